"""Text functions as column expressions; topics and phrases are Arrow functions, all others stay within the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillstream.config import STOP_WORDS

#: ASCII word boundary; Java's own is wider.
B = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: White space as browsers see it.
WS = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
# Formats of what is masked.
CARD = f"{B}(?:[0-9][ -]*?){{13,19}}{B}"
PHONE = f"(?:\\+?[0-9]{{1,3}}[-.\\s]?)?\\(?[0-9]{{3}}\\)?[-.\\s]?[0-9]{{3}}[-.\\s]?[0-9]{{4}}{B}|\\+[0-9]{{1,3}}\\s[0-9]{{3}}\\s[0-9]{{4}}\\s[0-9]{{4}}"
EMAIL = f"{B}[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]{{2,}}{B}"


def sanitize(text: Column) -> Column:
    """Mask card numbers with a valid check digit, then phone numbers, then e-mail addresses. Null stays null."""
    found = F.regexp_extract_all(text, F.lit(f"({CARD})"), F.lit(1))
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    cards = F.filter(found, lambda m: F.length(digits(m)).between(13, 19) & F.call_function("luhn_check", digits(m)))
    # cheap tests first: most texts hold nothing of the kind
    masked = F.when(text.rlike("(?:[0-9][ -]*){13}"), F.aggregate(cards, text, lambda acc, m: F.replace(acc, m, F.lit("[REDACTED_CC]")))).otherwise(text)
    phones = F.when(text.rlike("[0-9]{4}"), F.regexp_replace(masked, PHONE, "[REDACTED_PHONE]")).otherwise(masked)
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(phones, EMAIL, "[REDACTED_EMAIL]")).otherwise(phones)


def collapse(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def clean_tag_name(name: Column) -> Column:
    """Special characters stripped, words capitalised, at most 20 characters; null if nothing is left."""
    words = F.split(F.trim(F.regexp_replace(name, "[^A-Za-z0-9_\\s-]", "")), "\\s+")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), " ")
    return F.nullif(F.trim(F.substring(titled, 1, 20)), F.lit(""))


def topic_of(text: str | None) -> str | None:
    """See `noun_topic`."""
    best: dict[str, list] = {}
    for sentence in re.split(r"[.!?]+", text or ""):
        words = [w for w in re.split(r"\s+", re.sub(r"[^\w\s-]", "", sentence.strip(), flags=re.ASCII)) if len(w) >= 3]
        for i, w in enumerate(words):
            low = w.lower()
            if low not in STOP_WORDS:
                best.setdefault(low, [0, w])[0] += 1 + (("A" <= w[0] <= "Z") and (1 if i == 0 else 3))
    return max(best.values(), key=lambda x: x[0])[1] if best else None


@F.pandas_udf(StringType())
def _topics(texts: pd.Series) -> pd.Series:
    return texts.map(topic_of, na_action="ignore").astype(object)


def noun_topic(text: Column) -> Column:
    """The word with the greatest sum of scores, as first written; ties go to the word that comes first.

    A word counts 1, 2 if it is capitalised at the start of a sentence and 4 within one. A null text, or one without such
    words, has none. An Arrow function: sums over the words of one text would make columns interpret nested loops.
    """
    return _topics(text)


def card_title(text: Column) -> Column:
    """Title of a card: up to the first sentence end, or the first 65 characters with dots if there is none within 70."""
    clean = collapse(text)
    first = F.regexp_extract(clean, "^(.*?[.!?])(?:\\s|$)", 1)
    return F.when(text.isNull() | (text == ""), F.lit("")).when(first != "", first).when(F.length(clean) > 70, F.concat(F.substring(clean, 1, 65), F.lit("…"))).otherwise(clean)


def card_body(text: Column) -> Column:
    """What follows the title; the whole text if the title was cut."""
    clean = collapse(text)
    first = F.regexp_extract(clean, "^(.*?[.!?])(?:\\s|$)", 1)
    return F.when(text.isNull() | (text == ""), F.lit("")).when(first != "", F.trim(clean.substr(F.length(first) + 1, F.length(clean)))).when(F.length(clean) > 70, clean).otherwise(F.lit(""))


def local_entities(text: Column, category: Column) -> Column:
    """At most three entities: the category, two hashtags, then capitalised words of four letters or more."""
    ignored = F.array(*[F.lit(w) for w in ("with", "this", "that", "from", "they", "your", "about", "their", "there", "when", "more")])
    own = F.when(category.isNotNull() & ~category.isin("Unclassified", "Ads") & (category != ""), F.array(category)).otherwise(F.array().cast("array<string>"))
    hashtags = F.transform(F.slice(F.regexp_extract_all(text, F.lit("(#[A-Za-z0-9_]+)"), F.lit(1)), 1, 2), lambda t: F.substring(t, 2, 1000000))
    words = F.split(F.regexp_replace(text, "[^A-Za-z0-9_\\s]", ""), "\\s+")
    names = F.filter(words, lambda w, i: (i >= 1) & (F.length(w) >= 4) & w.rlike("^[A-Z]") & ~w.rlike("^[A-Z]+$") & ~F.array_contains(ignored, F.lower(w)))
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(F.concat(own, hashtags, names)), 1, 3))


@F.pandas_udf(ArrayType(StringType()))
def _runs(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[str] | None:
        if text is None:
            return None
        words = re.sub(r"[^\w\s-]", " ", text, flags=re.ASCII).lower().split()
        heavy = [len(w) >= 2 and w not in STOP_WORDS for w in words]
        return list(dict.fromkeys(" ".join(words[i : i + n]) for i in range(len(words)) for n in (2, 3) if i + n <= len(words) and all(heavy[i : i + n])))

    return texts.map(one)


def ngrams(text: Column) -> Column:
    """Neighbouring pairs and triples of words that carry weight, in lower case, each once. Null stays null."""
    return _runs(text)


def escape_html(text: Column) -> Column:
    """The five characters with a meaning in HTML, escaped."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def user_prompt(text: Column, platform: Column) -> Column:
    """A post as a model is asked about it: its source and its text in quotation marks."""
    return F.concat(F.lit("[Source: "), F.coalesce(platform, F.lit("unknown")), F.lit('] "'), F.coalesce(text, F.lit("")), F.lit('"'))


def extract_domain(url: Column) -> Column:
    """Host of a URL without the first `www.`; the input itself where it is no URL."""
    return F.coalesce(F.regexp_replace(F.lower(F.call_function("try_parse_url", url, F.lit("HOST"))), "^(.*?)www\\.", "$1"), url)


def relative_time(ms: Column, now_ms: int) -> Column:
    """Age in seconds, minutes, hours or days, rounded down."""
    s = F.floor((F.lit(now_ms) - ms) / 1000)
    return F.when(s < 60, F.concat(s, F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60), F.lit("m"))).when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h"))).otherwise(F.concat(F.floor(s / 86400), F.lit("d")))


def iso_utc(ms: Column) -> Column:
    """Milliseconds as ISO 8601 in UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def handle(url: Column) -> Column:
    """The last part of the URL's path in lower case without its first `@`; null where it is no URL."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.call_function("try_parse_url", url, F.lit("PATH")), "([^/]+)/*$", 1), "^([^@]*)@", "$1"))


def author_match(a: Column, b: Column, url_a: Column, url_b: Column) -> Column:
    """Do two authors match by name or handle? Equal, equal without marks, one within the other, the same last part of the
    URL, or an edit distance below a fifth. Null and blank names never match; the relation isn't transitive."""
    na, nb = F.lower(F.trim(a)), F.lower(F.trim(b))
    norm = lambda c: F.regexp_replace(c, "[@_\\s0-9-]", "")
    ma, mb = norm(na), norm(nb)
    longest = F.greatest(F.length(ma), F.length(mb))
    close = (1 - F.levenshtein(ma, mb) / F.nullif(longest, F.lit(0)) > 0.8) & (longest > 4)
    within = (F.length(ma) > 3) & (F.length(mb) > 3) & (ma.contains(mb) | mb.contains(ma))
    same_handle = (handle(url_a) != "") & (handle(url_a) == handle(url_b))
    return F.coalesce((na != "") & (nb != "") & ((na == nb) | ((ma == mb) & (F.length(ma) > 2)) | within | F.coalesce(same_handle, F.lit(False)) | F.coalesce(close, F.lit(False))), F.lit(False))
