"""Problem 9: garbled text from a wrong character encoding.

Method: the garbled sequences of all encoding pairs are computed beforehand and found with a
multi-pattern automaton; only matched spans are replaced, mixed correct text stays untouched.

Three families of pairs:

* Pairs with an East Asian encoding. UTF-8 or a Western single-byte text read as one leaves single characters attached to
  Latin letters ("caf茅"); all letters and signs of Western text, alone or with the letter that follows, give the
  patterns, and they count if the text holds no other East Asian character. A text in such an encoding read as a
  Western one gives pairs of accented letters and signs; three or more pairs in a row count.
* UTF-8 read as a single-byte encoding. Each lead byte with a continuation byte gives a pattern for
  every wrong encoding; a match counts if the whole UTF-8 sequence decodes to a plausible character.
* A single-byte encoding read as another. One garbled letter proves nothing, so the sequences are whole
  tokens: every distinct token of the corpus that holds a character beyond ASCII is decoded anew under
  all pairs, and it is garbled if the result is far more frequent in the corpus than itself, or if the
  token cannot stand as written (a symbol or another script inside a word, a capital inside a
  lower-case word) and the result can.

Text with replacement characters, stray C1 controls or private-use characters is found, too, though what
was lost cannot come back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Encodings as Python names them.
WRONG_FOR_UTF8 = ("cp1252", "latin_1", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "koi8_r", "cp866", "iso8859_2", "cp1253", "cp1254")
SINGLE_BYTE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_2", "iso8859_5")
EAST_ASIAN = ("gbk", "shift_jis", "big5", "euc_kr")
WRONG_FOR_EAST_ASIAN = ("cp1252", "latin_1", "mac_roman")
#: Pairs in a row that make a text of an East Asian encoding.
PAIRS = 3
#: A restored token must be this many times as frequent as the garbled one, and occur so often at least.
RATIO, LEAST = 5, 3

_LOST = re.compile("[�\x80-\x84\x86-\x9f-]")
LOST = "[\\x{FFFD}\\x{80}-\\x{84}\\x{86}-\\x{9F}\\x{E000}-\\x{F8FF}]"


@lru_cache(maxsize=None)
def _bytes_of(name: str) -> dict[str, int]:
    """Upper half of a single-byte encoding: character to byte. Undefined bytes stand as C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if name.startswith("cp125"):  # browsers pass undefined bytes through, and mail programs mix both tables
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


def _plausible(ch: str) -> bool:
    """Characters that a text is likely to hold; others are chance."""
    o = ord(ch)
    if o < 0xA0:
        return 0x80 <= o
    if o < 0x180 or 0x218 <= o <= 0x21B or 0x2C6 <= o <= 0x2DD:
        return True
    if o < 0x250:
        return o == 0x192
    if 0x300 <= o < 0x370 or 0x370 <= o < 0x530 or 0x590 <= o < 0x700 or 0x900 <= o < 0x980 or 0xE00 <= o < 0xE80:
        return unicodedata.category(ch) != "Cn"
    if 0x1E00 <= o < 0x1F00 or 0x2000 <= o < 0x2070 or 0x20A0 <= o < 0x20C0 or 0x2100 <= o < 0x2800 or 0x3000 <= o < 0x3100:
        return unicodedata.category(ch) != "Cn"
    return 0x3400 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4 or 0xF000 <= o < 0xF900 or 0xFB00 <= o < 0xFB07 or 0xFE00 <= o < 0xFE10 or o in (0xFEFF, 0xFFFD) or 0xFF00 <= o < 0xFFF0 or 0x1F000 <= o < 0x1FB00


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Patterns of the first two characters of every garbled UTF-8 sequence; values: wrong encodings."""
    at: dict[str, list[str]] = {}
    for name in WRONG_FOR_UTF8:
        table = _bytes_of(name)
        leads = [(c, b) for c, b in table.items() if 0xC2 <= b < 0xF5]
        tails = [c for c, b in table.items() if 0x80 <= b < 0xC0]
        for lead, _ in leads:
            for t in tails:
                at.setdefault(lead + t, []).append(name)
    auto = ahocorasick.Automaton()
    for p, names in at.items():
        auto.add_word(p, (p, tuple(names)))
    auto.make_automaton()
    return auto


def _sequence(text: str, i: int, name: str) -> tuple[int, str] | None:
    """The UTF-8 sequence that starts at `i` as read under `name`: its length and its character."""
    table = _bytes_of(name)
    lead = table.get(text[i], 0)
    n = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    if i + n > len(text):
        return None
    raw = [lead] + [table.get(c, 0) for c in text[i + 1 : i + n]]
    try:
        ch = bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return None
    if len(ch) != 1 or not _plausible(ch):
        return None
    seen = text[i : i + n]
    if n > 2 and seen.isalpha() and (ch.isalpha() or seen.islower()):
        return None  # a word of its own language that happens to spell a sequence
    return n, ch


def utf8_spans(text: str) -> list[tuple[int, int, str]]:
    """Matched spans (start, end, restored) of UTF-8 read as a single-byte encoding, left to right."""
    out, done = [], -1
    for end, (pair, names) in _automaton().iter(text):
        i = end - 1
        if i < done:
            continue
        best = None
        for name in names:
            j, got = i, []
            while j < len(text) and (s := _sequence(text, j, name)):
                j, got = j + s[0], got + [s[1]]
            if got and (best is None or j > best[1]) and _counts(text, i, j, got, name):
                best = (i, j, "".join(got))
        if best:
            out.append(best)
            done = best[1]
    return out


_EAST = re.compile("[぀-ヿ㐀-鿿가-힣｡-ﾟ]")
_WESTERN = [chr(c) for c in (*range(0xC0, 0x180), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026)]


@lru_cache(maxsize=1)
def _east_automaton() -> ahocorasick.Automaton:
    """What Western letters and signs, with or without the letter after them, look like read as an East Asian encoding."""
    at: dict[str, dict[str, str]] = {}
    after = ["", *"abcdefghijklmnopqrstuvwxyz ,.-"]
    for wrong in EAST_ASIAN:
        for right in ("utf-8", "cp1252"):
            for c in _WESTERN:
                for x in after:
                    try:
                        seen = (c + x).encode(right).decode(wrong)
                    except UnicodeError:
                        continue
                    if _EAST.match(seen) and not seen[-1].isascii():
                        at.setdefault(seen, {})[f"{right} as {wrong}"] = c + x
    auto = ahocorasick.Automaton()
    for seen, meant in at.items():
        auto.add_word(seen, (seen, meant))
    auto.make_automaton()
    return auto


def east_spans(text: str) -> list[tuple[int, int, str]]:
    """Matched spans (start, end, restored) of Western text read as an East Asian encoding, left to right; none unless one
    pair of encodings explains all East Asian characters of the text and Latin letters stand beside them."""
    if not _EAST.search(text):
        return []
    every = len(_EAST.findall(text))
    by: dict[str, list[tuple[int, int, str]]] = {}
    for end, (seen, meant) in _east_automaton().iter(text):
        for pair, right in meant.items():
            by.setdefault(pair, []).append((end - len(seen) + 1, end + 1, right))
    latin = lambda c: c.isascii() and c.isalpha()
    for _, spans in sorted(by.items()):
        out, done = [], 0
        for i, j, right in sorted(spans, key=lambda x: (x[0], -x[1])):
            if i >= done:
                out.append((i, j, right))
                done = j
        beside = [latin(text[i - 1 : i]) or latin(text[j : j + 1]) for i, j, _ in out]
        if sum(len(_EAST.findall(text[i:j])) for i, j, _ in out) == every and any(beside) and all(x or not r[0].isalpha() for x, (_, _, r) in zip(beside, out)):
            return out
    return []


@lru_cache(maxsize=1)
def _pair_automaton() -> ahocorasick.Automaton:
    """What kana and the commonest ideographs and syllables look like in pairs of Western letters and signs."""
    at: dict[str, list[tuple[str, str]]] = {}
    for right in EAST_ASIAN:
        # the first rows of each table hold the kana and the characters in common use
        rows = {"gbk": [(a, b) for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF)], "big5": [(a, b) for a in range(0xA4, 0xC7) for b in (*range(0x80, 0x80), *range(0xA1, 0xFF))],
                "euc_kr": [(a, b) for a in range(0xB0, 0xC9) for b in range(0xA1, 0xFF)], "shift_jis": [(a, b) for a in (0x82, 0x83) for b in range(0x80, 0xF2)]}[right]
        for wrong in WRONG_FOR_EAST_ASIAN:
            seen_as = {b: c for c, b in _bytes_of(wrong).items()}
            for a, b in rows:
                try:
                    c = bytes((a, b)).decode(right)
                except UnicodeDecodeError:
                    continue
                at.setdefault(seen_as[a] + seen_as[b], []).append((f"{right} as {wrong}", c))
    auto = ahocorasick.Automaton()
    for pair, meant in at.items():
        auto.add_word(pair, (pair, dict(meant)))
    auto.make_automaton()
    return auto


_DENSE = re.compile("[^\x00-\x7f\u0370-\u1fff\u3000-\uffff]{6}")


def pair_spans(text: str) -> list[tuple[int, int, str]]:
    """Matched spans (start, end, restored) of East Asian text read as a Western encoding: `PAIRS` or more pairs in a row."""
    if not _DENSE.search(text):
        return []
    at = {end - 1: meant for end, (_, meant) in _pair_automaton().iter(text)}
    out, i = [], 0
    while i < len(text):
        best = None
        for pair in at.get(i, ()):
            j, got = i, []
            while pair in at.get(j, ()):
                got.append(at[j][pair])
                j += 2
            if len(got) >= PAIRS and (best is None or j > best[1]):
                best = (i, j, "".join(got))
        if best and not text[best[0] : best[1]].isupper():
            out.append(best)
            i = best[1]
        else:
            i += 1
    return out


def spans(text: str) -> list[tuple[int, int, str]]:
    """Matched spans of all families whose sequences are computed beforehand."""
    one, two = utf8_spans(text), pair_spans(text)
    return (two if sum(j - i for i, j, _ in two) > sum(j - i for i, j, _ in one) else one) or east_spans(text)


def _counts(text: str, i: int, j: int, got: list[str], name: str) -> bool:
    """A lone sequence is chance where a capital that ends a word is followed by a quotation mark, dash or dots."""
    if len(got) > 1 or j - i > 2:
        return True
    lead, tail, before = text[i], text[i + 1], text[i - 1] if i else " "
    if lead.isupper() and not tail.isalnum() and (unicodedata.category(tail) in ("Pi", "Pf", "Pd", "Po", "Ps") or tail in "»«"):
        same = before.isupper() and unicodedata.name(before, "?")[:5] == unicodedata.name(lead, "?")[:5]
        after = text[j] if j < len(text) else " "
        return not same and (after.isalnum() or before.isalnum()) and not (before in " «“„(" and not after.isalnum())
    if lead.islower() and tail.islower():  # Polish "óż" and the like are lead bytes of longer sequences only
        return False
    if lead.isupper() and tail.isalpha() and name in ("cp1251", "cp866", "koi8_r", "iso8859_2", "cp1250", "cp1253"):
        return got[0].isalpha() and not (before.isspace() or not before.isalnum()) or got[0] not in "иеовс" and ord(got[0]) < 0x400
    return True


_SYMBOL_INSIDE = re.compile("[^\\W\\d_][∂-⋿⌠⌡⌐─-▟ⁿ‰‡„¸ˆ˜˙-˝·÷¢-¦¨¬±³¶¿∙ﬁﬂ][^\\W\\d_]")
_CAPITAL_INSIDE = re.compile("[a-z][À-ÖØ-Þ][a-z]")
_CP437_GREEK = frozenset("αΓπΣστΦΘΩδφε")


def _stands(token: str) -> bool:
    """Can the token stand as written?"""
    if _SYMBOL_INSIDE.search(token) or _CAPITAL_INSIDE.search(token) or "ⁿ" in token and re.search("[a-z]", token):
        return False
    return not (any(c in _CP437_GREEK for c in token) and len(re.findall("[A-Za-z]", token)) > 1 and not re.search("[α-ωΑ-Ω]{2}", token) and re.search("[A-Za-z][αΓπΣστΦΘΩδφε]|[αΓπΣστΦΘΩδφε][A-Za-z]", token))


def anew(token: str) -> dict[str, str]:
    """The token decoded anew under all pairs of single-byte encodings: result to pair."""
    out: dict[str, str] = {}
    for wrong in SINGLE_BYTE:
        table = _bytes_of(wrong)
        try:
            raw = bytes(table[c] if c in table else ord(c) if ord(c) < 128 else 1 / 0 for c in token)
        except ZeroDivisionError:
            continue
        for right in SINGLE_BYTE:
            if right != wrong:
                try:
                    s = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if s != token:
                    out.setdefault(s, f"{right} as {wrong}")
    return out


def _anew_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(t, n, s, _stands(t), _stands(s) and all(c.isalpha() or c in ".,:;!?()'\"-“”’‘–—…«»¿¡" for c in s)) for t, n in zip(b["token"], b["n"]) for s in anew(t)]
        yield pd.DataFrame(rows, columns=["token", "n", "result", "stands", "result_stands"])


#: A token for the counts: digits as 0, without ASCII punctuation at its ends.
def _tokens(docs: DataFrame, key: str) -> DataFrame:
    words = docs.where(F.col("text").rlike("[^\\x00-\\x7f]")).select(key, F.xxhash64("text").alias("same"), F.explode(F.array_distinct(F.filter(F.split("text", "\\s+"), lambda w: w.rlike("[^\\x00-\\x7f]")))).alias("raw"))
    shape = F.regexp_replace(F.regexp_replace("raw", "[0-9]+", "0"), "^[\\x21-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e]+|[\\x21-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e]+$", "")
    return words.withColumn("token", shape)


def garbled_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens that are another token under a wrong single-byte encoding: (token, result).

    Counted over the different texts of all rows, so that copies of a garbled text cannot make it the commoner form;
    counts are combined before the shuffle, so that a token of a third of all rows is one row when it is joined.
    """
    counts = tokens.select("token", "same").distinct().groupBy("token").agg(F.count("*").alias("n")).where("token <> ''")
    tries = counts.mapInPandas(_anew_batches, "token string, n long, result string, stands boolean, result_stands boolean")
    known = counts.select(F.col("token").alias("result"), F.col("n").alias("n_result"))
    judged = tries.join(known, "result", "left").withColumn("n_result", F.coalesce("n_result", F.lit(0)))
    frequent = (F.col("n_result") >= LEAST) & (F.col("n_result") >= RATIO * F.col("n")) & (F.col("result_stands") | ~F.col("stands") | F.col("result").rlike("[^\\p{L}]"))
    cannot = ~F.col("stands") & F.col("result_stands")
    best = judged.where(frequent | cannot).groupBy("token").agg(F.max_by("result", F.struct("n_result", "result")).alias("result"))
    return best


@F.pandas_udf(BooleanType())
def _has_span(s: pd.Series) -> pd.Series:
    return s.map(lambda t: bool(spans(t)), na_action="ignore").fillna(False).astype(bool)


def _flagged(docs: DataFrame, key: str) -> DataFrame:
    some = docs.where(F.col("text").rlike("[^\\x00-\\x7f]"))
    return some.where(F.col("text").rlike(LOST) | _has_span("text")).select(key)


def garbled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of the rows whose text shows characters of a wrong decoding.

    Null, empty and blank texts are no cases, texts of any length are read whole, a repeated row is judged
    under its own key, other columns are dropped first, and an empty table gives an empty result.
    """
    docs = df.select(F.col(key), F.col(text).alias("text"))
    tokens = _tokens(docs, key)
    by_token = tokens.join(garbled_tokens(tokens), "token").select(key)
    return _flagged(docs, key).unionByName(by_token).distinct()


def _restore(text: str | None, pairs) -> str | None:
    if text is None:
        return None
    for _ in range(3):  # text may have been garbled more than once
        found = spans(text)
        if not found:
            break
        out, at = [], 0
        for i, j, s in found:
            out += [text[at:i], s]
            at = j
        text = "".join(out) + text[at:]
    whole_tokens: dict[str, str] = {}
    for raw, token, result in pairs if pairs is not None else ():
        core = re.sub("[0-9]+", "0", raw)
        k = core.find(token)
        if k < 0:
            continue
        digits = re.findall("[0-9]+", raw)
        whole = core[:k] + result + core[k + len(token) :]
        it = iter(digits)
        fixed = re.sub("0", lambda m: next(it, "0"), whole) if whole.count("0") == len(digits) else raw
        whole_tokens[raw] = fixed
    return _SOLID.sub(lambda m: whole_tokens.get(m[0], m[0]), text) if whole_tokens else text


_SOLID = re.compile("[^ \t\n\x0b\f\r]+")


def restored(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, restored) of the found records: matched spans replaced, the rest unchanged; what was lost stays."""
    docs = df.select(F.col(key), F.col(text).alias("text"))
    tokens = _tokens(docs, key)
    swaps = tokens.join(garbled_tokens(tokens), "token").groupBy(key).agg(F.collect_set(F.struct("raw", "token", "result")).alias("swaps"))
    found = docs.join(_flagged(docs, key).unionByName(swaps.select(key)).distinct(), key).join(swaps, key, "left")

    @F.pandas_udf("string")
    def restore(t: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([_restore(x, None if p is None else [(q["raw"], q["token"], q["result"]) for q in p]) for x, p in zip(t, pairs)], dtype=object)

    return found.select(key, restore("text", "swaps").alias("restored"))
