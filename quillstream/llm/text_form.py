"""Problem 4: one consistent form for text that looks the same.

Method: confusables skeleton. A value is decomposed, every character is replaced by its prototype in
the look-alike table and the result is decomposed again; originals with equal skeletons look alike.
The consistent form follows the skeleton only where a letter poses as one of another script, so that
text in its own script, symbols, emoji sequences and joiners that a script needs stay as they are.

Only values that hold a suspicious character leave the JVM: one regular expression selects them, the
others reach the Python worker as nulls.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quillstream.session import cut

# Look-alike letters and their Latin prototypes (public Unicode knowledge).
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ѵ": "V",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "Ӏ": "I", "ɡ": "g", "ո": "n",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "γ": "y", "η": "n", "τ": "t", "ω": "w", "ε": "e",
    # Armenian
    "Տ": "S", "Օ": "O", "Լ": "L", "Ս": "U", "հ": "h", "ս": "u", "ց": "g", "օ": "o", "զ": "q", "ք": "p", "յ": "j",
    "ռ": "n", "ա": "w", "ղ": "n", "ը": "n", "ե": "t", "վ": "u", "ի": "h",
}
#: Latin letters that pose inside a word of another script.
LATIN_POSERS = frozenset("ABCEHIJKMOPSTXYaceijopsxy")
#: Letters whose look-alike is exact in any font; alone as a word they still count as posing.
EXACT_ALONE = frozenset("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο" + "АВЕЅІЈКМНОРСТХУаеѕіјорсух" + "Օօհոսց")
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff\u115f\u1160\u3164\uffa0"
#: Any character that can make a value inconsistent, for the JVM's regular expression.
SUSPICIOUS = f"[̀-ͯ{SPACES}{INVISIBLE}！-～Ͱ-ϿЀ-ԯ԰-֏ɡ]"

_SPACE = re.compile(f"[{SPACES}]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_SUSPICIOUS = re.compile(SUSPICIOUS)
_WORD = re.compile(r"[^\W\d_][^\W_]*")
_SENTENCE = re.compile(r"[^.!?\n…:;]+")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")
_RTL = re.compile("[֐-ࣿיִ-﷿ﹰ-ﻼ]")
_WIDTH = re.compile("[！-～]")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_TO_PROTOTYPE = str.maketrans(LOOKALIKES)
#: Letters the Russian alphabet lacks; alone they cannot make a Cyrillic word genuine.
_FOREIGN_CYRILLIC = frozenset("ѕіјһԁԛԝѵүӏЅІЈԚԜԌѴҮӀ")


def script(ch: str) -> str:
    """L(atin), G(reek), C(yrillic), A(rmenian) or O(ther)."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or o == 0x261 or 0xFF21 <= o <= 0xFF5A:
        return "L"
    if o < 0x370:
        return "L"
    if o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if o < 0x530:
        return "C"
    if o < 0x590:
        return "A"
    return "O"


def skeleton(text: str | None) -> str | None:
    """The value decomposed, mapped to prototypes and decomposed again; invisible characters vanish.

    Null stays null, an empty text stays empty.
    """
    if text is None:
        return None
    out = _INVISIBLE.sub("", unicodedata.normalize("NFD", text))
    out = _SPACE.sub(" ", out.translate(_WIDE)).translate(_TO_PROTOTYPE)
    return unicodedata.normalize("NFD", out)


def _keeps(text: str, i: int) -> bool:
    """True where the invisible character at `i` belongs: in emoji sequences and in scripts that need joiners."""
    ch, before, after = text[i], text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
    if ch in "\u200e\u200f\u061c\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069":
        return bool(_RTL.search(text))
    if "\ufe00" <= ch <= "\ufe0f":  # variation selector after a symbol
        return bool(before) and (unicodedata.category(before) in ("So", "Sm", "Po", "Sk", "Nd", "Lo") and not before.isalpha() or bool(_CJK.match(before)))
    if ch == "\u200d" and before and (unicodedata.category(before) in ("So", "Sk") or before == "\ufe0f"):
        return True
    if ch in "\u200c\u200d":
        return bool(before) and 0x0590 <= ord(before) < 0x1100 and (bool(after) and 0x0590 <= ord(after) < 0x1100 or ch == "\u200d" or unicodedata.category(before) == "Mn")
    return False


def _poses(word: str, genuine: frozenset[str] | set[str], latin: bool) -> bool:
    """Does a letter of `word` pose as one of another script, or the whole word so?"""
    by: dict[str, list[str]] = {}
    for ch in word:
        if ch.isalpha():
            by.setdefault(script(ch), []).append(ch)
    others = [s for s in by if s in "GCA"]
    if not others:
        return False
    if "L" in by or len(others) > 1:
        for s in others:
            if all(c in LOOKALIKES for c in by[s]):
                return True
        most = max((len(by[s]) + (s == "C") for s in others), default=0)
        return "L" in by and most >= 2 and all(c in LATIN_POSERS for c in by["L"])
    s = others[0]
    letters = by[s]
    if not all(c in LOOKALIKES for c in letters):
        return False
    if s == "C" and any(c in _FOREIGN_CYRILLIC for c in letters) and latin:
        return True
    if s in genuine or not latin:
        return False
    return len(letters) > 1 or letters[0] in EXACT_ALONE


def consistent(text: str | None) -> str | None:
    """The consistent form: composed accents, ordinary spaces and widths, no stray invisible characters,
    and posing letters replaced by their prototypes. Null stays null."""
    if not text or not _SUSPICIOUS.search(text):
        return text
    if _INVISIBLE.search(text):
        whole = text
        text = _INVISIBLE.sub(lambda m: m[0] if _keeps(whole, m.start()) else "", whole)
    text = _SPACE.sub(" ", unicodedata.normalize("NFC", text))
    if _WIDTH.search(text):
        if _CJK.search(text):
            text = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E and c.isalnum() else c for c in text)
        else:
            text = text.translate(_WIDE)

    return _SENTENCE.sub(_in_sentence, text) if _FOREIGN.search(text) else text


_FOREIGN = re.compile("[ɡͰ-֏]")


@lru_cache(maxsize=200_000)
def _script_of(word: str) -> tuple[bool, str]:
    """Has the word Latin letters, and the foreign script that it surely is in, if any."""
    kinds = {script(c) for c in word if c.isalpha()}
    sure = len(kinds) == 1 and len(word) > 1 and any(c not in LOOKALIKES for c in word)
    return "L" in kinds, s if sure and (s := next(iter(kinds))) in "GCA" else ""


@lru_cache(maxsize=200_000)
def _word_form(word: str, genuine: frozenset[str], latin: bool) -> str:
    """The word with its posing letters replaced, in a sentence with words surely in the scripts `genuine`."""
    if not _poses(word, genuine, latin):
        return word
    own = {script(c) for c in word if c.isalpha()}
    if "L" in own and all(c in LATIN_POSERS for c in word if script(c) == "L") and not all(c in LOOKALIKES for c in word if script(c) in "GCA"):
        return word.translate(_FROM_LATIN)
    return word.translate(_TO_PROTOTYPE)


def _in_sentence(m: re.Match) -> str:
    part = m[0]
    if not _FOREIGN.search(part):
        return part
    seen = [_script_of(w) for w in _WORD.findall(part)]
    genuine, latin = frozenset(s for _, s in seen if s), any(x for x, _ in seen)
    return _WORD.sub(lambda w: _word_form(w[0], genuine, latin), part)


_FROM_LATIN = {ord(v): k for k, v in LOOKALIKES.items() if v in LATIN_POSERS and script(k) == "C" and k not in _FOREIGN_CYRILLIC}


_CLUSTER = re.compile("[^\u0300-\u036f\u0483-\u0489\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\u1160-\u11ff\ufe20-\ufe2f][\u0300-\u036f\u0483-\u0489\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\u1160-\u11ff\ufe20-\ufe2f]*", re.S)


def origins(text: str) -> list[int]:
    """For every character of the consistent form the place in `text` that it comes from, and the text's length at the end.

    Only dropped invisible characters and composed accents move places; all other changes are one for one.
    """
    if not _SUSPICIOUS.search(text):
        return list(range(len(text) + 1))
    at = [i for i, ch in enumerate(text) if not _INVISIBLE.match(ch) or _keeps(text, i)]
    left = "".join(text[i] for i in at)
    out: list[int] = []
    done = 0
    for m in _CLUSTER.finditer(left):
        out += at[done : m.start()]  # marks without a letter
        n = len(unicodedata.normalize("NFC", m[0]))
        out += [at[min(m.start() + k, m.end() - 1)] for k in range(n)]
        done = m.end()
    out += at[done:]
    form = consistent(text)
    if len(out) != len(form):  # scripts that compose in other ways: places by common stretches
        out = [0] * len(form)
        for a, b, n in SequenceMatcher(None, form, text, autojunk=False).get_matching_blocks():
            out[a : a + n] = range(b, b + n)
        for k in range(1, len(out)):
            out[k] = max(out[k], out[k - 1])
    return [*out, len(text)]


def _form(value: str) -> str | None:
    """The form of a value if it is another of the same skeleton."""
    form = consistent(value)
    return form if form != value and skeleton(form) == skeleton(value) else None


@pandas_udf(StringType())
def _form_udf(s: pd.Series) -> pd.Series:
    return s.map(_form, na_action="ignore").astype(object)


@pandas_udf(StringType())
def _consistent_udf(s: pd.Series) -> pd.Series:
    return s.map(consistent, na_action="ignore").astype(object)


@pandas_udf(StringType())
def _skeleton_udf(s: pd.Series) -> pd.Series:
    return s.map(skeleton, na_action="ignore").astype(object)


def consistent_col(col: Column) -> Column:
    """Column form of `consistent`: only suspicious values are handed to Python."""
    return F.coalesce(_consistent_udf(F.when(col.rlike(SUSPICIOUS), col)), col)


def skeleton_col(col: Column) -> Column:
    """Column form of `skeleton`; for values without a mark or foreign letter it is the value itself."""
    return F.coalesce(_skeleton_udf(F.when(col.rlike("[^\\x00-\\x7f]"), col)), col)


def inconsistent_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows (key, field, value, form) of the values that aren't in the consistent form.

    Nulls and empty texts give no row; repeated rows are judged each under its own key. Columns of `df`
    other than the key and the fields are dropped first, so their names cannot clash. An empty table gives
    an empty result.
    """
    long = df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x"))
    long = long.select(key, "x.field", "x.value").where(F.col("value").rlike(SUSPICIOUS))
    return long.withColumn("form", _form_udf("value")).where("form is not null")


def skeleton_groups(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Different values grouped by equal skeleton: rows (field, skeleton, value, form, n_rows, n_values) of every value
    that looks like another or isn't in the consistent form, with the number of its rows and of the different
    values that look like it. `skeleton` is the skeleton's hash.

    Hashes are counted and combined before each shuffle, so a value or skeleton that holds a third of all rows is one row by
    then; only the values that come out are shuffled themselves. Null values are left out; an empty text is a value.
    """
    long = df.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select("key", "x.field", "x.value").where("value is not null")
    hashed = long.select("key", "field", F.md5("value").alias("v"), F.md5(skeleton_col(F.col("value"))).alias("skeleton"), F.coalesce(F.md5(_form_udf(F.when(F.col("value").rlike(SUSPICIOUS), F.col("value")))), F.lit("")).alias("f"))
    values = cut(hashed.groupBy("field", "v", "skeleton", "f").agg(F.count("*").alias("n_rows"), F.min("key").alias("key")))
    sizes = values.groupBy("field", "skeleton").agg(F.count("*").alias("n_values"))
    wanted = values.join(sizes.hint("merge"), ["field", "skeleton"]).where("n_values > 1 or f <> ''")
    out = wanted.join(long.hint("merge"), ["field", "key"]).where(F.md5("value") == F.col("v"))
    return out.select("field", "skeleton", "value", consistent_col(F.col("value")).alias("form"), "n_rows", "n_values").dropDuplicates(["field", "skeleton", "value"])
