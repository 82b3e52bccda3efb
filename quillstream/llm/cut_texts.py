"""Problem 1: texts cut off by field limits.

Method: self-join by prefix. A text that was cut ends in a fragment that is a strict prefix of longer copies
elsewhere. Whole texts seldom return, sentences and phrases do, so the join works on the last, unfinished
sentence of a text: hashes of its whole token prefix, of its last tokens and of the letters of its last word
meet the hashes of all prefixes of all finished sentences of the corpus. Where the longer copies outnumber
the copies that end there, the text was cut. A mark that a cut leaves (an unfinished link or entity, "[...]",
"see more", half a character) decides alone; a closing phrase that many posts end with and no sentence
continues is the writer's own.

Only posts whose end is open make queries. Their hashes fill a bit array of fixed size, which lets the
tasks drop the sentence prefixes that nobody asks for before anything is shuffled; a fuller array only
lets more of them through. Counts are combined within a batch and again before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.bitmap import bitmap, has
from quillstream.llm.text_form import consistent
from quillstream.session import cut

#: A closing phrase counts as the writers' own from so many posts on if its letters go on nowhere, else from this
#: share of all posts on; and this share of longer copies is a cut.
CLOSERS, CLOSERS_SHARE, SHARE = 3, 0.0008, 0.5
#: A length is a platform's limit if this share of its cut texts, and at least `CLOSERS`, have it.
LIMIT_SHARE = 0.15
FAMILIES = 10
ASKS = FAMILIES
_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[,;:“”«»–—(·=/]")
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
#: One class comes first, as the search then skips to its characters.
_END = re.compile(rf"[.!?…\n](?:(?<=\n)\n*|(?<!\n)[.!?…]*[»”\"')\]]*(?:\s+(?!{_MONTHS})|$))")
_ABBREVIATION = re.compile(r"(?:\b[A-ZÀ-Þ]|\b(?:Dr|Mr|Ms|Mrs|Prof|no|ul|St|tel|ext|Nr))$")


def _boundaries(text: str) -> Iterator[re.Match]:
    """Ends of sentences and lines; a dot after an initial or an abbreviation is none."""
    for m in _END.finditer(text):
        i = m.start()
        if text[i] != "." or i >= 5 and text[i - 5 : i].isalpha() or not _ABBREVIATION.search(text, max(0, i - 5), i):
            yield m


_HARD = re.compile(r"(?:\[\.\.\.\]|\[…\]|\[\+\]|(?:\.\.\.|…)\s*(?:see more|more|read more|weiterlesen|mehr|lire la suite|ver más)|�|https?://\w*|&#?\w{0,6};?|(?:…|\.\.\.)\s*(?:continue reading|continued)|\((?:more|cont)\))\s*$")
_DOTS = re.compile(r"\s*(?:\.\.\.|…)\s*$")
_DRESS = re.compile(r"(?:#\w+|https?://\S+\.\S+|[☀-➿\U0001F000-\U0001FAFF\ufe0f\u200d♀♂]+)$")
#: Marks of a cut are shorter than this.
TAIL = 80
_STOPPED = re.compile(r"[.!?][»”\"')\]]*$")
#: A label of two to four words before a colon opens a remark, not a sentence.
_LABEL = re.compile(r"(?:PS|P\.S\.|NB|EDIT|edit|[A-ZÀ-Þ][a-zà-ÿ]+(?: [a-zà-ÿ]+){1,3})\s?:")
_DIGITS = re.compile(r"\d+")


def _shape(tok: str, first: bool) -> str:
    """Digits as 0, capitalised words within a sentence as one class, others in lower case."""
    if tok[0].isdigit():
        return _DIGITS.sub("0", tok).lower()
    if not first and tok[0].isupper():
        return "N"
    return tok.lower()


def _h(s: str) -> int:
    return xxhash.xxh64_intdigest(s)


def _tokens(sentence: str) -> list[str]:
    """Shaped tokens; capitalised words in a row are one."""
    out: list[str] = []
    for k, t in enumerate(_TOKEN.findall(sentence)):
        s = _shape(t, k == 0)
        if s != "N" or not out or out[-1] != "N":
            out.append(s)
    return out


def _prefix(hashes: list[int]) -> int:
    """Hash of a whole token prefix."""
    h = 0
    for x in hashes:
        h = ((h ^ x) * 0x9E3779B97F4A7C15 + 0x165667B1) & (2**64 - 1)
    return h


def _tag(h: int, family: int) -> int:
    h = ((h ^ (family * 0xC2B2AE3D27D4EB4F)) * 0xD6E8FEB86659FD93) & (2**64 - 1)
    return h ^ (h >> 29)


def _suffix(hashes: list[int]) -> int:
    h = len(hashes)
    for x in hashes:
        h = (h * 0x27D4EB2F165667C5 + x) & (2**64 - 1)
    return h


def contexts(sentence: str) -> list[tuple[int, int]]:
    """Hashes of an open fragment by family: 0 its whole prefix, 1 its first two and last two tokens, 2 to 5 its last
    five to two tokens, 6 its last word as written, 7 and 8 the letters of its last word after the whole prefix or
    after the token before, 9 the letters of a capitalised last word. `ASKS` is the prefix before the last word: no
    counts, it only tells where the letters of family 7 are asked for."""
    toks = _tokens(sentence)
    raw = _TOKEN.findall(sentence)
    hs = [_h(t) for t in toks]
    out = [(0, _prefix(hs))]
    if len(hs) > 3:
        out.append((1, _suffix([*hs[:2], *hs[-2:], 77])))
    out += [(7 - k, _suffix(hs[-k:])) for k in (5, 4, 3, 2) if len(hs) >= k]
    last = raw[-1].lower()
    if raw[-1][0].isalpha():
        out.append((6, _h(last)))
        out.append((7, _prefix([*hs[:-1], _h("~" + last)])))
        out.append((ASKS, _prefix(hs[:-1])))
        if len(hs) > 1:
            out.append((8, _suffix([hs[-2], _h("~" + last)])))
        if raw[-1][0].isupper():
            out.append((9, _h("~" + last)))
    return [(f, _tag(h, f)) for f, h in out]


def _undressed(text: str) -> str:
    """The text without tags, links and emoji at its end."""
    while True:
        t = text.rstrip()
        last = t.rsplit(None, 1)[-1:] or [""]
        m = _DRESS.search(last[0])
        if not m or m.start() and last[0][0] == "#":
            return t
        text = t[: len(t) - len(m[0])]


def split_end(text: str) -> tuple[str, bool, bool]:
    """(open fragment, hard mark, dots): the unfinished last sentence of a text, empty if it was finished."""
    t = text.rstrip()
    tail = t[-TAIL:]
    m = _HARD.search(tail)
    if m and not (m[0].startswith("&") and (m.end() - m.start() > 6 or tail[m.start() - 1 : m.start()].isalnum())):
        return "", True, False
    bare = _undressed(t)
    dots = bare.endswith(("...", "…"))
    if dots:
        bare = _DOTS.sub("", bare)
    elif not bare or _STOPPED.search(bare[-8:]):
        return "", False, False
    ends = [e.end() for e in _boundaries(bare)]
    return bare[ends[-1] if ends else 0 :].strip(), False, dots


def _query_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, length, hard, frag, fam, hashed, whole = [], [], [], [], [], [], []
        for k, t in enumerate(b.column(1).to_pylist()):
            if not t or not t.strip():
                continue
            f, mark, dots = split_end(t if t.isascii() else consistent(t))
            if not mark and not f:
                continue
            tokens = _TOKEN.findall(f)
            c = contexts(f) if tokens else []
            at.append(k)
            length.append(len(t))
            # 2: certain, 1: open, 0: a label or a bracket closes it
            hard.append(2 if mark or re.search(r"[,;:–—(“«-]$", f) else 0 if _LABEL.match(f) and len(f) < 70 or re.fullmatch(r"\(.*\)|<.*>", f) else 1)
            frag.append(f"{_h(f.lower()):x}" if tokens else "")
            whole.append(_h(" ".join(t.lower().split())) - 2**63)
            fam.append([x for x, _ in c])
            hashed.append([x - 2**64 if x >= 2**63 else x for _, x in c])
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(at, pa.int64())), pa.array(length, pa.int32()), b.column(2).take(pa.array(at, pa.int64())), pa.array(hard, pa.int8()), pa.array(frag, pa.string()), pa.array(fam, pa.list_(pa.int8())), pa.array(hashed, pa.list_(pa.int64())), pa.array(whole, pa.int64())],
            names=["key", "n", "source", "mark", "frag", "family", "hash", "whole"],
        )


def _counted(bits: np.ndarray):
    """Batches of texts to rows (hash, ends, goes_on) of the sentence prefixes that somebody asks for."""

    def wanted(h: np.ndarray) -> np.ndarray:
        return has(bits, h.view(np.int64))

    def tag(h: np.ndarray, family: int) -> np.ndarray:
        h = (h ^ np.uint64(family * 0xC2B2AE3D27D4EB4F & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for b in batches:
            if len(lexicon.words) > 500_000:
                lexicon = Lexicon()
            flat: list[int] = []
            lengths: list[int] = []
            index = lexicon.index
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                if not t.isascii():
                    t = consistent(t)
                at = 0
                for m in _boundaries(t):
                    s = t[at : m.end()]
                    at = m.end()
                    if m[0][0] == "…" or m[0].startswith("...") or m[0][0] == "\n" and s.rstrip()[-1:] not in ".!?":
                        continue
                    ids = [index[w] for w in _TOKEN.findall(s)]
                    if ids:
                        flat += ids
                        lengths.append(len(ids))
            if not flat:
                continue
            arrays = lexicon.arrays()
            with np.errstate(over="ignore"):
                counts = [*_sentence_contexts(np.array(flat, np.int64), np.array(lengths, np.int64), arrays, tag), *_letter_contexts(arrays, tag, wanted)]
            hashes = np.concatenate([c[0] for c in counts])
            ends, goes = np.concatenate([c[1] for c in counts]), np.concatenate([c[2] for c in counts])
            keep = wanted(hashes)
            u, inv = np.unique(hashes[keep], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inv, ends[keep], len(u)).astype(np.int64)), pa.array(np.bincount(inv, goes[keep], len(u)).astype(np.int64))], names=["hash", "ends", "goes_on"])

    return run


def _letters(low: str) -> list[int]:
    """Hashes of all strict prefixes of a word."""
    if len(low) <= 64:
        return [_h("~" + low[:i]) for i in range(1, len(low))]
    x = xxhash.xxh64("~")
    out = []
    for c in low[:-1]:
        x.update(c)
        out.append(x.intdigest())
    return out


class Lexicon:
    """The words of a worker's texts with their hashes, each worked out once."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.rows: list[tuple[int, int, bool, bool, bool, int]] = []
        self.letters: list[int] = []
        self.starts: list[int] = [0]
        self.pairs: np.ndarray | None = None
        self.uses: np.ndarray | None = None
        outer = self

        class Index(dict):
            def __missing__(self, w: str) -> int:
                self[w] = k = len(outer.words)
                outer.words.append(w)
                shaped, low = _shape(w, False), w.lower()
                outer.rows.append((_h(shaped), _h(_shape(w, True)), shaped == "N", w[0].isalpha(), w[0].isupper(), _tag(_h(low), 6)))
                if w[0].isalpha():
                    outer.letters += _letters(low)
                outer.starts.append(len(outer.letters))
                return k

        self.index = Index()

    def arrays(self) -> dict[str, np.ndarray]:
        h, first, name, alpha, capital, raw = zip(*self.rows)
        return {
            "shape": np.array(h, np.uint64), "first": np.array(first, np.uint64), "name": np.array(name), "alpha": np.array(alpha), "capital": np.array(capital), "raw": np.array(raw, np.uint64),
            "letters": np.array(self.letters, np.uint64), "starts": np.array(self.starts, np.int64),
        }


def _sentence_contexts(flat: np.ndarray, lengths: np.ndarray, x: dict[str, np.ndarray], tag) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, ends, goes on) of families 0 to 5 at every token of the sentences; leaves what the letters need in `x`."""
    sent = np.repeat(np.arange(len(lengths)), lengths)
    first = np.r_[True, sent[1:] != sent[:-1]]
    h = np.where(first, x["first"][flat], x["shape"][flat])
    name = x["name"][flat] & ~first
    keep = ~(name & np.r_[False, name[:-1]] & ~first)
    x["uses"] = np.bincount(flat, minlength=len(x["raw"]))
    h, sent = h[keep], sent[keep]
    start = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]])
    size = np.diff(np.r_[start, len(h)])
    p = np.arange(len(h)) - np.repeat(start, size)
    last = p == np.repeat(size, size) - 1
    before = np.where(p == 0, np.uint64(0), np.r_[np.uint64(0), h[:-1]])
    whole = np.zeros(len(h), np.uint64)
    longest_first = np.argsort(-size, kind="stable")
    begins, sizes = start[longest_first], size[longest_first]
    for k in range(int(size.max())):
        i = begins[: np.searchsorted(-sizes, -k)] + k  # the sentences of more than k tokens
        whole[i] = ((whole[i - 1] if k else np.uint64(0)) ^ h[i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x165667B1)
    # the words of a name follow what stands before the name
    of = np.cumsum(keep) - 1
    x["before"], x["kept"] = before[of], flat
    x["prefix"] = np.where(p == 0, np.uint64(0), np.r_[np.uint64(0), whole[:-1]])[of]
    mult = np.uint64(0x27D4EB2F165667C5)
    begin = np.repeat(start, size)
    i = np.flatnonzero(p >= 3)
    s = np.full(len(i), 5, np.uint64)
    for part in (h[begin[i]], h[begin[i] + 1], h[i - 1], h[i], np.full(len(i), 77, np.uint64)):
        s = s * mult + part
    found = [(tag(whole, 0), np.arange(len(h))), (tag(s, 1), i)]
    for k in (5, 4, 3, 2):
        i = np.flatnonzero(p >= k - 1)
        s = np.full(len(i), k, np.uint64)
        for j in range(k - 1, -1, -1):
            s = s * mult + h[i - j]
        found.append((tag(s, 7 - k), i))
    for hashes, i in found:
        yield hashes, last[i].astype(np.int64), (~last[i]).astype(np.int64)


def _letter_contexts(x: dict[str, np.ndarray], tag, wanted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, 0, uses) of families 6 to 9: words as written, and the letters that words go on from."""
    mult = np.uint64(0x27D4EB2F165667C5)
    used = np.flatnonzero((x["uses"] > 0) & x["alpha"])
    yield x["raw"][used], np.zeros(len(used), np.int64), x["uses"][used]

    def letters(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = x["starts"][words + 1] - x["starts"][words]
        owner = np.repeat(np.arange(len(words)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + x["starts"][words][owner]
        return x["letters"][at], owner

    def counted(left: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters of the different words after each of `left`, what stands before them, and their uses."""
        mixed = left * np.uint64(0xC2B2AE3D27D4EB4F) ^ (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at, n = np.unique(mixed, return_index=True, return_counts=True)
        part, owner = letters(words[at])
        return part, left[at][owner], n[owner]

    capital = used[x["capital"][used]]
    part, owner = letters(capital)
    yield tag(part, 9), np.zeros(len(part), np.int64), x["uses"][capital][owner]
    asked = np.flatnonzero(wanted(tag(x["prefix"], ASKS)))
    part, left, n = counted(x["prefix"][asked], x["kept"][asked])
    yield tag((left ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x165667B1), 7), np.zeros(len(part), np.int64), n
    later = np.flatnonzero(x["before"])
    part, left, n = counted(x["before"][later], x["kept"][later])
    yield tag((np.uint64(2) * mult + left) * mult + part, 8), np.zeros(len(part), np.int64), n


def _longer(family: int) -> tuple[Column, Column]:
    f = F.col("family") == family
    return F.max(F.when(f, F.col("ends"))).alias(f"e{family}"), F.max(F.when(f, F.col("goes_on"))).alias(f"g{family}")


def cut_off(df: DataFrame, key: str = "seq", text: str = "text", source: str = "sourcePlatform") -> DataFrame:
    """Keys of the rows whose text was cut off, with the reason (mark, word, sentence or limit).

    Null, empty and blank texts are no cases; texts are read whole; a repeated row is judged under its own key, and
    its copies are no longer copies of it; extra columns are dropped first; an empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), platform(F.col(source)).alias("source"))
    kind = rows.schema["key"].dataType.simpleString()
    asked = cut(rows.mapInArrow(_query_batches, f"key {kind}, n int, source string, mark byte, frag string, family array<byte>, hash array<long>, whole long"))
    each = asked.where("mark = 1").select("key", F.explode(F.arrays_zip("family", "hash")).alias("x")).select("key", "x.family", "x.hash")
    asked_for = bitmap(each.select("hash"))
    counts = df.select(text).mapInArrow(_counted(asked_for), "hash long, ends long, goes_on long").groupBy("hash").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    seen = each.where(F.col("family") < FAMILIES).join(counts, "hash").groupBy("key").agg(*[c for f in range(FAMILIES) for c in _longer(f)])
    tails = asked.where("mark = 1").groupBy("frag").agg(F.count_distinct("whole").alias("n_tails"))
    judged = asked.where("mark = 1").select("key", "n", "source", "frag").join(tails, "frag", "left").join(seen, "key", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda f: F.when(n(f"e{f}") + n(f"g{f}") >= (1 if f < 2 else 3), n(f"g{f}") / (n(f"e{f}") + n(f"g{f}")))
    goes_on = F.coalesce(share(0), share(1), share(2), share(3), share(4), share(5))
    # different texts on both sides, as copies of one cut post are no other writers
    n_texts = rows.where("text is not null").select(F.xxhash64("text")).distinct().count()
    closer = (n("g0") == 0) & (n("g7") == 0) & ((F.col("n_tails") >= CLOSERS) & (n("g8") == 0) & (n("g9") == 0) | (F.col("n_tails") >= max(CLOSERS, CLOSERS_SHARE * n_texts)))
    # the letters of the last word go on elsewhere, and the word as such hardly follows here
    inside = (n("g7") + n("g8") > 0) & (n("g5") + n("e5") == 0) & (n("e0") + n("g0") == 0) | (n("g6") == 0) & (n("g7") + n("g8") + n("g9") > 0)
    reason = F.when(closer, "closer").when(inside, F.lit("word")).when(F.coalesce(goes_on, F.lit(1.0)) >= SHARE, F.lit("sentence"))
    judged = cut(judged.select("key", "n", "source", reason.alias("reason")).unionByName(asked.where("mark = 2").select("key", "n", "source", F.lit("mark").alias("reason"))))
    # open texts that have just the length at which their platform cuts
    sure = judged.where("reason in ('word', 'sentence', 'mark')")
    lengths = sure.groupBy("source", "n").agg(F.count("*").alias("k"))
    limits = lengths.join(sure.groupBy("source").agg(F.count("*").alias("of")), "source").where((F.col("k") >= CLOSERS) & (F.col("k") >= LIMIT_SHARE * F.col("of"))).select("source", "n", F.lit(True).alias("limit"))
    found = judged.join(limits, ["source", "n"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("limit"), F.lit("limit"))))
    return found.where("reason <> 'closer'").select(F.col("key").alias(key), "reason")


def platform(col: Column) -> Column:
    """The platform in lower case without blanks and `www.`; unknown if null or blank."""
    p = F.regexp_replace(F.lower(F.trim(col)), "^www\\.", "")
    return F.when(p.isNull() | (p == ""), F.lit("unknown")).otherwise(p)


def rates(df: DataFrame, key: str = "seq", text: str = "text", source: str = "sourcePlatform") -> DataFrame:
    """For each platform the number of posts with a text, of cut ones, their share, and the commonest length of a cut text."""
    found = cut_off(df, key, text, source).select(key, F.lit(1).alias("cut"))
    rows = df.select(key, platform(F.col(source)).alias("platform"), F.length(F.col(text)).alias("n")).where(F.trim(F.col(text)) != "").join(found, key, "left")
    lengths = rows.where("cut = 1").groupBy("platform", "n").agg(F.count("*").alias("k")).groupBy("platform").agg(F.max_by("n", F.struct("k", "n")).alias("usual_length"))
    out = rows.groupBy("platform").agg(F.count("*").alias("n_posts"), F.count("cut").alias("n_cut"))
    return out.withColumn("share", F.col("n_cut") / F.col("n_posts")).join(lengths, "platform", "left")
