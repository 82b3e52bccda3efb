"""Problem 3: variant spellings of names typed by people.

Method: MinHash banding over padded q-grams, verified by Monge-Elkan similarity, clustered by star clustering.

1. A name is brought to the consistent form and parsed: decorations, titles and word order go, given names
   take their full form, abbreviations of organisations too. The account's handle is cut to its core. Records that
   parse alike become one, with the number of its copies as weight.
2. Each word of two letters or more is a set of padded 3-grams; `BANDS` bands of `ROWS` minhashes tell which words may be
   alike. The collision curve 1-(1-s^ROWS)^BANDS was set for words of nine letters: one letter changed (s = 0.57) is
   met with probability 0.999, two swapped (s = 0.47) with 0.99. Two names meet if a word of one is like a
   word of the other and another word of each begins alike (two letters, or one where one of them is an initial), so
   that no word, however common, is no key, and no hot word brings all its names together. Words are banded under each
   beginning of the other word, and where names meet, their letters tell which pairs cannot pass (3). Handles and
   acronyms must be equal to count, so they meet by equality. Two records with different accounts are never compared.
3. A candidate is verified by the handle (a person keeps the core of theirs everywhere; two cores are two persons)
   and by the mean of Monge-Elkan similarities in both directions, over Jaro-Winkler with initials.
4. Star clustering: the record with most links that has an account becomes a centre and takes its neighbours, and so
   on until none is left; records without an account keep only their best links, so that they cannot bridge namesakes.

Everything runs as DataFrame joins; no links or clusters are collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.text_form import consistent
from quillstream.session import cut

Q, BANDS, ROWS = 3, 20, 2
SURE, WEAK, SLACK = 0.93, 0.8, 0.015
#: A word in the names of more different accounts, or a known given name, cannot tell a person by itself and an initial.
PERSONS = 10

# Short forms of given names, titles, and abbreviations of organisations.
SHORT = {
    "alexander": "alex lex sasha sandy xander alec", "agnieszka": "aga", "amara": "mara_", "andre": "dre andrew_ andrei", "benjamin": "ben benny benji", "bjorn": "",
    "christopher": "chris kit topher kris", "dmitri": "dima mitya dmitry dimitri", "ekaterina": "katya ekaterine katia katja", "eleanor": "nell ellie nora_ elinor eleanora", "elizabeth": "liz beth eliza lizzie betty elisabeth",
    "francisco": "paco frank pancho", "friedrich": "fritz fred friedrick", "giovanni": "gio gianni vanni", "gregory": "greg gregor", "hiro": "", "isabella": "bella izzy izabela isabela isa", "jennifer": "jen jenny jenn",
    "johannes": "hans johan hannes", "jose": "pepe joseph_", "karl": "carl", "katherine": "kathy kate katie kat catherine kathryn", "kofi": "", "lawrence": "larry laurie laurence", "leila": "layla leyla", "lena": "",
    "margaret": "maggie meg peggy greta margret", "michael": "mike mick mickey micheal", "nathaniel": "nate nat nathan", "olga": "olya", "patricia": "pat patty trish tricia", "robert": "rob bob bobby robbie", "samantha": "sam sammy",
    "susanna": "sue susie suzy susana suzanna", "theodora": "theo dora teodora thea", "thomas": "tom tommy tomas", "tomasz": "tomek", "victoria": "vicky vic tori viktoria", "william": "will bill billy willy liam", "winifred": "winnie freda fred_ win", "yusuf": "yousef joseph__ youssef",
    "zoe": "", "stephen": "steve stephan steven", "edward": "ed eddie ted", "richard": "rick dick rich", "james": "jim jimmy jamie", "charles": "charlie chuck", "anthony": "tony", "daniel": "dan danny", "matthew": "matt", "nicholas": "nick nicky",
    "joshua": "josh", "jonathan": "jon jonny", "rebecca": "becky becca", "deborah": "deb debbie", "barbara": "barb", "david": "dave", "peter": "pete", "philip": "phil", "ronald": "ron", "timothy": "tim", "vladimir": "vova volodya", "maria": "masha", "anastasia": "nastya", "sebastian": "seb bastian", "maximilian": "max", "wilhelm": "willi",
}
GIVEN = frozenset(SHORT) | {"ines", "nina", "milo", "tina", "dara", "soren", "emma", "anna", "paul", "john", "mark", "laura", "sara", "sarah", "julia", "martin"}
FULL = {s.strip("_"): full for full, shorts in SHORT.items() for s in [*shorts.split()] if not s.endswith("_")}
TITLES = frozenset("dr prof professor mr mrs ms miss mme herr frau sir coach captain rev doctor ing mag".split())
ABBREVIATED = {"inst": "institute", "intl": "international", "univ": "university", "corp": "corporation", "co": "company", "assoc": "association", "dept": "department", "labs": "laboratories", "lab": "laboratories", "bros": "brothers", "found": "foundation", "org": "organisation", "soc": "society", "ltd": "limited", "assn": "association", "fdn": "foundation", "ctr": "centre"}
_ORG = frozenset(ABBREVIATED.values()) | frozenset("records public research trading printing marine grain housing harbour timber radio rail daily feed news agency group works trust council guild".split())
_WORD = re.compile(r"[^\W_]+")


def ascii_of(text: str) -> str:
    """Lower case without accents."""
    flat = unicodedata.normalize("NFD", text.lower().replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("æ", "ae").replace("đ", "d"))
    return "".join(c for c in flat if not unicodedata.combining(c))


def handle_core(url: str | None) -> str:
    """The handle of an account without decorations (`the`, digits at the end, dots, dashes and underscores)."""
    if not url or not url.strip():
        return ""
    path = re.sub(r"[?#].*$", "", url.strip()).rstrip("/")
    if "/" not in path.replace("://", ""):
        return ""
    return _core(path.rsplit("/", 1)[1])


def _core(handle: str) -> str:
    h = re.sub(r"[._\-]", "", ascii_of(handle.lstrip("@")))
    h = re.sub(r"\d+$", "", h)
    return h[3:] if h.startswith("the") and len(h) > 9 else h


def parse(name: str | None) -> tuple[list[str], str]:
    """The name's words in full forms (without titles), and the core of a name that is a handle itself."""
    if not name or not name.strip():
        return [], ""
    n = re.sub(r"[(\[].*?[)\]]", " ", consistent(name))
    n = re.split(r"\s[–—|·•~/-]\s", n)[0].strip()
    if n.startswith("@") or re.fullmatch(r"[a-z]+[._][a-z._]+\d*|[a-z]+[._]?[a-z]+\d+", n):
        parts = [p for p in re.split(r"[._\d@]+", ascii_of(n)) if p]
        return ([FULL.get(p, p) for p in parts] if len(parts) > 1 else []), _core(n)
    words = [w for w in _WORD.findall(ascii_of(n).replace("'", "").replace("’", ""))]
    words = [ABBREVIATED.get(w, w) for w in words if w not in TITLES and w not in ("the", "of", "and", "for", "de", "la") and not w.isdigit()]
    return [FULL.get(w, w) for w in words], ""


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(la, lb) // 2 - 1
    hit_a, hit_b = [False] * la, [False] * lb
    m = 0
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not hit_b[j] and b[j] == c:
                hit_a[i] = hit_b[j] = True
                m += 1
                break
    if not m:
        return 0.0
    x = [c for c, h in zip(a, hit_a) if h]
    y = [c for c, h in zip(b, hit_b) if h]
    t = sum(p != q for p, q in zip(x, y)) / 2
    jaro = (m / la + m / lb + (m - t) / m) / 3
    prefix = 0
    for p, q in zip(a[:4], b[:4]):
        if p != q:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(maxsize=500_000)
def _inner(a: str, b: str) -> float:
    if len(a) == 1 or len(b) == 1:
        return 0.9 if a[0] == b[0] and len(a) != len(b) else float(a == b)
    return jaro_winkler(a, b)


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean of the best inner similarities, in both directions; the fuller name may hold one more initial."""
    if not a or not b:
        return 0.0

    def one(x: list[str], y: list[str]) -> float:
        long = [w for w in x if len(w) > 1 or len(x) <= 2]
        return sum(max(_inner(w, v) for v in y) for w in long) / max(1, len(long))

    return (one(a, b) + one(b, a)) / 2


def _full(words: list[str]) -> bool:
    return sum(len(w) > 1 for w in words) >= 2


def _clash(a: list[str], b: list[str]) -> bool:
    """Two full personal names of which a word has no likeness in the other name."""
    if not _full(a) or not _full(b) or set(a) & _ORG or set(b) & _ORG:
        return False
    return any(len(w) > 1 and max((_inner(w, v) for v in y), default=0) < 0.7 for x, y in ((a, b), (b, a)) for w in x)


def verify(core_a: str, core_b: str, words_a: list[str], words_b: list[str], own_a: str, own_b: str, held: frozenset[str] | set[str] = frozenset()) -> tuple[float, bool]:
    """(similarity, weak) of two records; 0 for different ones. Weak: known by an initial or an acronym only, and then a
    word that many accounts hold (`held`) or a given name is not enough."""
    if core_a and core_b:
        return (0.0, False) if core_a != core_b or _clash(words_a, words_b) else (1.0, False)
    for own, core, words in ((own_a, core_b, words_b), (own_b, core_a, words_a)):
        if own and not core_a + core_b == "" and own == core:
            return 1.0, False
        if own and words and own in ("".join(words), "".join(reversed(words))):
            return 0.99, False
    if own_a and own_a == own_b:
        return 1.0, False
    for x, y in ((words_a, words_b), (words_b, words_a)):
        if len(x) == 1 and len(y) >= 3 and 2 <= len(x[0]) <= 5 and x[0] == "".join(w[0] for w in y):
            return WEAK, True
    m = monge_elkan(words_a, words_b)
    if m < WEAK or _clash(words_a, words_b):
        return 0.0, False
    told = lambda words: [w for w in words if len(w) > 1 and w not in held and w not in GIVEN]
    if (set(words_a) | set(words_b)) & _ORG:
        # organisations share their generic words; what names them must be alike
        x, y = sorted(([w for w in told(words) if w not in _ORG] for words in (words_a, words_b)), key=len)
        if any(max((_inner(w, v) for v in y), default=0.0) < 0.9 for w in x):
            return 0.0, False
    if not _full(words_a) or not _full(words_b):
        family = max((_inner(w, v) for w in told(words_a) for v in told(words_b)), default=0.0)
        return (m, True) if family >= 0.95 and min(len(words_a), len(words_b)) >= 2 else (0.0, False)
    shared = min(len(words_a), len(words_b))
    if shared < max(len([w for w in words_a if len(w) > 1]), len([w for w in words_b if len(w) > 1])) and not (set(words_a) | set(words_b)) & _ORG:
        return 0.0, False
    return (m, False) if m >= SURE else (0.0, False)


_SEEDS = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, np.uint64) | np.uint64(1)


def bands_of(word: str) -> list[int]:
    """Band keys of the padded q-grams of a word."""
    padded = f"{'_' * (Q - 1)}{word}{'_' * (Q - 1)}"
    g = np.array([xxhash.xxh64_intdigest(padded[k : k + Q]) for k in range(len(padded) - Q + 1)], np.uint64)
    with np.errstate(over="ignore"):
        h = ((g[:, None] * _SEEDS[None, :]) >> np.uint64(20)).min(axis=0).reshape(BANDS, ROWS)
        keys = (h[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return keys.view(np.int64).tolist()


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parsed = [parse(n) for n in b.column(1).to_pylist()]
        cores = [handle_core(u) for u in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cores), pa.array([w for w, _ in parsed], pa.list_(pa.string())), pa.array([o for _, o in parsed])], names=["ref", "core", "words", "own"])


def _letters(word: str) -> int:
    """Bits of the letters that stand in a word, and of those that stand there twice."""
    once = twice = 0
    for c in word:
        bit = 1 << ord(c) % 31
        twice |= once & bit
        once |= bit
    return once | twice << 31


def _start(word: str) -> int:
    """The first four letters in 32 bits; letters that are equal have equal bits."""
    return int.from_bytes(bytes(ord(c) % 256 for c in word[:4]).ljust(4, b"\0"), "big")


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, asks, gives) to rows (word, letters, key, code, asks): one for each band of the word and each key."""
    for b in batches:
        at, key, code, side = [], [], [], []
        for i, (w, *both) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
            bands = np.array(bands_of(w), np.int64).view(np.uint64)
            for asks, keys in zip((True, False), both):
                if keys:
                    marks = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
                    code.append((bands[None, :] ^ marks[:, None]).ravel())
                    at += [i] * code[-1].size
                    key += [k for k in keys for _ in bands]
                    side += [asks] * code[-1].size
        i = pa.array(at, pa.int64())
        codes = np.concatenate(code).view(np.int64) if code else np.empty(0, np.int64)
        letters = pa.array([_letters(w) for w in b.column(0).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(i), letters.take(i), pa.array(key, pa.string()), pa.array(codes), pa.array(side, pa.bool_())], names=["word", "letters", "key", "code", "asks"])


def _verify_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(x.a, x.b, *verify(x.core_a, x.core_b, list(x.words_a), list(x.words_b), x.own_a, x.own_b, {*x.held_a, *x.held_b}), bool(x.core_a), bool(x.core_b), x.core_a or x.core_b) for x in b.itertuples(index=False)]
        out = pd.DataFrame(rows, columns=["a", "b", "score", "weak", "has_a", "has_b", "core"])
        yield out[out["score"] > 0]


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref, core, words, held) to keys (ref, has, word, ask, give, sort, and of this and the other word the letters, start
    and length): a name that asks meets the names that give the same. Of sort 1 are names of two full words, none of an
    organisation; of sort 2 those of organisations with one word of their own, which then stands for the other word.

    A name whose only full word is a given name can't be told by words (`verify`), so it has no keys.
    """
    for b in batches:
        at, word, ask, give, sort, marks = [], [], [], [], [], []
        for k, (words, held) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            if not _full(words) and all(w in GIVEN for w in words if len(w) > 1):
                continue
            own = [w for w in words if len(w) > 1 and w not in held and w not in GIVEN and w not in _ORG]
            of = 2 if set(words) & _ORG and len(own) == 1 else int(len(words) == 2 and _full(words) and not set(words) & _ORG)
            mark = {w: (_letters(w), _start(w), len(w)) for w in words}
            for w, u in dict.fromkeys((w, u) for i, w in enumerate(words) if len(w) > 1 for j, u in enumerate(words) if i != j):
                # full words by two letters; an initial by its letter, with full words and with initials
                for x, y in ((f"f{u[:2]}", f"f{u[:2]}"), (f"j{u[0]}", f"i{u[0]}")) if len(u) > 1 else ((f"i{u}", f"j{u}"), (None, f"i{u}")):
                    at.append(k)
                    word.append(w)
                    ask.append(x)
                    give.append(y)
                    sort.append(of)
                    marks.append(mark[w] + mark[own[0] if of == 2 else u])
        i = pa.array(at, pa.int64())
        has = pa.array([c != "" for c in b.column(1).to_pylist()], pa.bool_())
        sides = np.array(marks, np.int64).reshape(-1, 6)
        yield pa.RecordBatch.from_arrays([b.column(0).take(i), has.take(i), *(pa.array(c, pa.string()) for c in (word, ask, give)), pa.array(sort, pa.int8()), *(pa.array(c) for c in sides.T)], names=["ref", "has", "word", "ask", "give", "sort", *_MARKS])


_MARKS = [f"{what}_{of}" for of in ("word", "other") for what in ("letters", "start", "size")]


def _common(x: str, y: str, size_x, size_y):
    """At least the number of letters that two words have in common, from their `letters`."""
    count = lambda c: F.bit_count(F.col(c))
    return F.bit_count(F.col(x).bitwiseAND(F.col(y))) + F.least(size_x - count(x), size_y - count(y))


def _may_be(x: str, y: str, least: dict):
    """Words may have a Jaro-Winkler similarity of so much or more (by sort), from their letters, starts and lengths."""
    size_x, size_y = F.col(f"size_{x}"), F.col(f"size_{y}")
    apart = F.col(f"start_{x}").bitwiseXOR(F.col(f"start_{y}"))

    def jaro(sure: float):
        """What three times the Jaro similarity less 1 must be, by the letters that both begin with."""
        need = [3 * (sure - 0.1 * n) / (1 - 0.1 * n) - 1 - 1e-6 for n in range(5)]
        return F.when(apart >= 1 << 24, need[0]).when(apart >= 1 << 16, need[1]).when(apart >= 1 << 8, need[2]).when(apart > 0, need[3]).otherwise(need[4])

    (_, one), *more = least.items()
    need = jaro(one)
    for sort, other in more:
        need = F.when(F.col("sort") == sort, jaro(other)).otherwise(need)
    return _common(f"letters_{x}", f"letters_{y}", size_x, size_y) * (size_x + size_y) >= need * size_x * size_y


def _may_link():
    """No pair (columns of the second end in 2) that `verify` lets pass by words is lost.

    Two full names need a mean of `SURE` over their words' best similarities. As one of two words is 1 at best, the other's
    is `2 * SURE - 1` in one of the names, with the other's other word or crosswise. Organisations are alike in their own
    words. The conditions are kept short: a join with long ones is not compiled.
    """
    other = 2 * SURE - 1
    cross = _may_be("other", "word2", {1: other}) | _may_be("word", "other2", {1: other})
    return (F.col("sort") != F.col("sort2")) | (F.col("sort") == 0) | _may_be("other", "other2", {1: other, 2: 0.9}) | (F.col("sort") == 1) & cross


def candidates(people: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of records (ref, core, words, own, and held if there is) that may be linked."""
    held = F.col("held") if "held" in people.columns else F.array().cast("array<string>").alias("held")
    kind = people.schema["ref"].dataType.simpleString()
    marks = ", ".join(f"{c} long" for c in _MARKS)
    keys = cut(people.select("ref", "core", "words", held).mapInArrow(_key_batches, f"ref {kind}, has boolean, word string, ask string, give string, sort byte, {marks}"))
    # every different word is banded once, and under each of its keys; like words meet, then their records, of which one has no account
    each = keys.groupBy("word").agg(F.collect_set(F.when(~F.col("has"), F.col("ask"))).alias("asks"), F.collect_set("give").alias("gives"))
    banded = cut(each.mapInArrow(_band_batches, "word string, letters long, key string, code long, asks boolean"))
    side = lambda s, which: banded.where(which).select(F.col("word").alias(s), F.col("letters").alias(f"letters_{s}"), F.length("word").alias(f"size_{s}"), "key", "code")
    # words within the distance asked for below have so many letters in common
    fits = _common("letters_w", "letters_v", F.col("size_w"), F.col("size_v")) >= 0.6 * F.greatest("size_w", "size_v") - 1e-6
    alike = side("w", "asks").join(side("v", "not asks").drop("key").hint("merge"), "code").where(fits).where("w <> v").select("w", "v", "key").distinct()
    alike = cut(alike.where((1 - F.levenshtein("w", "v") / F.greatest(F.length("w"), F.length("v"))) >= 0.6))
    asking = keys.where("not has and ask is not null").select(F.col("ref").alias("a"), F.col("word").alias("w"), F.col("ask").alias("key"), "sort", *_MARKS)
    giving = keys.select(F.col("ref").alias("b"), F.col("word").alias("v"), F.col("give").alias("key"), F.col("sort").alias("sort2"), *[F.col(c).alias(f"{c}2") for c in _MARKS])
    by_equal = asking.join(giving.withColumnRenamed("v", "w").hint("merge"), ["w", "key"]).where(_may_link()).select("a", "b")
    by_alike = asking.join(alike.hint("merge"), ["w", "key"]).join(giving.hint("merge"), ["v", "key"]).where(_may_link()).select("a", "b")
    by_words = by_equal.unionByName(by_alike)
    # handles: a name that is one meets accounts, other such names, and names whose words joined are the same
    joined = people.where(F.size("words") > 0).select("ref", "core", F.explode(F.array_distinct(F.array(F.array_join("words", ""), F.array_join(F.reverse("words"), "")))).alias("k"))
    own = people.where("own <> ''").select(F.col("ref").alias("a"), F.col("core").alias("core_a"), F.col("own").alias("k"))
    others = joined.unionByName(people.where("core <> ''").select("ref", "core", F.col("core").alias("k"))).unionByName(people.where("own <> ''").select("ref", "core", F.col("own").alias("k")))
    by_handle = own.join(others.withColumnRenamed("ref", "b").hint("merge"), "k").where("core_a = '' or core = '' or core_a = core").select("a", "b")
    accounts = people.where("core <> ''").select("ref", "core")
    by_account = accounts.toDF("a", "core").join(accounts.toDF("b", "core").hint("merge"), "core").select("a", "b")
    short = people.where((F.size("words") == 1) & F.length(F.get("words", F.lit(0))).between(2, 5)).select(F.col("ref").alias("a"), F.col("core").alias("core_a"), F.get("words", F.lit(0)).alias("k"))
    long = people.where(F.size("words") >= 3).select(F.col("ref").alias("b"), F.col("core").alias("core_b"), F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "").alias("k"))
    by_acronym = short.join(long.hint("merge"), "k").where("core_a = '' or core_b = ''").select("a", "b")
    pairs = by_words.unionByName(by_handle).unionByName(by_account).unionByName(by_acronym).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(people: DataFrame) -> DataFrame:
    """Verified links (a, b, score), a < b, between records (ref, core, words, own)."""
    kind = people.schema["ref"].dataType.simpleString()
    each = people.select("ref", "core", F.explode(F.array_distinct("words")).alias("word"))
    wide = each.where("core <> ''").groupBy("word").agg(F.count_distinct("core").alias("n")).where(F.col("n") > PERSONS).select("word")
    held = each.join(wide.hint("merge"), "word", "left_semi").groupBy("ref").agg(F.collect_list("word").alias("held"))
    people = cut(people.join(held.hint("merge"), "ref", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>"))))
    side = lambda s: people.select(F.col("ref").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("core", "words", "own", "held")]).hint("merge")
    both = candidates(people).join(side("a"), "a").join(side("b"), "b")
    found = cut(both.mapInPandas(_verify_batches, f"a {kind}, b {kind}, score double, weak boolean, has_a boolean, has_b boolean, core string"))
    # records without an account keep their best links; weak ones only if they lead to one person
    ends = found.select(F.col("a").alias("ref"), F.col("has_a").alias("has"), "score", "weak", "core").unionByName(found.select(F.col("b").alias("ref"), F.col("has_b").alias("has"), "score", "weak", "core"))
    best = ends.where("not has").groupBy("ref").agg(F.max("score").alias("best"), F.count_distinct(F.when(F.col("weak") & (F.col("core") != ""), F.col("core"))).alias("persons"), F.max(F.when(~F.col("weak"), F.col("score"))).alias("strong"))
    kept = found
    for s in ("a", "b"):
        kept = kept.join(best.select(F.col("ref").alias(s), F.col("best").alias("best"), F.col("persons").alias("persons"), F.col("strong").alias("strong")).hint("merge"), s, "left")
        kept = kept.where(F.col("best").isNull() | (F.when(F.col("weak"), F.col("strong").isNull() & (F.col("persons") <= 1)).otherwise(F.col("score") >= F.col("best") - SLACK)) | F.col("weak") & F.col(f"has_{'b' if s == 'a' else 'a'}") & (F.col("persons") <= 1) & F.col("strong").isNull())
        kept = kept.drop("best", "persons", "strong")
    return kept.select("a", "b", "score", "has_a", "has_b")


def stars(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Star clustering: rows (ref, centre) of all nodes. Nodes: (ref, has, copies); links: (a, b).

    A node's rank is whether it has an account, the copies of its neighbours and its own, and the lower ref. Nodes that rank
    above all open neighbours become centres, their open neighbours join the best of them, until no node is open.
    """
    edges = cut(found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = edges.join(nodes.select(F.col("ref").alias("b"), "copies").hint("merge"), "b").groupBy("a").agg(F.sum("copies").alias("deg"))
    ranked = cut(nodes.join(degree.withColumnRenamed("a", "ref").hint("merge"), "ref", "left").select("ref", "deg", F.struct(F.col("has").cast("int").alias("has"), (F.coalesce("deg", F.lit(0)) + F.col("copies") - 1).alias("deg"), (-F.col("ref")).alias("neg")).alias("rank")))
    done = ranked.where("deg is null").select("ref", F.col("ref").alias("centre"))
    open_ = ranked.where("deg is not null").select("ref", "rank")
    while not open_.isEmpty():
        around = edges.join(open_.select(F.col("ref").alias("a")).hint("merge"), "a").join(open_.toDF("b", "rank_b").hint("merge"), "b")
        higher = around.groupBy("a").agg(F.max("rank_b").alias("top"))
        centres = cut(open_.join(higher.withColumnRenamed("a", "ref").hint("merge"), "ref", "left").where(F.col("top").isNull() | (F.col("top") < F.col("rank"))).select("ref", "rank"))
        taken = edges.join(centres.toDF("b", "rank_b").hint("merge"), "b").join(open_.select(F.col("ref").alias("a")).hint("merge"), "a").groupBy("a").agg(F.max_by("b", "rank_b").alias("centre"))
        now = cut(centres.select("ref", F.col("ref").alias("centre")).unionByName(taken.toDF("ref", "centre")))
        done = done.unionByName(now)
        open_ = cut(open_.join(now.select("ref").hint("merge"), "ref", "left_anti"))
    return done


def people_of(df: DataFrame, key: str = "authorRef", name: str = "authorName", url: str = "authorUrl") -> DataFrame:
    """Parsed records (ref, core, words, own); null keys are left out, other columns are dropped."""
    few = df.where(F.col(key).isNotNull()).select(key, name, url)
    return few.mapInArrow(_parse_batches, f"ref {few.schema[key].dataType.simpleString()}, core string, words array<string>, own string")


def entities(df: DataFrame, key: str = "authorRef", name: str = "authorName", url: str = "authorUrl") -> DataFrame:
    """Rows (key, entity): the person or organisation of every record.

    Null and blank names without an account stand alone, equal names without an account are one entity, decorated and
    null URLs are handled, extra columns are dropped first, and an empty table gives an empty result.
    """
    rows = cut(people_of(df, key, name, url))
    # records that parse alike are one, where that makes them the same person
    known = (F.col("core") != "") | (F.col("own") != "") | (F.size(F.filter("words", lambda w: F.length(w) > 1)) >= 2)
    rows = rows.withColumn("alone", F.when(~known, F.col("ref")))
    people = cut(rows.groupBy("core", "words", "own", "alone").agg(F.min("ref").alias("rep"), F.count("*").alias("copies")))
    which = rows.join(people.select("core", "words", "own", "alone", "rep").hint("merge"), (rows["core"] == people["core"]) & (rows["words"] == people["words"]) & (rows["own"] == people["own"]) & rows["alone"].eqNullSafe(people["alone"])).select("ref", "rep")
    found = links(people.select(F.col("rep").alias("ref"), "core", "words", "own"))
    out = stars(people.select(F.col("rep").alias("ref"), (F.col("core") != "").alias("has"), "copies"), found)
    return which.join(out.select(F.col("ref").alias("rep"), "centre").hint("merge"), "rep").select(F.col("ref").alias(key), F.col("centre").alias("entity"))


def same(df: DataFrame, key: str = "authorRef", name: str = "authorName", url: str = "authorUrl") -> DataFrame:
    """All pairs (ref_a, ref_b), ref_a < ref_b, of one entity."""
    who = cut(entities(df, key, name, url))
    return who.toDF("ref_a", "entity").join(who.toDF("ref_b", "entity").hint("merge"), "entity").where("ref_a < ref_b").select("ref_a", "ref_b")
