"""Problem 5: near-duplicate records with small edits.

Similarity is the Jaccard index of the sets of runs of three words, of the consistent form in lower case.

1. The texts are read once. Each gives its class (a 128-bit hash of its words), the hashes of its runs and its pivot
   table; equal texts become one class, known by its least key, before anything is compared.
2. Pivot tables can only discard pairs, so minhash bands propose them: with `BANDS` bands of `ROWS` minhashes a pair of
   similarity 0.5 is met with probability 0.9993, of 0.55 with 0.99998. Bands come in rounds, and the shuffle of a round
   is freed before the next, so that disk holds a few bands at a time. Within a round a task sorts one band, or
   one slice of its hashes, as packed arrays.
3. Pivot distance tables. The fingerprint of a text is the set of its run hashes as bits, so the Hamming distance of two is
   the number of runs that only one has, at most a third of both sizes for copies. The reference fingerprints are all
   unions of `BLOCKS` blocks of the hash space: 2^`BLOCKS` of them. A text's distance to each follows from how many of
   its runs lie in each block, so these counts are its whole table, and the maximum coordinate difference of two
   tables is the sum of the differences of their counts. By the triangle inequality no copy is discarded. Counts
   are kept up to `LEVELS`, in unary, which can only lower the difference.
4. Survivors are verified on all their runs. Runs are compared by 32 bits of their hashes.

Texts are never shuffled, only hashes are. Equal texts are combined before the shuffle; a band value that more than
`GROUP` classes share is no task's group but meets itself in a join that splits skewed partitions, with the pivot
tables as its condition. No table that grows is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.bitmap import bitmap, has
from quillstream.llm.text_form import consistent
from quillstream.session import cut, kept

RUN, THRESHOLD = 3, 0.5
BANDS, ROWS, BANDS_A_ROUND = 112, 4, 28
BLOCKS, LEVELS = 128, 3
_LONGS = BLOCKS * LEVELS // 64
#: Bytes of postings that one task sorts at a time, and the greatest band group whose pairs it gives itself.
SLICE_BYTES, GROUP = 32 << 20, 16
#: Texts whose runs are held at once.
TEXTS = 2000


class _Spaced(dict):
    """Characters other than letters and digits to blanks, filled as they come up."""

    def __missing__(self, c: int) -> int:
        self[c] = v = c if chr(c).isalnum() else 32
        return v


_SPACED = _Spaced()


def plain(text: str | None) -> str:
    """The text's words in the consistent form and lower case, joined by spaces; a text without words is kept
    behind a zero character; null and blank texts give an empty string."""
    if not text:
        return ""
    low = (text if text.isascii() else consistent(text)).lower()
    words = low.translate(_SPACED).split()
    return " ".join(words) if words else "\0" + low.strip() if low.strip() else ""


def _word_hash(w: str) -> int:
    return hash_cache.setdefault(w, xxhash.xxh64_intdigest(w))


hash_cache: dict[str, int] = {}
#: Words whose hashes a worker keeps; only speed depends on it.
KEPT_WORDS = 1_000_000


def runs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Different 32-bit hashes of the runs of three words of each text, in order, and their number for each text."""
    if len(hash_cache) > KEPT_WORDS:
        hash_cache.clear()
    get = hash_cache.get
    flat: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        words = t.split(" ") if t[:1] != "\0" else []
        if len(words) >= RUN:
            lengths[k] = len(words)
            flat += [get(w) or _word_hash(w) for w in words]
    h = np.array(flat, np.uint64)
    if len(h) < RUN:
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        r = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) ^ (h[2:] * np.uint64(0x165667B19E3779F9) + np.uint64(2))
        r ^= r >> np.uint64(31)
        r *= np.uint64(0xBF58476D1CE4E5B9)
    ends = np.cumsum(lengths)
    keep = np.ones(len(h), bool)
    last = ends[lengths > 0]
    keep[last - 1] = False
    keep[last - 2] = False
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.maximum(lengths - 2, 0))
    each = np.unique(owner << np.uint64(32) | r[keep[:-2]] >> np.uint64(32))
    return each.astype(np.uint32), np.bincount((each >> np.uint64(32)).astype(np.int64), minlength=len(texts))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240501).integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


#: Minhashes that share one mix of the runs' hashes.
MIXED = 16


def minhashes(r: np.ndarray, counts: np.ndarray, first: int, last: int) -> np.ndarray:
    """Minhashes `first` to `last` (texts x hashes) of texts that all have runs."""
    out = np.empty((len(counts), last - first), np.uint32)
    starts = np.cumsum(counts) - counts
    by_size = np.argsort(counts, kind="stable")
    a = _multipliers()
    with np.errstate(over="ignore"):
        for lo in range(0, len(counts), 512):
            at = by_size[lo : lo + 512]
            x = r[starts[at] + np.minimum(np.arange(counts[at].max())[:, None], counts[at] - 1)]
            for k in range(first, last):
                if k == first or k % MIXED == 0:
                    m = (x ^ np.uint32((k // MIXED + 1) * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                    m ^= m >> np.uint32(13)
                    m *= np.uint32(0xC2B2AE35)
                    m ^= m >> np.uint32(16)
                out[at, k - first] = (m * a[k]).min(axis=0)
    return out


def band_keys(r: np.ndarray, counts: np.ndarray, first: int, last: int) -> np.ndarray:
    """32-bit hashes of the bands `first` to `last` (texts x bands)."""
    m = minhashes(r, counts, first * ROWS, last * ROWS).astype(np.uint64).reshape(len(counts), last - first, ROWS)
    mul = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
    with np.errstate(over="ignore"):
        return ((m * mul).sum(axis=2) >> np.uint64(32)).astype(np.uint32)


def pivot_tables(r: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs in each block, up to `LEVELS`, in unary (texts x longs)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    n = np.bincount(owner * BLOCKS + (r >> np.uint32(25)), minlength=len(counts) * BLOCKS).reshape(len(counts), BLOCKS)
    return np.packbits(np.concatenate([n > k for k in range(LEVELS)], axis=1), axis=1).view(">u8").astype(np.uint64).view(np.int64)


def _class_hash(words: list[str]) -> tuple[pa.Array, pa.Array]:
    h = np.frombuffer(b"".join(xxhash.xxh128_digest(w) for w in words), ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
    return pa.array(h[:, 0]), pa.array(h[:, 1])


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, h1, h2, runs, pivots) of every text; runs and pivots once for equal texts of a batch."""
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS):
            b = batch.slice(lo, TEXTS)
            words = [plain(t) for t in b.column(1).to_pylist()]
            at = [k for k, w in enumerate(words) if w]
            words = [words[k] for k in at]
            first = {w: k for k, w in reversed(list(enumerate(words)))}
            fresh = np.array([first[w] == k for k, w in enumerate(words)], bool)
            r, counts = runs_of([w if f else "" for w, f in zip(words, fresh)])
            runs, pivots = _lists(r.view(np.int32), counts), _lists(pivot_tables(r, counts).reshape(-1), np.full(len(at), _LONGS))
            taken = pa.array(np.where(fresh, np.arange(len(at)), -1), mask=~fresh)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *_class_hash(words), runs.take(taken), pivots.take(taken)], names=["key", "h1", "h2", "runs", "pivots"])


def _banded(first: int, last: int, slices: int):
    """Batches of classes (id, runs) to packed postings (part, base, data) of the bands `first` to `last`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            base = int(ids.min())
            near = (ids - base).astype(np.uint32)  # ids of one partition lie within 2^33, those of a batch side by side
            runs = b.column(1)
            counts = np.diff(runs.offsets.to_numpy())
            keys = band_keys(runs.flatten().to_numpy().view(np.uint32), counts, first, last)
            part, data = [], []
            for k in range(last - first):
                h = keys[:, k]
                if slices == 1:
                    cuts, order = [0, len(h)], slice(None)
                else:
                    s = (h.astype(np.uint64) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
                    order = np.argsort(s, kind="stable")
                    cuts = np.searchsorted(s[order], np.arange(slices + 1))
                hs, ns = h[order], near[order]
                for j in range(slices):
                    if cuts[j] < cuts[j + 1]:
                        part.append(k * slices + j)
                        data.append(hs[cuts[j] : cuts[j + 1]].tobytes() + ns[cuts[j] : cuts[j + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([base] * len(part), pa.int64()), pa.array(data, pa.binary())], names=["part", "base", "data"])

    return run


def _meet(postings: pa.Table) -> pa.Table:
    """The packed postings of a band, or a slice of it, to pairs (a, b, null), and the members of groups beyond
    `GROUP` as rows (a, null, group)."""
    hashes, ids = [], []
    for base, data in zip(postings.column("base").to_pylist(), postings.column("data").to_pylist()):
        x = np.frombuffer(data, np.uint32).reshape(2, -1)
        hashes.append(x[0])
        ids.append(x[1].astype(np.int64) + base)
    h, i = np.concatenate(hashes), np.concatenate(ids)
    order = np.argsort(h, kind="stable")
    h, i = h[order], i[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[start, len(h)])
    of = np.repeat(size, size)
    some = (of > 1) & (of <= GROUP)
    h2, i2 = h[some], i[some]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for gap in range(1, GROUP):
        at = np.flatnonzero(h2[gap:] == h2[:-gap])
        a.append(np.minimum(i2[at], i2[at + gap]))
        b.append(np.maximum(i2[at], i2[at + gap]))
    hot = of > GROUP
    a, b = np.concatenate(a), np.concatenate(b)
    n, m = len(a), int(hot.sum())
    group = (postings.column("part")[0].as_py() << 32) | h[hot].astype(np.int64)
    none = np.arange(n + m) >= n
    return pa.table({"a": np.r_[a, i[hot]], "b": pa.array(np.r_[b, np.zeros(m, np.int64)], mask=none), "group": pa.array(np.r_[np.zeros(n, np.int64), group], mask=~none)})


def _near() -> Column:
    """The maximum coordinate difference of the tables `x` and `y` is at most what the sizes of two copies allow."""
    apart = sum((F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(_LONGS)), F.lit(0))
    return apart * (1 + THRESHOLD) <= (F.col("x.n") + F.col("y.n")) * (1 - THRESHOLD) + 1e-6


def _met(classes: DataFrame, first: int, last: int, slices: int) -> DataFrame:
    """Rows (a, b, group) of one round of bands; see `_meet`."""
    packed = classes.select("id", "runs").mapInArrow(_banded(first, last, slices), "part int, base long, data binary")
    return packed.groupBy("part").applyInArrow(_meet, "a long, b long, group long")


def candidates(classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ids of classes that share a band and that the pivot tables let pass."""
    tables = classes.select("id", F.size("runs").alias("n"), *[F.col("pivots")[k].alias(f"p{k}") for k in range(_LONGS)])
    slices = -(-classes.count() * 8 // SLICE_BYTES) or 1
    out = None
    for first in range(0, BANDS, BANDS_A_ROUND):
        met = cut(_met(classes, first, min(first + BANDS_A_ROUND, BANDS), slices))
        pairs = met.where("group is null").select("a", "b").repartition("a").distinct()
        pairs = pairs.join(tables.alias("x").hint("merge"), F.col("a") == F.col("x.id")).join(tables.alias("y").hint("merge"), F.col("b") == F.col("y.id")).where(_near()).select("a", "b")
        hot = met.where("group is not null").select("a", "group").join(tables.hint("merge"), F.col("a") == F.col("id"))
        meeting = hot.alias("x").join(hot.alias("y").hint("merge"), (F.col("x.group") == F.col("y.group")) & (F.col("x.id") < F.col("y.id")) & _near()).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        near = cut(pairs.unionByName(meeting))
        out = near if out is None else out.unionByName(near)
    return out.distinct()


def _similar(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose `column` (long) may be among `ids`; a join must follow."""
    wanted = bitmap(ids.select(F.xxhash64("id").alias("hash")))

    def those(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(has(wanted, b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)))).select(range(b.num_columns - 1))

    return rows.withColumn("_hash", F.xxhash64(column)).mapInArrow(those, rows.schema)


def _links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b, similarity) of ids of classes, a < b, whose similarity reaches the threshold."""
    near = cut(candidates(classes))
    words = cut(_among(classes.select("id", "runs"), "id", near.select(F.explode(F.array("a", "b")).alias("id"))))
    both = near.join(words.toDF("a", "runs_a").hint("merge"), "a").join(words.toDF("b", "runs_b").hint("merge"), "b")
    return both.select("a", "b", _similar(F.col("runs_a"), F.col("runs_b")).alias("similarity")).where(F.col("similarity") >= THRESHOLD)


@contextmanager
def _classes(df: DataFrame, key: str, text: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(rows, classes): (key, h1, h2) of every text, and (id, class, h1, h2, n_rows, runs, pivots) of every different one."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    with kept(rows.mapInArrow(_read, f"key {kind}, h1 long, h2 long, runs array<int>, pivots array<long>")) as read:
        each = read.groupBy("h1", "h2").agg(F.min("key").alias("class"), F.count("*").alias("n_rows"), F.first("runs", True).alias("runs"), F.first("pivots", True).alias("pivots"))
        yield read.select("key", "h1", "h2"), cut(each.withColumn("id", F.monotonically_increasing_id()))


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, id, class) of the rows of these classes."""
    few = classes.select("h1", "h2", "id", "class")
    return _among(rows, "h1", few.select(F.col("h1").alias("id"))).join(few.hint("merge"), ["h1", "h2"]).select("key", "id", "class")


def _searched(classes: DataFrame) -> DataFrame:
    return classes.where("size(runs) > 0")


def copies(df: DataFrame, key: str = "seq", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of every row with a text, and the links between different texts.

    Members are rows (key, class), links are rows (a, b, similarity) between classes; the class of a row is the
    least key of the rows with equal words. Null, empty and blank texts belong to no class; texts of fewer than
    three words link to equal ones only; texts are taken whole. Columns other than the two named are dropped
    first. Empty tables give empty results.
    """
    with _classes(df, key, text) as (rows, classes):
        members = cut(rows.join(classes.select("h1", "h2", "class").hint("merge"), ["h1", "h2"]).select(F.col("key").alias(key), "class"))
        found = cut(_links(_searched(classes)))
        name = lambda c: classes.select(F.col("id").alias(c), F.col("class").alias(f"_{c}")).hint("merge")
        named = found.join(name("a"), "a").join(name("b"), "b")
        return members, named.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "similarity")


def pairs(df: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """All pairs of rows (key_a, key_b), key_a < key_b, whose texts reach the threshold; equal texts count."""
    with _classes(df, key, text) as (rows, classes):
        found = cut(_links(_searched(classes)).select("a", "b"))
        # only classes with several rows or a link have pairs
        linked = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        some = classes.where("n_rows > 1").unionByName(classes.where("n_rows = 1").join(linked.hint("merge"), "id", "left_semi"))
        members = cut(_members(rows, some))
    a, b = members.select(F.col("key").alias("ka"), F.col("id").alias("a")), members.select(F.col("key").alias("kb"), F.col("id").alias("b"))
    same = a.join(b.hint("merge"), F.col("a") == F.col("b")).where("ka < kb").select("ka", "kb")
    other = found.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"))
    return same.unionByName(other).toDF(f"{key}_a", f"{key}_b")


def groups(df: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """One row per row with a text: its class and the number of other classes that the class is linked to."""
    members, found = copies(df, key, text)
    n = found.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    return members.join(n.hint("merge"), "class", "left").select(key, "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
