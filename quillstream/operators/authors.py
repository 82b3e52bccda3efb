"""Authors across sites: pairs that match, and canonical names in order of appearance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import handle
from quillstream.session import cut


def _segments(size: int, parts: int) -> list[tuple[int, int]]:
    """(start, end) of so many even segments of a text."""
    return [(size * i // parts, size * (i + 1) // parts) for i in range(parts)]


def _edits(size: int) -> int:
    """The largest edit distance that two names may have of which the longer has so many letters."""
    return (size - 1) // 5


def _letters(name: str) -> int:
    """Bits of the letters that stand in a name, and of those that stand there twice; an edit changes two at most."""
    once = twice = 0
    for c in name:
        bit = 1 << ord(c) % 31
        twice |= once & bit
        once |= bit
    return once | twice << 31


def _within(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, edits: int) -> np.ndarray:
    """Is the edit distance of the rows of letters at most `edits`? The matrix is filled beside its diagonal, all pairs at once."""
    n, width = len(x), int(size_x.max())
    y = np.pad(y[:, : width + edits], ((0, 0), (edits, 2 * edits + max(0, width - y.shape[1]))))
    kind = np.int8 if edits < 100 else np.int32
    far = kind(100 if edits < 100 else 1 << 30)
    row = [np.full(n, k if k >= 0 else far, kind) for k in range(-edits, edits + 1)]
    last = np.full(n, far, kind)
    for i in range(width + 1):
        if i:
            fresh: list[np.ndarray] = []
            for k in range(2 * edits + 1):
                if i + k - edits < 0:
                    fresh.append(np.full(n, far, kind))
                    continue
                cell = row[k] + (x[:, i - 1] != y[:, i + k - 1]) if i + k - edits > 0 else np.full(n, min(i, far), kind)
                if k < 2 * edits:
                    cell = np.minimum(cell, row[k + 1] + 1)
                if k:
                    cell = np.minimum(cell, fresh[k - 1] + 1)
                fresh.append(np.minimum(cell, far).astype(kind))
            row = fresh
        if len(done := np.flatnonzero(size_x == i)):
            last[done] = np.stack(row)[(size_y - size_x)[done] + edits, done]
    return last <= edits


def _near_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Rows (bare, letters, key, longer) in the order of their keys to pairs (x, y) of names of one key, y the longer one,
    that are different and close; at most so many are compared at once."""

    def pairs(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        group = t.column(2).dictionary_encode().indices.to_numpy()
        longer = t.column(3).to_numpy(zero_copy_only=False)
        letters = t.column(1).to_numpy()
        order = np.lexsort((longer, group))  # of each group the shorter ones go first
        n = np.bincount(group)
        n_y = np.bincount(group, longer).astype(np.int64)
        start, n_x = np.r_[0, np.cumsum(n)[:-1]], n - n_y
        # one task for each shorter name: its place, and where the longer ones of its group are
        of = np.repeat(np.arange(len(n)), np.where(n_y > 0, n_x, 0))
        if not len(of):
            return
        first = np.r_[True, of[1:] != of[:-1]]
        at = np.arange(len(of)) - np.repeat(np.flatnonzero(first), np.diff(np.r_[np.flatnonzero(first), len(of)]))
        x_at, y_from, y_n = start[of] + at, start[of] + n_x[of], n_y[of]
        names = t.column(0).dictionary_encode()
        spelt = names.dictionary.to_pylist()
        which = names.indices.to_numpy()
        size = np.array([len(w) for w in spelt], np.int64)
        ends = np.cumsum(y_n)
        low = 0
        while low < len(of):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
            times = y_n[low:high]
            i = np.repeat(x_at[low:high], times)
            j = np.repeat(y_from[low:high] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            i, j = order[i], order[j]
            low = high
            x, y = which[i], which[j]
            edits = (size[y] - 1) // 5
            fits = (np.bitwise_count(letters[i] ^ letters[j]) <= 2 * edits) & (x != y) & (size[x] <= size[y]) & (size[y] - size[x] <= edits)
            x, y, edits = x[fits], y[fits], edits[fits]
            code = np.unique(x.astype(np.int64) * len(spelt) + y)
            x, y = code // len(spelt), code % len(spelt)
            edits = (size[y] - 1) // 5
            hit = np.zeros(len(x), bool)
            for k in np.unique(edits):
                some = np.flatnonzero(edits == k)
                own = np.unique(np.r_[x[some], y[some]])
                chars = np.array([spelt[w] for w in own], f"U{size[own].max()}").view(np.uint32).reshape(len(own), -1)
                hit[some] = _within(chars[np.searchsorted(own, x[some])], chars[np.searchsorted(own, y[some])], size[x[some]], size[y[some]], int(k))
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(x[hit])), names.dictionary.take(pa.array(y[hit]))], names=["x", "y"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(2)
        if held and key[0].as_py() == key[-1].as_py() == held[-1].column(2)[-1].as_py():
            held.append(b)  # one key goes on
            continue
        whole = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
        ids = whole.column(2).dictionary_encode().indices.to_numpy()
        end = int(np.searchsorted(ids, ids[-1]))
        if end:
            yield from pairs(whole.slice(0, end))
        held = [whole.slice(end)]
    if held:
        yield from pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names to keys (bare, letters, key, longer): the segments of each as the longer of two, and the runs that may equal
    one of them in each as the shorter.

    Of a name cut into one segment more than there are edits, one segment i is whole and has i edits at most before
    it, so its place in the other name moves by i at most, and counted from the end by the other edits at most.
    """
    for b in batches:
        at, key, longer = [], [], []
        for k, name in enumerate(b.column(0).to_pylist()):
            own, size, keys = len(name), len(name), set()
            while size - own <= _edits(size):
                edits, gap = _edits(size), size - own
                for i, (start, end) in enumerate(_segments(size, edits + 1) if edits else ()):
                    if not gap:
                        at.append(k)
                        key.append(f"{size} {i} {name[start:end]}")
                        longer.append(True)
                    first, last = max(0, start - i, start - gap - edits + i), min(own - end + start, start + i, start - gap + edits - i)
                    keys.update(f"{size} {i} {name[p : p + end - start]}" for p in range(first, last + 1))
                size += 1
            at += [k] * len(keys)
            key += keys
            longer += [False] * len(keys)
        i = pa.array(at, pa.int64())
        letters = pa.array([_letters(n) for n in b.column(0).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(i), letters.take(i), pa.array(key, pa.string()), pa.array(longer, pa.bool_())], names=["bare", "letters", "key", "longer"])


def _close(bares: DataFrame) -> DataFrame:
    """Pairs (x, y) of different names `bare` whose edit distance is below a fifth of the longer's length."""
    parts = bares.sparkSession.sparkContext.defaultParallelism
    keys = bares.repartition(parts, "bare").mapInArrow(_segment_batches, "bare string, letters long, key string, longer boolean")
    found = keys.repartition(4 * parts, "key").sortWithinPartitions("key").mapInArrow(_near_batches, "x string, y string")
    # of two names of one size both are the longer one
    return cut(found.where("length(x) < length(y) or x < y").distinct())


def _matches(authors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(ids, hits): the id (least key of equal name and URL) of every author with a name, and the pairs (a, b), a < b, of ids that match.

    Pairs come rule by rule, none is lost. Equal bare names and equal handles meet by equality. Of two names of which one
    holds the other, the rarest run of four letters of the shorter stands in the longer. Names within an edit
    distance share a segment (`_segment_batches`). These two meet as different bare names and are compared where they meet.
    """
    rows = authors.where(F.trim("authorName") != "").select(F.col(key).alias("ref"), F.lower(F.trim("authorName")).alias("name"), F.coalesce("authorUrl", F.lit("")).alias("url"))
    each = rows.groupBy("name", "url").agg(F.min("ref").alias("id"))
    bare = F.regexp_replace("name", "[@_\\s0-9-]", "")
    named = cut(each.select("id", "name", bare.alias("bare"), F.coalesce(handle(F.col("url")), F.lit("")).alias("handle")))
    ordered = lambda x, y: x.join(y, "k").where("a < b").select("a", "b")
    same = lambda c: ordered(c.toDF("a", "k"), c.toDF("b", "k"))
    equal = same(named.select("id", "bare").where("length(bare) > 2")).unionByName(same(named.select("id", "name"))).unionByName(same(named.select("id", "handle").where("handle <> ''")))
    bares = cut(named.select("bare").where("length(bare) > 3").distinct())
    runs = cut(bares.select("bare", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("bare") - 3), lambda i: F.col("bare").substr(i, F.lit(4))))).alias("k")))
    rarest = runs.join(runs.groupBy("k").agg(F.count("*").alias("n")), "k").groupBy("bare").agg(F.min(F.struct("n", "k")).alias("r"))
    within = rarest.select(F.col("bare").alias("x"), F.col("r.k").alias("k")).join(runs.select(F.col("bare").alias("y"), "k"), "k").where("x <> y and contains(y, x)").select("x", "y")
    names = within.unionByName(_close(bares)).distinct()
    of = lambda s, c: named.select(F.col("id").alias(s), F.col("bare").alias(c))
    other = names.join(of("p", "x"), "x").join(of("q", "y"), "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return rows.join(each, ["name", "url"]).select("ref", "id"), equal.unionByName(other).distinct()


def author_pairs(authors: DataFrame, key: str = "authorRef") -> DataFrame:
    """Pairs (a, b), a < b, of authors that match. Null and blank names match nobody.

    Equal names are folded to one row before they meet and unfolded afterwards.
    """
    ids, hits = _matches(authors, key)
    same = ids.toDF("a", "id").join(ids.toDF("b", "id"), "id").where("a < b").select("a", "b")
    other = hits.join(ids.toDF("ra", "a"), "a").join(ids.toDF("rb", "b"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    return same.unionByName(other)


def canonical_names(authors: DataFrame, key: str = "authorRef") -> DataFrame:
    """Rows (key, canonical): greedy from the oldest on, each author takes the name of the first one that matches and has
    kept its own.

    An author keeps its name if no earlier one that keeps its own matches. Each round settles all whose earlier matches are
    settled, so the result is that of the sequential fold over all authors. Null and blank names are their own.
    """
    ids, hits = _matches(authors, key)
    ids, hits = cut(ids), cut(hits)
    first = ids.select("id").distinct()
    kept = cut(first.join(hits.select(F.col("b").alias("id")), "id", "left_anti"))
    fresh, left = kept, hits
    while not left.isEmpty():
        taken = left.join(fresh.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        rest = left.join(fresh.withColumnRenamed("id", "a"), "a", "left_anti")
        open_ = cut(left.select(F.col("b").alias("id")).distinct().join(taken, "id", "left_anti"))
        # a match with an author that took another's name binds nobody
        left = cut(rest.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
        fresh = cut(open_.join(left.select(F.col("b").alias("id")), "id", "left_anti"))
        kept = kept.unionByName(fresh)
    took = hits.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").groupBy("b").agg(F.min("a").alias("of")).withColumnRenamed("b", "id")
    rows = authors.select(F.col(key).alias("ref"), F.trim("authorName").alias("name"))
    names = rows.select(F.col("ref").alias("of"), F.col("name").alias("canonical"))
    of = ids.join(took.join(kept, "id", "left_anti"), "id", "left").select("ref", F.coalesce("of", "id").alias("of"))
    return rows.join(of.join(names, "of").select("ref", "canonical"), "ref", "left").select(F.col("ref").alias(key), F.coalesce("canonical", "name").alias("canonical"))
