"""Problem 7: encoding of the whole corpus with a public tokenizer.

Method: merge replay over a block of the corpus. The distinct words of a block are laid out as chains of
symbols; an inverted index leads from each token pair to the word positions that hold it. The merges are
applied in rank order, each to all its positions at once, and only the touched neighbours change the index.

The ids of a word don't depend on other words, so replaying block by block gives the ids of a replay over
the whole corpus, without shuffling words: a task encodes the rows it reads and no row moves. Words that
came up before are kept in a table of bounded size in each worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"
#: The public pattern that splits text before the merges (given with the vocabulary files).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker keeps; beyond it the table starts anew. Only speed depends on it.
KEPT_WORDS = 400_000


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]]]:
    """Ids of the 256 bytes, and pair of ids to (rank, merged id)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    # byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable}
    for k, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + k)
    merges = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    return [vocab[shown[b]] for b in range(256)], merges


def replay(words: list[bytes], byte_ids: list[int], merges: dict) -> list[list[int]]:
    """The ids of each word, by replaying all merges over all words together.

    Positions of all words lie in one array; -1 as neighbour marks a word's end. A pair's positions are taken
    from left to right, so that overlapping pairs merge as in a word of its own.
    """
    symbol: list[int] = []
    starts = [0]
    for w in words:
        symbol += [byte_ids[b] for b in w]
        starts.append(len(symbol))
    n = len(symbol)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    for s in starts[:-1]:
        if s < n:
            before[s] = -1
    for s in starts[1:]:
        if s:
            after[s - 1] = -1
    index: dict[tuple[int, int], list[int]] = {}
    for i in range(n):
        if after[i] >= 0:
            p = (symbol[i], symbol[i + 1])
            if p in merges:
                index.setdefault(p, []).append(i)
    heap = [(merges[p][0], p) for p in index]
    heapq.heapify(heap)
    while heap:
        _, pair = heapq.heappop(heap)
        spots = index.pop(pair, None)
        if not spots:
            continue
        left, right = pair
        new = merges[pair][1]
        spots.sort()
        for i in spots:
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # an earlier merge took this spot
            symbol[i] = new
            symbol[j] = -1
            k = after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                p = (new, symbol[k])
                if p in merges:
                    at = index.get(p)
                    if at is None:
                        index[p] = [i]
                        heapq.heappush(heap, (merges[p][0], p))
                    else:
                        at.append(i)
            h = before[i]
            if h >= 0:
                p = (symbol[h], new)
                if p in merges:
                    at = index.get(p)
                    if at is None:
                        index[p] = [h]
                        heapq.heappush(heap, (merges[p][0], p))
                    else:
                        at.append(h)
    return [[s for s in symbol[a:b] if s >= 0] for a, b in zip(starts, starts[1:])]


@lru_cache(maxsize=1)
def _kept(path: str) -> dict[str, np.ndarray]:
    return {}


def encode_block(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids of each text; an empty list for a null or empty one."""
    byte_ids, merges = _vocabulary(path)
    kept = _kept(path)
    if len(kept) > KEPT_WORDS:
        kept.clear()
    split = regex.compile(PATTERN).findall
    pieces = [split(t) if t else [] for t in texts]
    fresh = list({w for words in pieces for w in words if w not in kept})
    for w, ids in zip(fresh, replay([w.encode("utf-8") for w in fresh], byte_ids, merges)):
        kept[w] = np.array(ids, np.int32)
    none = np.empty(0, np.int32)
    return [np.concatenate([kept[w] for w in words]) if words else none for words in pieces]


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """Rows (key, ids): the ids of every text by the vocabulary at `path`, without special tokens.

    The strings of special tokens are ordinary text. Null and empty texts give an empty list, repeated rows one
    row each, an empty table an empty result; only the key and the text are read, so other columns cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = encode_block(b.column(1).to_pylist(), path)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=[key, "ids"])

    few = df.select(key, text)
    return few.mapInArrow(run, f"{key} {few.schema[key].dataType.simpleString()}, ids array<int>")
