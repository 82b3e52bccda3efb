"""Problem 8: passages of evaluation items inside training text.

Method: a BM25 inverted index of the items, queried with every passage of every document by block-max WAND;
all items above the threshold are retrieved and then verified on the words themselves.

The threshold loses nothing: the passages overlap by `RUN` words, so any run of `RUN` words lies whole in one
of them, and each item's impacts are divided by the least score that any run of its own words can reach.
An item that shares such a run with a passage therefore scores at least 1.

The index is built from the items only. Items are taken in blocks of bounded size, whose indexes are built once and
broadcast; documents are read by the tasks and never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12
#: Characters of item texts in one index; more items are taken in several blocks.
INDEX_CHARS = 4_000_000
K1, B, BLOCK = 1.2, 0.75, 16
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall(text.lower())


class Index:
    """Doc-ordered postings with normalised BM25 impacts and the greatest impact of each block."""

    def __init__(self, items: list[tuple[int, str, str | None]]):
        self.ids = [i for i, _, _ in items]
        self.words = [words_of(t or "") for _, t, _ in items]
        self.answers = [words_of(a or "") for _, _, a in items]
        n, mean = len(items), sum(map(len, self.words)) / max(1, len(items)) or 1
        df = Counter(t for w in self.words for t in set(w))
        self.term = {t: k for k, t in enumerate(df)}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in df]
        for d, w in enumerate(self.words):
            if len(w) < RUN:
                continue
            norm = K1 * (1 - B + B * len(w) / mean)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in Counter(w).items()}
            least = min(sum(impact[t] for t in set(w[k : k + RUN])) for k in range(len(w) - RUN + 1))
            for t, x in impact.items():
                self.postings[self.term[t]].append((d, x / least))
        self.greatest = [max((x for _, x in p), default=0.0) for p in self.postings]
        self.blocks = [[(p[min(k + BLOCK, len(p)) - 1][0], max(x for _, x in p[k : k + BLOCK])) for k in range(0, len(p), BLOCK)] for p in self.postings]
        self.runs: list[dict[tuple[str, ...], int]] = [{tuple(w[k : k + RUN]): k for k in range(len(w) - RUN + 1)} for w in self.words]

    def retrieve(self, terms: list[int], threshold: float = 1 - 1e-9) -> list[int]:
        """Block-max WAND: all items whose score over the distinct `terms` reaches the threshold."""
        out: list[int] = []
        lists = [(self.postings[t], self.blocks[t], self.greatest[t]) for t in terms if self.postings[t]]
        at = [0] * len(lists)
        while True:
            live = sorted((lists[k][0][at[k]][0], k) for k in range(len(lists)) if at[k] < len(lists[k][0]))
            bound, pivot = 0.0, -1
            for j, (_, k) in enumerate(live):
                bound += lists[k][2]
                if bound >= threshold:
                    pivot = j
                    break
            if pivot < 0:
                return out
            item = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            # the blocks that would hold `item` bound its score and that of all items up to the nearest block end
            bound, upto = 0.0, None
            for d, k in live[: pivot + 1]:
                for end, top in lists[k][1][at[k] // BLOCK :]:
                    if end >= item:
                        bound += top
                        upto = end if upto is None else min(upto, end)
                        break
            if bound < threshold:
                goal = (upto if upto is not None else item) + 1
                if pivot + 1 < len(live):
                    goal = min(goal, live[pivot + 1][0])
                goal = max(goal, item + 1)
            elif live[0][0] == item:
                if sum(lists[k][0][at[k]][1] for _, k in live[: pivot + 1]) >= threshold:
                    out.append(item)
                goal = item + 1
            else:
                goal = item
            for d, k in live[: pivot + 1]:
                p, i = lists[k][0], at[k]
                while i < len(p) and p[i][0] < goal:
                    i += 1
                at[k] = i

    def leaks(self, text: str | None) -> list[tuple[int, int, bool]]:
        """(item, longest run of its words in the text, answer stands in the text) of each leaked item."""
        if not text:
            return []
        words = words_of(text)
        ids = [self.term.get(w, -1) for w in words]
        known = [self.greatest[t] if t >= 0 else 0.0 for t in ids]
        candidates: set[int] = set()
        for a in range(0, max(1, len(words) - RUN + 1), RUN):
            if sum(known[a : a + 2 * RUN]) < 1 - 1e-9:
                continue
            candidates.update(self.retrieve(list({t for t in ids[a : a + 2 * RUN] if t >= 0})))
        out = []
        for d in sorted(candidates):
            runs, best, now = self.runs[d], 0, 0
            for k in range(len(words) - RUN + 1):
                now = (now + 1 if now else RUN) if tuple(words[k : k + RUN]) in runs else 0
                best = max(best, now)
            if best:
                a = self.answers[d]
                out.append((self.ids[d], best, bool(a) and any(words[k : k + len(a)] == a for k in range(len(words) - len(a) + 1))))
        return out


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, item_id, run, answer) of documents that hold at least `RUN` consecutive words of an item.

    `run` is the longest run found, `answer` tells if the item's answer stands in the document as well. Null, empty
    and short texts give no row, items of fewer than `RUN` words never leak, texts are read whole, repeated
    documents are judged under their own keys, and extra columns are dropped first. Empty tables give no rows.
    """
    few = docs.select(key, text)
    kind = few.schema[key].dataType.simpleString()
    rows = items.select(F.col("item_id").cast("long"), "text", "answer").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / INDEX_CHARS))
    out = None
    for k in range(blocks):
        part = [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").collect()]

        shared = docs.sparkSession.sparkContext.broadcast(Index(part))  # of bounded size, built once

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                found = [(i, *x) for i, t in enumerate(b.column(1).to_pylist()) for x in index.leaks(t)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.bool_())],
                    names=[key, "item_id", "run", "answer"],
                )

        one = few.mapInArrow(run, f"{key} {kind}, item_id long, run int, answer boolean")
        out = one if out is None else out.unionByName(one)
    return out
