"""Problem 2: subject areas of each document.

Method: labels spread over a verified similarity graph by iterative DataFrame joins, from clamped seeds, and a node
may keep several subjects. A post is about an area if one of its sentences is, so the documents of the graph are
sentences; they are joined through their words. Sentence nodes are folded into the edges: an edge between
two words counts the different sentences that hold both, over all rows. An edge is verified if the words
stand together far more often than chance has it. The words of the hand-labelled examples are the seeds. The
tool's own tags are nodes, too: however often one is wrong, the posts under it share their subject more than
chance has it, so a tag takes the subject of its words and hands it on to words of any language.

A sentence then takes the subject of its words. Fixed phrases (small talk, figures of speech) return word for
word, while a word's own sentences differ; word pairs that nearly always return within the same sentence
mark such phrases, and their sentences take no subject.

Texts are read and split once: posts are kept as lists of sentence hashes, different sentences as word ids
(32 bits of a hash), packed into bytes. Counts of pairs leave a task packed, too, one row for each word. All counts are taken over sentences made distinct over all rows, and uses over different texts, so
that neither copies nor the layout of the rows weigh anything. What the tasks get is bounded: a word is a node only if it stands in `NODE_SHARE` of all
different sentences, so there are at most (mean words of a sentence) / `NODE_SHARE` nodes, some 50,000, and as many
labelled words; a pair marks fixed phrases only if it makes up `FIXED_OF_ALL` of all uses of sentences, and one that is
counted over all sentences makes up about a third of that in sentences of `OFTEN` uses.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.cut_texts import _boundaries, split_end
from quillstream.llm.text_form import consistent
from quillstream.session import cut, kept

ROUNDS = 3
#: A verified edge needs this lift over chance and so many sentences, or so large a share of all; a label needs so many verified edges to words
#: that have it and this share of all labelled company of the word; a seed keeps its label from half of that on.
LIFT, LEAST, LEAST_SHARE, EDGES, PURITY = 3.0, 2, 1.6e-6, 3, 0.7
#: Words in fewer sentences, or in a smaller share of all sentences, are no nodes.
NODE_SENTENCES, NODE_SHARE = 4, 2e-4
#: A neighbour in more than this share of a word's sentences belongs to the same fixed expression and tells nothing.
PARTNER = 0.5
#: So much of a word's weighted company must bear a label before the word gets one.
REACHED = 0.25
#: A tag's share of one subject; posts under such tags that a word needs, and their share under its subject's tags;
#: words with twice as many posts and no share above `FLAT` get no label; nor do words of whose posts, tagged so or
#: not, a smaller part than `TAG_ALL` is under the subject's tags.
TAG_PURITY, TAG_POSTS, TAG_SHARE, FLAT, TAG_ALL = 0.5, 6, 0.6, 0.45, 0.3
#: Words in more than this share of all sentences make no edges.
COMMON = 0.03
#: A word pair marks fixed phrases if its sentences are so much rarer than its uses.
FIXED, FIXED_USES, FIXED_OF_ALL, FIXED_SHARE = 0.34, 4, 2e-6, 0.4
#: A sentence returns only if it makes up this share of all uses of sentences; else its uses count as one, as in a large
#: table every sentence of common words returns by chance.
RETURNS = 3e-6
#: A sentence of fewer uses makes no pair one that marks fixed phrases: what it adds to the sentences is more than `FIXED` of its uses.
OFTEN = 1 / FIXED
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")


class _Ids(dict):
    """Packed ids of the words in a piece of text without spaces; filled as pieces come up, and emptied when it grows too large."""

    MOST, LONGEST = 300_000, 40

    def __missing__(self, piece: str) -> bytes:
        k = b"".join(_id("0" if w[0].isdigit() else w.lower()).to_bytes(4, sys.byteorder, signed=True) for w in _TOKEN.findall(piece))
        if len(piece) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = k
        return k


_ids = _Ids()


def _id(w: str) -> int:
    return xxhash.xxh32_intdigest(w) - 2**31


def sentences(text: str | None) -> list[str]:
    """The whole sentences of a text; what a cut left open is none."""
    if not text or not text.strip():
        return []
    t = text if text.isascii() else consistent(text)
    open_end, mark, _ = split_end(t)
    out, at = [], 0
    for m in _boundaries(t):
        if s := t[at : m.end()].strip():
            out.append(s)
        at = m.end()
    if rest := t[at:].strip():
        out.append(rest)
    if out and (mark or open_end and out[-1].startswith(open_end[:20])):
        out = out[:-1]
    return out


def words(sentence: str) -> bytes:
    """Packed ids of the words in lower case; numbers count as one word. Names drop out of the graph by their counts.

    No word holds a space, so the pieces between spaces can be looked up.
    """
    return b"".join(map(_ids.__getitem__, sentence.split()))


def _lists(values: list | np.ndarray, counts: list[int] | np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values, kind))


def _packed(lists: pa.ListArray) -> pa.BinaryArray:
    """Lists of numbers as their bytes, which the JVM, shuffles and tables handle as one value each."""
    if lists.null_count == len(lists):  # rows of counts, which have none at all
        return pa.nulls(len(lists), pa.binary())
    ends = lists.offsets.to_numpy()
    ends = (ends - ends[0]) * (lists.type.value_type.bit_width // 8)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(lists.flatten().to_numpy())])


def _unpacked(a: pa.BinaryArray, kind: pa.DataType) -> pa.ListArray:
    """The lists again; nulls stay nulls."""
    if not len(a):
        return pa.array([], pa.list_(kind))
    valid, ends, data = a.buffers()
    ends = np.frombuffer(ends, np.int32, a.offset + len(a) + 1) // (kind.bit_width // 8)
    values = pa.Array.from_buffers(kind, int(ends[-1]), [None, data or pa.py_buffer(b"")])
    return pa.Array.from_buffers(pa.list_(kind), len(a), [valid, pa.py_buffer(ends.astype(np.int32))], offset=a.offset, children=[values])


def _tag(tag: str | None) -> int:
    return xxhash.xxh64_intdigest("#" + (tag or "")) - 2**63


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, tag) to posts (key, sents, hash of the text) and, once a batch, sentences under a tag (hash, tag, words,
    uses)."""
    for b in batches:
        known: dict[str, int] = {}
        uses: dict[tuple[str, str | None], int] = {}
        at, sents, lengths, texts = [], [], [], []
        for k, (t, tag) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            if not (found := dict.fromkeys(sentences(t))):
                continue
            at.append(k)
            texts.append(xxhash.xxh64_intdigest(t) - 2**63)
            for s in found:
                if s not in known:
                    known[s] = xxhash.xxh64_intdigest(s) - 2**63
                uses[s, tag] = uses.get((s, tag), 0) + 1
            own = [known[s] for s in found]
            sents += own
            lengths.append(len(own))
        ids = {s: words(s) for s in known}
        tags = {tag: _tag(tag) for tag in {tag for _, tag in uses}}
        n, m = len(at), len(uses)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.nulls(m, b.column(0).type)]),
                pa.concat_arrays([_lists(np.array(sents, np.int64), lengths, pa.int64()), pa.nulls(m, pa.list_(pa.int64()))]),
                pa.array(texts + [known[s] for s, _ in uses], pa.int64()),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([tags[tag] for _, tag in uses], pa.int64())]),
                pa.array([None] * n + [ids[s] for s, _ in uses], pa.binary()),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(uses.values(), pa.int64())]),
            ],
            names=["key", "sents", "hash", "tag", "words", "uses"],
        )


def _once_batches(batches: Iterator[pa.RecordBatch], least: float = 0.0, often: float = 0.0) -> Iterator[pa.RecordBatch]:
    """Sentences (hash, tag, words, uses) in the order of their hashes to one row each (hash, words, tags, uses), and
    rows (kind, a, uses, sentences) that count their words; see `_word_counts`. Fewer uses than `least` count as one, and
    neighbours are counted in sentences of at least `often` uses.

    Rows without words take back uses of copies; they stand behind the others of their hash. The rows of the last sentence
    of a batch are held back until the next.
    """

    def merged(t: pa.RecordBatch) -> pa.RecordBatch:
        back = None
        if t.column(2).null_count:
            real = t.column(2).is_valid()
            back, t = t.filter(pc.invert(real)), t.filter(real)
        m = once(t)
        if back is None:
            return m
        uses = m.column(3).to_numpy().copy()
        np.add.at(uses, np.searchsorted(m.column(0).to_numpy(), back.column(0).to_numpy()), back.column(3).to_numpy())
        return pa.RecordBatch.from_arrays([*m.columns[:3], pa.array(uses)], names=m.schema.names)

    def once(t: pa.RecordBatch) -> pa.RecordBatch:
        hashes, tags = t.column(0).to_numpy(), t.column(1).to_numpy(zero_copy_only=False)
        order = np.lexsort((tags, hashes))
        hashes, tags = hashes[order], tags[order]
        start = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (tags[1:] != tags[:-1])]
        per = np.add.reduceat(fresh.astype(np.int64), start)
        return pa.RecordBatch.from_arrays([pa.array(hashes[start]), t.column(2).take(pa.array(order[start])), _lists(tags[fresh], per, pa.int64()), pa.array(np.add.reduceat(t.column(3).to_numpy()[order], start))], names=["hash", "words", "tags", "uses"])

    def again(x: pa.RecordBatch) -> pa.RecordBatch:
        """One merged sentence as rows of the input."""
        tags = x.column(2).flatten()
        return pa.RecordBatch.from_arrays([x.column(0).take(pa.array([0] * len(tags))), tags, x.column(1).take(pa.array([0] * len(tags))), pa.array([x.column(3)[0].as_py()] + [0] * (len(tags) - 1), pa.int64())], names=["hash", "tag", "words", "uses"])

    counts = _WordSums()

    def out(m: pa.RecordBatch) -> pa.RecordBatch:
        """The sentences of a batch; the counts of their words stay here until there are many."""
        uses = m.column(3).to_numpy()
        counts.add(m.column(1), _weights(uses, least), often)
        none = [pa.nulls(m.num_rows, t) for t in (pa.int8(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*m.columns, *none], names=["hash", "words", "tags", "uses", "kind", "a", "sentences"])

    def counted(like: pa.RecordBatch) -> pa.RecordBatch:
        kind, a, uses, n = counts.all()
        none = [pa.nulls(len(a), like.column(k).type) for k in range(3)]
        return pa.RecordBatch.from_arrays([*none, pa.array(uses), pa.array(kind), pa.array(a), pa.array(n)], names=["hash", "words", "tags", "uses", "kind", "a", "sentences"])

    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(y.type), y]) for x, y in zip(again(held).columns, b.columns)], names=["hash", "tag", "words", "uses"])
        m = merged(b)
        held = m.slice(m.num_rows - 1)
        if m.num_rows > 1:
            yield out(m.slice(0, m.num_rows - 1))
            if counts.held > counts.MOST:
                yield counted(m)
    if held is not None:
        yield out(held)
        yield counted(held)


def _once_packed(batches: Iterator[pa.RecordBatch], least: float, often: float) -> Iterator[pa.RecordBatch]:
    """`_once_batches` with packed words and tags."""
    lists = (pa.RecordBatch.from_arrays([b.column(0), b.column(1), _unpacked(b.column(2), pa.int32()), b.column(3)], names=b.schema.names) for b in batches)
    for m in _once_batches(lists, least, often):
        yield pa.RecordBatch.from_arrays([m.column(0), _packed(m.column(1)), _packed(m.column(2)), *m.columns[3:]], names=m.schema.names)


def _weights(uses: np.ndarray, least: float) -> np.ndarray:
    """Fewer uses than `least` count as one."""
    return np.where(uses < least, 1, uses)


class _WordSums:
    """Counts of words and of pairs of neighbours, added up over batches."""

    MOST = 1_500_000

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, lists: pa.ListArray, n: np.ndarray, often: float) -> None:
        self.parts.append(_word_counts(lists, n, often))
        self.held += len(self.parts[-1][0])
        if self.held > self.MOST:  # what is left after adding up may stay if it is less than half of that
            self.parts = [self.all()]
            self.held = 2 * len(self.parts[0][0])

    def all(self) -> tuple[np.ndarray, ...]:
        """(kind, code, uses, sentences); it starts anew."""
        kind, code, uses, n = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.empty(0, np.int8), *(np.empty(0, np.int64) for _ in range(3)))
        order = np.lexsort((code, kind))
        kind, code, uses, n = kind[order], code[order], uses[order], n[order]
        start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (kind[1:] != kind[:-1])]) if len(code) else np.empty(0, np.int64)
        self.parts, self.held = [], 0
        return (kind[start], code[start], np.add.reduceat(uses, start), np.add.reduceat(n, start)) if len(start) else (kind, code, uses, n)


class _Sums:
    """Counts by code, added up over batches; they leave when there are too many to hold. Codes below `size` are counted
    in place if that takes less memory than holding them."""

    MOST = 2_000_000
    CELLS = 1 << 24

    def __init__(self, size: int) -> None:
        self.cells = np.zeros(size, np.int64) if size <= self.CELLS else None
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, codes: np.ndarray) -> bool:
        """Is it time to let them go?"""
        if self.cells is None:
            codes, counts = np.unique(codes, return_counts=True)
            self.counts.append(counts)
        self.codes.append(codes)
        self.held += len(codes)
        if self.held <= self.MOST:
            return False
        if self.cells is not None:
            self._count()
            return False
        u, c = self.all()
        self.codes, self.counts, self.held = [u], [c], len(u)
        return self.held > self.MOST // 2

    def _count(self) -> None:
        if self.codes:
            self.cells += np.bincount(np.concatenate(self.codes), minlength=len(self.cells))
            self.codes, self.held = [], 0

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes and their counts so far; it starts anew."""
        if self.cells is not None:
            self._count()
            u = np.flatnonzero(self.cells)
            c = self.cells[u]
            self.cells[u] = 0
            return u, c
        if not self.codes:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes, counts = np.concatenate(self.codes), np.concatenate(self.counts)
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
        self.codes, self.counts, self.held = [], [], 0
        return codes[start], np.add.reduceat(counts, start) if len(start) else counts


class _Places:
    """Places of numbers in a sorted array: a table over hashed bits answers for all but numbers that share a cell."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.mask = (1 << max(12, min(22, (32 * len(codes)).bit_length()))) - 1
        cell = self._cell(codes)
        self.table = np.full(self.mask + 1, -1, np.int32)
        self.table[cell] = np.where(np.bincount(cell, minlength=self.mask + 1)[cell] > 1, len(codes), np.arange(len(codes)))

    def _cell(self, x: np.ndarray) -> np.ndarray:
        return (x ^ x >> 32) & self.mask

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the numbers are in the array, and where."""
        p = self.table[self._cell(x)]
        at = np.flatnonzero(p >= 0)
        p, x = p[at], x[at]
        shared = np.flatnonzero(p == len(self.codes))
        p[shared] = np.minimum(np.searchsorted(self.codes, x[shared]), len(self.codes) - 1)
        there = self.codes[p] == x if len(self.codes) else p == 0
        return at[there], p[there].astype(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers in order; sorting whole batches is faster here than NumPy's hash table."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the sentences one after the other, the sentence of each, and their number in each."""
    size = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size), size


def _neighbours(flat: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring words, two ids in 64 bits, and the sentence of each."""
    inside = np.flatnonzero(sent[1:] == sent[:-1])
    return flat[inside] << 32 | flat[inside + 1] & 0xFFFFFFFF, sent[inside]


def _word_counts(lists: pa.ListArray, n: np.ndarray, often: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of different sentences and their uses: kind (0 words, 1 pairs of neighbours in sentences of `often` uses), code, uses
    and number of the sentences that hold each."""
    flat, sent, _ = _flat(lists)
    vocab, w = np.unique(flat, return_inverse=True)
    key = _distinct(sent * max(len(vocab), 1) + w)
    ws, ss = key % max(len(vocab), 1), key // max(len(vocab), 1)
    returns = (n >= often)[sent]
    pair, of = _neighbours(flat[returns], sent[returns])
    u, inv = np.unique(pair, return_inverse=True)
    return np.r_[np.zeros(len(vocab), np.int8), np.ones(len(u), np.int8)], np.r_[vocab, u], np.r_[np.bincount(ws, n[ss], len(vocab)), np.bincount(inv, n[of], len(u))].astype(np.int64), np.r_[np.bincount(ws, minlength=len(vocab)), np.bincount(inv, minlength=len(u))]


#: What `_pair_batches` counts: uses and sentences of pairs of neighbours, pairs of words, words with a tag.
USES, HOLD, PAIR, TAGGED = 0, 1, 2, 4


def _pair_batches(nodes: np.ndarray, linked: np.ndarray, marks: np.ndarray, least: float):
    """Different sentences (words, tags, uses) to counts (kind, a, b, n), one row for each `a` with all its partners `b` and
    their counts packed: pairs of the words `linked` (the places in `nodes`, a < b), words of `nodes` (the place) with a
    tag, and the neighbours `marks`. The arrays are sorted; fewer uses than `least` count as one."""
    links, node_places, mark_places = np.isin(nodes, linked), _Places(nodes), _Places(marks)

    def rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        """Of counts in the order of `a`."""
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        per = np.diff(np.r_[start, len(a)])
        return [pa.array(np.full(len(start), kind, np.int8)), pa.array(a[start]), *(_packed(_lists(x, per, pa.int64())) for x in (b, n))]

    def batch(*parts: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*parts)], names=["kind", "a", "b", "n"])

    def out(pairs: _Sums, tagged: _Sums, names: dict[int, int]) -> pa.RecordBatch:
        u, c = pairs.all()
        t, n = tagged.all()
        tags = np.array(list(names), np.int64)
        order = np.argsort(t % len(nodes), kind="stable")
        t, n = t[order], n[order]
        return batch(rows(PAIR, u // len(nodes), u % len(nodes), c), rows(TAGGED, t % len(nodes), tags[t // len(nodes)] if len(t) else t, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, tagged, names = _Sums(len(nodes) ** 2), _Sums(1 << 62), {}
        used, hold = np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int64)
        for b in batches:
            flat, sent, _ = _flat(_unpacked(b.column(0), pa.int32()))
            if not len(flat):
                continue
            if len(marks):
                pair, of = _neighbours(flat, sent)
                at, m = mark_places.find(pair)
                of = of[at]
                used += np.bincount(m, _weights(b.column(2).to_numpy(), least)[of], len(marks)).astype(np.int64)
                hold += np.bincount(m, minlength=len(marks))
            if not len(nodes):
                continue
            at, w = node_places.find(flat)
            key = _distinct(sent[at] * len(nodes) + w)
            ws, ss = key % len(nodes), key // len(nodes)
            # under each of its tags a sentence counts once
            lists = _unpacked(b.column(1), pa.int64())
            name, t = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            t = np.array([names.setdefault(x, len(names)) for x in name.tolist()], np.int64)[t]
            ends = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
            times = np.diff(ends)[ss]
            of = np.repeat(ends[ss], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            full = tagged.add(t[of] * len(nodes) + np.repeat(ws, times))
            inside = links[ws]
            ws, ss = ws[inside], ss[inside]
            codes = [np.empty(0, np.int64)]
            gap, i = 1, np.arange(len(ss))
            while len(i := i[i < len(ss) - gap]):
                i = i[ss[i + gap] == ss[i]]
                codes.append(ws[i] * len(nodes) + ws[i + gap])
                gap += 1
            if pairs.add(np.concatenate(codes)) or full:
                yield out(pairs, tagged, names)
        if len(nodes):
            yield out(pairs, tagged, names)
        if len(marks):
            at = marks >> 32
            yield batch(rows(USES, at, marks, used), rows(HOLD, at, marks, hold))

    return run


def _summed_batches(nodes: np.ndarray, sizes: np.ndarray, together: int):
    """Rows (kind, a, b, n) in the order of kind and `a`, as from many tasks, to (kind, a, b, n_ab, n_a, n_b): one row for each
    pair, words as their ids. Pairs of words need `together` sentences; `sizes` are the sentences of the `nodes`."""

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        b, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return b, np.bincount(at, np.concatenate([x for _, x in parts]), len(b)).astype(np.int64)

    def summed(kind: int, a: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        b, n = added(parts)
        if kind == PAIR:
            b, n = b[n >= together], n[n >= together]
            return np.full(len(b), kind, np.int8), np.full(len(b), nodes[a]), nodes[b], n, np.full(len(b), sizes[a]), sizes[b]
        none = np.zeros(len(b), np.int64)
        return np.full(len(b), kind, np.int8), np.full(len(b), nodes[a] if kind == TAGGED else a), b, n, none, none

    def out(done: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done)], names=["kind", "a", "b", "n_ab", "n_a", "n_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held, done, ready = None, [], 0, [], 0
        for batch in batches:
            for kind, a, b, n in zip(*(x.to_pylist() for x in batch.columns)):
                if at != (kind, a):
                    if at:
                        done.append(summed(*at, parts))
                        ready += len(done[-1][0])
                    at, parts, held = (kind, a), [], 0
                    if ready > 50_000:
                        yield out(done)
                        done, ready = [], 0
                parts.append((np.frombuffer(b, np.int64), np.frombuffer(n, np.int64)))
                held += len(parts[-1][0])
                if held > _Sums.MOST:  # the same partners from many tasks
                    parts = [added(parts)]
                    held = len(parts[0][0]) // 2
        if at:
            yield out([*done, summed(*at, parts)])

    return run


def _seeds(examples: DataFrame) -> DataFrame:
    """Words of the labelled texts: (a, subject, share of the word's labelled sentences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, s, i) for t, s, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()) if t and s for x in sentences(t) for w in set(np.frombuffer(words(x), np.int32).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["a", "subject", "example"])

    seen = examples.select("text", "subject", F.xxhash64("text").alias("example")).mapInArrow(run, "a long, subject string, example long").groupBy("a", "subject").agg(F.count_distinct("example").alias("n"))
    return seen.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("a")))


def model(different: DataFrame, words: DataFrame, examples: DataFrame, returns: float = 0.0) -> tuple[list, np.ndarray]:
    """The words' subjects (a, subject, score, company) and the sorted word pairs that mark fixed phrases, from the
    different sentences (words, tags, uses) and the counts of their words (kind, a, uses, sentences). Fewer uses than
    `returns` count as one.

    `company` is the mean number of other words of the same subject in a word's sentences.
    """
    size = different.agg(F.count("*").alias("n"), F.sum("uses").alias("uses")).first()
    total = size["n"] or 1
    least = max(FIXED_USES, int(FIXED_OF_ALL * (size["uses"] or 0)))
    # Neighbours are counted in sentences of `OFTEN` uses so far. Others have at most `few` uses, so a pair that is fixed over
    # all sentences is so over these, too, and they have at least the rest of `few * FIXED` of the uses it needs.
    few = math.ceil(OFTEN) - 1
    counts = cut(words.groupBy("kind", "a").agg(F.sum("uses").alias("uses"), F.sum("sentences").alias("sentences")).where(F.expr(f"kind = 0 and sentences >= {max(NODE_SENTENCES, NODE_SHARE * total)} or kind = 1 and uses >= {least * (1 - few * FIXED) * 0.999} and sentences <= {FIXED} * uses")))
    rows = sorted(counts.collect())
    nodes, sizes = (np.array([r[x] for r in rows if not r["kind"]], np.int64) for x in ("a", "sentences"))
    marks = np.array([r["a"] for r in rows if r["kind"]], np.int64)
    together = max(LEAST, round(LEAST_SHARE * total))
    counted = different.select("words", "tags", "uses").mapInArrow(_pair_batches(nodes, nodes[sizes <= max(COMMON * total, 3)], marks, returns), "kind byte, a long, b binary, n binary")
    summed = counted.repartition("kind", "a").sortWithinPartitions("kind", "a").mapInArrow(_summed_batches(nodes, sizes, together), "kind byte, a long, b long, n_ab long, n_a long, n_b long")
    with kept(summed) as both:
        uses, hold = (F.sum(F.when(F.col("kind") == k, F.col("n_ab"))).alias(x) for k, x in ((USES, "uses"), (HOLD, "sentences")))
        marked = both.where(F.col("kind") <= HOLD).groupBy("b").agg(uses, hold).where(F.expr(f"uses >= {least} and sentences <= {FIXED} * uses"))
        fixed = np.sort(np.array([r["b"] for r in marked.select("b").collect()] if len(marks) else [], np.int64))
        own = counts.where("kind = 0").select("a")
        return _spread(both.where(F.col("kind") == TAGGED).select("a", "b", F.col("n_ab").alias("posts")), both.where(F.col("kind") == PAIR), own, examples, total), fixed


def _one(df: DataFrame) -> DataFrame:
    """A table of at most a few rows for each node, in one partition, so that nothing about it is shuffled or broadcast."""
    return df.coalesce(1).hint("merge")


def _spread(tags: DataFrame, pairs: DataFrame, nodes: DataFrame, examples: DataFrame, total: int) -> list:
    """Rows (a, subject, score, company) of the words that have a label in the end."""
    lift = F.col("n_ab") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b"))
    both_ways = pairs.select("a", "b", "n_ab", "n_a", "n_b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n_ab", F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
    edges = both_ways.withColumn("verified", lift >= LIFT)
    seeds = _one(cut(_one(_seeds(examples).where(F.col("share") >= PURITY)).join(_one(nodes.select("a")), "a", "left_semi").select("a", F.col("subject").alias("seed"), F.col("share").alias("score"), "n")))
    first = seeds.select("a", F.col("seed").alias("subject"), "score")
    tags = _one(tags)
    spread = tags.join(first, "a").groupBy("b", "subject").agg(F.sum(F.col("posts") * F.col("score")).alias("s"))
    even = spread.withColumn("s", F.col("s") / F.sum("s").over(Window.partitionBy("subject")))
    meant = even.withColumn("share", F.col("s") / F.sum("s").over(Window.partitionBy("b"))).where(F.col("share") >= TAG_PURITY).select("b", "subject")
    every = tags.groupBy("a").agg(F.sum("posts").alias("every"))
    under = tags.join(meant.hint("merge"), "b").groupBy("a", "subject").agg(F.sum("posts").alias("s")).join(every.hint("merge"), "a")
    under = under.withColumn("posts", F.sum("s").over(Window.partitionBy("a"))).withColumn("share", F.col("s") / F.col("posts"))
    under = _one(cut(under.withColumn("most", F.max("share").over(Window.partitionBy("a")))))
    trusted = under.where((F.col("posts") >= TAG_POSTS) & (F.col("share") >= TAG_SHARE) & (F.col("s") >= TAG_ALL * F.col("every"))).select("a", "subject", F.lit(1.0).alias("score"))
    poor = (F.col("share") == F.col("most")) & (F.col("s") < TAG_ALL / 2 * F.col("every"))
    flat = under.where((F.col("posts") >= 2 * TAG_POSTS) & ((F.col("most") < FLAT) | poor)).select("a").distinct()
    settled = _one(trusted.select("a").unionByName(flat)).distinct().hint("merge")
    labels = cut(_one(trusted.unionByName(first.join(settled, "a", "left_anti"))))
    heard = F.col("n_ab") / (F.col("n_b").cast("double") * F.col("n_b"))
    company = _one(cut(edges.where(F.col("verified") & (F.col("n_ab") < PARTNER * F.col("n_a"))).groupBy("a").agg(F.sum(heard).alias("all"))))
    for _ in range(ROUNDS):
        told = edges.where(F.col("n_ab") < PARTNER * F.col("n_a")).join(F.broadcast(labels.toDF("b", "subject", "score")), "b")
        # rare neighbours tell more than the words of a sentence frame, which stand beside all subjects
        spread = _one(told.groupBy("a", "subject").agg(F.sum(heard * F.col("score")).alias("s"), F.count_if("verified").alias("k"), F.sum(F.when(F.col("verified"), heard)).alias("near")))
        share = spread.withColumn("score", F.col("s") / F.sum("s").over(Window.partitionBy("a")))
        share = share.join(seeds.select("a", "seed"), "a", "left").join(company, "a")
        stays = (F.col("score") >= PURITY) & (F.col("k") >= EDGES) & (F.col("near") >= REACHED * F.col("all")) | (F.col("seed") == F.col("subject")) & (F.col("score") >= PURITY / 2 + 0.15)
        fresh = share.where(stays).join(settled, "a", "left_anti")
        labels = cut(_one(trusted.unionByName(fresh.select("a", "subject", F.when(F.col("seed") == F.col("subject"), F.lit(1.0)).otherwise(F.col("score")).alias("score")))))
    pure = labels.where(F.col("score") >= PURITY)
    same = edges.where("verified").join(F.broadcast(pure.select("a", "subject")), "a").join(F.broadcast(pure.select(F.col("a").alias("b"), F.col("subject").alias("subject_b"))), "b").where("subject = subject_b")
    company = same.groupBy("a").agg((F.sum("n_ab") / F.max("n_a")).alias("company"))
    table = _one(pure).join(_one(company), "a", "left").select("a", "subject", "score", F.coalesce("company", F.lit(0.0)).alias("company"))
    return sorted(table.collect())  # no more than there are nodes


def _label_batches(table: np.ndarray, subject: np.ndarray, score: np.ndarray, company: np.ndarray, n_names: int, fixed: np.ndarray):
    """Different sentences (hash, words) to (hash, subject) of those that are about an area.

    `table` holds the labelled words in order; subject (one of `n_names` numbers), score and company belong to them.
    """

    places, fixed_places = _Places(table), _Places(fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sent, size = _flat(_unpacked(b.column(1), pa.int32()))
            if not len(flat) or not len(table):
                continue
            hit, w = places.find(flat)
            key = _distinct(sent[hit] * len(table) + w)
            ws, ss = key % len(table), key // len(table)
            at = ss * n_names + subject[ws]
            shape = (len(size), n_names)
            mass = np.bincount(at, score[ws], len(size) * n_names).reshape(shape)
            votes = np.bincount(at, minlength=len(size) * n_names).reshape(shape)
            near = np.bincount(at, company[ws], len(size) * n_names).reshape(shape)
            # ties go to the name that is last in order
            best = n_names - 1 - np.argmax(mass[:, ::-1], axis=1)
            i = np.arange(len(size))
            n = votes[i, best]
            told = (size >= 3) & (n > 0) & (mass[i, best] >= 0.6 * mass.sum(axis=1)) & (n >= np.where(near[i, best] / np.maximum(n, 1) >= 1.2, 2, 1))
            # fixed phrases name no subject
            pair, of = _neighbours(flat, sent)
            marks = np.bincount(of[fixed_places.find(pair)[0]], minlength=len(size))
            told &= marks < FIXED_SHARE * (size - 1)
            at = np.flatnonzero(told)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(best[at].astype(np.int32))], names=["hash", "subject"])

    return run


def subjects(df: DataFrame, examples: DataFrame, key: str = "seq", text: str = "text", tag: str = "assignedTag") -> DataFrame:
    """Rows (key, subject): one for each area that at least one whole sentence of the text is about.

    Null, empty and blank texts give no row, texts are read whole, a repeated row is judged under its own key, extra
    columns are dropped first. Empty tables give no rows; without examples nothing can be named.
    """
    few = df.select(F.col(key).alias("key"), text, F.col(tag).alias("tag"))
    kind = few.schema["key"].dataType.simpleString()
    with kept(few.mapInArrow(_split_batches, f"key {kind}, sents array<long>, hash long, tag long, words binary, uses long")) as split:
        posts = split.where("sents is not null")
        # a text taken several times counts once: what its other rows count is taken back
        copies = posts.groupBy("hash").agg(F.count("*").alias("n"), F.max("sents").alias("sents")).where("n > 1")
        back = cut(copies.select(F.explode("sents").alias("hash"), (1 - F.col("n")).alias("uses")).groupBy("hash").agg(F.sum("uses").alias("uses")))
        each = split.where("words is not null").select("hash", "tag", "words", "uses")
        all_uses = each.select("uses").unionByName(back.select("uses")).agg(F.sum("uses")).first()[0] or 0
        none = back.select("hash", F.lit(None).cast("long").alias("tag"), F.lit(None).cast("binary").alias("words"), "uses")
        ordered = each.unionByName(none).repartition("hash").sortWithinPartitions("hash", F.col("words").isNull())
        with kept(ordered.mapInArrow(partial(_once_packed, least=RETURNS * all_uses, often=OFTEN), "hash long, words binary, tags binary, uses long, kind byte, a long, sentences long")) as once:
            different = once.where("kind is null")
            rows, fixed = model(different, once.where("kind is not null").select("kind", "a", "uses", "sentences"), examples, RETURNS * all_uses)
            names = sorted({r["subject"] for r in rows})
            place = {s: k for k, s in enumerate(names)}
            labels = _label_batches(np.array([r["a"] for r in rows], np.int64), np.array([place[r["subject"]] for r in rows], np.int64), np.array([r["score"] for r in rows], float), np.array([r["company"] for r in rows], float), len(names), fixed)
            told = different.select("hash", "words").mapInArrow(labels, "hash long, place int")
            held = posts.select("key", F.explode("sents").alias("hash"))
            found = cut(held.join(told.hint("shuffle_hash"), "hash").select("key", "place").distinct())
            return found.select(F.col("key").alias(key), F.get(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("place")).alias("subject"))
