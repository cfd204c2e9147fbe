"""Operator 1. Language-model scores from an Elias-Fano n-gram trie.

Words, bigrams and trigrams of *all* documents are counted: map tasks send packed runs of sorted trigrams to ranges of
(first, second) word that are cut by the words' cumulative frequencies, so that no frequent word makes a range heavy. Witten-Bell smoothing
interpolates the orders: ``P(w|h) = a(w|h) + b(h) P(w|shorter h)`` with ``a = c / (c(h) + T(h))`` and ``b`` what the kept ``a`` of ``h``
leave over. The query keeps all of them (``ALL``). With a ``prune`` the words below it share one unknown word; bigrams and trigrams below it
are counted in ``c`` and ``T`` but get no node of their own, so their mass goes to ``b``.

The trie is three levels in memory-mapped files of the shared folder. Pointers from a node to its successors are a monotone Elias-Fano
sequence. The successors themselves are one strictly growing sequence per level: each range is lifted by the last value of the range
before it; the third level holds, instead of a word's number, its rank among the successors of the second word alone (context-relative), so its
values stay small. Each range of (first, second) word is a row; many tasks write their rows' parts of a level at their offsets, and
what is held at once is a range and some numbers a word of the vocabulary. A lookup is a successor search in the range of the context. ``a`` and ``b`` are quantised
to 8 bits, in steps of ``STEP`` in the logarithm.

A document is scored from its first word to the end mark. Defined results: null and wordless texts have 0 tokens, log-probability 0 and null
perplexity (they do not count an end mark); repeated rows count and score each; null ids pass; extra columns are ignored; an empty table has an empty result.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import narrowed, shared_dir, written
from cairn.llm.elias_fano import EliasFano
from cairn.llm.text import Words, pack, pieces, released, unpack

#: Least counts of a word, a bigram, a trigram with a node of its own: a smaller model, and the whole one.
PRUNE, ALL = (2, 2, 2), (1, 1, 1)
STEP = 0.1
FLUSH = 4 << 20
#: Bytes of text that are taken at once.
BYTES = 2 << 20
#: Words that are looked up at once: sorted, the lookups of more words are nearer to each other in the levels.
LOOKUPS = 1 << 19
#: Numbers of at most so many bits are sorted three in one.
NARROW = 21
#: Word numbers: unknown, end mark, nothing (after the end), then the vocabulary.
UNKNOWN, END, NONE, FIRST = 0, 1, 2, 3


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log(np.maximum(p, 1e-12)) / STEP), 0, 255).astype(np.uint8)


def _folder(spark: SparkSession) -> str:
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError("the trie is memory-mapped: spark.checkpoint.dir must be a mounted folder")
    path = f"{url.path}/cairn/trie-{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    return path


def _save(path: str, name: str, value: np.ndarray) -> None:
    """By way of another name, so that a task that runs again does not disturb a reader."""
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, value)
    os.replace(part, f"{path}/{name}.npy")


def _load(path: str, name: str) -> np.ndarray:
    return np.load(f"{path}/{name}.npy", mmap_mode="r")


def _put(path: str, name: str, at: int, value: np.ndarray) -> None:
    """Values into an array of the folder, from place ``at`` on; a task that runs again writes the same."""
    array = _load(path, name)
    with open(f"{path}/{name}.npy", "r+b") as f:
        f.seek(array.offset + at * array.itemsize)
        f.write(np.ascontiguousarray(value, array.dtype))


def _open(path: str, name: str, dtype: type, n: int) -> None:
    with open(f"{path}/{name}.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": np.dtype(dtype).str, "fortran_order": False, "shape": (n,)})
        f.truncate(f.tell() + n * np.dtype(dtype).itemsize)


def _open_sequence(path: str, name: str, n: int, last: int) -> None:
    """Room for a sequence of ``n`` values up to ``last``."""
    if not n:
        return _save_sequence(path, name, np.empty(0, np.int64))
    _save(path, f"{name}-head", np.array([n, EliasFano.low_bits(n, last + 1)], np.int64))
    for k, (dtype, size) in EliasFano.sizes(n, last).items():
        _open(path, f"{name}-{k}", dtype, size)


def _save_sequence(path: str, name: str, value: np.ndarray) -> None:
    for k, v in EliasFano.encode(value).items():
        _save(path, f"{name}-{k}", v)


def _put_sequence(path: str, name: str, start: int, value: np.ndarray) -> list[int]:
    """A part of a sequence; its edges."""
    inner, edges = EliasFano.part(value, start, int(_load(path, f"{name}-head")[1]))
    for k, (at, v) in inner.items():
        _put(path, f"{name}-{k}", at, v)
    return list(edges)


def _close_sequence(path: str, name: str, edges: list[list[int]]) -> None:
    for k, at, v in EliasFano.seams(edges, int(_load(path, f"{name}-head")[0]), len(_load(path, f"{name}-high"))) if edges else ():
        _put(path, f"{name}-{k}", at, v)


def _sequence_of(path: str, name: str) -> EliasFano:
    return EliasFano.decode({k: _load(path, f"{name}-{k}") for k in ("head", "low", "high", "ones", "zeros")})


@released
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    docs = 0

    def flush() -> pa.RecordBatch:
        h, inv = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.bincount(inv, np.concatenate([x for _, x in held]), len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.append(h.view(np.int64), 0)), pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(h), np.int64), docs))], ["word", "n", "ends"])

    for batch in batches:
        for (texts,) in pieces(batch, 0, BYTES):
            w = Words(texts)
            docs += int(np.count_nonzero(np.diff(w.first)))
            held.append(np.unique(w.hash, return_counts=True))
            if sum(len(x) for x, _ in held) > FLUSH:
                yield flush()
                held, docs = [], 0
    if held:
        yield flush()


def _write_vocabulary(path: str, least: int):
    """One task: the sorted words with their cumulative counts, from rows in order."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, single, ends = [], [], 0, 0
        for batch in batches:
            w, n, e = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keep = n >= least
            words.append(w[keep].view(np.uint64))
            counts.append(n[keep])
            single += int(n[~keep].sum())
            ends += int(e.sum())
        word = np.concatenate(words) if words else np.empty(0, np.uint64)
        count = np.concatenate(counts) if counts else np.empty(0, np.int64)
        order = np.argsort(word)
        count = np.concatenate([[single, ends, 0], count[order]]).astype(np.int64)
        _save(path, "words", word[order])
        _save(path, "counts", count)
        _save(path, "before", np.concatenate([[0], np.cumsum(count)]))
        yield pa.RecordBatch.from_arrays([pa.array([len(word)], pa.int64())], ["n"])

    return run


def _distinct(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the distinct hashes, and of each hash its place among them."""
    unique, inverse = np.unique(hashes, return_inverse=True)
    if not len(words) or not len(hashes):
        return np.zeros(len(unique), np.int64), inverse
    at = np.minimum(np.searchsorted(words, unique), len(words) - 1)
    return np.where(words[at] == unique, at + FIRST, UNKNOWN), inverse


def _spread(w: Words, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's values of words with ``end`` after each document that has words; document of each; words by document."""
    n = np.diff(w.first)
    full = np.flatnonzero(n > 0)
    seq = np.full(len(w.hash) + len(full), end, np.int64)
    doc = np.repeat(np.arange(len(n)), n + (n > 0))
    last = np.cumsum(n[full] + 1) - 1
    inner = np.ones(len(seq), bool)
    inner[last] = False
    seq[inner] = values
    return seq, doc, n


def _sequence(texts: list[str | None], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's word numbers with an end mark after each document that has words; document of each; words by document."""
    w = Words(texts)
    numbers, inverse = _distinct(w.hash, words)
    return _spread(w, numbers[inverse], END)


def _next(seq: np.ndarray, doc: np.ndarray, by: int, none: int = NONE) -> np.ndarray:
    out = np.full(len(seq), none, seq.dtype)
    if len(seq) > by:
        same = doc[:-by] == doc[by:]
        out[:-by][same] = seq[by:][same]
    return out


def _order(pair: np.ndarray, third: np.ndarray) -> np.ndarray:
    """An order by pair and third, of numbers below 2**32, by two sorts of single numbers, which are several times as fast as one of two columns."""
    first = np.argsort(pair)
    p = pair[first]
    group = np.cumsum(np.concatenate([[False], p[1:] != p[:-1]])[: len(p)]).astype(np.uint64)
    return first[np.argsort((group << np.uint64(32)) | third[first].astype(np.uint64))]


def _emit(path: str, buckets: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before = _load(path, "words"), _load(path, "before")
        total = max(int(before[-1]), 1)
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            # what is held has few of the vocabulary's words, so numbers among them, in the same order, are short
            among = np.unique(np.concatenate([numbers for numbers, *_ in held]))
            bits = np.uint64(len(among).bit_length())
            n = sum(len(x[1]) for x in held)
            places = [np.searchsorted(among, numbers).astype(np.uint64) for numbers, *_ in held]
            if int(bits) <= NARROW:  # the three numbers fit in one, which sorts faster
                key, ones, done = np.empty(n, np.uint64), (np.uint64(1) << bits) - np.uint64(1), 0
                for place, (_, *three) in zip(places, held, strict=True):
                    first, second, third = (place[x] for x in three)
                    key[done : done + len(first)] = (((first << bits) | second) << bits) | third
                    done += len(first)
                held.clear()
                key.sort()
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                key = key[start]
                third = among[key & ones]
                pair = (among[key >> (bits + bits)].astype(np.uint64) << np.uint64(32)) | among[key >> bits & ones].astype(np.uint64)
            else:
                first, second, third = (np.concatenate([numbers[x[i]] for numbers, *x in held]) for i in range(3))
                held.clear()
                pair = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
                order = _order(pair, third)
                pair, third = pair[order], third[order]
                start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
                pair, third = pair[start], third[start]
            count = np.diff(np.append(start, n))
            a, b = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            # the place of the pair among all bigrams if words were independent: grows with (a, b)
            place = before[a] + (before[a + 1] - before[a]) * (before[b] / total)
            bucket = np.maximum.accumulate(np.minimum((place * (buckets / total)).astype(np.int64), buckets - 1))
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [(i, pack(pair[lo:hi]), pack(third[lo:hi].astype(np.uint64)), pack(count[lo:hi].astype(np.uint64))) for i, lo, hi in zip(range(buckets), cut, cut[1:], strict=False) if lo < hi]
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "pair", "third", "n"])

        for batch in batches:
            for (texts,) in pieces(batch, 0, BYTES):
                w = Words(texts)
                numbers, inverse = _distinct(w.hash, words)
                seq, doc, _ = _spread(w, inverse, len(numbers))
                if len(seq):
                    seq = seq.astype(np.int32)
                    held.append((np.append(numbers, [END, NONE]), seq, *(_next(seq, doc, by, len(numbers) + 1) for by in (1, 2))))
                if sum(len(x[1]) for x in held) > FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return run


_SHARD = "bucket long, pairs long, triples long, seen binary, types binary, nodes binary, mass binary, last binary, second binary, n binary, kinds binary, thirds binary, third binary, third_n binary"


def _shard(prune: tuple[int, int, int]):
    """Of a range: the successors of each first word, the kept bigrams, and the kept trigrams below them."""

    @released
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pair, third, n = (np.concatenate([unpack(x) for x in rows.column(c).to_pylist()]) for c in ("pair", "third", "n"))
        order = _order(pair, third)
        pair, third, n = pair[order], third[order], n[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
        n, pair, third = np.add.reduceat(n, start), pair[start], third[start].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pair))))
        pairs, total = pair[start], np.add.reduceat(n, start)
        kinds = np.bincount(of, third != NONE, len(start)).astype(np.int64)
        first, second = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        real = second != NONE
        seen, which, types = np.unique(first[real], return_inverse=True, return_counts=True)
        keep = real & (total >= prune[1])
        which = which[keep[real]]
        # of each first word: kept bigrams, their count, the number after the last successor
        nodes = np.bincount(which, minlength=len(seen))
        mass = np.bincount(which, total[keep], len(seen))
        last = np.zeros(len(seen), np.int64)
        last[which] = second[keep] + 1
        node = (third != NONE) & (n >= prune[2]) & keep[of]
        thirds = np.bincount(of[node], minlength=len(start))[keep]
        out = (seen, types, nodes, mass, last, second[keep], total[keep], kinds[keep], thirds, third[node], n[node])
        sizes = {"bucket": key[0].as_py(), "pairs": len(thirds), "triples": int(thirds.sum())}
        return pa.table({k: pa.array([v], pa.int64()) for k, v in sizes.items()} | {k.split()[0]: pa.array([pack(x.astype(np.uint64))], pa.binary()) for k, x in zip(_SHARD.split(", ")[3:], out, strict=True)})

    return run


def _write_contexts(path: str):
    """One task: what is known of each word as a context, where each range begins, and room for the second level."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _load(path, "counts")
        size = len(count)
        types, nodes, mass, last = (np.zeros(size, np.int64) for _ in range(4))
        ranges = []
        for batch in batches:
            for bucket, pairs, triples, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ranges.append((bucket, pairs, triples))
                seen, *of = (unpack(x).astype(np.int64) for x in packed)
                for whole, x in zip((types, nodes, mass), of, strict=False):
                    whole[seen] += x
                last[seen] = np.maximum(last[seen], of[3])
        ranges = np.array(sorted(ranges), np.int64).reshape(-1, 3)
        start = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(ranges[:, 1:], axis=0)])
        _save(path, "ranges", np.column_stack([ranges[:, 0], start[:-1]]))
        _save(path, "types", types)
        _save(path, "lift", np.concatenate([[0], np.cumsum(last)]))
        known = int(np.count_nonzero(count))
        floor = known / ((count.sum() + known) * max(size - 1, 1)) if known else 0
        one = count / max(count.sum() + known, 1) + floor
        one[NONE] = 0
        _save(path, "one", np.log(np.maximum(one, 1e-300)).astype(np.float32))
        # the end mark has no successors, so a word's count is that of its occurrences as context
        _save(path, "b1", quantised(np.where(count > 0, 1 - mass / np.maximum(count + types, 1), 1.0)))
        pairs, triples = (int(x) for x in start[-1])
        _save_sequence(path, "ptr1", np.concatenate([[0], np.cumsum(nodes)]))
        _open_sequence(path, "seq2", pairs, int(last.sum()))
        _open_sequence(path, "ptr2", pairs + 1, triples) if pairs else _save_sequence(path, "ptr2", np.zeros(1, np.int64))
        for name, n in (("a2", pairs), ("b2", pairs), ("a3", triples)):
            _open(path, name, np.uint8, n)
        yield pa.RecordBatch.from_arrays([pa.array([pairs], pa.int64())], ["n"])

    return run


_EDGES = "seq array<long>, ptr array<long>"


def _starts(path: str) -> dict[int, tuple[int, int]]:
    """Of each range: the places of its first bigram and trigram."""
    return {b: (i, j) for b, i, j in _load(path, "ranges").tolist()}


def _write_second(path: str):
    """The ranges' parts of the second level and the weights of the third; the edges of the parts."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, types, lift, starts = _load(path, "counts"), _load(path, "types"), _load(path, "lift"), _starts(path)
        for batch in batches:
            for bucket, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen, nodes, second, n, kinds, thirds, third_n = (unpack(x).astype(np.int64) for x in packed)
                if not len(second):
                    continue
                at2, at3 = starts[bucket]
                first = np.repeat(seen, nodes)
                of = np.repeat(np.arange(len(second)), thirds)
                a3 = third_n / (n[of] + kinds[of])
                _put(path, "a2", at2, quantised(n / np.maximum(count[first] + types[first], 1)))
                _put(path, "b2", at2, quantised(1 - np.bincount(of, a3, len(second))))
                _put(path, "a3", at3, quantised(a3))
                ends = at3 + np.cumsum(thirds)
                seq = _put_sequence(path, "seq2", at2, lift[first] + second + 1)
                ptr = _put_sequence(path, "ptr2", at2 + 1, ends) if at2 else _put_sequence(path, "ptr2", 0, np.concatenate([[0], ends]))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int64())) for x in (seq, ptr)], ["seq", "ptr"])

    return run


_RANKS = "bucket long, last long, thirds binary, rank binary"


def _ranks(path: str):
    """Context-relative: the ranks of the third words among the successors of the second."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ptr1, seq2 = _sequence_of(path, "ptr1"), _sequence_of(path, "seq2")
        for batch in batches:
            for bucket, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                second, thirds, third = (unpack(x).astype(np.int64) for x in packed)
                if not len(third):
                    continue
                key, inverse = np.unique((np.repeat(second, thirds) << 32) | third, return_inverse=True)
                middle, which = np.unique(key >> 32, return_inverse=True)
                start = ptr1.access(middle)
                rank = (_find(seq2, start, ptr1.access(middle + 1), which, key & 0xFFFFFFFF) - start[which])[inverse]
                some = np.cumsum(thirds)[thirds > 0] - 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((bucket, pa.int64()), (int((rank[some] + 1).sum()), pa.int64()), (pack(thirds.astype(np.uint64)), pa.binary()), (pack(rank.astype(np.uint64)), pa.binary()))], [k.split()[0] for k in _RANKS.split(", ")])

    return run


def _write_third(path: str, lift: dict[int, int]):
    """The ranges' parts of the third level; the edges of the parts."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = _starts(path)
        for batch in batches:
            for bucket, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                thirds, rank = (unpack(x).astype(np.int64) for x in packed)
                seq = _put_sequence(path, "seq3", starts[bucket][1], lift[bucket] + _lifted(rank, np.concatenate([[0], np.cumsum(thirds)])))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int64())) for x in (seq, [])], ["seq", "ptr"])

    return run


def _lifted(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Values that grow within each range ``ptr[i]:ptr[i+1]`` made to grow throughout: plus one, plus the last of the range before."""
    if not len(values):
        return values.astype(np.int64)
    ends = np.unique(ptr[ptr > 0]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    base = np.concatenate([[0], np.cumsum(values[ends] + 1, dtype=np.int64)[:-1]]) + 1
    out = np.repeat(base, np.diff(np.append(begins, len(values))))
    out += values
    return out


def _find(seq: EliasFano, start: np.ndarray, end: np.ndarray, of: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The place of each ``value`` in the ``of``-th range ``start:end``, or -1."""
    out = np.full(len(value), -1, np.int64)
    if not seq.n or not len(value):
        return out
    base = np.where(start > 0, seq.access(np.maximum(start - 1, 0)), 0)
    some = np.flatnonzero((start < end)[of])
    want, s, e = base[of[some]] + value[some] + 1, start[of[some]], end[of[some]]
    at, same = seq.find(want, e)
    hit = np.flatnonzero(same & (at >= s))
    out[some[hit]] = at[hit]
    return out


class Trie:
    """The levels as maps of files, and their lookups."""

    def __init__(self, path: str):
        self.words, self.one = _load(path, "words"), _load(path, "one")
        self.a2, self.b1, self.a3, self.b2 = (_load(path, x) for x in ("a2", "b1", "a3", "b2"))
        self.ptr1, self.seq2, self.ptr2, self.seq3 = (_sequence_of(path, x) for x in ("ptr1", "seq2", "ptr2", "seq3"))

    def log_probabilities(self, seq: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Natural log-probability of every element of a batch's sequence, given up to two before it in its document."""
        n = len(seq)
        if not n:
            return np.empty(0)
        same1 = np.concatenate([[False], doc[1:] == doc[:-1]])
        same2 = same1 & np.concatenate([[False], same1[:-1]])
        p = np.exp(self.one[seq].astype(np.float64))
        # bigrams, each distinct one looked up once
        at2, start = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        i = np.flatnonzero(same1)
        key, inverse = np.unique((seq[i - 1] << 32) | seq[i], return_inverse=True)
        ctx, which = np.unique(key >> 32, return_inverse=True)
        lo = self.ptr1.access(ctx)
        at2[i], start[i] = _find(self.seq2, lo, self.ptr1.access(ctx + 1), which, key & 0xFFFFFFFF)[inverse], lo[which][inverse]
        scale = np.exp(-STEP * np.arange(256))
        p[i] *= scale[self.b1[seq[i - 1]]]
        hit = i[at2[i] >= 0]
        p[hit] += scale[self.a2[at2[hit]]]
        # trigrams: only where the context has a node
        i = np.flatnonzero(same2)
        i = i[at2[i - 1] >= 0]
        p[i] *= scale[self.b2[at2[i - 1]]]
        i = i[at2[i] >= 0]
        if len(i):
            key, inverse = np.unique((at2[i - 1] << 32) | (at2[i] - start[i]), return_inverse=True)
            ctx, which = np.unique(key >> 32, return_inverse=True)
            at3 = _find(self.seq3, self.ptr2.access(ctx), self.ptr2.access(ctx + 1), which, key & 0xFFFFFFFF)[inverse]
            p[i[at3 >= 0]] += scale[self.a3[at3[at3 >= 0]]]
        return np.log(np.maximum(p, 1e-300))


def build(docs: DataFrame, prune: tuple[int, int, int] = PRUNE) -> str:
    """Counts all of ``docs`` and writes the trie of what is seen ``prune`` times; its folder."""
    spark = docs.sparkSession
    path, texts = _folder(spark), narrowed(docs, "text")
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = written(texts.mapInArrow(_word_counts, "word long, n long, ends long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).where("n > 0 or ends > 0"), "words")
    words.coalesce(1).mapInArrow(_write_vocabulary(path, prune[0]), "n long").collect()
    shards = texts.mapInArrow(_emit(path, buckets), "bucket long, pair binary, third binary, n binary").groupBy("bucket").applyInArrow(_shard(prune), _SHARD)
    shards = written(shards, "shards")
    shards.select("bucket", "pairs", "triples", "seen", "types", "nodes", "mass", "last").coalesce(1).mapInArrow(_write_contexts(path), "n long").collect()
    edges = shards.select("bucket", "seen", "nodes", "second", "n", "kinds", "thirds", "third_n").mapInArrow(_write_second(path), _EDGES).collect()
    _close_sequence(path, "seq2", [r.seq for r in edges])
    _close_sequence(path, "ptr2", [r.ptr for r in edges])
    ranks = written(shards.select("bucket", "second", "thirds", "third").mapInArrow(_ranks(path), _RANKS), "ranks")
    ends = sorted((r.bucket, r.last) for r in ranks.select("bucket", "last").collect())
    sums = np.cumsum([0, *(n for _, n in ends)]).tolist()
    _open_sequence(path, "seq3", len(_load(path, "a3")), sums[-1])
    edges = ranks.select("bucket", "thirds", "rank").mapInArrow(_write_third(path, {b: x for (b, _), x in zip(ends, sums, strict=False)}), _EDGES).collect()
    _close_sequence(path, "seq3", [r.seq for r in edges])
    return path


def score(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, log_probability, perplexity, unknown`` of every row under the trie in ``path``."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(path)
        held: list[tuple[list, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, seqs, docs, ns = zip(*held, strict=True)
            held.clear()
            first = np.cumsum([0, *(len(n) for n in ns)])
            seq, doc, n = np.concatenate(seqs), np.concatenate([d + f for d, f in zip(docs, first, strict=False)]), np.concatenate(ns)
            total = np.bincount(doc, trie.log_probabilities(seq, doc), len(n))
            unknown = np.bincount(doc, seq == UNKNOWN, len(n)).astype(np.int64)
            per = np.exp(-total / np.maximum(n + 1, 1))
            return pa.RecordBatch.from_arrays([pa.array([i for x in ids for i in x], pa.int64()), pa.array(n.astype(np.int64)), pa.array(np.round(total, 6), pa.float64()), pa.array(np.round(per, 6), pa.float64(), mask=n == 0), pa.array(unknown)], ["doc_id", "n_tokens", "log_probability", "perplexity", "unknown"])

        for batch in batches:
            for ids, texts in pieces(batch, 1, BYTES):
                held.append((ids, *_sequence(texts, trie.words)))
                if sum(len(seq) for _, seq, *_ in held) > LOOKUPS:
                    yield flush()
        if held:
            yield flush()

    return narrowed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, log_probability double, perplexity double, unknown long")


def score_documents(docs: DataFrame, prune: tuple[int, int, int] = PRUNE) -> DataFrame:
    """The query's result, there with ``ALL``: every document under the trie of all documents."""
    return score(docs, build(docs, prune))
