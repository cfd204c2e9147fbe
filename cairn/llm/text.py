"""Vectorised tokens: words of whole batches of texts as 64-bit hashes with their places.

A word is a maximal run of ASCII letters, digits, ``_`` and characters beyond ASCII, in lower case
(character by character, so that places in the text do not move). Everything is done on the UTF-8 bytes
of a batch at once: prefix sums of a polynomial modulo 2**64 give each word's hash without a Python loop.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

from cairn.functions.batches import pieces as pieces
from cairn.functions.batches import trimmed

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True

#: The same words for SQL engines, over lower-cased text.
WORD_PATTERN = r"[0-9a-z_\x{80}-\x{10FFFF}]+"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept for the next batch."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        run = np.full(max(n, 1 << 16), base, np.uint64)
        run[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(run)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that low and high bits are both usable."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def fold(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low


def ranges_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``values[start:end]`` of a sequence of small or hashed integers."""
    n = len(values) + 1
    prefix = np.zeros(n, np.uint64)
    run = prefix[1:]
    np.add(values, np.uint64(1), out=run, casting="unsafe")
    run *= powers(_BASE, n)[1:]
    np.cumsum(run, out=run)
    h = (prefix[end] - prefix[start]) * powers(_INVERSE, n)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of a batch: ``hash``; ``start``, ``end`` (bytes of the folded batch); ``first[d]:first[d+1]`` are document d's."""

    def __init__(self, texts: list[str | None]):
        parts = [fold(t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = b"\n".join([*parts, b""]) or b"\n"
        self.bytes = np.frombuffer(data, np.uint8)
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.begin = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        word = np.zeros(len(self.bytes) + 2, bool)
        word[1:-1] = _IS_WORD[self.bytes]
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = ranges_hash(self.bytes, self.start, self.end)
        self.first = np.searchsorted(self.start, self.begin)

    def document(self) -> np.ndarray:
        """The index of each word's document."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def plain(self) -> memoryview:
        """The words of all documents with a space after each; ``plain_start`` is each word's place there."""
        size = self.end - self.start + 1
        keep = np.zeros(len(self.bytes) + 1, bool)
        keep[:-1] = _IS_WORD[self.bytes]
        keep[self.end] = True
        data = np.append(self.bytes, np.uint8(32))
        data[self.end] = 32
        self.plain_start = np.cumsum(size) - size
        return memoryview(data[keep])

    def characters(self, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Byte places ``at`` of the batch as characters from the start of documents ``of``."""
        head = np.concatenate([[0], np.cumsum((self.bytes & 0xC0) != 0x80)])
        return head[at] - head[self.begin[of]]


def release() -> None:
    """Gives a worker's free memory back: workers outlive their tasks, and idle ones would keep the most that they ever held."""
    _powers.clear()
    trimmed()


def released(run: Callable) -> Callable:
    """A function of batches, or of a group, that releases memory at its end."""

    @functools.wraps(run)
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    @functools.wraps(run)
    def of(key: tuple, rows: pa.Table) -> pa.Table:
        try:
            return run(key, rows)
        finally:
            release()

    return of if run.__code__.co_argcount == 2 else over


_squeeze, _expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, best sorted: their differences, byte plane by byte plane, compressed."""
    d = values.astype(np.uint64)
    d[1:] = d[1:] - values[:-1]
    return _squeeze.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
