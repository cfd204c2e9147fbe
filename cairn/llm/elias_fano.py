"""Elias-Fano sequences as flat arrays that can be memory-mapped, with vectorised access and successor search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th one in a byte.
_BYTE_SELECT = np.array([[([j for j in range(8) if i >> j & 1] + [8] * 8)[k] for k in range(8)] for i in range(256)], np.uint8)


_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_PAIRS, _QUADS, _NIBBLES = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
_U = [np.uint64(i) for i in range(57)]


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the ``k``-th one (from 0) of each 64-bit word: sums of ones up to each byte, side by side in a word."""
    s = words - ((words >> _U[1]) & _PAIRS)
    s = (s & _QUADS) + ((s >> _U[2]) & _QUADS)
    s = ((s + (s >> _U[4])) & _NIBBLES) * _ONES
    k = k.astype(np.uint64)
    at = (((((k * _ONES) | _TOPS) - s) & _TOPS) >> _U[7]) * _ONES >> _U[56] << _U[3]
    before = ((s << _U[8]) >> at) & np.uint64(0xFF)
    return (at + _BYTE_SELECT[((words >> at) & np.uint64(0xFF)).astype(np.int64), (k - before).astype(np.int64)]).astype(np.int64)


_BLOCK = 1 << 20


class EliasFano:
    """A non-decreasing sequence: low bits packed side by side, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.l = n, low_bits
        self.high, self.ones, self.zeros = (np.asarray(x) for x in (high, ones, zeros))
        #: A 64-bit view from every byte.
        self.low = np.ndarray((max(len(low) - 7, 1),), "<u8", low, 0, (1,))
        self.mask = np.uint64((1 << low_bits) - 1)

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        """The arrays of a sequence: ``head`` (length, low bits), ``low``, ``high``, ``ones`` and ``zeros`` (ones and zeros before each word)."""
        v = values.view(np.uint64) if values.dtype == np.int64 else values.astype(np.uint64)
        n, top = len(v), int(v[-1]) + 1 if len(v) else 1
        l = EliasFano.low_bits(n, top)
        low = np.zeros((n * l + 7) // 8 + 8, np.uint8)
        raw = np.zeros(((int(v[-1] >> np.uint64(l)) + n if n else 0) // 64 + 1) * 64, np.uint8)
        for i in range(0, n, _BLOCK):  # whole bytes of low bits at a time
            part = v[i : i + _BLOCK]
            raw[(part >> np.uint64(l)).astype(np.int64) + np.arange(i, i + len(part))] = 1
            if l:
                bits = np.empty((len(part), l), np.uint8)
                for j in range(l):
                    bits[:, j] = (part >> np.uint64(j)).astype(np.uint8) & 1
                packed = np.packbits(bits.ravel(), bitorder="little")
                low[i * l // 8 : i * l // 8 + len(packed)] = packed
        high = np.packbits(raw, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return {"head": np.array([n, l], np.int64), "low": low, "high": high, "ones": ones, "zeros": np.arange(len(ones)) * 64 - ones}

    @staticmethod
    def low_bits(n: int, top: int) -> int:
        """Low bits of ``n`` values below ``top``."""
        return max(0, (top // max(n, 1)).bit_length() - 1)

    @staticmethod
    def sizes(n: int, last: int) -> dict[str, tuple[type, int]]:
        """Types and lengths of the arrays of ``n`` values up to ``last``, to be filled by ``part``."""
        l = EliasFano.low_bits(n, last + 1)
        words = ((last >> l) + n) // 64 + 1
        return {"low": (np.uint8, (n * l + 7) // 8 + 8), "high": (np.uint64, words), "ones": (np.int64, words + 1), "zeros": (np.int64, words + 1)}

    @staticmethod
    def part(v: np.ndarray, start: int, l: int) -> tuple[dict[str, tuple[int, np.ndarray]], tuple[int, ...]]:
        """What the values from place ``start`` on put into the arrays of the whole sequence, as (place, array); and, since
        its first and last word and byte may have others' bits too: start, first and last word, their bits, first and last byte, their bits."""
        place = (v >> l) + np.arange(start, start + len(v))
        w0, w1 = int(place[0]) >> 6, int(place[-1]) >> 6
        raw = np.zeros((w1 - w0 + 1) * 64, np.uint8)
        raw[place - w0 * 64] = 1
        high = np.packbits(raw, bitorder="little").view(np.uint64)
        word = np.arange(w0 + 1, w1 + 1)
        ones = start + np.searchsorted(place, word * 64)
        b0, bits = start * l // 8, np.zeros(start * l % 8 + len(v) * l, np.uint8)
        for j in range(l):
            bits[start * l % 8 + j :: l] = (v >> j) & 1
        low = np.packbits(bits, bitorder="little") if l else np.zeros(1, np.uint8)
        inner = {"high": (w0 + 1, high[1:-1]), "low": (b0 + 1, low[1:-1]), "ones": (w0 + 1, ones), "zeros": (w0 + 1, word * 64 - ones)}
        return inner, (start, w0, w1, *(int(x) for x in high[[0, -1]].view(np.int64)), b0, b0 + len(low) - 1, int(low[0]), int(low[-1]))

    @staticmethod
    def seams(edges: list[tuple[int, ...]], n: int, words: int) -> Iterator[tuple[str, int, np.ndarray]]:
        """What is between the parts, from their edges, as (array, place, values)."""
        high, low, done = {}, {}, 0
        for start, w0, w1, h0, h1, b0, b1, c0, c1 in [*sorted(edges), (n, words, words, 0, 0, 0, 0, 0, 0)]:
            between = np.arange(done, w0 + 1)
            yield "ones", done, np.full(len(between), start)
            yield "zeros", done, between * 64 - start
            done = w1 + 1
            for at, bits in ((w0, h0), (w1, h1)):
                high[at] = high.get(at, 0) | (bits & (1 << 64) - 1)
            for at, bits in ((b0, c0), (b1, c1)):
                low[at] = low.get(at, 0) | bits
        del high[words]
        for at, bits in high.items():
            yield "high", at, np.array([bits], np.uint64)
        for at, bits in low.items():
            yield "low", at, np.array([bits], np.uint8)

    @staticmethod
    def decode(arrays: dict[str, np.ndarray]) -> EliasFano:
        n, l = (int(x) for x in arrays["head"])
        return EliasFano(n, l, arrays["low"], arrays["high"], arrays["ones"], arrays["zeros"])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.int64)
        bit = i * self.l
        return ((self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((place - i) << self.l) | self._lows(i)

    def _before_bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values have high bits below ``h``: the place of the ``h``-th zero less ``h``; and how many below ``h + 1``."""
        k = h - 1
        word = np.minimum(np.searchsorted(self.zeros, np.maximum(k, 0), "right") - 1, len(self.high) - 1)
        inside = np.maximum(k, 0) - self.zeros[word]
        free = ~self.high[word]
        ok = (inside < np.bitwise_count(free)) & (k >= 0)
        bit = np.zeros(len(h), np.int64)
        bit[ok] = _select_in_word(free[ok], inside[ok])
        below = np.where(k < 0, 0, np.where(ok, word * 64 + bit - k, self.n))
        # the bucket's values are the ones after that zero, up to the next zero; in the same word, or else looked up
        rest = free & ~((_U[2] << bit.astype(np.uint64)) - _U[1])
        least = rest & (~rest + _U[1])
        near = ok & (rest != 0)
        upto = np.where(near, below + np.bitwise_count(least - _U[1]).astype(np.int64) - bit - 1, 0)
        far = np.flatnonzero(~near)
        if len(far):
            word = np.minimum(np.searchsorted(self.zeros, h[far], "right") - 1, len(self.high) - 1)
            inside = h[far] - self.zeros[word]
            free = ~self.high[word]
            ok = inside < np.bitwise_count(free)
            upto[far] = self.n
            upto[far[ok]] = word[ok] * 64 + _select_in_word(free[ok], inside[ok]) - h[far[ok]]
        return below, upto

    def find(self, value: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``successor``, and whether the element there, before ``end``, is the value itself."""
        at, upto = self._successor(value, end)
        is_it = np.flatnonzero(at < upto)
        out = np.zeros(len(value), bool)
        out[is_it] = self._lows(at[is_it]) == value[is_it] & int(self.mask)
        return at, out

    def successor(self, value: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each value the place of the first element not below it, at most ``end``."""
        return self._successor(value, end)[0]

    def _successor(self, value: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, low = value >> self.l, value & int(self.mask)
        a, b = self._before_bucket(h)
        b = np.minimum(b, end)
        a = np.minimum(a, b)
        left, right = a.copy(), b.copy()
        live = np.flatnonzero(left < right)
        while len(live):
            mid = (left[live] + right[live]) >> 1
            less = self._lows(mid) < low[live]
            left[live[less]] = mid[less] + 1
            right[live[~less]] = mid[~less]
            live = live[left[live] < right[live]]
        return left, b
