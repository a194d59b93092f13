"""Elias-Fano coding of monotone sequences, held in one buffer.

Each value is split into low bits, packed, and high bits, coded in unary in a bit
vector.  A directory holds the zeros before every 64 bits, so a value is found on
the coded form: the directory names the word of its bucket, a select within that
word the bucket's place, and the few low bits in the bucket are compared.  No
level is decoded for a search.  The buffer can be a file mapped into memory:
nothing is copied on opening it.
"""

from __future__ import annotations

import numpy as np

_CHUNK = 1 << 16
_ONE = np.uint64(1)
_PAIRS, _FOURS, _NIBBLES, _BYTES, _TOPS = (np.uint64(k) for k in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080))
#: By rank and byte: the place of the byte's one of that rank.
_IN_BYTE = np.array([([k for k in range(8) if byte >> k & 1] + [0] * 8)[rank] for rank in range(8) for byte in range(256)], np.int64)


class EliasFano:
    def __init__(self, buffer):
        self.buffer = buffer
        head = np.frombuffer(buffer, np.int64, 4)
        self.n, self.width, lows, highs = (int(x) for x in head)
        low = np.frombuffer(buffer, np.uint8, lows, 32)
        # eight bytes from every place on, as one number
        self.low = np.ndarray(lows - 7, "<u8", low, strides=(1,))
        self.high = np.frombuffer(buffer, np.uint8, highs, 32 + lows).view("<u8")
        self._before = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """values: non-decreasing, below 2^62."""
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = b"".join(cls._packed(v[k : k + _CHUNK], width) for k in range(0, n, _CHUNK)) if width else b""
        low += bytes(8 + -len(low) % 8)
        highs = (v >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(-(-(n + int(highs[-1] if n else 0) + 2) // 64) * 64, np.uint8)
        bits[highs + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").tobytes()
        return cls(np.array([n, width, len(low), len(high)], np.int64).tobytes() + low + high)

    @staticmethod
    def _packed(v: np.ndarray, width: int) -> bytes:
        bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & _ONE).astype(np.uint8)
        return np.packbits(bits.ravel(), bitorder="little").tobytes()

    def decode(self) -> np.ndarray:
        """All values; for tests and for reading a level whole."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        return (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width) | self._low_at(np.arange(self.n))

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        found = self.low[byte] >> shift
        if self.width > 57:  # the last bits are in a ninth byte
            more = self.low[np.minimum(byte + 8, len(self.low) - 1)]
            found |= np.where(shift > 0, more << (np.uint64(64) - np.maximum(shift, _ONE)), 0)
        return found & np.uint64((1 << self.width) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at places, by select on the ones."""
        out = np.zeros(len(i), np.uint64)
        for k in range(0, len(i), _CHUNK):
            part = np.asarray(i[k : k + _CHUNK], np.int64)
            out[k : k + _CHUNK] = (self._select(part, zeros=False) - part).astype(np.uint64) << np.uint64(self.width) | self._low_at(part)
        return out

    def _select(self, rank: np.ndarray, zeros: bool = True) -> np.ndarray:
        """The place of the zero (or one) of each rank, from 0, of the high bits."""
        if self._before is None:  # zeros before every word
            self._before = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(self.high).astype(np.int64))])
        before = self._before if zeros else np.arange(len(self._before)) * 64 - self._before
        word = np.searchsorted(before, rank, "right") - 1
        left = (rank - before[word]).astype(np.uint64)
        bits = ~self.high[word] if zeros else self.high[word]
        # ones of every byte and those before it, all eight at once; those bytes are passed that hold no more than are left
        ones = bits - (bits >> _ONE & _PAIRS)
        ones = (ones & _FOURS) + (ones >> np.uint64(2) & _FOURS)
        ones = (ones + (ones >> np.uint64(4)) & _NIBBLES) * _BYTES
        byte = np.bitwise_count((left * _BYTES | _TOPS) - ones & _TOPS).astype(np.uint64) << np.uint64(3)
        left -= ones << np.uint64(8) >> byte & np.uint64(255)
        return word * 64 + byte.astype(np.int64) + _IN_BYTE[(left << np.uint64(8) | bits >> byte & np.uint64(255)).astype(np.int64)]

    def find(self, values: np.ndarray) -> np.ndarray:
        """The index of each value, -1 where it is not in the sequence: successor search."""
        v = np.asarray(values, np.uint64)
        out = np.full(len(v), -1, np.int64)
        for k in range(0, len(v) if self.n else 0, _CHUNK):
            out[k : k + _CHUNK] = self._find(v[k : k + _CHUNK])
        return out

    def _find(self, v: np.ndarray) -> np.ndarray:
        h = (v >> np.uint64(self.width)).astype(np.int64)
        within = h < len(self.high) * 64 - self.n
        h = np.where(within, h, 0)
        # the bucket begins after the zero before it and ends at the next one
        place = np.where(h > 0, self._select(np.maximum(h - 1, 0)) + 1, 0)
        ahead = ~self.high[place >> 6] >> (place & 63).astype(np.uint64)
        lo = place - h
        end = lo + np.bitwise_count((ahead & (~ahead + _ONE)) - _ONE)
        beyond = np.flatnonzero(ahead == 0)  # the zero is in a later word
        end[beyond] = self._select(h[beyond]) - h[beyond]
        hi = end
        low = v & np.uint64((1 << self.width) - 1)
        open_ = np.flatnonzero(lo < hi)
        hi = hi.copy()
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low_at(mid) < low[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        hit = within & (lo < end)
        hit[hit] = self._low_at(lo[hit]) == low[hit]
        return np.where(hit, lo, -1)
