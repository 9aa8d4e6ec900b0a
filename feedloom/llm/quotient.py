"""Counting quotient filters that lose nothing: keys of up to 126 bits with a counter each.

A key is a pair of numbers, `high` and `low` bits wide. `permute` maps keys one
to one onto keys that look random. Of a permuted key the first bits name a
segment, the next ones are the quotient, and all others are kept as remainder,
so that equal slots mean equal keys. A filter holds the keys of one segment in
order: a bit for every quotient that occurs, a bit for every slot that ends the
run of its quotient, the remainders, and a counter of one byte (larger counters
stand aside). Filters of the same segment from different shards are sorted
runs; merging adds the counters of equal remainders.

`Shape` fixes the widths. Everything works on arrays, in memory that follows
the keys given; callers choose the number of segments so that one is small.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from collections.abc import Iterator

import numpy as np

HEAD = "<IBI"
U = np.uint64
#: Odd numbers that the rounds of the permutation begin with.
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def mask(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


def mixed(x: np.ndarray, start: int) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = x ^ U(start)
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@dataclass(frozen=True)
class Shape:
    """Widths of a key's two numbers (at most 63 or, if both are 32, 64 bits in all) and of the segment's number."""

    high: int
    low: int
    segments: int

    @classmethod
    def of(cls, bits: int, keys: int, most: int) -> Shape:
        """For keys of `bits` bits, with so many segments that each has about `most` of `keys` keys, repeats counted."""
        if bits > 126:
            raise ValueError("keys have 126 bits at most")
        high = bits - bits // 2
        return cls(high, bits // 2, min(high, max(0, (keys // most).bit_length())))

    @property
    def rest(self) -> int:
        """Bits of the first number behind the segment."""
        return self.high - self.segments

    def permute(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k, start in enumerate(ROUNDS):
            if k % 2:
                lo = lo ^ (mixed(hi, start) & mask(self.low))
            else:
                hi = hi ^ (mixed(lo, start) & mask(self.high))
        return hi, lo

    def invert(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k, start in reversed(list(enumerate(ROUNDS))):
            if k % 2:
                lo = lo ^ (mixed(hi, start) & mask(self.low))
            else:
                hi = hi ^ (mixed(lo, start) & mask(self.high))
        return hi, lo

    def sort(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different keys in order, with the sum of their counters (each counts once if there are none)."""
        if not len(hi):
            return hi, lo, np.zeros(0, np.int64)
        if self.high + self.low <= 64:
            keys = hi << U(self.low) | lo
            if n is None:
                keys.sort()
            else:
                order = np.argsort(keys, kind="stable")  # merges runs that are in order
                keys, n = keys[order], n[order]
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            hi, lo = keys[begins] >> U(self.low), keys[begins] & mask(self.low)
            total = len(keys)
        else:
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            n = None if n is None else n[order]
            begins = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
            total = len(hi)
            hi, lo = hi[begins], lo[begins]
        return hi, lo, np.diff(np.append(begins, total)) if n is None else np.add.reduceat(n, begins)

    def filters(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
        """(segment, filter) of permuted keys in any order, repeats allowed."""
        hi, lo, n = self.sort(hi, lo, n)
        segment = hi >> U(self.rest)
        begins = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(hi) else np.zeros(0, int)
        for a, b in zip(begins, np.append(begins[1:], len(hi))):
            yield int(segment[a]), self.write(hi[a:b] & mask(self.rest), lo[a:b], n[a:b])

    def write(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
        """The filter of different keys of one segment, in order."""
        m = len(hi)
        q = min(self.rest, m.bit_length() - 1)
        tail = self.rest - q
        quotient = hi >> U(tail)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient.astype(np.int64)] = True
        ends = np.append(quotient[1:] != quotient[:-1], True)
        large = n > 255
        return b"".join([struct.pack(HEAD, m, q, int(large.sum())), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
                         narrow(hi & mask(tail), tail), narrow(lo, self.low),
                         np.where(large, 0, n).astype(np.uint8).tobytes(), n[large].astype("<i8").tobytes()])

    def read(self, segment: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of a filter in order, and their counters."""
        m, q, aside = struct.unpack_from(HEAD, data)
        tail, at = self.rest - q, struct.calcsize(HEAD)

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        occupied = np.flatnonzero(np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q))
        ends = np.unpackbits(take((m + 7) // 8), count=m)
        run = np.cumsum(ends) - ends
        hi = occupied[run].astype(U) << U(tail) | wide(take(m * width(tail)), m, width(tail)) | U(segment) << U(self.rest)
        lo = wide(take(m * width(self.low)), m, width(self.low))
        n = take(m).astype(np.int64)
        n[n == 0] = np.frombuffer(data, "<i8", aside, at)
        return hi, lo, n

    def merge(self, segment: int, shards: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all filters of a segment in order, with summed counters."""
        parts = [self.read(segment, data) for data in shards]
        return self.sort(*(np.concatenate(x) for x in zip(*parts)))


def width(bits: int) -> int:
    return (bits + 7) // 8


def narrow(x: np.ndarray, bits: int) -> bytes:
    """Numbers of so many bits in as few bytes each."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width(bits)].tobytes()


def wide(data: np.ndarray, count: int, size: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :size] = data.reshape(count, size)
    return out.view("<u8").ravel().astype(U)
