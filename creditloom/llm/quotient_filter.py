"""Counting quotient filters: sorted, lossless counters of wide integer keys.

A key is a row of ids packed into at most 128 bits, held as two halves of equal width. A Feistel
network permutes the keys, so that they spread evenly and still come back bit by bit. The leading
bits of a permuted key name its range, the next ones are its quotient, all others its remainder.
A block holds the keys of one range:

    u8 bits of the range, u8 bits of a quotient, u8 bytes of a remainder's upper part, u8 of its lower part,
    u32 entries
    occupied   one bit per quotient
    runend     one bit per entry: the last of its quotient
    remainders whole bytes, in ascending order within a quotient
    counters   one byte each; 255 refers to the u64 list at the end

Blocks of one range from different shards are merged as what they are, sorted runs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from creditloom.llm.words import mixed

_HEAD = "<BBBBI"
_ROUNDS = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
WIDEST = 128


def _ones(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


class Keys:
    """How ``length`` ids of ``bits`` bits each become permuted keys. Id 0 stands for no id."""

    def __init__(self, length: int, bits: int):
        if length * bits > WIDEST:
            raise ValueError("the ids of a phrase need more than 128 bits")
        self.length, self.bits = length, bits
        self.half = (length * bits + 1) // 2
        self.mask = _ones(self.half)

    def pack(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The permuted keys of phrases given as one array per position; later positions may be absent."""
        hi = np.zeros(len(columns[0]), dtype=np.uint64)
        lo = np.zeros(len(columns[0]), dtype=np.uint64)
        for i, column in enumerate(columns):
            v, s = column.astype(np.uint64), self.bits * (self.length - 1 - i)
            if s >= self.half:
                hi |= v << np.uint64(s - self.half)
            else:
                lo |= (v << np.uint64(s)) & self.mask
                if s + self.bits > self.half:
                    hi |= v >> np.uint64(self.half - s)
        for k in _ROUNDS:
            hi, lo = lo, hi ^ (mixed(lo + k) & self.mask)
        return hi, lo

    def unpack(self, hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
        for k in reversed(_ROUNDS):
            hi, lo = lo ^ (mixed(hi + k) & self.mask), hi
        out = []
        for i in range(self.length):
            s = self.bits * (self.length - 1 - i)
            if s >= self.half:
                v = hi >> np.uint64(s - self.half)
            else:
                v = lo >> np.uint64(s)
                if s + self.bits > self.half:
                    v = v | (hi << np.uint64(self.half - s))
            out.append((v & _ones(self.bits)).astype(np.int64))
        return out

    def tally(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in ascending order with their summed counts."""
        if not len(hi):
            return hi, lo, np.zeros(0, dtype=np.int64)
        if self.half <= 32:
            key = hi << np.uint64(self.half) | lo
            if counts is None:
                key.sort()
            else:
                order = np.argsort(key, kind="stable")
                key, counts = key[order], counts[order]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            hi, lo = key >> np.uint64(self.half), key & self.mask
        else:
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            counts = None if counts is None else counts[order]
            first = np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
        at = np.nonzero(first)[0]
        sums = np.diff(np.append(at, len(hi))) if counts is None else np.add.reduceat(counts, at)
        return hi[at], lo[at], sums.astype(np.int64)

    def blocks(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
        """The filter of ascending distinct keys, one block for each range of ``bits`` leading bits."""
        bits = min(bits, self.half)
        ranges = hi >> np.uint64(self.half - bits)
        edges = [0, *(np.nonzero(ranges[1:] != ranges[:-1])[0] + 1).tolist(), len(hi)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield int(ranges[a]), self._block(hi[a:b] & _ones(self.half - bits), lo[a:b], counts[a:b], bits)

    def _block(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
        q = min(int(len(hi)).bit_length(), self.half - bits)
        rest = self.half - bits - q
        quotient = (hi >> np.uint64(rest)).astype(np.int64)
        occupied = np.zeros(1 << q, dtype=bool)
        occupied[quotient] = True
        runend = np.append(quotient[1:] != quotient[:-1], True)
        upper, lower = (rest + 7) // 8, (self.half + 7) // 8
        parts = [struct.pack(_HEAD, bits, q, upper, lower, len(hi)), np.packbits(occupied).tobytes(), np.packbits(runend).tobytes()]
        for values, size in ((hi & _ones(rest), upper), (lo, lower)):
            parts.append(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes())
        parts.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
        parts.append(counts[counts >= 255].astype("<u8").tobytes())
        return b"".join(parts)

    def read(self, number: int, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys and counts of a block of range ``number``."""
        bits, q, upper, lower, n = struct.unpack_from(_HEAD, block)
        at = struct.calcsize(_HEAD)

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(block, dtype=np.uint8, count=size, offset=at - size)

        occupied = np.nonzero(np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q))[0].astype(np.uint64)
        runend = np.unpackbits(take((n + 7) // 8), count=n).astype(np.int64)
        values = []
        for size in (upper, lower):
            wide = np.zeros((n, 8), dtype=np.uint8)
            wide[:, :size] = take(n * size).reshape(n, size)
            values.append(wide.view("<u8").ravel().astype(np.uint64))
        counts = take(n).astype(np.int64)
        counts[counts == 255] = np.frombuffer(block, dtype="<u8", offset=at).astype(np.int64)
        quotient = occupied[np.cumsum(runend) - runend]
        rest = self.half - bits - q
        hi = np.uint64(number) << np.uint64(self.half - bits) if bits else np.uint64(0)
        return hi | quotient << np.uint64(rest) | values[0], values[1], counts


class Merger:
    """Collects sorted filters and merges them; ``full`` tells when more than ``most`` keys remain."""

    def __init__(self, keys: Keys, most: int):
        self.keys, self.most, self.held, self.size = keys, most, [], 0

    def add(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((hi, lo, counts))
        self.size += len(hi)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = self.held[0] if len(self.held) == 1 else self.keys.tally(*(np.concatenate(c) for c in zip(*self.held)))
        self.held, self.size = [out], len(out[0])
        return out

    def full(self) -> bool:
        if self.size > 2 * self.most:
            self.merged()
        return self.size > self.most and len(self.held) == 1

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = self.merged()
        self.held, self.size = [], 0
        return out
