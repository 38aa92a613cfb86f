"""Words of many texts at once, as spans of one byte buffer with 64-bit hashes."""

from __future__ import annotations

import numpy as np

SPACES = b"\t\n\x0b\x0c\r "
_LONG = 64


def separators(other: bytes = b"") -> np.ndarray:
    """Look-up table of the bytes that part words: white space and ``other``."""
    table = np.zeros(256, dtype=bool)
    table[list(SPACES + other)] = True
    return table


BLANK = separators()


def spans(texts: list[bytes], parts: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined buffer, start and end of each word in it, and the number of words per text."""
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = ~parts[buf]
    edge = np.nonzero(inside[1:] != inside[:-1])[0] + 1
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, text_ends, side="right"))))
    return buf, starts, ends, counts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of a public-domain generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words, eight bytes of all words at a time; very long words one by one."""
    import xxhash

    padded = np.concatenate((buf, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray(shape=(len(buf),), dtype="<u8", buffer=padded.data, strides=(1,))
    sizes = ends - starts
    h = mixed(sizes.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
    keep = np.array([(1 << 8 * n) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
    todo = np.nonzero(sizes <= _LONG)[0]
    at = 0
    while len(todo):
        chunk = eight[starts[todo] + at] & keep[np.minimum(8, sizes[todo] - at)]
        h[todo] = mixed(h[todo] ^ chunk)
        at += 8
        todo = todo[sizes[todo] > at]
    for i in np.nonzero(sizes > _LONG)[0]:
        h[i] = xxhash.xxh64_intdigest(buf[starts[i]: ends[i]].tobytes(), seed)
    return h
