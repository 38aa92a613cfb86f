"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    home = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    return home.__dict__.setdefault(name, {})


def release_caches(*kept: str) -> None:
    """Forgets what earlier operators left in this Python worker, but for ``kept``, and gives the memory back.

    Workers outlive a stage, so the tables of one operator would stay beside the next one's work."""
    home = vars(sys.modules.get("_llm_worker_cache", types.ModuleType("none")))
    left = [n for n, x in home.items() if not n.startswith("__") and n not in kept and x]
    for name in left:
        home.pop(name).clear()
    if left:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library keeps freed memory unless told
        if trim:
            trim(0)


@contextmanager
def no_cycle_search():
    """Leaves Python's search for reference cycles out while a task handles millions of small lists
    that are freed by counting alone; with large caches the search takes longer than the work."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text, as ``_id`` and ``_text``; other columns never get in the way."""
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "_text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``most`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = batch.column(column).cast(pa.binary()).fill_null(b"")
        sizes = np.array([len(x.as_buffer()) for x in lengths], dtype=np.int64)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "_text") -> list[str]:
    """Texts with null as the empty text."""
    return batch.column(column).fill_null("").to_pylist()


def bytes_of(batch: pa.RecordBatch, column: str = "_text") -> list[bytes]:
    """UTF-8 bytes with null as the empty text."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


class RecentCache:
    """A bounded look-up table that keeps what was used lately.

    Entries live in two halves. When the young half is full it becomes the old one and what was old
    is forgotten; an old entry that is asked for again becomes young.
    """

    def __init__(self, most: int, longest: int):
        self.half, self.longest = most // 2, longest
        self.young, self.old = {}, {}

    def look_up(self, keys: list, make) -> list:
        """The values of all keys; ``make`` turns a list of unknown keys into their values."""
        got = list(map(self.young.get, keys))
        if None in got:
            missed = {k for k, v in zip(keys, got) if v is None}
            found = {k: self.old[k] for k in missed if k in self.old}
            unknown = [k for k in missed if k not in found]
            found.update(zip(unknown, make(unknown) if unknown else ()))
            got = [found[k] if v is None else v for k, v in zip(keys, got)]
            if len(self.young) + len(found) > self.half:
                self.young, self.old = {}, self.young
            self.young.update((k, v) for k, v in found.items() if len(k) <= self.longest)
        return got


class IdCache(dict):
    """Numbers keys in the order they come and keeps the ids of all of them in one flat array.

    ``make`` turns a list of new keys into their ids, as little-endian u32 each. Above ``most`` keys, or
    ``most_bytes`` bytes or characters of them, everything is forgotten before the next texts come.
    """

    def __init__(self, make, most: int, most_bytes: int = 12 << 20):
        self.make, self.most, self.most_bytes = make, most, most_bytes
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new, self.held = [], 0
        self.flat, self.starts, self.sizes = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def known(self, key) -> bytes | None:
        """The ids of a key that came with earlier texts."""
        n = self.get(key, len(self.sizes))
        return self.flat[self.starts[n]: self.starts[n] + self.sizes[n]].tobytes() if n < len(self.sizes) else None

    def rows(self, texts: list[list]) -> list[np.ndarray]:
        """The ids of texts given as their keys in order."""
        if len(self) > self.most or self.held > self.most_bytes:
            self.forget()
        counts = [len(keys) for keys in texts]
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=sum(counts))
        if self.new:
            made = self.make(self.new)
            sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(made), dtype="<u4")))
            self.held += sum(map(len, self.new))
            self.new = []
        sizes = self.sizes[numbers]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        out = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[numbers] - ends[:-1], sizes)]
        bounds = ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))].tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]
