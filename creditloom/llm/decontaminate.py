"""Benchmark decontamination by spaced seeds.

A mask names the word positions of a window that count and skips the rest. Seeds of all benchmark
windows are held in a table of bounded size, document seeds are looked up in it inside the scan,
and around each hit the whole alignment of item and document is compared, so that overlaps with
substituted words are found and chance hits are not. The three masks hit every 13-word window that
differs from the benchmark in at most two words, which is what counts as an overlap; shorter items
must match whole. A large benchmark is taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import id_text, slices, texts_of
from creditloom.llm.words import mixed, separators, spans, word_hashes

# The masks, as offsets of the words that count. Every 13-word window with at most
# two substitutions is hit by one of them (tested exhaustively).
MASKS = ((0, 1, 2, 4, 5, 6, 7), (0, 1, 2, 3, 6, 9, 10), (0, 3, 5, 6, 7, 8, 10))
LEAST = 13
SHARE = 0.8
BLOCK_WORDS = 1_000_000

PARTS = separators(bytes(c for c in range(1, 128) if not chr(c).isalnum()) + b"\0")


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words without ASCII punctuation, and words per text."""
    buf, starts, ends, counts = spans([t.lower().encode() for t in texts], PARTS)
    return word_hashes(buf, starts, ends), counts


def _seeds(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """One hash per window start, in order."""
    n = max(0, len(h) - mask[-1])
    out = np.zeros(n, dtype=np.uint64)
    for k, o in enumerate(mask):
        out += h[o: o + n] * np.uint64(2 * k + 0x9E3779B97F4A7C15)
    return mixed(out)


class SeedTable:
    """Benchmark items (an id, or None, and the text) as words, with the seeds of every mask sorted for look-up."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        self.words, self.sizes = _words([t for _, t in items])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.item = np.repeat(np.arange(len(items)), self.sizes)
        self.tables = []
        for mask in MASKS:
            seeds = _seeds(self.words, mask)
            at = np.arange(len(seeds))
            inside = self.item[at] == self.item[at + mask[-1]] if len(at) else np.zeros(0, dtype=bool)
            seeds, at = seeds[inside], at[inside]
            order = np.argsort(seeds, kind="stable")
            bits = np.zeros(1 << 20, dtype=bool)
            bits[(seeds >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((mask, seeds[order], at[order], bits))
        self.short = {}
        for i, n in enumerate(self.sizes.tolist()):  # no mask fits: the whole item is looked up
            if 0 < n <= max(m[-1] for m in MASKS):
                key = self.words[self.first[i]: self.first[i] + n]
                self.short.setdefault(n, {}).setdefault(key.tobytes(), i)

    def hits(self, h: np.ndarray, owner: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, position of the item's first word) of every alignment that a seed within one
        text hits."""
        found: set[tuple[int, int, int]] = set()
        for mask, seeds, at, bits in self.tables:
            mine = _seeds(h, mask)
            maybe = np.nonzero(bits[(mine >> np.uint64(44)).astype(np.int64)])[0]
            maybe = maybe[owner[maybe] == owner[maybe + mask[-1]]]
            low, high = (np.searchsorted(seeds, mine[maybe], side=s) for s in ("left", "right"))
            for p, a, b in zip(maybe[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                for q in at[a:b].tolist():
                    i = int(self.item[q])
                    found.add((int(owner[p]), i, p - (q - int(self.first[i]))))
        for n, keys in self.short.items():
            heads = {k[:8] for k in keys}
            first = np.isin(h[: max(0, len(h) - n + 1)], np.frombuffer(b"".join(sorted(heads)), dtype=np.uint64))
            for p in np.nonzero(first)[0].tolist():
                i = keys.get(h[p: p + n].tobytes())
                if i is not None and owner[p] == owner[p + n - 1]:
                    found.add((int(owner[p]), i, p))
        return found

    def overlap(self, h: np.ndarray, item: int, start: int, least: int, share: float) -> tuple[int, int, int] | None:
        """First word, length and equal words of the best overlap on one alignment.

        Windows of ``least`` words count if ``share`` of their words are equal; the longest run of such
        windows is the overlap, without unequal words at its ends. An item with fewer words counts
        if all are equal.
        """
        size = int(self.sizes[item])
        need = min(least, size)
        lo, hi = max(0, start), min(len(h), start + size)
        if hi - lo < need:
            return None
        first = int(self.first[item])
        same = h[lo:hi] == self.words[first + lo - start: first + hi - start]
        total = np.concatenate(([0], np.cumsum(same)))
        good = total[need:] - total[:-need] >= (need if size < least else int(np.ceil(share * need - 1e-9)))
        edge = np.nonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))[0]
        if not len(edge):
            return None
        k = int(np.argmax(edge[1::2] - edge[::2]))
        equal = np.nonzero(same[edge[2 * k]: edge[2 * k + 1] - 1 + need])[0] + edge[2 * k]
        return lo + int(equal[0]), int(equal[-1] - equal[0]) + 1, len(equal)


def seed_tables(benchmark: DataFrame, item_col: str, item_text: str, block_words: int, shortest: int) -> Iterator[Broadcast]:
    """The benchmark in blocks of bounded size, each sent to all workers."""
    items = benchmark.where(F.col(item_text).isNotNull()).groupBy(F.col(item_text).alias("t")).agg(F.min(F.col(item_col).cast("long")).alias("i"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-size // (4 * block_words)) or 1
    items = items.withColumn("b", F.pmod(F.xxhash64("t"), F.lit(blocks)))
    for b in range(blocks):
        rows = sorted(((r["i"], r["t"]) for r in items.where(F.col("b") == b).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if shortest > 1:
            rows = [x for x, n in zip(rows, _words([t for _, t in rows])[1].tolist()) if n >= shortest]
        yield benchmark.sparkSession.sparkContext.broadcast(SeedTable(rows))


def findings(known: SeedTable, texts: list[str], least: int, share: float) -> dict[int, dict[int, tuple]]:
    """Per place of a text, its longest overlap with each item it repeats, the first of equals."""
    words, counts = _words(texts)
    ends = np.cumsum(counts)
    by_text: dict[int, dict[int, tuple]] = {}
    for t, item, start in sorted(known.hits(words, np.repeat(np.arange(len(counts)), counts))):
        lo = int(ends[t] - counts[t])
        got = known.overlap(words[lo: int(ends[t])], item, start - lo, least, share)
        best = by_text.setdefault(t, {})
        if got and (item not in best or (-got[1], got[0]) < (-best[item][1], best[item][0])):
            best[item] = got
    return by_text


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text", least: int = LEAST, share: float = SHARE,
             block_words: int = BLOCK_WORDS, shortest: int = 1) -> DataFrame:
    """``doc_id, item_id, doc_start, n_words, n_equal`` per document and benchmark item it repeats.

    Words are lower-cased runs without white space and ASCII punctuation; ``doc_start`` counts
    them. The longest overlap of the pair is given, the first of equals; see ``SeedTable.overlap``. Items with equal texts count
    as the one with the smallest id; items without words, null texts and documents without words
    meet nothing, nor do items of fewer than ``shortest`` words. Items without an id are searched for like
    others and give item_id null, a row for each text. Documents that repeat nothing give no row. Repeated document rows give theirs
    each. Null document ids stay null.
    """
    out = None
    for table in seed_tables(benchmark, item_col, item_text, block_words, shortest):

        def search(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            known = table.value
            for part in slices(batches):
                ids, rows = part.column("_id").to_pylist(), []
                by_text = findings(known, texts_of(part), least, share)
                for t in sorted(by_text):
                    rows += [(ids[t], known.ids[i], *by_text[t][i]) for i in sorted(by_text[t])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)],
                                                 ["doc_id", "item_id", "doc_start", "n_words", "n_equal"])

        found = id_text(docs, id_col, text_col).mapInArrow(search, "doc_id long, item_id long, doc_start long, n_words long, n_equal long")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          least: int = LEAST, share: float = SHARE, block_words: int = BLOCK_WORDS, shortest: int = 1) -> DataFrame:
    """The documents that repeat no benchmark item, all columns as they were. Every row is judged by its own text as it
    is read, so ids play no part: they may be null or shared. Rows stay in place, nothing is shuffled. Null
    and empty texts stay. Items of fewer than ``shortest`` words do not contaminate; with 1 an item of a single
    word takes every document that has it. An empty table stays empty, an empty benchmark takes nothing."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("_text"))
    for table in seed_tables(benchmark, item_col, item_text, block_words, shortest):

        def keep(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                found = findings(table.value, texts_of(part), least, share)
                yield part.filter(pa.array([not found.get(t) for t in range(part.num_rows)], pa.bool_()))

        rows = rows.mapInArrow(keep, rows.schema)
    return rows.select("row.*")
