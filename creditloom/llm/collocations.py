"""Collocations: phrases whose words occur together more often than apart, counted without loss.

1. Texts are cut into pieces and words. A task holds the words of one language as a chunk: its own
   list of distinct words and the number of each word in order, 0 where a piece ends.
2. Words are counted over all chunks. Those that are frequent enough get ids; a phrase with any
   other word cannot be frequent enough. Only a chunk's distinct words are joined with the ids.
3. Each task counts the phrases of its chunks in a counting quotient filter. Filters travel as blocks
   per range of keys and are merged range by range, so a phrase costs one counter per filter
   however often it occurs, and no range is larger than another.
4. Frequent phrases get the counts of their parts by equi-joins, and the best of each language are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditloom.llm.common import bytes_of, no_cycle_search
from creditloom.llm.quotient_filter import Keys, Merger
from creditloom.operators.sizing import join_small, settle

PIECE_END = b".,;:!?\n\x0b\x0c\r"
CHUNK_BYTES = 2 << 20
FILTER_KEYS = 1 << 20
RANGE_KEYS = 1 << 20
STEP_BITS = 10
ID_BUCKET = 1 << 16
SALTS = 64

_ENDS = re.compile(b"[" + re.escape(PIECE_END) + b"]")
_PLAIN = bytes.maketrans(PIECE_END + b"\t", b"\n" * len(PIECE_END) + b" ")


class Numbering(dict):
    """Numbers words in the order they come; 0 is the end of a piece."""

    def __init__(self):
        self[b"\n"] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def parts_of(text: bytes, most: int) -> Iterator[bytes]:
    """A text cut behind ends of pieces, where it is longer than ``most`` bytes."""
    while len(text) > most and (end := _ENDS.search(text, most)):
        yield text[: end.end()]
        text = text[end.end():]
    yield text


def piece_words(text: bytes) -> list[bytes]:
    """Words in order, A-Z in lower case, with a line break for each end of a piece."""
    return [w for w in text.lower().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ") if w]


def chunks(docs: DataFrame, text_col: str, lang_col: str, chunk_bytes: int) -> DataFrame:
    """``chunk, lang, words, counts, codes``: codes are u32 numbers, 1 for the first of ``words``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        open_ones: dict[str, tuple[Numbering, list]] = {}
        held, number = 0, 0

        def close(lang: str):
            nonlocal number
            known, coded = open_ones.pop(lang)
            codes = np.concatenate(coded)
            counts = np.bincount(codes, minlength=len(known))[1:]
            number += 1
            arrays = [pa.array([first + number], pa.int64()), pa.array([lang], pa.string()),
                      pa.array([list(known)[1:]], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                      pa.array([counts], pa.list_(pa.int64())), pa.array([codes.astype("<u4").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["chunk", "lang", "words", "counts", "codes"])

        for batch in batches:
            for lang, text in zip(batch.column("_lang").to_pylist(), bytes_of(batch)):
                for part in parts_of(text, chunk_bytes):
                    with no_cycle_search():
                        known, coded = open_ones.setdefault(lang, (Numbering(), []))
                        words = piece_words(part)
                        coded.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words)))
                        coded.append(np.zeros(1, dtype=np.uint32))
                    held += len(part)
                    if held >= chunk_bytes:
                        yield from map(close, list(open_ones))
                        held = 0
        yield from map(close, list(open_ones))

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(cut, "chunk long, lang string, words array<string>, counts array<long>, codes binary")


def with_ids(words: DataFrame) -> DataFrame:
    """Add ``id``, from 1, nearly dense: words are numbered within hash buckets of about equal size."""
    buckets = 1 << max(0, words.count() // ID_BUCKET).bit_length()
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(buckets))
    place = F.row_number().over(W.partitionBy("_b").orderBy("lang", "word"))
    return words.withColumn("_b", bucket).withColumn("id", (place - 1) * F.lit(buckets) + F.col("_b") + 1).drop("_b")


def phrase_counts(coded: DataFrame, keys: Keys, range_bits: int, least: int, filter_keys: int = FILTER_KEYS,
                  step_bits: int = STEP_BITS) -> DataFrame:
    """``ids, a`` of all phrases of 2 to ``keys.length`` ids that occur ``least`` times. ``coded`` has a chunk's
    ``codes`` and its ``known`` words, as structs ``at, id``.

    Blocks are dealt out by at most ``step_bits`` more bits a time, so blocks stay large with many ranges.
    """
    schema = "range long, block binary"

    def rows(merger: Merger, bits: int) -> Iterator[pa.RecordBatch]:
        numbers, blocks, size = [], [], 0
        for number, block in keys.blocks(*merger.take(), bits):
            numbers.append(number)
            blocks.append(block)
            size += len(block)
            if size > CHUNK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blocks, pa.binary())], ["range", "block"])
                numbers, blocks, size = [], [], 0
        if numbers:
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blocks, pa.binary())], ["range", "block"])

    def count(bits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merger = Merger(keys, filter_keys)
            for batch in batches:
                for known, codes in zip(batch.column("known"), batch.column("codes")):
                    codes = np.frombuffer(codes.as_buffer(), dtype="<u4")
                    pairs = known.values
                    ids = np.zeros(int(codes.max(initial=0)) + 1, dtype=np.uint64)
                    ids[pairs.field("at").to_numpy() + 1] = pairs.field("id").to_numpy()
                    ids = ids[codes]
                    ok = ids > 0
                    inside = ok
                    for n in range(2, keys.length + 1):
                        inside = inside[:-1] & ok[n - 1:]
                        at = np.nonzero(inside)[0]
                        merger.add(*keys.tally(*keys.pack([ids[at + i] for i in range(n)])))
                    if merger.full():
                        yield from rows(merger, bits)
            if merger.size:
                yield from rows(merger, bits)
        return run

    def deal(bits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merger, now = Merger(keys, filter_keys), None
            for batch in batches:
                for number, block in zip(batch.column("range").to_pylist(), batch.column("block").to_pylist()):
                    if merger.size and (number != now or merger.full()):
                        yield from rows(merger, bits)
                    merger.add(*keys.read(number, block))
                    now = number
            if merger.size:
                yield from rows(merger, bits)
        return run

    def merge(group: pa.Table) -> pa.Table:
        merger = Merger(keys, filter_keys)
        for number, block in zip(group.column("range").to_pylist(), group.column("block").to_pylist()):
            merger.add(*keys.read(number, block))
            merger.full()
        hi, lo, counts = merger.take()
        enough = counts >= least
        ids = np.column_stack(keys.unpack(hi[enough], lo[enough]))
        offsets = np.concatenate(([0], np.cumsum((ids > 0).sum(axis=1))))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[ids > 0], pa.int64()))
        return pa.table({"ids": lists, "a": pa.array(counts[enough], pa.int64())})

    bits = min(step_bits, range_bits)
    blocks = coded.mapInArrow(count(bits), schema)
    while bits < range_bits:
        bits = min(bits + step_bits, range_bits)
        blocks = blocks.repartition("range").sortWithinPartitions("range").mapInArrow(deal(bits), schema)
    return blocks.groupBy("range").applyInArrow(merge, "ids array<long>, a long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10,
                 share: int = 50, top: int = 2000, chunk_bytes: int = CHUNK_BYTES, filter_keys: int = FILTER_KEYS,
                 range_keys: int = RANGE_KEYS, step_bits: int = STEP_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` words.

    ``a`` counts all occurrences of a phrase within the pieces of a language's texts, ``n`` its words. Of the
    cuts of a phrase in two, the one with the lowest score counts (ties: the shorter first part): ``l`` and
    ``r`` count its parts, ``score`` is the whole part of 1000000 * a * a / (l * r), exact while a stays below 10^15.
    Phrases need ``least`` occurrences. One that lies in a longer phrase that is frequent enough too and has
    ``share`` per cent of its occurrences goes. Order: score, a, both descending, then the phrase's bytes.

    A null text is empty, a null language ``und``. Repeated rows count as often as they occur; ids and other
    columns play no part. An empty table, or one without frequent phrases, gives no rows. A text longer than a
    chunk is cut between pieces; a piece always stays whole in a task.
    """
    if longest < 2:
        raise ValueError("a phrase has two words or more")
    pieces = settle(chunks(docs, text_col, lang_col, chunk_bytes))
    each = pieces.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    words = settle(each.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f")))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = settle(with_ids(words.where(F.col("f") >= least)))
    highest, occurrences = known.agg(F.max("id"), F.sum("f")).first()
    keys = Keys(longest, int(highest or 1).bit_length())
    # No more distinct phrases than words at which they start, times the lengths.
    range_bits = max(0, ((longest - 1) * (occurrences or 0)) // range_keys).bit_length()

    slots = pieces.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    found = slots.join(known.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("known"))
    coded = pieces.select("chunk", "codes").join(found, "chunk").select("known", "codes")
    phrases = settle(phrase_counts(coded, keys, range_bits, least, filter_keys, step_bits))

    counts = phrases.select("ids", "a").union(known.select(F.array("id"), "f"))
    size = F.size("ids")
    covered = phrases.where(size > 2).select("a", F.explode(F.expr(
        "flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), s -> slice(ids, s, m))))")).alias("ids"))
    covered = covered.groupBy("ids").agg(F.max("a").alias("_longer"))
    open_ones = phrases.join(covered, "ids", "left").where(
        F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * share)).select("ids", "a")

    cuts = open_ones.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("_k"))
    cuts = cuts.select("ids", "a", "_k", F.slice("ids", F.lit(1), F.col("_k")).alias("_first"),
                       F.slice("ids", F.col("_k") + 1, size - F.col("_k")).alias("_rest"))
    cuts = cuts.join(counts.select(F.col("ids").alias("_first"), F.col("a").alias("l")), "_first")
    cuts = cuts.join(counts.select(F.col("ids").alias("_rest"), F.col("a").alias("r")), "_rest")
    exact = {c: f"cast({c} as decimal(15,0))" for c in ("a", "l", "r")}
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000000 as decimal(7,0)) * ({exact['a']} * {exact['a']})) div ({exact['l']} * {exact['r']})"))
    scored = cuts.groupBy("ids", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_x"))

    spelled = scored.select("ids", "a", "_x", F.posexplode("ids").alias("_at", "id")).join(known.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids").agg(
        F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("_x").alias("_x"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"])).alias("phrase"))
    rows = spelled.select("lang", "phrase", "a", "_x.l", "_x.r", "_x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for part in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*part).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return join_small(rows, sizes, "lang", "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
