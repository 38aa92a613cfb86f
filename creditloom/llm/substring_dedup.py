"""Removal of word sequences that an earlier document holds, by prefix-partitioned suffix trees.

A suffix is a document's words from one place on; windows of ``window`` words that repeat are the
inner nodes at depth ``window`` of the suffix tree of all documents. The tree is never built whole:

1. Sieve. Of the k-word runs in each window the one with the smallest hash is its anchor. Equal
   windows have equal anchors, consecutive windows mostly share theirs, and only anchors that stand
   in two documents or more can lie in a repeated window. Texts are not shuffled for this.
2. Partition. Suffixes go to the group of a prefix: those around a sieved anchor share its words, and
   the anchor names the group. A prefix whose group would hold more than ``group_words`` words is
   lengthened to the whole window, where a group needs no tree: its only node is an aggregate.
3. Trees. A task reads its groups one after the other and holds a bounded number of words at a
   time. It sorts the suffixes by doubling the compared depth; neighbours that agree on ``window``
   words hang under one deep node. A suffix is a repeat if its node holds a smaller document id.

Runs of repeated suffixes are the maximal repeats, and their words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import WORD, bytes_of, id_text, slices
from creditloom.llm.winnowing import gram_hashes
from creditloom.llm.words import spans, word_hashes
from creditloom.operators.sizing import settle

GROUP_WORDS = 1_000_000
CHUNK_WORDS = 400_000
_LAST = np.iinfo(np.int64).max  # stands for a null id: later than any other


def anchors_of(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes of a text with these word hashes, and the first and last window start that each
    serves. Neighbouring windows with equal anchor hashes go together, so a text that repeats itself
    over and over has few."""
    reach = max(1, 2 * window // 3)
    least, done = gram_hashes(hashes, window - reach + 1), 1
    while done < reach:
        step = min(done, reach - done)
        least, done = np.minimum(least[: len(least) - step], least[step:]), done + step
    new = np.nonzero(np.concatenate(([True], least[1:] != least[:-1])))[0]
    return least[new], new, np.concatenate((new[1:], [len(least)])) - 1


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """``h, _id, _row, lo, hi`` per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            buf, starts, ends, counts = spans(bytes_of(part))
            words = word_hashes(buf, starts, ends)
            stops = np.cumsum(counts)
            ids, rows = part.column("_id").to_pylist(), part.column("_row").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for i in np.nonzero(counts >= window)[0].tolist():
                h, lo, hi = anchors_of(words[stops[i] - counts[i]: stops[i]], window)
                out[0].append(h.view(np.int64))
                out[1].append(np.full(len(h), _LAST if ids[i] is None else ids[i]))
                out[2].append(np.full(len(h), rows[i]))
                out[3].append(lo)
                out[4].append(hi)
            if out[0]:
                cols = [np.concatenate(c) for c in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.int32(),) * 2)],
                                                 ["h", "_id", "_row", "lo", "hi"])

    return docs.mapInArrow(run, "h long, _id long, _row long, lo int, hi int")


def deep_nodes(words: np.ndarray, depth: int) -> np.ndarray:
    """For every suffix of ``words`` (whole numbers) with ``depth`` words, the number of its node
    at that depth, numbered in the suffixes' order: equal numbers mean equal words down to there."""
    node, reached = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while reached < depth:
        step = min(reached, depth - reached)
        below = node[step:]
        pair = node[: len(below)] * (int(node.max(initial=0)) + 1) + below
        node, reached = np.unique(pair, return_inverse=True)[1].astype(np.int64), reached + step
    return node


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true values."""
    edge = np.nonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))[0]
    return edge[::2], edge[1::2] - 1


def tree_repeats(segments: list[list[bytes]], ids: np.ndarray, depth: int) -> list[tuple[int, int, int]]:
    """(segment, first word, end) of the maximal repeats of each segment that a segment of a
    smaller id also holds."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(s) for s in segments])
    words = np.fromiter((number.setdefault(w, len(number)) for s in segments for w in s), dtype=np.int64, count=int(sizes.sum()))
    owner = np.repeat(np.arange(len(segments)), sizes)
    node = deep_nodes(words, depth)
    whole = np.nonzero(owner[: len(node)] == owner[depth - 1: depth - 1 + len(node)])[0]  # suffixes within one segment
    node, owner, first = node[whole], owner[whole], np.cumsum(sizes) - sizes
    order = np.argsort(node, kind="stable")
    heads = np.nonzero(np.concatenate(([True], node[order][1:] != node[order][:-1])))[0]
    least = np.empty(len(node), dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[owner[order]], heads), np.diff(np.concatenate((heads, [len(node)])))) if len(node) else 0
    repeated = least < ids[owner]
    flags = np.zeros(len(words) + 1, dtype=bool)
    flags[whole] = repeated
    out = []
    for s, e in zip(*_runs(flags)):  # a run ends with its segment: the last depth - 1 places are no suffix
        k = int(np.searchsorted(first, s, side="right")) - 1
        out.append((k, int(s - first[k]), int(e - first[k]) + depth))
    return out


def repeated_spans(texts: DataFrame, window: int) -> DataFrame:
    """``_row, a, b``: words to remove from the texts with their sieved anchors: from each place in ``a``
    up to ``b``, or for the length of a window where that is null.

    ``texts`` has ``_id, _row, _text, marks``; a mark is an anchor (h, lo, hi, over) and ``over`` tells
    that its group is too large for a tree.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["h", "_id", "_row", "lo", "words"], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        for part in slices(batches, most=1 << 20):
            rows = []
            for i, row, text, marks in zip(part.column("_id").to_pylist(), part.column("_row").to_pylist(), bytes_of(part), part.column("marks").to_pylist()):
                words = text.split()
                rows += [(m["h"], _LAST if i is None else i, row, m["lo"], b" ".join(words[m["lo"]: m["hi"] + window]).decode()) for m in marks if not m["over"]]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush():
            found = tree_repeats([r[0] for r in held], np.array([r[1] for r in held], dtype=np.int64), window)
            rows = [(held[k][2], held[k][3] + a, held[k][3] + b) for k, a, b in found]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["_row", "a", "b"])

        for batch in batches:
            for h, i, row, lo, text in zip(*(batch.column(c).to_pylist() for c in ("h", "_id", "_row", "lo")), bytes_of(batch, "words")):
                if h != last and size >= CHUNK_WORDS:
                    yield flush()
                    size = 0
                last = h
                words = text.split()
                held.append((words, i, row, lo))
                size += len(words)
        if held:
            yield flush()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each different window of a document once, with its starts."""
        names, types = ["w1", "w2", "_id", "_row", "starts"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        for part in slices(batches, most=1 << 20):
            for i, row, text, marks in zip(part.column("_id").to_pylist(), part.column("_row").to_pylist(), bytes_of(part), part.column("marks").to_pylist()):
                over = [(m["lo"], m["hi"]) for m in marks if m["over"]]
                if over:
                    buf, starts, ends, _ = spans([text])
                    at = np.unique(np.concatenate([np.arange(lo, hi + 1) for lo, hi in over]))
                    w = np.column_stack([gram_hashes(word_hashes(buf, starts, ends, seed), window)[at].view(np.int64) for seed in (1, 2)])
                    order = np.lexsort((at, w[:, 1], w[:, 0]))
                    w, at = w[order], at[order]
                    heads = np.nonzero(np.concatenate(([True], (w[1:] != w[:-1]).any(axis=1))))[0]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)), pa.int32()), pa.array(at, pa.int32()))
                    n = len(heads)
                    yield pa.RecordBatch.from_arrays([pa.array(w[heads, 0]), pa.array(w[heads, 1]), pa.array(np.full(n, _LAST if i is None else i)),
                                                      pa.array(np.full(n, row)), lists], names)

    parts = texts.select("_id", "_row", "_text", "marks")
    small = (parts.mapInArrow(segments, "h long, _id long, _row long, lo int, words string")
             .repartition("h").sortWithinPartitions("h").mapInArrow(trees, "_row long, a int, b int"))
    long_prefix = settle(parts.where(F.exists("marks", lambda m: m["over"])).mapInArrow(windows, "w1 long, w2 long, _id long, _row long, starts array<int>"))
    least = long_prefix.groupBy("w1", "w2").agg(F.min("_id").alias("least"), F.max("_id").alias("most")).where("least < most").drop("most")
    again = long_prefix.join(least, ["w1", "w2"]).where("least < _id")
    return small.select("_row", F.array("a").alias("a"), "b").union(again.select("_row", F.col("starts").alias("a"), F.lit(None).cast("int").alias("b")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, group_words: int = GROUP_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` per document.

    A word goes if a window of ``window`` consecutive words covers it whose word sequence also starts
    in a document with a smaller id. Windows are judged on the input. ``kept_text`` has the other words,
    one space between. Null and empty texts have no words. Null ids are later than all others and
    never remove each other's words; rows with equal ids do not either. Other columns are ignored.
    """
    rows = id_text(docs, id_col, text_col).select("_id", F.coalesce("_text", F.lit("")).alias("_text"))
    rows = rows.withColumn("_row", F.xxhash64("_id", "_text"))
    anchors = settle(_anchors(rows, window))
    repeated = (anchors.groupBy("h").agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.sum(F.col("hi") - F.col("lo") + window).alias("n"))
                .where("least < most").select("h", (F.col("n") > group_words).alias("over")))
    marks = (anchors.join(repeated, "h").groupBy("_row")
             .agg(F.collect_set(F.struct("h", "lo", "hi", "over")).alias("marks")))
    words = F.regexp_extract_all("_text", F.lit(f"({WORD})"), 0)
    untouched = F.col("marks").isNull()
    # One shuffle of the texts; what has no mark is done here, the rest stays with its text.
    joined = settle(rows.join(marks, "_row", "left").select(
        "_id", "_row", "marks", F.when(~untouched, F.col("_text")).alias("_text"),
        F.when(untouched, F.concat_ws(" ", words)).alias("_kept"), F.when(untouched, F.size(words)).cast("long").alias("_n")))
    done = joined.where("marks is null").select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("_kept").alias("kept_text"))
    marked = joined.where("marks is not null").select("_id", "_row", "_text", "marks")
    found = repeated_spans(marked, window).groupBy("_row").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for i, text, cuts in zip(part.column("_id").to_pylist(), bytes_of(part), part.column("cuts").to_pylist()):
                words = text.split()
                steps = np.zeros(len(words) + 1, dtype=np.int64)
                for c in cuts or ():
                    a = np.array(c["a"])
                    np.add.at(steps, a, 1)
                    np.add.at(steps, a + window if c["b"] is None else c["b"], -1)
                keep = np.cumsum(steps)[:-1] == 0
                kept = [w for w, k in zip(words, keep.tolist()) if k]
                out.append((i, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                             ["doc_id", "n_words", "n_removed", "kept_text"])

    changed = marked.join(found, "_row", "left").select("_id", "_text", "cuts").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_text string")
    return done.union(changed)
