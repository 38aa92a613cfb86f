"""Quality of documents: histogram gradient-boosted trees over statistics of whole texts.

Statistics are taken in one pass over the texts and stored. Trees are fitted to a bounded sample of
labelled rows: values become bins at quantiles, each level sums gradients and curvatures per node,
statistic and bin, and the best cuts are taken by second-order gain. Fitted trees are complete binary
trees laid out level by level in flat arrays, which all rows walk at once, one level a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import bytes_of, id_text, no_cycle_search, slices
from creditloom.llm.words import mixed, spans, word_hashes
from creditloom.operators.sizing import join_small, settle

SAMPLE_ROWS = 32_768
PUNCTUATION = b".,;:!?'\"()-"
ENDINGS = b".!?:;\""
SHINGLE = 5
STATISTICS = ("log_bytes", "log_words", "word_bytes", "letters", "capitals", "digits", "spaces", "punctuation", "symbols", "controls",
              "beyond_ascii", "bars", "exclamations", "stops", "commas", "same_as_last", "distinct_words", "top_word", "short_words", "long_words",
              "no_letter", "capital_starts", "all_capitals", "symbol_ends", "line_bytes", "ended_lines", "distinct_lines", "repeated_shingles",
              "longest_word")


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(characters)] = 1
    return out


_UPPER = _table(bytes(range(65, 91)))
_LETTER = _UPPER + _table(bytes(range(97, 123))) + _table(bytes(range(128, 256)))
_DIGIT = _table(b"0123456789")
_SPACE = _table(b" \t\n\x0b\x0c\r")
_PUNCTUATION = _table(PUNCTUATION)
_CONTROL = _table(bytes(x for x in (*range(32), 127) if x not in b"\t\n\x0b\x0c\r"))
_SYMBOL = 1 - np.minimum(1, _LETTER + _DIGIT + _SPACE + _PUNCTUATION + _CONTROL)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(home: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes of each row, and how often its most frequent one occurs."""
    order = np.lexsort((hashes, home))
    h, g = hashes[order], home[order]
    at = np.nonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])))[0] if len(h) else np.zeros(0, dtype=np.int64)
    most = np.zeros(rows, dtype=np.int64)
    np.maximum.at(most, g[at], np.diff(np.append(at, len(h))))
    return np.bincount(g[at], minlength=rows), most


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; shares of nothing are 0."""
    n = len(texts)
    buf, starts, ends, words = spans(texts)
    edges = np.cumsum([1] + [len(t) + 1 for t in texts])
    sizes = np.diff(edges) - 1
    home = np.repeat(np.arange(n), words)
    lengths = ends - starts

    def bytes_in(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[buf])))
        return total[edges[:-1] + sizes] - total[edges[:-1]]

    def per_row(flags: np.ndarray, of: np.ndarray = home) -> np.ndarray:
        return np.bincount(of, weights=flags, minlength=n)

    hashes = word_hashes(buf, starts, ends)
    distinct, top = _distinct(home, hashes, n)
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (home[1:] == home[:-1])) if len(hashes) else np.zeros(0, dtype=bool)
    inside = {name: np.concatenate(([0], np.cumsum(table[buf]))) for name, table in (("letter", _LETTER), ("upper", _UPPER))}
    letters, uppers = (inside[k][ends] - inside[k][starts] for k in ("letter", "upper"))

    run = max(0, len(hashes) - SHINGLE + 1)
    shingle = np.zeros(run, dtype=np.uint64)
    for i in range(SHINGLE):
        shingle = mixed(shingle ^ hashes[i: i + run])
    whole = home[:run] == home[SHINGLE - 1:] if run else np.zeros(0, dtype=bool)
    shingle_home = home[:run][whole]
    shingles = np.bincount(shingle_home, minlength=n)
    distinct_shingles, _ = _distinct(shingle_home, shingle[whole], n)

    breaks = _table(b"\n").astype(bool)
    _, line_starts, line_ends, lines = spans(texts, breaks)
    line_home = np.repeat(np.arange(n), lines)
    line_hashes = word_hashes(buf, line_starts, line_ends)
    distinct_lines, _ = _distinct(line_home, line_hashes, n)
    ended = _table(ENDINGS)[buf[line_ends - 1]]

    all_letters = bytes_in(_LETTER)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, home, lengths)
    columns = {
        "log_bytes": np.log1p(sizes), "log_words": np.log1p(words), "word_bytes": _share(per_row(lengths), words),
        "letters": _share(all_letters, sizes), "capitals": _share(bytes_in(_UPPER), all_letters), "digits": _share(bytes_in(_DIGIT), sizes),
        "spaces": _share(bytes_in(_SPACE), sizes), "punctuation": _share(bytes_in(_PUNCTUATION), sizes), "symbols": _share(bytes_in(_SYMBOL), sizes),
        "controls": _share(bytes_in(_CONTROL), sizes), "beyond_ascii": _share(bytes_in(_table(bytes(range(128, 256)))), sizes),
        "bars": _share(bytes_in(_table(b"|")), words), "exclamations": _share(bytes_in(_table(b"!")), words),
        "stops": _share(bytes_in(_table(b".")), words), "commas": _share(bytes_in(_table(b",")), words),
        "same_as_last": _share(per_row(again), words), "distinct_words": _share(distinct, words), "top_word": _share(top, words),
        "short_words": _share(per_row(lengths <= 3), words), "long_words": _share(per_row(lengths > 20), words),
        "no_letter": _share(per_row(letters == 0), words), "capital_starts": _share(per_row(_UPPER[buf[starts]]), words),
        "all_capitals": _share(per_row((uppers == letters) & (letters > 1)), words), "symbol_ends": _share(per_row(_SYMBOL[buf[ends - 1]]), words),
        "line_bytes": np.log1p(_share(per_row(line_ends - line_starts, line_home), lines)), "ended_lines": _share(per_row(ended, line_home), lines),
        "distinct_lines": _share(distinct_lines, lines), "repeated_shingles": 1 - _share(distinct_shingles, shingles) * (shingles > 0) - (shingles == 0),
        "longest_word": np.log1p(longest),
    }
    return np.column_stack([columns[c] for c in STATISTICS]).astype(np.float32)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` (array of floats, in the order of ``STATISTICS``) of each document's whole text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            with no_cycle_search():
                values = statistics(bytes_of(piece))
            offsets = pa.array(np.arange(len(values) + 1) * len(STATISTICS), pa.int32())
            yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], ["doc_id", "stats"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, stats array<float>")


# ---- Trees

@dataclass
class Trees:
    """Complete trees of equal depth: ``feature, cut`` of inner nodes level by level, ``leaf`` values in order."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1. All trees of all rows go down one level a step; values at a cut go left."""
        out = np.full(len(rows), self.base)
        trees, depth = np.arange(len(self.leaf))[None, :], int(self.leaf.shape[1]).bit_length() - 1
        for start in range(0, len(rows), 4096):
            part = rows[start: start + 4096]
            node = np.zeros((len(part), len(self.leaf)), dtype=np.int64)
            here = np.arange(len(part))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (part[here, self.feature[trees, node]] > self.cut[trees, node])
            out[start: start + 4096] += self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 different cuts at quantiles of a column; the largest value is no cut."""
    cuts = np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))
    return cuts[cuts < values.max()]


def best_cuts(binned: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, bins: int, l2: float,
              least_weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the gain, statistic and bin of its best cut; ties go to the first statistic and bin."""
    n, columns = binned.shape
    cell = ((node[:, None] * columns + np.arange(columns)) * bins + binned).ravel()
    sums = [np.bincount(cell, weights=np.repeat(w, columns), minlength=nodes * columns * bins).reshape(nodes, columns, bins) for w in (g, h)]
    left_g, left_h = (s.cumsum(axis=2) for s in sums)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
    gain = np.where((left_h >= least_weight) & (right_h >= least_weight), gain, 0.0).reshape(nodes, -1)
    at = gain.argmax(axis=1)
    return gain[np.arange(nodes), at], at // bins, at % bins


def fit_trees(rows: np.ndarray, labels: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64,
              l2: float = 1.0, least_weight: float = 2.0) -> Trees:
    """Boosted trees for labels 0 and 1. Without rows, or with one label alone, only the smoothed share of label 1."""
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if len(labels) == 0 or labels.min() == labels.max():
        rounds = 0
    feature, cut, leaf = np.zeros((rounds, inner), dtype=np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    if rounds:
        cuts = [cuts_of(rows[:, k], bins) for k in range(rows.shape[1])]
        binned = np.column_stack([np.searchsorted(c, rows[:, k]) for k, c in enumerate(cuts)])
    margin = np.full(len(labels), base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - labels, p * (1 - p)
        node = np.zeros(len(labels), dtype=np.int64)
        for level in range(depth):
            gain, column, at = best_cuts(binned, node, 1 << level, g, h, bins, l2, least_weight)
            first = (1 << level) - 1
            split = gain > 1e-9
            for k in np.nonzero(split)[0].tolist():
                feature[t, first + k], cut[t, first + k] = column[k], cuts[column[k]][at[k]]
            right = split[node] & (binned[np.arange(len(node)), column[node]] > at[node])
            node = 2 * node + right
        leaf[t] = -rate * np.bincount(node, weights=g, minlength=leaves) / (np.bincount(node, weights=h, minlength=leaves) + l2)
        margin += leaf[t][node]
    return Trees(base, feature, cut, leaf)


def held_out(id_col: str = "doc_id"):
    """Documents whose labels are not learnt from. A document without an id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", label_id: str = "doc_id",
          sample_rows: int = SAMPLE_ROWS, **how) -> Trees:
    """Trees fitted to labelled documents that are not held out, at most ``sample_rows`` of them, drawn by a hash
    of the id. An id counts once: of several labels the greatest, of several documents the least statistics.
    Null ids and labels are not learnt from."""
    known = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("_label")).where("doc_id is not null and _label in (0, 1)")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("_label").alias("_label"))
    rows = settle(join_small(stats, known, "doc_id", "inner").groupBy("doc_id").agg(F.min("stats").alias("stats"), F.first("_label").alias("_label")))
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30))
    share = int(min(1.0, sample_rows / max(1, rows.count())) * (1 << 30))
    got = sorted(rows.where(draw < share).select(draw.alias("k"), "doc_id", "stats", "_label").toLocalIterator())[:sample_rows]
    values = np.array([r.stats for r in got], dtype=np.float32).reshape(len(got), len(STATISTICS))
    return fit_trees(values, np.array([r["_label"] for r in got], dtype=np.float64), **how)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", label_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS, **how) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; only the text decides the score.

    Null texts count as empty, and empty texts are scored by their statistics, which are 0. Repeated rows and
    null ids are kept. Other columns are ignored. An empty table gives an empty one; without labels of both kinds every
    score is the smoothed share of label 1.
    """
    stats = settle(document_statistics(docs, id_col, text_col))
    model = docs.sparkSession.sparkContext.broadcast(train(stats, labels, label_col, label_id, sample_rows, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("stats").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(values), pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
