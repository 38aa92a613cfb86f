import zlib

import numpy as np
import pytest

from creditloom.llm.quality import STATISTICS, best_cuts, cuts_of, fit_trees, quality_scores, statistics, train

SF = "/root/testdata/sf0.01"


def stat(text, name):
    return float(statistics([b"other words", text.encode(), b""])[1][STATISTICS.index(name)])


@pytest.mark.parametrize("text, name, want", [
    ("one two two two", "same_as_last", 0.5), ("one two two two", "distinct_words", 0.5), ("one two two two", "top_word", 0.75),
    ("a | b | c", "bars", 0.4), ("AB Cd", "all_capitals", 0.5), ("AB Cd", "capital_starts", 1.0), ("x$$$ y", "symbol_ends", 0.5),
    ("x$$$ y", "symbols", 0.5), ("l\nl\nm", "distinct_lines", 2 / 3), ("Ends.\nno end", "ended_lines", 0.5), ("12 ab", "digits", 0.4),
    ("a b c d e a b c d e", "repeated_shingles", 1 / 6), ("ab", "repeated_shingles", 0.0), ("12 --", "no_letter", 1.0), ("é", "beyond_ascii", 1.0)])
def test_statistics(text, name, want):
    assert stat(text, name) == pytest.approx(want)


def test_statistics_do_not_depend_on_neighbours():
    texts = [b"", b"The cat.\nThe cat.\n", "é ü | x!!".encode(), b" ", b"word " * 5000]
    alone = np.concatenate([statistics([t]) for t in texts])
    assert np.array_equal(statistics(texts), alone)
    assert not alone[0].any() and np.isfinite(alone).all()
    assert statistics([]).shape == (0, len(STATISTICS))


def test_cuts_equal_a_plain_search():
    rng = np.random.default_rng(1)
    binned, node = rng.integers(0, 8, (200, 3)), rng.integers(0, 2, 200)
    g, h = rng.normal(size=200), rng.uniform(0.1, 0.3, 200)
    gains, columns, bins = best_cuts(binned, node, 2, g, h, 8, 1.0, 2.0)
    for k in range(2):
        found = []
        for c in range(3):
            for b in range(8):
                sides = [(node == k) & s for s in (binned[:, c] <= b, binned[:, c] > b)]
                w = [h[s].sum() for s in sides]
                gain = sum(g[s].sum() ** 2 / (x + 1) for s, x in zip(sides, w)) - g[node == k].sum() ** 2 / (h[node == k].sum() + 1)
                found.append((gain if min(w) >= 2 else 0.0, -c, -b))
        assert (gains[k], -columns[k], -bins[k]) == (pytest.approx(max(found)[0]), *max(found)[1:])


def test_flat_traversal_equals_walking_each_row():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(5000, 4)).astype(np.float32)
    labels = (rows[:, 0] * rows[:, 1] > 0).astype(float)
    trees = fit_trees(rows, labels, rounds=12, depth=3)
    scores = trees.score(rows)
    for i in range(0, 5000, 97):
        total = trees.base
        for t in range(12):
            node = 0
            while node < 7:
                node = 2 * node + (2 if rows[i, trees.feature[t, node]] > trees.cut[t, node] else 1)
            total += trees.leaf[t, node - 7]
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((scores > 0.5) == labels).mean() > 0.9


def test_cuts_of_constant_and_few_values():
    assert len(cuts_of(np.ones(50), 8)) == 0
    assert cuts_of(np.array([1.0, 2.0] * 20), 8).tolist() == [1.0]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    marked = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(marked) > 40 and sum(p == q for p, q in marked) / len(marked) > 0.9


def test_odd_rows(spark):
    long = "Plain words in a sentence. " * 20000
    rows = [(1, "A good text, of course.", "x"), (1, "A good text, of course.", "x"), (None, None, "y"), (3, "", None), (4, long, "z"), (5, "$$$ %%%", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string")  # a clashing name
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (4, None), (3, 7)], "doc_id long, quality int")
    got = quality_scores(docs, labels, rounds=3, least_weight=0.1).collect()
    assert sorted(((r.doc_id, r.held_out) for r in got), key=str) == sorted(
        ((r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows), key=str)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    same = {r.score for r in got if r.doc_id == 1}
    assert len(same) == 1
    none = quality_scores(docs, labels.where("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert quality_scores(docs.where("false"), labels).collect() == []


def test_sample_is_bounded_and_leaves_held_out_rows_out(spark):
    stats = spark.range(400).selectExpr("id as doc_id", f"transform(sequence(1, {len(STATISTICS)}), x -> cast(id as float)) as stats")
    labels = spark.range(400).selectExpr("id as doc_id", "case when crc32(cast(cast(id as string) as binary)) % 5 = 0 then 0 else 1 end as quality")
    assert len(train(stats, labels, sample_rows=50).leaf) == 0  # the other label is on held-out rows only
    assert train(stats, labels, sample_rows=50).base < train(stats, labels).base
