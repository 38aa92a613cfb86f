import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators.boosting import BoostSettings, feature_cuts, fit_boosted


def plain(x, y, outputs, s):
    """The same trees by a plain best-first search, for values that are their own bins."""
    margin, trees = np.zeros((len(y), outputs)), []
    shrink = lambda g: np.sign(g) * max(abs(g) - s.reg_alpha, 0)
    strength = lambda g, h: shrink(g) ** 2 / (h + s.reg_lambda) if h + s.reg_lambda > 0 else 0.0
    for _ in range(s.rounds):
        if outputs == 1:
            p = 1 / (1 + np.exp(-margin))
        else:
            e = np.exp(margin - margin.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
        moved, group = margin.copy(), []
        for k in range(outputs):
            g, h = p[:, k] - (y == (1 if outputs == 1 else k)), p[:, k] * (1 - p[:, k])

            def cut(rows):
                best = None
                for f in range(x.shape[1]):
                    for v in np.unique(x[rows, f])[:-1]:
                        left = rows & (x[:, f] <= v)
                        right = rows & ~left
                        gain = 0.5 * (strength(g[left].sum(), h[left].sum()) + strength(g[right].sum(), h[right].sum()) - strength(g[rows].sum(), h[rows].sum()))
                        if min(h[left].sum(), h[right].sum()) >= s.min_child_weight and gain > s.gamma and (best is None or gain > best[0] + 1e-12):
                            best = (gain, f, v, left, right)
                return best

            whole = np.ones(len(y), bool)
            leaves, heap, number, found = {"": whole}, [], 0, {}
            first = cut(whole)
            if first:
                heap.append((-first[0], 0, "", first))
            while heap and len(leaves) < s.num_leaves:
                _, _, path, (gain, f, v, left, right) = heapq.heappop(heap)
                found[path] = (f, v)
                del leaves[path]
                for side, rows in (("L", left), ("R", right)):
                    leaves[path + side] = rows
                    number += 1
                    nxt = cut(rows) if s.max_depth is None or len(path) + 1 < s.max_depth else None
                    if nxt:
                        heapq.heappush(heap, (-nxt[0], number, path + side, nxt))
            for path, rows in leaves.items():
                moved[rows, k] -= s.learning_rate * shrink(g[rows].sum()) / (h[rows].sum() + s.reg_lambda)
            group.append((found, set(leaves)))
        margin = moved
        trees.append(group)
    return margin, trees


@pytest.mark.parametrize("outputs, how", [
    (1, {"num_leaves": 6, "settle_every": 2}), (1, {"num_leaves": 31, "max_depth": 2, "gamma": 0.5}), (3, {"num_leaves": 4, "reg_alpha": 1.0, "reg_lambda": 0.0}),
    (1, {"num_leaves": 5, "min_child_weight": 6.0, "reg_lambda": 5.0})])
def test_trees_equal_a_plain_best_first_search(spark, outputs, how):
    rng = np.random.default_rng(outputs)
    x = np.column_stack([rng.integers(0, 12, 240), rng.integers(0, 5, 240), rng.integers(0, 30, 240)])
    y = ((x[:, 0] > 5) ^ (x[:, 2] > 17)).astype(int) + (x[:, 1] > 3) * (outputs > 1)
    y = np.where(rng.random(240) < 0.1, 0, y)
    s = BoostSettings(rounds=3, learning_rate=0.4, **how)
    rows = spark.createDataFrame([(*map(int, r), f"c{int(c)}", i) for i, (r, c) in enumerate(zip(x, y))], "a int, b int, c int, y string, i int").repartition(5)
    model = fit_boosted(rows, ["a", "b", "c"], "y", s)
    margin, trees = plain(x, y, outputs, s)
    got = {}
    for number, k, path, feature, cut, gain, value in model.rows():
        got.setdefault((number, k), ({}, set()))[feature is None].add(path) if feature is None else got.setdefault((number, k), ({}, set()))[0].update(
            {path: ("abc".index(feature), cut)})
    assert got == {(t, k): ({p: (f, float(v)) for p, (f, v) in found.items()}, leaves) for t, group in enumerate(trees) for k, (found, leaves) in enumerate(group)}
    scored = model.predict(rows).orderBy("i").collect()
    if outputs == 1:
        want = 1 / (1 + np.exp(-margin[:, 0]))
        assert np.allclose([r.probability[1] for r in scored], want)
    else:
        e = np.exp(margin)
        assert np.allclose([r.probability for r in scored], e / e.sum(axis=1, keepdims=True))
    assert np.mean([r.prediction == r.y for r in scored]) > 0.6


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, 1.0, "a"), (float("nan"), 1.0, "a"), (2.0, 1.0, "b"), (3.0, 1.0, "b"), (4.0, 1.0, None)] * 4, "x double, one double, y string")
    model = fit_boosted(rows, ["x", "one"], "y", BoostSettings(rounds=5, min_child_weight=0.1, reg_lambda=0.1))
    assert {(r.y, r.prediction) for r in model.predict(rows).where("y is not null").collect()} == {("a", "a"), ("b", "b")}
    assert model.predict(rows).where("y is null").first().prediction == "b"
    alone = fit_boosted(rows.where("y = 'a'"), ["x", "one"], "y")
    assert alone.trees == [] and alone.classes == ["a"]
    assert fit_boosted(rows.where("false"), ["x"], "y").trees == []
    with pytest.raises(ValueError):
        fit_boosted(rows, ["x"], "y", BoostSettings(bins=1))


def test_cuts(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("few"), F.col("id").cast("double").alias("many"), F.lit(None).cast("double").alias("none"))
    few, many, none = feature_cuts(df, ["few", "many", "none"], 10)
    assert few.tolist() == [0, 1] and none.tolist() == []
    assert len(many) == 9 and np.allclose(many, np.arange(1, 10) * 100, atol=2)


def test_settings_from_published_names():
    s = BoostSettings.from_names({"n_estimators": 5, "max_depth": 4, "gamma": 1, "reg_alpha": 0.5, "min_child_weight": 3, "learning_rate": 0.05})
    assert (s.rounds, s.num_leaves, s.max_depth, s.gamma, s.reg_alpha, s.min_child_weight) == (5, 16, 4, 1, 0.5, 3)
    assert BoostSettings.from_names({"num_leaves": 62, "max_depth": -1}).max_depth is None
    with pytest.raises(ValueError):
        BoostSettings.from_names({"trees": 1})


def test_held_out_accuracy(spark):
    from creditloom.catalog.models import boosted_scores, mark_counts

    scored = boosted_scores(mark_counts(spark, "/root/testdata/sf0.01")).select("quality", "prediction").collect()
    right = sum(r.quality == r.prediction for r in scored) / len(scored)
    assert right > max(0.9, sum(r.quality for r in scored) / len(scored))
