import math
import random

import pytest
from pyspark.sql import functions as F

from creditloom.operators import balance as B
from creditloom.operators import candidates as C
from creditloom.operators import feature_scores as S
from creditloom.operators import quality as Q
from creditloom.operators.nearest import nearest_in_group
from creditloom.operators.splits import stratified_folds, train_test_split


def points(spark, n=600, seed=3, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = (5.0, 5.0) if rng.random() < hot else (float(rng.randint(0, 40)), float(rng.randint(0, 40)))
        rows.append((i, "a" if i % 3 else "b", x, y, rng.choice("uv")))
    return rows, spark.createDataFrame(rows, "id int, g string, x double, y double, c string")


@pytest.mark.parametrize("cell_rows", [5, 40, 2000])
def test_nearest_against_all_pairs(spark, cell_rows):
    rows, df = points(spark)
    near = nearest_in_group(df, "id", "g", ["x", "y"], 4, cell_rows=cell_rows)
    got = {r.id: [n["id"] for n in r.neighbours] for r in near.collect()}
    assert len(got) == len(rows)
    for i, g, x, y, _ in rows:
        others = sorted((((x - a) ** 2 + (y - b) ** 2), j) for j, h, a, b, _ in rows if h == g and j != i)
        assert got[i] == [j for _, j in others[:4]]


def test_nearest_with_categories(spark):
    rows, df = points(spark, 200, hot=0.2)
    near = nearest_in_group(df, "id", "g", ["x", "y"], 3, ["c"], {"a": 2.5, "b": 4.0}, cell_rows=10)
    got = {r.id: [n["id"] for n in r.neighbours] for r in near.collect()}
    for i, g, x, y, c in rows:
        w = {"a": 2.5, "b": 4.0}[g] ** 2
        others = sorted((((x - a) ** 2 + (y - b) ** 2) + w * (c != d), j) for j, h, a, b, d in rows if h == g and j != i)
        assert got[i] == [j for _, j in others[:3]]


def test_smote_rows_lie_between_neighbours(spark):
    rows, df = points(spark, 300, hot=0.1)
    out = B.smote(df, "g", "id", ["x", "y"], 3).collect()
    at = {r[0]: r for r in rows}
    assert len(out) == 100 and {r.g for r in out} == {"b"}
    for r in out:
        p, q = at[r.id], at[r.neighbour_id]
        assert min(p[2], q[2]) - 1e-9 <= r.x <= max(p[2], q[2]) + 1e-9
        assert p[1] == q[1] == "b"


def test_balance_strategies(spark):
    _, df = points(spark, 120, hot=0.1)
    sizes = lambda d: {r.g: r["count"] for r in d.groupBy("g").count().collect()}
    assert sizes(B.balance(df, "g", "id", ["x", "y"], enabled=False)) == {"a": 80, "b": 40}
    full = B.balance(df, "g", "id", ["x", "y"], ["c"], k=5, min_improvement=0.1)
    assert sizes(full) == {"a": 80, "b": 80} and full.where("c not in ('u', 'v')").count() == 0
    tiny = df.where("g = 'a' or id = 0")
    assert sizes(B.balance(tiny, "g", "id", ["x", "y"])) == {"a": 80, "b": 80}
    same = df.where("id < 60 and (g = 'b' or id < 30)").limit(40).withColumn("g", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    assert B.improvement_gate(0.5, 0.5, 2, 0.01) and not B.improvement_gate(0.3, 0.3, 2, 0.01)
    assert B.adjusted_k(tiny, "g", 5) == 1 and same.count() > 0


def test_many_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(B, "COPIES_PER_TASK", 7)
    df = spark.range(101).selectExpr("id", "case when id = 0 then 'x' else 'y' end g")
    out = B.random_oversample(df, "g", "id")
    assert {r.g: r["count"] for r in out.groupBy("g").count().collect()} == {"x": 100, "y": 100}
    assert out.where("g = 'x'").select("copy_no").distinct().count() == 100


def test_split_and_folds_do_not_depend_on_partitions(spark):
    df = spark.range(997).selectExpr("id", "cast(id % 7 = 0 as int) y")
    for make in (lambda d: train_test_split(d, ["y"], "id"), lambda d: stratified_folds(d, "y", "id", 5)):
        a = sorted(map(tuple, make(df.repartition(3)).collect()))
        assert a == sorted(map(tuple, make(df.repartition(11)).collect())) and len(a) == 997
    sizes = [r["count"] for r in stratified_folds(df, "y", "id", 5).where("y = 1").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_validation(spark):
    df = spark.createDataFrame([(1, 0.5, 2), (2, float("inf"), 1), (3, None, 0)], "a int, b double, f int")
    checks = {(r.check, r.column) for r in Q.validate_frame(df, categorical=["b", "z"], ohe=["f"]).collect()}
    assert {("null", "b"), ("infinite", "b"), ("non_binary", "f"), ("missing_categorical", "z"), ("categorical_type", "b")} == checks
    assert {r.check for r in Q.validate_frame(df.limit(0)).collect()} == {"empty"}
    with pytest.raises(ValueError):
        Q.require_columns(df, ["a", "b"])
    with pytest.raises(ValueError):
        Q.require_columns(df, ["nope"])
    assert Q.passed(Q.validate_frame(df.select("a")))
    log = Q.StepLog()
    log.record(df, "read")
    log.snapshot(df, "read")
    assert log.table(spark).first()["n_rows"] == 3 and len(log.snapshots["read"]["sample"]) == 3


def test_candidates():
    space = {C.MAX_FEATURES: list(range(50)), C.THRESHOLD: [0.25 + 0.0075 * i for i in range(100)], "other": ["a", "b", "c"]}
    got = C.sample_candidates(space, 100, 1)
    assert len(got) == 100 and got == C.sample_candidates(space, 100, 1)
    assert sum(c[C.MAX_FEATURES] is not None for c in got) == 50
    assert all((c[C.MAX_FEATURES] is None) != (c[C.THRESHOLD] is None) for c in got)
    assert C.search_size({"a": [1, 2, 3], "b": 5}) == 4 and len(C.grid({"a": [1, 2], "b": [1, 2, 3]})) == 6
    with pytest.raises(ValueError):
        C.search_size({})


def test_selection():
    names, imp = ["a", "b", "c", "d"], [0.4, 0.1, 0.3, 0.2]
    assert S.select_by_importance(names, imp) == ["a", "c"]
    assert S.select_by_importance(names, imp, "median") == ["a", "c"]
    assert S.select_by_importance(names, imp, 0.2) == ["a", "c", "d"]
    assert S.select_by_importance(names, imp, 0.9, 2) == ["a", "c"]
    with pytest.raises(ValueError):
        S.select_by_importance(names, imp[:2])


def test_k_best_finds_the_signal(spark):
    df = spark.range(400).selectExpr("cast(id % 2 as int) y", "(id % 2) * 5 + rand(1) s", "rand(2) n1", "rand(3) n2")
    for score in S.SCORES:
        assert S.select_k_best(df, "y", ["n1", "s", "n2"], 1, score) == ["s"]
    with pytest.raises(ValueError):
        S.select_k_best(df, "y", ["s"], None)
    assert math.isfinite(S.chi2_scores(df, "y", ["s"]).first()["score"])


def test_balance_refuses_missing_values_and_small_gains(spark):
    rows = [(i, "a" if i < 80 else "b", float(i % 7), float(i % 5), "u" if i % 3 else "v") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double, c string")
    for broken, cats in ((df, ["c", "gone"]), (df.withColumn("c", F.when(F.col("id") > 3, F.col("c"))), ["c"]),
                         (df.withColumn("x", F.when(F.col("id") > 3, F.col("x"))), ["c"]),
                         (df.withColumn("y", F.when(F.col("id") > 3, F.col("y")).otherwise(float("nan"))), ["c"])):
        with pytest.raises(ValueError):
            B.balance(broken, "g", "id", ["x", "y"], cats)
    with pytest.raises(ValueError, match="minority share"):
        B.balance(df, "g", "id", ["x", "y"], ["c"], min_improvement=0.6)
    even = df.where("id < 40 or id >= 80")
    assert B.balance(even, "g", "id", ["x", "y"], ["c"]).count() == 80


def test_duplicate_names_are_checked_like_the_rest(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 3, float("inf"))], "a int, b int, c double").toDF("a", "b", "b")
    found = {(r.check, r.column) for r in Q.validate_frame(df).collect()}
    assert ("duplicate_column", "b") in found and any(c == "b#2" for _, c in found) and len(found) >= 3


def test_exact_quartiles(spark):
    import numpy as np

    v = [3.0, 1.0, 1.0, 10.0, -4.0, 2.5, 8.0]
    df = spark.createDataFrame([(x, None) for x in v], "x double, y double")
    got = {r["column"]: r for r in Q.numeric_summary(df, ["x", "y"]).collect()}
    assert [got["x"][q] for q in ("q25", "q50", "q75")] == list(np.quantile(v, [0.25, 0.5, 0.75]))
    assert got["y"].n == 0 and got["y"].q50 is None


def test_neighbours_merge_equal_rows_once(spark, monkeypatch):
    """The grid, which reads the points again and again, gets them as written rows."""
    from creditloom.operators import nearest as N
    seen, grid = [], N._grid
    monkeypatch.setattr(N, "_grid", lambda points, *a: seen.append(points) or grid(points, *a))
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i // 4)) for i in range(40)], "id long, g string, x double")
    near = {r.id: [n.id for n in r.neighbours] for r in nearest_in_group(df, "id", "g", ["x"], 1, cell_rows=5).collect()}
    assert near == {i: [i ^ 2] for i in range(40)}
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
