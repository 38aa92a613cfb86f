import numpy as np

from creditloom.operators.quality import cross_products, pair_correlations


def test_three_hundred_columns_in_one_pass(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 300)) + 1e6
    x[:, 7] = x[:, 3] * -2
    names = [f"a.{i}" for i in range(300)]
    df = spark.createDataFrame(x.tolist(), names).repartition(4)
    want = np.corrcoef(x, rowvar=False)
    got = pair_correlations(df, names)
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    rows = got.collect()
    assert len(rows) == 300 * 299 // 2
    assert all(abs(r.correlation - want[names.index(r.column_a), names.index(r.column_b)]) < 1e-7 for r in rows)
    assert [(r.column_a, r.column_b) for r in pair_correlations(df, names, 0.95).collect()] == [("a.3", "a.7")]


def test_odd_columns(spark):
    rows = [(1.0, 5, None, 2.0), (2.0, 5, float("nan"), float("inf")), (3.5, 5, 4.0, 1.0), (None, 5, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, same int, b double, infinite double")
    got = {(r.column_a, r.column_b): r.correlation for r in pair_correlations(df, df.columns).collect()}
    assert abs(got["a", "b"] - np.corrcoef([1, 2, 3.5, 0], [0, 0, 4, 1])[0, 1]) < 1e-12
    assert got["a", "same"] is None and np.isnan(got["a", "infinite"])
    assert pair_correlations(df, ["a"]).collect() == [] and pair_correlations(df.where("false"), df.columns).collect() == []
    one = cross_products(df.limit(1), ["a", "same"]).first()
    assert (one.n, one.saa, one.sab) == (1, 0.0, 0.0)


def test_notes_on_public_records(spark):
    from pyspark.sql import functions as F

    from creditloom.functions.text import public_records

    cases = [("Public Records: 2\nBankruptcy CH-7 Discharged\nmore", (2, "Bankruptcy CH-7 Discharged")), ("public  records 0 bk filed ", (1, "bk filed")),
             ("bkx chapter  13 open", (1, "chapter  13 open")), ("ch- 7", (0, "")), ("CH-13\nchapter 7", (1, "CH-13")), ("none", (0, ""))]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(public_records(F.col("t")).alias("p"))
    assert [tuple(r.p) for r in df.collect()] == [w for _, w in cases]
