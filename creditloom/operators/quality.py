"""Data-quality checks. Every check is one aggregation pass over the table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.operators.scans import prefix_scan, range_chunks
from creditloom.operators.sizing import settle

SAMPLE_VALUES = 20
REPORT_SCHEMA = "`check` string, severity string, `column` string, metric double, detail string"


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def _integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.IntegralType, T.BooleanType))


def _null(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    return col.isNull() | F.isnan(col) if _floating(df.schema[c].dataType) else col.isNull()


def _infinite(df: DataFrame, c: str) -> Column:
    if not _floating(df.schema[c].dataType):
        return F.lit(False)
    return F.abs(F.col(f"`{c}`")) == F.lit(float("inf"))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise unless every column is present and free of nulls; returns the frame unchanged."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if columns:
        counts = df.agg(*[F.count_if(_null(df, c)).alias(c) for c in dict.fromkeys(columns)]).first()
        bad = {c: counts[c] for c in dict.fromkeys(columns) if counts[c]}
        if bad:
            raise ValueError(f"columns with nulls: {bad}")
    return df


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, null/NaN count, infinite count."""
    cols = list(columns or df.columns)
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(_null(df, c)).alias(f"_a{i}"), F.count_if(_infinite(df, c)).alias(f"_b{i}")]
    lines = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"), F.col(f"_a{i}").alias("n_null"),
                 F.col(f"_b{i}").alias("n_inf"))
        for i, c in enumerate(cols)
    ])
    return df.agg(*aggs).select(F.explode(lines).alias("x")).select("x.*")


def sample_values(df: DataFrame, column: str, limit: int = SAMPLE_VALUES) -> DataFrame:
    """The smallest few distinct values of a column, for reports on bad columns."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(limit)


def validate_frame(df: DataFrame, stage: str = "input", categorical: Sequence[str] = (),
                   ohe: Sequence[str] = (), label_rows: int | None = None) -> DataFrame:
    """Long report of everything wrong with a frame; no rows means it passed.

    Errors: empty table, absent categorical or encoded columns, nulls, infinities, row-count
    mismatch with the labels. Warnings: non-integer categorical columns. Issues: encoded values
    outside {0, 1} and duplicate column names.
    """
    spark, cols = df.sparkSession, list(dict.fromkeys(df.columns))
    fixed: list[tuple] = []
    for kind, names in (("categorical", categorical), ("one_hot", ohe)):
        fixed += [("missing_" + kind, "error", c, None, f"{stage}: column is absent") for c in names if c not in cols]
    for c in categorical:
        if c in cols and not _integral(df.schema[c].dataType):
            fixed.append(("categorical_type", "warning", c, None, df.schema[c].dataType.simpleString()))
    for c in sorted({c for c in df.columns if df.columns.count(c) > 1}):
        fixed.append(("duplicate_column", "issue", c, float(df.columns.count(c)), stage))
    if len(cols) != len(df.columns):  # names that repeat get their place, and are checked like the rest
        seen: dict[str, int] = {}
        names = []
        for c in df.columns:
            seen[c] = seen.get(c, 0) + 1
            names.append(c if seen[c] == 1 else f"{c}#{seen[c]}")
        df, cols = df.toDF(*names), names

    present_ohe = [c for c in ohe if c in cols]
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(_null(df, c)).alias(f"_a{i}"), F.count_if(_infinite(df, c)).alias(f"_b{i}")]
    for i, c in enumerate(present_ohe):
        odd = F.col(c).isNotNull() & ~F.col(c).cast("double").isin(0.0, 1.0)
        aggs.append(F.count_if(odd).alias(f"_o{i}"))

    def line(check, severity, column, metric, detail):
        return F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"),
                        F.lit(column).alias("column"), metric.cast("double").alias("metric"),
                        F.lit(detail).alias("detail"))

    n = F.col("_n")
    lines = [F.when(n == 0, line("empty", "error", None, n, stage))]
    if label_rows is not None:
        lines.append(F.when(n != label_rows, line("length_mismatch", "error", None, n, f"{label_rows} labels")))
    for i, c in enumerate(cols):
        lines.append(F.when(F.col(f"_a{i}") > 0, line("null", "error", c, F.col(f"_a{i}"), stage)))
        lines.append(F.when(F.col(f"_b{i}") > 0, line("infinite", "error", c, F.col(f"_b{i}"), stage)))
    for i, c in enumerate(present_ohe):
        lines.append(F.when(F.col(f"_o{i}") > 0, line("non_binary", "issue", c, F.col(f"_o{i}"), stage)))
    found = df.agg(*aggs).select(F.explode(F.array_compact(F.array(*lines))).alias("x")).select("x.*")
    return found.unionByName(spark.createDataFrame(fixed, REPORT_SCHEMA)) if fixed else found


def passed(report: DataFrame) -> bool:
    return report.isEmpty()


def validate_model_input(df: DataFrame, label: str, features: Sequence[str], **kwargs) -> DataFrame:
    """Frame checks on the features plus too few rows (warning) and too small a class (issue)."""
    report = validate_frame(df.select(*features), "pipeline_input", **kwargs)
    counts = df.groupBy(label).agg(F.count("*").alias("_k")).agg(F.sum("_k").alias("n"), F.min("_k").alias("low"))
    extra = F.array_compact(F.array(
        F.when(F.coalesce("n", F.lit(0)) < 10, F.struct(
            F.lit("few_rows").alias("check"), F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("column"),
            F.col("n").cast("double").alias("metric"), F.lit("results may be unreliable").alias("detail"))),
        F.when(F.coalesce("low", F.lit(0)) < 2, F.struct(
            F.lit("small_class").alias("check"), F.lit("issue").alias("severity"), F.lit(label).alias("column"),
            F.col("low").cast("double").alias("metric"), F.lit("too small for cross-validation").alias("detail"))),
    ))
    return report.unionByName(counts.select(F.explode(extra).alias("x")).select("x.*"))


def cross_products(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_a, column_b, n, sa, sb, saa, sbb, sab`` of every pair of columns, each with those behind it: the sums of
    both, of their squares and of their products, from one pass over the table for any number of columns.

    Nulls and NaN count as 0. Values are taken relative to some row, which changes neither variances nor
    covariances and keeps large values from cancelling. Each task adds up its rows as matrix products and
    hands on one row per pair. An empty table gives no rows.
    """
    columns = list(columns)
    filled = df.select(*[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    first = filled.first() if len(columns) > 1 else None
    schema = "column_a string, column_b string, n long, sa double, sb double, saa double, sbb double, sab double"
    if first is None:
        return df.sparkSession.createDataFrame([], schema)
    origin = np.nan_to_num(np.array(first, dtype=np.float64), posinf=0.0, neginf=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(len(columns)), np.zeros((len(columns), len(columns)))
        for batch in batches:
            x = np.column_stack([c.to_numpy() for c in batch.columns]) - origin
            n += len(x)
            sums += x.sum(axis=0)
            products += x.T @ x
        if n:
            a, b = np.triu_indices(len(columns), 1)
            squares = np.diag(products)
            values = (np.full(len(a), n), sums[a], sums[b], squares[a], squares[b], products[a, b])
            names = [pa.array([columns[i] for i in side], pa.string()) for side in (a, b)]
            yield pa.RecordBatch.from_arrays([*names, *map(pa.array, values)], ["column_a", "column_b", "n", "sa", "sb", "saa", "sbb", "sab"])

    sums = ["n", "sa", "sb", "saa", "sbb", "sab"]
    return filled.mapInArrow(run, schema).groupBy("column_a", "column_b").agg(*[F.sum(c).alias(c) for c in sums])


def pair_correlations(df: DataFrame, columns: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Pearson correlation of every column pair (nulls count as 0), in one pass; null where a column is constant,
    NaN where one holds infinities."""
    s = cross_products(df, columns)
    spread = lambda q, x: F.col(q) - F.col(x) * F.col(x) / F.col("n")
    below = F.sqrt(spread("saa", "sa")) * F.sqrt(spread("sbb", "sb"))
    r = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.when(below != 0, below)
    kept = F.when(F.isnan(r), r).otherwise(F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))
    out = s.select("column_a", "column_b", kept.alias("correlation"))
    return out if threshold is None else out.where(F.abs("correlation") >= threshold)


def compare_frames(before: DataFrame, after: DataFrame, corr_threshold: float = 0.95) -> DataFrame:
    """Long report of what a step changed: columns, types, new bad values, correlated pairs."""
    spark = before.sparkSession
    b, a = set(before.columns), set(after.columns)
    fixed = [("column_added", "info", c, None, "") for c in sorted(a - b)]
    fixed += [("column_removed", "info", c, None, "") for c in sorted(b - a)]
    common = [c for c in before.columns if c in a]
    for c in common:
        old, new = before.schema[c].dataType, after.schema[c].dataType
        if old != new:
            lossy = _integral(old) and not _integral(new)
            fixed.append(("type_change", "error" if lossy else "warning", c, None,
                          f"{old.simpleString()} -> {new.simpleString()}"))
    numeric = [c for c in common if c in _numeric(before) and c in _numeric(after)]
    report = spark.createDataFrame(fixed, REPORT_SCHEMA)
    if numeric:
        bad = lambda d: column_profile(d, numeric).select("column", (F.col("n_null") + F.col("n_inf")).alias("n_bad"))
        both = bad(before).alias("x").join(bad(after).alias("y"), "column")
        gained = both.where("y.n_bad > x.n_bad").select(
            F.lit("new_bad_values").alias("check"), F.lit("error").alias("severity"), "column",
            (F.col("y.n_bad") - F.col("x.n_bad")).cast("double").alias("metric"), F.lit("null, NaN or infinite").alias("detail"))
        report = report.unionByName(gained)
    shared = [c for c in common if c in _numeric(after)]
    if len(shared) > 1:
        high = pair_correlations(after, shared, corr_threshold).select(
            F.lit("high_correlation").alias("check"), F.lit("issue").alias("severity"), F.col("column_a").alias("column"),
            F.abs("correlation").alias("metric"), F.col("column_b").alias("detail"))
        report = report.unionByName(high)
    return report


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles (linear between ranks) and max per column.

    Values are counted before they are ranked, and ranks come from range pieces with carried
    totals, so no column is sorted in one task.
    """
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null")
    counts = settle(values.groupBy("column", "v").agg(F.count("*").alias("k")))
    moments = values.groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    pieces = range_chunks(counts, ["column", "v"])
    ranked = prefix_scan(pieces, ["column"], "_chunk", ["v"], {"_to": ("sum", F.col("k"), True)})
    totals = counts.groupBy("column").agg(F.sum("k").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    at = ranked.join(totals.select("column", "n"), "column")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_to") - F.col("k") <= rank) & (rank < F.col("_to")), F.col("v")))

    ends = {}
    for q in (25, 50, 75):
        place = (F.col("n") - 1) * F.lit(q / 100)
        ends |= {f"_l{q}": value_at(F.floor(place)), f"_h{q}": value_at(F.ceil(place))}
    found = at.groupBy("column", "n").agg(*[c.alias(name) for name, c in ends.items()])
    share = lambda q: (F.col("n") - 1) * F.lit(q / 100) % 1
    quartiles = {f"q{q}": F.col(f"_l{q}") + share(q) * (F.col(f"_h{q}") - F.col(f"_l{q}")) for q in (25, 50, 75)}
    out = totals.join(moments, "column").join(found.drop("n"), "column").withColumns(quartiles)
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return listed.join(out, "column", "left").select(
        "column", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "min", "q25", "q50", "q75", "max")


def to_integers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast columns to int after checking that none holds a null, NaN or infinity."""
    profile = column_profile(df, columns).where("n_null + n_inf > 0").select("column").collect()
    if profile:
        raise ValueError(f"not finite: {sorted(r[0] for r in profile)}")
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


class StepLog:
    """Row and column counts, durations and small snapshots of a chain of steps.

    Counting is its own job, so log settled tables: there it reads only the file footers. (An
    attached Observation would count for free, but a session that has used one can no longer
    ship fitted ensemble models to its tasks.)
    """

    def __init__(self) -> None:
        self._steps: list[tuple[str, int, int, float, str]] = []
        self.snapshots: dict[str, dict] = {}

    def record(self, df: DataFrame, step: str, seconds: float = 0.0, status: str = "success") -> DataFrame:
        """Log a step's output and pass it on."""
        self._steps.append((step, df.count(), len(df.columns), float(seconds), status))
        return df

    def snapshot(self, df: DataFrame, step: str) -> None:
        """Column types and three sample rows."""
        self.snapshots[step] = {"types": dict(df.dtypes), "sample": [r.asDict() for r in df.limit(3).collect()]}

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self._steps, "step string, n_rows bigint, n_columns int, seconds double, status string")
