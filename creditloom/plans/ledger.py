"""A ledger of evaluated candidates, so that a search may stop anywhere and go on later.

The ledger is an append-only table of result rows with the key of their candidate. Nothing is ever
rewritten: a row that arrives twice (a retried flush, two searches at once) is settled when reading.
What is left to do is an anti-join of the plan with the keys that have a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "candidate_key"


def candidate_key(scope: str, *columns: str) -> Column:
    """Hash of what tells candidates apart. ``scope`` names the data and settings they share; nulls
    and empty texts differ, and so do texts cut at other places."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", F.lit(scope), *parts), 256)


def open_ledger(spark: SparkSession, path: str, schema: str) -> None:
    """Create the ledger unless it exists."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(path)


def commit(rows: DataFrame, path: str) -> None:
    """Add result rows. Spark's commit protocol makes them visible together or not at all."""
    rows.write.mode("append").parquet(path)


def settled_rows(ledger: DataFrame, score: str = "mean_f1", time: str = "timestamp") -> DataFrame:
    """One row per candidate: one with a score before one without, then the earliest, then the
    least by its other atomic columns, so that any order of commits gives the same rows."""
    failed = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")).isNull()
    rest = [c for c in ledger.columns if c != KEY]
    first = F.min_by(F.struct(*rest), F.struct(failed, F.col(time), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest]))
    return ledger.groupBy(KEY).agg(first.alias("_row")).select(KEY, "_row.*")


def unfinished(plan: DataFrame, ledger: DataFrame, retry_failed: bool = False, score: str = "mean_f1") -> DataFrame:
    """Planned candidates without a row in the ledger; with ``retry_failed`` also those that only failed."""
    done = ledger
    if retry_failed:
        done = ledger.where(F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")).isNotNull())
    return plan.join(done.select(KEY).distinct(), KEY, "left_anti")


def planned_results(plan: DataFrame, ledger: DataFrame, score: str = "mean_f1", time: str = "timestamp") -> DataFrame:
    """The plan's candidates that have a row, with its columns. A candidate planned twice appears twice."""
    rows = settled_rows(ledger, score, time)
    return plan.join(rows.select(KEY, *[c for c in rows.columns if c != KEY and c not in plan.columns]), KEY)
