"""Reading and writing the tables between the stages.

Every run writes under its own ``run_ts``; "latest" is the largest one, found from the folder
names, so nothing is renamed or linked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.labels import sanitize_name

# Texts that a CSV reader with default settings takes as missing.
NA_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
            "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_csv_text(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV in which 'NA' and empty fields stay text."""
    reader = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "")
    # Unquoted empty fields arrive as nulls whatever the null marker is.
    return (reader.schema(schema) if schema else reader).csv(path).fillna("")


def read_csv_nulls(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV in which 'NA', 'null', empty fields and the like are null."""
    df = read_csv_text(spark, path)
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(NA_TEXTS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    if schema is None:
        return df
    wanted = T.StructType.fromDDL(schema)
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields])


def sanitize_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[sanitize_name(c) for c in df.columns])


def write_table(df: DataFrame, path: str, run_ts: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Write one run's table; a rerun of the same run replaces it."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{path}/run_ts={run_ts}")


def write_split(df: DataFrame, path: str, run_ts: str) -> None:
    """Train and test rows of a run as partitions of one table."""
    write_table(df, path, run_ts, ["split"])


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest run."""
    df = spark.read.option("recursiveFileLookup", False).parquet(path)
    newest = df.select(F.max(F.col("run_ts").cast("string"))).first()[0]
    return df.where(F.col("run_ts").cast("string") == newest)


def write_report(df: DataFrame, path: str, phase: str, kind: str, run_ts: str) -> None:
    """Append a report table under its phase, kind and run."""
    df.withColumns({"phase": F.lit(phase), "kind": F.lit(kind), "run_ts": F.lit(run_ts)}).write.mode("append").partitionBy(
        "phase", "kind", "run_ts").parquet(path)


def read_latest_report(spark: SparkSession, path: str, phase: str, kind: str) -> DataFrame:
    df = spark.read.option("mergeSchema", True).parquet(path).where((F.col("phase") == phase) & (F.col("kind") == kind))
    newest = df.select(F.max(F.col("run_ts").cast("string"))).first()[0]
    return df.where(F.col("run_ts").cast("string") == newest)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_predictions(df: DataFrame, path: str, run_ts: str, id_col: str, label: str) -> None:
    """Ids, true and predicted classes and the class probabilities."""
    write_table(df.select(id_col, F.col(label).alias("y_true"), F.col("prediction").alias("y_pred"), "probability"), path, run_ts)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Nested rows as JSON Lines."""
    df.write.mode("overwrite").json(path)


def append_history(results: DataFrame, path: str, run_ts: str, args: str = "{}", n: int = 5) -> None:
    """Snapshot a search run's results under ``path/results`` and add its entry to ``path/history``. A
    rerun under the same ``run_ts`` replaces its snapshot; its entry is added again, the newest counts."""
    from creditloom.operators.candidates import history_entry

    write_table(results, f"{path}/results", run_ts)
    append_rows(history_entry(results, run_ts, args, n).withColumn("written", F.current_timestamp()), f"{path}/history")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of every run."""
    df = spark.read.parquet(f"{path}/history")
    rest = [c for c in df.columns if c not in ("run_ts", "written")]
    return df.groupBy("run_ts").agg(F.max_by(F.struct(*rest), "written").alias("_e")).select("run_ts", "_e.*")
