"""Small-table handling by measured bytes, and cutting lineage on shared storage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark's setting that deletes a query's shuffle files when the query ends, not when the driver collects garbage.
FREED = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}
# Generated methods above 8000 bytes are only interpreted by the JVM; with this limit Spark splits them up.
COMPILED = {"spark__sql__codegen__hugeMethodLimit": "8000"}
_LOCK, _HELD = threading.Lock(), {}


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join with a side that is usually tiny.

    The small side is settled first, so the planner knows its size in bytes: it is sent to every
    task if that is below the session's broadcast limit, and the big side is then not shuffled.
    Otherwise it is an ordinary join and AQE splits skewed keys. No row passes through the driver.
    """
    return big.join(settle(small), on, how)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
    folder = tempfile.mkdtemp(prefix="creditloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _written(df: DataFrame) -> str:
    """Writes the rows to a new folder; the shuffles behind them go as soon as they are written."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/creditloom/{uuid.uuid4().hex}"
    with settings(spark, **FREED):
        df.write.parquet(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Later branches neither recompute nor drift, executors may be lost, and the planner gets
    column pruning and real sizes, which a checkpointed RDD would not offer.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written(df))


@contextmanager
def settled(df: DataFrame) -> Iterator[DataFrame]:
    """Rows as ``settle`` keeps them, for the length of a block; nothing made of them may be read later."""
    spark, path = df.sparkSession, _written(df)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for what runs inside; names have ``__`` for a dot. The former ones come back when the
    last of several threads leaves."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    with _LOCK:
        for k, v in names.items():
            held = _HELD.setdefault(k, [0, spark.conf.get(k, None)])
            held[0] += 1
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _LOCK:
            for k in names:
                held = _HELD[k]
                held[0] -= 1
                if not held[0]:
                    before = _HELD.pop(k)[1]
                    spark.conf.unset(k) if before is None else spark.conf.set(k, before)
