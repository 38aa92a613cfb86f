"""Access to the benchmark tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from creditloom.operators.sizing import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, which every executor can reach."""
    return f"{checkpoint_dir(spark).rstrip('/')}/creditloom/{name}-{uuid.uuid4().hex}"
