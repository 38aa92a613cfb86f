"""Combining the class probabilities of several models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average_probabilities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Soft vote: mean of the probability arrays; the first of equal classes wins."""
    zipped = F.arrays_zip(*columns)
    mean = F.transform(zipped, lambda z: sum((z[c] for c in columns), F.lit(0.0)) / len(columns))
    out = df.withColumn("probability", mean)
    best = F.array_position("probability", F.array_max("probability")) - 1
    return out.withColumn("prediction", best.cast("int"))


def majority_vote(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hard vote over prediction columns, ties going to the smallest class."""
    votes = F.array(*[F.col(c).cast("int") for c in columns])
    tally = F.transform(
        F.array_distinct(votes),
        lambda v: F.struct((-F.size(F.filter(votes, lambda x: x == v))).alias("n"), v.alias("v")),
    )
    return df.withColumn("prediction", F.array_min(tally)["v"])
