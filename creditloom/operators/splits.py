"""Exact stratified splits and folds.

A row's place in its stratum is its rank by md5(seed:id). Only the ranks where one part ends
and the next begins matter, so the rows at those ranks are found from small per-bucket counts
and every other row is compared with them. Rows are never sorted or shuffled by stratum,
however large one stratum is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditloom.functions.hashing import draw_hex
from creditloom.operators.sizing import join_small, settle, settled


BUCKET_ROWS = 10_000


def _keyed(df: DataFrame, strata: Sequence[str], id_col: str, seed) -> DataFrame:
    return df.select(
        F.struct(*strata).alias("_s"),
        draw_hex(seed, F.col(id_col)).alias("_h"),
        F.col(id_col).alias("_id"),
    )


def rank_cuts(df: DataFrame, strata: Sequence[str], id_col: str, seed,
              ranks: Callable[[Column], list[Column]], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per stratum: its size ``_n`` and ``_cuts``, the (hash, id) found at each requested rank.

    ``ranks`` gets the stratum size and returns 1-based rank columns; a rank of 0 has no row
    and is left out. Result: one row per stratum.
    """
    with settled(_keyed(df, strata, id_col, seed)) as keyed:
        return settle(_found(keyed, ranks, bucket_rows))


def _found(keyed: DataFrame, ranks: Callable[[Column], list[Column]], bucket_rows: int) -> DataFrame:
    largest = keyed.groupBy("_s").agg(F.count("*").alias("_k")).agg(F.max("_k")).first()[0] or 0
    # As many hash digits as keep a bucket of the largest stratum near ``bucket_rows`` rows.
    digits = max(1, math.ceil(math.log(max(1, largest / bucket_rows), 16)))
    rows = keyed.withColumn("_b", F.substring("_h", 1, digits))
    upto = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = (
        rows.groupBy("_s", "_b").agg(F.count("*").alias("_k"))
        .withColumn("_before", F.coalesce(F.sum("_k").over(upto), F.lit(0)))
        .withColumn("_n", F.sum("_k").over(W.partitionBy("_s")))
    )
    wanted = F.array(*[
        F.struct(F.lit(i).alias("q"), r.cast("bigint").alias("rank"))
        for i, r in enumerate(ranks(F.col("_n")))
    ])
    hits = counts.select(
        "_s", "_b", "_before", "_n",
        F.filter(
            wanted, lambda x: (x["rank"] > F.col("_before")) & (x["rank"] <= F.col("_before") + F.col("_k"))
        ).alias("_want"),
    )
    sizes = hits.groupBy("_s").agg(F.max("_n").alias("_n"))
    border = join_small(rows, hits.where(F.size("_want") > 0), ["_s", "_b"], "inner")
    place = F.row_number().over(W.partitionBy("_s", "_b").orderBy("_h", "_id")) + F.col("_before")
    found = (
        border.withColumn("_r", place)
        .withColumn("_hit", F.filter("_want", lambda x: x["rank"] == F.col("_r")))
        .where(F.size("_hit") > 0)
        .select("_s", F.explode("_hit").alias("_x"), "_h", "_id")
        .groupBy("_s")
        .agg(F.sort_array(F.collect_list(
            F.struct(F.col("_x.q").alias("q"), F.col("_h").alias("h"), F.col("_id").alias("id"))
        )).alias("_cuts"))
    )
    return sizes.join(found, "_s", "left")


def with_cuts(df: DataFrame, cuts: DataFrame, strata: Sequence[str], id_col: str, seed) -> DataFrame:
    """Attach each row's stratum size, cut list and own (hash, id) key."""
    keyed = df.withColumns({
        "_s": F.struct(*strata),
        "_me": F.struct(draw_hex(seed, F.col(id_col)).alias("h"), F.col(id_col).alias("id")),
    })
    return keyed.join(cuts, "_s", "left")


def _after(cut: Column) -> Column:
    return F.struct(cut["h"].alias("h"), cut["id"].alias("id")) < F.col("_me")


def train_test_split(df: DataFrame, strata: Sequence[str], id_col: str, test_fraction: float = 0.25,
                     seed=42, singletons: str = "train") -> DataFrame:
    """Add ``split`` (train/test), exact per stratum: round(fraction * size) rows are test.

    A stratum with one row stays in train; ``singletons="both"`` puts it on both sides.
    """
    if singletons not in ("train", "both"):
        raise ValueError("singletons must be 'train' or 'both'")
    quota = lambda n: [F.round(n * F.lit(test_fraction)).cast("bigint")]
    cuts = rank_cuts(df, strata, id_col, seed, quota)
    rows = with_cuts(df, cuts, strata, id_col, seed)
    cut = F.get(F.col("_cuts"), 0)
    side = F.when(cut.isNotNull() & ~_after(cut), "test").otherwise("train")
    if singletons == "both":
        sides = F.when(F.col("_n") == 1, F.array(F.lit("train"), F.lit("test"))).otherwise(F.array(side))
        rows = rows.withColumn("split", F.explode(sides))
    else:
        rows = rows.withColumn("split", side)
    return rows.drop("_s", "_me", "_n", "_cuts")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed=42) -> DataFrame:
    """Add ``fold`` in 0..k-1; fold sizes within a class differ by at most one."""
    ends = lambda n: [F.ceil(n * F.lit(f) / F.lit(k)) for f in range(1, k)]
    cuts = rank_cuts(df, [label], id_col, seed, ends)
    rows = with_cuts(df, cuts, [label], id_col, seed)
    passed = F.size(F.filter(F.coalesce(F.col("_cuts"), F.array().cast(cuts.schema["_cuts"].dataType)), _after))
    return rows.withColumn("fold", passed).drop("_s", "_me", "_n", "_cuts")


def rare_strata(df: DataFrame, strata: Sequence[str], minimum: int = 2) -> DataFrame:
    """Rows whose stratum has fewer than ``minimum`` rows, by a semi-join with the rare keys."""
    rare = df.groupBy(*strata).agg(F.count("*").alias("_k")).where(F.col("_k") < minimum).drop("_k")
    return join_small(df, rare, list(strata), "left_semi")


def stratum_counts(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    key = F.concat_ws("_", *[F.col(c).cast("string") for c in strata])
    return df.groupBy(key.alias("stratum")).agg(F.count("*").alias("n_rows"))
