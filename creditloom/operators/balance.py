"""Class balance: counts, oversampling, synthetic minority rows and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.hashing import index_draw, unit_draw
from creditloom.operators.nearest import nearest_in_group
from creditloom.operators.sizing import join_small, settle
from creditloom.operators.splits import rank_cuts, with_cuts

COPIES_PER_TASK = 10_000


def class_counts(df: DataFrame, label: str, warn_below: int = 5) -> DataFrame:
    """Rows per class, with a flag on classes too small for folds or neighbours."""
    return (
        df.groupBy(label).agg(F.count("*").alias("n_rows"))
        .withColumn("too_small", F.col("n_rows") < warn_below)
    )


def minority_share(df: DataFrame, label: str) -> DataFrame:
    """One row: classes, rows, smallest class and its share."""
    counts = df.groupBy(label).agg(F.count("*").alias("_k"))
    return counts.agg(
        F.count("*").alias("n_classes"), F.sum("_k").alias("n_rows"),
        F.min("_k").alias("min_rows"), F.max("_k").alias("max_rows"),
        (F.min("_k") / F.sum("_k")).alias("minority_share"),
    )


def class_weight_table(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """A row per class with its 'balanced' weight: rows / (classes * rows of the class)."""
    counts = settle(df.groupBy(label).agg(F.count("*").alias("_k")))
    total, classes = counts.agg(F.sum("_k"), F.count("*")).first()
    return counts.select(label, (F.lit(float(total or 0)) / (F.lit(classes) * F.col("_k"))).alias(weight))


def class_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Add rows / (classes * rows of the class), the 'balanced' weight."""
    return join_small(df, class_weight_table(df, label, weight), label)


def adjusted_k(df: DataFrame, label: str, k: int) -> int:
    """k, lowered to the smallest class size minus one (at least 1) when it does not fit."""
    smallest = minority_share(df, label).first()["min_rows"] or 0
    return k if k < smallest else max(1, smallest - 1)


def _copies(df: DataFrame, label: str, id_col: str, seed) -> tuple[DataFrame, int]:
    """Attach ``_copies``: how many extra rows each row stands for, so classes reach the largest.

    The shortfall is spread evenly; the remainder goes to the first rows in hash order.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("_k"))
    low, top = sizes.agg(F.min("_k"), F.max("_k")).first()
    top = top or 0
    spare = lambda n: (F.lit(top) - n)
    cuts = rank_cuts(df, [label], id_col, seed, lambda n: [spare(n) % n])
    rows = with_cuts(df, cuts, [label], id_col, seed)
    cut = F.get(F.col("_cuts"), 0)
    extra = cut.isNotNull() & (F.col("_me") <= F.struct(cut["h"].alias("h"), cut["id"].alias("id")))
    n = F.col("_n")
    rows = rows.withColumn("_copies", F.floor(spare(n) / n) + F.when(extra, 1).otherwise(0))
    return rows.drop("_s", "_me", "_n", "_cuts"), (-(-top // low) if low else 0)


def _explode_copies(df: DataFrame, id_col: str, first: int, most: int, out: str) -> DataFrame:
    """One row per copy number ``first``..``_copies``; huge copy counts are spread over tasks."""
    last = F.col("_copies").cast("bigint")
    if most <= COPIES_PER_TASK:
        numbers = F.when(last >= first, F.sequence(F.lit(first).cast("bigint"), last))
        return df.withColumn(out, F.explode(numbers))
    step = F.lit(COPIES_PER_TASK).cast("bigint")
    starts = F.when(last >= first, F.sequence(F.lit(first).cast("bigint"), last, step))
    pieces = df.withColumn("_start", F.explode(starts)).repartition(F.col(id_col), F.col("_start"))
    numbers = F.sequence(F.col("_start"), F.least(F.col("_start") + step - 1, last))
    return pieces.withColumn(out, F.explode(numbers)).drop("_start")


def random_oversample(df: DataFrame, label: str, id_col: str, seed=42) -> DataFrame:
    """Duplicate rows until every class is as large as the largest.

    ``copy_no`` is 0 for the original row and 1.. for its duplicates.
    """
    rows, most = _copies(df, label, id_col, seed)
    return _explode_copies(rows, id_col, 0, most, "copy_no").drop("_copies")


def _synthetic_base(df, label, id_col, num_cols, cat_cols, k, seed, penalty):
    rows, most = _copies(df, label, id_col, seed)
    wanted = rows.where(F.col("_copies") > 0)
    # Only classes that grow need neighbours; all their rows are candidates.
    grow = settle(wanted.select(label).distinct())
    members = join_small(df, grow, label, "left_semi")
    near = nearest_in_group(members, id_col, label, num_cols, k, cat_cols, penalty)
    base = near.join(wanted.select(id_col, "_copies"), id_col).where(F.size("neighbours") > 0)
    return _explode_copies(base, id_col, 1, most, "copy_no")


def _interpolated(num_cols: Sequence[str], seed, id_col: str, pick: Column) -> list[Column]:
    u = unit_draw(f"{seed}-gap", F.col(id_col), F.col("copy_no"))
    return [
        (F.get("x", i) + u * (F.get(pick["x"], i) - F.get("x", i))).alias(c)
        for i, c in enumerate(num_cols)
    ]


def smote(df: DataFrame, label: str, id_col: str, num_cols: Sequence[str], k: int = 5,
          seed=42) -> DataFrame:
    """Synthetic rows that bring every class to the size of the largest (Chawla et al. 2002).

    Each synthetic row is base + u * (neighbour - base), the neighbour being one of the base
    row's k nearest in its class; the choice and u come from md5(seed, id, copy). Returns the
    synthetic rows only: base id, copy_no, neighbour_id, label and the numeric columns.
    """
    base = _synthetic_base(df, label, id_col, num_cols, (), k, seed, None)
    pick = F.get("neighbours", index_draw(F.size("neighbours"), f"{seed}-pick", F.col(id_col), F.col("copy_no")))
    return base.withColumn("_p", pick).select(
        id_col, "copy_no", F.col("_p.id").alias("neighbour_id"), label,
        *_interpolated(num_cols, seed, id_col, F.col("_p")),
    )


def median_spread(df: DataFrame, label: str, num_cols: Sequence[str]) -> DataFrame:
    """Per class: median over the numeric columns of their standard deviation in the class."""
    from creditloom.functions.numeric import row_median

    sds = df.groupBy(label).agg(*[F.stddev_pop(c).alias(f"_sd_{c}") for c in num_cols])
    spread = row_median([F.col(f"_sd_{c}") for c in num_cols], ignore=(-1.0,), missing=0.0)
    return sds.select(label, spread.alias("spread"))


def smote_nc(df: DataFrame, label: str, id_col: str, num_cols: Sequence[str], cat_cols: Sequence[str],
             k: int = 5, seed=42) -> DataFrame:
    """Mixed-type synthetic rows.

    A differing nominal column adds the class's median numeric spread to the distance;
    nominal values are the neighbours' majority, ties going to the smallest value.
    """
    spread = {r[0]: r[1] for r in median_spread(df, label, num_cols).collect()}
    base = _synthetic_base(df, label, id_col, num_cols, cat_cols, k, seed, spread)
    pick = F.get("neighbours", index_draw(F.size("neighbours"), f"{seed}-pick", F.col(id_col), F.col("copy_no")))

    def majority(i: int) -> Column:
        votes = F.transform("neighbours", lambda n: F.get(n["c"], i))
        tally = F.transform(
            F.array_distinct(votes),
            lambda v: F.struct((-F.size(F.filter(votes, lambda x: x == v))).alias("n"), v.alias("v")),
        )
        return F.array_min(tally)["v"]

    return base.withColumn("_p", pick).select(
        id_col, "copy_no", F.col("_p.id").alias("neighbour_id"), label,
        *_interpolated(num_cols, seed, id_col, F.col("_p")),
        *[majority(i).cast(df.schema[c].dataType).alias(c) for i, c in enumerate(cat_cols)],
    )


def improvement_gate(before: float, after: float, classes: int, min_improvement: float) -> bool:
    """Whether the minority share grew enough; a set that was balanced already passes."""
    if not min_improvement:
        return True
    if before == after and abs(before - 1.0 / max(classes, 1)) < 1e-12:
        return True
    return before > 0 and after / before - 1.0 >= min_improvement


def balance(df: DataFrame, label: str, id_col: str, num_cols: Sequence[str], cat_cols: Sequence[str] = (),
            enabled: bool = True, method: str = "smotenc", k: int = 5, seed=42,
            min_improvement: float = 0.01, allow_fallback: bool = True) -> DataFrame:
    """Original plus added rows, by the strategy that fits the data.

    Disabled or ``none``: unchanged. Smallest class of one row or not above k: duplicates.
    Categorical columns present and ``smotenc``: mixed synthetic rows. Else plain synthetic rows.
    The result has the input's feature and label columns and ``synthetic``; the id is kept for
    the base row. Raises when a categorical column is absent, when a column holds nulls or NaN, and when
    the minority share, as counted in the result, does not improve by ``min_improvement`` (0: not asked).
    """
    present = [c for c in cat_cols if c in df.columns]
    absent = sorted(set(cat_cols) - set(present))
    if enabled and method != "none" and absent:
        raise ValueError(f"categorical columns are absent: {absent}")
    nums = [c for c in num_cols if c not in present]
    cols = [id_col, label, *nums, *present]
    original = df.select(*cols).withColumn("synthetic", F.lit(False))
    if not enabled or method == "none":
        return original
    before = minority_share(df, label).first()
    smallest = before["min_rows"] or 0
    if before["n_rows"] is None:
        raise ValueError("cannot balance an empty table")
    bad = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in [*nums, *present]]).first().asDict() if nums or present else {}
    if any(bad.values()):
        raise ValueError(f"cannot balance missing values: { {c: n for c, n in bad.items() if n} }")
    use_k = k if k < smallest else max(1, smallest - 1)
    if allow_fallback and (smallest <= 1 or smallest <= use_k):
        extra = random_oversample(df.select(*cols), label, id_col, seed).where("copy_no > 0")
    elif present and method == "smotenc":
        extra = smote_nc(df, label, id_col, nums, present, use_k, seed)
    else:
        extra = smote(df, label, id_col, [*nums, *present], use_k, seed)
    full = original.unionByName(
        extra.select(*[F.col(c).cast(df.schema[c].dataType) if c in present else F.col(c) for c in cols])
        .withColumn("synthetic", F.lit(True))
    )
    if not min_improvement:
        return full
    full = settle(full)
    after = minority_share(full, label).first()["minority_share"]
    if not improvement_gate(before["minority_share"], after, before["n_classes"], min_improvement):
        raise ValueError(f"the minority share went from {before['minority_share']:.6f} to {after:.6f}, less than {min_improvement} more")
    return full


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def resampling_summary(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Per class: rows before, after and added, and the change of the class share."""
    both = (
        before.select(label, F.lit(1).alias("_b"), F.lit(0).alias("_a"))
        .unionByName(after.select(label, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
        .groupBy(label).agg(F.sum("_b").alias("n_before"), F.sum("_a").alias("n_after"))
    )
    counts = settle(both)
    nb, na = counts.agg(F.sum("n_before"), F.sum("n_after")).first()
    return counts.select(
        label, "n_before", "n_after", (F.col("n_after") - F.col("n_before")).alias("n_added"),
        (F.col("n_after") / F.lit(na or 1) - F.col("n_before") / F.lit(nb or 1)).alias("share_delta"),
    )
