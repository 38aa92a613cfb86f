"""Order-dependent work on long groups, cut into chunks so that no group has to fit one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditloom.operators.sizing import join_small, settle

CHUNK = 8192


def neighbours(df: DataFrame, keys: Sequence[str], pos: str, value: str, before: int = 0,
               after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Add ``prev_1..`` and ``next_1..``: the value 1.. rows before and after within the keys.

    ``pos`` must be dense (0, 1, 2, ...) within the keys. Rows close to a chunk border are also
    sent to the neighbouring chunk, so one shuffle on (keys, chunk) serves every offset.
    """
    if max(before, after) > chunk:
        raise ValueError("a chunk must be longer than the reach")
    p, size = F.col(pos), F.lit(chunk)
    own = F.floor(p / size)
    homes = F.array_compact(
        F.array(
            own,
            F.when((p % size < after) & (own > 0), own - 1),
            F.when(p % size >= chunk - before, own + 1) if before else F.lit(None).cast("bigint"),
        )
    )
    spread = df.withColumn("_own", own).withColumn("_chunk", F.explode(homes))
    w = W.partitionBy(*keys, "_chunk").orderBy(pos)
    added = {f"prev_{i}": F.lag(value, i).over(w) for i in range(1, before + 1)}
    added |= {f"next_{i}": F.lead(value, i).over(w) for i in range(1, after + 1)}
    return spread.withColumns(added).where("_own = _chunk").drop("_own", "_chunk")


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def long_groups(df: DataFrame, keys: Sequence[str], chunk: str) -> DataFrame | None:
    """Keys of the groups with rows outside piece 0, settled; None when there are none. ``df`` should be settled."""
    found = settle(df.where(F.col(chunk) != 0).select(*keys).distinct())
    return None if found.isEmpty() else found


def prefix_scan(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence,
                specs: dict[str, tuple[str, Column, bool]], long: DataFrame | None = None, carry_all: bool = True) -> DataFrame:
    """Running aggregates over arbitrarily long groups.

    ``chunk`` is a column that splits each group into ordered pieces. ``specs`` maps an output
    name to (kind, value, inclusive) with kind sum, max, min, last (last non-null value) or next
    (the value of the row after this one). Piece totals are scanned first and carried into the pieces
    by an equi-join on (keys, chunk), which shares its shuffle with the window inside the pieces.

    Without ``carry_all`` only the groups in ``long``, as ``long_groups`` finds them, have more than one
    piece: their totals alone are added up, and without such groups nothing is joined.
    """
    values = df.withColumns({f"_v_{n}": F.struct(v.alias("v")) if kind == "next" else v for n, (kind, v, _) in specs.items()})
    order_cols = list(order)
    inside = W.partitionBy(*keys, chunk).orderBy(*order_cols)
    earlier = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    carried = carry_all or long is not None

    totals, carry = {}, {}
    for name, (kind, _, _) in specs.items():
        v = F.col(f"_v_{name}")
        stamp = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_cols])
        if kind == "next":
            totals[f"_t_{name}"] = F.min_by(v, stamp)
            carry[f"_c_{name}"] = F.lead(f"_t_{name}").over(W.partitionBy(*keys).orderBy(chunk))
        elif kind == "last":
            totals[f"_t_{name}"] = F.max_by(v, F.when(v.isNotNull(), stamp))
            carry[f"_c_{name}"] = F.last(f"_t_{name}", ignorenulls=True).over(earlier)
        else:
            totals[f"_t_{name}"] = _MERGE[kind](v)
            carry[f"_c_{name}"] = _MERGE[kind](f"_t_{name}").over(earlier)
    joined = values
    if carried:
        several = values if carry_all else values.join(long, list(keys), "left_semi")
        pieces = several.groupBy(*keys, chunk).agg(*[c.alias(n) for n, c in totals.items()])
        pieces = pieces.withColumns(carry).select(*keys, chunk, *carry)
        joined = values.join(pieces, [*keys, chunk], "left") if carry_all else join_small(values, pieces, [*keys, chunk], "left")

    out = {}
    for name, (kind, _, inclusive) in specs.items():
        w = inside.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        local = F.col(f"_v_{name}")
        before = F.col(f"_c_{name}") if carried else F.lit(None).cast(values.select(totals[f"_t_{name}"]).schema[0].dataType)
        if kind == "next":
            out[name] = F.coalesce(F.lead(local).over(inside), before)["v"]
        elif kind == "sum":
            out[name] = F.coalesce(before, F.lit(0)) + F.coalesce(F.sum(local).over(w), F.lit(0))
        elif kind == "last":
            out[name] = F.coalesce(F.last(local, ignorenulls=True).over(w), before)
        else:
            pick = F.greatest if kind == "max" else F.least
            out[name] = pick(_MERGE[kind](local).over(w), before)
    drop = [f"_v_{n}" for n in specs] + list(carry if carried else [])
    return joined.withColumns(out).drop(*drop)


def chunk_of(pos: str, chunk: int = CHUNK) -> Column:
    """Number of a position's piece; positions that are null come before all others."""
    return F.coalesce(F.floor(F.col(pos) / chunk), F.lit(-1).cast("bigint"))


def range_chunks(df: DataFrame, order: Sequence, name: str = "_chunk") -> DataFrame:
    """Cut a whole table into globally ordered pieces of about equal size.

    The range-partitioned rows are written to the checkpoint folder, which fixes the piece
    numbers for every later use. The ordering columns must be (nearly) unique.
    """
    return settle(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def global_row_number(df: DataFrame, order: Sequence, name: str = "row_no") -> DataFrame:
    """1-based position of every row in a total order, without a one-task window."""
    pieces = range_chunks(df, order)
    ranked = prefix_scan(pieces, [], "_chunk", order, {name: ("sum", F.lit(1), True)})
    return ranked.drop("_chunk")
