"""Hash-derived randomness: the same row gets the same draw whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_hex(seed: int | str, *parts: Column) -> Column:
    """32 hex digits for (seed, parts); a total order over rows up to hash ties."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def unit_draw(seed: int | str, *parts: Column) -> Column:
    """Uniform double in [0, 1)."""
    return F.conv(F.substring(draw_hex(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def index_draw(n: Column, seed: int | str, *parts: Column) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(unit_draw(seed, *parts) * n).cast("int")
