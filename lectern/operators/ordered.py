"""Running sums and neighbours over orderings whose keys may be very uneven.

A window over one key runs in one task. Here an ordering is given as levels, from
coarse to fine: rows are windowed inside one slab (key and coarse levels), slabs
are summed with map-side combine, and the short slab table carries the offsets.
A key that holds a third of all rows is then spread over its slabs. Keys and coarse levels must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Levels = list[list[str]]


def running_sums(df: DataFrame, keys: list[str], levels: Levels, sums: dict[str, Column]) -> DataFrame:
    """Add, for each name, the sum of its column over all earlier rows of the key (0 at first)."""
    *outer, finest = levels
    slab = keys + [c for level in outer for c in level]
    before = Window.partitionBy(*slab).orderBy(*finest).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.select(
        "*", *[F.coalesce(F.sum(value).over(before), F.lit(0)).alias(name) for name, value in sums.items()]
    )
    if not outer:
        return inside
    totals = df.groupBy(*slab).agg(*[F.sum(value).alias(f"{name}__t") for name, value in sums.items()])
    offsets = running_sums(totals, keys, outer, {f"{name}__o": F.col(f"{name}__t") for name in sums})
    joined = inside.join(offsets.drop(*[f"{name}__t" for name in sums]), slab)
    kept = [F.col(c) for c in df.columns]
    return joined.select(*kept, *[(F.col(name) + F.col(f"{name}__o")).alias(name) for name in sums])


def row_numbers(df: DataFrame, keys: list[str], levels: Levels, name: str) -> DataFrame:
    """Position of each row inside its key, from 0."""
    return running_sums(df, keys, levels, {name: F.lit(1).cast("bigint")})


def neighbour(
    df: DataFrame, keys: list[str], levels: Levels, value: Column, name: str, *, ahead: bool = False
) -> DataFrame:
    """Add ``value`` of the row before (or after, with ``ahead``); null at the edge of a key.

    ``value`` should be a struct if a null neighbour must differ from no neighbour.
    """
    *outer, finest = levels
    slab = keys + [c for level in outer for c in level]
    order = Window.partitionBy(*slab).orderBy(*finest)
    step = F.lead if ahead else F.lag
    if not outer:
        return df.select("*", step(value).over(order).alias(name))
    boxed = F.struct(value.alias("v"))
    inside = df.select("*", step(boxed).over(order).alias("__near"))
    edge = F.min_by if ahead else F.max_by
    ends = df.groupBy(*slab).agg(edge(boxed, F.struct(*finest)).alias("__edge"))
    far = neighbour(ends, keys, outer, F.col("__edge"), "__far", ahead=ahead).drop("__edge")
    joined = inside.join(far, slab)
    picked = F.coalesce(F.col("__near"), F.col("__far"))["v"]
    return joined.select(*[F.col(c) for c in df.columns], picked.alias(name))
