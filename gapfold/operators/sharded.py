"""Ordered neighbours without one task per key.

A window over a key puts all rows of the key in one task. Where a key may hold
a third of all rows, its rows are cut into shards along the order; neighbours
are found inside each shard, and only the edge rows of the shards (a few per
shard) travel in a second, small window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of a join side that may be broadcast.
BROADCAST_BYTES = 8 << 20


def checked_side(df: DataFrame, width: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df as the side of a join: broadcast if its rows, `width` bytes each, are
    at most `limit` in all (one aggregate counts them), else joined by a sort-merge
    join, whose hot keys the engine splits. df should be a written table."""
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df.hint("merge")


def with_previous(df: DataFrame, keys: list[str], shard: Column, order: list[str], carry: list[str], name: str = "prev") -> DataFrame:
    """df plus a struct `name` of the carried columns of the row before.

    Rows of a key are ordered by `order`; `shard` must not decrease along it.
    The first row of a key gets NULL. Ties in `order` are broken by nothing, so
    `order` should be total. NULL keys are a key. Empty input gives empty output.
    """
    s = "__shard"
    item = F.struct(*carry)
    base = df.withColumn(s, shard)
    within = Window.partitionBy(*keys, s).orderBy(*order)
    inner = base.withColumn(name, F.lag(item).over(within))
    tails = base.groupBy(*keys, s).agg(F.max_by(item, F.struct(*order)).alias("__tail"))
    halo = tails.withColumn("__halo", F.lag("__tail").over(Window.partitionBy(*keys).orderBy(s))).drop("__tail")
    same = F.lit(True)
    for k in [*keys, s]:
        same = same & F.col(f"__a.{k}").eqNullSafe(F.col(f"__b.{k}"))
    both = inner.alias("__a").join(halo.alias("__b"), same, "left")
    return both.select(*[F.col(f"__a.{c}") for c in df.columns], F.coalesce(F.col(f"__a.{name}"), F.col("__b.__halo")).alias(name))
