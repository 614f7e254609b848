"""As-of look-ups without range joins: both sides in one sorted window per key.

One exchange by key serves any number of look-ups; each is a running ``last`` over the union, so a symbol of a million
bars costs a sort and not a product with its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, value: Column, name: str, forward: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with ``name``: the ``value`` (a struct) of the latest right row at or before ``left_on``.

    ``forward``: the earliest at or after. ``strict``: equal times don't count.
    """
    names = [f"_l{i}" for i in range(len(left.columns))]
    packed = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(left.columns, names, strict=True)])
    lhs = left.select(F.col(by).alias("_k"), F.col(left_on).alias("_t"), F.lit(0 if strict else 1).alias("_s"), packed.alias("_row"))
    rhs = right.select(F.col(by).alias("_k"), F.col(right_on).alias("_t"), F.lit(1 if strict else 0).alias("_s"), value.alias("_v"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    order = [F.col("_t").desc() if forward else F.col("_t"), F.col("_s")]
    seen = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.when(F.col("_t").isNotNull(), F.last("_v", ignorenulls=True).over(seen))
    found = both.withColumn("_hit", hit).filter(F.col("_row").isNotNull())
    return found.select(*[F.col(f"_row.{n}").alias(c) for c, n in zip(left.columns, names, strict=True)], F.col("_hit").alias(name))
