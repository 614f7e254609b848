"""Connected components of links between numbers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import materialize

MOST_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every number in ``links`` (a, b); a component is named by its smallest number.

    Each round is written to the shared folder, and neighbourhoods are only reduced to their minimum and joined back, so
    a number with very many links is never gathered in one place.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = materialize(edges)
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that both sides of the join are dealt anew and a number with very many links can be split
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    named = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return named.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
