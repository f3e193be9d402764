"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_path, written_at


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """An equi-join on `key` (a column or several) whose sides are always dealt anew, so AQE can split a hot key's rows.

    A side that was just aggregated by `key` is already dealt by it, and a join then takes it as it is. The key's hash as
    a second join key asks for another exchange.
    """
    keys = [key] if isinstance(key, str) else key
    dealt = lambda df: df.withColumn("_dealt", F.xxhash64(*keys))
    return dealt(left).join(dealt(right), ["_dealt", *keys], how).drop("_dealt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; the component is its smallest node.

    Each round points the larger neighbours of a node at its smallest one (large star), then the smaller ones (small
    star); the graph becomes stars after a number of rounds that grows with the logarithm of its size, also for chains.
    Rounds are written to the shared folder, and each is dropped when the next is there. A null end or a loop links
    nothing. Nodes that are numbers are aggregated by hash, others by sorting.
    """
    spark, seen = edges.sparkSession, None
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, path = written_at(e, "edges")
    while True:
        # A larger neighbour v of u goes to the smallest of u's neighbours and u itself.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Then u has only smaller neighbours: they, and u, go to the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e, after = written_at(small, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_path(spark, path)
        path = after
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
