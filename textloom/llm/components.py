"""Connected components of an edge list by rounds of star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared_store import stored


def _mark(edges: DataFrame) -> tuple:
    """Count and two hashes of a set of edges, whatever their order."""
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(h, "lo"))).first())


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) for the nodes of edges (a, b).

    Alternates large stars (each node links its larger neighbours to its smallest) and small
    stars (each node links its smaller neighbours to the smallest) until nothing changes; the
    number of rounds grows with the logarithm of the longest path. A hub is never gathered:
    stars are a minimum by key and a join, which splits skewed keys.
    """
    both = edges.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = stored(spark, both)
    mark = _mark(now)
    while True:
        ways = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lows = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lows, "hi")
        small = small.filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(lows.select("hi", F.col("m").alias("lo"))).distinct()
        after = stored(spark, small)
        was, mark = mark, _mark(after)
        if was == mark:
            break
        now = after
    roots = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
