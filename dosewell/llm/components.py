"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewell.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, for each node that has a link.

    Every step keeps at most as many links as there were and points nodes at smaller ones; the number
    of steps grows with the logarithm of the longest chain. Lineage is cut after each; nothing but a
    count and a sum comes to the driver. Minima are aggregates, so a node with very many links is
    combined before the shuffle. Steps go on until one changes nothing.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = cut(e)
    before = None
    while True:
        # large star: every node's larger neighbours point at the least of its neighbours and itself
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "n")
        e = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours and itself point at the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        joined = e.join(least, F.col("u") == F.col("n"))
        e = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
        e = cut(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
