"""Connected components by contraction of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewell.sources.lineage import cut, discard


def components(links: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(on..., a, b) links -> (on..., node, zone): nodes that links join, directly or not, and only they, have the same zone.

    In every pass a node moves to its least neighbour's least neighbour, or stays if it is less itself; the order is that of a hash that changes
    from pass to pass, so about half of the nodes vanish however they are numbered, and the links between those that are left are
    a smaller graph. Passes end when no link is left, after some log2(nodes) of them. At the end nodes are told where they have come
    to, from the last pass back. Repeated links and links of a node to itself are none; a zone is one of its nodes.
    """
    keys = list(on)
    e = links.select(*keys, "a", "b").filter("a <> b")
    e = cut(e.union(e.select(*keys, F.col("b"), F.col("a"))).distinct())
    passes, number = [], 0
    while not e.isEmpty():
        place = lambda c, n=number: F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("v"))
        least = e.groupBy(*keys, "a").agg(F.min(place("b")).alias("_m"))
        first = least.select(*keys, "a", F.when(F.col("_m") < place("a"), F.col("_m.v")).otherwise(F.col("a")).alias("p"))
        second = first.select(*keys, F.col("a").alias("p"), F.col("p").alias("to"))
        moved = cut(first.join(second, [*keys, "p"]).select(*keys, "a", "to"))
        left = e.join(moved.withColumnRenamed("to", "_a"), [*keys, "a"]).join(moved.select(*keys, F.col("a").alias("b"), F.col("to").alias("_b")), [*keys, "b"])
        smaller = cut(left.filter("_a <> _b").select(*keys, F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        discard(e)
        e, number = smaller, number + 1
        passes.append(moved)
    if not passes:
        return e.select(*keys, F.col("a").alias("node"), F.col("b").alias("zone"))
    found = None
    for moved in reversed(passes):
        step = moved.select(*keys, F.col("a").alias("node"), "to")
        if found is None:
            found = step.withColumnRenamed("to", "zone")
        else:
            found = step.join(found.withColumnRenamed("node", "to"), [*keys, "to"], "left").select(*keys, "node", F.coalesce("zone", "to").alias("zone"))
    return found
