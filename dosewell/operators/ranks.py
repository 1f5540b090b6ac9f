"""Ranks and exact quantiles of values by group, where a group may hold most rows and one value most of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewell.sources.lineage import cut

#: The most ranges that a group's values are dealt into, and the different values that a range is meant to hold.
RANGES, RANGE_VALUES = 256, 1 << 20


def ranked_values(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, value, _c (rows with the value), _last (rank of the last of them, from 1), _n (rows of the group).

    Equal values are counted before the shuffle. Values are dealt into ranges whose sizes are summed
    first, and ranked inside a range, so neither a group nor a value needs a task of its own. A group has
    as many ranges as its values need: a small one is a single range.
    """
    values = cut(rows.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("_c")))
    sizes = values.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count("*").alias("_d"))
    if (sizes.agg(F.max("_d")).first()[0] or 0) <= RANGE_VALUES:  # every group is one range
        running = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        return values.select(*keys, "value", "_c", F.sum("_c").over(running).alias("_last"), F.sum("_c").over(whole).alias("_n"))
    edges = values.groupBy(*keys).agg(F.percentile_approx("value", [k / RANGES for k in range(1, RANGES)], 8 * RANGES).alias("_e"), F.sum("_c").alias("_n"), F.ceil(F.count("*") / RANGE_VALUES).alias("_k"))
    # of the edges at k / RANGES, those that lie nearest above the group's own ones
    before_ = lambda i: F.floor(i * F.least("_k", F.lit(RANGES)) / RANGES)
    edges = edges.withColumn("_e", F.filter("_e", lambda e, i: before_(i + 1) > before_(i))).drop("_k")
    x = (values.join(edges, keys) if keys else values.crossJoin(edges)).withColumn("_r", F.size(F.filter("_e", lambda e: e < F.col("value"))))
    sizes = x.groupBy(*keys, "_r").agg(F.sum("_c").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_before", before).drop("_m")  # at most RANGES rows a group
    inside = F.sum("_c").over(Window.partitionBy(*keys, "_r").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_in", inside).join(starts, [*keys, "_r"]).select(*keys, "value", "_c", (F.col("_in") + F.col("_before")).alias("_last"), "_n")


#: Accuracy of the sketches that bracket a quantile: ranks are off by one in ACCURACY of a group's rows at most.
ACCURACY = 10000


def exact_quantiles(rows: DataFrame, keys: list[str], column: str, shares: dict[str, float], middles: bool = False) -> DataFrame:
    """A column for each named share: the exact quantile of each group, with linear interpolation between neighbours.

    The first value is at share 0 and the last at 1, or (`middles`) each at (rank - 1/2) / n. Nulls have no rank; a group of nulls gives no row.
    A mergeable sketch of each group gives two values that a quantile lies between. A second pass over the rows counts what is below,
    between and above, and keeps apart only the values between: a few in ten thousand of a group's rows, and sums, move;
    the rows themselves stay where they are. Should a bracket not hold its quantile, an error says so.
    """
    names = list(shares)
    spread = 4.0 / ACCURACY  # the sketch's error, and the way to the next rank
    ends = [min(1.0, max(0.0, q + d)) for q in shares.values() for d in (-spread, spread)]
    value = F.col(column).cast("double")
    known = rows.select(*keys, value.alias("_v"))
    sketch = known.groupBy(*keys).agg(F.percentile_approx("_v", ends, ACCURACY).alias("_e"), F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # at the ends of the shares, and in a group of few rows, a bracket takes all
    few = F.col("_n") < 2 * ACCURACY
    low = [F.when(few | F.lit(ends[2 * k] <= 0.0), F.col("_min")).otherwise(F.col("_e")[2 * k]) for k in range(len(names))]
    high = [F.when(few | F.lit(ends[2 * k + 1] >= 1.0), F.col("_max")).otherwise(F.col("_e")[2 * k + 1]) for k in range(len(names))]
    sketch = sketch.select(*keys, "_n", *[c.alias(f"_lo{k}") for k, c in enumerate(low)], *[c.alias(f"_hi{k}") for k, c in enumerate(high)])
    x = known.filter(F.col("_v").isNotNull())
    x = x.join(sketch, keys) if keys else x.crossJoin(F.broadcast(sketch))  # a row for each group
    between = reduce(lambda a, b: a | b, [(F.col("_v") >= F.col(f"_lo{k}")) & (F.col("_v") <= F.col(f"_hi{k}")) for k in range(len(names))])
    below = sum(((F.col("_v") > F.col(f"_hi{k}")).cast("int") for k in range(len(names))), F.lit(0))  # grows with the value
    counted = x.groupBy(*keys, below.alias("_below"), F.when(between, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"), F.min(F.col("_n")).alias("_n"), F.min("_v").alias("_least"))
    order = Window.partitionBy(*keys).orderBy("_least")
    counted = counted.withColumn("_last", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.col("_n") - 1
    place = {n: F.greatest(F.lit(0.0), F.least(F.lit(q) * F.col("_n") - 0.5, last.cast("double"))) if middles else F.lit(q) * last for n, q in shares.items()}
    # of the value or the run of values that has a rank, the value; null for a run
    at = lambda p: F.min(F.when((F.col("_last") > p) & (F.col("_last") - F.col("_c") <= p), F.coalesce("_v", F.lit(float("nan")))))
    columns = [c for n, p in place.items() for c in (at(F.floor(p)).alias(f"_lo_{n}"), at(F.ceil(p)).alias(f"_hi_{n}"), F.max(p - F.floor(p)).alias(f"_part_{n}"))]
    found = counted.groupBy(*keys).agg(*columns)
    missed = lambda c: F.when(F.isnan(c), F.raise_error(F.lit("a quantile lies outside of its bracket"))).otherwise(F.col(c))
    out = found.select(*keys, *[(missed(f"_lo_{n}") + F.col(f"_part_{n}") * (missed(f"_hi_{n}") - missed(f"_lo_{n}"))).alias(n) for n in names])
    return out
