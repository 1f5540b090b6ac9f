"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Each document has a 60-bit hash. Word counts are summed by source and hash bucket, the bucket in
which the budget of a source runs out is found from the running sum, and only that bucket is looked
at again with finer buckets. Five levels of 4096 buckets settle every bit, so no documents are
sorted and none are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewell.llm.common import keep

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source, and a document, is taken at most this many times.
MOST = 3
LEVEL_BITS, LEVELS = 12, 5
#: Tasks that a source's documents are spread over where they meet its limits.
SALTS = 32


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> also `target`: all words shared by weight, none above `most` times its size.

    Sources are ordered by code point, null last. What sources at their limit leave is shared by the
    others by weight; the level at which that ends is found in one pass over sources in the order of
    limit / weight. The input has a row for each source, and sources are few: they are ordered in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), k.cast("int") + 1)
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("double") * most).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    x = x.withColumns({
        "_all": F.sum(F.col("source_size").cast("double")).over(whole),
        "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_rest": F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_rest"))
    x = x.withColumn("_lambda", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole))
    return x.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_lambda"), F.col("_ratio")) * F.col("_w"))).select("source", "source_size", "target")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The words that a mixture takes of every document: doc_id, size, source_size, target, taken, copies.

    Every document of a source is taken floor(target / source_size) times; of what is missing, the
    documents below the source's hash threshold are taken once more, and the documents at the
    threshold share the last words, so a source's sum differs from its target by less than a word for
    each of those. `copies` says it in whole documents, the threshold's own document rounded. The
    hash is of doc_id, so reruns agree and repeated rows are treated alike. Null texts have size 0
    and take 0; a null source is a source; a null id hashes as the empty string; an empty table
    gives no rows. Extra columns are not read.
    """
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    x = keep(x.withColumn("_h", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")))
    sizes = x.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int")
    sources = source_targets(sizes, weights, most).withColumn("_times", whole)
    # A row for each source: what is left to take, and the prefix of the hash that is settled so far.
    sources = keep(sources.withColumn("_left", F.when(F.col("_times") >= most, 0.0).otherwise(F.col("target") - F.col("_times") * F.col("source_size"))))
    state = sources.select("source", F.col("_left").alias("_budget"), F.lit(0).cast("long").alias("_prefix"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - level - 1)
        s = state.withColumnRenamed("source", "_src")
        inside = x.join(s, _same(F.col("source"), F.col("_src")) & (F.shiftright("_h", shift + LEVEL_BITS) == F.col("_prefix")))
        sums = inside.groupBy("source", "_budget", F.shiftright("_h", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"))
        running = sums.withColumn("_to", F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
        # the first bucket that the budget doesn't fill; its documents are the next level's
        state = running.filter(F.col("_to") > F.col("_budget")).groupBy("source").agg(F.min_by(F.struct("_bucket", (F.col("_budget") - (F.col("_to") - F.col("_sum"))).alias("b"), "_sum"), "_bucket").alias("_m"))
        state = state.select("source", F.col("_m.b").alias("_budget"), F.col("_m._bucket").alias("_prefix"), F.col("_m._sum").alias("_at"))
    edge = state.select(F.col("source").alias("_src"), F.col("_prefix").alias("_threshold"), F.col("_budget").alias("_share"), F.col("_at"))
    limits = sources.join(edge, _same(F.col("source"), F.col("_src")), "left").select(F.col("source").alias("_source"), "source_size", "target", "_times", "_threshold", "_share", "_at", "_left")
    # a source may hold a third of all documents: its one row is copied for each salt
    limits = limits.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    y = x.join(limits, _same(F.col("source"), F.col("_source")) & (F.pmod("_h", F.lit(SALTS).cast("long")) == F.col("_s")))
    # no threshold: the budget covers all documents or none has words
    below = (F.col("_left") > 0) & F.coalesce(F.col("_h") < F.col("_threshold"), F.lit(True))
    part = F.when(F.col("_h") == F.col("_threshold"), F.floor(F.col("size") * F.col("_share") / F.col("_at"))).otherwise(0)
    return y.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("_times") + F.when(below, F.col("size")).otherwise(F.coalesce(part, F.lit(0)))).cast("long").alias("taken"),
        (F.col("_times") + F.when(below | ((F.col("_h") == F.col("_threshold")) & (F.col("_share") * 2 >= F.col("_at"))), 1).otherwise(0)).cast("int").alias("copies"),
    )


#: The same rows by running sums over sorted documents.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)] AS DOUBLE) AS wt, 3.0 * source_size AS cap FROM s),
r AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(CAST(cap AS DOUBLE)) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
l AS (SELECT max(lev) AS lam FROM r WHERE lev <= cap / wt),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), lam * wt) AS target,
         CASE WHEN source_size > 0 THEN least(floor(least(CAST(cap AS DOUBLE), lam * wt) / source_size), 3) ELSE 0 END AS times FROM w, l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.times,
         CASE WHEN t.times >= 3 THEN 0.0 ELSE t.target - t.times * t.source_size END AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS tied
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * times + CASE WHEN budget > 0 AND upto <= budget THEN size
                                WHEN budget > upto - tied AND tied > 0 THEN floor(size * (budget - (upto - tied)) / tied) ELSE 0 END AS BIGINT) AS taken,
       CAST(times + CASE WHEN budget > 0 AND upto <= budget THEN 1 WHEN budget > upto - tied AND (budget - (upto - tied)) * 2 >= tied THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM c
"""
