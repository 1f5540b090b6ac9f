"""Exact duplicates by distributed MSD radix partitioning: groups are split by successive bytes.

Documents are counted by their first 64 bytes; those alone with theirs are settled. The others' groups
are split by their first 4096 bytes, then by the next 64 times more, until a group has one member or its
texts have ended. Texts are equal because all their bytes were, not because digests were. Only bytes
that are not yet compared move from round to round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewell.llm.common import LOWER, flat, keep, maybe_in, membership, with_places

#: Bytes of the first digit; the growth of the digits after it.
FIRST_BYTES, GROWTH = 64, 64


def _head(text: Column) -> Column:
    """The first bytes of the normalised text: a character has at least a byte."""
    start = F.translate(F.left(F.coalesce(text, F.lit("")), F.lit(FIRST_BYTES)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.substring(F.encode(start, "UTF-8"), 1, FIRST_BYTES)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256, one row per document.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. keep_id is the
    largest doc_id of a group, and `kept` says that a row has it. Rows that repeat an id are counted
    each, and all rows that have keep_id are kept; a null id is never kept unless all ids of its group
    are null, then keep_id is null and kept false. Groups are labelled by the number of one of their
    rows; the SHA-256 of the normalised text is only reported. An empty table gives no rows; other columns are not read.
    Counts are combined before the shuffle, and a hot group's rows meet its one count in a join whose
    large partitions Spark splits.
    """
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("head", _head(F.col("text")))
    # a filter of fixed size says which heads may be shared; the rounds below are exact
    shared = membership(x.groupBy("head").agg(F.count("*").alias("n")).filter("n > 1").select(F.xxhash64("head").alias("h")))

    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """SHA-256 of every normalised text; the text itself only where its head may be shared."""
        for b in batches:
            x, off = flat(b.column("text"))
            whole, at = x.tobytes().translate(LOWER), off.tolist()
            view = memoryview(whole)
            several = maybe_in(shared.value, b.column("_b0").to_numpy(), b.column("_b1").to_numpy()).tolist()
            sha = [hashlib.sha256(view[i:j]).hexdigest() for i, j in zip(at, at[1:])]
            rest = [whole[i:j] if s else None for i, j, s in zip(at, at[1:], several)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(sha, pa.string()), pa.array(rest, pa.binary())], names=["doc_id", "row", "text_sha256", "rest"])

    hashed = with_places(x.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", F.xxhash64("head").alias("_h")), "_h")
    first = keep(hashed.mapInArrow(normalised, "doc_id long, row long, text_sha256 string, rest binary"))
    alone = lambda rows: rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    done = [alone(first.filter("rest is null"))]
    left = first.filter("rest is not null").withColumn("label", F.lit(0).cast("long"))
    longest = left.agg(F.max(F.octet_length("rest"))).first()[0]
    width = FIRST_BYTES * GROWTH
    while longest is not None:
        rows = left.select("doc_id", "row", "text_sha256", "label", F.substring("rest", 1, width).alias("piece"), F.substring(F.col("rest"), F.lit(width + 1), F.lit(1 << 30)).alias("rest"))
        found = rows.groupBy("label", "piece").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"), F.min("row").alias("name")).filter("n > 1")
        met = rows.join(found.withColumnsRenamed({"label": "_label", "piece": "_piece"}), (F.col("label") == F.col("_label")) & (F.col("piece") == F.col("_piece")), "left")
        over = F.col("n").isNull() | (F.octet_length("piece") < width)
        met = keep(met.select("doc_id", "row", "text_sha256", "n", "top", F.col("name").alias("label"), F.when(~over, F.col("rest")).alias("rest")))
        ended = met.filter("rest is null")
        done.append(ended.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "text_sha256"))
        if longest < width:
            break
        left = met.filter("rest is not null").select("doc_id", "row", "text_sha256", "label", "rest")
        longest, width = longest - width, width * GROWTH
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
