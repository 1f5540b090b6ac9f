"""A corpus pipeline of five stages: language ID, exact dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Stages look at all rows that their predecessor kept, and extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewell.llm import exact, langid, mixture, neardup, packing
from dosewell.llm.common import columns_of, cut, free_name, numbered, table

#: Words in a shingle of the near-duplicate stage.
SHINGLE_WORDS = 5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; null, empty and other texts without a letter go.

    Whole texts are looked at, however long; repeated rows are judged alike; ties go to the larger sum
    of margins; an empty table stays empty.
    """
    return langid.keep_identified(docs, langid.fit(docs.select("doc_id", "text", "lang").filter(~langid.held_out(F.col("doc_id")))))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal whole texts (A-Z lower-cased, null as empty), one row: one with the largest doc_id.

    Rows are told apart by themselves, not by their ids: of a row that is repeated one copy stays, of rows
    that share an id those with other texts stay. Null ids are less than all others. An empty table stays empty.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, row, nulls_last=False)
    gone = exact.exact_duplicates(rows, id_col=row).filter("not kept").select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(*columns_of(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row, one with the smallest doc_id.

    Rows are told apart by themselves, as in the exact stage; null ids are larger than all others. Null,
    empty and blank texts are linked with nothing and stay. Sets are those of whole texts. An empty
    table stays empty.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    gone = neardup.near_duplicates(rows, SHINGLE_WORDS, id_col=row).filter("not kept").select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(*columns_of(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; the threshold's own document is rounded to a whole one.

    Rows are told apart by themselves, as in the exact stage. Texts without words have size 0 and come as often as
    their source is taken; a null source is a source; an empty table stays empty.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    taken = mixture.mix(rows, id_col=row).filter("copies > 0").select(F.col("doc_id").alias("number"), "copies")
    whole = rows.select(F.col(row).alias("number"), F.struct(*columns_of(docs)).alias("whole"))  # extra columns may have any names
    return whole.join(taken, "number").select("whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; every row is packed, repeated ones each, null and empty texts as their end id.

    Texts longer than a sequence are cut into pieces; an empty table gives no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained models and MinHash have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
