"""Text tables with comments, packed coefficients and partitioned beams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_space_table(lines: DataFrame, schema: list[tuple[str, str]], comment: str = "#") -> DataFrame:
    """Columns of blank-separated lines (column `value`); comments and blank lines are skipped.

    Text after the comment sign is dropped from a line, too. Missing or unreadable fields are null.
    """
    text = F.trim(F.regexp_replace(F.split("value", comment, 2)[0], r"\s+", " "))
    rows = lines.select(text.alias("t")).filter(F.col("t") != "").select(F.split("t", " ").alias("f"))
    return rows.select(*[F.get("f", F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(schema)])


def read_space_table(spark: SparkSession, path: str, schema: list[tuple[str, str]], comment: str = "#") -> DataFrame:
    """Spectra, density tables and beam lists as text files."""
    return parse_space_table(spark.read.text(path), schema, comment)


def write_beam_parts(parts: DataFrame, path: str) -> None:
    """One folder for each part of `partition_beams`, with a file for each beam or some of them.

    Beams, not parts, are dealt to tasks, so a part of many beams is written by many. Spark commits all folders at
    the end of the job: a failed task's files are never seen, and a path that exists is an error.
    """
    parts.repartition("part", "beam").write.partitionBy("part").parquet(path)
