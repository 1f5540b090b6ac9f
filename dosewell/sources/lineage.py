"""Cutting lineage in loops by tables that all executors can read, rows dealt out evenly, and tables whose size is looked up before they go to all tasks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Writes to the folder of spark.checkpoint.dir and reads back; without one, to a temporary folder in local mode only."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), "dosewell-checkpoints")
    path = f"{folder.rstrip('/')}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by the keys to as many tasks as the session shuffles to, for sorts and aggregates that hold what a task gets.

    Spark joins parts of its own shuffles by their compressed bytes, which for places and numbers in order are so few that a task gets millions of rows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The table marked for broadcast if it has at most `most` rows, which is looked up; otherwise as it is, for Spark to decide."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def discard(*frames: DataFrame) -> None:
    """Deletes the tables that `cut` wrote for these frames, when nothing that is still to run reads them."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("loop-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
