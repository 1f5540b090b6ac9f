"""Stand-ins for plan data in the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewell.sources.lineage import dealt

#: Grid of the volume stand-ins: i and j have this many places, k as many as are needed.
NX = NY = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def coo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as coefficients: part = voxel, supplier = beamlet, the supplier's nation = beam. Rows that repeat a (beamlet, voxel) add."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("beamlet"), F.col("s_nationkey").alias("beam"))
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("beamlet"), F.col("l_partkey").alias("voxel"), F.col("l_quantity").alias("coeff"))
    return x.join(s, "beamlet").select("beam", "beamlet", "voxel", "coeff")


def coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficients of `coo_rows`, one row for each (beamlet, voxel); nearly all rows differ, so they are not added up before they move."""
    return dealt(coo_rows(spark, sf_dir), "beam", "beamlet", "voxel").groupBy("beam", "beamlet", "voxel").agg(F.sum("coeff").alias("coeff"))


COO = "coo AS (SELECT s_nationkey AS beam, l_suppkey AS beamlet, l_partkey AS voxel, sum(l_quantity) AS coeff FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the beamlets that have a positive balance."""
    return table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("beam"), F.col("s_suppkey").alias("beamlet"), (F.col("s_acctbal") / 1000).alias("weight"))


WEIGHTS = "weights AS (SELECT s_nationkey AS beam, s_suppkey AS beamlet, s_acctbal / 1000 AS weight FROM supplier WHERE s_acctbal > 0)"


def cell(number: Column) -> tuple[Column, Column, Column]:
    """i, j, k of a linear index."""
    return (number % NX).cast("int"), (F.floor(number / NX) % NY).cast("int"), F.floor(number / (NX * NY)).cast("int")


CELL = "CAST({0} % 20 AS INTEGER) AS i, CAST(({0} // 20) % 20 AS INTEGER) AS j, CAST({0} // 400 AS INTEGER) AS k"


def part_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as voxels: a structure for each type, and one of large parts that overlaps them."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    i, j, k = cell(F.col("p_partkey"))
    x = p.select(F.col("p_partkey").alias("voxel"), i.alias("i"), j.alias("j"), k.alias("k"), "p_type", "p_size")
    return x.select(F.col("p_type").alias("structure"), "voxel", "i", "j", "k").union(x.filter("p_size > 30").select(F.lit("LARGE"), "voxel", "i", "j", "k"))


PART_MASKS = f"masks AS (SELECT p_type AS structure, p_partkey AS voxel, {CELL.format('p_partkey')} FROM part UNION ALL SELECT 'LARGE', p_partkey, {CELL.format('p_partkey')} FROM part WHERE p_size > 30)"


def event_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as voxels: a structure for each type, and two by user that overlap them."""
    i, j, k = cell(F.col("event_id"))
    x = table(spark, sf_dir, "events").select(F.col("event_id").alias("voxel"), i.alias("i"), j.alias("j"), k.alias("k"), "event_type", "user_id")
    parts = [x.select(F.col("event_type").alias("structure"), "voxel", "i", "j", "k")]
    parts += [x.filter(F.col("user_id") % n != 0).select(F.lit(f"U{n}"), "voxel", "i", "j", "k") for n in (3, 4)]
    return parts[0].union(parts[1]).union(parts[2])


EVENT_MASKS = (
    f"masks AS (SELECT event_type AS structure, event_id AS voxel, {CELL.format('event_id')} FROM events"
    + "".join(f" UNION ALL SELECT 'U{n}', event_id, {CELL.format('event_id')} FROM events WHERE user_id % {n} <> 0" for n in (3, 4))
    + ")"
)


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j, k = cell(F.col("event_id"))
    return table(spark, sf_dir, "events").select(i.alias("i"), j.alias("j"), k.alias("k"), F.col("value"))


VOLUME = f"volume AS (SELECT {CELL.format('event_id')}, value FROM events)"


def volume2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second volume on the same grid, of orders; it has other voxels than the first one."""
    i, j, k = cell(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select(i.alias("i"), j.alias("j"), k.alias("k"), (F.col("o_totalprice") / 1000).alias("value"))


VOLUME2 = f"volume2 AS (SELECT {CELL.format('o_orderkey')}, o_totalprice / 1000 AS value FROM orders)"


def doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doses of voxels by plan and structure: line items by status and flag."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("plan"), F.col("l_returnflag").alias("structure"), (F.col("l_extendedprice") / 1000).alias("dose"), F.lit(0.001).alias("volume"))


DOSES = "doses AS (SELECT l_linestatus AS plan, l_returnflag AS structure, l_extendedprice / 1000 AS dose, CAST(0.001 AS DOUBLE) AS volume FROM lineitem)"


def fluence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fluence cells: a beam for each 400, a quarter of the cells inactive."""
    i, j, k = cell(F.col("o_orderkey"))
    w = F.when(F.col("o_custkey") % 4 == 0, 0.0).otherwise(F.col("o_totalprice") / 1000)
    return table(spark, sf_dir, "orders").select(k.alias("beam"), j.alias("r"), i.alias("c"), w.alias("weight"))


FLUENCE = "fluence AS (SELECT CAST(o_orderkey // 400 AS INTEGER) AS beam, CAST((o_orderkey // 20) % 20 AS INTEGER) AS r, CAST(o_orderkey % 20 AS INTEGER) AS c, CASE WHEN o_custkey % 4 = 0 THEN 0.0 ELSE o_totalprice / 1000 END AS weight FROM orders)"


def with_sql(*parts: str) -> str:
    """Common table expressions and, last, the query, which may begin with more of them."""
    *tables, last = parts
    return "WITH " + ",\n".join(tables) + ("\n" if last.startswith("SELECT") else ",\n") + last
