"""Registered queries of the library's own operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewell.operators import coeffs, dvh
from dosewell.plans import cohorts, dosevolume, images, matrix, structures

SECTIONS = (matrix, structures, dosevolume, images, cohorts)
QUERIES = {name: q for s in SECTIONS for name, q in s.QUERIES.items()}
ORACLE_SQL = {name: sql for s in SECTIONS for name, sql in s.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients thresholded per beamlet, weighted to a dose, and its cumulative histogram by structure."""
    from dosewell.plans import inputs

    dose = coeffs.apply_weights(coeffs.sparsify(inputs.coo(spark, sf_dir), 0.1), inputs.weights(spark, sf_dir))
    voxels = inputs.part_masks(spark, sf_dir).join(dose, "voxel").select(F.lit("plan").alias("plan"), "structure", "dose", F.lit(0.001).alias("volume"))
    return dvh.dvh_cumulative(dvh.dvh_differential(voxels, 20.0))
