"""Masks and volumes of many patients in one job.

Operators on structures, volumes and texture know rows by structure and i, j, k. A cohort is put into one such
space: every patient gets slices of its own, farther apart than any operator reaches, and structures
are named with the patient's number. An operator then runs once over all patients, spread over tasks by
slice as for one of them, and its result is taken apart again. This holds for whatever is done structure by
structure or place by place. Operators on pairs of structures and totals over whole volumes take the patient's column
themselves, as `on`: masks.dice, min_surface_distance, hausdorff, com_distance, union_intersection, consensus and kappa,
volume.compare_volumes, l2_scale and value_centroid, texture.mutual_information and background_threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cohort:
    """Patients with their numbers (patient, _p), the first slice of all, the slices of one patient, and those of them that stay empty."""

    numbers: DataFrame
    first: int
    stride: int
    margin: int

    def together(self, table: DataFrame) -> DataFrame:
        """Rows with patient, k and perhaps structure, without the patient and with places and names of their own."""
        x = table.join(self.numbers, "patient").withColumn("k", (F.col("k") - self.first + F.col("_p") * self.stride).cast("int"))
        if "structure" in table.columns:
            x = x.withColumn("structure", F.concat(F.col("_p").cast("string"), F.lit(":"), F.col("structure")))
        return x.drop("patient", "_p")

    def apart(self, result: DataFrame) -> DataFrame:
        """An operator's result with its patient: by the name of a structure, or else by the slice."""
        x = result
        if "structure" in result.columns:
            number = F.substring_index("structure", ":", 1).cast("int")
            x = x.withColumn("_p", number).withColumn("structure", F.substring("structure", F.length(F.substring_index("structure", ":", 1)) + 2, F.length("structure")))
        else:
            x = x.withColumn("_p", F.floor((F.col("k") + self.margin // 2) / self.stride).cast("int"))
        if "k" in result.columns:
            x = x.withColumn("k", F.col("k") - F.col("_p") * self.stride + self.first)
        return x.join(self.numbers, "_p").select("patient", *result.columns)


def cohort_of(*tables: DataFrame, margin: int = 128) -> Cohort:
    """The cohort of tables with patient and k; `margin` is at least twice as far as an operator reaches along k."""
    ends = [t.agg(F.min("k").alias("a"), F.max("k").alias("b")).first() for t in tables]
    low, high = min((e["a"] for e in ends if e["a"] is not None), default=0), max((e["b"] for e in ends if e["b"] is not None), default=0)
    people = tables[0].select("patient")
    for t in tables[1:]:
        people = people.union(t.select("patient"))
    # a row for each patient; ranked on one machine
    numbers = people.distinct().withColumn("_p", F.row_number().over(Window.orderBy("patient")) - 1)
    return Cohort(numbers, low, high - low + 1 + margin, margin)
