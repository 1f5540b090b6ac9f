"""The plan objective on dose rows, its gradient, and a proximal gradient loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewell.operators.fluence import fluence_gradients
from dosewell.operators.stored import Coefficients, few, in_place
from dosewell.sources.lineage import cut, discard

#: Columns of an optimisation row besides structure and voxel; null means not applicable.
LIMITS = ("min_target", "min_weight", "max_dose", "max_weight", "oar_weight")


def _parts():
    d = F.coalesce("dose", F.lit(0.0))
    w = lambda c: F.coalesce(c, F.lit(0.0))
    under = F.coalesce(F.least(d - F.col("min_target"), F.lit(0.0)), F.lit(0.0))
    over = F.coalesce(F.greatest(d - F.col("max_dose"), F.lit(0.0)), F.lit(0.0))
    return d, w, under, over


def dose_objective(dose: DataFrame, rows: DataFrame) -> DataFrame:
    """Half the weighted squares of under-dose, over-dose and organ dose, for each structure and in total (structure null)."""
    return dose_cost(rows.join(dose, "voxel", "left"))


def dose_cost(dosed: DataFrame) -> DataFrame:
    """`dose_objective` of rows that have their dose."""
    d, w, under, over = _parts()
    cost = 0.5 * (w("min_weight") * under * under + w("max_weight") * over * over + w("oar_weight") * d * d)
    return dosed.withColumn("_cost", cost).rollup("structure").agg(F.sum("_cost").alias("cost"))


def dose_residual(dose: DataFrame, rows: DataFrame) -> DataFrame:
    """The weighted residual of every voxel, which the transposed matrix takes."""
    return voxel_residual(rows.join(dose, "voxel", "left"))


def voxel_residual(dosed: DataFrame) -> DataFrame:
    """`dose_residual` of rows that have their dose."""
    d, w, under, over = _parts()
    residual = w("min_weight") * under + w("max_weight") * over + w("oar_weight") * d
    return dosed.groupBy("voxel").agg(F.sum(residual).alias("residual"))


def smoothness(fluence: DataFrame, gamma: float) -> DataFrame:
    """One row: the Huber-smoothed sum of absolute fluence differences."""
    t = F.col("diff")
    p = F.signum(t) * F.greatest(F.abs(t) - gamma, F.lit(0.0))
    return fluence_gradients(fluence).agg(F.coalesce(F.sum(F.abs(p) + (p - t) * (p - t) / (2 * gamma)), F.lit(0.0)).alias("smoothness"))


def group_shrink(weights: DataFrame, tau: float) -> DataFrame:
    """The proximal step of the square root of each beam's norm: whole beams shrink or go to zero."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("beam")))
    alpha = F.when(F.col("_norm") > 0, tau * F.pow("_norm", F.lit(-1.5)))
    root = 2 / F.sqrt(F.lit(3.0)) * F.sin((F.acos(0.75 * F.sqrt(F.lit(3.0)) * F.col("_alpha")) + F.pi() / 2) / 3)
    scale = F.when(F.col("_alpha").isNull() | (F.col("_alpha") > 2 * F.sqrt(F.lit(6.0)) / 9), 0.0).otherwise(root * root)
    x = weights.withColumn("_norm", norm).withColumn("_alpha", alpha)
    return x.withColumn("weight", F.col("weight") * scale).drop("_norm", "_alpha")


def optimise_fluence(coo: DataFrame | Coefficients, rows: DataFrame, weights: DataFrame, iterations: int, step: float, tau: float) -> tuple[DataFrame, list[float]]:
    """Projected gradient with `group_shrink` in each pass; returns the weights and the cost before each pass.

    Coefficients are dealt out once by voxel and, if weights are too many for all tasks, once by beamlet, and stay there; rows that repeat
    a (beamlet, voxel) add. A pass computes the dose once and writes it beside the limits of its voxels; cost and residual are read from that table. Doses and weights, a row a voxel or beamlet, are cut from
    their lineage in every pass, so a lost executor costs no pass, and the tables of the pass before are deleted.
    """
    own = isinstance(coo, DataFrame)
    lookup = few(weights)  # a pass keeps the beamlets
    stored = in_place(coo, voxels_only=lookup) if own else coo
    dose = stored.dose_of_few if lookup else stored.dose
    costs, before = [], []
    for _ in range(iterations):
        dosed = cut(rows.join(dose(weights), "voxel", "left"))
        costs.append(dose_cost(dosed).filter("structure is null").agg(F.max("cost")).first()[0])
        gradient = stored.gradient(voxel_residual(dosed))
        moved = weights.join(gradient, ["beam", "beamlet"], "left").select("beam", "beamlet", F.greatest(F.col("weight") - step * F.coalesce("gradient", F.lit(0.0)), F.lit(0.0)).alias("weight"))
        weights = cut(group_shrink(moved, tau))
        discard(dosed, *before)
        before = [weights]
    if own:
        stored.unpersist()
    return weights, costs
