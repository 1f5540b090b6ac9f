"""Fluence maps (beam, r, c, weight) and beam tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewell.sources.lineage import small


def to_fluence_map(weights: DataFrame, dims: DataFrame) -> DataFrame:
    """Dense maps with zeros from (beam, beamlet, weight); dims has beam, nrows, ncols; beamlets run along rows."""
    cells = dims.select("beam", "ncols", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("nrows") * F.col("ncols") - 1).cast("long"))).alias("beamlet"))
    full = cells.join(weights, ["beam", "beamlet"], "left")
    return full.select("beam", F.floor(F.col("beamlet") / F.col("ncols")).cast("int").alias("r"), (F.col("beamlet") % F.col("ncols")).cast("int").alias("c"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def aperture_segments(fluence: DataFrame) -> DataFrame:
    """First and last column of every run of active (non-zero) cells: beam, r, first, last."""
    active = fluence.filter("weight <> 0")
    run = F.col("c") - F.row_number().over(Window.partitionBy("beam", "r").orderBy("c"))
    return active.withColumn("_run", run).groupBy("beam", "r", "_run").agg(F.min("c").alias("first"), F.max("c").alias("last")).drop("_run")


def is_aperture_ready(fluence: DataFrame) -> DataFrame:
    """beam -> ready: no row has more than one run."""
    rows = aperture_segments(fluence).groupBy("beam", "r").agg(F.count("*").alias("n"))
    most = rows.groupBy("beam").agg(F.max("n").alias("n"))
    return fluence.select("beam").distinct().join(most, "beam", "left").select("beam", (F.coalesce("n", F.lit(0)) <= 1).alias("ready"))


def fill_aperture(fluence: DataFrame, fill: float) -> DataFrame:
    """Zero cells between the first and the last active cell of a row get `fill`."""
    row = Window.partitionBy("beam", "r")
    active = F.when(F.col("weight") != 0, F.col("c"))
    inside = (F.col("c") > F.col("_lo")) & (F.col("c") < F.col("_hi")) & (F.col("weight") == 0)
    return fluence.withColumn("_lo", F.min(active).over(row)).withColumn("_hi", F.max(active).over(row)).withColumn("weight", F.when(inside, F.lit(float(fill))).otherwise(F.col("weight"))).drop("_lo", "_hi")


def fluence_gradients(fluence: DataFrame) -> DataFrame:
    """Forward differences between neighbours that are both active: beam, axis, r, c, diff.

    `fluence` holds the active cells only; absent cells are inactive.
    """
    out = []
    for axis, line, along in (("x", "r", "c"), ("y", "c", "r")):
        w = Window.partitionBy("beam", line).orderBy(along)
        x = fluence.withColumn("_at", F.lead(along).over(w)).withColumn("_next", F.lead("weight").over(w))
        out.append(x.filter(F.col("_at") == F.col(along) + 1).select("beam", F.lit(axis).alias("axis"), "r", "c", (F.col("_next") - F.col("weight")).alias("diff")))
    return out[0].unionByName(out[1])


def beam_direction(phi_deg, theta_deg):
    """Unit vector of gantry-like angles in mask axes, as columns x, y, z."""
    phi, theta = F.radians(phi_deg), F.radians(theta_deg)
    return -(F.sin(theta) * F.sin(phi)), -(F.sin(theta) * F.cos(phi)), F.cos(theta)


def blocked_beams(beams: DataFrame, body: DataFrame, iso: tuple[float, float, float], dr2: float = 50.0) -> DataFrame:
    """Adds `blocked` to beams (beam, phi, theta): the ray from the isocentre passes the body's end slice within dr2.

    The end slice is the first or the last slice of the body (i, j, k), on the side of the source.
    """
    x, y, z = beam_direction(F.col("phi"), F.col("theta"))
    ends = body.agg(F.min("k").alias("_lo"), F.max("k").alias("_hi"))
    b = beams.select("*", x.alias("_x"), y.alias("_y"), z.alias("_z")).crossJoin(F.broadcast(ends))
    side = F.when((F.col("_lo") - iso[2]) * F.col("_z") > 0, F.col("_lo")).when((F.col("_hi") - iso[2]) * F.col("_z") > 0, F.col("_hi"))
    t = (side - iso[2]) / F.col("_z")
    b = b.withColumn("_slice", side).withColumn("_px", F.lit(iso[0]) + t * F.col("_x")).withColumn("_py", F.lit(iso[1]) + t * F.col("_y"))
    # the slices' voxels are few; the beams of a plan are at most a few thousand and are sent to them
    rays = b.filter(F.col("_slice").isNotNull()).select("beam", "_slice", "_px", "_py")
    hit = body.join(small(rays), (F.col("k") == F.col("_slice")) & ((F.col("i") - F.col("_px")) ** 2 + (F.col("j") - F.col("_py")) ** 2 < dr2)).select("beam").distinct().withColumn("_hit", F.lit(True))
    return beams.join(hit, "beam", "left").withColumn("blocked", F.coalesce("_hit", F.lit(False))).drop("_hit")


def select_active_beams(norms: DataFrame, eps: float = 1e-2, top: int = 20) -> DataFrame:
    """The `top` beams of largest norm above eps, ties to the smaller beam."""
    return norms.filter(F.col("norm") > eps).orderBy(F.col("norm").desc(), "beam").limit(top)
