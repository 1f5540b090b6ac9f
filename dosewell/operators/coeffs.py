"""The sparse dose-coefficient matrix as long rows: beam, beamlet, voxel, coeff.

Rows that repeat a (beamlet, voxel) add, as in sparse-matrix constructors; operators that must see
one row for each say so. Sums are of doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMN = ("beam", "beamlet")


def explode_coeffs(packed: DataFrame) -> DataFrame:
    """Rows of packed beamlets (arrays lindex and coeffs); arrays of different lengths are an error."""
    agree = F.assert_true(F.size("lindex") == F.size("coeffs"), F.lit("lindex and coeffs differ in length"))
    pairs = packed.filter(agree.isNull()).select("beam", "beamlet", F.explode(F.arrays_zip("lindex", "coeffs")).alias("z"))
    return pairs.select("beam", "beamlet", F.col("z.lindex").cast("long").alias("voxel"), F.col("z.coeffs").cast("double").alias("coeff"))


def pack_coeffs(coo: DataFrame) -> DataFrame:
    """A row for each beamlet with arrays in the order of voxels, and n_coeffs."""
    packed = coo.groupBy(*COLUMN).agg(F.array_sort(F.collect_list(F.struct("voxel", "coeff"))).alias("z"))
    return packed.select(*COLUMN, F.col("z.voxel").alias("lindex"), F.col("z.coeff").alias("coeffs"), F.size("z").alias("n_coeffs"))


def partition_beams(coo: DataFrame, per_part: int = 100) -> DataFrame:
    """Adds `part`: beams in sorted order, per_part to a part. Only distinct beams are ranked."""
    beams = coo.select("beam").distinct()
    ranked = beams.select("beam", F.floor((F.row_number().over(Window.orderBy("beam")) - 1) / per_part).cast("int").alias("part"))
    return coo.join(ranked, "beam")


def sparsify(coo: DataFrame, thresh: float) -> DataFrame:
    """Keeps coefficients above `thresh` times the largest of their beamlet."""
    top = F.max("coeff").over(Window.partitionBy(*COLUMN))
    return coo.withColumn("_top", top).filter(F.col("coeff") > F.col("_top") * thresh).drop("_top")


def sparsity(coo: DataFrame, thresh: float, box: int) -> DataFrame:
    """What `sparsify` keeps and drops of each beamlet, in percent of the box; only positive values are dropped."""
    top = F.max("coeff").over(Window.partitionBy(*COLUMN))
    kept = F.col("coeff") > F.col("_top") * thresh
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)) * 100.0 / box
    return coo.withColumn("_top", top).groupBy(*COLUMN).agg(count(kept).alias("perc_nonzero"), count(~kept & (F.col("coeff") > 0)).alias("perc_dropped"))


def prune_global(coo: DataFrame, thresh: float) -> DataFrame:
    """Keeps coefficients of at least `thresh` times the largest of all."""
    top = coo.agg(F.max("coeff").alias("_top"))  # one row
    return coo.crossJoin(F.broadcast(top)).filter(F.col("coeff") >= F.col("_top") * thresh).drop("_top")


def apply_weights(coo: DataFrame, weights: DataFrame) -> DataFrame:
    """d = A w: dose for each voxel; a beamlet without a weight adds nothing."""
    return coo.join(weights, list(COLUMN), "left").groupBy("voxel").agg(F.sum(F.col("coeff") * F.coalesce("weight", F.lit(0.0))).alias("dose"))


def apply_transpose(coo: DataFrame, residual: DataFrame) -> DataFrame:
    """g = A' r: for each beamlet; a voxel without a residual adds nothing."""
    return coo.join(residual, "voxel", "left").groupBy(*COLUMN).agg(F.sum(F.col("coeff") * F.coalesce("residual", F.lit(0.0))).alias("gradient"))


def total_dose(coo: DataFrame) -> DataFrame:
    """Dose of unit weights."""
    return coo.groupBy("voxel").agg(F.sum("coeff").alias("dose"))


def prune_error(full: DataFrame, pruned: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: |M'w - Mw| / |Mw| and the share of rows that are left."""
    a = apply_weights(full, weights).withColumnRenamed("dose", "a")
    b = apply_weights(pruned, weights).withColumnRenamed("dose", "b")
    x = F.coalesce("a", F.lit(0.0))
    y = F.coalesce("b", F.lit(0.0))
    error = a.join(b, "voxel", "full").agg((F.sqrt(F.sum((y - x) * (y - x))) / F.sqrt(F.sum(x * x))).alias("relative_error"))
    ratio = full.agg(F.count("*").alias("n")).crossJoin(pruned.agg(F.count("*").alias("m"))).select((F.col("m") / F.col("n")).alias("nnz_ratio"))
    return error.crossJoin(ratio)


def column_index(coo: DataFrame) -> DataFrame:
    """A number from 0 for each (beam, beamlet) in order: beams' sizes first, then ranks inside a beam."""
    keys = coo.select(*COLUMN).distinct()
    sizes = keys.groupBy("beam").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("beam").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("beam", F.coalesce(before, F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("beam").orderBy("beamlet")) - 1
    return keys.withColumn("_rank", rank).join(starts, "beam").select(*COLUMN, (F.col("_start") + F.col("_rank")).alias("col"))


def select_columns(coo: DataFrame, beams: DataFrame) -> DataFrame:
    """Coefficients of the chosen beams with their columns numbered anew."""
    chosen = coo.join(beams.select("beam").distinct(), "beam", "left_semi")
    return chosen.join(column_index(chosen), list(COLUMN)).select(*COLUMN, "col", "voxel", "coeff")


def reduce_by_roi(coo: DataFrame, masks: DataFrame, rois: DataFrame) -> DataFrame:
    """Rows of the ROI-ordered matrix: beam, beamlet, roi, row, coeff.

    `masks` has structure, i, j, k and voxel, `rois` structure and ord. A row is the size of the
    ROIs before plus the voxel's rank in its ROI by i, j, k; a voxel in two ROIs gives two rows;
    voxels in none and zero coefficients go.
    """
    inside = masks.join(rois, "structure")
    # planes are counted first and ranked each by itself, as one structure may hold most voxels
    rank = F.row_number().over(Window.partitionBy("structure", "i").orderBy("j", "k")) - 1
    before = F.sum("_n").over(Window.orderBy("ord", "i").rowsBetween(Window.unboundedPreceding, -1))  # a row for each plane of a structure
    starts = inside.groupBy("structure", "ord", "i").agg(F.count("*").alias("_n")).select("structure", "i", F.coalesce(before, F.lit(0)).alias("_start"))
    rows = inside.withColumn("_rank", rank).join(starts, ["structure", "i"]).select(F.col("structure").alias("roi"), "voxel", (F.col("_start") + F.col("_rank")).alias("row"))
    return coo.filter("coeff <> 0").join(rows, "voxel").select(*COLUMN, "roi", "row", "coeff")


def row_block_sizes(reduced: DataFrame) -> DataFrame:
    """Non-zeros of each beamlet in each ROI."""
    return reduced.groupBy(*COLUMN, "roi").agg(F.count("*").alias("n"))


def permute_xy(coo: DataFrame, nx: int, ny: int) -> DataFrame:
    """Swaps the first two axes of the linear index (k*ny + j)*nx + i, which becomes (k*nx + i)*ny + j."""
    i, rest = F.col("voxel") % nx, F.floor(F.col("voxel") / nx)
    j, k = rest % ny, F.floor(rest / ny)
    return coo.withColumn("voxel", ((k * nx + i) * ny + j).cast("long"))


def mask_dose(dose: DataFrame, masks: DataFrame, keep: list[str]) -> DataFrame:
    """Dose with 0 outside the union of the named structures."""
    inside = masks.filter(F.col("structure").isin(keep)).select("voxel", F.lit(1).alias("_in")).distinct()
    return dose.join(inside, "voxel", "left").withColumn("dose", F.when(F.col("_in").isNotNull(), F.col("dose")).otherwise(0.0)).drop("_in")


def beam_weights(coo: DataFrame, masks: DataFrame, target: str, floor: float = 0.1) -> DataFrame:
    """sqrt(mean target dose / sqrt(beamlets)) of each beam with unit weights, over the largest, at least `floor`.

    The mean is over all target voxels, with those that a beam doesn't reach as 0. Coefficients are neither grouped nor sorted: they
    stream past their share of the target's voxels, and sums by beam are what is held.
    """
    voxels = masks.filter(F.col("structure") == target).select("voxel").distinct()
    beams = coo.groupBy("beam").agg(F.count_distinct("beamlet").alias("_m"))
    hit = coo.join(voxels.hint("shuffle_hash"), "voxel", "left_semi").groupBy("beam").agg(F.sum("coeff").alias("_d"))
    size = voxels.agg(F.count("*").alias("_n"))
    raw = F.sqrt(F.coalesce("_d", F.lit(0.0)) / F.col("_n") / F.sqrt(F.col("_m").cast("double")))
    x = beams.join(hit, "beam", "left").crossJoin(F.broadcast(size)).select("beam", raw.alias("_w"))
    top = x.agg(F.max("_w").alias("_top"))
    return x.crossJoin(F.broadcast(top)).select("beam", F.greatest(F.col("_w") / F.col("_top"), F.lit(floor)).alias("weight"))


def structure_rows(masks: DataFrame, info: DataFrame, mod: int = 1) -> DataFrame:
    """Row blocks of the optimisation: structure, kind, block, voxel, i, j, k.

    `masks` has structure, i, j, k, voxel; `info` structure, ord, target (boolean) and the weights
    max_weight, min_weight, oar_weight. Targets come first, each without what lies within a voxel of
    earlier ones; other structures lose what lies within a voxel of the first target. Structures
    without any weight go, and only voxels whose 1-based indices are multiples of `mod` stay.
    """
    has = F.coalesce("max_weight", F.lit(0.0)) != 0
    for c in ("min_weight", "oar_weight"):
        has = has | (F.coalesce(c, F.lit(0.0)) != 0)
    used = info.filter(has)
    x = masks.join(used.select("structure", "ord", "target"), "structure")
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])).alias("o")
    grown = x.filter("target").select("ord", (F.col("i")).alias("i0"), F.col("j").alias("j0"), F.col("k").alias("k0"), near)
    grown = grown.select((F.col("i0") + F.col("o.a")).alias("i"), (F.col("j0") + F.col("o.b")).alias("j"), (F.col("k0") + F.col("o.c")).alias("k"), "ord").groupBy("i", "j", "k").agg(F.min("ord").alias("_first"))
    primary = x.filter("target").agg(F.min("ord").alias("_primary"))
    y = x.join(grown, ["i", "j", "k"], "left").crossJoin(F.broadcast(primary))
    free = F.when(F.col("target"), F.coalesce(F.col("_first") >= F.col("ord"), F.lit(True))).otherwise(F.coalesce(F.col("_first") > F.col("_primary"), F.lit(True)))
    on_grid = ((F.col("i") + 1) % mod == 0) & ((F.col("j") + 1) % mod == 0) & ((F.col("k") + 1) % mod == 0)
    return y.filter(free & on_grid).select("structure", F.when(F.col("target"), "target").otherwise("oar").alias("kind"), (F.when(F.col("target"), 0).otherwise(1)).alias("block"), "voxel", "i", "j", "k")


def matrix_stats(coo: DataFrame) -> DataFrame:
    """One row: nnz, rows, cols, density in percent, bytes of (8-byte index, 8-byte value) pairs."""
    nnz, rows, cols = F.count("*"), F.count_distinct("voxel"), F.count_distinct("beam", "beamlet")
    return coo.agg(nnz.alias("nnz"), rows.alias("rows"), cols.alias("cols")).select("nnz", "rows", "cols", (F.col("nnz") * 100.0 / F.col("rows") / F.col("cols")).alias("density"), (F.col("nnz") * 16).alias("bytes"))
