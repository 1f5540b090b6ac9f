"""Dose and image volumes as rows of i, j, k, value: arithmetic, resampling, comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewell.operators.distance import whole_lines
from dosewell.operators.dvh import EPS, histogram_of
from dosewell.sources.lineage import small

AT = ["i", "j", "k"]


def _array(offsets):
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", o, strict=True)]) for o in offsets])


def sum_doses(doses: DataFrame, factors: DataFrame) -> DataFrame:
    """Weighted sum of doses (plan, i, j, k, value) on one grid, in Gy.

    factors: plan, factor, offset, unit; a unit that spells cGy is divided by 100. A factor of -1 subtracts.
    """
    gray = F.when(F.lower("unit").isin("cgy", "cgys", "cgray", "centigray", "centigrays"), F.col("value") / 100).otherwise(F.col("value"))
    x = doses.join(small(factors), "plan")
    return x.groupBy(*AT).agg(F.sum((gray + F.col("offset")) * F.col("factor")).alias("value"))


def _both(a: DataFrame, b: DataFrame, how: str = "full", on: tuple[str, ...] = ()) -> DataFrame:
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), [*on, *AT], how)


def _at_point(volume: DataFrame, point: tuple[int, int, int], name: str) -> DataFrame:
    """One row: the value at a place, null where there is none or 0."""
    here = sum((F.col(c) == p).cast("int") for c, p in zip(AT, point, strict=True)) == len(AT)
    return volume.agg(F.max(F.when(here & (F.col("value") != 0), F.col("value"))).alias(name))


def dose_difference(a: DataFrame, b: DataFrame, level_a: float | None = None, level_b: float | None = None, point: tuple[int, int, int] | None = None) -> DataFrame:
    """b - a, absent as 0; with levels both are first scaled to percent of them, with a point to percent of their values there.

    Where a dose has no value at the point, or 0, differences are null.
    """
    if point is not None:
        both = _both(a, b).crossJoin(_at_point(a, point, "_a")).crossJoin(_at_point(b, point, "_b"))  # one row each
        return both.select(*AT, (F.coalesce("b", F.lit(0.0)) / F.col("_b") * 100 - F.coalesce("a", F.lit(0.0)) / F.col("_a") * 100).alias("value"))
    x = F.coalesce("a", F.lit(0.0)) * (100 / level_a if level_a else 1.0)
    y = F.coalesce("b", F.lit(0.0)) * (100 / level_b if level_b else 1.0)
    return _both(a, b).select(*AT, (y - x).alias("value"))


def dose_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """b / a where both exist, null where a is 0."""
    return _both(a, b, "inner").select(*AT, F.when(F.col("a") != 0, F.col("b") / F.col("a")).alias("value"))


def compare_volumes(old: DataFrame, new: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of the `on` columns): sum of absolute differences, the same over the old sum, peaks and sums."""
    x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    s = _both(old, new, on=on).groupBy(*on).agg(F.sum(F.abs(y - x)).alias("abs_difference"), F.sum(x).alias("old_sum"), F.sum(y).alias("new_sum"), F.max(x).alias("old_peak"), F.max(y).alias("new_peak"))
    return s.withColumn("relative_difference", F.col("abs_difference") / F.col("old_sum"))


def _corners(points: DataFrame, keys: list[str]) -> DataFrame:
    """The neighbours of fractional places x, y, z with their weights _w; those without weight go."""
    corners = F.explode(_array([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)])).alias("o")
    x = points.select(*keys, "x", "y", "z", corners)
    weight = F.lit(1.0)
    at = []
    for name, place, side in (("i", "x", "a"), ("j", "y", "b"), ("k", "z", "c")):
        low = F.floor(place)
        part = F.col(place) - low
        weight = weight * F.when(F.col(f"o.{side}") == 1, part).otherwise(1 - part)
        at.append((low + F.col(f"o.{side}")).cast("int").alias(name))
    return x.select(*keys, *at, weight.alias("_w")).filter("_w > 0")


def _weighted(points: DataFrame, volume: DataFrame, keys: list[str]) -> DataFrame:
    """Corners with the volume's values."""
    return _corners(points, keys).join(volume, AT)


def _weighted_by(points: DataFrame, doses: DataFrame, keys: list[str]) -> DataFrame:
    """Trilinear values at x, y, z in the volume that has the same keys."""
    x = _corners(points, keys)
    return x.join(doses, [*keys, *AT]).groupBy(*keys).agg(F.sum(F.col("_w") * F.col("value")).alias("value"))


def resize_trilinear(volume: DataFrame, old: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """The volume on another number of places per axis; centre n is at (n + 0.5) / new * old - 0.5, outside counts 0."""
    spark = volume.sparkSession
    n = new[0] * new[1] * new[2]
    index = F.col("id")
    t = spark.range(n).select((index % new[0]).cast("int").alias("ti"), (F.floor(index / new[0]) % new[1]).cast("int").alias("tj"), F.floor(index / (new[0] * new[1])).cast("int").alias("tk"))
    place = [((F.col(c) + 0.5) / new[d] * old[d] - 0.5).alias(p) for d, (c, p) in enumerate((("ti", "x"), ("tj", "y"), ("tk", "z")))]
    points = t.select("ti", "tj", "tk", *place)
    found = _weighted(points, volume, ["ti", "tj", "tk"]).groupBy("ti", "tj", "tk").agg(F.sum(F.col("_w") * F.col("value")).alias("value"))
    return t.join(found, ["ti", "tj", "tk"], "left").select(F.col("ti").alias("i"), F.col("tj").alias("j"), F.col("tk").alias("k"), F.coalesce("value", F.lit(0.0)).alias("value"))


def sample_at(volume: DataFrame, points: DataFrame, start=(0.0, 0.0, 0.0), step=(1.0, 1.0, 1.0)) -> DataFrame:
    """Trilinear values at points (id, px, py, pz); null where a neighbour with weight is outside the grid."""
    place = [((F.col(c) - s) / d).alias(n) for c, s, d, n in zip(("px", "py", "pz"), start, step, ("x", "y", "z"), strict=True)]
    found = _weighted(points.select("id", *place), volume, ["id"]).groupBy("id").agg(F.sum(F.col("_w") * F.col("value")).alias("_v"), F.sum("_w").alias("_s"))
    return points.join(found, "id", "left").select("id", F.when(F.col("_s") > 1 - 1e-9, F.col("_v")).alias("value"))


def transform_points(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """A 4 x 4 affine transformation of px, py, pz."""
    row = lambda r: F.col("px") * r[0] + F.col("py") * r[1] + F.col("pz") * r[2] + r[3]
    return points.select("id", *[row(r).alias(c) for r, c in zip(matrix, ("px", "py", "pz"), strict=False)])


def downsample(volume: DataFrame, step: tuple[int, int, int]) -> DataFrame:
    """Every n-th place of each axis, numbered anew."""
    keep = (F.col("i") % step[0] == 0) & (F.col("j") % step[1] == 0) & (F.col("k") % step[2] == 0)
    return volume.filter(keep).select(*[F.floor(F.col(c) / s).cast("int").alias(c) for c, s in zip(AT, step, strict=True)], "value")


def hu_to_density(volume: DataFrame, lut: DataFrame) -> DataFrame:
    """Piecewise linear density of `value` (HU) by a table (hu, density), 14 points or so.

    Up to the first point its density holds; beyond the last, the last two points' line goes on.
    """
    w = Window.orderBy("hu")
    n = Window.partitionBy()
    x = lut.withColumn("_h", F.lead("hu").over(w)).withColumn("_d", F.lead("density").over(w)).withColumn("_first", F.min("hu").over(n)).withColumn("_last", F.max("hu").over(n))
    top = F.max("_h").over(n)
    x = x.filter("_h is not null").withColumn("_end", F.when(F.col("_h") == top, F.lit(float("inf"))).otherwise(F.col("_h")))
    x = x.withColumn("_begin", F.when(F.col("hu") == F.col("_first"), F.lit(float("-inf"))).otherwise(F.col("hu"))).drop("_last")
    y = volume.join(small(x), (F.col("value") >= F.col("_begin")) & (F.col("value") < F.col("_end")))
    line = F.col("density") + (F.col("value") - F.col("hu")) / (F.col("_h") - F.col("hu")) * (F.col("_d") - F.col("density"))
    return y.select(*AT, "value", F.when(F.col("value") <= F.col("_first"), F.col("density")).otherwise(line).alias("density_out")).withColumnRenamed("density_out", "density")


def hu_to_density_formula(volume: DataFrame) -> DataFrame:
    return volume.withColumn("density", F.greatest((F.col("value") + 1024) / 1024, F.lit(0.05)))


def edep_to_dose(edep: DataFrame, layers: DataFrame) -> DataFrame:
    """Energy over the density of the layer at its depth: edep has z (depth in cm) and value, layers ord, thickness, density."""
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    x = layers.withColumn("_to", F.sum("thickness").over(w)).withColumn("_from", F.col("_to") - F.col("thickness"))
    return edep.join(small(x), (F.col("z") >= F.col("_from")) & (F.col("z") < F.col("_to"))).select(*edep.columns, (F.col("value") / F.col("density")).alias("dose"))


def ring_dose(edep: DataFrame, dr: float, dz: float, density: float) -> DataFrame:
    """Energy over the mass of a ring: edep has ring (from 0), z and value."""
    mass = F.pi() * ((F.col("ring") + 1) ** 2 - F.col("ring") ** 2) * dr * dr * dz * density
    return edep.withColumn("dose", F.col("value") / mass)


def radiological_depth(density: DataFrame) -> DataFrame:
    """Adds `depth`: the sum of density before each place along k."""
    w = Window.partitionBy("i", "j").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return density.withColumn("depth", F.coalesce(F.sum("value").over(w), F.lit(0.0)))


def combine_spectrum(volumes: DataFrame, spectrum: DataFrame, kernel: bool = False) -> DataFrame:
    """Weighted sum of one volume per energy: by photon count (fluence / energy), or for kernels by fluence x energy x mu."""
    w = F.col("fluence") * F.col("energy") * F.col("mu") if kernel else F.col("fluence") / F.col("energy")
    s = spectrum.withColumn("_w", w)
    s = s.withColumn("_w", F.col("_w") / F.sum("_w").over(Window.partitionBy())).select("energy", "_w")
    return volumes.join(s, "energy").groupBy(*AT).agg(F.sum(F.col("value") * F.col("_w")).alias("value"))


def count_to_energy(counts: DataFrame) -> DataFrame:
    """Shares of the energy that photons of each energy bring: adds `share`, count x energy over its sum."""
    part = F.col("count") * F.col("energy")
    return counts.crossJoin(counts.agg(F.sum(part).alias("_all"))).withColumn("share", part / F.col("_all")).drop("_all")


def _line_sums(rows: DataFrame, axis: str, back: int, ahead: int) -> DataFrame:
    """Sums of the values from `back` places behind to `ahead` before each place of an axis that sees any.

    Places lie in stretches as long as a window; a window's sum is that of the end of one stretch and of the beginning of the
    next, both running sums, so the work for a place doesn't grow with the window and no sum is made by subtracting.
    """
    width = back + ahead + 1
    others = [c for c in AT if c != axis]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begins in whole_lines(batches, axis, "value"):
            pos, value = t.column(axis).to_numpy().astype(np.int64), t.column("value").to_numpy()
            new = np.zeros(len(pos), bool)
            new[begins] = True
            new[1:] |= np.diff(pos) >= width
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(pos)) - 1
            size = pos[last] - pos[first] + width  # from the first place that sees the run to the last
            start = np.cumsum(size + width) - size  # `width` empty places before each run
            run = np.cumsum(new) - 1
            room = -(-int(start[-1] + size[-1] + 2 * width) // width) * width
            dense = np.zeros(room)
            np.add.at(dense, start[run] + pos - pos[first][run], value)
            parts = dense.reshape(-1, width)
            upto, onward = parts.cumsum(axis=1).ravel(), parts[:, ::-1].cumsum(axis=1)[:, ::-1].ravel()
            # a run's place p (from 0) is at first + p - ahead and sees the values at p - width + 1 to p of the run
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            end = np.repeat(start, size) + place
            begin = end - width + 1
            out = np.where(begin % width == 0, upto[end], onward[begin] + upto[end])
            line = t.select(others).take(pa.array(np.repeat(first, size)))
            at = pa.array((place + np.repeat(pos[first], size) - ahead).astype(np.int32))
            yield from pa.table([at if c == axis else line.column(c) for c in AT] + [pa.array(out)], names=[*AT, "value"]).combine_chunks().to_batches()

    return rows.select(*AT, "value").repartition(*others).sortWithinPartitions(*others, axis).mapInArrow(summed, "i int, j int, k int, value double")


def box_filter(volume: DataFrame, width: int) -> DataFrame:
    """Sums over width x width places in the plane, absent ones as 0; an even window reaches one farther ahead.

    Lines along i, then along j, are dealt out whole and summed as streams, one row a place: no value is copied to the places that see it. Null values count 0.
    """
    back, ahead = (width - 1) // 2, width // 2
    sums = volume.select(*[F.col(c).cast("int").alias(c) for c in AT], F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")).dropna(subset=list(AT))
    for c in ("i", "j"):
        sums = _line_sums(sums, c, back, ahead)
    return volume.drop("value").join(sums, list(AT))


def depth_profiles(volume: DataFrame, ci: int, cj: int) -> DataFrame:
    """For each k: centre line, sum of the plane and its mean, each over its largest."""
    x = volume.groupBy("k").agg(F.max(F.when((F.col("i") == ci) & (F.col("j") == cj), F.col("value"))).alias("centre"), F.sum("value").alias("partial"), F.avg("value").alias("mean"))
    top = Window.partitionBy()
    return x.select("k", *[(F.col(c) / F.max(c).over(top)).alias(c) for c in ("centre", "partial", "mean")])


def inverse_square(volume: DataFrame, sad: float, spacing: float, centre: float) -> DataFrame:
    """Values times (SAD / r)^2 with r the distance of the plane from the source."""
    r = F.lit(sad) + (F.col("k") - centre) * spacing
    return volume.withColumn("value", F.col("value") * (sad / r) ** 2)


def l2_scale(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """b times the factor that brings it closest to a (sum ab / sum b^2), and the factor; one factor for each value of the `on` columns."""
    factor = _both(a, b, "inner", on).groupBy(*on).agg((F.sum(F.col("a") * F.col("b")) / F.sum(F.col("b") * F.col("b"))).alias("factor"))
    scaled = b.join(factor, list(on)) if on else b.crossJoin(F.broadcast(factor))
    return scaled.withColumn("value", F.col("value") * F.col("factor"))


def value_centroid(volume: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Value-weighted centre of each plane and (k null) of the whole volume, for each value of the `on` columns."""
    v = F.sum("value")
    centres = [(F.sum(F.col(c) * F.col("value")) / v).alias(f"c{c}") for c in ("i", "j")] + [(F.sum(F.col("z") * F.col("value")) / v).alias("ck"), v.alias("total")]
    planes = volume.withColumn("z", F.col("k"))
    if not on:
        return planes.rollup("k").agg(*centres)
    return planes.groupBy(*on, "k").agg(*centres).unionByName(planes.groupBy(*on).agg(F.lit(None).cast("int").alias("k"), *centres))


def z_index(centroid: DataFrame, masks: DataFrame, structure: str) -> DataFrame:
    """Adds 1 - (z - least) / (greatest - least) of another structure's extent."""
    e = masks.filter(F.col("structure") == structure).agg(F.min("k").alias("_lo"), F.max("k").alias("_hi"))
    return centroid.crossJoin(F.broadcast(e)).withColumn("z_index", 1 - (F.col("ck") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def shadow(volume: DataFrame, masks: DataFrame, structure: str, axis: str, mode: str = "max") -> DataFrame:
    """Projection along an axis inside a structure, with the first slice of the extreme (null for the mean)."""
    x = masks.filter(F.col("structure") == structure).select(*AT).distinct().join(volume, AT)
    plane = [c for c in AT if c != axis]
    if mode == "mean":
        return x.groupBy(*plane).agg(F.avg("value").alias("value"), F.lit(None).cast("int").alias("slice"))
    best = F.max("value") if mode == "max" else F.min("value")
    order = F.struct((-F.col("value") if mode == "max" else F.col("value")).alias("v"), F.col(axis))
    return x.groupBy(*plane).agg(best.alias("value"), F.min_by(axis, order).alias("slice"))


def gamma_index(reference: DataFrame, evaluated: DataFrame, dose_criterion: float, distance: float, spacing=(1.0, 1.0, 1.0), reach: float | None = None, threshold: float = 0.0) -> DataFrame:
    """Gamma of every reference voxel: the least sqrt(difference^2 / criterion^2 + r^2 / distance^2) around it.

    The window is a box of half-width `reach` (twice the distance by default); voxels at or below the
    threshold have 0, and places off the evaluated grid don't count. Voxels meet in slabs along k with
    the window's margin, and NumPy takes the least in each.
    """
    reach = 2 * distance if reach is None else reach
    half = [int(reach // s) for s in spacing]
    slab = max(4, 2 * half[2])
    low = reference.filter(F.col("value") <= threshold).select(*AT, F.lit(0.0).alias("gamma"))
    r = reference.filter(F.col("value") > threshold).select(F.floor(F.col("k") / slab).cast("int").alias("slab"), *AT, F.col("value").alias("r"), F.lit(None).cast("double").alias("e"))
    near = F.explode(F.sequence(F.floor((F.col("k") - half[2]) / slab).cast("int"), F.floor((F.col("k") + half[2]) / slab).cast("int"))).alias("slab")
    e = evaluated.select(near, *AT, F.lit(None).cast("double").alias("r"), F.col("value").alias("e"))

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        own, other = pdf[pdf["r"].notna()], pdf[pdf["e"].notna()]
        out = pd.DataFrame({c: own[c].astype("int32") for c in AT})
        if not len(own) or not len(other):
            return out.assign(gamma=np.nan)
        lo = np.minimum(own[AT].min().to_numpy() - half, other[AT].min().to_numpy()).astype(int)
        hi = np.maximum(own[AT].max().to_numpy() + half, other[AT].max().to_numpy()).astype(int)
        grid = np.full(tuple(hi - lo + 1), np.nan)
        at = other[AT].to_numpy(int) - lo
        grid[at[:, 0], at[:, 1], at[:, 2]] = other["e"]
        p, d = own[AT].to_numpy(int) - lo, own["r"].to_numpy()
        best = np.full(len(own), np.inf)
        for a in range(-half[0], half[0] + 1):
            for b in range(-half[1], half[1] + 1):
                for c in range(-half[2], half[2] + 1):
                    r2 = (a * spacing[0]) ** 2 + (b * spacing[1]) ** 2 + (c * spacing[2]) ** 2
                    v = (grid[p[:, 0] + a, p[:, 1] + b, p[:, 2] + c] - d) ** 2 / dose_criterion**2 + r2 / distance**2
                    best = np.fmin(best, v)
        return out.assign(gamma=np.where(np.isinf(best), np.nan, np.sqrt(best)))

    found = r.unionByName(e).groupBy("slab").applyInPandas(least, "i int, j int, k int, gamma double")
    return found.withColumn("gamma", F.nanvl("gamma", F.lit(None))).unionByName(low.select(*[F.col(c).cast("int").alias(c) for c in AT], "gamma"))


def gamma_histogram(gamma: DataFrame, masks: DataFrame, voxel_volume: float, edges: list[float] | None = None) -> DataFrame:
    """Volume of each structure in gamma bins (0.1 to 10, the last one open), and its pass rate (gamma up to 1)."""
    edges = edges or [0.1 * n for n in range(1, 101)]
    number = F.least(F.greatest(F.ceil(F.round(F.col("gamma") / edges[0], 9)), F.lit(1)), F.lit(len(edges))).cast("int")
    x = masks.select("structure", *AT).distinct().join(gamma, AT).filter("gamma is not null")
    counts = x.groupBy("structure", number.alias("bin")).agg(F.count("*").alias("_n"), F.sum((F.col("gamma") <= 1).cast("int")).alias("_p"))
    w = Window.partitionBy("structure")
    return counts.select("structure", "bin", (F.col("_n") * voxel_volume).alias("volume"), (F.sum("_p").over(w) / F.sum("_n").over(w)).alias("pass_rate"))


def weighted_mean(values: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse-variance mean of (value, error), its error 1 / sqrt(sum 1 / error^2), and the plain spread."""
    w = 1 / (F.col("error") * F.col("error"))
    return values.groupBy(*keys).agg((F.sum(F.col("value") * w) / F.sum(w)).alias("mean"), (1 / F.sqrt(F.sum(w))).alias("mean_error"), F.stddev_samp("value").alias("spread"))


def energy_deposited(dose: DataFrame, density: DataFrame, masks: DataFrame, voxel_volume: float) -> DataFrame:
    """Sum of dose x density x voxel volume of each structure, and its dosed voxels."""
    x = masks.select("structure", *AT).distinct().join(_both(dose, density, "inner"), AT)
    return x.groupBy("structure").agg((F.sum(F.col("a") * F.col("b")) * voxel_volume).alias("energy"), F.sum((F.col("a") > 0).cast("int")).alias("dosed_voxels"))


#: Places of a tile along each axis, and the most shifts (trials x fractions) of a robust histogram.
TILE, SHIFTS = (64, 64, 16), 1 << 20


def robust_dvh(volume: DataFrame, masks: DataFrame, shifts: DataFrame, width: float, voxel_volume: float) -> DataFrame:
    """Spread over trials of the DVH under position shifts: structure, bin, dose, mean_volume, std_volume.

    shifts: trial, fraction, sx, sy, sz, a row for each fraction. A voxel's dose in a trial is the mean
    of the trilinear dose at its shifted places, outside as 0; a bin that a trial lacks counts 0.
    A shift has the same eight weights for all voxels, so tiles of dose with a margin as wide as the largest shift meet
    the tile's masks once and do all trials there; they give counts of bins. Shifts are a plan's table of some thousand rows and
    go to every task; more than SHIFTS are an error. Rows of the dose that repeat a place add.
    """
    rows = shifts.select(F.col("trial").cast("string").alias("trial"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("sx", "sy", "sz")]).orderBy("trial").limit(SHIFTS + 1).collect()
    if len(rows) > SHIFTS:
        raise ValueError(f"more than {SHIFTS} shifts")
    trials: dict[str, list[np.ndarray]] = {}
    for trial, *way in rows:
        trials.setdefault(trial, []).append(np.array(way))
    margin = [max([1] + [int(np.ceil(abs(w[c]))) + 1 for own in trials.values() for w in own]) for c in range(3)]
    size = [max(t, m) for t, m in zip(TILE, margin)]
    tile = [f"_t{c}" for c in AT]
    dose = volume.select(*[F.col(c).cast("int").alias(c) for c in AT], F.col("value").cast("double").alias("value")).dropna()
    for c, t, m, n in zip(AT, size, margin, tile):  # a voxel also goes to the tiles in whose margin it lies
        dose = dose.withColumn(n, F.explode(F.sequence(F.floor((F.col(c) - m) / t), F.floor((F.col(c) + m) / t))))
    own = masks.select("structure", *[F.col(c).cast("int").alias(c) for c in AT]).dropna(subset=list(AT))
    own = own.withColumns({n: F.floor(F.col(c) / t) for c, t, n in zip(AT, size, tile)})

    def run(key, dose: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = {n: [] for n in ("plan", "structure", "_up", "_plain", "volume", "_min")}
        if len(own):
            low = np.array([key[c] * size[c] - margin[c] for c in range(3)])
            grid = np.zeros([t + 2 * m + 1 for t, m in zip(size, margin)])
            at = dose[AT].to_numpy(int) - low
            np.add.at(grid, tuple(at.T), dose["value"].to_numpy())
            places, index = np.unique(own[AT].to_numpy(int) - low, axis=0, return_inverse=True)
            structure, names = pd.factorize(own["structure"], use_na_sentinel=False)
            for trial, ways in trials.items():
                total = np.zeros(len(places))
                for way in ways:
                    base = np.floor(way)
                    part = way - base
                    for corner in np.ndindex(2, 2, 2):
                        weight = np.prod(np.where(corner, part, 1 - part))
                        if weight > 0:
                            total += weight * grid[tuple((places + base.astype(int) + corner).T)]
                value = (total / len(ways))[index.ravel()]
                found = pd.DataFrame({"structure": structure, "_up": np.ceil(value / width + EPS), "_plain": np.ceil(value / width), "value": value}).groupby(["structure", "_up", "_plain"])["value"].agg(["size", "min"]).reset_index()
                for n, v in (("plan", [trial] * len(found)), ("structure", [names[s] for s in found["structure"]]), ("_up", found["_up"].astype(int)), ("_plain", found["_plain"].astype(int)), ("volume", found["size"] * voxel_volume), ("_min", found["min"])):
                    out[n].extend(v)
        kinds = {"plan": object, "structure": object, "_up": np.int64, "_plain": np.int64, "volume": float, "_min": float}
        return pd.DataFrame({n: pd.Series(np.array(v, kinds[n]) if v else np.zeros(0, kinds[n])) for n, v in out.items()})

    counted = dose.groupBy(*tile).cogroup(own.groupBy(*tile)).applyInPandas(run, "plan string, structure string, _up long, _plain long, volume double, _min double")
    both = counted.groupBy("plan", "structure", "_up", "_plain").agg(F.sum("volume").alias("volume"), F.min("_min").alias("_min"))
    s = histogram_of(both, width).groupBy("structure", "bin", "dose").agg(F.sum("volume").alias("_s"), F.sum(F.col("volume") * F.col("volume")).alias("_q")).withColumn("_t", F.lit(len(trials)))
    mean = F.col("_s") / F.col("_t")
    return s.select("structure", "bin", "dose", mean.alias("mean_volume"), F.sqrt(F.greatest((F.col("_q") - F.col("_t") * mean * mean) / (F.col("_t") - 1), F.lit(0.0))).alias("std_volume"))


def tally(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Energy of each detector and bin over all hits and runs."""
    return hits.groupBy(*keys).agg(F.sum("energy").alias("energy"), F.count("*").alias("hits"))


def recentred(hits: DataFrame, events: DataFrame, least: float, most: float) -> DataFrame:
    """Hits of events whose interaction depth is in [least, most), with depth counted from there."""
    chosen = events.filter((F.col("interaction") >= least) & (F.col("interaction") < most))
    return hits.join(chosen, "event").withColumn("depth", F.col("depth") - F.floor("interaction"))


def stack_slabs(edep: DataFrame, slab_depth: int) -> DataFrame:
    """Slab files along depth: z becomes slab * slab_depth + the place inside the slab."""
    return edep.withColumn("z", F.col("slab") * slab_depth + F.col("z")).drop("slab")

