"""Image statistics and texture features of structures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewell.operators.graph import components
from dosewell.operators.ranks import exact_quantiles
from dosewell.sources.lineage import cut, dealt

AT = ["i", "j", "k"]
EPS = 2.220446049250313e-16
#: One of each pair of opposite directions to the 26 neighbours, and those in the plane.
DIRECTIONS_3D = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (c, b, a) > (0, 0, 0)]
DIRECTIONS_2D = [d for d in DIRECTIONS_3D if d[2] == 0]


def first_order(scan: DataFrame, masks: DataFrame, voxel_volume: float) -> DataFrame:
    """Statistics of each structure's values; sample std and var, population skewness, kurtosis that is 3 for a normal distribution."""
    x = masks.select("structure", *AT).distinct().join(scan, AT).select("structure", "value")
    mean = x.groupBy("structure").agg(F.avg("value").alias("_m"))
    v = F.col("value")
    y = x.join(mean, "structure")
    out = y.groupBy("structure").agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), (F.max(v) - F.min(v)).alias("range"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("var"), F.max("_m").alias("_mean"),
        F.skewness(v).alias("skewness"), (F.kurtosis(v) + 3).alias("kurtosis"), F.sqrt(F.avg(v * v)).alias("rms"), (F.sum(v * v) * voxel_volume).alias("energy"), F.avg(F.abs(v - F.col("_m"))).alias("mean_abs_deviation"),
    )
    return out.drop("_mean").join(exact_quantiles(x, ["structure"], "value", {"median": 0.5}), "structure")


def histogram_entropy(values: DataFrame, n: int = 256) -> DataFrame:
    """-sum p log2 p over n bins of equal width between the least and the largest value of each structure."""
    ends = values.groupBy("structure").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("*").alias("_n"))
    x = values.join(ends, "structure")
    bin_ = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * n), F.lit(n - 1))).otherwise(0)
    c = x.groupBy("structure", "_n", bin_.alias("bin")).agg(F.count("*").alias("_c"))
    p = F.col("_c") / F.col("_n")
    return c.groupBy("structure").agg((-F.sum(p * F.log2(p)) + 0.0).alias("entropy"))


def quantise(scan: DataFrame, masks: DataFrame, levels: int, equal_width: bool = False) -> DataFrame:
    """structure, i, j, k, level from 1 to `levels`: linear rounding, or intervals (low, high] of equal width."""
    x = dealt(masks.select("structure", *AT), *AT).distinct().join(scan, AT)
    ends = x.groupBy("structure").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    at = (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    level = F.greatest(F.ceil(at * levels), F.lit(1)) if equal_width else F.floor(at * (levels - 1) + 1 + 0.5)
    return x.join(ends, "structure").select("structure", *AT, F.when(F.col("_hi") > F.col("_lo"), level).otherwise(1).cast("int").alias("level"))


def _grid(pdf: pd.DataFrame, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """(levels as a dense array with an empty margin, each row's place in it); 0 where there is no voxel."""
    lo = pdf[AT].min().to_numpy(int) - margin
    at = pdf[AT].to_numpy(int) - lo
    out = np.zeros(tuple(at.max(axis=0) + margin + 1), np.int32)
    out[at[:, 0], at[:, 1], at[:, 2]] = pdf["level"]
    return out, at


def cooccurrence(quantised: DataFrame, offsets=DIRECTIONS_3D) -> DataFrame:
    """Shares of level pairs of neighbours inside the structure, symmetric: structure, l1, l2, p.

    Voxels are dealt out in blocks of slices with the slices around them; a block's pairs are counted by NumPy, so
    what moves is about one copy of each voxel and some counts.
    """
    reach = max(max(map(abs, o)) for o in offsets)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, at = _grid(pdf, reach)
        own = at[pdf["own"].to_numpy(bool)]
        top = int(pdf["level"].max()) + 1
        total = np.zeros(top * top, np.int64)
        u = grid[own[:, 0], own[:, 1], own[:, 2]]
        for a, b, c in offsets:
            v = grid[own[:, 0] + a, own[:, 1] + b, own[:, 2] + c]
            total += np.bincount((u * top + v)[v > 0], minlength=top * top)
        pair = np.flatnonzero(total)
        return pd.DataFrame({"structure": pdf["structure"].iloc[0], "l1": pair // top, "l2": pair % top, "n": total[pair]})

    pairs = _blocks(quantised, 8, reach).groupBy("structure", "block").applyInPandas(count, "structure string, l1 int, l2 int, n long")
    both = pairs.union(pairs.select("structure", F.col("l2").alias("l1"), F.col("l1").alias("l2"), "n")).groupBy("structure", "l1", "l2").agg(F.sum("n").alias("n"))
    return both.select("structure", "l1", "l2", (F.col("n") / F.sum("n").over(Window.partitionBy("structure"))).alias("p"))


def cooccurrence_features(p: DataFrame, levels: int) -> DataFrame:
    """Energy, entropy, contrast, inverse difference moment, sum average, correlations, cluster shade and prominence."""
    m = p.groupBy("structure").agg(F.sum(F.col("l1") * F.col("p")).alias("_m"), F.sum(F.col("l1") * F.col("l1") * F.col("p")).alias("_q"))
    shares = p.groupBy("structure", "l1").agg(F.sum("p").alias("_x")).groupBy("structure").agg(F.sum(F.col("_x") * F.col("_x")).alias("_px2"))
    x = p.join(m.join(shares, "structure"), "structure")
    # the spread of level shares around 1 / levels, as shares add up to 1
    spread = (F.max("_px2") - 1 / levels) / levels
    haralick = (F.sum(F.col("l1") * F.col("l2") * F.col("p")) - 1 / levels**2) / (spread + EPS)
    d, s = F.col("l1") - F.col("l2"), F.col("l1") + F.col("l2") - 2 * F.col("_m")
    variance = F.max(F.col("_q") - F.col("_m") * F.col("_m"))
    covariance = F.sum((F.col("l1") - F.col("_m")) * (F.col("l2") - F.col("_m")) * F.col("p"))
    return x.groupBy("structure").agg(
        F.sum(F.col("p") * F.col("p")).alias("energy"), (-F.sum(F.col("p") * F.log2(F.col("p") + 1e-10))).alias("entropy"), F.sum(d * d * F.col("p")).alias("contrast"), F.sum(F.col("p") / (1 + d * d)).alias("inverse_difference"),
        F.sum((F.col("l1") + F.col("l2")) * F.col("p")).alias("sum_average"), F.when(variance > 0, covariance / variance).alias("correlation"), F.sum(F.pow(s, F.lit(3)) * F.col("p")).alias("cluster_shade"), F.sum(F.pow(s, F.lit(4)) * F.col("p")).alias("cluster_prominence"), haralick.alias("haralick_correlation"),
    )


def _blocks(quantised: DataFrame, size: int, halo: int) -> DataFrame:
    """Rows dealt out with the blocks of k that need them; `own` says that a block holds the voxel itself."""
    at = F.explode(F.sequence(F.floor((F.col("k") - halo) / size).cast("int"), F.floor((F.col("k") + halo) / size).cast("int"))).alias("block")
    rows = quantised.select("structure", *AT, "level", at).withColumn("own", F.floor(F.col("k") / size) == F.col("block"))
    return dealt(rows, "structure", "block")


#: Numbers of level pairs of patches that a task holds at a time.
PATCH_CELLS = 1 << 22


def _patch_features(p: np.ndarray, levels: int) -> dict[str, np.ndarray]:
    """Features of rows of level-pair shares, as in `cooccurrence_features`."""
    n = np.arange(levels * levels)
    l1, l2 = n // levels + 1.0, n % levels + 1.0
    some, m = p.sum(axis=1) > 0, 2 * (p @ l1)
    s1, s2, s3, s4 = (p @ (l1 + l2) ** k for k in (1, 2, 3, 4))
    product, variance = p @ (l1 * l2), p @ l1**2 - m * m / 4
    shares = p.reshape(len(p), levels, levels).sum(axis=2)
    spread = ((shares * shares).sum(axis=1) - 1 / levels) / levels
    correlation = np.divide(product - m * m / 4, variance, out=np.full(len(p), np.nan), where=variance > 1e-12)
    return {
        "energy": (p * p).sum(axis=1), "entropy": -(p * np.log2(p + 1e-10)).sum(axis=1), "contrast": p @ (l1 - l2) ** 2, "inverse_difference": p @ (1 / (1 + (l1 - l2) ** 2)), "sum_average": s1,
        "correlation": correlation, "cluster_shade": s3 - 3 * m * s2 + 3 * m * m * s1 - m**3 * some, "cluster_prominence": s4 - 4 * m * s3 + 6 * m * m * s2 - 4 * m**3 * s1 + m**4 * some,
        "haralick_correlation": np.where(some, (product - 1 / levels**2) / (spread + EPS), np.nan),
    }


FEATURES = ("energy", "entropy", "contrast", "inverse_difference", "sum_average", "correlation", "cluster_shade", "cluster_prominence", "haralick_correlation")


def texture_map(quantised: DataFrame, levels: int, reach: int = 1, offsets=DIRECTIONS_3D) -> DataFrame:
    """The features of level pairs in the box of half-width `reach` around each voxel; correlations are null where undefined.

    Voxels are dealt out in blocks of slices with the slices around them, and each block is done by
    NumPy, some voxels at a time.
    """
    box = [(a, b, c) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) for c in range(-reach, reach + 1)]
    inside = set(box)
    steps = [(q, r) for o in offsets for q in box if (r := (q[0] + o[0], q[1] + o[1], q[2] + o[2])) in inside]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, at = _grid(pdf, reach)
        mine = pdf["own"].to_numpy(bool)
        out, parts = pdf.loc[mine, ["structure", *AT]], []
        for lo in range(0, int(mine.sum()), max(1, PATCH_CELLS // levels**2)):
            own = at[mine][lo : lo + max(1, PATCH_CELLS // levels**2)]
            counts = np.zeros(len(own) * levels * levels)
            row = np.arange(len(own)) * levels * levels
            for q, r in steps:
                u = grid[own[:, 0] + q[0], own[:, 1] + q[1], own[:, 2] + q[2]]
                v = grid[own[:, 0] + r[0], own[:, 1] + r[1], own[:, 2] + r[2]]
                some = (u > 0) & (v > 0)
                # a step gives a voxel one pair, so no place is met twice
                counts[(row + (u - 1) * levels + v - 1)[some]] += 1
                counts[(row + (v - 1) * levels + u - 1)[some]] += 1
            counts = counts.reshape(len(own), -1)
            total = counts.sum(axis=1, keepdims=True)
            parts.append(pd.DataFrame(_patch_features(np.divide(counts, total, out=np.zeros_like(counts), where=total > 0), levels)))
        features = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=FEATURES, dtype=float)
        return pd.concat([out.reset_index(drop=True), features], axis=1)

    found = _blocks(quantised, 8, reach).groupBy("structure", "block").applyInPandas(run, "structure string, i int, j int, k int, " + ", ".join(f"{f} double" for f in FEATURES))
    return found.withColumns({f: F.when(~F.isnan(f), F.col(f)) for f in ("correlation", "haralick_correlation")})


def joined_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links (u, v) reach, by hooking roots and halving paths."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def size_zones(quantised: DataFrame) -> DataFrame:
    """How many 26-connected zones of each level and size a structure has: structure, level, size, n.

    Zones are found inside blocks of slices by NumPy first; zones that touch across blocks are then joined
    by contraction of the graph of their links, in some log2(blocks) passes however long a zone is.
    """
    size = 8

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = pdf[AT].min().to_numpy(int) - 1
        at = pdf[AT].to_numpy(int) - lo
        number = np.full(tuple(at.max(axis=0) + 2), -1, np.int64)
        number[at[:, 0], at[:, 1], at[:, 2]] = np.arange(len(pdf))
        level, links = pdf["level"].to_numpy(), []
        for a, b, c in DIRECTIONS_3D:
            other = number[at[:, 0] + a, at[:, 1] + b, at[:, 2] + c]
            one = np.flatnonzero(other >= 0)
            one = one[level[one] == level[other[one]]]
            links.append((one, other[one]))
        root = joined_labels(len(pdf), *(np.concatenate(x) for x in zip(*links, strict=True)))
        block = int(pdf["block"].iloc[0])
        return pdf[["structure", *AT, "level"]].assign(label=[f"{block}:{n}" for n in root.tolist()])

    blocks = quantised.withColumn("block", F.floor(F.col("k") / size).cast("int"))
    x = dealt(blocks, "structure", "block").groupBy("structure", "block").applyInPandas(label, "structure string, i int, j int, k int, level int, label string")
    x = cut(x)
    zones = x.groupBy("structure", "level", "label").agg(F.count("*").alias("n"))
    up = [o for o in DIRECTIONS_3D if o[2] == 1]
    edge = x.filter(F.col("k") % size == size - 1)
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, _ in up])).alias("o")
    moved = edge.select("structure", "level", F.col("label").alias("a"), F.col("i").alias("i0"), F.col("j").alias("j0"), (F.col("k") + 1).alias("k"), o)
    moved = moved.select("structure", "level", "a", (F.col("i0") + F.col("o.a")).alias("i"), (F.col("j0") + F.col("o.b")).alias("j"), "k")
    links = moved.join(x.filter(F.col("k") % size == 0).withColumnRenamed("label", "b"), ["structure", "level", *AT]).select("structure", "a", "b").distinct()
    least = components(links, ("structure",)).withColumnRenamed("node", "label")
    whole = zones.join(least, ["structure", "label"], "left").groupBy("structure", "level", F.coalesce("zone", "label").alias("z")).agg(F.sum("n").alias("size"))
    return whole.groupBy("structure", "level", "size").agg(F.count("*").alias("n"))


def mutual_information(a: DataFrame, b: DataFrame, levels: int, on: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of the `on` columns): sum p log2(p / (px py)) of two volumes' levels, by equal widths between their ends, where both exist."""
    x = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), [*on, *AT])
    ends = x.groupBy(*on).agg(*[f(c).alias(f"{n}{c}") for c in ("a", "b") for f, n in ((F.min, "lo"), (F.max, "hi"))], F.count("*").alias("_n"))
    level = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}")) * levels), F.lit(levels - 1))
    y = x.join(ends, list(on)) if on else x.crossJoin(F.broadcast(ends))
    y = y.groupBy(*on, level("a").alias("l1"), level("b").alias("l2"), "_n").agg((F.count("*") / F.col("_n")).alias("p"))
    px, py = F.sum("p").over(Window.partitionBy(*on, "l1")), F.sum("p").over(Window.partitionBy(*on, "l2"))
    return y.withColumn("_x", px).withColumn("_y", py).groupBy(*on).agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("_x") * F.col("_y")))).alias("mutual_information"))


def local_variation(scan: DataFrame, masks: DataFrame, structure: str, distance: float, one_in: int) -> DataFrame:
    """One row: sample variance of absolute differences between sampled voxels and those within a distance.

    The sample is one voxel in `one_in` by its place, so reruns agree; neighbours are found by an
    equi-join on the offsets within the distance.
    """
    x = masks.filter(F.col("structure") == structure).select(*AT).distinct().join(scan, AT)
    n = int(distance)
    near = [(a, b, c) for a in range(-n, n + 1) for b in range(-n, n + 1) for c in range(-n, n + 1) if 0 < a * a + b * b + c * c <= distance * distance]
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in near])).alias("o")
    s = x.filter((F.col("i") * 7 + F.col("j") * 13 + F.col("k") * 29) % one_in == 0).select(F.col("value").alias("_v"), *[F.col(c).alias(f"{c}0") for c in AT], o)
    s = s.select("_v", *[(F.col(f"{c}0") + F.col(f"o.{d}")).alias(c) for c, d in zip(AT, "abc", strict=True)])
    return s.join(x, AT).agg(F.var_samp(F.abs(F.col("value") - F.col("_v"))).alias("local_variation"))


def background_threshold(pet: DataFrame, limit: float, voxel_volume: float, on: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of the `on` columns): the level at which value x volume of the histogram's highest bins passes `limit`, as a share of the largest value, and their volume.

    Zeros, nulls and values that are not finite are no voxels. Bins are 2 IQR n^(-1/3) wide and counted from 0 as in a dose histogram, the quartiles
    are those of values at (rank - 1/2) / n. Where the limit is never passed, the lowest bin's level and the whole volume are given; without spread (a width of
    0) both are null.
    """
    x = pet.filter((F.col("value") != 0) & ~F.isnan("value") & (F.abs("value") < float("inf"))).select(*on, "value")
    join = lambda left, right: left.join(right, list(on)) if on else left.crossJoin(F.broadcast(right))  # a row for each value of `on`
    q = join(exact_quantiles(x, list(on), "value", {"_a": 0.25, "_b": 0.75}, middles=True), x.groupBy(*on).agg(F.count("*").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_top")))
    width = 2 * (F.col("_b") - F.col("_a")) * F.pow(F.col("_n").cast("double"), F.lit(-1 / 3))
    q = q.withColumn("_w", F.when(width > 0, width))
    place = F.col("value") / F.col("_w")
    first = lambda v: F.when(F.col("_lo") >= 0, F.ceil(F.lit(EPS) + v)).otherwise(F.ceil(v))
    bins = join(x, q).groupBy(*on, first(place).alias("bin"), "_lo", "_top", "_w").agg(F.count("*").alias("n"))
    bins = bins.withColumn("level", (F.col("bin") - 0.5) * F.col("_w"))
    w = Window.partitionBy(*on).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)  # bins, not voxels
    y = bins.withColumn("_s", F.sum(F.col("level") * F.col("n") * voxel_volume).over(w)).withColumn("_v", F.sum(F.col("n") * voxel_volume).over(w))
    passed = F.col("_s") > limit
    low = F.when(F.max("_lo") >= 0, 0.5 * F.max("_w")).otherwise(F.min("level"))
    found = y.groupBy(*on).agg(F.max(F.when(passed, F.col("level"))).alias("_level"), F.min(F.when(passed, F.col("_v"))).alias("_volume"), low.alias("_first"), F.max("_v").alias("_all"), F.max("_top").alias("_peak"), F.max("_w").alias("_width"))
    return found.select(*on, (F.coalesce("_level", "_first") / F.col("_peak")).alias("threshold"), F.when(F.col("_width").isNotNull(), F.coalesce("_volume", "_all")).alias("volume"))
