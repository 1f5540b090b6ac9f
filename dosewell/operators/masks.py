"""Structures as voxel rows: structure, i, j, k (and voxel where a linear index is enough)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewell.operators.distance import box_map, distance_map, greatest_nearest, least_distance, looked_up
from dosewell.sources.lineage import cut

AT = ("i", "j", "k")
FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def _offsets(offsets) -> F.Column:
    """An array of integer offsets for explode: short lists, known when the plan is made."""
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in offsets])


def ball(radius: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> list[tuple[int, int, int]]:
    """Integer offsets within a physical radius."""
    n = [int(radius // s) for s in spacing]
    return [(a, b, c) for a in range(-n[0], n[0] + 1) for b in range(-n[1], n[1] + 1) for c in range(-n[2], n[2] + 1) if (a * spacing[0]) ** 2 + (b * spacing[1]) ** 2 + (c * spacing[2]) ** 2 <= radius * radius]


def box(n: int) -> list[tuple[int, int, int]]:
    return [(a, b, c) for a in range(-n, n + 1) for b in range(-n, n + 1) for c in range(-n, n + 1)]


def _at(masks: DataFrame, name: str) -> DataFrame:
    return masks.filter(F.col("structure") == name).select(*AT).distinct()


def mask_union(masks: DataFrame, a: str, b: str) -> DataFrame:
    return _at(masks, a).union(_at(masks, b)).distinct()


def mask_intersect(masks: DataFrame, a: str, b: str) -> DataFrame:
    return _at(masks, a).join(_at(masks, b), list(AT), "left_semi")


def mask_subtract(masks: DataFrame, a: str, b: str) -> DataFrame:
    return _at(masks, a).join(_at(masks, b), list(AT), "left_anti")


def agreement(masks: DataFrame, names: list[str], least: int) -> DataFrame:
    """Voxels in at least `least` of the named structures."""
    return masks.filter(F.col("structure").isin(names)).groupBy(*AT).agg(F.count_distinct("structure").alias("n")).filter(F.col("n") >= least)


def structure_volume(masks: DataFrame, voxel_volume: float) -> DataFrame:
    return masks.select("structure", *AT).distinct().groupBy("structure").agg(F.count("*").alias("voxels"), (F.count("*") * voxel_volume).alias("volume"))


def union_intersection(masks: DataFrame, names: list[str], voxel_volume: float, on: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of the `on` columns): volumes of the union and the intersection of the named structures, and their ratio."""
    n = masks.filter(F.col("structure").isin(names)).groupBy(*on, *AT).agg(F.count_distinct("structure").alias("n"))
    sums = n.groupBy(*on).agg((F.count("*") * voxel_volume).alias("union_volume"), (F.coalesce(F.sum((F.col("n") == len(names)).cast("int")), F.lit(0)) * voxel_volume).alias("intersection_volume"))
    return sums.withColumn("ratio", F.when(F.col("union_volume") > 0, F.col("intersection_volume") / F.col("union_volume")))


def dice(masks: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """2 x intersection / (a + b) of all pairs of structures a < b, 0 for pairs that don't meet; pairs have the same `on` columns.

    Pairs are made from the short list of structures; voxels meet by an equi-join that is counted at once.
    """
    x = masks.select(*on, "structure", *AT).distinct()
    sizes = x.groupBy(*on, "structure").agg(F.count("*").alias("n"))
    y = x.select(*on, F.col("structure").alias("b"), *AT)
    meet = x.select(*on, F.col("structure").alias("a"), *AT).join(y, [*on, *AT]).filter("a < b").groupBy(*on, "a", "b").agg(F.count("*").alias("m"))
    p, q = sizes.select(*on, F.col("structure").alias("a"), F.col("n").alias("na")), sizes.select(*on, F.col("structure").alias("b"), F.col("n").alias("nb"))
    pairs = _paired(p, q, on)
    return pairs.join(meet, [*on, "a", "b"], "left").select(*on, "a", "b", (2.0 * F.coalesce("m", F.lit(0)) / (F.col("na") + F.col("nb"))).alias("dice"))


def _paired(p: DataFrame, q: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Pairs a < b with the same `on` columns."""
    return p.join(q, list(on)).filter("a < b") if on else p.join(q, F.col("a") < F.col("b"))


def structure_stats(masks: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Bounding box, centre of mass (and rounded), volume and largest extent along an axis."""
    aggregates = [F.count("*").alias("voxels")]
    for c in AT:
        aggregates += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean")]
    x = masks.groupBy("structure").agg(*aggregates)
    extent = F.greatest(*[(F.col(f"{c}_max") - F.col(f"{c}_min") + 1) * float(s) for c, s in zip(AT, spacing, strict=True)])
    volume = float(np.prod(spacing))
    return x.select("*", *[F.floor(F.col(f"{c}_mean") + 0.5).alias(f"{c}_centre") for c in AT], (F.col("voxels") * volume).alias("volume"), extent.alias("extent"))


def surface_voxels(masks: DataFrame) -> DataFrame:
    """Voxels that miss at least one of their six neighbours, with the number of open faces."""
    return _open_faces(masks).filter("faces > 0")


def _open_faces(masks: DataFrame) -> DataFrame:
    """Voxels with how many of their six neighbours they miss.

    Each axis looks at the voxels before and after on a line, so a voxel moves once for an axis, not once for each neighbour.
    """
    x, faces = masks.select("structure", *AT).distinct(), F.lit(0)
    for c in AT:
        line = Window.partitionBy("structure", *[o for o in AT if o != c]).orderBy(c)
        open_ = lambda near, way, c=c: F.coalesce((near(c).over(line) != F.col(c) + way).cast("int"), F.lit(1))  # noqa: E731, B023
        x = x.withColumn(f"_{c}", open_(F.lag, -1) + open_(F.lead, 1))
        faces = faces + F.col(f"_{c}")
    return x.select("structure", *AT, faces.cast("int").alias("faces"))


def dilate(masks: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """All voxels within an offset of the structure."""
    moved = masks.select("structure", *AT, F.explode(_offsets(offsets)).alias("o"))
    return moved.select("structure", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), (F.col("k") + F.col("o.c")).alias("k")).distinct()


def erode(masks: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Voxels all of whose neighbours at the offsets are in the structure; the six at the faces are found on lines, without a row for each."""
    if sorted(offsets) == sorted(FACES):
        return _open_faces(masks.filter("structure is not null")).filter("faces = 0").drop("faces")
    x = masks.select("structure", *AT).distinct()
    moved = x.select("structure", *AT, F.explode(_offsets(offsets)).alias("o"))
    count = moved.select("structure", (F.col("i") - F.col("o.a")).alias("i"), (F.col("j") - F.col("o.b")).alias("j"), (F.col("k") - F.col("o.c")).alias("k")).groupBy("structure", *AT).agg(F.count("*").alias("n"))
    return count.filter(F.col("n") == len(offsets)).join(x, ["structure", *AT], "left_semi").drop("n")


def dilate_ball(masks: DataFrame, radius: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """All voxels within a physical radius of the structure, by its distance map: no row for each voxel and offset."""
    return distance_map(masks, radius, spacing).drop("distance")


def erode_ball(masks: DataFrame, radius: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Voxels of the structure with no place outside of it within the radius.

    The nearest outside place of a voxel shares a face with the structure, so only those are looked at.
    """
    x = masks.select("structure", *AT).distinct()
    near = surface_voxels(x).select("structure", *AT, F.explode(_offsets(FACES)).alias("o")).select("structure", *[(F.col(c) + F.col(f"o.{o}")).alias(c) for c, o in zip(AT, "abc", strict=True)])
    outside = near.distinct().join(x, ["structure", *AT], "left_anti")
    return x.join(dilate_ball(outside, radius, spacing), ["structure", *AT], "left_anti")


def ring_radius(voxels: int) -> float:
    """The ring's radius for a target of so many voxels: twice that of a ball of its size, 20 at most."""
    return min(20.0, 2.0 * (3.0 * voxels / 4.0 / np.pi) ** (1.0 / 3.0))


def ring_and_skin(masks: DataFrame, target: str, body: str, radius: float | None = None, gap: int = 1, skin: int = 1) -> DataFrame:
    """Two structures: the ball around the target without its box, inside the body; and the body without its eroded self.

    Without a radius the ring's follows from the target's size (`ring_radius`).
    """
    t, b = masks.filter(F.col("structure") == target), masks.filter(F.col("structure") == body)
    inside = b.select(*AT).distinct()
    if radius is None:
        radius = ring_radius(_at(masks, target).count())
    outer = dilate_ball(t, radius).select(*AT)
    ring = outer.join(box_map(t, gap).select(*AT), list(AT), "left_anti").join(inside, list(AT), "left_semi")
    rind = inside.join(erode(b, box(skin)).select(*AT), list(AT), "left_anti")
    return ring.select(F.lit("ring").alias("structure"), *AT).union(rind.select(F.lit("skin").alias("structure"), *AT))


def expand_margin(masks: DataFrame, margin: float, spacing: tuple[float, float, float]) -> DataFrame:
    """The structure and all voxels within a physical margin of it."""
    return dilate_ball(masks, margin, spacing)


def to_segments(masks: DataFrame) -> DataFrame:
    """Runs along i: structure, k, j, first, last."""
    x = masks.select("structure", *AT).distinct()
    run = F.col("i") - F.row_number().over(Window.partitionBy("structure", "k", "j").orderBy("i"))
    return x.withColumn("_run", run).groupBy("structure", "k", "j", "_run").agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("_run")


def from_segments(segments: DataFrame) -> DataFrame:
    return segments.select("structure", F.explode(F.sequence("first", "last")).alias("i"), "j", "k")


#: Structures that one BIGINT tells apart; its sign stays free.
WORD = 63


def membership_bits(masks: DataFrame, order: DataFrame) -> DataFrame:
    """One BIGINT for each voxel; bit `ord` (0 to 62) says that the voxel is in that structure. More structures take `membership_words`."""
    bit = F.expr("shiftleft(1L, cast(ord as int))")
    return masks.join(order, "structure").groupBy(*AT).agg(F.bit_or(bit).alias("bits"))


def membership_words(masks: DataFrame, order: DataFrame, structures: int) -> DataFrame:
    """`bits` as an array of BIGINTs, for any number of structures: word ord / 63, bit ord % 63."""
    bit = F.expr(f"shiftleft(1L, cast(ord % {WORD} as int))")
    word = lambda n: F.coalesce(F.bit_or(F.when(F.floor(F.col("ord") / WORD) == n, bit)), F.lit(0).cast("long"))
    return masks.join(order, "structure").groupBy(*AT).agg(F.array(*[word(n) for n in range(-(-structures // WORD))]).alias("bits"))


def is_member(bits: F.Column, ord: int) -> F.Column:
    """Whether a voxel's words have the bit of a structure."""
    return F.shiftright(bits[ord // WORD], ord % WORD).bitwiseAND(F.lit(1).cast("long")) == 1


def split_sup_inf(masks: DataFrame, parts: int) -> DataFrame:
    """Adds `part`: the structure's extent in k in equal intervals, the last one closed."""
    ends = masks.groupBy("structure").agg(F.min("k").alias("_lo"), F.max("k").alias("_hi"))
    x = masks.join(ends, "structure").select(*masks.columns, "_lo", "_hi")
    at = F.floor((F.col("k") - F.col("_lo")) * float(parts) / (F.col("_hi") - F.col("_lo")))
    return x.withColumn("part", F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(at, F.lit(parts - 1))).cast("int")).drop("_lo", "_hi")


def threshold_structure(volume: DataFrame, masks: DataFrame, percent: float) -> DataFrame:
    """Voxels of each structure with at least `percent` of its largest value."""
    x = masks.join(volume, list(AT))
    top = x.groupBy("structure").agg(F.max("value").alias("_top"))
    return x.join(top, "structure").filter(F.col("value") >= F.col("_top") * percent / 100).drop("_top")


def isodose_structure(volume: DataFrame, level: float) -> DataFrame:
    return volume.filter(F.col("value") >= level)


def pad_crop(masks: DataFrame, start: tuple[int, int, int], size: tuple[int, int, int] | None = None, full: tuple[int, int, int] | None = None) -> DataFrame:
    """Indices in a cropped box at `start` to indices in the full volume, or back.

    With `size` the way is from the full volume into the box of that size: what lies outside goes. Otherwise it
    is from the box to the full volume. `lindex` is the linear index, i fastest, in the box (`size`) or in the
    full volume where its shape `full` is given.
    """
    sign, shape = (-1, size) if size else (1, full)
    x = masks.withColumns({c: F.col(c) + sign * s for c, s in zip(AT, start, strict=True)})
    if size:
        for c, n in zip(AT, size, strict=True):
            x = x.filter((F.col(c) >= 0) & (F.col(c) < n))
    return x.withColumn("lindex", (F.col("k").cast("long") * shape[1] + F.col("j")) * shape[0] + F.col("i")) if shape else x


def _cells(points: DataFrame, size: float, spacing) -> DataFrame:
    return points.withColumns({f"_c{c}": F.floor(F.col(c) * s / size).cast("long") for c, s in zip(AT, spacing, strict=True)})


def min_surface_distance(masks: DataFrame, a: str, b: str, spacing=(1.0, 1.0, 1.0), on: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of the `on` columns that has both): the least distance between two surfaces, 0 when below the larger in-plane spacing."""
    p, q = (_surface_of(masks.filter(F.col("structure") == n), on) for n in (a, b))
    small = max(spacing[0], spacing[1])
    return least_distance(p, q, spacing, on).select(*on, F.when(F.col("distance") < small, 0.0).otherwise(F.col("distance")).alias("distance"))


def _surface_of(masks: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Surface voxels of structures that are told apart by `on` columns, too."""
    if not on:
        return surface_voxels(masks)
    whole = F.struct(*on, "structure")
    x = surface_voxels(masks.select(whole.alias("structure"), *AT))
    return x.select(*[F.col(f"structure.{c}").alias(c) for c in on], F.col("structure.structure").alias("structure"), *AT, "faces")


def nearest_distance(points: DataFrame, targets: DataFrame, spacing=(1.0, 1.0, 1.0), on: tuple[str, ...] = (), cell: float = 4.0) -> DataFrame:
    """points (any columns and i, j, k) -> also `distance` to the nearest of targets (i, j, k), null without any.

    Points meet the targets that have the same `on` columns. Places around a point are looked at first, nearest ones first. For
    points with nothing there, or between places, targets are looked for in neighbouring cells, which
    settles every point that has one within a cell's width; cells double for the others. In each pass a
    quarter as large cells are compared first, by the least and greatest distance that their points can have,
    so a point meets the targets of few of them.
    """
    keys = list(on)
    left, there = cut(points.select(*keys, *AT).distinct()), cut(targets.select(*keys, *AT).distinct())
    ends = left.select(*AT).union(there.select(*AT)).agg(*[(F.max(c) - F.min(c) + 1).alias(c) for c in AT]).first()
    span = sum((ends[c] or 0) * s for c, s in zip(AT, spacing, strict=True))
    square = sum(((F.col(c) - F.col(f"{c}2")) * s) ** 2 for c, s in zip(AT, spacing, strict=True))
    size, done = float(cell), None
    if all(kind in ("tinyint", "smallint", "int", "bigint") for x in (left, there) for c, kind in x.dtypes if c in AT):
        near, left, radius = looked_up(left, there, keys, spacing)
        done = near.select(*keys, *AT, F.sqrt("square").alias("distance"))
        size = max(size, 2 * radius)
    while done is None or not left.isEmpty():
        fine = size / 4
        p, t = _cells(left, fine, spacing), _cells(there, fine, spacing)
        coarse = [F.floor(F.col(f"_c{c}") / 4).cast("int").alias(f"_g{c}") for c in AT]
        mine = p.select(*keys, *[f"_c{c}" for c in AT]).distinct().select("*", *coarse, F.explode(_offsets(box(1))).alias("o"))
        mine = mine.select(*keys, *[f"_c{c}" for c in AT], *[(F.col(f"_g{c}") + F.col(f"o.{a}")).alias(f"_g{c}") for c, a in zip(AT, "abc", strict=True)])
        other = t.select(*keys, *[f"_c{c}" for c in AT]).distinct().select(*keys, *coarse, *[F.col(f"_c{c}").alias(f"_d{c}") for c in AT])
        met = mine.join(other.hint("merge"), [*keys, *[f"_g{c}" for c in AT]])
        apart = [F.abs(F.col(f"_c{c}") - F.col(f"_d{c}")) for c in AT]
        least, most = (sum((f(a) * fine) ** 2 for a in apart) for f in (lambda a: F.greatest(a - 1, F.lit(0)), lambda a: a + 1))
        met = met.withColumns({"_least": least, "_bound": F.min(most).over(Window.partitionBy(*keys, *[f"_c{c}" for c in AT]))})
        met = met.filter((F.col("_least") <= F.col("_bound")) & (F.col("_least") <= size * size)).select(*keys, *[f"_c{c}" for c in AT], *[f"_d{c}" for c in AT])
        near = t.select(*keys, *[F.col(c).alias(f"{c}2") for c in AT], *[F.col(f"_c{c}").alias(f"_d{c}") for c in AT])
        best = p.join(met.hint("merge"), [*keys, *[f"_c{c}" for c in AT]]).join(near.hint("merge"), [*keys, *[f"_d{c}" for c in AT]]).groupBy(*keys, *AT).agg(F.sqrt(F.min(square)).alias("distance"))
        found = cut(left.join(best.hint("merge"), [*keys, *AT], "left"))
        last = size > span
        sure = found if last else found.filter(F.col("distance") <= size)
        done = sure if done is None else done.unionByName(sure)
        left = found.filter(F.coalesce(F.col("distance") > size, F.lit(True))).select(*keys, *AT)
        if last:
            break
        size *= 2
    return points.join(done.hint("merge"), [*keys, *AT], "left").select(*points.columns, "distance")


def _both_ways(masks: DataFrame, a: str, b: str, on: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The surface voxels of two structures, and the same under the other one's name."""
    surface = cut(_surface_of(masks.filter(F.col("structure").isin(a, b)), on).select(*on, "structure", *AT))
    return surface, surface.withColumn("structure", F.when(F.col("structure") == a, b).otherwise(a))


def hausdorff(masks: DataFrame, a: str, b: str, spacing=(1.0, 1.0, 1.0), on: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of the `on` columns that has both): the larger of the two directed greatest nearest-surface distances."""
    surface, other = _both_ways(masks, a, b, on)
    return greatest_nearest(surface, other, spacing, (*on, "structure")).groupBy(*on).agg(F.max("distance").alias("hausdorff"))


def mean_surface_distance(masks: DataFrame, a: str, b: str, spacing=(1.0, 1.0, 1.0), on: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of the `on` columns): the mean of the distances from all surface voxels of both to the nearest of the other."""
    surface, other = _both_ways(masks, a, b, on)
    return nearest_distance(surface, other, spacing, (*on, "structure")).groupBy(*on).agg(F.avg("distance").alias("mean_distance"))


def surface_distances(masks: DataFrame, a: str, b: str, spacing=(1.0, 1.0, 1.0), on: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of the `on` columns): hausdorff and mean_distance, the greatest and the mean of the distances that `mean_surface_distance` takes."""
    surface, other = _both_ways(masks, a, b, on)
    return nearest_distance(surface, other, spacing, (*on, "structure")).groupBy(*on).agg(F.max("distance").alias("hausdorff"), F.avg("distance").alias("mean_distance"))


def com_distance(masks: DataFrame, spacing=(1.0, 1.0, 1.0), on: tuple[str, ...] = ()) -> DataFrame:
    """Distance between the centres of mass of all pairs of structures a < b that have the same `on` columns."""
    com = masks.groupBy(*on, "structure").agg(*[(F.avg(c) * float(s)).alias(c) for c, s in zip(AT, spacing, strict=True)])
    p = com.select(*on, F.col("structure").alias("a"), *[F.col(c).alias(f"{c}a") for c in AT])
    q = com.select(*on, F.col("structure").alias("b"), *[F.col(c).alias(f"{c}b") for c in AT])
    square = sum((F.col(f"{c}a") - F.col(f"{c}b")) ** 2 for c in AT)
    return _paired(p, q, on).select(*on, "a", "b", F.sqrt(square).alias("distance"))


def _patterns(masks: DataFrame, raters: list[str], on: tuple[str, ...] = ()) -> DataFrame:
    """How many voxels of the union's bounding box have each pattern of ratings: a string of 0 and 1, a place for each rater.

    There may be any number of raters; a pattern that no voxel has is no row. Boxes are those of each value of the `on` columns.
    """
    rated = masks.filter(F.col("structure").isin(raters))
    own = [F.when(F.max((F.col("structure") == r).cast("int")) == 1, F.lit("1")).otherwise(F.lit("0")) for r in raters]
    voxels = rated.groupBy(*on, *AT).agg(F.concat(*own).alias("pattern"))
    counts = voxels.groupBy(*on, "pattern").agg(F.count("*").alias("n"))
    size = rated.groupBy(*on).agg(*[(F.max(c) - F.min(c) + 1).cast("long").alias(c) for c in AT])
    some = voxels.groupBy(*on).agg(F.count("*").alias("m"))
    both = size.join(some, list(on)) if on else size.crossJoin(some)
    return counts.unionByName(both.select(*on, F.lit("0" * len(raters)).alias("pattern"), (F.col("i") * F.col("j") * F.col("k") - F.col("m")).cast("long").alias("n")))


def _rating(r: int) -> F.Column:
    return F.substring("pattern", r + 1, 1).cast("double")


def consensus(masks: DataFrame, raters: list[str], voxel_volume: float, levels: int = 20, on: tuple[str, ...] = ()) -> DataFrame:
    """Volume with at least each level of agreement: on..., level, volume, corrected_volume.

    Agreement is the mean rating of a voxel; corrected for chance it is the mean of (x - c) / (1 - c)
    with c = sqrt(p (1 - p)) of each rater's share p of the union's bounding box.
    """
    x = _patterns(masks, raters, on).select(*on, "pattern", "n")
    rating = [_rating(r) for r in range(len(raters))]
    shares = x.groupBy(*on).agg(*[(F.sum(rating[r] * F.col("n")) / F.sum("n")).alias(f"p{r}") for r in range(len(raters))])
    x = x.join(shares, list(on)) if on else x.crossJoin(F.broadcast(shares))
    chance = [F.sqrt(F.col(f"p{r}") * (1 - F.col(f"p{r}"))) for r in range(len(raters))]
    x = x.select(*on, "n", (sum(rating) / len(raters)).alias("agree"), (sum((v - c) / (1 - c) for v, c in zip(rating, chance, strict=True)) / len(raters)).alias("corrected"))
    edges = [0.001 + (1 - 0.001) * t / (levels - 1) for t in range(levels)]
    level = F.explode(F.array(*[F.lit(e) for e in edges])).alias("level")
    volume = lambda c: F.coalesce(F.sum(F.when(F.col(c) >= F.col("level") - 1e-9, F.col("n"))), F.lit(0)) * voxel_volume
    return x.select("*", level).groupBy(*on, "level").agg(volume("agree").alias("volume"), volume("corrected").alias("corrected_volume"))


def staple(masks: DataFrame, raters: list[str], iterations: int = 100, p0: float = 0.9999, q0: float = 0.9999, tolerance: float = 1e-2) -> tuple[DataFrame, DataFrame]:
    """Expectation maximisation of raters' sensitivity and specificity: (raters, probability of each pattern).

    Voxels are counted by their pattern of ratings once. A pass is an aggregate over the patterns, of which there are at most as
    many as voxels; the driver holds two numbers for each rater. Passes end when the sum of probabilities changes by less than `tolerance`.
    A pattern's likelihoods are sums of logarithms, so many raters don't make them vanish. Without any voxel both tables are empty.
    """
    counts = cut(_patterns(masks, raters).filter("n is not null"))
    total = counts.agg(F.sum("n").alias("n"), *[F.sum(_rating(r) * F.col("n")).alias(f"x{r}") for r in range(len(raters))]).first()
    spark = masks.sparkSession
    if not total["n"]:
        return spark.createDataFrame([], "rater string, sensitivity double, specificity double"), counts.withColumn("probability", F.lit(0.0)).limit(0)
    prior = sum(total[f"x{r}"] for r in range(len(raters))) / len(raters) / total["n"]
    p, q, before = [p0] * len(raters), [q0] * len(raters), None
    for _ in range(iterations):
        weighed = counts.withColumn("probability", _truth(prior, p, q))
        w, n = F.col("probability"), F.col("n")
        true = [F.sum(w * n * _rating(r)).alias(f"t{r}") for r in range(len(raters))]
        false = [F.sum((1 - w) * n * (1 - _rating(r))).alias(f"f{r}") for r in range(len(raters))]
        s = weighed.agg(F.sum(w * n).alias("in"), F.sum((1 - w) * n).alias("out"), *true, *false).first()
        p = [s[f"t{r}"] / max(s["in"], 1e-300) for r in range(len(raters))]
        q = [s[f"f{r}"] / max(s["out"], 1e-300) for r in range(len(raters))]
        if before is not None and abs(s["in"] - before) < tolerance:
            break
        before = s["in"]
    return spark.createDataFrame(list(zip(raters, map(float, p), map(float, q))), "rater string, sensitivity double, specificity double"), weighed


def _truth(prior: float, p: list[float], q: list[float]) -> F.Column:
    """The probability that a voxel with the pattern is in the true structure."""
    log = lambda x: float(np.log(max(x, 1e-300)))
    odds = F.lit(log(1 - prior) - log(prior))
    for r, (a, b) in enumerate(zip(p, q)):
        odds = odds + F.when(_rating(r) == 1, log(1 - b) - log(a)).otherwise(log(b) - log(1 - a))
    return 1 / (1 + F.exp(F.least(odds, F.lit(700.0))))


def kappa(masks: DataFrame, raters: list[str], on: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of the `on` columns): Fleiss' kappa of in/out ratings over the union's bounding box.

    With two categories the kappa of each is the overall one.
    """
    r = len(raters)
    x = _patterns(masks, raters, on).select(*on, "n", sum(_rating(k) for k in range(r)).alias("x"))
    agree = (F.col("x") * (F.col("x") - 1) + (r - F.col("x")) * (r - F.col("x") - 1)) / (r * (r - 1))
    s = x.groupBy(*on).agg(F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("ones"), F.sum(agree * F.col("n")).alias("agree"))
    p = F.col("ones") / (F.col("n") * r)
    chance = p * p + (1 - p) * (1 - p)
    return s.select(*on, ((F.col("agree") / F.col("n") - chance) / (1 - chance)).alias("kappa"))
