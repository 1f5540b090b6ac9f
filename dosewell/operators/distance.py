"""Distances between voxel sets: exact separable distance maps, places looked at around a point, and trees of cells with bounds for what lies farther.

Points have integer i, j, k; distances are physical, by the spacing of each axis. `on` columns keep sets apart, so that many
structures, pairs of them, or patients are handled by one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewell.sources.lineage import cut, dealt

AT = ("i", "j", "k")
#: Pairs of points that are compared rather than bounded any further: in all, or for each point if that is more.
ENOUGH, ENOUGH_EACH = 4_000_000, 20
#: Radii of the balls of places that are looked at, in edges of a cube of a voxel's volume, and edges of blocks in places.
LOOKS, EDGE = (4.0, 8.0), 32
#: Places of blocks that a task keeps as a bit map; more are searched for by number.
DENSE = 1 << 26
#: Bounds are compared with this much room for the rounding of sums.
ROOM = 1 + 1e-9


def whole_lines(batches: Iterator[pa.RecordBatch], *free: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole lines from sorted batches, each time with the rows that begin one; rows differ in a line by the columns `free` only."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
        begins = _begins(t, free)
        last = int(begins[-1]) if len(begins) else 0
        if last:
            yield t.slice(0, last), begins[:-1]
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield held, _begins(held, free)


def _begins(t: pa.Table, free: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for name in t.column_names:
        if name not in free:
            c = t.column(name).combine_chunks()
            v = (c.dictionary_encode().indices if not pa.types.is_integer(c.type) else c).fill_null(-(1 << 31)).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _spread(rows: DataFrame, on: list[str], axis: str, reach: int, step: float, most: float) -> DataFrame:
    """Squared distances carried along one axis: of each place within `reach` of a row of its line, the least d2 + (step x way)^2, up to `most`.

    Lines are dealt out whole; a task goes through them as a stream, all lines of a batch at once. Work is 2 x reach + 1 for
    a place, whatever the other axes have. Lines are cut where rows are too far apart to have places in common.
    """
    others = [c for c in AT if c != axis]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in on) + (", " if on else "") + "i int, j int, k int, d2 double"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begins in whole_lines(batches, axis, "d2"):
            pos, d2 = t.column(axis).to_numpy().astype(np.int64), t.column("d2").to_numpy()
            new = np.zeros(len(pos), bool)
            new[begins] = True
            new[1:] |= np.diff(pos) > 2 * reach
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(pos)) - 1
            size = pos[last] - pos[first] + 1 + 2 * reach
            start = np.cumsum(size) - size
            run = np.cumsum(new) - 1
            known = np.full(int(size.sum()), np.inf)
            np.minimum.at(known, start[run] + pos - pos[first][run] + reach, d2)
            out = known.copy()
            for way in range(1, reach + 1):
                cost = (way * step) ** 2
                np.minimum(out[way:], known[:-way] + cost, out=out[way:])
                np.minimum(out[:-way], known[way:] + cost, out=out[:-way])
            keep = np.flatnonzero(out <= most)
            of = np.searchsorted(start, keep, side="right") - 1
            line = t.take(pa.array(first[of]))
            place = pa.array((keep - start[of] + pos[first][of] - reach).astype(np.int32))
            columns = [line.column(c) if c in on else place if c == axis else line.column(c) for c in (*on, *AT)]
            yield from pa.table([*columns, pa.array(out[keep])], names=[*on, *AT, "d2"]).combine_chunks().to_batches()

    whole = rows.select(*on, *[F.col(c).cast("int").alias(c) for c in AT], "d2")
    return whole.repartition(*on, *others).sortWithinPartitions(*on, *others, axis).mapInArrow(spread, schema)


def distance_map(points: DataFrame, radius: float, spacing=(1.0, 1.0, 1.0), on: tuple[str, ...] = ("structure",)) -> DataFrame:
    """Every place within `radius` of a set's points: on..., i, j, k, distance (to the nearest of them, 0 at the points).

    The squared distance is the sum of one square for each axis, so the least of them is found axis by axis: three passes, each over
    one row a place, in place of a row for each point and offset within the radius. Repeated points count once; a null
    coordinate is no place; no points, no places.
    """
    most = float(radius) * float(radius)
    x = points.select(*on, *AT, F.lit(0.0).alias("d2")).dropna(subset=list(AT))
    for axis, step in zip(AT, spacing, strict=True):
        x = _spread(x, list(on), axis, int(radius // step), float(step), most)
    return x.select(*on, *AT, F.sqrt("d2").alias("distance"))


def box_map(points: DataFrame, n: int, on: tuple[str, ...] = ("structure",)) -> DataFrame:
    """Every place within n of a point along each axis: on..., i, j, k."""
    x = points.select(*on, *AT, F.lit(0.0).alias("d2")).dropna(subset=list(AT))
    for axis in AT:
        x = _spread(x, list(on), axis, n, 0.0, 0.0)
    return x.select(*on, *AT)


# --- places looked at


def _around(radius: float, spacing) -> tuple[list[int], list[tuple[float, tuple[int, int, int]]]]:
    """How many places a radius reaches along each axis, and all offsets within it with their squares, nearest first."""
    reach = [int(radius // s) for s in spacing]
    ways = np.stack(np.meshgrid(*[np.arange(-r, r + 1) for r in reach], indexing="ij"), axis=-1).reshape(-1, 3)
    squares = ((ways * np.array(spacing, float)) ** 2).sum(axis=1)
    order = np.argsort(squares, kind="stable")
    return reach, [(float(squares[n]), tuple(map(int, ways[n]))) for n in order if squares[n] <= radius * radius]


def _blocks(rows: DataFrame, reach: list[int] | None = None) -> DataFrame:
    """Rows with the block that a place lies in or, with `reach`, a row for each block that has places so near."""
    for c, far in zip(AT, reach or (0, 0, 0), strict=True):
        first, last = (F.floor((F.col(c) + way * far) / EDGE) for way in (-1, 1))
        rows = rows.withColumn(f"b_{c}", F.explode(F.sequence(first, last)) if reach else first)
    return rows


def _look(points: DataFrame, targets: DataFrame, on: list[str], spacing, radius: float) -> DataFrame:
    """on..., i, j, k of points, and `square`, the squared distance to the nearest target within the radius, null without any.

    Blocks of places are dealt out with the targets around them. A task goes through them as a stream and looks at the places around
    all points of some blocks at once, nearest first, so a point costs at most as many looks as the ball has places, however many points there are.
    """
    reach, around = _around(radius, spacing)
    wide = [EDGE + 2 * r for r in reach]
    block = [f"b_{c}" for c in AT]
    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in on) + (", " if on else "") + "i long, j long, k long, square double"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begins in whole_lines(batches, *AT, "own"):
            new = np.zeros(t.num_rows, np.int64)
            new[begins] = 1
            place = np.cumsum(new) - 1
            for c, r, w in zip(AT, reach, wide, strict=True):
                place = place * w + t.column(c).to_numpy() - t.column(f"b_{c}").to_numpy() * EDGE + r
            own = t.column("own").to_numpy()
            mine, there = np.flatnonzero(own), np.unique(place[~own])
            square = np.full(len(mine), np.nan)
            if len(mine) and len(there):
                room, left = len(begins) * wide[0] * wide[1] * wide[2], np.arange(len(mine))
                dense = np.zeros(room, bool) if room <= DENSE else None
                if dense is not None:
                    dense[there] = True
                for cost, (a, b, c) in around:
                    want = place[mine[left]] + (a * wide[1] + b) * wide[2] + c
                    hit = dense[want] if dense is not None else there[np.minimum(np.searchsorted(there, want), len(there) - 1)] == want
                    square[left[hit]] = cost
                    left = left[~hit]
                    if not len(left):
                        break
            out = t.select([*on, *AT]).take(pa.array(mine)).append_column("square", pa.array(square, from_pandas=True))
            yield from out.combine_chunks().to_batches()

    columns = lambda own: [*on, *block, *AT, F.lit(own).alias("own")]
    whole = lambda x: x.select(*on, *[F.col(c).cast("long").alias(c) for c in AT])
    rows = _blocks(whole(points).dropna()).select(*columns(True)).union(_blocks(whole(targets).dropna(), reach).select(*columns(False)))
    return dealt(rows, *on, *block).sortWithinPartitions(*on, *block).mapInArrow(look, schema)


def looked_up(points: DataFrame, targets: DataFrame, on: list[str], spacing) -> tuple[DataFrame, DataFrame, float]:
    """Squared distances to the nearest target of points that have one near (on..., i, j, k, square), the points that have none, and how far was looked.

    Nulls in `on` meet nothing. Points of the first radius' ball are settled by it; only the others, with the targets around their blocks, go through the next one.
    """
    unit = float(np.prod(spacing)) ** (1 / 3)
    near, left = None, points
    for radius in LOOKS:
        there = targets
        if near is not None:
            reach, _ = _around(radius * unit, spacing)
            block = [f"b_{c}" for c in AT]
            there = _blocks(targets.dropna(subset=list(AT)), reach).join(_blocks(left).select(*on, *block).distinct().hint("merge"), [*on, *block], "left_semi").select(*on, *AT).distinct()
        found = cut(_look(left, there, on, spacing, radius * unit))
        sure, left = found.filter("square is not null"), found.filter("square is null").drop("square")
        near = sure if near is None else near.union(sure)
        if left.isEmpty():
            break
    return near, left, radius * unit


# --- trees of cells


def _sizes(span: int) -> list[int]:
    """Edges of cells from one that holds all points down to 2: quarters while they are large, then halves."""
    size = 2
    while size < span:
        size *= 2
    out = [size]
    while size > 2:
        size //= 4 if size > 16 else 2
        out.append(size)
    return out


def _boxes(points: DataFrame, on: list[str], size: int, parent: int, tag: str) -> DataFrame:
    """Occupied cells of a size, and the one above each: the box that its points fill, and one of them."""
    cell = [F.floor(F.col(c) / size).alias(f"{tag}_{c}") for c in AT]
    above = [F.floor(F.col(c) / parent).alias(f"{tag}_up_{c}") for c in AT]
    ends = [f(c).alias(f"{tag}_{n}_{c}") for c in AT for n, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy(*on, *cell, *above).agg(*ends, F.min(F.struct(*AT)).alias(f"{tag}_one"), F.count("*").alias(f"{tag}_n"))


def _squares(parts: list[Column], spacing) -> Column:
    return sum((p * float(s)) ** 2 for p, s in zip(parts, spacing, strict=True))


def _least() -> list[Column]:
    return [F.greatest(F.lit(0), F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}")) for c in AT]


def _descend(a: DataFrame, b: DataFrame, on: list[str], spacing, upper, prune) -> DataFrame:
    """Pairs of points that no bound rules out: on..., i, j, k, i2, j2, k2, square.

    Cells of a and b meet from the largest size down. `upper` bounds a pair's squared distance from above; `prune` keeps
    of the pairs (on, cells, least, most) those that can matter, and only their parts meet at the next size.
    As soon as the pairs that are left have few pairs of points, these are compared.
    """
    a, b = cut(a.select(*on, *AT).dropna(subset=list(AT)).distinct()), cut(b.select(*on, *AT).dropna(subset=list(AT)).distinct())
    ends = a.select(*AT).union(b.select(*AT)).agg(F.count("*").alias("points"), *[f(c).alias(f"{n}{c}") for c in AT for n, f in (("lo", F.min), ("hi", F.max))]).first()
    points = ends["points"]
    if ends["loi"] is None:
        sizes = [2]
    else:  # cells count from the least place, so that the largest one holds all
        a, b = (x.select(*on, *[(F.col(c) - ends[f"lo{c}"]).alias(c) for c in AT]) for x in (a, b))
        sizes = _sizes(max(ends[f"hi{c}"] - ends[f"lo{c}"] + 1 for c in AT))
    cells = [f"{t}_{c}" for t in "ab" for c in AT]
    up = {t: [f"{t}_up_{c}" for c in AT] for t in "ab"}
    pairs, parent = None, sizes[0] * 4
    for size in sizes:
        x, y = _boxes(a, on, size, parent, "a"), _boxes(b, on, size, parent, "b")
        if pairs is None:  # one cell of each set
            met = x.join(y, on) if on else x.crossJoin(y)
        else:
            above = pairs.select(*on, *[F.col(f"{t}_{c}").alias(f"{t}_up_{c}") for t in "ab" for c in AT])
            met = above.join(x, [*on, *up["a"]]).join(y, [*on, *up["b"]])
        met = cut(met.select(*on, *cells, _squares(_least(), spacing).alias("least"), upper(spacing).alias("most"), (F.col("a_n") * F.col("b_n")).alias("points")))
        pairs, parent = prune(met), size
        if (pairs.agg(F.sum("points")).first()[0] or 0) <= max(ENOUGH, ENOUGH_EACH * points):
            break
    p = a.select(*on, *AT, *[F.floor(F.col(c) / parent).alias(f"a_{c}") for c in AT])
    q = b.select(*on, *[F.col(c).alias(f"{c}2") for c in AT], *[F.floor(F.col(c) / parent).alias(f"b_{c}") for c in AT])
    near = pairs.select(*on, *cells).join(p, [*on, *cells[:3]]).join(q, [*on, *cells[3:]])
    return near.select(*on, *AT, *[f"{c}2" for c in AT], _squares([F.col(c) - F.col(f"{c}2") for c in AT], spacing).alias("square"))


def _bounded(x: DataFrame, bounds: DataFrame, on: list[str]) -> DataFrame:
    """Joins one row of bounds for each set."""
    return x.join(bounds, on) if on else x.crossJoin(bounds)


def least_distance(a: DataFrame, b: DataFrame, spacing=(1.0, 1.0, 1.0), on: tuple[str, ...] = ()) -> DataFrame:
    """on..., distance: the least distance between a point of a and one of b, for each set that both have (one row, null without points, if `on` is empty).

    Cells hold one of their points each, and the least distance of such points bounds the answer; pairs of cells that are farther apart go.
    """
    one = lambda s: _squares([F.col(f"a_one.{c}") - F.col(f"b_one.{c}") for c in AT], s)
    keys = list(on)

    def prune(met: DataFrame) -> DataFrame:
        return _bounded(met, met.groupBy(*keys).agg(F.min("most").alias("bound")), keys).filter(F.col("least") <= F.col("bound") * ROOM).drop("bound")

    return _descend(a, b, keys, spacing, one, prune).groupBy(*keys).agg(F.sqrt(F.min("square")).alias("distance"))


def greatest_nearest(a: DataFrame, b: DataFrame, spacing=(1.0, 1.0, 1.0), on: tuple[str, ...] = ()) -> DataFrame:
    """on..., distance: the greatest of the distances from each point of a to its nearest of b (the directed Hausdorff distance).

    Most points have their nearest around them, where they look for it; only the others go down the tree. For each cell of a, a point of every cell of b bounds how far its points' nearest can be; cells of b beyond that go. Some cell's nearest
    is at least so far as its nearest box; cells of a that are surely nearer go, too, so that few points are compared in the end.
    """
    keys = list(on)
    far = lambda s: _squares([F.greatest(F.abs(F.col(f"a_hi_{c}") - F.col(f"b_one.{c}")), F.abs(F.col(f"b_one.{c}") - F.col(f"a_lo_{c}"))) for c in AT], s)
    own = [f"a_{c}" for c in AT]

    def prune(met: DataFrame) -> DataFrame:
        each = met.groupBy(*keys, *own).agg(F.min("least").alias("_least"), F.min("most").alias("_most"))
        low = each.groupBy(*keys).agg(F.max("_least").alias("_low"))
        alive = _bounded(each, low, keys).filter(F.col("_most") * ROOM >= F.col("_low")).select(*keys, *own, "_most")
        return met.join(alive, [*keys, *own]).filter(F.col("least") <= F.col("_most") * ROOM).drop("_most")

    there = cut(b.select(*keys, *AT).dropna(subset=list(AT)))
    nearest, beyond, _ = looked_up(a.select(*keys, *AT).dropna(subset=list(AT)), there, keys, spacing)
    if not beyond.isEmpty():
        tree = _descend(beyond, there, keys, spacing, far, prune).groupBy(*keys, *AT).agg(F.min("square").alias("square"))
        nearest = nearest.unionByName(tree)
    return nearest.groupBy(*keys).agg(F.sqrt(F.max("square")).alias("distance"))
