"""Codes of vectors by product quantisation: each part's codebook is trained by Ball k-means in exact integers.

An entry with its parts is a ball. Parts nearer to their entry than half the way to the nearest other entry are its
stable core and are not compared with any other. Beyond it, half distances to the other entries cut the ball into rings:
a part in the k-th ring is compared with the k nearest entries only. The ball's radius says which entries can be
neighbours at all; a ball whose entry and neighbours have not moved keeps its parts without a distance computed.
All comparisons are of integers, and entries at equal distance are compared, so results are those of the plain method.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewell.llm.common import keep

#: Vectors that one pass of NumPy code looks at.
BATCH_ROWS = 8192

STATE = "vec_id long, label string, x binary, codes binary"
SUMS = "part int, entry int, n long, r2 long, sums array<long>"


def neighbours(book: np.ndarray, r2: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each part and entry: the other entries that a part of its ball may be as near to, nearest first, and 4 x the squared way.

    r2 bounds the squared distance of the ball's parts; 4 d(p, i)^2 < d(i, j)^2 rules j out for p.
    """
    out = []
    for m in range(len(book)):
        gap = ((book[m][:, None, :] - book[m][None, :, :]) ** 2).sum(2)
        row = []
        for i in range(book.shape[1]):
            order = np.argsort(gap[i], kind="stable")
            order = order[(order != i) & (gap[i][order] <= 4 * r2[m, i])]
            row.append((order, gap[i][order]))
        out.append(row)
    return out


def assigned(x: np.ndarray, codes: np.ndarray, book: np.ndarray, near: list, stable: np.ndarray) -> np.ndarray:
    """New codes of parts x (rows, parts, width) whose last codes are given."""
    out = codes.copy()
    for m in range(x.shape[1]):
        for i in np.unique(codes[:, m]):
            if stable[m, i]:
                continue
            rows = np.flatnonzero(codes[:, m] == i)
            p = x[rows, m]
            own = ((p - book[m, i]) ** 2).sum(1)
            order, gap = near[m][i]
            ring = np.searchsorted(gap, 4 * own, side="right")
            outer = np.argsort(-ring, kind="stable")  # outer rings first, so that each comparison takes a head
            p, rows, ring, best = p[outer], rows[outer], ring[outer], own[outer]
            at = np.full(len(rows), i, np.uint8)
            reach = np.searchsorted(-ring, -np.arange(len(order)), side="left")
            for j, n in zip(order, reach):
                if not n:
                    break
                d = ((p[:n] - book[m, j]) ** 2).sum(1)
                better = (d < best[:n]) | ((d == best[:n]) & (j < at[:n]))
                best[:n][better] = d[better]
                at[:n][better] = j
            out[rows, m] = at
    return out


def _distances(x: np.ndarray, codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    own = book[np.arange(x.shape[1])[None, :], codes]
    return ((x - own) ** 2).sum(2)


class Shape:
    """Sizes that all tasks share: dimension, parts, and the width of a part after filling up with zeros."""

    def __init__(self, dim: int, parts: int, scale: int) -> None:
        self.dim, self.parts, self.scale = dim, parts, scale
        self.width = -(-dim // parts)
        self.most = math.isqrt((1 << 58) // (self.width * parts))  # four squared distances fit 63 bits

    def integers(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of integers floor(scale * x) as int32."""
        v = np.floor(vectors * self.scale)
        if v.size and np.abs(v).max() > self.most:
            raise ValueError(f"components beyond {self.most / self.scale:g} have squared distances that no long holds")
        out = np.zeros((len(v), self.width * self.parts), "<i4")
        out[:, : self.dim] = v
        return out

    def arrays(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<i4").astype(np.int64)
        codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8)
        return x.reshape(b.num_rows, self.parts, self.width), codes.reshape(b.num_rows, self.parts)


def _binary(rows: np.ndarray) -> pa.Array:
    """Equally long rows of numbers as a binary column."""
    width = rows.itemsize * (rows.size // max(1, len(rows)))
    data = np.ascontiguousarray(rows).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, max(1, width), dtype=np.int32)[: len(rows) + 1].tobytes()), pa.py_buffer(data)])


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(i, BATCH_ROWS)


def _start(rows: DataFrame, shape: Shape) -> DataFrame:
    """Usable vectors as integers, all at entry 0."""

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parted(batches):
            v = b.column("v")
            whole = np.array(pc.equal(pc.list_value_length(v), shape.dim).fill_null(False))
            b = b.filter(pa.array(whole))
            values = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, shape.dim)  # null becomes NaN
            good = np.isfinite(values).all(1)
            x = shape.integers(values[good])
            b = b.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _binary(x), _binary(np.zeros((len(x), shape.parts), np.uint8))], names=["vec_id", "label", "x", "codes"])

    return rows.mapInArrow(usable, STATE)


def _moved(state: DataFrame, shape: Shape, book: np.ndarray, near: list, stable: np.ndarray) -> DataFrame:
    """The state after each part went to its nearest entry; rows stay where they are."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parted(batches):
            x, codes = shape.arrays(b)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), _binary(assigned(x, codes, book, near, stable))], names=["vec_id", "label", "x", "codes"])

    return state.mapInArrow(move, STATE)


def _balls(state: DataFrame, shape: Shape, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, squared radii, sums) of every part's entries; a task gives at most one row for each."""
    parts, entries = book.shape[:2]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r2, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64), np.zeros(book.shape, np.int64)
        for b in _parted(batches):
            x, codes = shape.arrays(b)
            d = _distances(x, codes, book)
            for m in range(parts):
                n[m] += np.bincount(codes[:, m], minlength=entries)
                np.maximum.at(r2[m], codes[:, m], d[:, m])
                np.add.at(sums[m], codes[:, m], x[:, m])
        m, i = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(n[m, i]), pa.array(r2[m, i]), pa.array(sums[m, i].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "r2", "sums"])

    found = state.mapInArrow(summed, SUMS).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("r2").alias("r2"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(shape.width)])
    n, r2, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64), np.zeros(book.shape, np.int64)
    for r in found.collect():  # parts x entries rows at most
        n[r["part"], r["entry"]], r2[r["part"], r["entry"]] = r["n"], r["r2"]
        sums[r["part"], r["entry"]] = [r[f"s{k}"] for k in range(shape.width)]
    return n, r2, sums


def _grown(r2: np.ndarray, moved2: np.ndarray) -> np.ndarray:
    """A bound of squared radii about entries that moved: whole roots, rounded up, can be added safely."""
    root = lambda v: 0 if v == 0 else math.isqrt(int(v) - 1) + 1
    return np.array([[int(r) if s == 0 else (root(r) + root(s)) ** 2 for r, s in zip(a, b)] for a, b in zip(r2, moved2)], np.int64)


def train(state: DataFrame, shape: Shape, entries: int = 16, rounds: int = 6) -> tuple[np.ndarray, DataFrame]:
    """(codebooks, state with final codes) of a stored state.

    The codebooks start as the parts of the smallest vec_ids (ties by the integers), as many as `entries`, fewer if there
    are fewer vectors. Only codebooks, counts, radii and sums (parts x entries rows) come to the driver. A round's state
    is stored on executors' disks and the one before it freed; no row moves between machines, so what a lost executor held is computed again.
    """
    first = state.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    if not first:
        return np.zeros((shape.parts, 0, shape.width), np.int64), state
    book = np.frombuffer(b"".join(bytes(r["x"]) for r in first), "<i4").astype(np.int64).reshape(len(first), shape.parts, shape.width).transpose(1, 0, 2).copy()
    k = book.shape[1]
    r2 = np.full((shape.parts, k), (1 << 60), np.int64)  # nothing is known of the first balls
    stable = np.zeros((shape.parts, k), bool)
    for _ in range(rounds):
        after = keep(_moved(state, shape, book, neighbours(book, r2), stable))
        n, r2, sums = _balls(after, shape, book)
        state.unpersist()
        state = after
        new = np.where(n[:, :, None] > 0, sums // np.maximum(n, 1)[:, :, None], book)
        shift = ((new - book) ** 2).sum(2)
        book, r2 = new, _grown(r2, shift)
        still = shift == 0
        near = neighbours(book, r2)
        stable = np.array([[still[m, i] and bool(still[m, near[m][i][0]].all()) for i in range(k)] for m in range(shape.parts)])
    return book, _moved(state, shape, book, neighbours(book, r2), stable)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Codes of all usable vectors: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null, empty or hold null or non-finite components are dropped; so are those of another length than the
    commonest (the shorter at a tie). Lengths that `parts` does not divide are filled up with zeros. Rows that repeat an id are vectors of
    their own; null ids come last in the order of ids. Components whose squared distances don't fit a long (beyond 16384 for 64 of them and
    a scale of 4096) raise an error. label_error is the error summed over equal labels, nulls together; labels with a thousandth of all rows or more (so
    1000 at most) are looked up in a broadcast table, the others joined by a shuffle. An empty table gives no rows; other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    size = F.size("v")
    common = rows.filter(size > 0).groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    shape = Shape(common[0]["size"] if common else parts, parts, scale)
    book, state = train(keep(_start(rows, shape)), shape, entries, rounds)
    digest = hashlib.sha256(",".join(str(v) for v in book.ravel().tolist()).encode()).hexdigest()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parted(batches):
            x, codes = shape.arrays(b)
            text = [c.hex() for c in b.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array(_distances(x, codes, book).sum(1))], names=["vec_id", "label", "code", "error"])

    out = keep(state.mapInArrow(coded, "vec_id long, label string, code string, error long"))
    totals = keep(out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    rows_in_all = totals.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * 1000 >= rows_in_all
    hot = totals.filter(frequent).select(F.col("label").alias("l"), "label_error", F.lit(True).alias("hot"))
    looked_up = out.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("l")), "left").drop("l")
    cold = totals.filter(~frequent).select(F.col("label").alias("l"), "label_error")
    rare = looked_up.filter("hot is null").drop("hot", "label_error").join(cold, F.col("label").eqNullSafe(F.col("l"))).drop("l")
    columns = ["vec_id", "code", "error", "label_error"]
    return reduce(DataFrame.unionByName, [looked_up.filter("hot").select(*columns), rare.select(*columns)]).withColumn("codebooks_sha256", F.lit(digest))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """SQL of the plain method: every part is compared with every entry in every round."""
    nearest = lambda k: (
        f"near{k} as materialized (select r, p.m, any_value(x) as x, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) * {entries} + e) as best "
        f"from cut p join book{k} b on p.m = b.m group by r, p.m)"
    )
    means = lambda k: (
        f"sums{k} as (select m, e, i, sum(v) as s, count(*) as n from (select m, best % {entries} as e, unnest(x) as v, unnest(range(1, len(x) + 1)) as i from near{k}) group by m, e, i), "
        f"mean{k} as (select m, e, list(cast((s - ((s % n) + n) % n) / n as bigint) order by i) as c from sums{k} group by m, e), "
        f"book{k + 1} as materialized (select b.m, b.e, coalesce(a.c, b.c) as c from book{k} b left join mean{k} a on a.m = b.m and a.e = b.e)"
    )
    steps = ", ".join(f"{nearest(k)}, {means(k)}" for k in range(rounds))
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id, embedding) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cut as materialized (select r, m, v[m * (len(v) // {parts}) + 1 : (m + 1) * (len(v) // {parts})] as x from kept, range({parts}) t(m)),
book0 as materialized (select m, r - 1 as e, x as c from cut where r <= {entries}),
{steps}, {nearest(rounds)},
final as (select r, string_agg(printf('%02x', best % {entries}), '' order by m) as code, sum(cast((best - best % {entries}) / {entries} as bigint)) as error from near{rounds} group by r),
digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by m, e)) as s from book{rounds})
select vec_id, code, cast(error as bigint) as error, cast(sum(error) over (partition by label) as bigint) as label_error, s as codebooks_sha256
from kept join final using (r), digest
"""


ORACLE = _oracle()
