"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The trees are fitted on a bounded sample and every vector is indexed in each of them. A query walks
all trees through one shared priority queue, the branch with the best margin first, until the leaves
it reached hold enough vectors; how many are enough is measured on some queries. Each vector moves once,
with its leaf in every tree, to a block of neighbours; a query goes to the blocks that hold vectors
of its leaves. There the vectors of those leaves are scored exactly, and each query keeps its best. Inner
products become distances by the usual extra dimension that makes all indexed vectors equally long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewell.llm.common import keep, mix64, partitions

#: Vectors that fit the trees, whatever the size of the table.
SAMPLE = 40_000
TREES, LEAF = 12, 400
#: Levels of a tree at most: a query carries a bit for each leaf of the forest.
MOST_DEPTH = 11
#: Queries that are compared with all vectors, and the share of their true nearest that walks must reach.
PROBES, RECALL = 64, 0.95
#: Vectors of a block at most, and blocks that a query is addressed to, few and many; larger blocks are dealt to several tasks.
BLOCK, LEAST_BLOCKS, MOST_BLOCKS = 1 << 16, 16, 1024
#: Queries of a block that are scored in one go, and rows of a batch that is sent.
CHUNK, SENT = 128, 4096


class Tree:
    """A binary tree over sample vectors; node k's children are 2k + 1 and 2k + 2, its planes random and balanced."""

    def __init__(self, points: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        inner = (1 << depth) - 1
        self.depth, self.inner = depth, inner
        self.normal = np.zeros((inner, points.shape[1]), np.float32)
        self.offset = np.zeros(inner, np.float32)
        parts = {0: np.arange(len(points))}
        for k in range(inner):
            rows = parts.pop(k)
            normal = self._plane(points[rows], rng) if len(rows) >= 2 else rng.standard_normal(points.shape[1])
            size = float(np.linalg.norm(normal))
            if size == 0:  # copies of one vector
                normal = rng.standard_normal(points.shape[1])
                size = float(np.linalg.norm(normal))
            self.normal[k] = normal / size
            at = points[rows] @ self.normal[k]
            self.offset[k] = np.median(at) if len(at) else 0.0
            right = at > self.offset[k]
            parts[2 * k + 1], parts[2 * k + 2] = rows[~right], rows[right]

    @staticmethod
    def _plane(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The direction between two random centres, moved a few times to the means of their sides."""
        some = points[rng.choice(len(points), min(len(points), 200), replace=False)]
        a, b = some[rng.choice(len(some), 2, replace=False)]
        for _ in range(6):
            near_b = some @ (b - a) > (b @ b - a @ a) / 2
            if near_b.all() or not near_b.any():
                break
            a, b = some[~near_b].mean(axis=0), some[near_b].mean(axis=0)
        return b - a

    def leaves(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            at = np.einsum("ij,ij->i", points, self.normal[node]) - self.offset[node]
            node = 2 * node + 1 + (at > 0)
        return node - self.inner


def walk(margins: list[np.ndarray], trees: list[Tree], counts: np.ndarray, enough: float = np.inf, least: float = np.inf) -> Iterator[tuple[int, int]]:
    """Leaves (tree, leaf) in the order of a priority queue shared by all trees.

    A branch's priority is the least margin on the way to it. The walk ends when the leaves hold
    `enough` vectors and one tree's leaves at least `least`, which are different vectors.
    """
    queue = [(-np.inf, t, 0) for t in range(len(trees))]
    heapq.heapify(queue)
    total, own = 0, np.zeros(len(trees), np.int64)
    while queue and (total < enough or own.max() < least):
        best, t, k = heapq.heappop(queue)
        tree, m = trees[t], margins[t]
        while k < tree.inner:
            side = m[k]
            far, near = (2 * k + 1, 2 * k + 2) if side > 0 else (2 * k + 2, 2 * k + 1)
            heapq.heappush(queue, (max(best, abs(side)), t, far))
            k = near
        leaf = k - tree.inner
        n = counts[t, leaf]
        if n:
            total += n
            own[t] += n
            yield t, leaf


def first_reached(margins: list[np.ndarray], trees: list[Tree], counts: np.ndarray, leaves: np.ndarray) -> list[int]:
    """How many vectors lie in the leaves that a walk has reached when it first meets each of the rows of `leaves` (a leaf of every tree)."""
    there: dict[tuple[int, int], list[int]] = {}
    for row, own in enumerate(leaves.tolist()):
        for t, leaf in enumerate(own):
            there.setdefault((t, leaf), []).append(row)
    at: dict[int, int] = {}
    total = 0
    for t, leaf in walk(margins, trees, counts):
        total += int(counts[t, leaf])
        for row in there.get((t, leaf), ()):
            at.setdefault(row, total)
        if len(at) == len(leaves):
            break
    return list(at.values())


def _matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def _longer(points: np.ndarray, longest: float | None) -> np.ndarray:
    """Indexed vectors get the dimension that makes them `longest`; queries get 0 and length 1."""
    if longest is None:
        unit = points / np.linalg.norm(points, axis=1, keepdims=True)
        return np.hstack([unit, np.zeros((len(points), 1))]).astype(np.float32)
    rest = np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0))
    return (np.hstack([points, rest[:, None]]) / longest).astype(np.float32)


def _in_order(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in order of the components: equal vectors have equal scores everywhere."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def best_pairs(q: np.ndarray, x: np.ndarray, ids: np.ndarray, among: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, exact score) of the `most` best of each q, ties to the smaller id; `among` marks the candidates."""
    s = q @ x.T
    if among is not None:
        s[~among] = -np.inf
    edge = np.full(len(q), -np.inf)
    if len(x) > most:
        edge = np.partition(s, len(x) - most, axis=1)[:, len(x) - most]
    # the product's rounding depends on the shape of the block, so what is close to the edge is summed again
    slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0.0)
    row, col = np.nonzero((s >= (edge - slack)[:, None]) & np.isfinite(s))
    score = _in_order(q[row], x[col])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < most], col[rank < most], score[rank < most]


def _bits(visited: list[tuple[int, int]], trees: int, leaves: int) -> np.ndarray:
    out = np.zeros((trees, leaves), np.uint8)
    for t, leaf in visited:
        out[t, leaf] = 1
    return np.packbits(out.ravel())


class Blocks:
    """Vectors lie in blocks of neighbouring leaves of the first tree; a block beyond `size` is split by id."""

    def __init__(self, first: np.ndarray, size: int):
        n = int(first.sum())
        count = max(1, min(MOST_BLOCKS, -(-n // size)))
        self.of_leaf = np.minimum((np.cumsum(first) - first) // max(1, -(-n // count)), count - 1)
        held = np.bincount(self.of_leaf, weights=first, minlength=count)
        self.parts = np.maximum(1, -(-held // size)).astype(np.int64)
        self.base = np.cumsum(self.parts) - self.parts
        self.count, self.slots = count, int(self.parts.sum())

    def slot(self, leaf: np.ndarray, ids: np.ndarray) -> np.ndarray:
        block = self.of_leaf[leaf]
        return self.base[block] + (mix64(ids.view(np.uint64)) % self.parts[block].astype(np.uint64)).astype(np.int64)


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, search: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `query_every`.

    Nearness is the inner product in double precision, summed in order of the components; ties go to
    the smaller id, and a row is no candidate of its own. Vectors that are null, zero, of another
    length than most, or hold null or non-finite components take no part, nor do null ids. Of rows
    that repeat an id, one with the smallest vector takes part. Copies of one vector are indexed and
    searched once, with their k + 1 smallest ids, which are all that can be among a query's nearest.
    An empty table gives no rows; other columns are not read.

    A walk ends when its leaves hold `search` vectors. Where `search` is not given it is measured:
    `PROBES` queries are compared with every vector, and `search` is what reaches the share `recall`
    of their true nearest, so it grows with the table as far as the data need it.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    v = v.filter(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0))
    v = v.groupBy("vec_id").agg(F.min("v").alias("v"))
    dims = v.agg(F.mode(F.size("v"), True)).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    v = keep(v.filter(F.size("v") == dims).withColumn("v", F.transform("v", lambda e: e + 0.0)))  # -0.0 becomes 0.0
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    first = v.withColumn("_k", F.row_number().over(by_vector)).filter(F.col("_k") <= k + 1)  # limited before the shuffle, too
    items = keep(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("item", F.col("ids")[0]))
    squared = F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)
    n, longest = items.agg(F.count("*"), F.max(F.sqrt(squared))).first()
    rows = items.select("v").orderBy(F.xxhash64("v")).limit(sample).toPandas()["v"] if n else []
    points = _longer(np.array(list(rows), np.float64).reshape(-1, dims), longest)
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / leaf)))), int(np.log2(max(1, len(points) / 4))), MOST_DEPTH))
    forest = [Tree(points, depth, seed) for seed in range(trees)]
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample and MOST_DEPTH
    leaves = 1 << depth

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _longer(_matrix(b.column("v"), dims), longest)
            own = np.stack([tree.leaves(p) for tree in shared.value], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("v"), pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), trees).cast(pa.list_(pa.int32()))], names=["item", "v", "leaves"])

    indexed = keep(items.select("item", "v").mapInArrow(assign, "item long, v array<double>, leaves array<int>"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, leaves), np.int64)
        for b in batches:
            own = _matrix(b.column(0), trees, np.int64)
            for t in range(trees):
                total[t] += np.bincount(own[:, t], minlength=leaves)
        t, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[t, at])], names=["tree", "leaf", "n"])

    counts = np.zeros((trees, leaves), np.int64)
    for r in indexed.select("leaves").mapInArrow(tally, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():  # a number for each leaf of the bounded forest
        counts[r["tree"], r["leaf"]] = r["n"]

    asked = v.filter(F.pmod("vec_id", F.lit(query_every)) == 0)
    # equal query vectors are searched once; the least id names them
    queries = keep(asked.groupBy("v").agg(F.min("vec_id").alias("_q")))
    if search is None:
        search = _enough(queries, indexed, forest, counts, dims, k, recall)

    blocks = Blocks(counts[0], max(256, min(BLOCK, -(-n // LEAST_BLOCKS))))

    def occupied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaves that the vectors of each block lie in, as bits."""
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            own = _matrix(b.column(0), trees, np.int64)
            block = blocks.of_leaf[own[:, 0]]
            for k_ in np.unique(block).tolist():
                mine = own[block == k_]
                seen.setdefault(k_, np.zeros((trees, leaves), np.uint8))[np.arange(trees), mine] = 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([np.packbits(s.ravel()).tobytes() for s in seen.values()], pa.binary())], names=["block", "bits"])

    def united(table: pa.Table) -> pa.Table:
        every = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([every.tobytes()], pa.binary())})

    kind = "block long, bits binary"
    # at most MOST_BLOCKS rows of trees x 2 ** MOST_DEPTH bits
    held = {r["block"]: np.frombuffer(r["bits"], np.uint8) for r in indexed.select("leaves").mapInArrow(occupied, kind).groupBy("block").applyInArrow(united, kind).collect()}
    there = spark.sparkContext.broadcast(np.stack([held.get(b, np.zeros(trees * leaves // 8 + bool(trees * leaves % 8), np.uint8)) for b in range(blocks.count)]))

    placed = "slot long, asks boolean, id long, v array<double>, leaves array<int>, bits binary"
    names = ["slot", "asks", "id", "v", "leaves", "bits"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = blocks.slot(_matrix(b.column("leaves"), trees, np.int64)[:, 0], b.column("item").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.zeros(len(slot), bool)), b.column("item"), b.column("v"), b.column("leaves"), pa.nulls(len(slot), pa.binary())], names=names)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                p = _longer(_matrix(part.column("v"), dims), None)
                margins = [p @ tree.normal.T - tree.offset for tree in shared.value]
                row, slot, bits = [], [], []
                for i in range(len(p)):
                    own = _bits(walk([m[i] for m in margins], shared.value, counts, search, k + 2), trees, leaves)
                    for block in np.flatnonzero((there.value & own).any(axis=1)).tolist():
                        for s in range(blocks.base[block], blocks.base[block] + blocks.parts[block]):
                            row.append(i)
                            slot.append(s)
                            bits.append(own.tobytes())
                    if len(row) >= SENT or i == len(p) - 1:
                        of = pa.array(row, pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(np.ones(len(row), bool)), part.column("_q").take(of), part.column("v").take(of), pa.nulls(len(row), pa.list_(pa.int32())), pa.array(bits, pa.binary())], names=names)
                        row, slot, bits = [], [], []

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block, its vectors before its queries; only a block's vectors are held."""
        now, some, x = None, [], None
        for b in batches:
            slot, asks = b.column("slot").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            edge = np.concatenate(([0], np.flatnonzero((slot[1:] != slot[:-1]) | (asks[1:] != asks[:-1])) + 1, [len(slot)]))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if i == j:
                    continue
                if slot[i] != now:
                    now, some, x = slot[i], [], None
                part = b.slice(i, j - i)
                if not asks[i]:
                    some.append((part.column("id").to_numpy(), _matrix(part.column("v"), dims), _matrix(part.column("leaves"), trees, np.int64)))
                    continue
                if not some:
                    continue
                if x is None:
                    ids, x, own = (np.concatenate(c) for c in zip(*some, strict=True))
                for lo in range(0, j - i, CHUNK):
                    rows = part.slice(lo, CHUNK)
                    q = _matrix(rows.column("v"), dims)
                    visited = np.unpackbits(np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(q), -1), axis=1)[:, : trees * leaves].reshape(len(q), trees, leaves).astype(bool)
                    among = visited[:, 0, own[:, 0]]
                    for t in range(1, trees):
                        among |= visited[:, t, own[:, t]]
                    row, col, score = best_pairs(q, x, ids, among, k + 1)
                    yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(row)), pa.array(ids[col]), pa.array(score)], names=["_q", "item", "score"])

    sent = indexed.mapInArrow(place, placed).union(queries.mapInArrow(visit, placed))
    tasks = max(partitions(spark), blocks.slots)
    found = sent.repartition(tasks, "slot").sortWithinPartitions("slot", "asks").mapInArrow(meet, "_q long, item long, score double")
    # the k + 1 best vectors of a query hold the k + 1 best rows, as each vector brings at least its least id
    top = found.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy(F.col("score").desc(), "item"))).filter(F.col("_r") <= k + 1)
    top = top.join(items.select("item", "ids"), "item").select("_q", "score", F.explode("ids").alias("vec_id"))
    named = asked.join(queries, "v").select(F.col("vec_id").alias("query_id"), "_q")
    mine = named.join(top, "_q").filter(F.col("query_id") != F.col("vec_id"))
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _enough(queries: DataFrame, indexed: DataFrame, forest: list[Tree], counts: np.ndarray, dims: int, k: int, recall: float) -> int:
    """Vectors in leaves after which walks have met the share `recall` of the true nearest of `PROBES` queries."""
    probes = queries.orderBy(F.xxhash64("_q")).limit(PROBES).toPandas()
    if not len(probes):
        return 0
    asked, q = probes["_q"].to_numpy(np.int64), np.array(list(probes["v"]), np.float64)
    trees = len(forest)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("item").to_numpy()
            row, col, score = best_pairs(q, _matrix(b.column("v"), dims), ids, None, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids[col]), pa.array(score), b.column("leaves").take(pa.array(col))], names=["row", "item", "score", "leaves"])

    close = indexed.mapInArrow(compare, "row long, item long, score double, leaves array<int>")
    close = close.withColumn("_r", F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "item"))).filter(F.col("_r") <= k + 1)
    true = close.toPandas()  # k + 1 rows for each probe
    p = _longer(q, None)
    margins = [p @ tree.normal.T - tree.offset for tree in forest]
    reached: list[int] = []
    for row, own in true[true["item"] != asked[true["row"]]].groupby("row"):
        leaves = np.array(list(own.sort_values("_r")["leaves"])[:k]).reshape(-1, trees)
        reached += first_reached([m[row] for m in margins], forest, counts, leaves)
    return int(np.quantile(reached, recall, method="higher")) if reached else 0
