"""Near-duplicates by MinHash with tensored banding; every link is confirmed on full shingle sets.

Two small collections of hash groups are computed, `SIDE` on each side. A table's key joins one group
of the left with one of the right, so SIDE x SIDE tables cost 2 x SIDE groups of minhashes. Documents
with equal sets form one class, and only classes take part. In each bucket all classes are compared
with one of them; after the connected classes are merged, what is left in a bucket of different
components is compared across, so that a large group of copies never becomes all of its pairs. Where
very many texts share a template and are no links, that is still a square of the bucket, which is dealt
to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewell.llm.common import LOWER, cut, flat, groups, keep, maybe_in, membership, mix64, with_places
from dosewell.llm.components import components

#: Hash groups on each side and minhashes in a group: at a similarity of 0.8 a pair shares a table
#: with probability (1 - (1 - 0.8^3)^14)^2 = 0.99991.
SIDE, ROWS = 14, 3
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bits of the parity sketch that rules pairs out before their sets are fetched.
PARITY_BITS = 512
#: Bytes of text whose shingles are hashed at once: a task takes some 45 bytes for each.
SET_BYTES = 1 << 20
#: Members of a bucket that are compared across in one task; a larger bucket is compared in squares.
SQUARE = 1 << 11

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEEDS = mix64(np.arange(1, 2 * SIDE * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(x: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's distinct shingles, sorted, and where each row's begin.

    Words are runs without ASCII white space of the lower-cased (A-Z) bytes. A row of fewer than
    `width` words has its whole sequence as one shingle, a row without words has none.
    """
    n = len(x)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    x = np.frombuffer(x.tobytes().translate(LOWER), np.uint8)
    word = ~_BLANK[x]
    border = np.zeros(n + 1, bool)
    border[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | border[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | border[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[x] * _powers(_BASE, n), dtype=np.uint64)))
    words = mix64((total[end] - total[start]) * _powers(_INVERSE, n)[start] + (end - start).astype(np.uint64))
    at = np.searchsorted(start, off)
    count = np.diff(at)
    row = np.repeat(np.arange(len(count)), count)
    left = at[1:][row] - np.arange(len(words))  # words of the row from here on
    shingle = np.zeros(len(words), np.uint64)
    for k in range(width):
        has = np.flatnonzero(left > k)
        shingle[has] = mix64(shingle[has] + words[has + k] + np.uint64(k + 1))
    use = (left >= width) | ((count[row] < width) & (left == count[row]))
    row, shingle = row[use], shingle[use]
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    row, shingle = row[new], shingle[new]
    return shingle, np.searchsorted(row, np.arange(len(off)))


def _signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 2 * SIDE group hashes of each non-empty set, the left ones first: each of ROWS minhashes and its number."""
    out = np.zeros((len(at) - 1, 2 * SIDE), np.uint64)
    for k, seed in enumerate(_SEEDS):
        h = (sets ^ seed) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xCA5A826395121157)
        group = k // ROWS
        out[:, group] = mix64(out[:, group] + np.minimum.reduceat(h, at[:-1]) + np.uint64(k))
    return out


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), _signed(values))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set1, set2 (two sums over the set, which name it), left and right (group hashes, none without shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, off = flat(b.column(1))
            for i, j in groups(off, SET_BYTES):
                part = off[i : j + 1]
                sets, at = shingle_sets(x[part[0] : part[-1]], part - part[0], width)
                size = np.diff(at)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sets + np.uint64(s)), dtype=np.uint64))) for s in (1, 2)]
                some = np.flatnonzero(size > 0)
                sig = _signatures(sets, np.append(at[some], len(sets))) if len(some) else np.zeros((0, 2 * SIDE), np.uint64)
                ends = np.concatenate(([0], np.cumsum(np.where(size > 0, SIDE, 0))))
                sides = [_lists(sig[:, k : k + SIDE].ravel(), ends) for k in (0, SIDE)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size), *[_signed(t[at[1:]] - t[at[:-1]]) for t in sums], *sides], names=["doc_id", "n_shingles", "set1", "set2", "left", "right"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, set1 long, set2 long, left array<long>, right array<long>")


def _parities(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set, PARITY_BITS bits: whether an odd number of its shingles falls on a bit.

    Two sketches differ in at most as many bits as shingles are in one of the sets alone.
    """
    out = np.zeros((len(at) - 1, PARITY_BITS // 64), np.int64)
    place = (mix64(sets ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(PARITY_BITS)).astype(np.int64)
    for lo in range(0, len(at) - 1, 1024):
        hi = min(lo + 1024, len(at) - 1)
        row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
        odd = np.bincount(row * PARITY_BITS + place[at[lo] : at[hi]], minlength=(hi - lo) * PARITY_BITS) & 1
        out[lo:hi] = np.packbits(odd.astype(np.uint8).reshape(hi - lo, PARITY_BITS), axis=1).view(np.int64)
    return out


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """doc_id, its sorted shingle hashes and their parity sketch, for the wanted ids.

    A filter of fixed size drops most other texts where they are read; the join is exact.
    """
    words = membership(wanted)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = maybe_in(words.value, b.column(2).to_numpy(), b.column(3).to_numpy())
            b = b.filter(pa.array(some))
            x, off = flat(b.column(1))
            for i, j in groups(off, SET_BYTES):
                part = off[i : j + 1]
                sets, at = shingle_sets(x[part[0] : part[-1]], part - part[0], width)
                odd = _parities(sets, at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _lists(sets, at), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * odd.shape[1]), pa.array(odd.ravel()))], names=["doc_id", "shingles", "odd"])

    found = with_places(docs.filter("doc_id is not null"), "doc_id").mapInArrow(give, "doc_id long, shingles array<long>, odd array<long>").join(wanted, "doc_id", "left_semi")
    # rows that repeat an id are one set if they are equal; no new shuffle, as rows lie by id
    return found.groupBy("doc_id", F.xxhash64("shingles").alias("_s")).agg(F.any_value("shingles").alias("shingles"), F.any_value("odd").alias("odd")).drop("_s")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, xa), (y, ya) = ((c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (b.column("x"), b.column("y")))
            ok = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                u, v = x[xa[k] : xa[k + 1]], y[ya[k] : ya[k + 1]]
                both = np.concatenate((u, v))
                both.sort(kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                ok[k] = 100 * same >= percent * (len(u) + len(v) - same)
            keep_ = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep_), b.column("b").filter(keep_)], names=["a", "b"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def _equal(u: str, v: str) -> Column:
    return F.zip_with(u, v, lambda s, t: (s == t).cast("int"))


def _plausible(n1: str, n2: str, odd1: str, odd2: str, percent: int) -> Column:
    """Whether two sets can be similar enough, by their sizes and parity sketches; never false for a link.

    With sizes a and b, a link has at most (a + b) * (100 - percent) / (100 + percent) shingles in one set alone.
    """
    apart = F.aggregate(F.zip_with(odd1, odd2, lambda s, t: F.bit_count(s.bitwiseXOR(t))), F.lit(0), lambda s, e: s + e)
    near = (F.col(n1) * 100 >= F.col(n2) * percent) & (F.col(n2) * 100 >= F.col(n1) * percent)
    return near & (apart * (100 + percent) <= (F.col(n1) + F.col(n2)) * (100 - percent))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of near-duplicates: doc_id, n_shingles, component_id, kept, one row per document.

    A document's set has its distinct `width`-word shingles; two documents are linked when 100 *
    intersection >= percent * union, confirmed on the full sets. component_id is the smallest doc_id
    reachable over links, itself included, and a row is kept if it is its own. Null, empty and
    blank texts have no shingles and are linked with nothing. Rows that repeat an id are one
    document if their sets are equal; otherwise the id belongs to the component of each, and takes the
    smallest. Null ids get component null and are never kept. Other columns are not read.
    """
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(signatures(x, width))
    named = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(named.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("c"), F.any_value("left").alias("left"), F.any_value("right").alias("right")))
    sides = classes.select("c", "left", "right")
    # left groups that several classes share, then their keys with every right group
    lefts = sides.select("c", F.explode("left").alias("l"))
    shared = lefts.groupBy("l").agg(F.count("*").alias("n")).filter("n > 1").select("l")
    keys = cut(lefts.join(shared, "l", "left_semi").join(sides.select("c", "right"), "c").select("c", F.explode(F.transform("right", lambda r: F.xxhash64("l", r))).alias("key")))
    buckets = keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("c"), "c")).alias("m"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("m.c").alias("lead"))
    members = cut(keys.join(buckets, "key"))
    sets = keep(full_sets(x, members.select(F.col("c").alias("doc_id")).distinct(), width))
    sketches = sets.select(F.col("doc_id").alias("c"), F.size("shingles").alias("n"), "odd")
    half = lambda v: sketches.select(F.col("c").alias(v), F.col("n").alias(f"n{v}"), F.col("odd").alias(f"odd{v}"))
    star = members.filter("c <> lead").select(F.least("c", "lead").alias("a"), F.greatest("c", "lead").alias("b")).distinct()
    star = star.join(half("a"), "a").join(half("b"), "b").filter(_plausible("na", "nb", "odda", "oddb", percent)).select("a", "b")
    links = cut(_confirmed(star, sets, percent))
    first = components(links)
    # buckets that still hold several components: compare across them
    now = cut(members.join(first, F.col("c") == F.col("node"), "left").select("key", "c", F.coalesce("component", "c").alias("g")))
    mixed = now.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("key", F.ceil(F.col("n") / SQUARE).cast("int").alias("strips"))
    open_ = cut(now.join(mixed, "key").withColumn("strip", F.pmod(F.xxhash64("c"), "strips").cast("int")))
    one = sides.join(open_.select("c").distinct(), "c", "left_semi").join(sketches, "c")
    # the square of a strip pair is one task's
    every = F.explode(F.sequence(F.lit(0), F.col("strips") - 1))
    squares = {"a": ("strip", every), "b": (every, "strip")}
    p, q = (open_.select("*", F.col(x).alias("x") if isinstance(x, str) else x.alias("x"), F.col(y).alias("y") if isinstance(y, str) else y.alias("y")).join(one, "c").select(*[F.col(v).alias(f"{v}{k}") for v in ("key", "x", "y", "c", "g", "n", "odd", "left", "right")]) for k, (x, y) in squares.items())
    # a pair meets in every table that it shares; it counts in the first of them
    table_ = F.xxhash64(F.col("lefta")[F.array_position(_equal("lefta", "leftb"), 1).cast("int") - 1], F.col("righta")[F.array_position(_equal("righta", "rightb"), 1).cast("int") - 1])
    on = (F.col("keya") == F.col("keyb")) & (F.col("xa") == F.col("xb")) & (F.col("ya") == F.col("yb")) & (F.col("ca") < F.col("cb")) & (F.col("ga") != F.col("gb"))
    across = p.join(q, on & _plausible("na", "nb", "odda", "oddb", percent) & (F.col("keya") == table_)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    more = cut(_confirmed(across.distinct(), sets, percent))
    last = components(links.union(more))
    found = classes.join(last, F.col("c") == F.col("node"), "left").select("set1", "set2", "n_shingles", F.coalesce("component", "c").alias("_g"))
    out = rows.select("doc_id", "n_shingles", "set1", "set2").join(found, ["set1", "set2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("_g")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
