"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Only the histogram of lengths (at most `width` numbers) reaches the driver. The plan fills each
gap exactly with one, two or three available lengths, found in an index of their sums, and the
rest by best fit; every pattern is used as often as its counts allow. Pieces then find their place
by their rank within their length, which Spark computes in salted groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewell.llm.common import keep, partitions
from dosewell.llm.tokens import token_pieces


class SumIndex:
    """Available lengths by the sums of one, two and three of them.

    `pairs` and `triples` hold a combination for each sum. Counts only fall, so a combination is good while its
    lengths last, is looked for again when they don't, and a sum without one never gets one.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self.pairs: dict[int, tuple[int, ...] | None] = {}
        self.triples: dict[int, tuple[int, ...] | None] = {}

    def lasts(self, combination: tuple[int, ...]) -> bool:
        return all(self.left[x] >= combination.count(x) for x in combination)

    def take(self, combination: tuple[int, ...], times: int = 1) -> None:
        for x in combination:
            self.left[x] -= times

    def _best_pair(self, total: int) -> tuple[int, ...] | None:
        """Of the pairs of a sum, the one that lasts longest."""
        a = np.arange(1, total // 2 + 1)
        room = np.minimum(self.left[a], self.left[total - a])
        if not total % 2 and len(a):
            room[-1] = self.left[total // 2] // 2
        k = int(room.argmax()) if len(room) else 0
        return (total - int(a[k]), int(a[k])) if len(room) and room[k] > 0 else None

    def pair(self, total: int) -> tuple[int, ...] | None:
        have = self.pairs.get(total, ())
        if have is not None and (not have or not self.lasts(have)):
            have = self.pairs[total] = self._best_pair(total)
        return have

    def _best_triple(self, total: int) -> tuple[int, ...] | None:
        """A length and a pair: of those whose length is the least third or more, the one that lasts longest."""
        best, room = None, 0
        for x in (np.flatnonzero(self.left[: total - 1]))[::-1].tolist():
            if x * 3 < total:  # the largest of three is no less than a third
                break
            two = self.pair(total - x)
            if two is None:
                continue
            if x in two and not self.lasts((x, *two)):
                self.left[x] -= 1
                two = self._best_pair(total - x)
                self.left[x] += 1
                if two is None:
                    continue
            three = (x, *two)
            lasting = min(int(self.left[y]) // three.count(y) for y in three)
            if lasting > room:
                best, room = three, lasting
        return best

    def triple(self, total: int) -> tuple[int, ...] | None:
        have = self.triples.get(total, ())
        if have is not None and (not have or not self.lasts(have)):
            have = self.triples[total] = self._best_triple(total)
        return have

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that add up to `gap`."""
        return (gap,) if self.left[gap] > 0 else self.pair(gap) or self.triple(gap)


def packing_plan(counts: dict[int, int], width: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how often each is used, from the number of pieces of each length.

    Each pattern fits `width`, and together they use every piece once. The largest remaining length
    opens a sequence; its gap is filled exactly where one to three lengths allow it, otherwise the
    largest length that fits goes in (best fit) and the smaller gap is tried again.
    """
    left = np.zeros(width + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index = SumIndex(left)
    plan: list[tuple[list[int], int]] = []
    for top in range(width, 0, -1):
        while index.left[top] > 0:
            pattern = [top]
            index.take((top,))
            gap = width - top
            while gap > 0:
                fill = index.complement(gap)
                if fill is None:
                    fits = np.flatnonzero(index.left[1 : gap + 1])
                    if not len(fits):
                        break
                    fill = (int(fits[-1]) + 1,)
                index.take(fill)
                pattern += fill
                gap -= sum(fill)
            # as often again as its lengths last
            more = min(int(index.left[x]) // pattern.count(x) for x in pattern)
            index.take(tuple(pattern), more)
            plan.append((pattern, more + 1))
    return plan


def pack(pieces: DataFrame, width: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (1 to `width`).

    Every piece gets one place, no sequence holds more than `width` tokens, and offsets leave no gap.
    Rows of one length are ranked in salted groups, so a length that a third of all rows share is
    split over tasks. Identical rows may change places with one another, which changes no result.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    salts = max(64, partitions(spark))
    salted = keep(pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")))
    cells = keep(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    histogram = {int(r["length"]): int(r["n"]) for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots, base = [], 0
    taken: dict[int, int] = {}
    for pattern, times in packing_plan(histogram, width):
        place = 0
        for length in pattern:
            lo = taken.get(length, 0)
            slots.append((length, lo, lo + times, base - lo, place))
            taken[length] = lo + times
            place += length
        base += times
    # At most a few thousand rows: patterns are bounded by the width, not by the documents.
    places = spark.createDataFrame(slots, "_length long, _lo long, _hi long, _shift long, offset long")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), "_before")
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_in", F.row_number().over(inside) - 1).join(starts, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_in") + F.col("_before"))
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return placed.withColumn("sequence_id", F.col("_rank") + F.col("_shift")).drop("_salt", "_l", "_s", "_before", "_in", "_rank", "_length", "_lo", "_hi", "_shift")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, width: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenises documents, cuts those longer than `width` tokens and packs all pieces.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is empty and
    packs its end id; repeated rows are packed each; other columns are not read.
    """
    cut_up = token_pieces(docs, vocabulary, width, end_id)
    return pack(cut_up, width).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
