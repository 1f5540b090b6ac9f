"""Coefficients kept in place: dealt out once by beamlet and once by voxel, or packed, so that products don't move them again."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewell.operators.coeffs import COLUMN, apply_transpose, apply_weights

#: Beamlets whose weights are sent to all tasks (some 70 MB).
FEW = 1_000_000
#: Voxels in a block of partial doses (2 MB of doubles).
BLOCK = 1 << 18


@dataclass(frozen=True)
class Coefficients:
    """The same coefficients in both orientations; each product moves sums or one row a beamlet or voxel, no coefficients."""

    by_beamlet: DataFrame
    by_voxel: DataFrame

    def dose(self, weights: DataFrame) -> DataFrame:
        """d = A w. Weights are dealt out as the beamlets are; what moves are doses, summed in each task first."""
        return apply_weights(self.by_beamlet, weights)

    def dose_of_few(self, weights: DataFrame) -> DataFrame:
        """`dose` of so `few` weights that they go to all tasks: each voxel's coefficients are in one place already, so neither they nor doses move."""
        return apply_weights(self.by_voxel, F.broadcast(weights))

    def gradient(self, residual: DataFrame) -> DataFrame:
        """g = A' r, residuals dealt out as the voxels are and looked up there, so that coefficients aren't sorted for each product."""
        return apply_transpose(self.by_voxel, residual.hint("shuffle_hash"))

    def unpersist(self) -> None:
        self.by_beamlet.unpersist()
        self.by_voxel.unpersist()


def few(weights: DataFrame) -> bool:
    """Whether there are at most FEW weights, which is looked up."""
    return weights.limit(FEW + 1).count() <= FEW


def in_place(coo: DataFrame, partitions: int | None = None, voxels_only: bool = False) -> Coefficients:
    """Both orientations, or (for `dose_of_few`) the one by voxel only, on the executors' memory and disks, for the products of one session.

    The planner knows how stored rows are dealt out and joins them without another exchange as long as `partitions` is the session's
    spark.sql.shuffle.partitions, the default. Parts of a lost executor are dealt out again.
    """
    n = partitions or int(coo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = coo.select(*COLUMN, "voxel", "coeff")
    stored = Coefficients(*[x.repartition(n, *keys) for keys in (COLUMN, ("voxel",))])
    for kept in (stored.by_voxel,) if voxels_only else (stored.by_beamlet, stored.by_voxel):
        kept.persist(StorageLevel.MEMORY_AND_DISK).count()  # only of rows that are stored already is it known how they are dealt out
    return stored


def write_bucketed(coo: DataFrame, name: str, buckets: int) -> None:
    """Both orientations as bucketed and sorted tables of the catalog, `name`_by_beamlet and `name`_by_voxel, for many sessions."""
    x = coo.select(*COLUMN, "voxel", "coeff")
    for how, keys in (("beamlet", COLUMN), ("voxel", ("voxel",))):
        x.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(f"{name}_by_{how}")


def read_bucketed(spark: SparkSession, name: str) -> Coefficients:
    return Coefficients(spark.table(f"{name}_by_beamlet"), spark.table(f"{name}_by_voxel"))


def packed_dose(packed: DataFrame, weights: DataFrame, block: int = BLOCK) -> DataFrame:
    """d = A w of packed beamlets (beam, beamlet, lindex, coeffs): voxel, dose, as `apply_weights` of their rows.

    Arrays are not exploded: a task adds weighted coefficients into dense blocks of voxels as they come, and only blocks move, one for each
    task and block that it met. A beamlet without a weight adds 0 to its voxels; arrays of different lengths are an error.
    A task holds at most 64 blocks at a time and gives them away when it meets more.
    """
    size = F.size("lindex") == F.size("coeffs")
    agree = F.assert_true(size | size.isNull(), F.lit("lindex and coeffs differ in length"))
    x = packed.filter(agree.isNull()).join(weights, list(COLUMN), "left").select(F.col("lindex").cast("array<long>").alias("lindex"), F.col("coeffs").cast("array<double>").alias("coeffs"), F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            b = b.filter(pc.is_valid(b.column("lindex")))
            at = b.column("lindex").flatten().to_numpy(zero_copy_only=False)
            n = np.diff(b.column("lindex").offsets.to_numpy())
            value = np.nan_to_num(b.column("coeffs").flatten().to_numpy(zero_copy_only=False), nan=0.0) if b.column("coeffs").flatten().null_count else b.column("coeffs").flatten().to_numpy()
            value = value * np.repeat(b.column("weight").to_numpy(), n)
            of = at // block
            order = np.argsort(of, kind="stable")
            numbers, first = np.unique(of[order], return_index=True)
            for number, i, j in zip(numbers.tolist(), first, np.append(first[1:], len(order))):
                if number not in held and len(held) >= 64:
                    yield from _given(held)
                    held = {}
                dose, met = held.setdefault(number, (np.zeros(block), np.zeros(block, bool)))
                place = at[order[i:j]] - number * block
                dose += np.bincount(place, weights=value[order[i:j]], minlength=block)
                met[place] = True
        yield from _given(held)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dose, met = None, None, None
        for b in batches:
            for number, d, m in zip(b.column("block").to_pylist(), b.column("dose").to_pylist(), b.column("met").to_pylist()):
                if number != now:
                    if now is not None:
                        yield _voxels(now, block, dose, met)
                    now, dose, met = number, np.zeros(block), np.zeros(block, bool)
                dose += np.frombuffer(d)
                met |= np.unpackbits(np.frombuffer(m, np.uint8), count=block).astype(bool)
        if now is not None:
            yield _voxels(now, block, dose, met)

    blocks = x.mapInArrow(partial, "block long, dose binary, met binary").repartition("block").sortWithinPartitions("block")
    return blocks.mapInArrow(whole, "voxel long, dose double")


def _given(held: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for number, (dose, met) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([dose.tobytes()], pa.binary()), pa.array([np.packbits(met).tobytes()], pa.binary())], names=["block", "dose", "met"])


def _voxels(number: int, block: int, dose: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(met)
    return pa.RecordBatch.from_arrays([pa.array(at + number * block), pa.array(dose[at])], names=["voxel", "dose"])
