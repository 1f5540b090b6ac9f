"""Shared helpers: reading tables, cutting lineage, and flat byte views of Arrow text columns.

Inside tasks a text column is handled as one byte buffer with row offsets, so that work on
every byte is done by NumPy over the whole batch. Null texts count as empty.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one pass of NumPy code looks at; bounds the memory of a task.
CHUNK_BYTES = 4 << 20

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Store a result that is read more than once on executors' disks; a lost executor's part is computed again."""
    return df.persist(StorageLevel.DISK_ONLY)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the folder that all executors share and read back.

    The folder is spark.checkpoint.dir. Where it is unset, a temporary folder is used in local mode,
    and elsewhere an error says what to set. Spark's users clear that folder as they do for checkpoints.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), "dosewell-checkpoints")
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column has; Spark tells names apart without regard to case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by their names, which may hold dots or quotes."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", nulls_last: bool = True) -> DataFrame:
    """Adds the long `name`: the id, or where ids repeat or are null a number of each row in the order of ids.

    Only in the second case are rows moved and written, in ranges of (id, hash of the text); the place in
    the ranges' order is the number, so no id and no text needs a task of its own.
    """
    own = F.col(id_col).cast("long")
    if df.select(own.alias("i")).groupBy("i").count().filter("`count` > 1 or i is null").isEmpty():
        return df.withColumn(name, own)
    read = free_name(df, f"{name}_")
    keys = [own.asc_nulls_last() if nulls_last else own.asc_nulls_first(), F.xxhash64(text_col), read]
    ranged = df.withColumn(read, F.monotonically_increasing_id()).repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return cut(ranged.withColumn(name, F.monotonically_increasing_id()).drop(read))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, row offsets); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row is a range of its own."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words of 64 bits in a membership filter: its size is 2 MB however many ids it holds.
FILTER_WORDS = 1 << 18


def membership(ids: DataFrame, hashed: bool = True) -> Broadcast:
    """A Bloom filter of the ids (one long column) for tasks that would otherwise move texts.

    Its size is fixed, so it may be broadcast; with very many ids it lets more rows through than it
    should, never fewer, and an exact join always follows. Ids that are hashes by themselves may
    be looked up by `hash_places` (`hashed` false).
    """
    c = F.col(ids.columns[0])
    places = [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(FILTER_WORDS * 64)) if hashed else F.shiftrightunsigned(c, 40 - 24 * k).bitwiseAND(FILTER_WORDS * 64 - 1) for k in range(2)]
    bit = F.explode(F.array(*places))
    words = ids.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    out = np.zeros(FILTER_WORDS, np.int64)
    found = words.toPandas()
    out[found["w"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64)
    return ids.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def with_places(df: DataFrame, id_col: str) -> DataFrame:
    """Adds the two places of an id in a membership filter, as Spark hashes it."""
    return df.withColumns({f"_b{k}": F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.lit(FILTER_WORDS * 64)) for k in range(2)})


def hash_places(h: np.ndarray) -> list[np.ndarray]:
    """The two places of 64-bit hashes in a membership filter that was made of them as they are."""
    return [(h >> np.uint64(40 - 24 * k)) & np.uint64(FILTER_WORDS * 64 - 1) for k in range(2)]


def maybe_in(words: np.ndarray, *places: np.ndarray) -> np.ndarray:
    """Whether ids with these places may be in the filter."""
    out = np.ones(len(places[0]), bool)
    for b in places:
        b = b.astype(np.uint64)
        out &= (words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return out
