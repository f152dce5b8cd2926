"""What the operators share: written intermediate tables and word scans over Arrow text.

The scans work on the UTF-8 bytes of many texts at once, so that a task spends
its time in numpy and not in a Python loop over words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task scans at once; a longer text is scanned alone.
SLICE_BYTES = 1 << 20
#: Spark's setting by which shuffle files go when the table that they were for is written; else they stay until the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a session on one machine takes a temporary
    folder once; on a cluster, whose executors would not see it, that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-colloquy-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/colloquy/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, through Spark's own file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts lineage, survives lost executors. It stays; what an operator returns reads it."""
    return _table(df, fresh_path(df.sparkSession, name))


def _table(df: DataFrame, path: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before) if before is not None else conf.unset(SHUFFLES_GO)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that an operator reads on its way: drop() removes one early, the end of the block all.

    What the operator returns must be ``written`` inside the block, or not depend on these tables.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, fresh_path(spark, name), {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        out = _table(df, path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(self.spark, self.paths[id(table)][0])


def row_keys(key: str, text: str) -> list[Column]:
    """_id and _tk: the id as text (null has a value too) and a hash of the text, which tell rows apart."""
    return [F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0null")).alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_tk")]


def one_row_each(docs: DataFrame, keep: DataFrame, key: str, text: str) -> DataFrame:
    """One row of docs for each (_id, _tk) of keep; the row travels as a struct, so that no column's name can clash."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *row_keys(key, text))
    return rows.join(keep.select("_id", "_tk"), ["_id", "_tk"]).dropDuplicates(["_id", "_tk"]).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def release() -> None:
    """Gives memory back that Arrow keeps after a task, as the worker may stay on, idle, beside other stages."""
    pa.default_memory_pool().release_unused()


def word_table(pattern: str) -> np.ndarray:
    """Which bytes belong to a word: 'alnum' (0-9, letters, all beyond ASCII) or 'nonspace'."""
    table = np.ones(256, dtype=bool)
    if pattern == "alnum":
        table[:128] = False
        table[ord("0") : ord("9") + 1] = True
        table[ord("a") : ord("z") + 1] = True
        table[ord("A") : ord("Z") + 1] = True
    else:
        table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = table[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (cut | ~before))
    ends = np.flatnonzero(before & (cut | ~inside))
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        _POWERS["up"], _POWERS["down"] = _powers(n, _P), _powers(n, _P_INV)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits (the finalizer of SplitMix64) that spreads polynomial hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: polynomial over prefix sums, then mixed."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words; entry i covers words i to i + n - 1, across texts too."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for j in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j : j + count]
    return mix(out)
