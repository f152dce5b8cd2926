"""SimHash near-duplicates by a grid range-join on segment popcounts.

Fingerprint: words are runs of bytes other than ASCII white space, A-Z
lower-cased; XXH64 (seed 42) of every shingle of three words, repeats included,
joined by a space; a bit is 1 if more than half of the hashes have it set. A
text of fewer words has one shingle, of all its words; one without words has
fingerprint zero.

Search for pairs within two bits. A fingerprint is mapped to the counts of set
bits in its 32 segments of two bits. Flipping a bit changes one count by one,
so the Manhattan distance of two count vectors is at most the Hamming distance.
The range-join on the integer grid of count vectors is met half-way: each
fingerprint goes to its own cell and the cells one step away, and two vectors at
distance two or less share a cell. Fingerprints that share no cell with another
one have no partner and are done. (With two bits to a segment, unrelated
fingerprints hardly ever meet: of n random ones, about n * n * 4e-11 pairs.)

Exact verification of the rest uses the same grid with segments of one bit,
where Manhattan and Hamming distance are the same: fingerprints that meet in a
cell there differ in two bits at most, and all that do so meet. A cell holds at
most 65 different fingerprints, however large a group of copies is, and yields
one link from each to the smallest. So links grow with the number of different
fingerprints, and no list of pairs is made; the components are those of all pairs.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; equal fingerprints are one component; a null doc_id counts for no
component's smallest id (a component of null ids alone has null); an empty
table gives no rows; other columns are ignored by find_components().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, one_row_each, written
from .components import components

SHINGLE = 3
SEED = 42
SEGMENTS = 32
#: Fingerprints whose cells one task makes, on average.
FPS_PER_TASK = 50_000
#: Hashes that are counted bit by bit at once.
HASHES_AT_ONCE = 1 << 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    counts = np.zeros(64, dtype=np.int64)
    n = len(words) - size + 1
    for at in range(0, n, HASHES_AT_ONCE):
        end = min(n, at + HASHES_AT_ONCE)
        grams = map(b" ".join, zip(*(words[at + j : end + j] for j in range(size)), strict=True))
        hashes = np.fromiter((xxh64_intdigest(g, seed) for g in grams), dtype=np.uint64, count=end - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    out = np.packbits(2 * counts > n, bitorder="little").view(np.uint64)
    return int(out[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp): a hash that tells rows of one id apart, and the signed 64-bit fingerprint of the whole text."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_key"), F.col(f"`{text}`").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_of(t.as_py(), shingle, seed) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])

    return rows.mapInArrow(scan, T.StructType([rows.schema["doc_id"], rows.schema["text_key"], T.StructField("fp", T.LongType())]))


def segment_counts(fp: Column, segments: int = SEGMENTS) -> list[Column]:
    """Set bits in each of the equal segments of a 64-bit fingerprint."""
    width = 64 // segments
    return [F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1))) for k in range(segments)]


def grid_cells(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(fp, cell): the cell of the segment counts and the cells one step away, each as a hash.

    A long packs the counts of half the segments in base width + 3 (a count may
    step to -1 or width + 1); cells whose hashes agree by chance meet in vain.
    """
    half, base = segments // 2, 64 // segments + 3

    def packed(part: list[Column]) -> Column:
        out = F.lit(0).cast("long")
        for count in part:
            out = out * base + (count + 1)
        return out

    counts = segment_counts(F.col("fp"), segments)
    steps = [0, *(sign * base**k for k in range(half) for sign in (1, -1))]
    moves = F.array(*(F.lit([step, 0]).cast("array<bigint>") for step in steps), *(F.lit([0, step]).cast("array<bigint>") for step in steps[1:]))
    placed = fps.select("fp", packed(counts[:half]).alias("high"), packed(counts[half:]).alias("low"))
    moved = placed.select("fp", "high", "low", F.explode(moves).alias("by"))
    return moved.select("fp", F.xxhash64(F.col("high") + F.get("by", F.lit(0)), F.col("low") + F.get("by", F.lit(1))).alias("cell"))


def bit_cells(fps: DataFrame) -> DataFrame:
    """(fp, cell): the cells of the grid with 64 segments of one bit, which are the fingerprint and those one bit away."""
    masks = [0, *((1 << k) - (1 << 64 if k == 63 else 0) for k in range(64))]
    return fps.select("fp", F.explode(F.lit(masks).cast("array<bigint>")).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("cell"))


def linked(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) of fp values within two bits, enough to join all that are connected, as a table of scratch; fps is a written table of distinct fp."""
    spark = fps.sparkSession
    # small tables come back in few tasks, and each row makes 65 cells
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() // FPS_PER_TASK))
    cells = grid_cells(scratch.table(fps.select("fp").repartition(tasks, "fp"), "dealt"))
    # few cells are shared: written, so that Spark sees when they are small enough to be sent to the second pass
    shared = scratch.table(cells.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b").select("cell"), "shared")
    near = scratch.table(cells.join(shared, "cell", "left_semi").select("fp").distinct(), "near")
    met = bit_cells(near).groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.collect_list("fp").alias("all")).filter("low < high")
    return scratch.table(met.select(F.explode("all").alias("a"), F.col("low").alias("b")).filter("a > b").distinct(), "links")


def find_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp, component_id, component_fp): the smallest id linked to each row, and the smallest fingerprint."""
    found = written(fingerprints(docs, key, text, shingle, seed), "simhash")
    with Scratch(docs.sparkSession, "simhash") as scratch:
        firsts = scratch.table(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
        roots = components(linked(firsts.select("fp"), scratch)).select(F.col("node").alias("fp"), "root")
        rooted = scratch.table(firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
        ids = scratch.table(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "ids")
        named = written(rooted.join(ids, "root").select("fp", "component_id", F.col("root").alias("component_fp")), "simhash-named")
    return found.join(named, "fp").select("doc_id", "text_key", "fp", "component_id", "component_fp")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id (of repeated rows with it one; of different texts with it, or without any id, the one of the smallest fingerprint and text hash)."""
    chosen = (
        find_components(docs, key, text)
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component_fp")
        .agg(F.min(F.struct("fp", "text_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null")).alias("id"))).alias("row"))
        .select(F.col("row.id").alias("_id"), F.col("row.text_key").alias("_tk"))
    )
    return one_row_each(docs, chosen, key, text)
