"""Sharding by rendezvous hashing over weighted shards.

Every record key draws, for each shard, a number from a hash of key and shard
number; the shard with the smallest ``-ln(u) / weight`` takes the record. A new
shard only takes records into itself: the draws for the old shards are as
before. Which shard a record goes to depends on its key and the shards alone.

Defined results: a null key is a key like any other (all null keys share a
shard); a null text has size 16 and the CRC of no bytes; repeated rows each get
a slot of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows that one task numbers at most, on average, within one shard.
ROWS_PER_BLOCK = 1 << 17


def _draw(key: Column, shard: Column, weight: Column) -> Column:
    """53 bits of a hash of key and shard as u in (0, 1); the draw is -ln(u) / weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard.cast("int")), 11)
    return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / weight).alias("draw"), shard.cast("int").alias("shard"))


def best_draw(key: Column, weights: Sequence[float]) -> Column:
    """The smallest (draw, shard) of the key; weights are positive, one for each shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    return F.array_min(F.transform(F.lit([float(w) for w in weights]), lambda weight, shard: _draw(text, shard, weight)))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    return best_draw(key, weights)["shard"]


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float],
    key: str = "doc_id",
    text: str = "text",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """key, size, text_crc32, shard, slot (gapless from 0 in each shard) and grown_shard (with one more shard of weight 1).

    Rows that are alike in all of that are counted, and made again from their count, so copies of one row are
    never sorted or dealt to one task. Slots come from counts of (block, shard) pairs and a running sum inside
    each pair, so no task holds a whole shard either; blocks are made from key, size and CRC.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("k"),
        (F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # written, as it is read for its sums, for the counts of blocks and for the rows
    alike = written(rows.groupBy("k", "size", "text_crc32").agg(F.count("*").alias("copies")), "sharding")
    total, most = alike.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    blocks = max(1, -(-total // rows_per_block))
    placed = alike.select(
        "*",
        best_draw(F.col("k"), weights).alias("best"),
        _draw(F.coalesce(F.col("k").cast("string"), F.lit("\0null")), F.lit(len(weights)), F.lit(1.0)).alias("new"),
        F.pmod(F.xxhash64("k", "size", "text_crc32"), F.lit(blocks)).cast("int").alias("block"),
    ).select("*", F.col("best.shard").alias("shard"), F.least("best", "new")["shard"].alias("grown_shard")).drop("best", "new")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("shard", "block").agg(F.sum("copies").alias("n")).select("shard", "block", F.coalesce(before, F.lit(0)).alias("start"))
    upto = F.sum("copies").over(Window.partitionBy("shard", "block").orderBy("k", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1))
    first = placed.withColumn("within", F.coalesce(upto, F.lit(0))).join(starts, ["shard", "block"]).withColumn("first", F.col("start") + F.col("within"))
    # copies in runs of a block's rows; where there are several runs, they are dealt to all tasks
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / rows_per_block))))
    runs = runs.repartition("k", "run") if most > rows_per_block else runs
    own = F.sequence(F.lit(0).cast("long"), F.least(F.lit(rows_per_block), F.col("copies") - F.col("run") * rows_per_block) - 1)
    return runs.withColumn("i", F.explode(own)).select(F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("first") + F.col("run") * rows_per_block + F.col("i")).cast("long").alias("slot"), "grown_shard")
