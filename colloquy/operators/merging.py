"""From recogniser items to words and segments, and the merge of a second transcript into the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands, max_overlap, nearest_gap

SEGMENT_GAP = 0.8
SEGMENT_WORDS = 20
MERGE_SLACK = 2.0
SENTENCE_END = r"[.?!…]$"
#: Items that one task sorts, on average.
ITEMS_PER_TASK = 500_000


def _dealt(items: DataFrame) -> DataFrame:
    """The items of a meeting in one task, in so many tasks that what each sorts doesn't grow with the table."""
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // ITEMS_PER_TASK))
    return items.repartition(tasks, "meeting_id")


def words_of_items(items: DataFrame) -> DataFrame:
    """items (meeting_id, ord, type, start_time, end_time, content, confidence) to words (meeting_id, ord from 1, start_time, end_time, text, confidence): punctuation goes to the word before it."""
    is_word = (F.col("type") != "punctuation") & (F.coalesce("content", F.lit("")) != "") & F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    kept = items.filter((F.col("type") == "punctuation") | is_word).withColumn("_word", is_word)
    numbered = islands(_dealt(kept), ["meeting_id"], ["ord"], F.col("_word")).filter("island > 0")
    parts = numbered.groupBy("meeting_id", "island").agg(
        F.min(F.when(F.col("_word"), F.col("start_time"))).alias("start_time"),
        F.max(F.when(F.col("_word"), F.col("end_time"))).alias("end_time"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "").alias("text"),
        F.coalesce(F.max(F.when(F.col("_word"), F.col("confidence"))), F.lit(0.0)).alias("confidence"),
    )
    return parts.select("meeting_id", F.col("island").alias("ord"), "start_time", "end_time", "text", "confidence")


def segments_of_words(words: DataFrame, gap: float = SEGMENT_GAP, most: int = SEGMENT_WORDS) -> DataFrame:
    """words to segments (meeting_id, ord from 0, start_time, end_time, text, confidence): cut before a long gap, after a sentence end, and after every ``most`` words in between."""
    w = Window.partitionBy("meeting_id").orderBy("ord")
    ended = F.lag(F.col("text").rlike(SENTENCE_END)).over(w)
    far = F.col("start_time") - F.lag("end_time").over(w) > gap
    numbered = words.withColumns({"_break": F.coalesce(ended, F.lit(False)) | F.coalesce(far, F.lit(False)), "_n": F.row_number().over(w)})
    hard = islands(numbered, ["meeting_id"], ["ord"], F.col("_break"))
    # where the island began, in the order that the rows have already
    begun = F.max(F.when(F.col("_break"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    capped = hard.withColumn("part", F.floor((F.col("_n") - F.coalesce(begun, F.lit(1))) / most))
    built = capped.groupBy("meeting_id", "island", "part").agg(
        F.min("ord").alias("_first"),
        F.min_by("start_time", "ord").alias("start_time"),
        F.max_by("end_time", "ord").alias("end_time"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.avg("confidence").alias("confidence"),
    )
    order = F.row_number().over(Window.partitionBy("meeting_id").orderBy("_first")) - 1
    return built.select("meeting_id", order.alias("ord"), "start_time", "end_time", "text", "confidence")


def assign(batch: DataFrame, streaming: DataFrame, slack: float = MERGE_SLACK) -> DataFrame:
    """meeting_id, probe (batch ord), target (tab segment ord): by greatest overlap, else by the nearest gap below the slack."""
    tab = streaming.filter("source = 'tab'")
    over = max_overlap(batch, tab).select("meeting_id", "probe", "target")
    rest = batch.join(over.select("meeting_id", F.col("probe").alias("ord")), ["meeting_id", "ord"], "left_anti")
    return over.unionByName(nearest_gap(rest, tab, slack).select("meeting_id", "probe", "target"))


def merge_transcripts(streaming: DataFrame, batch: DataFrame, slack: float = MERGE_SLACK) -> DataFrame:
    """streaming with text and confidence of the batch segments assigned to each, and provenance; order and number of rows stay."""
    hits = assign(batch, streaming, slack).join(batch.withColumnRenamed("ord", "probe"), ["meeting_id", "probe"])
    joined = hits.groupBy("meeting_id", F.col("target").alias("ord")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_time", "probe", "text"))), lambda x: x["text"]), " ").alias("_text"),
        F.avg("confidence").alias("_confidence"),
    )
    found = F.col("_text").isNotNull()
    return streaming.join(joined, ["meeting_id", "ord"], "left").select(
        *(c for c in streaming.columns if c not in ("text", "confidence")),
        F.coalesce("_text", "text").alias("text"),
        F.when(found, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(found, "batch").otherwise("streaming").alias("provenance"),
    )


def batch_fraction(merged: DataFrame) -> DataFrame:
    return merged.groupBy("meeting_id").agg(F.avg((F.col("provenance") == "batch").cast("double")).alias("batch_fraction"))
