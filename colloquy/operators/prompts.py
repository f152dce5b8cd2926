"""Transcripts, search hits and conversations as the text that a language model reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as v
from .analytics import history_window

HISTORY = 8


def _joined(rows: DataFrame, key: str, line: Column, *order: str, by: str = "\n") -> DataFrame:
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("l"))
    return listed.select(key, F.array_join(F.col("l.line"), by).alias("text"))


def raw_transcript(segments: DataFrame) -> DataFrame:
    """meeting_id, text: '[s3] [mm:ss] speaker: text' for each segment (ord, seg_id, speaker, start_time, text)."""
    line = F.concat(F.lit("["), "seg_id", F.lit("] ["), v.mmss(F.col("start_time")), F.lit("] "), "speaker", F.lit(": "), "text")
    return _joined(segments, "meeting_id", line, "ord")


def clean_transcript(turns: DataFrame, chapters: DataFrame) -> DataFrame:
    """meeting_id, text: turns in their order, '## [mm:ss] title' before the first turn that starts at or after each chapter; later chapters last."""
    from pyspark.sql import Window

    t = turns.select("meeting_id", "ord", "start_time", F.concat(F.lit("["), "id", F.lit("] ["), v.mmss(F.col("start_time")), F.lit("] "), "speaker", F.lit(": "), "text").alias("line"))
    # turns may start out of order; a chapter stands before the first turn in order that has reached it
    reached = F.max("start_time").over(Window.partitionBy("meeting_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = t.select("meeting_id", reached.alias("at"), F.lit(1).alias("k"), F.col("ord").cast("long").alias("o"), "line")
    c = chapters.select("meeting_id", F.col("start_time").alias("at"), F.lit(0).alias("k"), F.col("ord").cast("long").alias("o"), F.concat(F.lit("## ["), v.mmss(F.col("start_time")), F.lit("] "), "title").alias("line"))
    return _joined(at.unionByName(c), "meeting_id", F.col("line"), "at", "k", "o")


def conversation(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """thread_id, text: the last n messages (thread_id, ord, role, text) with who said them."""
    line = F.concat(F.when(F.col("role") == "user", "Usuario").otherwise("Asistente"), F.lit(": "), "text")
    return _joined(history_window(messages, n), "thread_id", line, "ord")


def fragments(hits: DataFrame) -> DataFrame:
    """query_id, text: search hits (query_id, rank, type, meeting_id, turn_start, note_id, date_epoch, text) under their references."""
    ref = tx.reference_of(F.col("type"), F.col("meeting_id"), F.col("turn_start"), F.col("note_id"))
    day = F.date_format(F.timestamp_seconds("date_epoch"), "yyyy-MM-dd")
    part = F.concat(F.lit("--- Fragmento "), ref, F.lit(" ("), "type", F.lit(", "), day, F.lit(") ---\n"), F.coalesce("text", F.lit("")))
    return _joined(hits, "query_id", part, "rank", by="\n\n")
