"""The clean transcript: turns over segments, raw fallbacks, highlight taps, chapters, and audits against the source.

Draft turns: meeting_id, turn_ix, source_ids (array), speaker, text. Segments:
meeting_id, ord, seg_id, speaker, start_time, end_time, text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .intervals import as_of

RAW_FALLBACK, RAW_GROUNDED = "raw-fallback", "raw-grounded"
OPENING = "Inicio"
#: Stretches of a meeting that one task merges, so that a very long one is spread.
AS_OF_SECONDS = 600.0


def _sorted_field(column: str, *order: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, column))), lambda x: x[column])


def build_clean(draft: DataFrame, segments: DataFrame) -> DataFrame:
    """meeting_id, ord, id (T1, T2, ...), source_ids, speaker, text, start_time, end_time, tags.

    A segment goes to the first draft turn that names it; turns left without a
    segment go, and segments that no turn names become turns of their own.
    """
    named = draft.select("meeting_id", "turn_ix", "speaker", "text", F.posexplode("source_ids").alias("pos", "seg_id"))
    known = named.join(segments.select("meeting_id", "seg_id", "start_time", "end_time"), ["meeting_id", "seg_id"])
    first = Window.partitionBy("meeting_id", "seg_id").orderBy("turn_ix", "pos")
    used = known.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    turns = used.groupBy("meeting_id", "turn_ix").agg(
        _sorted_field("seg_id", "pos").alias("source_ids"), F.first("speaker").alias("speaker"), F.first("text").alias("text"),
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
    )
    turns = turns.withColumn("tags", F.array().cast("array<string>")).withColumn("_proto", F.struct(F.lit(0).alias("k"), F.col("turn_ix").cast("long").alias("i"))).drop("turn_ix")
    left = segments.join(used.select("meeting_id", "seg_id"), ["meeting_id", "seg_id"], "left_anti").select(
        "meeting_id", F.array("seg_id").alias("source_ids"), "speaker", "text", "start_time", "end_time", F.array(F.lit(RAW_FALLBACK)).alias("tags"),
        F.struct(F.lit(1).alias("k"), F.col("ord").cast("long").alias("i")).alias("_proto"),
    )
    order = F.row_number().over(Window.partitionBy("meeting_id").orderBy("start_time", "_proto"))
    return turns.unionByName(left).withColumn("ord", order).select(
        "meeting_id", "ord", F.concat(F.lit("T"), F.col("ord")).alias("id"), "source_ids", "speaker", "text", "start_time", "end_time", "tags"
    )


def apply_taps(turns: DataFrame, taps: DataFrame) -> DataFrame:
    """turns with each tap's tag on the last turn that starts at or before it, or on the first turn; taps: meeting_id, ord, t, tag."""
    found = as_of(taps, turns.select("meeting_id", "start_time", F.col("ord").alias("turn_ord")), ["meeting_id"], "t", "start_time", "turn_ord", ["turn_ord"], AS_OF_SECONDS)
    firsts = turns.groupBy("meeting_id").agg(F.min("ord").alias("_first"))
    placed = found.join(firsts, "meeting_id").select("meeting_id", F.coalesce("match.turn_ord", "_first").alias("turn_ord"), F.col("ord").alias("tap"), "tag")
    tags = placed.groupBy("meeting_id", F.col("turn_ord").alias("ord")).agg(_sorted_field("tag", "tap").alias("_tags"))
    joined = turns.join(tags, ["meeting_id", "ord"], "left")
    return joined.withColumn("tags", F.when(F.col("_tags").isNull(), F.col("tags")).otherwise(F.array_union("tags", "_tags"))).select(*turns.columns)


def with_chapters(turns: DataFrame, chapters: DataFrame) -> DataFrame:
    """turns with chapter_ix and chapter_title of the last chapter that starts at or before each (0 and the opening title before the first)."""
    w = Window.partitionBy("meeting_id").orderBy("start_time", "ord")
    numbered = chapters.withColumn("chapter_ix", F.row_number().over(w)).select("meeting_id", F.col("start_time").alias("chapter_start"), "chapter_ix", F.col("title").alias("chapter_title"))
    found = as_of(turns, numbered, ["meeting_id"], "start_time", "chapter_start", "chapter_ix", ["chapter_ix", "chapter_title"], AS_OF_SECONDS)
    return found.select(*turns.columns, F.coalesce("match.chapter_ix", F.lit(0)).alias("chapter_ix"), F.coalesce("match.chapter_title", F.lit(OPENING)).alias("chapter_title"))


def interleave(turns: DataFrame, chapters: DataFrame) -> DataFrame:
    """meeting_id, line_ix, kind, text: chapter lines before the turns that start at or after them, trailing chapters last."""
    c = chapters.select("meeting_id", F.col("start_time").alias("at"), F.lit(0).alias("k"), "ord", F.lit("chapter").alias("kind"), F.col("title").alias("text"))
    t = turns.select("meeting_id", F.col("start_time").alias("at"), F.lit(1).alias("k"), "ord", F.lit("turn").alias("kind"), F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("speaker"), F.lit(": "), F.col("text")).alias("text"))
    w = Window.partitionBy("meeting_id").orderBy("at", "k", "ord")
    return c.unionByName(t).withColumn("line_ix", F.row_number().over(w)).select("meeting_id", "line_ix", "kind", "text")


def raw_texts(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """meeting_id, ord, raw: the texts of each turn's source segments, joined by spaces."""
    sources = turns.select("meeting_id", "ord", F.posexplode("source_ids").alias("pos", "seg_id")).join(segments.select("meeting_id", "seg_id", F.col("text").alias("raw")), ["meeting_id", "seg_id"])
    return sources.groupBy("meeting_id", "ord").agg(F.array_join(_sorted_field("raw", "pos"), " ").alias("raw"))


def audit_turns(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """turns with raw, audit (struct) and violated."""
    found = turns.join(raw_texts(turns, segments), ["meeting_id", "ord"], "left").withColumn("raw", F.coalesce("raw", F.lit("")))
    return found.withColumn("audit", tx.audit("raw", "text")).withColumn("violated", tx.violated(F.col("audit")))


def audit_totals(audited: DataFrame) -> DataFrame:
    bad = audited.withColumn("numbers", F.size("audit.missing_numbers") + F.size("audit.introduced_numbers")).withColumn("negations", F.size("audit.negation_flips"))
    return bad.groupBy("meeting_id").agg(F.sum("numbers").alias("number_mismatches"), F.sum("negations").alias("negation_mismatches"), F.count_if("violated").alias("violations"))


def ground_violations(audited: DataFrame) -> DataFrame:
    """Turns with the raw text back where the rewrite broke an invariant, tagged so."""
    text = F.when(F.col("violated"), F.col("raw")).otherwise(F.col("text"))
    tags = F.when(F.col("violated"), F.array_union("tags", F.array(F.lit(RAW_GROUNDED)))).otherwise(F.col("tags"))
    return audited.withColumns({"text": text, "tags": tags}).drop("raw", "audit", "violated")


def canonical_turns(clean: DataFrame, segments: DataFrame) -> DataFrame:
    """Clean turns, or the raw segments of meetings that have none: meeting_id, ord, id, speaker, start_time, end_time, text."""
    columns = ["meeting_id", "ord", "id", "speaker", "start_time", "end_time", "text"]
    raw = segments.join(clean.select("meeting_id").distinct(), "meeting_id", "left_anti").withColumn("id", F.coalesce("seg_id", F.concat(F.lit("T"), F.col("ord") + 1)))
    return clean.select(columns).unionByName(raw.select(columns))
