"""Who spoke: votes of the active-speaker readings and anchors of captions, per segment.

Segments: meeting_id, ord, source (mic, tab, caption), label, start_time,
end_time, text, confidence. Readings: meeting_id, ord, t, name. Captions:
meeting_id, ord, t, speaker_name, text, final.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .intervals import BUCKET_SECONDS, band_join, overlap_by_name, speaking_intervals

UNKNOWN = "Unknown"
CAPTION_SLACK = 5.0
CAPTION_LEAST = 0.5
CAPTION_TOKENS = 3
VOTE_WINDOW = 30.0


def _ranked(tally: DataFrame, group: list[str], score: str, first: list[str]) -> DataFrame:
    """group, name, top, second, total of the highest score; ties go to the earliest first appearance."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), *first)
    numbered = tally.withColumn("_n", F.row_number().over(w))
    return numbered.groupBy(*group).agg(
        F.max(F.when(F.col("_n") == 1, F.col("name"))).alias("name"),
        F.max(F.when(F.col("_n") == 1, F.col(score))).alias("top"),
        F.coalesce(F.max(F.when(F.col("_n") == 2, F.col(score))), F.lit(0.0)).alias("second"),
        F.sum(score).alias("total"),
    )


def global_vote(segments: DataFrame, readings: DataFrame, local_user: str) -> DataFrame:
    """segments with speaker and resolved: each label gets the name with most seconds over the whole meeting."""
    spoken = segments.filter("source <> 'mic'")
    seconds = overlap_by_name(spoken, speaking_intervals(readings)).join(spoken.select("meeting_id", "ord", "label"), ["meeting_id", "ord"])
    tally = seconds.groupBy("meeting_id", "label", "name").agg(F.sum("overlap").alias("score"), F.min(F.struct("ord", "first")).alias("_first"))
    winners = _ranked(tally, ["meeting_id", "label"], "score", ["_first"]).select("meeting_id", "label", F.col("name").alias("winner"))
    mic = F.col("source") == "mic"
    return segments.join(winners, ["meeting_id", "label"], "left").select(
        *segments.columns,
        F.when(mic, F.lit(local_user)).otherwise(F.coalesce("winner", "label")).alias("speaker"),
        (mic | F.col("winner").isNotNull()).alias("resolved"),
    )


def windowed_vote(segments: DataFrame, readings: DataFrame, window: float = VOTE_WINDOW) -> DataFrame:
    """meeting_id, ord, name, share, margin: each tab segment's label voted over the tab segments with it that meet the window around it.

    Seconds by name are counted once for each voter; a voter that meets the
    window counts whole.
    """
    tab = segments.filter("source = 'tab'")
    seconds = overlap_by_name(tab, speaking_intervals(readings))
    voters = tab.select("meeting_id", "label", F.col("ord").alias("voter"), F.col("start_time").alias("v0"), F.col("end_time").alias("v1"))
    pairs = band_join(
        tab.select("meeting_id", "label", "ord", "start_time", "end_time"), voters, ["meeting_id", "label"],
        (F.col("start_time") - window, F.col("end_time") + window), (F.col("v0"), F.col("v1")),
        (F.col("v1") >= F.col("start_time") - window) & (F.col("v0") <= F.col("end_time") + window), 4 * window,
    ).select("meeting_id", "ord", "voter")
    votes = pairs.join(seconds.withColumnRenamed("ord", "voter"), ["meeting_id", "voter"])
    tally = votes.groupBy("meeting_id", "ord", "name").agg(F.sum("overlap").alias("score"), F.min(F.struct("voter", "first")).alias("_first"))
    best = _ranked(tally, ["meeting_id", "ord"], "score", ["_first"])
    return best.select("meeting_id", "ord", "name", (F.col("top") / F.col("total")).alias("share"), ((F.col("top") - F.col("second")) / F.col("total")).alias("margin"))


def caption_anchor(segments: DataFrame, captions: DataFrame) -> DataFrame:
    """meeting_id, ord, name, score, margin: the speaker of the captions near in time whose text overlaps the tab segment's best."""
    usable = captions.filter(F.col("final") & (F.col("speaker_name") != UNKNOWN)).withColumn("caption_tokens", tx.tokens("text")).filter(F.size("caption_tokens") >= CAPTION_TOKENS)
    usable = usable.select("meeting_id", F.col("ord").alias("caption"), "t", F.col("speaker_name").alias("name"), "caption_tokens")
    tab = segments.filter("source = 'tab'").select("meeting_id", "ord", "start_time", "end_time", tx.tokens("text").alias("segment_tokens"))
    low, high = F.col("start_time") - CAPTION_SLACK, F.col("end_time") + CAPTION_SLACK
    pairs = band_join(tab, usable, ["meeting_id"], (low, high), (F.col("t"), F.col("t")), (F.col("t") >= low) & (F.col("t") <= high), BUCKET_SECONDS)
    # texts without a common token score 0 and don't leave the JVM
    met = pairs.filter(F.arrays_overlap("caption_tokens", "segment_tokens"))
    scored = met.select("meeting_id", "ord", "name", "caption", tx.sliding_overlap("caption_tokens", "segment_tokens").alias("score")).filter("score > 0")
    per_name = scored.groupBy("meeting_id", "ord", "name").agg(F.max("score").alias("score"), F.min("caption").alias("_first"))
    best = _ranked(per_name, ["meeting_id", "ord"], "score", ["_first"]).filter(F.col("top") >= CAPTION_LEAST)
    return best.select("meeting_id", "ord", "name", F.col("top").alias("score"), (F.col("top") - F.col("second")).alias("margin"))


def correlate(segments: DataFrame, readings: DataFrame, captions: DataFrame, local_user: str) -> DataFrame:
    """Segments with seg_id, speaker, resolved, speaker_confidence, label_margin, label_source, and agrees (anchor and vote name the same; null unless both exist)."""
    vote = windowed_vote(segments, readings).select("meeting_id", "ord", F.col("name").alias("vote"), "share", F.col("margin").alias("vote_margin"))
    anchor = caption_anchor(segments, captions).select("meeting_id", "ord", F.col("name").alias("anchor"), "score", F.col("margin").alias("anchor_margin"))
    rows = segments.join(anchor, ["meeting_id", "ord"], "left").join(vote, ["meeting_id", "ord"], "left")
    mic, cap = F.col("source") == "mic", F.col("source") == "caption"
    anchored, voted = F.col("anchor").isNotNull(), F.col("vote").isNotNull()

    def routed(of_mic, of_caption, of_anchor, of_vote, of_none):
        return F.when(mic, of_mic).when(cap, of_caption).when(anchored, of_anchor).when(voted, of_vote).otherwise(of_none)

    one, zero = F.lit(1.0), F.lit(0.0)
    source = routed(F.lit("mic"), F.lit("caption"), F.lit("caption"), F.lit("timeline"), F.lit("unresolved"))
    return rows.select(
        *segments.columns,
        F.concat(F.lit("s"), F.col("ord")).alias("seg_id"),
        routed(F.lit(local_user), F.col("label"), F.col("anchor"), F.col("vote"), F.col("label")).alias("speaker"),
        (source != "unresolved").alias("resolved"),
        routed(one, one, F.col("score"), F.col("share"), zero).alias("speaker_confidence"),
        routed(one, one, F.col("anchor_margin"), F.col("vote_margin"), zero).alias("label_margin"),
        source.alias("label_source"),
        F.when(~mic & ~cap & anchored & voted, F.col("anchor") == F.col("vote")).alias("agrees"),
    )


def correlation_scores(correlated: DataFrame) -> DataFrame:
    """meeting_id, label_margin_min, unresolved_pct, caption_agreement_pct (null where anchor and vote never meet)."""
    judged = (F.col("source") == "tab") & F.col("resolved")
    return correlated.groupBy("meeting_id").agg(
        F.least(F.lit(1.0), F.coalesce(F.min(F.when(judged, F.col("label_margin"))), F.lit(1.0))).alias("label_margin_min"),
        (100 * F.avg((~F.col("resolved")).cast("double"))).alias("unresolved_pct"),
        (100 * F.avg(F.col("agrees").cast("double"))).alias("caption_agreement_pct"),
    )


def repair_targets(correlated: DataFrame, gate_fired: DataFrame, least_margin: float = 0.3) -> DataFrame:
    """meeting_id and seg_ids in order that a repair looks at, where a speaker gate fired."""
    doubtful = correlated.filter((F.col("source") != "mic") & (~F.col("resolved") | (F.col("label_margin") < least_margin)))
    fired = gate_fired.filter("fired").select("meeting_id").distinct()
    listed = doubtful.join(fired, "meeting_id", "left_semi").groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("ord", "seg_id"))).alias("s"))
    return listed.select("meeting_id", F.col("s.seg_id").alias("seg_ids"))


def resolved_speakers(correlated: DataFrame) -> DataFrame:
    """meeting_id and the distinct names of resolved segments in order of first appearance."""
    firsts = correlated.filter("resolved").groupBy("meeting_id", "speaker").agg(F.min("ord").alias("first"))
    return firsts.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("first", "speaker"))).alias("s")).select("meeting_id", F.col("s.speaker").alias("speakers"))


def roster(correlated: DataFrame, participants: DataFrame) -> DataFrame:
    """meeting_id and speakers united with the participants' names (array column names)."""
    found = resolved_speakers(correlated).join(participants, "meeting_id", "full")
    none = F.array().cast("array<string>")
    return found.select("meeting_id", F.array_union(F.coalesce("speakers", none), F.coalesce("names", none)).alias("names"))
