"""Talk time, list filters, overlays, numbering and other analytics over turns and meetings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as v

#: Words per second that stand for a missing end.
WORDS_PER_SECOND = 2.5
DOMINANT_PCT = 60.0
PATCH_TTL = 120.0


def talk_time(turns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, speaker, seconds, words, turns, pct of the key's seconds, rank (by seconds, then first appearance), dominant (first and over 60 %).

    turns: keys, ord, speaker, start_time, end_time, text.
    """
    keys = ["meeting_id"] if keys is None else keys
    n = tx.word_count("text")
    length = F.when(F.col("end_time").isNotNull(), F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time"))).otherwise(n / WORDS_PER_SECOND)
    per = turns.groupBy(*keys, "speaker").agg(F.sum(length).alias("seconds"), F.sum(n).alias("words"), F.count("*").alias("turns"), F.min("ord").alias("_first"))
    total = F.sum("seconds").over(Window.partitionBy(*keys))
    pct = F.when(total > 0, 100 * F.col("seconds") / total).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("seconds").desc(), "_first"))
    return per.withColumn("pct", pct).withColumn("rank", rank).withColumn("dominant", (F.col("rank") == 1) & (F.col("pct") > DOMINANT_PCT)).drop("_first")


def session_totals(turns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, words, talk_seconds, speakers, duration, turns."""
    keys = ["meeting_id"] if keys is None else keys
    n = tx.word_count("text")
    length = F.when(F.col("end_time").isNotNull(), F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time"))).otherwise(n / WORDS_PER_SECOND)
    return turns.groupBy(*keys).agg(
        F.sum(n).alias("words"), F.sum(length).alias("talk_seconds"), F.countDistinct("speaker").alias("speakers"),
        (F.max("end_time") - F.min("start_time")).alias("duration"), F.count("*").alias("turns"),
    )


def label_usage(overrides: DataFrame, column: str = "labels") -> DataFrame:
    return overrides.select(F.explode(column).alias("label")).groupBy("label").agg(F.count("*").alias("uses"))


def rename_label(overrides: DataFrame, old: str, new: str | None, column: str = "labels") -> DataFrame:
    """A label renamed in, or (new None) taken out of, every array."""
    changed = F.array_remove(column, old) if new is None else v.renamed(F.col(column), F.lit(old), F.lit(new))
    return overrides.withColumn(column, changed)


def participants(meetings: DataFrame, column: str = "participants", collation: str | None = "es", keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct names in the order of a language; with keys, those of each key with their place (from 1)."""
    names = meetings.select(*keys, F.explode(column).alias("name")).distinct()
    order = [F.collate("name", collation) if collation else F.lower("name"), F.col("name")]
    return names.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))) if keys else names.orderBy(*order)


def filter_meetings(
    meetings: DataFrame,
    query: str = "",
    first_day: str | None = None,
    last_day: str | None = None,
    people: list[str] | None = None,
    labels: list[str] | None = None,
    statuses: list[str] | None = None,
    ts: str = "started_at",
) -> DataFrame:
    """meetings (title, participants, labels, status, removed, started_at) that pass every filter that is given."""
    out = meetings.filter(~F.coalesce("removed", F.lit(False)))
    if query.strip():
        hay = tx.fold(F.lower(F.concat_ws(" ", "title", F.array_join("participants", " "))))
        out = out.filter(F.contains(hay, tx.fold(F.lower(F.lit(query.strip())))))
    if first_day:
        out = out.filter(v.in_days(F.col(ts), F.lit(first_day).cast("timestamp"), F.lit(last_day).cast("timestamp")))
    if people:
        out = out.filter(F.arrays_overlap("participants", F.lit(people)))
    if labels:
        out = out.filter(F.arrays_overlap("labels", F.lit(labels)))
    if statuses:
        out = out.filter(F.col("status").isin(*statuses))
    return out


def patched_status(meetings: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """meetings with a fresh patch's status shown over ready and needs_review. patches: meeting_id, patch_status, patched_at (seconds)."""
    fresh = (now - F.col("patched_at") < PATCH_TTL) & F.col("status").isin("ready", "needs_review")
    joined = meetings.join(patches, "meeting_id", "left")
    return joined.withColumn("status", F.when(fresh, F.col("patch_status")).otherwise(F.col("status"))).select(*meetings.columns)


def tagged(turns: DataFrame, tags: list[str]) -> DataFrame:
    return turns.filter(F.arrays_overlap("tags", F.lit(tags))) if tags else turns


def overlay(turns: DataFrame, patches: DataFrame) -> DataFrame:
    """turns with patches by stable id: deleted ones go, texts and tags are replaced, edited marks those with a new text. patches: meeting_id, id, new_text, new_tags, deleted."""
    joined = turns.join(patches, ["meeting_id", "id"], "left").filter(~F.coalesce("deleted", F.lit(False)))
    return joined.select(
        *(c for c in turns.columns if c not in ("text", "tags")), F.coalesce("new_text", "text").alias("text"), F.coalesce("new_tags", "tags").alias("tags"),
        F.col("new_text").isNotNull().alias("edited"),
    )


def colour_index(turns: DataFrame, colours: int = 5, keys: list[str] | None = None) -> DataFrame:
    """keys, speaker, colour: by order of first appearance, around the colours."""
    keys = ["meeting_id"] if keys is None else keys
    firsts = turns.groupBy(*keys, "speaker").agg(F.min("ord").alias("first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1
    return firsts.select(*keys, "speaker", F.pmod(place, F.lit(colours)).cast("int").alias("colour"))


def find_occurrences(turns: DataFrame, query: str, keys: list[str] | None = None) -> DataFrame:
    """keys, match_ix (from 0 over the meeting), ord, occurrence: each place of the query in the turns, in order."""
    keys = ["meeting_id"] if keys is None else keys
    n = tx.occurrences("text", F.lit(query))
    rows = turns.select(*keys, "ord", n.alias("n")).filter("n > 0").select(*keys, "ord", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("occurrence"))
    w = Window.partitionBy(*keys).orderBy("ord", "occurrence")
    return rows.withColumn("match_ix", F.row_number().over(w) - 1)


def step_match(current: Column, step: int, n: Column) -> Column:
    return F.pmod(current + step, n)


def entry_names(entries: DataFrame, base: str = "base", order: str = "ord", keys: list[str] | None = None) -> DataFrame:
    """entries with name: the base, or with the entry's overall number if the base has come before."""
    keys = keys or []
    seen = F.row_number().over(Window.partitionBy(*keys, base).orderBy(order)) > 1
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) if keys else F.col(order) + 1
    return entries.withColumn("_seen", seen).withColumn("name", F.when(F.col("_seen"), F.concat(base, F.lit("-"), number.cast("string"))).otherwise(F.col(base))).drop("_seen")


def caption_ends(captions: DataFrame, keys: list[str] | None = None, least: float = 0.2) -> DataFrame:
    """captions (keys, ord, t, text) with end_time: the next caption's time, for the last one a reading time; at least ``least`` after t."""
    keys = ["meeting_id"] if keys is None else keys
    after = F.lead("t").over(Window.partitionBy(*keys).orderBy("t", "ord"))
    reading = F.col("t") + F.greatest(F.lit(1.5), 0.35 * tx.word_count("text"))
    return captions.withColumn("end_time", F.greatest(F.coalesce(after, reading), F.col("t") + least))


def any_capturing(meetings: DataFrame) -> DataFrame:
    """One row: whether a meeting is being captured."""
    return meetings.agg(F.coalesce(F.bool_or(F.col("status") == "capturing"), F.lit(False)).alias("any_capturing"))


def recent(rows: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return rows.orderBy(F.col(by).desc(), F.col(tie)).limit(n)


def history_window(messages: DataFrame, n: int = 8, keys: list[str] | None = None) -> DataFrame:
    """The last n messages of each thread, in order."""
    keys = ["thread_id"] if keys is None else keys
    w = Window.partitionBy(*keys).orderBy(F.col("ord").desc())
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def orphans(captures: DataFrame, active: DataFrame, finalizing: DataFrame) -> DataFrame:
    """Captures with data that are neither active nor being finalised (capture_id, segments, captions arrays)."""
    filled = (F.coalesce(F.size("segments"), F.lit(0)) > 0) | (F.coalesce(F.size("captions"), F.lit(0)) > 0)
    return captures.filter(filled).join(active, "capture_id", "left_anti").join(finalizing, "capture_id", "left_anti")


def audio_declaration(sources: Column, seconds: Column, known: tuple[str, ...] = ("tab", "mic")) -> Column:
    """struct of the declared sources that are known, in the order of the known ones, and the duration between 0 and a day (0 if it isn't a number)."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(float("inf")))
    return F.struct(
        F.array_intersect(F.lit(list(known)), F.coalesce(sources, F.array().cast("array<string>"))).alias("sources"),
        F.when(finite, v.clamp(v.round_half_up(seconds), 0, 86400)).otherwise(0).cast("long").alias("duration_sec"),
    )


def route_question(has_artifacts: Column, sufficient: Column) -> Column:
    return F.when(~has_artifacts, "legacy").when(sufficient, "summary").otherwise("transcript")


def thread_guard(message: Column, messages: Column, most_chars: int = 4000, most_messages: int = 40) -> Column:
    """'ok', 'too long' or 'full'."""
    return F.when(F.length(message) > most_chars, "too long").when(messages > most_messages, "full").otherwise("ok")


def note_guard(raw: Column, source: Column, sources: tuple[str, ...] = ("typed", "voice"), most_chars: int = 20_000) -> Column:
    return F.when(F.length(tx.strip(raw)) == 0, "empty").when(F.length(raw) > most_chars, "too long").when(~source.isin(*sources), "unknown source").otherwise("ok")


def tenant_of(claim: Column, subject: Column) -> Column:
    return F.coalesce(F.nullif(claim, F.lit("")), subject)


def groups_of(claim: Column) -> Column:
    """Group names from a bracketed, comma- or space-separated claim."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(claim, F.lit("")), r"[\[\]]", ""), r"[,\s]+"), lambda g: g != "")


def recall_report(truth: DataFrame, stages: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row of line_recall and word_recall; lines and words lost by first failing stage). truth: text and a boolean for each stage in order."""
    lost = F.lit(None).cast("string")
    for stage in reversed(stages):
        lost = F.when(~F.col(stage), F.lit(stage)).otherwise(lost)
    rows = truth.select(lost.alias("stage"), tx.word_count(tx.comparable("text")).alias("words"))
    kept = F.col("stage").isNull()
    overall = rows.agg(F.avg(kept.cast("double")).alias("line_recall"), (F.sum(F.when(kept, F.col("words")).otherwise(0)) / F.sum("words")).alias("word_recall"))
    return overall, rows.filter(~kept).groupBy("stage").agg(F.count("*").alias("lines"), F.sum("words").alias("words"))


def _closest(truth: DataFrame, emitted: list[DataFrame], least: float, keys: list[str]) -> DataFrame:
    """truth with _best0, _best1, ...: the highest sequence ratio to any line of each of the emitted tables in the meeting, 0 below least."""
    from ..functions.models import sequence_ratio

    form = lambda rows, name: rows.withColumn(name, F.lower(tx.comparable("text")))
    said = form(truth, "_said")
    # a line is compared once for all tables that hold it; tables are bits
    lines = None
    for k, rows in enumerate(emitted):
        part = form(rows, "shown").select(*keys, "shown", F.lit(1 << k).alias("bit"))
        lines = part if lines is None else lines.unionAll(part)
    shown = lines.filter("shown <> ''").groupBy(*keys, "shown").agg(F.bit_or("bit").alias("held"))
    texts = said.select(*keys, "_said").filter("_said <> ''").distinct()
    texts = texts.join(shown.select(*keys, F.col("shown").alias("_said"), F.col("held").alias("equal")), [*keys, "_said"], "left").withColumn("equal", F.coalesce("equal", F.lit(0)))
    x, y = F.length("_said"), F.length("shown")
    left = F.col("held").bitwiseAND(F.bitwise_not("equal"))
    open_ = texts.filter(F.col("equal") != (1 << len(emitted)) - 1)
    pairs = open_.join(shown, keys).filter(2 * F.least(x, y) >= least * (x + y)).filter(left != 0)
    # comparisons cost far more than their bytes tell: they are dealt over all cores by number, which Spark doesn't merge
    spark = truth.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    pairs = pairs.repartition(parts, "_said", "shown")
    ratios = pairs.withColumn("_ratio", sequence_ratio("_said", "shown", least))
    bit = lambda k, c: F.col(c).bitwiseAND(F.lit(1 << k)) != 0
    best = ratios.groupBy(*keys, "_said").agg(*(F.max(F.when(bit(k, "held"), F.col("_ratio"))).alias(f"_best{k}") for k in range(len(emitted))))
    joined = said.join(texts, [*keys, "_said"], "left").join(best, [*keys, "_said"], "left")
    found = {f"_best{k}": F.when(bit(k, "equal"), 1.0).when(F.col(f"_best{k}") >= least, F.col(f"_best{k}")).otherwise(0.0) for k in range(len(emitted))}
    return joined.withColumns(found).drop("_said", "equal")


def align_recall(truth: DataFrame, emitted: DataFrame, least: float = 0.6, keys: list[str] | None = None) -> DataFrame:
    """truth (keys, ord, text) with best and found: the highest sequence ratio to any line emitted in the meeting.

    Texts are compared in lower case, white space collapsed and end punctuation off. Equal texts are found by
    a join of their own and go no further; of the rest, each text is compared once however often it stands,
    and only with those that can reach ``least``: the ratio is at most twice the shorter length over both
    lengths, and a comparison ends where what is left to match is too little. ``best`` is exact from
    ``least`` up, and 0 below.
    """
    out = _closest(truth, [emitted], least, ["meeting_id"] if keys is None else keys)
    return out.withColumnRenamed("_best0", "best").withColumn("found", F.col("best") >= least)


#: Where a line is lost, in the order of the stages; a line that is lost nowhere before is lost in the last.
LOSSES = ("SOURCE", "ROOT_GATE", "EXTRACTION", "PIPELINE")


def attribute_losses(truth: DataFrame, emitted: DataFrame, stages: list[DataFrame], least: float = 0.6, keys: list[str] | None = None) -> DataFrame:
    """truth (keys, ord, text) with stage: 'MATCHED' where a line like it was emitted, else the first stage whose lines hold none like it.

    stages: the lines (keys, text) there were at the source, past the gate of the root, and extracted.
    """
    out = _closest(truth, [emitted, *stages], least, ["meeting_id"] if keys is None else keys)
    stage = F.when(F.col("_best0") >= least, "MATCHED")
    for k, name in enumerate(LOSSES[:-1], 1):
        stage = stage.when(F.col(f"_best{k}") < least, name)
    return out.withColumn("stage", stage.otherwise(LOSSES[-1])).drop(*(f"_best{k}" for k in range(len(stages) + 1)))


def loss_report(attributed: DataFrame) -> DataFrame:
    """stage, lines, words (of comparable texts): how many lines went where."""
    return attributed.groupBy("stage").agg(F.count("*").alias("lines"), F.sum(tx.word_count(tx.comparable("text"))).alias("words"))


def dictation_text(results: DataFrame) -> DataFrame:
    """session_id, text: the final results of a dictation (session_id, ord, final, text) in order; partial ones are left out."""
    rows = results.filter("final").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("r"))
    return rows.select("session_id", F.array_join("r.text", " ").alias("text"))
