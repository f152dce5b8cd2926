"""Queries of talk time, speaker attribution, merging and clean transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, intervals, merging, speakers, transcripts
from . import inputs as i
from .inputs import sql

R6 = lambda c: F.round(c, 6).alias(c)


def talk_time(spark, d):
    rows = analytics.talk_time(i.turns(spark, d))
    return rows.select("meeting_id", "speaker", R6("seconds"), "words", "turns", R6("pct"), "rank", "dominant")


TALK = f"""per AS (SELECT meeting_id, speaker, sum(greatest(0, end_time - start_time)) AS seconds, sum(words) AS words, count(*) AS turns, min(ord) AS first
  FROM (SELECT t.*, b.words FROM turns t JOIN base b USING (meeting_id, ord)) GROUP BY ALL),
ranked AS (SELECT *, 100 * seconds / sum(seconds) OVER (PARTITION BY meeting_id) AS pct, row_number() OVER (PARTITION BY meeting_id ORDER BY seconds DESC, first) AS rank FROM per)"""


def session_totals(spark, d):
    rows = analytics.session_totals(i.turns(spark, d))
    return rows.select("meeting_id", "words", R6("talk_seconds"), "speakers", R6("duration"), "turns")


def dominant_speaker(spark, d):
    return analytics.talk_time(i.turns(spark, d)).filter("dominant").select("meeting_id", "speaker", R6("pct"))


def first_appearance(spark, d):
    return analytics.colour_index(i.turns(spark, d))


def occurrence_search(spark, d):
    return analytics.find_occurrences(i.turns(spark, d), "th")


def caption_ends(spark, d):
    return analytics.caption_ends(i.captions(spark, d)).select("meeting_id", "ord", "t", R6("end_time"))


def edge_trigger(spark, d):
    return intervals.edges(i.readings(spark, d), ["meeting_id"], "name", ["t", "ord"]).select("meeting_id", "ord", "t", "name")


def closing_reading(spark, d):
    """Changes of speaker, and one closing reading for each meeting that stopped."""
    changes = intervals.edges(i.readings(spark, d), ["meeting_id"], "name", ["t", "ord"])
    stops = i.turns(spark, d).groupBy("meeting_id").agg((F.max("end_time") + 100).alias("stopped_at")).filter("meeting_id % 3 <> 0")
    return intervals.with_closing(changes, stops, ["meeting_id"], "name", "t")


def speaker_intervals(spark, d):
    return intervals.speaking_intervals(i.readings(spark, d)).select("meeting_id", "ord", "t", "until", "name")


def interval_overlap(spark, d):
    rows = intervals.overlap_by_name(i.segments(spark, d), intervals.speaking_intervals(i.readings(spark, d)))
    return rows.select("meeting_id", "ord", "name", R6("overlap"))


def global_vote(spark, d):
    return speakers.global_vote(i.segments(spark, d), i.readings(spark, d), "me").select("meeting_id", "ord", "speaker", "resolved")


def windowed_vote(spark, d):
    return speakers.windowed_vote(i.segments(spark, d), i.readings(spark, d)).select("meeting_id", "ord", "name", R6("share"), R6("margin"))


def _correlated(spark, d):
    return speakers.correlate(i.segments(spark, d), i.readings(spark, d), i.captions(spark, d), "me")


def caption_anchor(spark, d):
    return speakers.caption_anchor(i.segments(spark, d), i.captions(spark, d)).select("meeting_id", "ord", "name", R6("score"), R6("margin"))


def correlate(spark, d):
    return _correlated(spark, d).select("meeting_id", "ord", "seg_id", "speaker", "resolved", R6("speaker_confidence"), R6("label_margin"), "label_source")


def correlation_scores(spark, d):
    return speakers.correlation_scores(_correlated(spark, d)).select("meeting_id", R6("label_margin_min"), R6("unresolved_pct"), R6("caption_agreement_pct"))


def resolved_speakers(spark, d):
    return speakers.resolved_speakers(_correlated(spark, d)).select("meeting_id", F.array_join("speakers", "|").alias("speakers"))


def max_overlap(spark, d):
    tab = i.segments(spark, d).filter("source = 'tab'")
    return intervals.max_overlap(i.batch_segments(spark, d), tab).select("meeting_id", "probe", "target", R6("overlap"))


def nearest_gap(spark, d):
    tab = i.segments(spark, d).filter("source = 'tab'")
    return intervals.nearest_gap(i.batch_segments(spark, d), tab, 2.0).select("meeting_id", "probe", "target", R6("gap"))


def merge_transcripts(spark, d):
    merged = merging.merge_transcripts(i.segments(spark, d), i.batch_segments(spark, d))
    return merged.select("meeting_id", "ord", "text", R6("confidence"), "provenance")


def batch_fraction(spark, d):
    merged = merging.merge_transcripts(i.segments(spark, d), i.batch_segments(spark, d))
    return merging.batch_fraction(merged).select("meeting_id", R6("batch_fraction"))


def word_segments(spark, d):
    rows = merging.segments_of_words(merging.words_of_items(i.items(spark, d)))
    return rows.select("meeting_id", F.col("ord").cast("long").alias("ord"), "start_time", "end_time", "text", R6("confidence"))


def item_words(spark, d):
    return merging.words_of_items(i.items(spark, d)).select("meeting_id", F.col("ord").cast("long").alias("ord"), "start_time", "end_time", "text", "confidence")


def asof_highlight(spark, d):
    taps = i.base(spark, d).filter("ord % 2 = 1").select("meeting_id", "ord", (F.col("c0") / 100 - 1).alias("t"), F.concat(F.lit("tap"), "ord").alias("tag"))
    rows = transcripts.apply_taps(i.speaker_turns(spark, d), taps)
    return rows.select("meeting_id", "ord", "id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


def _chapters(spark, d):
    return i.base(spark, d).filter("ord % 3 = 1").select("meeting_id", "ord", ((F.col("c0") + 20) / 100).alias("start_time"), F.concat(F.lit("chapter "), "ord").alias("title"))


def asof_chapter(spark, d):
    return transcripts.with_chapters(i.speaker_turns(spark, d), _chapters(spark, d)).select("meeting_id", "ord", "chapter_ix", "chapter_title")


def chapter_lines(spark, d):
    rows = transcripts.interleave(i.speaker_turns(spark, d), _chapters(spark, d))
    return rows.select("meeting_id", "line_ix", "kind", "text")


def _draft(spark, d):
    """A rewrite that joins segments two by two, names some twice and some that don't exist, and forgets each fifth."""
    b = i.base(spark, d)
    ids = F.array(F.concat(F.lit("s"), F.col("ord")), F.concat(F.lit("s"), F.col("ord") + 1), F.lit("s99"))
    return b.filter("ord % 2 = 0 AND ord % 5 <> 4").select("meeting_id", F.col("ord").alias("turn_ix"), ids.alias("source_ids"), F.col("role").alias("speaker"), F.regexp_replace("text", "[0-9]+", "").alias("text"))


def _raw(spark, d):
    return i.segments(spark, d).select("meeting_id", "ord", F.concat(F.lit("s"), "ord").alias("seg_id"), F.col("label").alias("speaker"), "start_time", "end_time", "text")


def clean_transcript(spark, d):
    rows = transcripts.build_clean(_draft(spark, d), _raw(spark, d))
    return rows.select("meeting_id", "ord", "id", F.array_join("source_ids", ",").alias("source_ids"), "speaker", "start_time", "end_time", F.array_join("tags", ",").alias("tags"))


CLEAN = """draft AS (SELECT meeting_id, ord AS turn_ix, role AS speaker, regexp_replace(text, '[0-9]+', '', 'g') AS text, ['s' || ord, 's' || (ord + 1), 's99'] AS ids FROM base WHERE ord % 2 = 0 AND ord % 5 <> 4),
named AS (SELECT meeting_id, turn_ix, pos, ids[pos] AS seg_id, speaker, text FROM (SELECT *, unnest([1, 2, 3]) AS pos FROM draft)),
used AS (SELECT * FROM (SELECT n.*, s.start_time, s.end_time, s.text AS raw, row_number() OVER (PARTITION BY n.meeting_id, n.seg_id ORDER BY turn_ix, pos) AS k FROM named n JOIN segments s ON s.meeting_id = n.meeting_id AND 's' || s.ord = n.seg_id) WHERE k = 1),
proto AS (SELECT meeting_id, 0 AS kind, turn_ix AS ix, string_agg(seg_id, ',' ORDER BY pos) AS source_ids, any_value(speaker) AS speaker, any_value(text) AS text, string_agg(raw, ' ' ORDER BY pos) AS raw, min(start_time) AS start_time, max(end_time) AS end_time, '' AS tags FROM used GROUP BY meeting_id, turn_ix
  UNION ALL SELECT meeting_id, 1, ord, 's' || ord, label, text, text, start_time, end_time, 'raw-fallback' FROM segments s WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.meeting_id = s.meeting_id AND u.seg_id = 's' || s.ord)),
clean AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_time, kind, ix) AS ord FROM proto)"""


def turn_audit(spark, d):
    audited = transcripts.audit_turns(transcripts.build_clean(_draft(spark, d), _raw(spark, d)), _raw(spark, d))
    join = lambda c: F.array_join(F.array_sort(f"audit.{c}"), ",").alias(c)
    return audited.select("meeting_id", "ord", join("missing_numbers"), join("introduced_numbers"), join("negation_flips"), "violated")


def audit_totals(spark, d):
    audited = transcripts.audit_turns(transcripts.build_clean(_draft(spark, d), _raw(spark, d)), _raw(spark, d))
    return transcripts.audit_totals(audited).select("meeting_id", F.col("number_mismatches").cast("long").alias("number_mismatches"), F.col("negation_mismatches").cast("long").alias("negation_mismatches"), "violations")


def raw_grounded(spark, d):
    audited = transcripts.audit_turns(transcripts.build_clean(_draft(spark, d), _raw(spark, d)), _raw(spark, d))
    return transcripts.ground_violations(audited).select("meeting_id", "ord", F.md5("text").alias("text_md5"), F.array_join("tags", ",").alias("tags"))


NUMS = r"list_distinct(list_transform(regexp_extract_all({}, '\d+(?:[.,]\d+)*'), lambda n: regexp_replace(n, '[.,]', '', 'g')))"
NEGS = "list_filter(list_distinct({}), lambda t: list_contains(['no','not','never','nunca','jamas','ni','tampoco','nadie','ninguno','ninguna','nada','sin'], t))"
_EXCEPT = "list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
AUDIT = (
    CLEAN
    + f""", sets AS (SELECT *, {NUMS.format('raw')} AS rn, {NUMS.format('text')} AS cn, {NEGS.format(i.tokens('raw'))} AS rg, {NEGS.format(i.tokens('text'))} AS cg FROM clean),
audit AS (SELECT meeting_id, ord, raw, text, tags, {_EXCEPT.format(a='rn', b='cn')} AS mn, {_EXCEPT.format(a='cn', b='rn')} AS inn,
  list_sort(list_concat({_EXCEPT.format(a='rg', b='cg')}, {_EXCEPT.format(a='cg', b='rg')})) AS nf FROM sets),
judged AS (SELECT *, len(mn) + len(inn) + len(nf) > 0 AS violated FROM audit)"""
)

QUERIES = {f.__name__: f for f in (
    talk_time, session_totals, dominant_speaker, first_appearance, occurrence_search, caption_ends, edge_trigger, closing_reading, speaker_intervals, interval_overlap, global_vote,
    windowed_vote, caption_anchor, correlate, correlation_scores, resolved_speakers, max_overlap, nearest_gap, merge_transcripts, batch_fraction, word_segments, item_words,
    asof_highlight, asof_chapter, chapter_lines, clean_transcript, turn_audit, audit_totals, raw_grounded,
)}

SEG = ("base", "segments", "readings", "intervals", "ovl")
_hits = "CAST(list_sum(list_transform(list_distinct({n}), lambda t: least(len(list_filter({n}, lambda x: x = t)), len(list_filter({w}, lambda x: x = t))))) AS DOUBLE)"


def _containment(n: str, h: str) -> str:
    width = f"least(len({h}), len({n}) + CAST(ceil(len({n}) / 4) AS BIGINT))"
    best = f"list_max(list_transform(range(1, len({h}) - {width} + 2), lambda k: {_hits.format(n=n, w=f'{h}[k : k + {width} - 1]')}))"
    return f"CASE WHEN len({n}) = 0 OR len({h}) = 0 THEN 0.0 WHEN contains(' ' || array_to_string({h}, ' ') || ' ', ' ' || array_to_string({n}, ' ') || ' ') THEN 1.0 ELSE {best} / len({n}) END"


ANCHOR = f"""capt AS (SELECT meeting_id, ord AS caption, t, speaker_name AS name, {i.tokens('text')} AS ct FROM captions WHERE final AND speaker_name <> 'Unknown'),
segt AS (SELECT meeting_id, ord, start_time, end_time, {i.tokens('text')} AS st FROM segments WHERE source = 'tab'),
scored AS (SELECT s.meeting_id, s.ord, c.name, c.caption, greatest({_containment('ct', 'st')}, {_containment('st', 'ct')}) AS score FROM segt s JOIN capt c ON s.meeting_id = c.meeting_id AND c.t >= s.start_time - 5 AND c.t <= s.end_time + 5 WHERE len(ct) >= 3),
named AS (SELECT meeting_id, ord, name, max(score) AS score, min(caption) AS first FROM scored WHERE score > 0 GROUP BY ALL),
anchor AS (SELECT meeting_id, ord, arg_min(name, n) AS name, max(score) AS score, max(score) - coalesce(max(score) FILTER (n = 2), 0) AS margin FROM
  (SELECT *, row_number() OVER (PARTITION BY meeting_id, ord ORDER BY score DESC, first) AS n FROM named) GROUP BY ALL HAVING max(score) >= 0.5)"""
CORRELATED = ANCHOR + """, correlated AS (SELECT s.meeting_id, s.ord, 's' || s.ord AS seg_id, s.source,
  CASE WHEN source = 'mic' THEN 'me' WHEN source = 'caption' THEN label ELSE coalesce(a.name, v.name, label) END AS speaker,
  CASE WHEN source IN ('mic', 'caption') THEN 1.0 WHEN a.name IS NOT NULL THEN a.score ELSE coalesce(v.share, 0) END AS speaker_confidence,
  CASE WHEN source IN ('mic', 'caption') THEN 1.0 WHEN a.name IS NOT NULL THEN a.margin ELSE coalesce(v.margin, 0) END AS label_margin,
  CASE WHEN source = 'mic' THEN 'mic' WHEN source = 'caption' OR a.name IS NOT NULL THEN 'caption' WHEN v.name IS NOT NULL THEN 'timeline' ELSE 'unresolved' END AS label_source,
  CASE WHEN source = 'tab' AND a.name IS NOT NULL AND v.name IS NOT NULL THEN a.name = v.name END AS agrees
  FROM segments s LEFT JOIN anchor a USING (meeting_id, ord) LEFT JOIN vote v USING (meeting_id, ord))"""
MERGED = """tab AS (SELECT * FROM segments WHERE source = 'tab'),
over AS (SELECT meeting_id, probe, arg_min(target, k) AS target FROM (SELECT b.meeting_id, b.ord AS probe, t.ord AS target, row_number() OVER (PARTITION BY b.meeting_id, b.ord ORDER BY least(b.end_time, t.end_time) - greatest(b.start_time, t.start_time) DESC, t.ord) AS k
  FROM batch b JOIN tab t ON b.meeting_id = t.meeting_id AND least(b.end_time, t.end_time) - greatest(b.start_time, t.start_time) > 0) GROUP BY ALL),
near AS (SELECT meeting_id, probe, arg_min(target, k) AS target FROM (SELECT b.meeting_id, b.ord AS probe, t.ord AS target, row_number() OVER (PARTITION BY b.meeting_id, b.ord ORDER BY greatest(t.start_time - b.end_time, b.start_time - t.end_time), t.ord) AS k
  FROM batch b ANTI JOIN over o ON b.meeting_id = o.meeting_id AND b.ord = o.probe JOIN tab t ON b.meeting_id = t.meeting_id AND greatest(t.start_time - b.end_time, b.start_time - t.end_time) < 2) GROUP BY ALL),
hits AS (SELECT a.meeting_id, a.target AS ord, string_agg(b.text, ' ' ORDER BY b.start_time, b.ord) AS text, avg(b.confidence) AS confidence FROM (FROM over UNION ALL FROM near) a JOIN batch b ON a.meeting_id = b.meeting_id AND a.probe = b.ord GROUP BY ALL),
merged AS (SELECT s.meeting_id, s.ord, coalesce(h.text, s.text) AS text, CASE WHEN h.text IS NULL THEN s.confidence ELSE h.confidence END AS confidence, CASE WHEN h.text IS NULL THEN 'streaming' ELSE 'batch' END AS provenance FROM segments s LEFT JOIN hits h USING (meeting_id, ord))"""
ITEMS = r"""w AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY ord, pos) - 1 AS n, ws[pos] AS word FROM
  (SELECT meeting_id, ord, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT meeting_id, ord, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM base))),
tim AS (SELECT meeting_id, n, word, n * 40 + (n // 7) * 100 AS s, (n * 13 % 100) / 100.0::DOUBLE AS confidence, regexp_replace(word, '\.$', '') <> '' AS is_word FROM w),
runs AS (SELECT *, sum(CASE WHEN is_word THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS ord FROM tim),
wd AS (SELECT meeting_id, CAST(ord AS BIGINT) AS ord, min(s) FILTER (is_word) / 100.0::DOUBLE AS start_time, (max(s) FILTER (is_word) + 30) / 100.0::DOUBLE AS end_time, string_agg(word, '' ORDER BY n) AS text, max(confidence) FILTER (is_word) AS confidence FROM runs WHERE ord > 0 GROUP BY ALL),
brk AS (SELECT *, CASE WHEN coalesce(regexp_matches(lag(text) OVER (PARTITION BY meeting_id ORDER BY ord), '[.?!…]$'), false) OR coalesce(start_time - lag(end_time) OVER (PARTITION BY meeting_id ORDER BY ord) > 0.8, false) THEN 1 ELSE 0 END AS b FROM wd),
isl AS (SELECT *, sum(b) OVER (PARTITION BY meeting_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM brk),
prt AS (SELECT *, (row_number() OVER (PARTITION BY meeting_id, island ORDER BY ord) - 1) // 20 AS part FROM isl)"""

ORACLES = {
    "talk_time": sql(f"SELECT meeting_id, speaker, round(seconds, 6) AS seconds, CAST(words AS BIGINT) AS words, turns, round(pct, 6) AS pct, rank, rank = 1 AND pct > 60 AS dominant FROM ranked", "base", "turns").replace("\nSELECT", ",\n" + TALK + "\nSELECT"),
    "dominant_speaker": sql("SELECT meeting_id, speaker, round(pct, 6) AS pct FROM ranked WHERE rank = 1 AND pct > 60", "base", "turns").replace("\nSELECT", ",\n" + TALK + "\nSELECT"),
    "session_totals": sql("SELECT meeting_id, CAST(sum(words) AS BIGINT) AS words, round(sum((c1 - c0) / 100.0), 6) AS talk_seconds, count(DISTINCT role) AS speakers, round((max(c1) - min(c0)) / 100.0, 6) AS duration, count(*) AS turns FROM base GROUP BY 1", "base"),
    "first_appearance": sql("SELECT meeting_id, speaker, CAST((row_number() OVER (PARTITION BY meeting_id ORDER BY first) - 1) % 5 AS INTEGER) AS colour FROM (SELECT meeting_id, speaker, min(ord) AS first FROM turns GROUP BY ALL)", "base", "turns"),
    "occurrence_search": sql("SELECT meeting_id, ord, occurrence, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY ord, occurrence) - 1 AS INTEGER) AS match_ix FROM (SELECT meeting_id, ord, CAST(unnest(range(0, (length(text) - length(replace(lower(text), 'th', ''))) // 2)) AS INTEGER) AS occurrence FROM turns)", "base", "turns"),
    "caption_ends": sql(f"SELECT meeting_id, ord, t, round(greatest(coalesce(lead(t) OVER (PARTITION BY meeting_id ORDER BY t, ord), t + greatest(1.5, 0.35 * {i.WORDS.format('text')})), t + 0.2), 6) AS end_time FROM captions", "base", "captions"),
    "closing_reading": sql("""SELECT meeting_id, t, name FROM (WITH c AS (SELECT meeting_id, ord, t, name FROM (SELECT *, lag(name) OVER w AS b, row_number() OVER w AS n FROM readings WINDOW w AS (PARTITION BY meeting_id ORDER BY t, ord)) WHERE n = 1 OR b IS DISTINCT FROM name)
        SELECT meeting_id, t, name FROM c UNION ALL SELECT meeting_id, z + 100 AS t, name FROM (SELECT meeting_id, arg_max(name, t) AS name FROM c GROUP BY 1) JOIN (SELECT meeting_id, max(end_time) AS z FROM turns GROUP BY 1) USING (meeting_id) WHERE meeting_id % 3 <> 0)""", "base", "turns", "readings"),
    "edge_trigger": sql("SELECT meeting_id, ord, t, name FROM (SELECT *, lag(name) OVER w AS b, row_number() OVER w AS n FROM readings WINDOW w AS (PARTITION BY meeting_id ORDER BY t, ord)) WHERE n = 1 OR b IS DISTINCT FROM name", "base", "readings"),
    "speaker_intervals": sql("SELECT meeting_id, ord, t, until, name FROM intervals", "base", "readings", "intervals"),
    "interval_overlap": sql("SELECT meeting_id, ord, name, round(overlap, 6) AS overlap FROM ovl", *SEG),
    "global_vote": sql("""SELECT s.meeting_id, s.ord, CASE WHEN source = 'mic' THEN 'me' ELSE coalesce(w.name, label) END AS speaker, source = 'mic' OR w.name IS NOT NULL AS resolved FROM segments s LEFT JOIN
        (SELECT meeting_id, label, arg_min(name, k) AS name FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, label ORDER BY score DESC, fo, ff) AS k FROM
          (SELECT s.meeting_id, s.label, o.name, sum(o.overlap) AS score, min(s.ord) AS fo, arg_min(o.first, s.ord) AS ff FROM segments s JOIN ovl o USING (meeting_id, ord) WHERE s.source <> 'mic' GROUP BY ALL)) GROUP BY ALL) w
        USING (meeting_id, label)""", *SEG),
    "windowed_vote": sql("SELECT meeting_id, ord, name, round(share, 6) AS share, round(margin, 6) AS margin FROM vote", *SEG, "vote"),
    "caption_anchor": sql("SELECT meeting_id, ord, name, round(score, 6) AS score, round(margin, 6) AS margin FROM anchor", "base", "segments", "captions").replace("\nSELECT", ",\n" + ANCHOR + "\nSELECT"),
    "correlate": sql("SELECT meeting_id, ord, seg_id, speaker, label_source <> 'unresolved' AS resolved, round(speaker_confidence, 6) AS speaker_confidence, round(label_margin, 6) AS label_margin, label_source FROM correlated", *SEG, "vote", "captions").replace("\nSELECT", ",\n" + CORRELATED + "\nSELECT"),
    "correlation_scores": sql("SELECT meeting_id, round(least(1, coalesce(min(label_margin) FILTER (source = 'tab' AND label_source <> 'unresolved'), 1)), 6) AS label_margin_min, round(100 * avg(CASE WHEN label_source = 'unresolved' THEN 1.0 ELSE 0 END), 6) AS unresolved_pct, round(100 * avg(CASE WHEN agrees THEN 1.0 WHEN NOT agrees THEN 0.0 END), 6) AS caption_agreement_pct FROM correlated GROUP BY 1", *SEG, "vote", "captions").replace("\nSELECT", ",\n" + CORRELATED + "\nSELECT"),
    "resolved_speakers": sql("SELECT meeting_id, string_agg(speaker, '|' ORDER BY first) AS speakers FROM (SELECT meeting_id, speaker, min(ord) AS first FROM correlated WHERE label_source <> 'unresolved' GROUP BY ALL) GROUP BY 1", *SEG, "vote", "captions").replace("\nSELECT", ",\n" + CORRELATED + "\nSELECT"),
    "max_overlap": sql("SELECT b.meeting_id, b.ord AS probe, arg_max(t.ord, (least(b.end_time, t.end_time) - greatest(b.start_time, t.start_time), -t.ord)) AS target, round(max(least(b.end_time, t.end_time) - greatest(b.start_time, t.start_time)), 6) AS overlap FROM batch b JOIN segments t ON b.meeting_id = t.meeting_id AND t.source = 'tab' AND least(b.end_time, t.end_time) - greatest(b.start_time, t.start_time) > 0 GROUP BY ALL", "base", "segments", "batch"),
    "nearest_gap": sql("SELECT b.meeting_id, b.ord AS probe, arg_min(t.ord, (greatest(t.start_time - b.end_time, b.start_time - t.end_time), t.ord)) AS target, round(min(greatest(t.start_time - b.end_time, b.start_time - t.end_time)), 6) AS gap FROM batch b JOIN segments t ON b.meeting_id = t.meeting_id AND t.source = 'tab' AND greatest(t.start_time - b.end_time, b.start_time - t.end_time) < 2 GROUP BY ALL", "base", "segments", "batch"),
    "merge_transcripts": sql("SELECT meeting_id, ord, text, round(confidence, 6) AS confidence, provenance FROM merged", "base", "segments", "batch").replace("\nSELECT", ",\n" + MERGED + "\nSELECT"),
    "batch_fraction": sql("SELECT meeting_id, round(avg(CASE WHEN provenance = 'batch' THEN 1.0 ELSE 0 END), 6) AS batch_fraction FROM merged GROUP BY 1", "base", "segments", "batch").replace("\nSELECT", ",\n" + MERGED + "\nSELECT"),
    "item_words": sql("SELECT meeting_id, ord, start_time, end_time, text, confidence FROM wd", "base").replace("\nSELECT", ",\n" + ITEMS + "\nSELECT"),
    "word_segments": sql("SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY f) - 1 AS BIGINT) AS ord, start_time, end_time, text, round(confidence, 6) AS confidence FROM (SELECT meeting_id, min(ord) AS f, arg_min(start_time, ord) AS start_time, arg_max(end_time, ord) AS end_time, string_agg(text, ' ' ORDER BY ord) AS text, avg(confidence) AS confidence FROM prt GROUP BY meeting_id, island, part)", "base").replace("\nSELECT", ",\n" + ITEMS + "\nSELECT", 1),
    "asof_highlight": sql("""SELECT t.meeting_id, t.ord, 'T' || (t.ord + 1) AS id, coalesce(array_to_string(list_sort(list_distinct(list_concat(CASE WHEN t.ord % 3 = 0 THEN ['key'] ELSE [] END, coalesce(g.tags, [])))), ','), '') AS tags FROM turns t LEFT JOIN
        (SELECT meeting_id, ord, list(tag) AS tags FROM (SELECT p.meeting_id, coalesce(max(t.ord) FILTER (t.start_time <= p.t), min(t.ord)) AS ord, p.tag FROM (SELECT meeting_id, ord, c0 / 100.0::DOUBLE - 1 AS t, 'tap' || ord AS tag FROM base WHERE ord % 2 = 1) p JOIN turns t ON t.meeting_id = p.meeting_id GROUP BY p.meeting_id, p.tag) GROUP BY ALL) g USING (meeting_id, ord)""", "base", "turns"),
    "asof_chapter": sql("""SELECT t.meeting_id, t.ord, CAST(coalesce(max(c.ix), 0) AS INTEGER) AS chapter_ix, coalesce(arg_max(c.title, c.ix), 'Inicio') AS chapter_title FROM turns t LEFT JOIN
        (SELECT meeting_id, (c0 + 20) / 100.0::DOUBLE AS s, 'chapter ' || ord AS title, row_number() OVER (PARTITION BY meeting_id ORDER BY c0, ord) AS ix FROM base WHERE ord % 3 = 1) c ON c.meeting_id = t.meeting_id AND c.s <= t.start_time GROUP BY ALL""", "base", "turns"),
    "chapter_lines": sql("""SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY tt, k, ord) AS INTEGER) AS line_ix, kind, text FROM (SELECT meeting_id, (c0 + 20) / 100.0::DOUBLE AS tt, 0 AS k, ord, 'chapter' AS kind, 'chapter ' || ord AS text FROM base WHERE ord % 3 = 1
        UNION ALL SELECT meeting_id, start_time, 1, ord, 'turn', '[T' || (ord + 1) || '] ' || speaker || ': ' || text FROM turns)""", "base", "turns"),
    "clean_transcript": sql("SELECT meeting_id, CAST(ord AS INTEGER) AS ord, 'T' || ord AS id, source_ids, speaker, start_time, end_time, tags FROM clean", "base", "segments").replace("\nSELECT", ",\n" + CLEAN + "\nSELECT"),
    "turn_audit": sql("SELECT meeting_id, CAST(ord AS INTEGER) AS ord, coalesce(array_to_string(mn, ','), '') AS missing_numbers, coalesce(array_to_string(inn, ','), '') AS introduced_numbers, coalesce(array_to_string(nf, ','), '') AS negation_flips, violated FROM judged", "base", "segments").replace("\nSELECT", ",\n" + AUDIT + "\nSELECT"),
    "audit_totals": sql("SELECT meeting_id, CAST(sum(len(mn) + len(inn)) AS BIGINT) AS number_mismatches, CAST(sum(len(nf)) AS BIGINT) AS negation_mismatches, count(*) FILTER (violated) AS violations FROM judged GROUP BY 1", "base", "segments").replace("\nSELECT", ",\n" + AUDIT + "\nSELECT"),
    "raw_grounded": sql("SELECT meeting_id, CAST(ord AS INTEGER) AS ord, md5(CASE WHEN violated THEN raw ELSE text END) AS text_md5, CASE WHEN violated THEN array_to_string(list_filter([tags, 'raw-grounded'], lambda x: x <> ''), ',') ELSE tags END AS tags FROM judged", "base", "segments").replace("\nSELECT", ",\n" + AUDIT + "\nSELECT"),
}
