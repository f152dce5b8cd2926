"""Queries of keyed reads and writes, artifacts, caption views, chunks of meetings, model contracts and small rules."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as tx
from ..functions import values as v
from ..operators import analytics, chunking, citations, grounding, prompts, search, speakers, transcripts
from ..operators import captions as cp
from ..sources import tables
from ..sources.work import work_folder
from . import inputs as i
from .inputs import sql
from .speaking import _containment
from .texts import _MMSS


_SMALL = "abcdefghijklmnopqrstuvwxyz"


# keyed reads and artifacts ------------------------------------------------------
def point_get(spark, d):
    return tables.get(i.read(spark, d, "orders"), o_custkey=7, o_orderstatus="F").select("o_orderkey", "o_custkey")


def optional_artifact(spark, d):
    c = i.read(spark, d, "customer").select("c_custkey", "c_name")
    return tables.optional(c, c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("found").alias("artifact")), ["c_custkey"])


def artifact_writes(spark, d):
    """Three writes of one artifact: even meetings, odd ones, and every tenth again; each replaces its own meetings only."""
    folder = work_folder(spark, "artifact")
    t = i.turns(spark, d).select(F.lit("t1").alias("tenant_id"), "meeting_id", "ord", "speaker", F.lit(1).alias("version"))
    for part in (t.filter("meeting_id % 2 = 0"), t.filter("meeting_id % 2 = 1"), t.filter("meeting_id % 10 = 0 AND ord < 2").withColumn("version", F.lit(2))):
        tables.write_artifact(part, folder, "turns")
    return tables.read_artifact(spark, folder, "turns", "ord long, speaker string, version int, tenant_id string, meeting_id long").select("meeting_id", "ord", "speaker", "version")


def owned_notes(spark, d):
    notes = i.read(spark, d, "documents").select("doc_id", F.col("source").alias("owner_sub"), F.col("n_chars").alias("created_at"), "lang")
    first = notes.agg(F.min("owner_sub")).first()[0]
    return tables.owned(notes, first, columns=["doc_id", "lang"])


def recogniser_json(spark, d):
    """Items rendered as the recogniser's JSON and parsed again."""
    t = i.turns(spark, d)
    text_of = lambda c: F.format_string("%.2f", F.col(c))
    item = F.struct(
        F.lit("pronunciation").alias("type"), text_of("start_time").alias("start_time"), text_of("end_time").alias("end_time"),
        F.array(F.struct(F.col("speaker").alias("content"), F.lit("0.5").alias("confidence"))).alias("alternatives"),
    )
    rows = t.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"]).alias("items"))
    return tables.recogniser_items(rows.select("meeting_id", F.to_json(F.struct(F.struct("items").alias("results"))).alias("json")))


def caption_lines(spark, d):
    """Caption lines written as JSON lines, every ninth of them broken."""
    path = work_folder(spark, "captions")
    t = i.turns(spark, d)
    line = F.when((F.col("meeting_id") + F.col("ord")) % 9 == 0, F.lit('{"meeting_id": 3, "ord": ')).otherwise(F.to_json(F.struct("meeting_id", "ord", "speaker")))
    t.select(line.alias("value")).write.text(path)
    rows = tables.read_json_lines(spark, path, "meeting_id long, ord long, speaker string")
    broken = F.col("_corrupt_record").isNotNull()
    return rows.groupBy(F.when(~broken, F.col("speaker")).alias("speaker")).agg(F.count_if(broken).alias("broken"), F.count_if(~broken).alias("whole"), F.sum(F.when(~broken, F.col("ord"))).alias("ords"))


def golden_set(spark, d):
    """A golden set as JSON arrays of about a thousand entries, a file each; entries without question or id don't count."""
    path = work_folder(spark, "golden")
    b = i.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("expected_id"), F.when(F.col("item_id") % 5 == 0, "  ").when(F.col("item_id") % 7 != 0, F.concat(F.lit("question "), "item_id")).alias("question"))
    files = F.pmod(F.xxhash64("expected_id"), F.lit(-(-b.count() // 1000) or 1)).alias("file")
    b.groupBy(files).agg(F.to_json(F.collect_list(F.struct("question", "expected_id"))).alias("value")).write.partitionBy("file").text(path)
    return tables.read_golden(spark, path).select("question", "expected_id")


def key_pattern(spark, d):
    e = i.read(spark, d, "customer").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "labels:").otherwise("other:"), F.col("c_custkey").cast("string")).alias("key"), F.when(F.col("c_custkey") % 6 == 0, "{broken").otherwise(F.concat(F.lit('{"name": "'), "c_mktsegment", F.lit('"}'))).alias("value"))
    return tables.matching_keys(e, r"^labels:\d+$", "name string").select("key", F.col("parsed.name").alias("name"))


def meeting_detail(spark, d):
    m = i.read(spark, d, "nation").select(F.col("n_nationkey").alias("meeting_id"), "n_name")
    a = m.filter("meeting_id % 2 = 0").select("meeting_id", F.struct(F.col("n_name").alias("text")).alias("value"))
    b = m.filter("meeting_id % 3 = 0").select("meeting_id", F.array("n_name").alias("value"))
    return tables.meeting_details(m, summary=a, tags=b).select("meeting_id", F.coalesce("summary.text", F.lit("")).alias("summary"), F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"))


def job_tokens(spark, d):
    jobs = i.read(spark, d, "customer").select(F.concat(F.lit("job"), "c_custkey").alias("job_name"), "c_custkey")
    tokens = i.read(spark, d, "orders").filter("o_orderkey % 4 = 0").select(F.concat(F.lit("job"), "o_custkey").alias("job_name"), F.col("o_orderkey").alias("token"))
    return tables.by_job(jobs, tokens)


def vector_upsert(spark, d):
    stored = i.read(spark, d, "embeddings").select(F.lit("t").alias("tenant_id"), F.col("vec_id").alias("key"), F.lit("old").alias("state"), F.create_map(F.lit("a"), F.lit("x")).alias("metadata"))
    fresh = stored.filter("key % 3 = 0").select("tenant_id", "key", F.lit("new").alias("state"), F.create_map(F.lit("a"), F.lit("y"), F.lit("b"), F.lit(None).cast("string")).alias("metadata"))
    return tables.put_vectors(stored, fresh).select("key", "state", F.array_join(F.map_keys("metadata"), ",").alias("fields"))


def vector_writes(spark, d):
    """Two writes of vectors by version; the second replaces some keys of version 1 and adds others."""
    path = work_folder(spark, "vectors")
    rows = i.read(spark, d, "embeddings").select(F.lit("t").alias("tenant_id"), (F.col("vec_id") % 2).alias("index_version"), F.col("vec_id").alias("key"), F.lit("old").alias("state"))
    tables.write_vectors(rows.filter("key % 7 <> 0"), path)
    tables.write_vectors(rows.filter("index_version = 1 AND key % 21 IN (0, 1)").withColumn("state", F.lit("new")), path)
    return spark.read.parquet(path).select("key", F.col("index_version").cast("long").alias("index_version"), "state")


def transcript_file(spark, d):
    t = i.turns(spark, d).select("meeting_id", "ord", "speaker", F.md5("text").alias("text"), F.timestamp_seconds(F.floor("start_time")).alias("at"))
    return tables.transcript_lines(t)


# lists and small rules ----------------------------------------------------------
def canonical_turns(spark, d):
    t = i.turns(spark, d)
    clean = t.filter("meeting_id % 3 = 0").withColumn("id", F.concat(F.lit("T"), F.col("ord") + 1))
    raw = t.withColumn("seg_id", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("s"), "ord")))
    return transcripts.canonical_turns(clean, raw).select("meeting_id", "ord", "id", "speaker")


def recent_orders(spark, d):
    return analytics.recent(i.read(spark, d, "orders").select("o_orderkey", "o_orderdate"), 20, "o_orderdate", "o_orderkey").select("o_orderkey")


def names_by_case(spark, d):
    """Distinct names of a nation's customers, numbered in the order of their lower-case form."""
    return analytics.participants(i.read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.array("c_mktsegment", F.lower("c_mktsegment")).alias("participants")), collation=None, keys=("nation",))


def any_capturing(spark, d):
    return analytics.any_capturing(i.read(spark, d, "orders").select(F.when(F.col("o_orderkey") == 1, "capturing").otherwise("ready").alias("status")))


def circular_match(spark, d):
    k = F.col("event_id")
    return i.read(spark, d, "events").select("event_id", analytics.step_match(k % 7, F.lit(-1), F.lit(7)).alias("before"), analytics.step_match(k % 7, F.lit(1), F.lit(7)).alias("after"))


def toggled(spark, d):
    tags = F.array(F.lit("a"), F.col("event_type"))
    return i.read(spark, d, "events").select("event_id", F.array_join(v.toggle(tags, F.lit("click")), ",").alias("tags"))


def patched_map(spark, d):
    old, patch = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("event_type")), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.lit("2"), F.lit("c"), F.lit("3")))
    entries = F.array_sort(F.transform(F.map_entries(v.patched(old, patch)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return i.read(spark, d, "events").select("event_id", F.array_join(entries, ",").alias("entries"))


def json_fallback(spark, d):
    """Broken JSON reads as the default, and a web token gives its expiry."""
    k = F.col("event_id")
    text = F.when(k % 3 == 0, "{broken").otherwise(F.concat(F.lit('{"n": '), k, F.lit("}")))
    body = F.translate(F.rtrim(F.base64(F.concat(F.lit('{"sub": "u'), k, F.lit('", "exp": '), k * 10, F.lit("}")).cast("binary")), F.lit("=")), "+/", "-_")
    parsed = v.json_or(text, "n long", F.named_struct(F.lit("n"), F.lit(-1).cast("long")))
    token = F.when(k % 5 == 0, F.lit("no token")).otherwise(F.concat(F.lit("h."), body, F.lit(".s")))
    return i.read(spark, d, "events").select("event_id", F.coalesce(parsed["n"], F.lit(-1)).alias("n"), v.token_expiry(token).alias("expires"))


def rendered_json(spark, d):
    return i.read(spark, d, "events").select("event_id", v.rendered_json(F.struct(F.col("user_id").alias("u"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind"))).alias("json"))


def date_times(spark, d):
    return i.events(spark, d).select("event_id", v.short_date_time(F.col("ts")).alias("told"))


def routing(spark, d):
    k = F.col("event_id")
    return i.read(spark, d, "events").select(
        "event_id", analytics.route_question(k % 3 != 0, k % 2 == 0).alias("route"), analytics.thread_guard(F.repeat(F.lit("x"), (k % 5000).cast("int")), k % 60).alias("thread"),
        analytics.note_guard(F.when(k % 7 == 0, F.lit("  ")).otherwise(F.col("event_type")), F.element_at(F.lit(["typed", "voice", "dictated"]), (k % 3 + 1).cast("int"))).alias("note"),
    )


def tenants(spark, d):
    k = F.col("event_id")
    return i.read(spark, d, "events").select(
        "event_id", analytics.tenant_of(F.when(k % 2 == 0, F.concat(F.lit("tenant"), k % 4)).when(k % 3 == 0, F.lit("")), F.concat(F.lit("sub"), k)).alias("tenant"),
        F.array_join(analytics.groups_of(F.when(k % 2 == 0, F.lit("[admins, users]")).when(k % 3 == 0, F.lit("users"))), "|").alias("groups"),
    )


def kits(spark, d):
    catalogue = i.read(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("kit")).agg(F.array_sort(F.collect_list("n_name")).alias("prompts"))
    return models.with_prompt(catalogue, "2", "Added").select("kit", F.array_join("prompts", ",").alias("prompts"))


def dictation(spark, d):
    r = i.turns(spark, d).select(F.col("meeting_id").alias("session_id"), "ord", (F.col("ord") % 3 != 1).alias("final"), "text")
    return analytics.dictation_text(r).select("session_id", F.md5("text").alias("text"))


# text -----------------------------------------------------------------------------
def quote_exists(spark, d):
    """Each turn's first words, and every third turn's words from another turn, as quotes."""
    t = i.turns(spark, d)
    nexts = t.select("meeting_id", (F.col("ord") - 1).alias("ord"), F.col("text").alias("after"))
    quote = F.when(F.col("ord") % 3 == 0, F.substring_index("after", " ", 6)).otherwise(F.translate(F.substring_index("text", " ", 6), _SMALL, _SMALL.upper()))
    return t.join(nexts, ["meeting_id", "ord"]).select("meeting_id", "ord", tx.quote_exists(quote, F.col("text")).alias("exists"))


def anchored_text(spark, d):
    mark = F.concat(F.lit("T"), F.col("ord") % 3)
    text = F.when(F.col("ord") % 2 == 0, F.concat("speaker", F.lit(" **said** [T1]"))).otherwise(F.concat("speaker", F.lit(" **said**")))
    return i.turns(spark, d).select("meeting_id", "ord", tx.strip_emphasis(tx.with_anchor(text, mark)).alias("text"))


def violation_text(spark, d):
    t = i.turns(spark, d)
    raw = F.concat("speaker", F.lit(" paid 1.500 and not "), F.col("ord"))
    clean = F.when(F.col("ord") % 2 == 0, F.concat("speaker", F.lit(" paid 1500 and 7777"))).otherwise(raw)
    rows = t.select("meeting_id", "ord", tx.audit(raw, clean).alias("found")).filter(tx.violated(F.col("found")))
    return rows.select("meeting_id", "ord", tx.describe_violation(F.array(F.concat(F.lit("s"), "ord")), F.col("found")).alias("told"))


def control_chunks(spark, d):
    """Turns with the marks of a captured control between their parts."""
    text = F.concat(F.lit(" head￼"), "speaker", F.lit("\t(x)|  \r"), F.translate("text", "|", "\n"))
    rows = i.turns(spark, d).select("meeting_id", "ord", F.posexplode(tx.chunks(text)).alias("n", "chunk"))
    return rows.select("meeting_id", "ord", "n", F.md5("chunk").alias("chunk"))


def reference_marks(spark, d):
    k = F.col("ord")
    kind = F.element_at(F.lit(["chapter", "summary", "digest", "note", "extraction"]), (k % 5 + 1).cast("int"))
    return i.turns(spark, d).select("meeting_id", "ord", tx.reference_of(kind, F.col("meeting_id").cast("string"), F.when(k % 7 != 0, F.concat(F.lit("T"), k)), F.concat(F.lit("n"), k)).alias("mark"))


def label_names(spark, d):
    """Accessible labels of people."""
    rest = F.element_at(F.lit([", video is on, muted", " · Guest", " | Org", " (Unverified)", " is speaking now", " (Sales)", " MUTED"]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return i.read(spark, d, "customer").select("c_custkey", tx.clean_name(F.concat(F.lit(" "), "c_name", rest)).alias("name"))


# caption views -------------------------------------------------------------------------
def _views(spark, d):
    """Turns as lines of a caption view; a meeting is a snapshot."""
    k = F.col("meeting_id") + F.col("ord")
    plain = F.translate("text", "\n():", "    ")
    line = (
        F.when(F.col("ord") == F.col("meeting_id") % 3, F.when(F.col("meeting_id") % 2 == 0, F.lit("Live Captions")).otherwise(F.lit("Ana Paz (Org)")))
        .when((F.col("ord") > 8) & (k % 5 == 0), F.lit("Hide live captions")).when(k % 7 == 0, F.lit("12:30")).when(k % 7 == 1, F.lit("People")).when(k % 11 == 2, F.lit("Chat participants")).otherwise(F.concat(F.lit("so "), plain))
    )
    return i.base(spark, d).select(F.col("meeting_id").alias("snapshot_id"), F.col("ord").alias("line_no"), line.alias("line"))


def candidate_region(spark, d):
    return cp.candidate_lines(_views(spark, d)).select("snapshot_id", "line_no", F.md5("line").alias("line"))


_LINES = ["Ana Paz (Org)", "Ana (Org)", "Ana Paz (Ctrl+M)", "General talk (Org)", "Ana Paz (Org) hello there", "Live captions language", "Chats (3)", "Luis: named the meeting x", "Zoom reset to 100 %", "we closed captions", ""]


def caption_predicates(spark, d):
    line = F.element_at(F.lit(_LINES), (F.col("event_id") % len(_LINES) + 1).cast("int"))
    return i.read(spark, d, "events").select(
        "event_id", cp.is_speaker_line(line).alias("speaker"), cp.reads_as_caption(line).alias("caption"), cp.is_caption_ui(line).alias("ui"), cp.is_frame_line(line).alias("frame"), cp.is_blocked(line).alias("blocked")
    )


def chrome_items(spark, d):
    t = i.turns(spark, d)
    text = F.when(F.col("ord") % 3 == 0, F.concat(F.lit(" "), F.upper("speaker"))).when(F.col("ord") % 3 == 1, F.concat("speaker", F.lit(" left the call"))).otherwise(F.concat("text", F.lit(".")))
    return t.select("meeting_id", "ord", cp.is_chrome(F.col("speaker"), text).alias("chrome"))


def root_scores(spark, d):
    k = F.col("event_id")
    roots = i.read(spark, d, "events").select(k.alias("ord"), *((k % n == 0).alias(c) for n, (c, _) in zip((2, 3, 5, 11, 7, 4), cp.ROOT_MARKS, strict=True)))
    return cp.root_order(roots).select("ord", "score")


#: Names of windows with their priority; null where they hold no meeting.
_PRIORITIES = {
    "Weekly sync | Microsoft Teams": 0, "Chat | Ana | Microsoft Teams": None, "Calendar | Microsoft Teams": None, "Meeting with Ana": 2, "Llamada de Ana": 1, "Editor": None, "Captions": None, "(2) Chat | x": None, "": None,
    "WebView2: Calendar | Microsoft Teams": 0, "WebView2: Weekly": None, "WebView2: Chat | Ana | Microsoft Teams": None, "Planner | Microsoft Teams": 0, "Microsoft Teams": None, "Subtítulos | Weekly": 1, "WebView2: Captions | Weekly": 1,
}
_WINDOWS = list(_PRIORITIES)


def window_priorities(spark, d):
    e = i.read(spark, d, "events").select("event_id", F.element_at(F.lit(_WINDOWS), (F.col("event_id") % len(_WINDOWS) + 1).cast("int")).alias("name"), F.col("event_id").alias("used_at"))
    return cp.windows_in_order(e).select("event_id", "priority")


def new_snapshot_lines(spark, d):
    s = i.turns(spark, d).select((F.col("meeting_id") * 1000 + F.floor(F.col("ord") / 2)).alias("poll"), "speaker", F.when(F.col("ord") % 3 == 0, "same").otherwise(F.md5("text")).alias("text"), F.col("ord").alias("pos"))
    return cp.new_lines(s).select("poll", "speaker", "text", "pos")


def recall_alignment(spark, d):
    """Turns against the captions of their meetings; no SQL has the ratio by matching blocks."""
    return analytics.align_recall(i.turns(spark, d).select("meeting_id", "ord", "text"), i.captions(spark, d)).select("meeting_id", "ord", F.round("best", 6).alias("best"), "found")


def loss_attribution(spark, d):
    """Turns against their meeting's captions: the source has all of the captions, the root's gate drops short ones, extraction those with digits; what is emitted are the final ones."""
    c = i.captions(spark, d)
    kept = c.filter(F.length("text") >= 40)
    extracted = kept.filter(~F.col("text").rlike("[0-9]"))
    lost = analytics.attribute_losses(i.turns(spark, d).select("meeting_id", "ord", "text"), extracted.filter("final"), [c, kept, extracted])
    return lost.select("meeting_id", "ord", "stage")


# speakers, grounding and chunks -------------------------------------------------------
def _correlated(spark, d):
    return i.segments(spark, d).select(
        "meeting_id", "ord", "source", F.concat(F.lit("s"), "ord").alias("seg_id"), F.concat(F.lit("sp"), F.col("ord") % 4).alias("speaker"), (F.col("ord") % 5 != 0).alias("resolved"), ((F.col("ord") % 10) / 10).alias("label_margin")
    )


_CORRELATED = "c AS (SELECT meeting_id, ord, source, 's' || ord AS seg_id, 'sp' || (ord % 4) AS speaker, ord % 5 <> 0 AS resolved, (ord % 10) / 10.0::DOUBLE AS label_margin FROM segments)"


def repair_targets(spark, d):
    c = _correlated(spark, d)
    fired = c.select("meeting_id").distinct().withColumn("fired", F.col("meeting_id") % 3 != 0)
    return speakers.repair_targets(c, fired).select("meeting_id", F.array_join("seg_ids", ",").alias("seg_ids"))


def roster_union(spark, d):
    c = _correlated(spark, d)
    names = c.filter("meeting_id % 2 = 0").select("meeting_id").distinct().withColumn("names", F.array(F.lit("sp1"), F.lit("Guest")))
    return speakers.roster(c, names).select("meeting_id", F.array_join("names", ",").alias("names"))


def located_quotes(spark, d):
    """First words of turns as quotes: even turns are in the clean transcript, the others in the raw one alone."""
    t = i.turns(spark, d)
    quotes = t.select("meeting_id", F.col("ord").alias("quote_id"), F.concat_ws(" ", F.lit("mark"), F.concat(F.lit("q"), "ord")).alias("quote"))
    marked = t.select("meeting_id", "ord", F.concat_ws(" ", F.lit("well mark"), F.concat(F.lit("q"), "ord"), F.lit("then")).alias("text"))
    return grounding.locate(quotes, marked.filter("ord % 2 = 0"), marked).select("meeting_id", "quote_id", "turn_ord", "place")


def item_validation(spark, d):
    c = i.claims(spark, d)
    items = c.select("meeting_id", F.col("claim_ix").alias("quote_id"), "verdict")
    hits = items.filter("quote_id % 3 <> 0").select("meeting_id", "quote_id", (F.col("quote_id") % 8).alias("turn_ord"), F.lit(1.0).alias("score"))
    kept, counts = grounding.validate_items(items, hits)
    return counts.join(kept.groupBy("meeting_id").agg(F.sum("turn_ord").alias("turns")), "meeting_id", "left")


def cited_cards(spark, d):
    """Answers that cite one meeting twice and one note."""
    t = i.turns(spark, d)
    answers = t.select(F.concat_ws("-", "meeting_id", "ord").alias("answer_id"), F.concat(F.lit("a [M:m 1] b [M:m 1] c [N:n1] d [M:m 1:T2]")).alias("text"))
    hits = answers.select("answer_id", F.lit(1).alias("rank"), F.lit("chapter").alias("type"), F.lit("m 1").alias("meeting_id"), F.lit(None).cast("string").alias("note_id"), F.lit("A").alias("title"), F.lit(0).cast("long").alias("date_epoch")).unionAll(
        answers.select("answer_id", F.lit(2), F.lit("note"), F.lit(None).cast("string"), F.lit("n1"), F.lit("B"), F.lit(86400).cast("long"))
    )
    return citations.citation_cards(citations.resolve_citations(answers, hits)[1]).select("answer_id", "n", "ref", "title", "date", "url")


def retrieval_gate(spark, d):
    metrics = i.read(spark, d, "events").groupBy("user_id").agg(F.avg((F.col("value") > 30).cast("double")).alias("hit_at_5"))
    return search.retrieval_gate(metrics).select("user_id", "passed")


def _meetings(spark, d):
    return i.turns(spark, d).select("meeting_id").distinct().select("meeting_id", F.concat(F.lit("Meeting "), "meeting_id").alias("title"), F.lit("2026-07-01T14:00:00Z").alias("started_at"), F.array(F.lit("Ana")).alias("participants"), F.array(F.lit("point")).alias("key_points"))


def _items(spark, d):
    t = i.turns(spark, d)
    kind = F.element_at(F.lit(["decisions", "actionItems", "openQuestions", "keyNumbers"]), (F.col("ord") % 4 + 1).cast("int"))
    return t.select("meeting_id", kind.alias("kind"), F.col("ord").alias("i"), F.when(F.col("ord") % 6 == 1, "  ").otherwise(F.concat("speaker", F.lit(" item"))).alias("text"), F.col("speaker").alias("verbatim_quote"), F.concat(F.lit("T"), F.col("ord") + 1).alias("turn_id"))


def _chaptered(spark, d):
    return i.speaker_turns(spark, d).select("meeting_id", "ord", "id", "speaker", "text", F.floor(F.col("ord") / 4).cast("int").alias("chapter_ix"), F.concat(F.lit("Part "), F.floor(F.col("ord") / 4)).alias("chapter_title"))


def _summaries(spark, d):
    return i.turns(spark, d).select("meeting_id").distinct().select("meeting_id", F.concat(F.lit("Intro "), "meeting_id", F.lit("\n## One\nfirst\n## Two\nsecond")).alias("text"))


def extraction_chunks(spark, d):
    return chunking.extraction_chunks(_meetings(spark, d), _items(spark, d)).select("key", "text", "turn_start")


def chapter_chunks(spark, d):
    rows = chunking.chapter_chunks(_meetings(spark, d), _chaptered(spark, d))
    return rows.select("meeting_id", "key", F.md5("text").alias("text"), "turn_start", "turn_end", "chapter_title")


def summary_chunks(spark, d):
    return chunking.summary_chunks(_meetings(spark, d), _summaries(spark, d)).select("key", "text")


def meeting_chunks(spark, d):
    rows = chunking.meeting_chunks(_meetings(spark, d), _items(spark, d), _chaptered(spark, d), _summaries(spark, d))
    return rows.groupBy("meeting_id", "type").agg(F.count("*").alias("n"))


# prompts --------------------------------------------------------------------------------
def raw_prompt(spark, d):
    t = i.turns(spark, d).withColumn("seg_id", F.concat(F.lit("s"), "ord"))
    return prompts.raw_transcript(t).select("meeting_id", F.md5("text").alias("text"))


def clean_prompt(spark, d):
    """Chapters at the start of every fifth turn, and one after the end."""
    t = i.speaker_turns(spark, d)
    c = t.filter("ord % 5 = 2").select("meeting_id", "ord", "start_time", F.concat(F.lit("Topic "), "ord").alias("title"))
    late = t.groupBy("meeting_id").agg(F.lit(999).alias("ord"), (F.max("end_time") + 60).alias("start_time"), F.lit("Late").alias("title"))
    return prompts.clean_transcript(t, c.unionByName(late)).select("meeting_id", F.md5("text").alias("text"))


def history_prompt(spark, d):
    m = i.base(spark, d).select(F.col("meeting_id").alias("thread_id"), "ord", "role", "text")
    return prompts.conversation(m, 3).select("thread_id", F.md5("text").alias("text"))


def fragment_prompt(spark, d):
    k = F.col("ord")
    h = i.turns(spark, d).select(
        F.col("meeting_id").alias("query_id"), k.alias("rank"), F.element_at(F.lit(["chapter", "summary", "note"]), (k % 3 + 1).cast("int")).alias("type"), F.col("meeting_id").cast("string").alias("meeting_id"),
        F.when(k % 3 == 0, F.concat(F.lit("T"), k)).alias("turn_start"), F.concat(F.lit("n"), k).alias("note_id"), (k * 86400).alias("date_epoch"), "text",
    )
    return prompts.fragments(h).select("query_id", F.md5("text").alias("text"))


# model contracts ---------------------------------------------------------------------------
#: For each contract an answer that holds, and one that doesn't.
#: Contract and case: a good answer, a bad one, where the bad one breaks, and what the good one is brought to.
_ANSWERS = {
    "clean": ({"turns": [{"sourceIds": ["s0"], "speaker": "Ana", "text": "x"}]}, {"turns": [{"sourceIds": [], "speaker": "Ana", "text": "x"}]}, "$.turns[0].sourceIds", '{"turns":[{"sourceIds":["s0"],"speaker":"Ana","text":"x"}]}'),
    "extract": (
        {"decisions": [{"text": "a", "verbatimQuote": "b", "turnId": "T1", "inferred": True}], "actionItems": [{"text": "a", "verbatimQuote": "b", "turnId": "T2", "owner": "", "due": "mon", "done": True}]},
        {"decisions": [{"text": "a", "verbatimQuote": 5, "turnId": "T1"}]}, "$.decisions[0].verbatimQuote",
        '{"decisions":[{"text":"a","verbatimQuote":"b","turnId":"T1","inferred":true}],"actionItems":[{"text":"a","verbatimQuote":"b","turnId":"T2","inferred":false,"due":"mon","done":true}],"openQuestions":[],"keyNumbers":[],"participants":[]}',
    ),
    "summarise": ({"text": "All fine [T1]"}, {"text": None}, "$.text", '{"text":"All fine [T1]"}'),
    "verify": ({"claims": [{"claim": "a", "verdict": "UNCERTAIN", "turnId": "T3", "critical": True}]}, {"claims": []}, "$.claims", '{"claims":[{"claim":"a","verdict":"UNCERTAIN","turnId":"T3","critical":true}]}'),
    "rejudge": ({"claims": [{"claim": "a", "verdict": "PARTIAL", "quote": "q", "critical": "yes"}]}, {"claims": [{"claim": "a", "verdict": "AMBIGUOUS"}]}, "$.claims[0].verdict", '{"claims":[{"claim":"a","verdict":"PARTIAL","quote":"q","critical":false}]}'),
    "repair": ({"text": "Fine [T2]"}, {"text": "no anchor"}, "$.text", '{"text":"Fine [T2]"}'),
    "answer": ({"answer": "yes", "sufficient": True}, {"answer": None}, "$.answer", '{"answer":"yes","sufficient":true}'),
    "plan": ({"searchQuery": "what", "timeIsExplicit": False, "targetTypes": []}, {"searchQuery": " ", "timeIsExplicit": False}, "$.searchQuery", '{"searchQuery":"what","timeIsExplicit":false}'),
    "plan/epochs": ({"searchQuery": "when", "timeIsExplicit": True, "fromEpoch": 1700000000, "toEpoch": 1700000001.5, "targetTypes": ["note"]}, {"searchQuery": "when", "fromEpoch": 1}, "$.timeIsExplicit", '{"searchQuery":"when","timeIsExplicit":true,"fromEpoch":1.7E9,"toEpoch":1.7000000015E9,"targetTypes":["note"]}'),
    "clean_note": ({"title": " " + "t" * 61, "cleanText": "x"}, {"title": "  ", "cleanText": "x"}, "$.title", '{"title":"' + "t" * 60 + '","cleanText":"x"}'),
    "memory": ({"answer_md": "yes"}, {"answer_md": " \n"}, "$.answer_md", '{"answer_md":"yes","citations":[]}'),
    "memory/cited": ({"answer_md": "yes", "citations": ["N:1"]}, "text", "$", '{"answer_md":"yes","citations":["N:1"]}'),
}


def model_contracts(spark, d):
    """Every contract with a stub model: of four prompts one is answered well, one on the second try, one never, one with no JSON."""
    rows = i.read(spark, d, "events").select("event_id")
    out = None
    for name, (good, bad, _, _) in _ANSWERS.items():

        def stub(prompt, fault, good=good, bad=bad):
            k = int(prompt) % 4
            return "no JSON" if k == 3 else json.dumps(good if k == 0 or (k == 1 and fault) else bad)

        made = models.call(rows.withColumn("prompt", F.col("event_id").cast("string")), name.split("/")[0], stub)
        told = F.when(F.col("result").isNotNull(), F.to_json("result"))
        part = made.select("event_id", F.lit(name).alias("contract"), F.col("result").isNotNull().alias("held"), F.coalesce(F.split("error", ":")[0], F.lit("")).alias("place"), told.alias("told"))
        out = part if out is None else out.unionAll(part)
    return out


QUERIES = {f.__name__: f for f in (
    point_get, optional_artifact, artifact_writes, owned_notes, recogniser_json, caption_lines, golden_set, key_pattern, meeting_detail, job_tokens, vector_upsert, vector_writes, transcript_file,
    canonical_turns, recent_orders, names_by_case, any_capturing, circular_match, toggled, patched_map, json_fallback, rendered_json, date_times, routing, tenants, kits, dictation,
    quote_exists, anchored_text, violation_text, control_chunks, reference_marks, label_names, candidate_region, caption_predicates, chrome_items, root_scores, window_priorities, new_snapshot_lines,
    recall_alignment, loss_attribution, repair_targets, roster_union, located_quotes, item_validation, cited_cards, retrieval_gate, extraction_chunks, chapter_chunks, summary_chunks, meeting_chunks, raw_prompt, clean_prompt, history_prompt, fragment_prompt, model_contracts,
)}

_TURN_WINDOWS = """r AS (SELECT meeting_id, ord, ord // 4 AS c, 'T' || (ord + 1) AS id, '[T' || (ord + 1) || '] ' || speaker || ': ' || text AS line FROM turns),
    k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY meeting_id, c ORDER BY ord) AS n, CAST(ceil(length(line) / 4) AS BIGINT) AS t FROM r),
    sums AS MATERIALIZED (SELECT *, sum(t) OVER (PARTITION BY meeting_id, c ORDER BY n) AS upto, count(*) OVER (PARTITION BY meeting_id, c) AS total FROM k),
    ends AS MATERIALIZED (SELECT a.meeting_id, a.c, a.n, max(b.n) AS e, any_value(a.total) AS total FROM sums a JOIN sums b ON b.meeting_id = a.meeting_id AND b.c = a.c AND b.n >= a.n AND (b.n = a.n OR (b.upto - a.upto + a.t <= 700 AND b.upto - b.t - a.upto + a.t < 500)) GROUP BY ALL),
    w AS (SELECT meeting_id, c, 0 AS ix, n, e, total FROM ends WHERE n = 1 UNION ALL SELECT w.meeting_id, w.c, ix + 1, x.n, x.e, x.total FROM w JOIN ends x ON x.meeting_id = w.meeting_id AND x.c = w.c AND x.n = greatest(w.n + 1, w.e) WHERE w.e < w.total),
    b AS (SELECT w.meeting_id, w.c, ix, string_agg(line, chr(10) ORDER BY k.n) AS body, arg_min(id, k.n) AS a, arg_max(id, k.n) AS z FROM w JOIN k ON k.meeting_id = w.meeting_id AND k.c = w.c AND k.n BETWEEN w.n AND w.e GROUP BY ALL)"""


def _cases(values: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


ORACLES = {
    "point_get": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'",
    "optional_artifact": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'found' END AS artifact FROM customer",
    "artifact_writes": sql("SELECT meeting_id, ord, speaker, CASE WHEN meeting_id % 10 = 0 THEN 2 ELSE 1 END AS version FROM turns WHERE meeting_id % 10 <> 0 OR ord < 2", "base", "turns"),
    "owned_notes": "SELECT doc_id, lang FROM documents WHERE source = (SELECT min(source) FROM documents)",
    "recogniser_json": sql("SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY ord) - 1 AS INTEGER) AS ord, 'pronunciation' AS type, start_time, end_time, speaker AS content, 0.5::DOUBLE AS confidence FROM turns", "base", "turns"),
    "caption_lines": sql("SELECT CASE WHEN NOT b THEN speaker END AS speaker, count(*) FILTER (b) AS broken, count(*) FILTER (NOT b) AS whole, CAST(sum(ord) FILTER (NOT b) AS BIGINT) AS ords FROM (SELECT *, (meeting_id + ord) % 9 = 0 AS b FROM turns) GROUP BY 1", "base", "turns"),
    "golden_set": "SELECT 'question ' || item_id AS question, CAST(item_id AS VARCHAR) AS expected_id FROM benchmark WHERE item_id % 5 <> 0 AND item_id % 7 <> 0",
    "key_pattern": "SELECT 'labels:' || c_custkey AS key, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS name FROM customer WHERE c_custkey % 2 = 0",
    "meeting_detail": "SELECT n_nationkey AS meeting_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS summary, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE '' END AS tags FROM nation",
    "job_tokens": "SELECT 'job' || c_custkey AS job_name, c_custkey, o_orderkey AS token FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 4 = 0",
    "vector_upsert": "SELECT vec_id AS key, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS state, 'a' AS fields FROM embeddings",
    "vector_writes": "SELECT vec_id AS key, vec_id % 2 AS index_version, CASE WHEN vec_id % 2 = 1 AND vec_id % 21 IN (0, 1) THEN 'new' ELSE 'old' END AS state FROM embeddings WHERE vec_id % 7 <> 0 OR (vec_id % 2 = 1 AND vec_id % 21 = 0)",
    "transcript_file": sql("SELECT meeting_id, ord, '[' || strftime(make_timestamp(CAST(floor(start_time) AS BIGINT) * 1000000), '%H:%M:%S') || '] ' || speaker || ': ' || md5(text) AS line FROM turns", "base", "turns"),
    "canonical_turns": sql("SELECT meeting_id, ord, CASE WHEN meeting_id % 3 = 0 OR ord % 2 = 1 THEN 'T' || (ord + 1) ELSE 's' || ord END AS id, speaker FROM turns", "base", "turns"),
    "recent_orders": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "names_by_case": "SELECT nation, name, CAST(row_number() OVER (PARTITION BY nation ORDER BY lower(name), name) AS INTEGER) AS place FROM (SELECT c_nationkey AS nation, c_mktsegment AS name FROM customer UNION SELECT c_nationkey, lower(c_mktsegment) FROM customer)",
    "any_capturing": "SELECT coalesce(bool_or(o_orderkey = 1), false) AS any_capturing FROM orders",
    "circular_match": "SELECT event_id, (event_id % 7 + 6) % 7 AS before, (event_id % 7 + 1) % 7 AS after FROM events",
    "toggled": "SELECT event_id, CASE WHEN event_type = 'click' THEN 'a' ELSE 'a,' || event_type || ',click' END AS tags FROM events",
    "patched_map": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a=1,b=2,c=3' ELSE 'a=1,b=' || event_type END AS entries FROM events",
    "json_fallback": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id END AS n, CASE WHEN event_id % 5 <> 0 THEN event_id * 10 END AS expires FROM events",
    "rendered_json": """SELECT event_id, '{"u":' || user_id || ',"kind":' || CASE WHEN event_id % 2 = 0 THEN '"' || event_type || '"' ELSE 'null' END || '}' AS json FROM events""",
    "date_times": "SELECT event_id, CAST(day(ts) AS VARCHAR) || ' ' || ['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic'][month(ts)] || ' ' || year(ts) || ', ' || strftime(ts, '%H:%M') AS told FROM events",
    "routing": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'legacy' WHEN event_id % 2 = 0 THEN 'summary' ELSE 'transcript' END AS route, CASE WHEN event_id % 5000 > 4000 THEN 'too long' WHEN event_id % 60 > 40 THEN 'full' ELSE 'ok' END AS thread, CASE WHEN event_id % 7 = 0 THEN 'empty' WHEN event_id % 3 = 2 THEN 'unknown source' ELSE 'ok' END AS note FROM events",
    "tenants": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'tenant' || (event_id % 4) ELSE 'sub' || event_id END AS tenant, CASE WHEN event_id % 2 = 0 THEN 'admins|users' WHEN event_id % 3 = 0 THEN 'users' ELSE '' END AS groups FROM events",
    "kits": "SELECT CAST(n_regionkey AS VARCHAR) AS kit, string_agg(n_name, ',' ORDER BY n_name) || CASE WHEN n_regionkey = 2 THEN ',Added' ELSE '' END AS prompts FROM nation GROUP BY n_regionkey",
    "dictation": sql("SELECT meeting_id AS session_id, md5(string_agg(text, ' ' ORDER BY ord)) AS text FROM turns WHERE ord % 3 <> 1 GROUP BY 1", "base", "turns"),
    "anchored_text": sql("SELECT meeting_id, ord, speaker || ' said' || CASE WHEN ord % 2 = 0 THEN ' [T1]' || CASE WHEN ord % 3 = 1 THEN '' ELSE ' [T' || (ord % 3) || ']' END ELSE ' [T' || (ord % 3) || ']' END AS text FROM turns", "base", "turns"),
    "violation_text": sql("SELECT meeting_id, ord, '- segments s' || ord || ': numbers lost: ' || ord || '; numbers introduced: 7777; negations changed: not' AS told FROM turns WHERE ord % 2 = 0", "base", "turns"),
    "control_chunks": sql(r"""SELECT meeting_id, ord, CAST(row_number() OVER (PARTITION BY meeting_id, ord ORDER BY k) - 1 AS INTEGER) AS n, md5(s) AS chunk FROM (SELECT meeting_id, ord, k, regexp_replace(ls[k], '^\s+|\s+$', '', 'g') AS s FROM (SELECT meeting_id, ord, ls, unnest(range(1, len(ls) + 1)) AS k FROM
        (SELECT meeting_id, ord, string_split('head' || chr(10) || speaker || ' (x)' || chr(10) || replace(replace(replace(text, chr(13), chr(10)), '|', chr(10)), chr(9), ' '), chr(10)) AS ls FROM turns))) WHERE s <> ''""", "base", "turns"),
    "reference_marks": sql("SELECT meeting_id, ord, CASE WHEN ord % 5 = 3 THEN 'N:n' || ord WHEN ord % 7 = 0 THEN 'M:' || meeting_id ELSE 'M:' || meeting_id || ':T' || ord END AS mark FROM turns", "base", "turns"),
    "label_names": "SELECT c_custkey, c_name || CASE WHEN c_custkey % 7 = 5 THEN ' (Sales)' ELSE '' END AS name FROM customer",
    "candidate_region": sql(r"""SELECT snapshot_id, line_no, md5(line) AS line FROM (SELECT *, coalesce(min(CASE WHEN stop THEN line_no END) OVER (PARTITION BY snapshot_id), 1000000000) AS til FROM
        (SELECT *, line_no > beg AND (line = 'Hide live captions' OR line = 'Chat participants' OR regexp_matches(line, '(?i)Closed captions overflow menu|More options|Calling controls')) AS stop FROM
        (SELECT *, min(CASE WHEN line = 'Live Captions' THEN line_no WHEN line = 'Ana Paz (Org)' THEN line_no - 1 END) OVER (PARTITION BY snapshot_id) AS beg FROM v))) WHERE beg IS NOT NULL AND line_no > beg AND line_no < til AND line NOT IN ('12:30', 'People', 'Live Captions')""".replace("FROM v)", """FROM
        (SELECT meeting_id AS snapshot_id, ord AS line_no, CASE WHEN ord = meeting_id % 3 THEN CASE WHEN meeting_id % 2 = 0 THEN 'Live Captions' ELSE 'Ana Paz (Org)' END WHEN ord > 8 AND (meeting_id + ord) % 5 = 0 THEN 'Hide live captions'
         WHEN (meeting_id + ord) % 7 = 0 THEN '12:30' WHEN (meeting_id + ord) % 7 = 1 THEN 'People' WHEN (meeting_id + ord) % 11 = 2 THEN 'Chat participants' ELSE 'so ' || translate(text, e'\\n():', '    ') END AS line FROM base))"""), "base"),
    "caption_predicates": f"SELECT event_id, k IN (1) AS speaker, k IN (1, 5) AS caption, k IN (6, 11) AS ui, k IN (7, 8) AS frame, k IN (9) AS blocked FROM (SELECT event_id, event_id % {len(_LINES)} + 1 AS k FROM events)",
    "chrome_items": sql("SELECT meeting_id, ord, ord % 3 IN (0, 1) OR (len(list_filter(string_split(trim(text || '.'), ' '), lambda x: x <> '')) <= 12 AND regexp_matches(lower(text), '(joined|left) the (meeting|call)|recording (has )?started')) AS chrome FROM turns", "base", "turns"),
    "root_scores": "SELECT event_id AS ord, CAST(CASE WHEN event_id % 2 = 0 THEN -50 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN -20 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN -15 ELSE 0 END + CASE WHEN event_id % 11 = 0 THEN 1000 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN -5 ELSE 0 END + CASE WHEN event_id % 4 = 0 THEN -2 ELSE 0 END AS INTEGER) AS score FROM events",
    "window_priorities": f"SELECT event_id, priority FROM (SELECT event_id, {list(_PRIORITIES.values())!r}[event_id % {len(_WINDOWS)} + 1] AS priority FROM events) WHERE priority IS NOT NULL".replace("None", "NULL"),
    "new_snapshot_lines": sql("SELECT poll, speaker, text, pos FROM s ANTI JOIN (SELECT poll + 1 AS poll, speaker, text FROM s) b USING (poll, speaker, text)".replace("FROM s", "FROM (SELECT meeting_id * 1000 + ord // 2 AS poll, speaker, CASE WHEN ord % 3 = 0 THEN 'same' ELSE md5(text) END AS text, ord AS pos FROM turns)"), "base", "turns"),
    "repair_targets": sql(f"SELECT meeting_id, string_agg(seg_id, ',' ORDER BY ord) AS seg_ids FROM (WITH {_CORRELATED} SELECT * FROM c) WHERE source <> 'mic' AND (NOT resolved OR label_margin < 0.3) AND meeting_id % 3 <> 0 GROUP BY 1", "base", "segments"),
    "roster_union": sql(f"""SELECT meeting_id, array_to_string(list_distinct_in_order, ',') AS names FROM (SELECT meeting_id, CASE WHEN meeting_id % 2 = 0 THEN list_concat(l, list_filter(['sp1', 'Guest'], lambda x: NOT list_contains(l, x))) ELSE l END AS list_distinct_in_order FROM
        (SELECT meeting_id, coalesce(list(speaker ORDER BY f) FILTER (f IS NOT NULL), []) AS l FROM (WITH {_CORRELATED} SELECT meeting_id, speaker, min(CASE WHEN resolved THEN ord END) AS f FROM c GROUP BY ALL) GROUP BY 1)) WHERE len(list_distinct_in_order) > 0""", "base", "segments"),
    "located_quotes": sql("SELECT meeting_id, ord AS quote_id, ord AS turn_ord, CASE WHEN ord % 2 = 0 THEN 'clean' ELSE 'raw' END AS place FROM turns", "base", "turns"),
    "item_validation": sql("SELECT meeting_id, count(*) FILTER (claim_ix % 3 <> 0) AS kept, count(*) FILTER (claim_ix % 3 = 0) AS dropped, CAST(sum(claim_ix % 8) FILTER (claim_ix % 3 <> 0) AS BIGINT) AS turns FROM claims GROUP BY 1", "claims"),
    "cited_cards": sql("SELECT meeting_id || '-' || ord AS answer_id, CAST(n AS INTEGER) AS n, ['M:m 1', 'N:n1', 'M:m 1:T2'][n + 1] AS ref, ['A', 'B', 'A'][n + 1] AS title, ['', '1970-01-02', ''][n + 1] AS date, ['/meeting?id=m%201', '/notes?id=n1', '/meeting?id=m%201&turn=T2'][n + 1] AS url FROM turns, (SELECT unnest([0, 1, 2]) AS n)", "base", "turns"),
    "retrieval_gate": "SELECT user_id, avg(CASE WHEN value > 30 THEN 1.0 ELSE 0 END) >= 0.7 AS passed FROM events GROUP BY 1",
    "extraction_chunks": sql("""SELECT meeting_id || '#ex#' || ['dec', 'act', 'opq', 'num'][ord % 4 + 1] || '#' || (row_number() OVER (PARTITION BY meeting_id, ord % 4 ORDER BY ord) - 1) AS key,
        ['Decisión', 'Tarea', 'Pregunta abierta', 'Cifra clave'][ord % 4 + 1] || ' (2026-07-01, reunión "Meeting ' || meeting_id || '"): ' || speaker || ' item — cita: "' || speaker || '" [T' || (ord + 1) || ']' AS text, 'T' || (ord + 1) AS turn_start FROM turns WHERE ord % 6 <> 1""", "base", "turns"),
    "chapter_chunks": "WITH RECURSIVE base AS (" + i.CTES["base"] + "), turns AS (" + i.CTES["turns"] + "), " + _TURN_WINDOWS + """
        SELECT meeting_id, meeting_id || '#ch#' || (row_number() OVER (PARTITION BY meeting_id ORDER BY c, ix) - 1) AS key, md5('Reunión: "Meeting ' || meeting_id || '" — 2026-07-01 — Capítulo: "Part ' || c || '"' || chr(10) || chr(10) || body) AS text, a AS turn_start, z AS turn_end, 'Part ' || c AS chapter_title FROM b""",
    "summary_chunks": sql("""SELECT meeting_id || '#sum#' || n AS key, 'Resumen de reunión "Meeting ' || meeting_id || '" — 2026-07-01' || chr(10) || chr(10) || ['Intro ' || meeting_id, '## One' || chr(10) || 'first', '## Two' || chr(10) || 'second'][n + 1] AS text FROM (SELECT DISTINCT meeting_id FROM turns), (SELECT unnest([0, 1, 2]) AS n)""", "base", "turns"),
    "meeting_chunks": "WITH RECURSIVE base AS (" + i.CTES["base"] + "), turns AS (" + i.CTES["turns"] + "), " + _TURN_WINDOWS + """
        SELECT meeting_id, type, n FROM (SELECT meeting_id, 'extraction' AS type, count(*) AS n FROM turns WHERE ord % 6 <> 1 GROUP BY 1 UNION ALL SELECT DISTINCT meeting_id, 'summary', 3 FROM turns UNION ALL SELECT DISTINCT meeting_id, 'digest', 1 FROM turns
            UNION ALL SELECT meeting_id, 'chapter', count(*) FROM b GROUP BY 1)""",
    "raw_prompt": sql(f"SELECT meeting_id, md5(string_agg('[s' || ord || '] [' || {_MMSS.format(s='start_time')} || '] ' || speaker || ': ' || text, chr(10) ORDER BY ord)) AS text FROM turns GROUP BY 1", "base", "turns"),
    "clean_prompt": sql(f"""SELECT meeting_id, md5(string_agg(line, chr(10) ORDER BY o, k)) AS text FROM (SELECT meeting_id, ord AS o, 1 AS k, '[T' || (ord + 1) || '] [' || {_MMSS.format(s='start_time')} || '] ' || speaker || ': ' || text AS line FROM turns
        UNION ALL SELECT meeting_id, ord, 0, '## [' || {_MMSS.format(s='start_time')} || '] Topic ' || ord FROM turns WHERE ord % 5 = 2
        UNION ALL SELECT meeting_id, 1000000, 0, '## [' || {_MMSS.format(s='max(end_time) + 60')} || '] Late' FROM turns GROUP BY meeting_id) GROUP BY 1""", "base", "turns"),
    "history_prompt": sql("SELECT meeting_id AS thread_id, md5(string_agg(CASE WHEN role = 'user' THEN 'Usuario' ELSE 'Asistente' END || ': ' || text, chr(10) ORDER BY ord)) AS text FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ord DESC) AS n FROM base) WHERE n <= 3 GROUP BY 1", "base"),
    "fragment_prompt": sql("""SELECT meeting_id AS query_id, md5(string_agg('--- Fragmento ' || CASE ord % 3 WHEN 0 THEN 'M:' || meeting_id || ':T' || ord WHEN 1 THEN 'M:' || meeting_id ELSE 'N:n' || ord END || ' (' || ['chapter', 'summary', 'note'][ord % 3 + 1] || ', '
        || strftime(make_timestamp(ord * 86400 * 1000000), '%Y-%m-%d') || ') ---' || chr(10) || text, chr(10) || chr(10) ORDER BY ord)) AS text FROM turns GROUP BY 1""", "base", "turns"),
    "model_contracts": "SELECT event_id, contract, event_id % 4 < 2 AS held, CASE WHEN event_id % 4 < 2 THEN '' WHEN event_id % 4 = 3 THEN '$' ELSE place END AS place, CASE WHEN event_id % 4 < 2 THEN told END AS told FROM events, (SELECT unnest("
    + _cases(list(_ANSWERS)) + ") AS contract, unnest(" + _cases([x[2] for x in _ANSWERS.values()]) + ") AS place, unnest(" + _cases([x[3] for x in _ANSWERS.values()]) + ") AS told)",
    "quote_exists": sql(f"""SELECT meeting_id, ord, {_containment('n', 'h')} >= 0.8 AS exists FROM (SELECT meeting_id, ord, {i.tokens('q')} AS n, {i.tokens('text')} AS h FROM
        (SELECT a.meeting_id, a.ord, a.text, CASE WHEN a.ord % 3 = 0 THEN array_to_string(string_split(b.text, ' ')[1:6], ' ') ELSE translate(array_to_string(string_split(a.text, ' ')[1:6], ' '), '{_SMALL}', '{_SMALL.upper()}') END AS q FROM turns a JOIN turns b ON a.meeting_id = b.meeting_id AND b.ord = a.ord + 1))""", "base", "turns"),
}
