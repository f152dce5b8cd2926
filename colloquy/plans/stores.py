"""Queries of search, citations, keyed tables, list filters and overlays."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as tx
from ..functions import values as v
from ..operators import analytics, citations, exports, intervals, search
from ..sources import recordings, replay, tables
from ..sources.work import work_folder
from ..streaming import revisions, views
from . import inputs as i
from .inputs import sql

R6 = lambda c: F.round(c, 6).alias(c)


def _vectors(spark, d):
    k = F.col("vec_id")
    kinds = F.element_at(F.lit(["chapter", "summary", "note", "extraction"]), (k % 4 + 1).cast("int"))
    return i.read(spark, d, "embeddings").select(k.alias("key"), "label", kinds.alias("type"), F.concat(F.lit("u"), k % 3).alias("owner_sub"), (k * 86400).alias("date_epoch"), "embedding")


VECTORS = "v AS (SELECT vec_id AS key, label, ['chapter', 'summary', 'note', 'extraction'][vec_id % 4 + 1] AS type, 'u' || (vec_id % 3) AS owner_sub, vec_id * 86400 AS date_epoch, embedding::DOUBLE[] AS e FROM embeddings)"


def _query(spark, d):
    return [float(x) for x in i.read(spark, d, "embeddings").filter("vec_id = 7").select("embedding").first()[0]]


def vector_topk(spark, d):
    return search.top_k(_vectors(spark, d), _query(spark, d), F.lit(True), 15).select("key", R6("distance"))


def filtered_topk(spark, d):
    where = search.search_filter("u1", ["note", "chapter"], 0, 300 * 86400)
    return search.top_k(_vectors(spark, d), _query(spark, d), where, 15).select("key", "type", "owner_sub", R6("distance"))


def _hits(spark, d):
    v_ = _vectors(spark, d)
    queries = v_.filter("key % 50 = 0").select(F.col("key").alias("query_id"), F.col("embedding").alias("query"))
    return search.top_k_join(v_, queries, 5)


def topk_join(spark, d):
    return _hits(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "key", R6("distance"))


def hit_at_k_mrr(spark, d):
    labels = _vectors(spark, d).select("key", "label")
    asked = labels.filter("key % 50 = 0").select(F.col("key").alias("query_id"), "label")
    m = search.labelled_metrics(_hits(spark, d), asked, labels)
    return m.select(*(R6(c) for c in ("hit_at_1", "hit_at_3", "hit_at_5", "mrr")), "questions")


def _keys(spark, d):
    o = i.read(spark, d, "orders")
    prev = o.groupBy(F.col("o_custkey").cast("string").alias("doc")).agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("keys"), (F.min("o_custkey") % 5).alias("index_version"))
    new = o.filter("o_orderkey % 3 <> 0").groupBy(F.col("o_custkey").cast("string").alias("doc")).agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("keys"), F.lit(1).alias("index_version"))
    return prev, new


def stale_keys(spark, d):
    rows = search.stale_keys(*_keys(spark, d))
    return rows.select("doc", F.array_join("stale", ",").alias("stale"), F.array_join("put", ",").alias("put"))


def reconcile(spark, d):
    prev, new = _keys(spark, d)
    old = prev.select("doc", F.explode("keys").alias("key"), F.lit("old").alias("state"))
    fresh = new.select("doc", F.explode("keys").alias("key"), F.lit("new").alias("state"))
    return search.reconcile(old, prev, fresh, new).select("doc", "key", "state")


def index_eligibility(spark, d):
    m = i.read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "capturing").otherwise("ready").alias("status"), (F.col("o_custkey") % 3).alias("index_version"))
    return search.needs_indexing(m, 2).groupBy("action").agg(F.count("*").alias("n"))


def _answers(spark, d):
    t = i.turns(spark, d)
    text = F.concat(F.lit("See [M:"), F.col("meeting_id"), F.lit(":T1] and [N:"), F.col("ord"), F.lit("]  then [M:none]."))
    answers = t.select(F.concat_ws("-", "meeting_id", "ord").alias("answer_id"), text.alias("text"), "meeting_id", "ord")
    hits = answers.select("answer_id", F.lit(1).alias("rank"), F.lit("chapter").alias("type"), F.col("meeting_id").cast("string").alias("meeting_id"), F.lit(None).cast("string").alias("note_id"), F.lit("A title").alias("title"), (F.col("meeting_id") * 86400).alias("date_epoch")).unionByName(
        answers.filter("ord % 2 = 0").select("answer_id", F.lit(2).alias("rank"), F.lit("note").alias("type"), F.lit(None).cast("string").alias("meeting_id"), F.col("ord").cast("string").alias("note_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("long").alias("date_epoch")))
    return answers.select("answer_id", "text"), hits


def answer_texts(spark, d):
    return citations.resolve_citations(*_answers(spark, d))[0].select("answer_id", "text")


def answer_citations(spark, d):
    cited = citations.resolve_citations(*_answers(spark, d))[1]
    return cited.select("answer_id", "ref", "kind", "id", F.coalesce("turn", F.lit("")).alias("turn"), "title", "date", "url")


def keyset_page(spark, d):
    return tables.page(i.read(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 50, ["1995-06-01 00:00:00", 500]).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def prefix_scan(spark, d):
    return tables.prefix_scan(i.read(spark, d, "part"), "p_name", "red").select("p_partkey", "p_name")


def insert_if_absent(spark, d):
    """Events race for (user, type); a third of the keys is taken already."""
    e = i.read(spark, d, "events").select("user_id", "event_type", "event_id")
    taken = e.filter("user_id % 3 = 0").groupBy("user_id", "event_type").agg(F.lit(-1).cast("long").alias("event_id"))
    return tables.put_if_absent(taken, e, ["user_id", "event_type"], ["event_id"])[0]


def seq_dedupe(spark, d):
    """Batches sent up to three times; the first to arrive counts."""
    e = i.read(spark, d, "events")
    sent = e.select(F.col("user_id").alias("meeting_id"), (F.col("event_id") % 40).alias("seq"), F.col("event_id").alias("arrival"), F.array_repeat(F.col("event_type"), (F.col("event_id") % 4).cast("int")).alias("segments"))
    stored = sent.filter("seq = 0").groupBy("meeting_id", "seq").agg(F.array(F.lit("kept")).alias("segments"))
    return tables.append_batches(stored, sent)[1].select("meeting_id", F.col("segment_count").cast("long").alias("segment_count"))


def put_overwrite(spark, d):
    c = i.read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return tables.put(c, c.filter("c_custkey % 4 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


def partial_update(spark, d):
    c = i.read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    patch = c.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("c_name"), (F.col("c_custkey") % 4 == 0).alias("c_name_set"), F.lit(None).cast("string").alias("c_mktsegment"), F.lit(True).alias("c_mktsegment_set"))
    return tables.update(c, patch, ["c_custkey"], ["c_name", "c_mktsegment"])


def cascade_delete(spark, d):
    gone = i.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    left = tables.delete_cascade(gone, ["k"], orders=i.read(spark, d, "orders").select(F.col("o_orderkey").alias("k")), lines=i.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")))
    return left["orders"].select(F.lit("orders").alias("part"), "k").unionByName(left["lines"].select(F.lit("lines").alias("part"), "k")).groupBy("part").agg(F.count("*").alias("n"))


def live_segments(spark, d):
    s = i.segments(spark, d)
    packed = s.groupBy("meeting_id", F.floor(F.col("ord") / 3).alias("seq")).agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("segments"))
    rows = tables.live_segments(packed.withColumn("segments", F.transform("segments", lambda x: F.struct(x["label"].alias("label")))))
    return rows.select("meeting_id", F.col("ord").cast("long").alias("ord"), "label")


def read_fallback(spark, d):
    s = i.segments(spark, d).select("meeting_id", "ord", F.lit("live").alias("from"))
    return tables.with_fallback(s.filter("meeting_id % 2 = 0 AND ord < 2").withColumn("from", F.lit("artifact")), s, ["meeting_id"])


def existence(spark, d):
    return tables.with_existence(i.read(spark, d, "customer").select("c_custkey"), i.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


def users_group(spark, d):
    users = i.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    members = i.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("group"))
    return tables.users_with_group(users, members, "BUILDING")


def meeting_filter(spark, d):
    o = i.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("meeting_id"), F.concat(F.lit("Reunión "), "o_orderpriority").alias("title"), F.array(F.concat(F.lit("user"), F.col("o_custkey") % 7)).alias("participants"),
        F.array(F.col("o_orderpriority")).alias("labels"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 10 == 0).alias("removed"), F.col("o_orderdate").cast("timestamp").alias("started_at"),
    )
    rows = analytics.filter_meetings(o, "REUNION", "1994-01-01", "1997-12-31", ["user1", "user2"], None, ["O", "F"])
    return rows.select("meeting_id", "title", "status")


def overlay(spark, d):
    t = i.speaker_turns(spark, d)
    patches = t.filter("ord % 2 = 0").select("meeting_id", "id", F.when(F.col("ord") % 4 == 0, "edited text").alias("new_text"), F.when(F.col("ord") % 3 == 0, F.array(F.lit("x"))).alias("new_tags"), (F.col("ord") == 6).alias("deleted"))
    return analytics.overlay(t, patches).select("meeting_id", "id", F.md5("text").alias("text_md5"), F.array_join("tags", ",").alias("tags"), "edited")


def status_patch(spark, d):
    m = i.read(spark, d, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.when(F.col("o_orderstatus") == "O", "ready").otherwise("capturing").alias("status"))
    p = m.select("meeting_id", F.lit("processing").alias("patch_status"), (F.col("meeting_id") % 240).alias("patched_at"))
    return analytics.patched_status(m, p, F.lit(240))


def label_usage(spark, d):
    return analytics.label_usage(i.speaker_turns(spark, d), "tags")


def label_rename(spark, d):
    """Renaming to a label that is there already leaves it twice, as the assignments are only mapped."""
    o = i.read(spark, d, "customer").select("c_custkey", F.array(F.col("c_mktsegment"), F.lit("keep")).alias("labels"))
    return analytics.rename_label(o, "BUILDING", "keep").select("c_custkey", F.array_join("labels", ",").alias("labels"))


def participants(spark, d):
    """Names of a region in Spanish order: ñ is a letter of its own after n, case and accents come last."""
    name = F.initcap(F.substring_index("n_name", " ", 1))
    made = F.array(name, F.lower(name), F.concat(F.lit("Ñ"), F.lower(name)), F.concat(F.lit("N"), F.lower(name)), F.concat(F.lit("Á"), F.lower(name)), F.concat(F.lit("Nz"), F.lower(name)))
    return analytics.participants(i.read(spark, d, "nation").select(F.col("n_regionkey").alias("region"), made.alias("participants")), keys=("region",))


def tag_filter(spark, d):
    return analytics.tagged(i.speaker_turns(spark, d), ["key"]).select("meeting_id", "ord")


def history_window(spark, d):
    m = i.turns(spark, d).withColumnRenamed("meeting_id", "thread_id")
    return analytics.history_window(m, 3).select("thread_id", "ord", "speaker")


def entry_names(spark, d):
    e = i.read(spark, d, "part").select((F.col("p_partkey") - 1).alias("ord"), tx.slug("p_brand").alias("base"))
    return analytics.entry_names(e).select("ord", "name")


def orphan_captures(spark, d):
    c = i.read(spark, d, "customer").select(F.col("c_custkey").alias("capture_id"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("segments"), F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit(1))).alias("captions"))
    return analytics.orphans(c, c.filter("capture_id % 3 = 0").select("capture_id"), c.filter("capture_id % 7 = 0").select("capture_id")).select("capture_id")


def audio_declaration(spark, d):
    """Sources listed in any order, with unknown ones among them."""
    listed = F.concat(F.when(F.col("event_id") % 2 == 0, F.array(F.lit("mic"))).otherwise(F.array(F.lit("camera"))), F.when(F.col("event_id") % 5 < 3, F.array(F.lit("tab"), F.lit("mic"))).otherwise(F.array().cast("array<string>")))
    a = analytics.audio_declaration(listed, F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value") * 1000 - 5000))
    return i.read(spark, d, "events").select("event_id", a["duration_sec"].alias("duration_sec"), F.array_join(a["sources"], ",").alias("sources"))


def debounce(spark, d):
    """Presence of a user: events below 50 say absent."""
    e = i.events(spark, d).groupBy("user_id", F.unix_timestamp("ts").alias("t")).agg((F.max("value") >= 50).alias("state"))
    rows = intervals.debounced(e, ["user_id"], "t", "state", 3600, 7200)
    return rows.select("user_id", "since", F.coalesce("until", F.lit(-1)).alias("until"), "state")


def learned_chrome(spark, d):
    polls = i.base(spark, d).select("meeting_id", F.col("ord").alias("poll"), (F.col("c0") / 100).alias("t"), F.col("role").alias("chunk"), (F.col("words") > 120).alias("caption_like"))
    return views.learned_chrome(polls)


def replayed_captions(spark, d):
    rows = i.events(spark, d).select(F.col("user_id").cast("string").alias("meeting_id"), F.col("event_id").alias("ord"), "ts", F.lit("x").alias("speaker"), F.concat("event_type", F.lit(" "), F.floor("value")).alias("text"))
    return revisions.replay_captions(rows).select("meeting_id", "speaker", "text", F.unix_millis("ts").alias("ms"))


def action_boxes(spark, d):
    a = i.turns(spark, d).select("meeting_id", F.col("ord").alias("i"), F.col("speaker").alias("text"))
    done = a.filter("i = 1").select("meeting_id", F.create_map(F.lit("1"), F.lit(True), F.lit("2"), F.lit(False)).alias("states"))
    return exports.action_boxes(a, done)


def archive_entries(spark, d):
    return tables.archive_entries(i.read(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("content"))).select("page_id", "size", "crc32")


def archive_sizes(spark, d):
    """Bytes of the entries of an archive of all pages by host."""
    entries = tables.archive_entries(i.read(spark, d, "pages").select(F.element_at(F.split("url", "/"), 3).alias("host"), F.coalesce("html", F.lit("")).alias("content")))
    return entries.groupBy("host").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def metrics_sink(spark, d):
    """Points are appended by day in two writes, and counted again."""
    path = work_folder(spark, "metrics")
    e = i.events(spark, d).select("ts", F.col("event_type").alias("name"), "value")
    replay.append_metrics(e.filter("name = 'error'"), path)
    replay.append_metrics(e.filter("name <> 'error'"), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def roster_samples(spark, d):
    """Every tenth reading of a user, by order."""
    e = i.events(spark, d)
    polls = e.select(F.col("user_id").alias("meeting_id"), "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("poll"))
    return replay.every_nth(polls).select("meeting_id", "event_id", "poll")


def followed_recording(spark, d):
    """Events as a recorder's JSON lines, read by the source that follows growing files, in stretches of 64 KB."""
    path = work_folder(spark, "followed")
    e = i.events(spark, d).select(F.col("user_id").cast("string").alias("meeting_id"), F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("speaker"), "props")
    e.select("meeting_id", "ord", "ts", "speaker", F.col("props").alias("text")).write.json(path)
    out = work_folder(spark, "followed-out")
    query = replay.append_stream(recordings.follow(spark, "captions", path, 1 << 16), out, f"{out}-checkpoint", None)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.parquet(out).select("meeting_id", "ord", "speaker", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.md5("text").alias("text"))


def lazy_table(spark, d):
    """A table that is made when it is first needed: asking again changes nothing."""
    name = f"colloquy_lazy_{uuid.uuid4().hex}"
    tables.ensure_table(spark, name, "key BIGINT, brand STRING")
    i.read(spark, d, "part").select("p_partkey", "p_brand").write.insertInto(name)
    tables.ensure_table(spark, name, "key BIGINT, brand STRING")
    path = work_folder(spark, "lazy")
    spark.table(name).groupBy("brand").agg(F.count("*").alias("n")).write.parquet(path)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(path)


def sortable_ids(spark, d):
    return i.read(spark, d, "events").select("event_id", v.id_time(F.col("event_id") * 1_000_003).alias("prefix"))


def note_model(spark, d):
    """The note contract with a stub model: a title longer than may be is cut, and answers fail first, with a blank title, for texts with a digit 1."""
    import json

    def stub(prompt, fault):
        return json.dumps({"title": prompt if fault or "1" not in prompt else " ", "cleanText": prompt})

    rows = i.turns(spark, d).select("meeting_id", "ord", F.col("text").alias("prompt"))
    return models.call(rows, "clean_note", stub).select("meeting_id", "ord", "result.title", "error")


def text_vectors(spark, d):
    e = models.embed(i.turns(spark, d))
    at = lambda k: F.round(F.element_at("embedding", k).cast("double"), 5)
    return e.select("meeting_id", "ord", F.size("embedding").alias("size"), at(1).alias("first"), at(18).alias("middle"), at(1024).alias("last"))


QUERIES = {f.__name__: f for f in (
    vector_topk, filtered_topk, topk_join, hit_at_k_mrr, stale_keys, reconcile, index_eligibility, answer_texts, answer_citations, keyset_page, prefix_scan, insert_if_absent, seq_dedupe,
    put_overwrite, partial_update, cascade_delete, live_segments, read_fallback, existence, users_group, meeting_filter, overlay, status_patch, label_usage, label_rename, participants, tag_filter,
    history_window, entry_names, orphan_captures, audio_declaration, debounce, learned_chrome, replayed_captions, action_boxes, archive_entries, archive_sizes, metrics_sink, roster_samples, followed_recording, lazy_table, sortable_ids, note_model, text_vectors,
)}

_DIST = "round(1 - list_cosine_similarity(e, (SELECT e FROM v WHERE key = 7)), 6)"
_HITS = "hits AS (SELECT * FROM (SELECT q.key AS query_id, v.key, 1 - list_cosine_similarity(q.e, v.e) AS distance, row_number() OVER (PARTITION BY q.key ORDER BY 1 - list_cosine_similarity(q.e, v.e), v.key) AS rank FROM v q, v WHERE q.key % 50 = 0) WHERE rank <= 5)"
_KEYS = """p AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, list(DISTINCT CAST(o_orderkey AS VARCHAR)) AS old, o_custkey % 5 AS v0 FROM orders GROUP BY o_custkey),
n AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, list(DISTINCT CAST(o_orderkey AS VARCHAR)) AS new FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey),
k AS (SELECT doc, list_sort(CASE WHEN v0 = 1 OR new IS NULL THEN list_filter(old, lambda x: NOT list_contains(coalesce(new, []), x)) ELSE old END) AS stale, list_sort(coalesce(new, [])) AS put, old FROM p LEFT JOIN n USING (doc))"""
ORACLES = {
    "vector_topk": f"WITH {VECTORS} SELECT key, {_DIST} AS distance FROM v ORDER BY 1 - list_cosine_similarity(e, (SELECT e FROM v WHERE key = 7)), key LIMIT 15",
    "filtered_topk": f"WITH {VECTORS} SELECT key, type, owner_sub, {_DIST} AS distance FROM v WHERE (type <> 'note' OR owner_sub = 'u1') AND type IN ('note', 'chapter') AND date_epoch BETWEEN 0 AND 300 * 86400 ORDER BY 1 - list_cosine_similarity(e, (SELECT e FROM v WHERE key = 7)), key LIMIT 15",
    "topk_join": f"WITH {VECTORS}, {_HITS} SELECT query_id, rank, key, round(distance, 6) AS distance FROM hits",
    "hit_at_k_mrr": f"""WITH {VECTORS}, {_HITS}, g AS (SELECT q.key AS query_id, v.key AS expected FROM v q JOIN v ON q.label = v.label AND q.key <> v.key WHERE q.key % 50 = 0),
        r AS (SELECT query_id, min(rank) AS rank FROM g LEFT JOIN hits h USING (query_id) WHERE h.key = expected OR h.key IS NULL GROUP BY 1), a AS (SELECT DISTINCT g.query_id, r.rank FROM g LEFT JOIN r USING (query_id))
        SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_at_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, count(*) AS questions FROM a""",
    "stale_keys": f"WITH {_KEYS} SELECT doc, coalesce(array_to_string(stale, ','), '') AS stale, coalesce(array_to_string(put, ','), '') AS put FROM k",
    "reconcile": f"WITH {_KEYS} SELECT doc, key, CASE WHEN list_contains(put, key) THEN 'new' ELSE 'old' END AS state FROM (SELECT doc, stale, put, unnest(old) AS key FROM k) WHERE list_contains(put, key) OR NOT list_contains(stale, key)",
    "index_eligibility": "SELECT CASE WHEN o_orderstatus = 'O' OR o_custkey % 3 = 2 THEN 'skip' ELSE 'index' END AS action, count(*) AS n FROM orders GROUP BY 1",
    "answer_texts": sql("SELECT meeting_id || '-' || ord AS answer_id, CASE WHEN ord % 2 = 0 THEN 'See [M:' || meeting_id || ':T1] and [N:' || ord || '] then .' ELSE 'See [M:' || meeting_id || ':T1] and then .' END AS text FROM turns", "base", "turns"),
    "answer_citations": sql("""SELECT meeting_id || '-' || ord AS answer_id, 'M:' || meeting_id || ':T1' AS ref, 'M' AS kind, CAST(meeting_id AS VARCHAR) AS id, 'T1' AS turn, 'A title' AS title, CASE WHEN meeting_id = 0 THEN '' ELSE strftime(make_timestamp(meeting_id * 86400 * 1000000), '%Y-%m-%d') END AS date, '/meeting?id=' || meeting_id || '&turn=T1' AS url FROM turns
        UNION ALL SELECT meeting_id || '-' || ord, 'N:' || ord, 'N', CAST(ord AS VARCHAR), '', '', '', '/notes?id=' || ord FROM turns WHERE ord % 2 = 0""", "base", "turns"),
    "keyset_page": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' OR (o_orderdate = TIMESTAMP '1995-06-01' AND o_orderkey < 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "prefix_scan": "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')",
    "insert_if_absent": "SELECT user_id, event_type, CASE WHEN user_id % 3 = 0 THEN -1 ELSE min(event_id) END AS event_id FROM events GROUP BY user_id, event_type",
    "seq_dedupe": "SELECT meeting_id, CAST(sum(n) AS BIGINT) AS segment_count FROM (SELECT user_id AS meeting_id, event_id % 40 AS seq, CASE WHEN event_id % 40 = 0 THEN 1 ELSE min(event_id) % 4 END AS n FROM events GROUP BY user_id, event_id % 40) GROUP BY 1",
    "put_overwrite": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_acctbal FROM customer",
    "partial_update": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey % 2 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer",
    "cascade_delete": "SELECT 'orders' AS part, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "live_segments": sql("SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) - 1 AS ord, label FROM segments", "base", "segments"),
    "read_fallback": sql("SELECT meeting_id, ord, CASE WHEN meeting_id % 2 = 0 AND has THEN 'artifact' ELSE 'live' END AS \"from\" FROM (SELECT *, bool_or(ord < 2) OVER (PARTITION BY meeting_id) AS has FROM segments) WHERE NOT (meeting_id % 2 = 0 AND has AND ord >= 2)", "base", "segments"),
    "existence": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS exists FROM customer",
    "users_group": "SELECT c_custkey AS user_id, c_name AS user_name, c_mktsegment = 'BUILDING' AS in_group FROM customer ORDER BY c_name, c_custkey LIMIT 60",
    "meeting_filter": "SELECT o_orderkey AS meeting_id, 'Reunión ' || o_orderpriority AS title, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 0 AND o_custkey % 7 IN (1, 2) AND o_orderstatus IN ('O', 'F') AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'",
    "overlay": sql("SELECT meeting_id, 'T' || (ord + 1) AS id, md5(CASE WHEN ord % 4 = 0 THEN 'edited text' ELSE text END) AS text_md5, CASE WHEN ord % 6 = 0 THEN 'x' WHEN ord % 3 = 0 THEN 'key' ELSE '' END AS tags, ord % 4 = 0 AS edited FROM turns WHERE ord <> 6", "base", "turns"),
    "status_patch": "SELECT o_orderkey AS meeting_id, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN 240 - o_orderkey % 240 < 120 THEN 'processing' ELSE 'ready' END ELSE 'capturing' END AS status FROM orders",
    "label_usage": sql("SELECT 'key' AS label, count(*) AS uses FROM turns WHERE ord % 3 = 0", "base", "turns"),
    "label_rename": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'keep,keep' ELSE c_mktsegment || ',keep' END AS labels FROM customer",
    "participants": """SELECT region, name, CAST(row_number() OVER (PARTITION BY region ORDER BY name COLLATE es, name) AS INTEGER) AS place FROM (SELECT DISTINCT region, unnest([upper(n[1]) || n[2:], n, 'Ñ' || n, 'N' || n, 'Á' || n, 'Nz' || n]) AS name
        FROM (SELECT n_regionkey AS region, lower(string_split(n_name, ' ')[1]) AS n FROM nation))""",
    "tag_filter": sql("SELECT meeting_id, ord FROM turns WHERE ord % 3 = 0", "base", "turns"),
    "history_window": sql("SELECT meeting_id AS thread_id, ord, speaker FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ord DESC) AS n FROM turns) WHERE n <= 3", "base", "turns"),
    "entry_names": "SELECT ord, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY ord) > 1 THEN base || '-' || (ord + 1) ELSE base END AS name FROM (SELECT p_partkey - 1 AS ord, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM part)",
    "orphan_captures": "SELECT c_custkey AS capture_id FROM customer WHERE (c_custkey % 2 = 0 OR c_custkey % 5 = 0) AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 0",
    "audio_declaration": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(least(greatest(floor(value * 1000 - 5000 + 0.5), 0), 86400) AS BIGINT) END AS duration_sec, concat_ws(',', CASE WHEN event_id % 5 < 3 THEN 'tab' END, CASE WHEN event_id % 2 = 0 OR event_id % 5 < 3 THEN 'mic' END) AS sources FROM events",
    "debounce": """WITH e AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, max(value) >= 50 AS state FROM events GROUP BY ALL), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t) AS run FROM (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY user_id ORDER BY t) IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS b FROM e)),
        g AS (SELECT user_id, run, min(t) AS since, max(t) AS last, any_value(state) AS state FROM r GROUP BY ALL),
        s AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY since), false) AS before FROM g WHERE last - since >= CASE WHEN state THEN 3600 ELSE 7200 END)
        SELECT user_id, since, coalesce(lead(since) OVER (PARTITION BY user_id ORDER BY since), -1) AS until, state FROM s WHERE before <> state""",
    "replayed_captions": """WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS meeting_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, ts, event_type || ' ' || CAST(floor(value) AS BIGINT) AS text FROM events),
        s AS (SELECT meeting_id, k, text AS p, ts AS since, ts AS changed, CAST(NULL AS VARCHAR) AS pub, ts AS pub_ts FROM o WHERE k = 1
        UNION ALL SELECT meeting_id, k, CASE WHEN (grows AND length(text) <= length(p)) OR (back AND NOT grows) THEN p ELSE text END, CASE WHEN grows OR back THEN since ELSE ts END,
            CASE WHEN (grows AND length(text) <= length(p)) OR (back AND NOT grows) THEN changed ELSE ts END, CASE WHEN NOT (grows OR back) THEN p END, since
        FROM (SELECT o.meeting_id, o.k, o.text, o.ts, s.p, s.since, s.changed, fresh AND (starts_with(o.text, s.p) OR levenshtein(s.p, o.text) <= floor(0.4 * greatest(length(s.p), length(o.text)) + 1e-9)) AS grows,
                fresh AND (starts_with(s.p, o.text) OR levenshtein(s.p, o.text) <= floor(0.4 * greatest(length(s.p), length(o.text)) + 1e-9)) AS back
              FROM (SELECT *, true AS t FROM s) s JOIN o ON o.meeting_id = s.meeting_id AND o.k = s.k + 1, LATERAL (SELECT o.ts - s.changed < INTERVAL 2 SECOND AS fresh)))
        SELECT meeting_id, 'x' AS speaker, pub AS text, CAST(epoch_us(pub_ts) // 1000 AS BIGINT) AS ms FROM s WHERE pub IS NOT NULL
        UNION ALL SELECT meeting_id, 'x', arg_max(p, k), CAST(epoch_us(arg_max(since, k)) // 1000 AS BIGINT) FROM s GROUP BY meeting_id""",
    "learned_chrome": sql("SELECT DISTINCT meeting_id, chunk FROM (SELECT meeting_id, chunk, run, min(t) FILTER (words <= 120) AS t0, max(t) FILTER (words <= 120) AS t1 FROM (SELECT meeting_id, role AS chunk, words, c0 / 100.0 AS t, ord - row_number() OVER (PARTITION BY meeting_id, role ORDER BY ord) AS run FROM base) GROUP BY ALL) WHERE t0 < 3 OR t1 - t0 >= 15", "base"),
    "archive_sizes": "SELECT string_split(url, '/')[3] AS host, count(*) AS entries, CAST(sum(octet_length(encode(coalesce(html, '')))) AS BIGINT) AS bytes FROM pages GROUP BY 1",
    "metrics_sink": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "roster_samples": "SELECT user_id AS meeting_id, event_id, CAST(poll AS INTEGER) AS poll FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS poll FROM events) WHERE poll % 10 = 0",
    "followed_recording": "SELECT CAST(user_id AS VARCHAR) AS meeting_id, event_id AS ord, event_type AS speaker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, md5(props) AS text FROM events",
    "lazy_table": "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1",
    "sortable_ids": "SELECT event_id, array_to_string(list_transform(range(9, -1, -1), lambda k: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST((event_id * 1000003 // CAST(pow(32, k) AS BIGINT)) % 32 AS INTEGER) + 1, 1)), '') AS prefix FROM events",
    "note_model": sql("SELECT meeting_id, ord, CASE WHEN trim(text) <> '' THEN substr(trim(text), 1, 60) END AS title, CASE WHEN trim(text) = '' THEN '$.title: empty' END AS error FROM turns", "base", "turns"),
    "action_boxes": sql("SELECT meeting_id, ord AS i, CASE WHEN ord = 1 THEN '- [x] ' ELSE '- [ ] ' END || speaker AS line FROM turns", "base", "turns"),
    "text_vectors": sql("""SELECT meeting_id, ord, 1024 AS size, round(b[1] / norm, 5) AS first, round(b[18] / norm, 5) AS middle, round(b[32] / norm, 5) AS last FROM
        (SELECT *, sqrt(32 * list_sum(list_transform(b, lambda x: x * x))) AS norm FROM (SELECT meeting_id, ord, list_transform(range(0, 32), lambda k: CAST(('0x' || substr(h, 2 * k + 1, 2)) AS INTEGER) - 127.5::DOUBLE) AS b FROM (SELECT meeting_id, ord, sha256(text) AS h FROM turns)))""", "base", "turns"),
}
