"""Queries of text functions, chunking, captions and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as v
from ..operators import captions as cp
from ..operators import chunking, exports
from . import inputs as i
from .inputs import sql


def normalize_tokens(spark, d):
    return i.read(spark, d, "documents").select("doc_id", F.md5(F.coalesce(tx.normalize("text"), F.lit(""))).alias("form"), F.size(tx.tokens("text")).cast("long").alias("n_tokens"))


def number_audit(spark, d):
    """Numbers of each document against those of the next id."""
    docs = i.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return pairs.select("doc_id", join(F.array_except(tx.numbers("text"), tx.numbers("other"))).alias("missing"), join(F.array_except(tx.numbers("other"), tx.numbers("text"))).alias("introduced"))


def negation_audit(spark, d):
    return i.read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(tx.negations("text")), ",").alias("negations"))


def levenshtein_sim(spark, d):
    """Each line against the next one, whole; letters beyond ASCII count as one and the same, as the oracle's distance counts bytes."""
    a = i.lines(spark, d).select("doc_id", "ord", F.regexp_replace("text", "[^ -~]", "?").alias("text"))
    pairs = a.join(a.select("doc_id", (F.col("ord") - 1).alias("ord"), F.col("text").alias("after")), ["doc_id", "ord"])
    return pairs.select("doc_id", "ord", F.round(tx.similarity("text", "after"), 6).alias("similarity"))


def revision(spark, d):
    """Whether a line continues, or corrects, its own first part; and the same for the line and its reverse."""
    # files may be few, or hold the long lines together
    a = i.lines(spark, d).select("doc_id", "ord", F.regexp_replace("text", "[^ -~]", "?").alias("text")).repartition("doc_id", "ord")
    cut = F.left("text", (F.length("text") * F.lit(2) / 5).cast("int"))
    form = lambda c: F.lower(tx.comparable(c))
    forms = a.select("doc_id", "ord", form(cut).alias("part"), form("text").alias("whole"), form(F.reverse("text")).alias("back"))
    return forms.select("doc_id", "ord", tx.goes_on("part", "whole").alias("grows"), tx.goes_on("whole", "back").alias("reversed"))


def turn_anchors(spark, d):
    marked = F.regexp_replace("text", r"(\w)\.", "$1 [T1]. [T23]")
    return i.turns(spark, d).select("meeting_id", "ord", F.array_join(tx.turn_anchors(marked), ",").alias("anchors"), F.md5(tx.strip_anchors(marked)).alias("plain"))


def references(spark, d):
    """Markers with blanks and colons in their ids, repeated ones, notes with what looks like a turn, and faulty ones."""
    text = F.concat(F.lit("[M:a:T"), "ord", F.lit("] "), "text", F.lit(" [N:x "), "meeting_id", F.lit("] [M:b 18:48:"), "ord", F.lit("] [N:q:T3] [M:a:T"), "ord", F.lit("] [M:] [X:y]"))
    rows = i.turns(spark, d).select("meeting_id", "ord", F.posexplode(tx.references(text)).alias("n", "r"))
    return rows.select("meeting_id", "ord", "n", "r.ref", "r.kind", "r.id", "r.turn")


def slug(spark, d):
    return i.lines(spark, d).select("doc_id", "ord", tx.slug("text").alias("slug"))


def html_escape(spark, d):
    return i.read(spark, d, "pages").select("page_id", F.md5(tx.html_escape(F.coalesce("html", F.lit("")))).alias("escaped"))


def initials(spark, d):
    return i.read(spark, d, "customer").select("c_custkey", tx.initials(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("initials"))


def safe_names(spark, d):
    return i.read(spark, d, "pages").select("page_id", tx.safe_name("url").alias("name"), tx.hashed_name("idx-", "url").alias("hashed"))


def clock_format(spark, d):
    t = i.turns(spark, d)
    return t.select("meeting_id", "ord", v.mmss(F.col("start_time")).alias("mmss"), v.clock(F.col("end_time") * 31).alias("clock"), v.duration(F.col("end_time") * 7).alias("duration"), v.duration(F.col("ord") * 29.9 + 59.6).alias("edge"))


def title_cut(spark, d):
    return i.lines(spark, d).select("doc_id", "ord", tx.title_of("text").alias("title"))


def word_counts(spark, d):
    return i.read(spark, d, "documents").select("doc_id", tx.word_count("text").alias("words"), tx.estimated_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def first_paragraph(spark, d):
    text = F.concat(F.lit("# Title\n\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")))
    return i.read(spark, d, "documents").select("doc_id", F.md5(tx.first_paragraph(text)).alias("paragraph"))


def summary_sections(spark, d):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n## "))
    rows = i.read(spark, d, "documents").select("doc_id", F.posexplode(tx.summary_sections(text)).alias("n", "s"))
    return rows.select("doc_id", "n", F.md5("s").alias("section"))


def paragraph_chunks(spark, d):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    rows = i.read(spark, d, "documents").select("doc_id", F.posexplode(chunking.paragraph_windows(text)).alias("n", "w"))
    return rows.select("doc_id", "n", F.length("w").cast("long").alias("length"), F.md5("w").alias("body"))


def turn_windows(spark, d):
    rows = i.lines(spark, d).withColumn("tokens", tx.estimated_tokens("text"))
    return chunking.turn_windows(rows, ("doc_id",))


def system_notice(spark, d):
    """Lines as they are, every seventh as the last words before a notice."""
    text = F.when(F.col("ord") % 7 == 3, F.concat(F.element_at(F.split("text", " "), -1), F.lit(" Joined the MEETING"))).otherwise(F.col("text"))
    return i.lines(spark, d).select("doc_id", "ord", cp.is_notice(text).alias("notice"))


def roster_label(spark, d):
    """Whole lines, and the first words of each in capitals."""
    upper = F.upper(F.replace(F.substring_index("text", " ", 3), F.lit("ß"), F.lit("s")))
    return i.lines(spark, d).select("doc_id", "ord", cp.is_roster_label("text").alias("line"), cp.is_roster_label(upper).alias("capitals"))


def meeting_surface(spark, d):
    parts = F.concat_ws(" ", F.when(F.col("event_id") % 2 == 0, "Leave"), F.when(F.col("event_id") % 3 == 0, "share content"), F.when(F.col("event_id") % 5 == 0, "Raise your hand"), F.when(F.col("event_id") % 7 == 0, "People"))
    return i.read(spark, d, "events").select("event_id", cp.surface_score(parts).alias("score"), cp.is_meeting_surface(parts).alias("surface"))


def clean_title(spark, d):
    """Titles with counters, prefixes and the application's suffix, others with bars of their own, and the application's surfaces."""
    k = F.col("p_partkey")
    title = (
        F.when(k % 4 == 0, F.concat(F.lit("("), (k % 5).cast("string"), F.lit(") "), "p_name", F.lit(" | Microsoft Teams"))).when(k % 4 == 1, F.concat(F.lit(" Chat | "), "p_name", F.lit(" | Budget review")))
        .when(k % 16 == 10, F.concat(F.lit("WebView2: Subframe: "), "p_name")).when(k % 16 == 2, "microsoft teams").when(k % 16 == 3, F.concat(F.lit("calendar | "), "p_name")).otherwise(F.concat("p_name", F.lit(" | part "), k % 3))
    )
    return i.read(spark, d, "part").select("p_partkey", cp.clean_title(title).alias("title"))


def parsed_lines(spark, d):
    """Turns as a caption view: speaker lines, lines with a speaker of their own, control lines, and plain ones."""
    said = F.translate("text", "\n()", "   ")
    line = (
        F.when(F.col("ord") % 5 == 0, F.concat(F.lit("Ana "), "speaker", F.lit(" (Org)"))).when(F.col("ord") % 5 == 1, F.concat(F.lit("Luis "), "speaker", F.lit(" (Other) said "), said))
        .when(F.col("ord") % 5 == 2, F.concat(F.lit("Show captions "), said)).otherwise(F.concat(F.lit("and "), said))
    )
    t = i.turns(spark, d).select(F.col("meeting_id").alias("snapshot_id"), F.col("ord").alias("line_no"), line.alias("line"))
    return cp.parse_lines(t).select("snapshot_id", "line_no", "speaker", F.md5("text").alias("text"))


def transcript_text(spark, d):
    return exports.transcript_text(i.turns(spark, d)).select("meeting_id", F.md5("text").alias("text_md5"))


def _exported(spark, d):
    """Meetings without an end (every fourth), without a summary (every third), without people (every fifth), with and without points and actions."""
    k = F.col("meeting_id")
    none = F.array().cast("array<string>")
    action = lambda text, owner: F.struct(F.lit(text).alias("text"), owner.alias("owner"))
    return i.turns(spark, d).groupBy("meeting_id").agg(F.max("end_time").alias("end"), F.array_sort(F.collect_set("speaker")).alias("people")).select(
        "meeting_id", F.concat(F.lit("Meeting "), k).alias("title"), F.lit("2026-01-05 14:03:00").cast("timestamp").alias("started_at"), F.when(k % 4 != 0, F.col("end")).alias("seconds"),
        F.when(k % 5 != 0, F.col("people")).otherwise(none).alias("participants"), F.when(k % 3 != 0, F.lit("All fine [T1] [T2]")).alias("summary"),
        F.when(k % 2 == 0, F.array(F.lit("one [T4]"), F.lit("two"))).otherwise(none).alias("key_points"), F.array(action("pay", F.lit("Ana")), action("call [T3]", F.lit(None).cast("string"))).alias("actions"),
        F.create_map(F.lit("pay"), F.lit(True)).alias("done"),
    )


def export_markdown(spark, d):
    m, t = _exported(spark, d), i.turns(spark, d)
    out = None
    for style in ("list", "detail", "bulk"):
        part = exports.meeting_markdown(m, t, style).select("meeting_id", F.lit(style).alias("style"), F.md5("markdown").alias("markdown_md5"))
        out = part if out is None else out.unionAll(part)
    return out


def markdown_blocks(spark, d):
    """Documents with some lines made items and headings, and blank lines between."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n([A-H])", "\n\n  - $1"), r"\n([I-M])", "\n## $1")
    rows = exports.markdown_blocks(i.read(spark, d, "documents").select("doc_id", marked.alias("text")))
    return rows.select("doc_id", "block_ix", "kind", F.md5("body").alias("body"))


def digest_chunks(spark, d):
    t = i.turns(spark, d)
    m = t.groupBy("meeting_id").agg(F.array_sort(F.collect_set("speaker")).alias("participants")).select(
        F.concat(F.lit("m"), "meeting_id").alias("meeting_id"), F.lit("Kickoff").alias("title"), F.lit("2026-07-01T14:00:00Z").alias("started_at"), "participants",
        F.when(F.col("meeting_id") % 2 == 0, F.array(F.lit("point"))).otherwise(F.array().cast("array<string>")).alias("key_points"),
    )
    return chunking.digest_chunks(m).select("key", "text", "date_epoch")


def note_chunks(spark, d):
    notes = i.read(spark, d, "documents").select(
        F.col("doc_id").alias("note_id"), F.col("lang").alias("owner_sub"), F.col("source").alias("title"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("clean_text"), F.lit("2026-03-04T05:06:07Z").alias("created_at")
    )
    return chunking.note_chunks(notes).select("key", F.md5("text").alias("text_md5"), "owner_sub", "date_epoch")


QUERIES = {f.__name__: f for f in (
    normalize_tokens, number_audit, negation_audit, levenshtein_sim, revision, turn_anchors, references, slug, html_escape, initials, safe_names, clock_format, title_cut, word_counts,
    first_paragraph, summary_sections, paragraph_chunks, turn_windows, system_notice, roster_label, meeting_surface, clean_title, parsed_lines, transcript_text, export_markdown,
    markdown_blocks, digest_chunks, note_chunks,
)}

_T = "coalesce(text, '')"
_NUMS = r"list_distinct(list_transform(regexp_extract_all({}, '\d+(?:[.,]\d+)*'), lambda n: regexp_replace(n, '[.,]', '', 'g')))"
_DIFF = "coalesce(array_to_string(list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x))), ','), '')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_MMSS = "lpad(CAST(CAST(floor({s}) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({s}) AS BIGINT) % 60 AS VARCHAR), 2, '0')"
_DURATION = """(SELECT CASE WHEN s < 60 THEN s || ' s' WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN (m // 60) || ' h' ELSE (m // 60) || ' h ' || (m % 60) || ' min' END
        FROM (SELECT CAST(floor({s} + 0.5) AS BIGINT) AS s, CAST(floor(floor({s} + 0.5) / 60 + 0.5) AS BIGINT) AS m))"""
_SLUGGED = "substr(trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60)"
# recursive packing of paragraphs: (key, text) in ``src``; windows in ``win``
_PACK = r"""st AS (SELECT k, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM src),
long AS (SELECT k, text FROM st WHERE ceil(length(text) / 4) > 650),
par AS (SELECT k, n, ps[n] AS p FROM (SELECT k, ps, unnest(range(1, len(ps) + 1)) AS n FROM (SELECT k, regexp_split_to_array(text, '\n{2,}') AS ps FROM long))),
pc AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY n, c) AS n, substr(p, c * 2600 + 1, 2600) AS p FROM (SELECT k, n, p, unnest(range(0, greatest(CAST(ceil(length(p) / 2600) AS BIGINT), 1))) AS c FROM par) WHERE p <> ''),
pk AS MATERIALIZED (SELECT k, n, p, CAST(ceil(length(p) / 4) AS BIGINT) AS t FROM pc),
walk AS (SELECT k, n, 0 AS w, t AS total FROM pk WHERE n = 1 UNION ALL SELECT q.k, q.n, CASE WHEN walk.total + q.t > 650 THEN w + 1 ELSE w END, CASE WHEN walk.total + q.t > 650 THEN q.t ELSE walk.total + q.t END FROM walk JOIN pk q ON q.k = walk.k AND q.n = walk.n + 1),
win AS (SELECT k, w AS n, string_agg(p, chr(10) || chr(10) ORDER BY walk.n) AS body FROM walk JOIN pk USING (k, n) GROUP BY k, w UNION ALL SELECT k, 0, text FROM st WHERE text <> '' AND ceil(length(text) / 4) <= 650)"""
_ASCII = "SELECT doc_id, ord, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM lines"
_LABEL = r"""(SELECT NOT regexp_matches(t, '[.,?!:;]') AND regexp_matches(t, '\p{{L}}') AND NOT regexp_matches(t, '\p{{Ll}}') AND len(w) BETWEEN 2 AND 4 AND len(list_filter(w, lambda x: length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) >= 4)) > 0
        FROM (SELECT t, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM (SELECT regexp_replace({c}, '^\s+|\s+$', '', 'g') AS t)))"""
_CMP = r"rtrim(regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '.,;:?! ')"


def _rev(p: str, c: str) -> str:
    a, b = _CMP.format(p), _CMP.format(c)
    sim = f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE 1 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b})) END"
    return f"length({a}) > 0 AND ((length({b}) >= length({a}) AND starts_with(lower({b}), lower({a}))) OR {sim} >= 0.6)"


ORACLES = {
    "normalize_tokens": f"SELECT doc_id, md5({i.norm(_T)}) AS form, len({i.tokens('text')}) AS n_tokens FROM documents",
    "number_audit": f"SELECT a.doc_id, {_DIFF.format(a=_NUMS.format('a.t'), b=_NUMS.format('b.t'))} AS missing, {_DIFF.format(a=_NUMS.format('b.t'), b=_NUMS.format('a.t'))} AS introduced FROM (SELECT doc_id, {_T} AS t FROM documents) a JOIN (SELECT doc_id, {_T} AS t FROM documents) b ON b.doc_id = a.doc_id + 1",
    "negation_audit": f"SELECT doc_id, coalesce(array_to_string(list_sort(list_filter(list_distinct({i.tokens('text')}), lambda t: list_contains(['no','not','never','nunca','jamas','ni','tampoco','nadie','ninguno','ninguna','nada','sin'], t))), ','), '') AS negations FROM documents",
    "levenshtein_sim": sql(f"SELECT a.doc_id, a.ord, round(CASE WHEN length(a.text) = 0 OR length(b.text) = 0 THEN 0 ELSE 1 - levenshtein(lower(a.text), lower(b.text)) / greatest(length(a.text), length(b.text)) END, 6) AS similarity FROM ({_ASCII}) a JOIN ({_ASCII}) b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1", "lines"),
    "revision": sql(f"SELECT doc_id, ord, {_rev('left(text, CAST(floor(length(text) * 2 / 5) AS INTEGER))', 'text')} AS grows, {_rev('text', 'reverse(text)')} AS reversed FROM ({_ASCII})", "lines"),
    "turn_anchors": sql(r"SELECT meeting_id, ord, CASE WHEN m = text THEN '' ELSE 'T1,T23' END AS anchors, md5(regexp_replace(m, '\s*\[T\d+\]', '', 'g')) AS plain FROM (SELECT *, regexp_replace(text, '([A-Za-z0-9_])\.', '\1 [T1]. [T23]', 'g') AS m FROM turns)", "base", "turns"),
    "references": sql("""SELECT meeting_id, ord, n, ref, left(ref, 1) AS kind, CASE WHEN n = 0 THEN 'a' ELSE substr(ref, 3) END AS id, CASE WHEN n = 0 THEN 'T' || ord ELSE '' END AS turn FROM
        (SELECT meeting_id, ord, n, ['M:a:T' || ord, 'N:x ' || meeting_id, 'M:b 18:48:' || ord, 'N:q:T3'][n + 1] AS ref FROM turns, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS n))""", "base", "turns"),
    "slug": sql(f"SELECT doc_id, ord, coalesce(nullif({_SLUGGED.format('text')}, ''), 'reunion') AS slug FROM lines", "lines"),
    "html_escape": "SELECT page_id, md5(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages",
    "initials": r"SELECT c_custkey, CASE WHEN len(w) = 0 THEN '?' WHEN len(w) = 1 THEN upper(left(w[1], 1)) ELSE upper(left(w[1], 1)) || upper(left(w[-1], 1)) END AS initials FROM (SELECT c_custkey, list_filter(regexp_split_to_array(replace(c_name, '#', ' '), '\s+'), lambda x: x <> '') AS w FROM customer)",
    "safe_names": "SELECT page_id, left(regexp_replace(url, '[^0-9A-Za-z._-]', '-', 'g'), 200) AS name, 'idx-' || lower(left(regexp_replace(url, '[^0-9A-Za-z._-]', '-', 'g'), 40)) || '-' || substr(sha256(url), 1, 10) AS hashed FROM pages",
    "clock_format": sql(f"""SELECT meeting_id, ord, {_MMSS.format(s='start_time')} AS mmss, (CAST(floor(end_time * 31) AS BIGINT) // 60) || ':' || lpad(CAST(CAST(floor(end_time * 31) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock,
        {_DURATION.format(s='end_time * 7')} AS duration, {_DURATION.format(s='(ord * 29.9::DOUBLE + 59.6::DOUBLE)')} AS edge FROM turns""", "base", "turns"),
    "title_cut": sql(f"SELECT doc_id, ord, substr({_STRIP.format('text')}, 1, 60) AS title FROM lines", "lines"),
    "word_counts": f"SELECT doc_id, {i.WORDS.format(_T)} AS words, CAST(ceil(length({_T}) / 4) AS BIGINT) AS tokens FROM documents",
    "first_paragraph": r"SELECT doc_id, md5(coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '' AND NOT starts_with(p, '#'))[1], '')) AS paragraph FROM documents",
    "summary_sections": r"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS n, md5(s) AS section FROM (SELECT doc_id, k, regexp_replace(CASE WHEN k = 1 THEN ls[k] ELSE '## ' || ls[k] END, '^\s+|\s+$', '', 'g') AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))) WHERE s <> ''",
    "paragraph_chunks": f"WITH RECURSIVE src AS (SELECT doc_id AS k, replace({_T}, chr(10), chr(10) || chr(10)) AS text FROM documents), {_PACK} SELECT k AS doc_id, CAST(n AS INTEGER) AS n, length(body) AS length, md5(body) AS body FROM win",
    "turn_windows": "WITH RECURSIVE lines AS (" + i.CTES["lines"] + """), c AS MATERIALIZED (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n, CAST(ceil(length(text) / 4) AS BIGINT) AS t FROM lines),
        sums AS MATERIALIZED (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY n) AS upto, count(*) OVER (PARTITION BY doc_id) AS total FROM c),
        ends AS MATERIALIZED (SELECT a.doc_id, a.n, max(b.n) AS e, any_value(a.total) AS total FROM sums a JOIN sums b ON b.doc_id = a.doc_id AND b.n >= a.n AND (b.n = a.n OR (b.upto - a.upto + a.t <= 700 AND b.upto - b.t - a.upto + a.t < 500)) GROUP BY ALL),
        w AS (SELECT doc_id, 0 AS window_ix, n, e, total FROM ends WHERE n = 1 UNION ALL SELECT w.doc_id, window_ix + 1, x.n, x.e, x.total FROM w JOIN ends x ON x.doc_id = w.doc_id AND x.n = greatest(w.n + 1, w.e) WHERE w.e < w.total)
        SELECT doc_id, CAST(window_ix AS INTEGER) AS window_ix, f.ord AS first_ord, l.ord AS last_ord FROM w JOIN c f USING (doc_id, n) JOIN c l ON l.doc_id = w.doc_id AND l.n = w.e""",
    "system_notice": sql("""SELECT doc_id, ord, len(list_filter(string_split(trim(t), ' '), lambda x: x <> '')) <= 12 AND (ord % 7 = 3 OR regexp_matches(lower(t), 'joined the (meeting|call)|left the (meeting|call)|recording (has )?started')) AS notice FROM (SELECT doc_id, ord, CASE WHEN ord % 7 = 3 THEN string_split(text, ' ')[-1] || ' Joined the MEETING' ELSE text END AS t FROM lines)""", "lines"),
    "roster_label": sql(f"""SELECT doc_id, ord, {_LABEL.format(c='text')} AS line, {_LABEL.format(c="upper(replace(array_to_string(string_split(text, ' ')[1:3], ' '), 'ß', 's'))")} AS capitals FROM lines""", "lines"),
    "meeting_surface": "SELECT event_id, s AS score, s >= 5 AS surface FROM (SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS s FROM events)",
    "clean_title": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN trim(p_name) WHEN p_partkey % 4 = 1 THEN trim(p_name) || ' | Budget review' WHEN p_partkey % 16 IN (2, 3, 10) THEN NULL ELSE trim(p_name || ' | part ' || (p_partkey % 3)) END AS title FROM part",
    "parsed_lines": sql(r"""SELECT meeting_id AS snapshot_id, ord AS line_no, CASE WHEN ord % 5 = 1 THEN 'Luis ' || speaker || ' (Other)' ELSE coalesce(head, '') END AS speaker,
        md5(regexp_replace(CASE WHEN ord % 5 = 1 THEN 'said ' ELSE 'and ' END || translate(text, e'\n()', '   '), '^\s+|\s+$', '', 'g')) AS text FROM
        (SELECT *, last_value(CASE WHEN ord % 5 = 0 THEN 'Ana ' || speaker || ' (Org)' END IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY ord) AS head FROM turns) WHERE ord % 5 NOT IN (0, 2)""", "base", "turns"),
    "transcript_text": sql("SELECT meeting_id, md5(string_agg(speaker || ' (' || (CAST(floor(start_time) AS BIGINT) // 60) || ':' || lpad(CAST(CAST(floor(start_time) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '): ' || text, chr(10) ORDER BY ord)) AS text_md5 FROM turns GROUP BY 1", "base", "turns"),
    "export_markdown": sql(rf"""SELECT meeting_id, style, md5(CASE style
        WHEN 'list' THEN '# Meeting ' || k || e'\n\n- Fecha: 5 ene 2026, 14:03\n- Participantes: ' || CASE WHEN people = '' THEN '—' ELSE people END || CASE WHEN k % 4 <> 0 THEN e'\n- Duración: ' || dur ELSE '' END
          || CASE WHEN k % 3 <> 0 THEN e'\n\n## Resumen\n\nAll fine' || points || e'\n\n## Acciones\n\n- pay — Ana\n- call' ELSE '' END || e'\n\n## Transcripción\n\n' || each
        WHEN 'detail' THEN '# Meeting ' || k || e'\n\n- Fecha: 5 ene 2026, 14:03' || CASE WHEN k % 4 <> 0 THEN e'\n- Duración: ' || dur ELSE '' END || e'\n- Participantes: ' || people || e'\n'
          || CASE WHEN k % 3 <> 0 THEN e'\n## Resumen\n\nAll fine\n' || CASE WHEN k % 2 = 0 THEN e'\n### Puntos clave\n\n- one\n- two\n' ELSE '' END || e'\n## Acciones\n\n- [ ] pay — Ana\n- [ ] call\n' ELSE '' END || e'\n## Transcripción\n\n' || spoken || e'\n'
        ELSE regexp_replace('# Meeting ' || k || e'\n\n- **Fecha:** 5 ene 2026, 14:03' || CASE WHEN k % 4 <> 0 THEN e'\n- **Duración:** ' || dur ELSE '' END || CASE WHEN people <> '' THEN e'\n- **Participantes:** ' || people ELSE '' END
          || CASE WHEN k % 3 <> 0 THEN e'\n\n## Resumen\n\nAll fine' || points || e'\n\n## Acciones\n\n- [x] pay — Ana\n- [ ] call' ELSE '' END || e'\n\n## Transcripción\n\n' || each, '\s+$', '') || e'\n' END) AS markdown_md5
        FROM (SELECT meeting_id, meeting_id AS k, {_DURATION.format(s='max(end_time)')} AS dur, CASE WHEN meeting_id % 5 <> 0 THEN array_to_string(list_sort(list_distinct(list(speaker))), ', ') ELSE '' END AS people,
          CASE WHEN meeting_id % 2 = 0 THEN e'\n\n### Puntos clave\n\n- one\n- two' ELSE '' END AS points, string_agg(line, e'\n\n' ORDER BY ord) AS spoken, string_agg(line || e'\n', e'\n' ORDER BY ord) AS each
          FROM (SELECT *, '**' || speaker || '** (' || (CAST(floor(start_time) AS BIGINT) // 60) || ':' || lpad(CAST(CAST(floor(start_time) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '): ' || text AS line FROM turns) GROUP BY meeting_id),
        (SELECT unnest(['list', 'detail', 'bulk']) AS style)""", "base", "turns"),
    "markdown_blocks": r"""WITH l AS (SELECT doc_id, n, regexp_replace(ls[n], '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM
        (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\n([A-H])', e'\n\n  - \\1', 'g'), '\n([I-M])', e'\n## \\1', 'g'), chr(10)) AS ls FROM documents))),
        k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6}\s+') THEN 'heading' WHEN regexp_matches(line, '^[-*]\s+') THEN 'list' ELSE 'para' END AS kind FROM l),
        p AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS before, last_value(CASE WHEN kind <> 'blank' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM k),
        r AS (SELECT *, sum(CASE kind WHEN 'heading' THEN 1 WHEN 'list' THEN CASE WHEN last IS DISTINCT FROM 'list' THEN 1 ELSE 0 END WHEN 'para' THEN CASE WHEN before IS DISTINCT FROM 'para' THEN 1 ELSE 0 END ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM p)
        SELECT doc_id, CAST(run - 1 AS INTEGER) AS block_ix, any_value(kind) AS kind, md5(string_agg(CASE WHEN kind = 'para' THEN line ELSE regexp_replace(line, '^(#{1,6}|[-*])\s+', '') END, chr(10) ORDER BY n)) AS body FROM r WHERE kind <> 'blank' GROUP BY doc_id, run""",
    "digest_chunks": sql(r"SELECT 'm' || meeting_id || '#dig' AS key, e'Reunión: \"Kickoff\"\nFecha: 2026-07-01\nParticipantes: ' || array_to_string(list_sort(list_distinct(list(speaker))), ', ') || CASE WHEN meeting_id % 2 = 0 THEN e'\nPuntos clave:\n- point' ELSE '' END AS text, CAST(epoch(TIMESTAMP '2026-07-01 14:00:00') AS BIGINT) AS date_epoch FROM turns GROUP BY meeting_id", "base", "turns"),
    "note_chunks": f"WITH RECURSIVE src AS (SELECT doc_id AS k, replace({_T}, chr(10), chr(10) || chr(10)) AS text FROM documents), {_PACK} SELECT 'note#' || k || '#' || n AS key, md5('Nota personal — 2026-03-04 — ' || source || chr(10) || chr(10) || body) AS text_md5, lang AS owner_sub, CAST(epoch(TIMESTAMP '2026-03-04 05:06:07') AS BIGINT) AS date_epoch FROM win JOIN documents ON doc_id = k",
}
