"""Meetings as Markdown and plain text, built from ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as v


def _none() -> Column:
    return F.array().cast("array<string>")


def transcript_lines(turns: DataFrame) -> DataFrame:
    """meeting_id, lines: 'speaker (m:ss): text' in order."""
    line = F.concat("speaker", F.lit(" ("), v.clock(F.col("start_time")), F.lit("): "), "text")
    rows = turns.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return rows.select("meeting_id", F.col("l.line").alias("lines"))


def transcript_text(turns: DataFrame) -> DataFrame:
    return transcript_lines(turns).select("meeting_id", F.array_join("lines", "\n").alias("text"))


def meeting_markdown(meetings: DataFrame, turns: DataFrame, style: str = "list") -> DataFrame:
    """meeting_id, markdown, in one of three styles: 'list' (an export of the list), 'detail' (of a meeting's page) or 'bulk' (an entry of an archive).

    meetings: title, started_at, participants (array of names), seconds (null while the meeting is open), summary
    (null without one), key_points (array), actions (array of structs of text and owner), and for 'bulk' done
    (map of an action's text to boolean). Anchors are cut from summary, key points and actions.
    """
    said = F.concat(F.lit("**"), "speaker", F.lit("** ("), v.clock(F.col("start_time")), F.lit("): "), "text")
    spoken = turns.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", said.alias("line")))), lambda x: x["line"]).alias("spoken"))
    rows = meetings.join(spoken, "meeting_id", "left")
    given = lambda c: F.coalesce(F.col(c), F.array().cast(meetings.schema[c].dataType))
    people, points, actions = (given(c) for c in ("participants", "key_points", "actions"))
    lines = F.coalesce("spoken", _none())
    label = lambda name: F.lit(f"- **{name}:** " if style == "bulk" else f"- {name}: ")
    one = lambda *parts: F.array(F.concat(*parts))
    put = lambda *xs: F.array(*map(F.lit, xs))
    only = lambda holds, xs: F.when(holds, xs).otherwise(_none())
    plain = tx.strip_anchors
    date = one(label("Fecha"), v.short_date_time(F.col("started_at")))
    length = only(F.col("seconds").isNotNull(), one(label("Duración"), v.duration(F.col("seconds"))))
    names = F.array_join(people, ", ")
    mark = {"list": lambda a: F.lit("- "), "detail": lambda a: F.lit("- [ ] "), "bulk": lambda a: F.when(F.coalesce(F.try_element_at(F.col("done"), a["text"]), F.lit(False)), "- [x] ").otherwise("- [ ] ")}[style]
    acted = F.transform(actions, lambda a: F.concat(mark(a), plain(a["text"]), F.when(F.coalesce(a["owner"], F.lit("")) != "", F.concat(F.lit(" — "), a["owner"])).otherwise("")))
    pointed = F.transform(points, lambda x: F.concat(F.lit("- "), plain(x)))
    has_points, has_actions, has_summary = F.size(points) > 0, F.size(actions) > 0, F.col("summary").isNotNull()
    each = F.flatten(F.transform(lines, lambda x: F.array(x, F.lit(""))))
    title = F.concat(F.array(F.concat(F.lit("# "), "title")), put(""))
    if style == "detail":
        parts = F.concat(
            title, date, length, one(label("Participantes"), names), put(""), only(has_summary, F.concat(put("## Resumen", ""), F.array(plain("summary")), put(""))),
            only(has_summary & has_points, F.concat(put("### Puntos clave", ""), pointed, put(""))), only(has_summary & has_actions, F.concat(put("## Acciones", ""), acted, put(""))),
            put("## Transcripción", ""), F.array(F.array_join(lines, "\n\n")), put(""),
        )
        return rows.select("meeting_id", F.array_join(parts, "\n").alias("markdown"))
    summary = only(has_summary & (F.col("summary") != "") if style == "list" else has_summary, F.concat(put("", "## Resumen", ""), F.array(plain("summary")), only(has_points, F.concat(put("", "### Puntos clave", ""), pointed))))
    tasks = only(has_summary & has_actions, F.concat(put("", "## Acciones", ""), acted))
    if style == "list":
        parts = F.concat(title, date, one(label("Participantes"), F.when(names == "", "—").otherwise(names)), length, summary, tasks, put("", "## Transcripción", ""), each)
        return rows.select("meeting_id", F.array_join(parts, "\n").alias("markdown"))
    parts = F.concat(title, date, length, only(F.size(people) > 0, one(label("Participantes"), names)), summary, tasks, only(F.size(lines) > 0, F.concat(put("", "## Transcripción", ""), each)))
    return rows.select("meeting_id", F.concat(F.regexp_replace(F.array_join(parts, "\n"), r"(?U)\s+$", ""), F.lit("\n")).alias("markdown"))


def action_boxes(actions: DataFrame, done: DataFrame) -> DataFrame:
    """'- [x] text' or '- [ ] text' for actions (meeting_id, i, text) by the overrides in done (meeting_id, states map of text to boolean)."""
    joined = actions.join(done, "meeting_id", "left")
    state = F.coalesce(F.try_element_at("states", F.col("i").cast("string")), F.lit(False))
    return joined.select("meeting_id", "i", F.concat(F.when(state, "- [x] ").otherwise("- [ ] "), "text").alias("line"))


def html_document(rows: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    paragraphs = F.array_join(F.transform(F.split(tx.html_escape(body), "\n"), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n")
    return rows.withColumn("html", F.concat(F.lit("<h1>"), tx.html_escape(title), F.lit("</h1>\n"), paragraphs))


def file_name(title: Column, started_at: Column, ending: str) -> Column:
    return F.concat(F.date_format(started_at, "yyyy-MM-dd"), F.lit("-"), tx.slug(title), F.lit(f".{ending}"))


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, block_ix, kind (heading, list, para), body.

    Lines are trimmed. A heading is a block of its own; items join the list before them, blank lines between or
    not; other lines make a paragraph up to a blank line, a heading or an item.
    """
    from pyspark.sql import Window

    lines = docs.select(key, F.posexplode(F.transform(F.split(text, "\n"), tx.strip)).alias("n", "line"))
    kind = F.when(F.col("line") == "", "blank").when(F.col("line").rlike(r"^#{1,6}\s+"), "heading").when(F.col("line").rlike(r"^[-*]\s+"), "list").otherwise("para")
    w = Window.partitionBy(key).orderBy("n")
    before = F.lag("kind").over(w)
    last = F.last(F.when(F.col("kind") != "blank", F.col("kind")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("kind") == "blank", False).when(F.col("kind") == "heading", True).when(F.col("kind") == "list", ~last.eqNullSafe(F.lit("list"))).otherwise(~before.eqNullSafe(F.lit("para")))
    rows = lines.withColumn("kind", kind).withColumn("_new", new.cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("kind <> 'blank'")
    body = F.regexp_replace("line", r"^(#{1,6}|[-*])\s+", "")
    blocks = rows.groupBy(key, "_run").agg(F.first("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.when(F.col("kind") == "para", F.col("line")).otherwise(body).alias("b")))), lambda x: x["b"]), "\n").alias("body"))
    return blocks.select(key, (F.col("_run") - 1).cast("int").alias("block_ix"), "kind", "body")
