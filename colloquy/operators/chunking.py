"""Chunks for retrieval: turn windows, paragraph windows, and the chunks of meetings and notes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import values as v

TURN_TARGET, TURN_MOST = 500, 700
NOTE_MOST = 650
#: Kinds of extracted items in order, with their short form and title.
KINDS = (("decisions", "dec", "Decisión"), ("actionItems", "act", "Tarea"), ("openQuestions", "opq", "Pregunta abierta"), ("keyNumbers", "num", "Cifra clave"))


def window_bounds(costs: list[int], target: int = TURN_TARGET, most: int = TURN_MOST) -> list[tuple[int, int]]:
    """(first, end) of windows over turns of these token counts: filled to the target, not beyond the most unless a single turn is, overlapping by one turn."""
    out, i = [], 0
    while i < len(costs):
        j, total = i + 1, costs[i]
        while j < len(costs) and total < target and total + costs[j] <= most:
            total += costs[j]
            j += 1
        out.append((i, j))
        if j == len(costs):
            break
        i = max(i + 1, j - 1)
    return out


def turn_windows(turns: DataFrame, keys: tuple[str, ...] = ("meeting_id", "chapter_ix"), order: str = "ord", cost: str = "tokens", target: int = TURN_TARGET, most: int = TURN_MOST) -> DataFrame:
    """keys, window_ix, first_ord, last_ord. A window's start hangs on the end of the one before, so each group is walked in order: only (order, tokens) of a group travel, and rows stream through in sorted partitions."""
    slim = turns.select(*keys, F.col(order).cast("long").alias("_o"), F.col(cost).cast("long").alias("_c"))
    schema = T.StructType([*slim.select(*keys).schema.fields, T.StructField("window_ix", T.IntegerType()), T.StructField("first_ord", T.LongType()), T.StructField("last_ord", T.LongType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, orders, costs = None, [], []
        kinds = None

        def flush(out: list[tuple]) -> None:
            out += [(*now, k, orders[a], orders[b - 1]) for k, (a, b) in enumerate(window_bounds(costs, target, most))]

        for batch in batches:
            out: list[tuple] = []
            kinds = [*batch.schema.types[: len(keys)], pa.int32(), pa.int64(), pa.int64()]
            for *key, o, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if tuple(key) != now:
                    if now is not None:
                        flush(out)
                    now, orders, costs = tuple(key), [], []
                orders.append(o)
                costs.append(c)
            yield _batch(out, kinds, schema.names)
        if now is not None:
            out = []
            flush(out)
            yield _batch(out, kinds, schema.names)

    return slim.repartition(*keys).sortWithinPartitions(*keys, "_o").mapInArrow(walk, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def paragraph_windows(c: Column | str, most: int = NOTE_MOST) -> Column:
    """Array of windows: the text whole if it is short; else paragraphs (cut at 4 * most characters) packed in order, without overlap."""
    text = tx.strip(c)
    chars = 4 * most
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p) / chars).cast("int") - 1, F.lit(0))), lambda k: F.substring(p, k * chars + 1, F.lit(chars)))
    pieces = F.flatten(F.transform(F.split(text, r"\n{2,}"), cut))
    pieces = F.filter(pieces, lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, p: Column) -> Column:
        n = tx.estimated_tokens(p)
        full = acc["open"].isNotNull() & (acc["n"] + n > most)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(acc["open"].isNull() | full, p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p)).alias("open"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    packed = F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).when(tx.estimated_tokens(text) <= most, F.array(text)).otherwise(packed)


def note_chunks(notes: DataFrame) -> DataFrame:
    """notes (note_id, owner_sub, title, clean_text, created_at as ISO string) to key, text, type, note_id, owner_sub, date_epoch, title."""
    rows = notes.select("*", F.posexplode(paragraph_windows("clean_text")).alias("n", "body"))
    header = F.concat(F.lit("Nota personal — "), v.date_prefix(F.col("created_at")), F.lit(" — "), F.col("title"), F.lit("\n\n"))
    return rows.select(
        F.concat(F.lit("note#"), "note_id", F.lit("#"), "n").alias("key"), F.concat(header, "body").alias("text"), F.lit("note").alias("type"),
        "note_id", "owner_sub", v.epoch_seconds(F.col("created_at")).alias("date_epoch"), "title",
    )


def _of_meeting(rows: DataFrame, kind: str, key: Column, text: Column, **more: Column) -> DataFrame:
    extra = {"chapter_title": F.lit(None).cast("string"), "turn_start": F.lit(None).cast("string"), "turn_end": F.lit(None).cast("string")} | more
    return rows.select(
        key.alias("key"), text.alias("text"), F.lit(kind).alias("type"), "meeting_id", v.epoch_seconds(F.col("started_at")).alias("date_epoch"), "title",
        *(c.alias(n) for n, c in extra.items()),
    )


def extraction_chunks(meetings: DataFrame, items: DataFrame) -> DataFrame:
    """items: meeting_id, kind, i, text, verbatim_quote, turn_id; blank ones are skipped and not counted."""
    kinds = F.create_map(*(F.lit(x) for k, short, title in KINDS for x in (k, f"{short}|{title}")))
    kept = items.filter(tx.strip("text") != "").withColumn("_kind", F.split(kinds[F.col("kind")], r"\|"))
    n = F.row_number().over(Window.partitionBy("meeting_id", "kind").orderBy("i")) - 1
    rows = kept.withColumn("n", n).withColumnRenamed("text", "item").join(meetings.select("meeting_id", "title", "started_at"), "meeting_id")
    text = F.concat(
        F.get("_kind", F.lit(1)), F.lit(" ("), v.date_prefix(F.col("started_at")), F.lit(', reunión "'), "title", F.lit('"): '), "item",
        F.lit(' — cita: "'), "verbatim_quote", F.lit('" ['), "turn_id", F.lit("]"),
    )
    return _of_meeting(rows, "extraction", F.concat("meeting_id", F.lit("#ex#"), F.get("_kind", F.lit(0)), F.lit("#"), "n"), text, turn_start=F.col("turn_id"))


def chapter_chunks(meetings: DataFrame, turns: DataFrame) -> DataFrame:
    """turns: meeting_id, ord, id, speaker, text, chapter_ix, chapter_title (see with_chapters)."""
    line = F.concat(F.lit("["), "id", F.lit("] "), "speaker", F.lit(": "), "text")
    rendered = turns.withColumn("line", line).withColumn("tokens", tx.estimated_tokens("line"))
    windows = turn_windows(rendered)
    inside = windows.join(rendered.select("meeting_id", "chapter_ix", "ord", "id", "line", "chapter_title"), ["meeting_id", "chapter_ix"]).filter(F.col("ord").between(F.col("first_ord"), F.col("last_ord")))
    bodies = inside.groupBy("meeting_id", "chapter_ix", "window_ix").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("body"),
        F.min_by("id", "ord").alias("turn_first"), F.max_by("id", "ord").alias("turn_last"), F.first("chapter_title").alias("chapter"),
    )
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("chapter_ix", "window_ix")) - 1
    rows = bodies.withColumn("n", n).join(meetings.select("meeting_id", "title", "started_at"), "meeting_id")
    header = F.concat(F.lit('Reunión: "'), "title", F.lit('" — '), v.date_prefix(F.col("started_at")), F.lit(' — Capítulo: "'), "chapter", F.lit('"\n\n'))
    return _of_meeting(rows, "chapter", F.concat("meeting_id", F.lit("#ch#"), "n"), F.concat(header, "body"), chapter_title=F.col("chapter"), turn_start=F.col("turn_first"), turn_end=F.col("turn_last"))


def summary_chunks(meetings: DataFrame, summaries: DataFrame) -> DataFrame:
    rows = summaries.select("meeting_id", F.posexplode(tx.summary_sections("text")).alias("n", "section")).join(meetings.select("meeting_id", "title", "started_at"), "meeting_id")
    header = F.concat(F.lit('Resumen de reunión "'), "title", F.lit('" — '), v.date_prefix(F.col("started_at")), F.lit("\n\n"))
    return _of_meeting(rows, "summary", F.concat("meeting_id", F.lit("#sum#"), "n"), F.concat(header, "section"))


def digest_chunks(meetings: DataFrame) -> DataFrame:
    """meetings: meeting_id, title, started_at, participants (array of names), key_points (array)."""
    none = F.array().cast("array<string>")
    people, points = F.coalesce("participants", none), F.coalesce("key_points", none)
    lines = F.concat(
        F.array(F.concat(F.lit('Reunión: "'), "title", F.lit('"')), F.concat(F.lit("Fecha: "), v.date_prefix(F.col("started_at")))),
        F.when(F.size(people) > 0, F.array(F.concat(F.lit("Participantes: "), F.array_join(people, ", ")))).otherwise(none),
        F.when(F.size(points) > 0, F.concat(F.array(F.lit("Puntos clave:")), F.transform(points, lambda p: F.concat(F.lit("- "), p)))).otherwise(none),
    )
    return _of_meeting(meetings, "digest", F.concat("meeting_id", F.lit("#dig")), F.array_join(lines, "\n"))


def meeting_chunks(meetings: DataFrame, items: DataFrame, turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """All chunks of meetings: extraction, chapters, summary sections and digest."""
    parts = [extraction_chunks(meetings, items), chapter_chunks(meetings, turns), summary_chunks(meetings, summaries), digest_chunks(meetings)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
