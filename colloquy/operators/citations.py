"""Citation markers of answers resolved against search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as v


def resolve_citations(answers: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers with text rid of markers that resolve to no hit; citations).

    answers: answer_id, text. hits: answer_id, rank, type, meeting_id, note_id,
    title, date_epoch. A marker takes the first hit with its id; note markers
    need a hit of type note, and meeting markers one of another type. Citations:
    answer_id, n, ref, kind, id, turn, title, date, url.
    """
    refs = answers.select("answer_id", F.posexplode(tx.references("text")).alias("n", "r")).select("answer_id", "n", "r.*")
    is_note = F.col("type") == "note"
    known = hits.select(
        "answer_id", F.when(is_note, "N").otherwise("M").alias("kind"), F.when(is_note, F.col("note_id")).otherwise(F.col("meeting_id")).alias("id"), "rank", "title", "date_epoch"
    ).groupBy("answer_id", "kind", "id").agg(F.min_by(F.struct("title", "date_epoch"), "rank").alias("hit"))
    joined = refs.join(known, ["answer_id", "kind", "id"], "left")
    lost = joined.filter("hit IS NULL").groupBy("answer_id").agg(F.array_sort(F.collect_set("ref")).alias("_lost"))
    none = F.array().cast("array<string>")
    cleaned = answers.join(lost, "answer_id", "left").withColumn("text", tx.strip_references("text", F.coalesce("_lost", none))).drop("_lost")
    page = F.when(F.col("kind") == "N", F.lit("/notes?id=")).otherwise(F.lit("/meeting?id="))
    url = F.concat(page, tx.uri_component("id"), F.when(F.col("turn") != "", F.concat(F.lit("&turn="), F.col("turn"))).otherwise(F.lit("")))
    cited = joined.filter("hit IS NOT NULL").select(
        "answer_id", "n", "ref", "kind", "id", F.nullif("turn", F.lit("")).alias("turn"), F.coalesce("hit.title", F.lit("")).alias("title"),
        F.coalesce(v.epoch_date(F.col("hit.date_epoch")), F.lit("")).alias("date"), url.alias("url"),
    )
    return cleaned, cited


def citation_cards(citations: DataFrame) -> DataFrame:
    """One row for each url of an answer, the first to be cited."""
    rows = citations.groupBy("answer_id", "url").agg(F.min(F.struct("n", "ref", "title", "date")).alias("c"))
    return rows.select("answer_id", "c.n", "c.ref", "c.title", "c.date", "url")
