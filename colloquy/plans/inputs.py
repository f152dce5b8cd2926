"""The driver tables in the roles of a meeting's inputs; each derivation exists as a DataFrame and as SQL.

conversations are meetings: a turn takes 0.35 s a word, at least 1.5 s, one
after the other. Times are whole hundredths of a second before they are divided,
so that both engines get the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, ord, role, text, words, c0 and c1 (start and end in hundredths of a second)."""
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").alias("ord"), "role", F.coalesce("text", F.lit("")).alias("text"), tx.word_count(F.coalesce("text", F.lit(""))).alias("words")
    )
    cost = F.greatest(F.lit(150), 35 * F.col("words"))
    end = F.sum(cost).over(Window.partitionBy("meeting_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("c1", end).withColumn("c0", F.col("c1") - cost)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("meeting_id", "ord", F.col("role").alias("speaker"), "text", (F.col("c0") / 100).alias("start_time"), (F.col("c1") / 100).alias("end_time"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("meeting_id") + F.col("ord")
    return base(spark, sf_dir).select(
        "meeting_id", "ord",
        F.when(k % 5 == 0, "mic").when(k % 5 == 1, "caption").otherwise("tab").alias("source"),
        F.concat(F.lit("spk_"), (k % 2).cast("string")).alias("label"),
        (F.col("c0") / 100).alias("start_time"), (F.col("c1") / 100).alias("end_time"), "text",
        F.when(k % 11 != 0, ((F.col("meeting_id") * 7 + F.col("ord") * 13) % 100) / 100).alias("confidence"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("meeting_id", "ord", ((F.col("c0") + F.col("ord") * 37 % 90) / 100).alias("t"), F.col("role").alias("name"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("meeting_id") + F.col("ord")
    return base(spark, sf_dir).select(
        "meeting_id", "ord", ((F.col("c1") - 50) / 100).alias("t"), F.when(k % 7 == 0, "Unknown").otherwise(F.col("role")).alias("speaker_name"),
        F.regexp_replace("text", r"^\S+\s+", "").alias("text"), (F.col("ord") % 4 != 3).alias("final"),
    )


def batch_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second transcript: segments moved by up to 3.4 s, and some of them cut short."""
    move = (F.col("meeting_id") * 31 + F.col("ord") * 53) % 340
    return base(spark, sf_dir).select(
        "meeting_id", "ord", ((F.col("c0") + move) / 100).alias("start_time"), ((F.col("c0") + move + F.lit(120)) / 100).alias("end_time"),
        F.concat(F.lit("B: "), "text").alias("text"), ((F.col("ord") * 17 % 100) / 100).alias("confidence"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recogniser items: the words of a meeting, full stops as items of their own, with a pause after every seventh word."""
    # turns are numbered, and not their words: nothing has to be sorted after words are rows
    before = F.sum("words").over(Window.partitionBy("meeting_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    w = base(spark, sf_dir).select("meeting_id", before.alias("before"), "text").select("meeting_id", "before", F.posexplode(tx.words("text")).alias("pos", "word"))
    rows = w.select("meeting_id", "word", (F.col("before") + F.col("pos")).alias("n")).withColumn("start", F.col("n") * 40 + F.floor(F.col("n") / 7) * 100)
    word = F.struct((F.col("n") * 2).alias("ord"), F.lit("pronunciation").alias("type"), (F.col("start") / 100).alias("start_time"), ((F.col("start") + 30) / 100).alias("end_time"), F.regexp_replace("word", r"\.$", "").alias("content"), ((F.col("n") * 13 % 100) / 100).alias("confidence"))
    stop = F.struct((F.col("n") * 2 + 1).alias("ord"), F.lit("punctuation").alias("type"), F.lit(None).cast("double").alias("start_time"), F.lit(None).cast("double").alias("end_time"), F.lit(".").alias("content"), F.lit(None).cast("double").alias("confidence"))
    return rows.select("meeting_id", F.explode(F.when(F.col("word").endswith("."), F.array(word, stop)).otherwise(F.array(word))).alias("i")).select("meeting_id", "i.*")


def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as clean turns: id T1, T2, ..., and tags."""
    return turns(spark, sf_dir).select("*", F.concat(F.lit("T"), F.col("ord") + 1).alias("id"), F.when(F.col("ord") % 3 == 0, F.array(F.lit("key"))).otherwise(F.array().cast("array<string>")).alias("tags"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, text: lines of documents that aren't blank."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    return rows.filter(F.trim("text") != "")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts; ten ids make a meeting."""
    return read(spark, sf_dir, "labels").select(
        F.floor(F.col("doc_id") / 10).alias("meeting_id"), F.col("doc_id").alias("claim_ix"),
        F.when(F.col("toxic") == 1, "UNSUPPORTED").when(F.col("doc_id") % 7 == 3, "UNCERTAIN").when(F.col("quality") == 1, "SUPPORTED").otherwise("PARTIAL").alias("verdict"),
        (F.col("doc_id") % 4 == 0).alias("critical"),
    )


def gate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate decisions from events: a user is a meeting."""
    names = F.element_at(F.lit(["gateA", "gateB", "gateC", "gateD", "gateE"]), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("eval_ix"), names.alias("gate"), (F.col("value") > 50).alias("fired"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
FOLD = "trim(regexp_replace(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def norm(c: str) -> str:
    return FOLD.format(c)


def tokens(c: str) -> str:
    return f"list_filter(string_split({norm(f'coalesce({c}, {chr(39) * 2})')}, ' '), lambda t: t <> '')"


CTES = {
    "base": (
        "SELECT *, sum(greatest(150, 35 * words)) OVER (PARTITION BY meeting_id ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS c1, "
        "(sum(greatest(150, 35 * words)) OVER (PARTITION BY meeting_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - greatest(150, 35 * words))::BIGINT AS c0 FROM "
        f"(SELECT conv_id AS meeting_id, turn AS ord, role, coalesce(text, '') AS text, {WORDS.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS words FROM conversations)"
    ),
    "turns": "SELECT meeting_id, ord, role AS speaker, text, c0 / 100.0::DOUBLE AS start_time, c1 / 100.0::DOUBLE AS end_time FROM base",
    "segments": "SELECT meeting_id, ord, CASE (meeting_id + ord) % 5 WHEN 0 THEN 'mic' WHEN 1 THEN 'caption' ELSE 'tab' END AS source, 'spk_' || ((meeting_id + ord) % 2) AS label, "
    "c0 / 100.0::DOUBLE AS start_time, c1 / 100.0::DOUBLE AS end_time, text, CASE WHEN (meeting_id + ord) % 11 <> 0 THEN ((meeting_id * 7 + ord * 13) % 100) / 100.0::DOUBLE END AS confidence FROM base",
    "readings": "SELECT meeting_id, ord, (c0 + ord * 37 % 90) / 100.0::DOUBLE AS t, role AS name FROM base",
    "captions": r"SELECT meeting_id, ord, (c1 - 50) / 100.0::DOUBLE AS t, CASE WHEN (meeting_id + ord) % 7 = 0 THEN 'Unknown' ELSE role END AS speaker_name, "
    r"regexp_replace(text, '^\S+\s+', '') AS text, ord % 4 <> 3 AS final FROM base",
    "batch": "SELECT meeting_id, ord, (c0 + (meeting_id * 31 + ord * 53) % 340) / 100.0::DOUBLE AS start_time, (c0 + (meeting_id * 31 + ord * 53) % 340 + 120) / 100.0::DOUBLE AS end_time, 'B: ' || text AS text, (ord * 17 % 100) / 100.0::DOUBLE AS confidence FROM base",
    "intervals": "SELECT * FROM (SELECT *, lead(t) OVER (PARTITION BY meeting_id ORDER BY t, ord) AS until FROM readings) WHERE until > t",
    "ovl": "SELECT s.meeting_id, s.ord, i.name, sum(least(s.end_time, i.until) - greatest(s.start_time, i.t)) AS overlap, min(i.ord) AS first FROM segments s JOIN intervals i ON s.meeting_id = i.meeting_id AND s.start_time < i.until AND s.end_time > i.t GROUP BY ALL",
    "vote": "SELECT meeting_id, ord, arg_min(name, n) AS name, max(score) / sum(score) AS share, (max(score) - coalesce(max(score) FILTER (n = 2), 0)) / sum(score) AS margin FROM "
    "(SELECT *, row_number() OVER (PARTITION BY meeting_id, ord ORDER BY score DESC, fv, ff) AS n FROM "
    "(SELECT s.meeting_id, s.ord, o.name, sum(o.overlap) AS score, min(v.ord) AS fv, arg_min(o.first, v.ord) AS ff FROM segments s JOIN segments v ON s.meeting_id = v.meeting_id AND s.label = v.label AND v.source = 'tab' AND v.end_time >= s.start_time - 30 AND v.start_time <= s.end_time + 30 "
    "JOIN ovl o ON o.meeting_id = v.meeting_id AND o.ord = v.ord WHERE s.source = 'tab' GROUP BY ALL)) GROUP BY ALL",
    "lines": r"SELECT doc_id, i - 1 AS ord, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)) WHERE trim(ls[i], ' ') <> ''",
    "claims": "SELECT CAST(floor(doc_id / 10) AS BIGINT) AS meeting_id, doc_id AS claim_ix, CASE WHEN toxic = 1 THEN 'UNSUPPORTED' WHEN doc_id % 7 = 3 THEN 'UNCERTAIN' WHEN quality = 1 THEN 'SUPPORTED' ELSE 'PARTIAL' END AS verdict, doc_id % 4 = 0 AS critical FROM labels",
    "gate_log": "SELECT user_id AS meeting_id, event_id AS eval_ix, ['gateA', 'gateB', 'gateC', 'gateD', 'gateE'][event_id % 5 + 1] AS gate, value > 50 AS fired FROM events",
}


def sql(query: str, *names: str) -> str:
    """The query over these derivations (in order of dependence)."""
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + query
