"""Queries of the streams: recordings made of the given tables are written, read as streams until their end, and what the streams wrote is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import gates
from ..sources.replay import append_stream
from ..sources.work import work_folder
from ..streaming import capture, captions, sinks, views
from . import inputs as i
from .inputs import sql


#: A second on which made-up recordings begin.
DAY = 1_767_225_600


def _recorded(rows: DataFrame) -> DataFrame:
    """The rows as a stream of the files they are written to."""
    path = work_folder(rows.sparkSession, "recording")
    rows.write.parquet(path)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", captions.STATE_STORE)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def _finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _told(stream: DataFrame) -> DataFrame:
    out = work_folder(stream.sparkSession, "stream")
    _finished(append_stream(stream, out, f"{out}-checkpoint", None))
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _events(spark, d):
    return i.events(spark, d).withColumn("meeting_id", F.col("user_id").cast("string"))


def stream_final_lines(spark, d):
    """Each event is a line that is edited half a second later, without an author; each user stops a second after the last."""
    e = _events(spark, d)
    line = e.select("meeting_id", "ts", F.col("event_id").alias("line_id"), F.col("event_type").alias("author"), F.floor("value").cast("string").alias("text"), F.lit(False).alias("removed"), F.lit(False).alias("stopped"))
    edit = line.withColumns({"ts": F.col("ts") + F.expr("INTERVAL 0.5 SECOND"), "author": F.lit(None).cast("string"), "text": F.concat("text", F.lit(" more "))})
    nothing = F.lit(None).cast("string")
    stop = e.groupBy("meeting_id").agg((F.max("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts")).select("meeting_id", "ts", F.lit(None).cast("long").alias("line_id"), nothing.alias("author"), nothing.alias("text"), F.lit(False).alias("removed"), F.lit(True).alias("stopped"))
    found = _told(captions.finalize_lines(_recorded(line.unionByName(edit).unionByName(stop))))
    return found.select("meeting_id", "line_id", "author", "text", F.unix_millis("ts").alias("ms"))


def stream_captures(spark, d):
    """Captures of a user: events are captions, errors are reads; five minutes of silence end one."""
    e = _events(spark, d).select("meeting_id", "ts", F.when(F.col("event_type") == "error", "read").otherwise("caption").alias("kind"))
    return _told(capture.finalize_captures(_recorded(e))).select("meeting_id", "reason", F.unix_millis("ended_at").alias("ended_ms"), "captions", "reads")


def stream_presence(spark, d):
    """A user is present while events have values of 50 or more."""
    e = _events(spark, d).select("meeting_id", "ts", (F.col("value") >= 50).alias("present"))
    return _told(capture.debounce_presence(_recorded(e), 3600.0, 7200.0)).select("meeting_id", F.unix_millis("since").alias("since_ms"), "present")


def stream_snapshot_lines(spark, d):
    """Each turn of a conversation is a poll that shows the turn before it and itself."""
    said = F.struct(F.col("role").alias("speaker"), "text")
    c = i.read(spark, d, "conversations").withColumn("said", said).withColumn("before", F.lag("said").over(Window.partitionBy("conv_id").orderBy("turn")))
    polls = c.select(F.col("conv_id").cast("string").alias("meeting_id"), F.col("turn").cast("long").alias("poll"), F.timestamp_seconds(F.col("turn") + DAY).alias("ts"), F.array_compact(F.array("before", "said")).alias("shown"), F.lit(False).alias("stopped"))
    return _told(views.new_snapshot_lines(_recorded(polls))).select("meeting_id", "poll", "pos", "speaker", F.md5("text").alias("text"))


def stream_chrome(spark, d):
    b = i.base(spark, d).select(F.col("meeting_id").cast("string"), F.col("ord").cast("long").alias("poll"), F.timestamp_millis(F.floor(F.col("c0") * 10).cast("long") + 1000 * DAY).alias("ts"), F.array(F.struct(F.upper("role").alias("chunk"), (F.col("words") > 120).alias("caption_like"))).alias("chunks"), F.lit(False).alias("stopped"))
    return _told(views.learn_chrome(_recorded(b))).select("meeting_id", "chunk")


def stream_rates(spark, d):
    """Hourly rates in update mode, upserted by batch."""
    e = _recorded(i.events(spark, d).select("ts", (F.col("value") > 50).alias("escalated"), (F.col("event_type") == "error").alias("needs_review")))
    path = work_folder(spark, "rates")
    table = sinks.LatestTable(spark, path, ["hour"], "hour timestamp, n long, escalation_rate double, review_rate double, escalation_alarm boolean, review_alarm boolean")
    _finished(sinks.each_batch(gates.fleet_rates(e.withWatermark("ts", "1 day")), table.write, f"{path}-checkpoint", None, "update"))
    return table.rows().select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "n", F.round("escalation_rate", 6).alias("escalation_rate"), F.round("review_rate", 6).alias("review_rate"), "escalation_alarm", "review_alarm")


def stream_batches(spark, d):
    """Batches of a user (one for each type of event) are sent again and again; each counts once."""
    e = _events(spark, d).select("meeting_id", "ts", F.pmod(F.crc32(F.col("event_type").cast("binary")), F.lit(1000)).alias("seq"))
    path = work_folder(spark, "batches")
    _finished(sinks.each_batch(captions.dedupe_batches(_recorded(e), "365 days").select("meeting_id", "seq"), lambda batch, number: sinks.append_once(batch, number, path), f"{path}-checkpoint", None))
    return spark.read.parquet(path).groupBy("meeting_id").agg(F.count("*").alias("batches"))


QUERIES = {f.__name__: f for f in (stream_final_lines, stream_captures, stream_presence, stream_snapshot_lines, stream_chrome, stream_rates, stream_batches)}
ORACLES = {
    "stream_final_lines": "SELECT CAST(user_id AS VARCHAR) AS meeting_id, event_id AS line_id, event_type AS author, CAST(floor(value) AS BIGINT) || ' more' AS text, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events",
    "stream_captures": """WITH c AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 300 SECOND THEN 1 ELSE 0 END AS b FROM events WHERE event_type <> 'error')),
        s AS (SELECT user_id, max(ts) + INTERVAL 300 SECOND AS due, count(*) AS n FROM c GROUP BY user_id, s), p AS (SELECT *, coalesce(lag(due) OVER (PARTITION BY user_id ORDER BY due), TIMESTAMP '1970-01-01') AS prev FROM s)
        SELECT CAST(user_id AS VARCHAR) AS meeting_id, 'silence' AS reason, CAST(epoch_us(due) // 1000 AS BIGINT) AS ended_ms, n AS captions, (SELECT count(*) FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'error' AND e.ts >= prev AND e.ts < due) AS reads
        FROM p WHERE due <= (SELECT max(ts) FROM events) - INTERVAL 30 SECOND OR EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.ts >= due)""",
    "stream_presence": """WITH r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(value >= 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM (value >= 50) THEN 0 ELSE 1 END AS b FROM events)),
        g AS (SELECT user_id, run, min(ts) AS since, max(ts) AS last, bool_or(value >= 50) AS present FROM r GROUP BY user_id, run),
        s AS (SELECT *, coalesce(lag(present) OVER (PARTITION BY user_id ORDER BY since), false) AS before FROM g WHERE last - since >= CASE WHEN present THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END)
        SELECT CAST(user_id AS VARCHAR) AS meeting_id, CAST(epoch_us(since) // 1000 AS BIGINT) AS since_ms, present FROM s WHERE before <> present""",
    "stream_snapshot_lines": """SELECT meeting_id, poll, CAST(1 AS INTEGER) AS pos, speaker, md5(text) AS text FROM (SELECT CAST(conv_id AS VARCHAR) AS meeting_id, CAST(turn AS BIGINT) AS poll, role AS speaker, text, {'r': role, 't': text} AS x, lag({'r': role, 't': text}) OVER w AS x1, lag({'r': role, 't': text}, 2) OVER w AS x2,
        row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE k > 1 AND x IS DISTINCT FROM x1 AND x IS DISTINCT FROM x2""",
    "stream_chrome": sql("""SELECT DISTINCT meeting_id, chunk FROM (SELECT meeting_id, chunk, run, min(t) FILTER (free) AS t0, max(t) FILTER (free) AS t1 FROM (SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, lower(role) AS chunk, words <= 120 AS free,
        floor(c0 * 10) / 1000.0 - min(floor(c0 * 10) / 1000.0) OVER (PARTITION BY meeting_id) AS t, ord - row_number() OVER (PARTITION BY meeting_id, role ORDER BY ord) AS run FROM base) GROUP BY ALL) WHERE t0 < 3 OR t1 - t0 >= 15""", "base"),
    "stream_rates": "SELECT *, escalation_rate > 0.25 AS escalation_alarm, review_rate > 0.15 AS review_alarm FROM (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS escalation_rate, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS review_rate FROM events GROUP BY 1)",
    "stream_batches": "SELECT CAST(user_id AS VARCHAR) AS meeting_id, count(DISTINCT event_type) AS batches FROM events GROUP BY 1",
}
