"""Streaming sources: recorded captions, view snapshots and speaker readings as JSON lines that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each recorder writes.
RECORDINGS = {
    "captions": "meeting_id string, ord long, ts timestamp, speaker string, text string, stopped boolean",
    "mutations": "meeting_id string, ts timestamp, line_id long, author string, text string, removed boolean, stopped boolean",
    "views": "meeting_id string, poll long, ts timestamp, shown array<struct<speaker:string,text:string>>, stopped boolean",
    "screens": "meeting_id string, poll long, ts timestamp, chunks array<struct<chunk:string,caption_like:boolean>>, stopped boolean",
    "captures": "meeting_id string, ts timestamp, kind string",
    "snapshots": "meeting_id string, poll long, ts timestamp, line_no int, line string",
    "readings": "meeting_id string, ts timestamp, name string",
    "presence": "meeting_id string, ts timestamp, present boolean",
    "batches": "meeting_id string, seq long, ts timestamp, segments array<struct<source:string,label:string,start_time:double,end_time:double,text:string>>",
}


def read_recording(spark: SparkSession, kind: str, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the files that arrive in the folder, with the recorder's declared schema."""
    return spark.readStream.schema(RECORDINGS[kind]).option("maxFilesPerTrigger", files_per_batch).json(folder)


def append_stream(rows: DataFrame, path: str, checkpoint: str, seconds: int | None = 15):
    """Appends a stream to Parquet every so many seconds (None: what is there now, then it stops); the checkpoint makes it exactly once and lets it go on after a crash."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def append_metrics(points: DataFrame, path: str) -> None:
    """Metric points by day."""
    points.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def every_nth(readings: DataFrame, n: int = 10) -> DataFrame:
    """Each n-th poll of recorded readings (meeting_id, poll, ...): how often the roster is sampled beside the speaker."""
    return readings.filter(F.col("poll") % n == 0)


def live_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a stream has written so far: read again for each look, files that came since are seen."""
    return spark.read.schema(schema).parquet(path)
