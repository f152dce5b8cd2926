"""Keyed tables on Parquet: scans, pages, conditional and partial writes, and artifacts as JSON.

A table is a DataFrame with its key columns; a write gives the new state of the
table, for the caller to store (by partition, so that only tenants that changed
are rewritten).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as v
from .schemas import RECOGNISER_OUTPUT, schema


# scans -----------------------------------------------------------------------
def get(table: DataFrame, **key) -> DataFrame:
    """The row of a key: a filter that reaches the scan."""
    for name, value in key.items():
        table = table.filter(F.col(name) == value)
    return table


def prefix_scan(table: DataFrame, sort_key: str, prefix: str, descending: bool = True, **partition) -> DataFrame:
    rows = get(table, **partition).filter(F.col(sort_key).startswith(prefix))
    return rows.orderBy(F.col(sort_key).desc() if descending else F.col(sort_key))


def page(table: DataFrame, order: Sequence[str], limit: int, cursor: Sequence | None = None, descending: bool = True) -> DataFrame:
    """The next rows after a cursor (the last row's key values), with column ``cursor`` for the page after.

    A keyset page: no offset is counted, and each task keeps ``limit`` rows.
    """
    rows = table
    if cursor is not None:
        past = F.lit(False)
        equal = F.lit(True)
        for name, value in zip(order, cursor, strict=True):
            past = past | (equal & ((F.col(name) < value) if descending else (F.col(name) > value)))
            equal = equal & (F.col(name) == value)
        rows = rows.filter(past)
    rows = rows.orderBy(*(F.col(c).desc() if descending else F.col(c) for c in order)).limit(limit)
    return rows.withColumn("cursor", v.cursor(*map(F.col, order)))


def live_segments(batches: DataFrame) -> DataFrame:
    """Segments of the appended batches in order of their sequence: meeting_id, ord, and the segment's fields."""
    rows = batches.select("meeting_id", "seq", F.posexplode("segments").alias("pos", "s"))
    w = Window.partitionBy("meeting_id").orderBy("seq", "pos")
    return rows.select("meeting_id", (F.row_number().over(w) - 1).alias("ord"), "s.*")


def batch_sort_key(seq: Column) -> Column:
    return F.concat(F.lit("SEGS#"), F.lpad(seq.cast("string"), 8, "0"))


def with_fallback(preferred: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The preferred rows, and the other ones of keys that have none."""
    rest = other.join(preferred.select(*keys).distinct(), list(keys), "left_anti")
    return preferred.unionByName(rest, allowMissingColumns=True)


def optional(rows: DataFrame, artifact: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(artifact, list(keys), "left")


def with_existence(rows: DataFrame, listing: DataFrame, keys: Sequence[str], name: str = "exists") -> DataFrame:
    marks = listing.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(marks, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def owned(table: DataFrame, owner: str, time: str = "created_at", columns: Sequence[str] | None = None) -> DataFrame:
    rows = table.filter(F.col("owner_sub") == owner).orderBy(F.col(time).desc())
    return rows.select(*columns) if columns else rows


def meeting_details(meetings: DataFrame, **artifacts: DataFrame) -> DataFrame:
    """meetings with a column for each artifact table (meeting_id and one struct or array column named value)."""
    for name, table in artifacts.items():
        meetings = meetings.join(table.select("meeting_id", F.col("value").alias(name)), "meeting_id", "left")
    return meetings


def users_with_group(users: DataFrame, members: DataFrame, group: str, limit: int = 60) -> DataFrame:
    """The first users by name, with whether each is in the group."""
    inside = members.filter(F.col("group") == group).select("user_id").distinct().withColumn("in_group", F.lit(True))
    return users.orderBy("user_name", "user_id").limit(limit).join(inside, "user_id", "left").withColumn("in_group", F.coalesce("in_group", F.lit(False)))


def matching_keys(entries: DataFrame, pattern: str, value_schema: str, key: str = "key", value: str = "value") -> DataFrame:
    """Entries whose key matches, with the value parsed; those that don't parse are null."""
    return entries.filter(F.col(key).rlike(pattern)).withColumn("parsed", F.from_json(value, value_schema))


# writes ----------------------------------------------------------------------
def put(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with rows in place of those of equal keys."""
    return table.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def put_if_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(new table, the winner for each row): a row is stored only if its key is free; the first to arrive wins."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*arrival, *(c for c in rows.columns if c not in (*keys, *arrival)))).alias("_r"))
    first = first.select(*keys, "_r.*").select(*rows.columns)
    added = first.join(table.select(*keys), list(keys), "left_anti")
    state = table.unionByName(added, allowMissingColumns=True)
    return state, rows.select(*keys).join(state, list(keys))


def append_batches(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches, meeting_id and segment_count): a batch counts once for its (meeting, seq), however often it is sent; of resent ones the first to arrive stays."""
    rows = incoming.join(stored.select("meeting_id", "seq"), ["meeting_id", "seq"], "left_anti")
    columns = [c for c in incoming.columns if c not in ("meeting_id", "seq", "arrival")]
    new = rows.groupBy("meeting_id", "seq").agg(F.min_by(F.struct(*columns), "arrival").alias("_r")).select("meeting_id", "seq", "_r.*")
    state = stored.unionByName(new, allowMissingColumns=True)
    return state, state.groupBy("meeting_id").agg(F.sum(F.size("segments")).alias("segment_count"))


def update(table: DataFrame, patches: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The table with patched fields: patches have the keys, and for each field ``<field>`` and ``<field>_set``; set with null removes the value."""
    renamed = patches.select(*keys, *(F.struct(F.col(f).alias("value"), F.col(f"{f}_set").alias("set")).alias(f"_{f}") for f in fields))
    rows = table.join(renamed, list(keys), "left")
    return rows.select(*(F.when(F.col(f"_{c}.set"), F.col(f"_{c}.value")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns))


def delete_cascade(keys: DataFrame, on: Sequence[str], **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the keys."""
    gone = keys.select(*on).distinct()
    return {name: t.join(gone, list(on), "left_anti") for name, t in tables.items()}


def by_job(jobs: DataFrame, tokens: DataFrame) -> DataFrame:
    return jobs.join(tokens, "job_name")


# artifacts and files -----------------------------------------------------------
def write_artifact(rows: DataFrame, folder: str, name: str) -> None:
    """JSON lines by tenant and meeting: one folder for each artifact. Only the meetings in rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id", "meeting_id").json(f"{folder}/{name}")


def read_artifact(spark: SparkSession, folder: str, name: str, ddl: str | None = None) -> DataFrame:
    """An artifact with its declared schema; lines that don't parse keep their text in _corrupt_record."""
    return spark.read.schema(ddl or schema(name)).option("mode", "PERMISSIVE").json(f"{folder}/{name}")


def read_json_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(f"{ddl}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_golden(spark: SparkSession, path: str, ddl: str = "question string, expected_id string") -> DataFrame:
    """A golden set (a JSON array); entries without question or id don't count."""
    rows = spark.read.schema(ddl).option("multiLine", True).json(path)
    return rows.filter((F.trim("question") != "") & (F.trim("expected_id") != ""))


def recogniser_items(rows: DataFrame, column: str = "json") -> DataFrame:
    """meeting_id, ord, type, start_time, end_time, content, confidence from the recogniser's JSON."""
    parsed = rows.select("meeting_id", F.from_json(column, RECOGNISER_OUTPUT).alias("j"))
    items = parsed.select("meeting_id", F.posexplode("j.results.items").alias("ord", "i"))
    best = F.get("i.alternatives", F.lit(0))
    return items.select(
        "meeting_id", "ord", "i.type", F.col("i.start_time").cast("double").alias("start_time"), F.col("i.end_time").cast("double").alias("end_time"),
        best["content"].alias("content"), best["confidence"].cast("double").alias("confidence"),
    )


def transcript_lines(turns: DataFrame) -> DataFrame:
    """meeting_id, ord, line: '[hh:mm:ss] name: text' of captions (at, speaker, text)."""
    line = F.concat(F.lit("["), F.date_format("at", "HH:mm:ss"), F.lit("] "), "speaker", F.lit(": "), "text")
    return turns.select("meeting_id", "ord", line.alias("line"))


def append_transcript(turns: DataFrame, folder: str) -> None:
    """Adds captions to what is there: lines under text, and the rows as JSON lines under json, sorted within files by meeting and place."""
    sorted_rows = turns.repartitionByRange("meeting_id", "ord").sortWithinPartitions("meeting_id", "ord")
    transcript_lines(sorted_rows).select(F.col("line").alias("value")).write.mode("append").text(f"{folder}/text")
    sorted_rows.write.mode("append").json(f"{folder}/json")


def archive_entries(files: DataFrame, content: str = "content") -> DataFrame:
    """files with size and crc32 of each entry, as an archive's directory needs them."""
    data = F.col(content).cast("binary")
    return files.withColumns({"size": F.octet_length(data).cast("long"), "crc32": F.crc32(data)})


def write_archive(files: DataFrame, path: str, name: str = "name", content: str = "content", most_bytes: int = 256 << 20) -> None:
    """One ZIP of stored entries. An archive is one file and so the work of one process: larger contents than ``most_bytes`` are refused."""
    import zipfile

    total = files.agg(F.sum(F.octet_length(F.col(content).cast("binary")))).first()[0] or 0
    if total > most_bytes:
        raise ValueError(f"{total} bytes are too many for one archive; write several")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as archive:
        for row in files.select(name, F.col(content).cast("binary")).orderBy(name).toLocalIterator():
            archive.writestr(row[0], bytes(row[1] or b""))


def put_vectors(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The vectors after an upsert by (tenant_id, key); null metadata entries are left out."""
    clean = rows.withColumn("metadata", F.map_filter("metadata", lambda _, x: x.isNotNull())) if "metadata" in rows.columns else rows
    return put(stored, clean, ["tenant_id", "key"])


def write_vectors(rows: DataFrame, path: str) -> None:
    """Upserts vectors (tenant_id, index_version, key, ...) in a table by tenant and version; only the partitions of rows are rewritten, through a second copy.

    A copy that is complete is what the table is to become: if a write stopped after it, the next one finishes that first.
    """
    spark, keys = rows.sparkSession, ["tenant_id", "index_version"]
    place, copy, done = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.next", f"{path}.next/_SUCCESS"))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())

    def replace(new: DataFrame) -> None:
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)

    def replace_by_copy() -> None:
        replace(spark.read.schema(rows.schema).parquet(f"{path}.next"))
        files.delete(copy, True)

    if files.exists(done):
        replace_by_copy()
    if not files.exists(place):
        replace(rows)
        return
    stored = spark.read.schema(rows.schema).parquet(path).select(*rows.columns).join(rows.select(*keys).distinct(), keys, "left_semi")
    put(stored, rows, [*keys, "key"]).write.mode("overwrite").partitionBy(*keys).parquet(f"{path}.next")
    replace_by_copy()


def ensure_table(spark: SparkSession, name: str, ddl: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")
