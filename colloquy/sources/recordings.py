"""A streaming source over recordings that are still being written: files of JSON lines that grow.

Spark's file source takes a file once, whole. This one keeps an offset for each
file, the bytes of its complete lines, so that lines appended later come in a
later batch, each once, and a restarted query goes on where its checkpoint says.
A batch is read in stretches of files, each by its own task. Files are reached
through Arrow's file systems.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .replay import RECORDINGS

#: Bytes of a file that one task reads, up to the next line end.
STRETCH = 16 << 20
_TAIL = 1 << 16


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def complete_bytes(fs: pafs.FileSystem, path: str, size: int, known: int) -> int:
    """Where the last complete line of a file ends: only what came since is looked at, from behind."""
    with fs.open_input_file(path) as file:
        end = size
        while end > known:
            start = max(known, end - _TAIL)
            at = file.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return known


class RecordingReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, folder: str, stretch: int):
        self.schema, self.folder, self.stretch = schema, folder, stretch
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, folder = _open(self.folder)
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        files = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
        self.known = {f.path: complete_bytes(fs, f.path, f.size, self.known.get(f.path, 0)) for f in files}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, last in sorted(end.items()):
            for at in range(start.get(path, 0), last, self.stretch):
                out.append(Stretch(path, at, min(at + self.stretch, last)))
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the stretch; the last one may end beyond it."""
        fs, _ = _open(self.folder)
        with fs.open_input_file(partition.path) as file:
            data = file.read_at(partition.end - partition.start, partition.start)
            skip = 0
            if partition.start and file.read_at(1, partition.start - 1) != b"\n":
                skip = data.find(b"\n") + 1 or len(data)
            end = partition.end
            while data[skip:] and not data.endswith(b"\n"):
                more = file.read_at(_TAIL, end)
                cut = more.find(b"\n") + 1
                data, end = data + (more[:cut] if cut else more), end + len(more)
                if not more:
                    break
        rows = [json.loads(line) for line in data[skip:].splitlines() if line.strip()]
        if rows:
            yield from _rows(rows, self.schema).to_batches()

    def commit(self, end: dict) -> None:
        pass


def _rows(rows: list[dict], schema: StructType) -> pa.Table:
    """Recorded rows in the declared schema; times are ISO texts, fields that miss are null."""
    import datetime as dt

    kinds = to_arrow_schema(schema)

    def value(x: object, kind: pa.DataType) -> object:
        if pa.types.is_timestamp(kind) and isinstance(x, str):
            at = dt.datetime.fromisoformat(x)
            return at if at.tzinfo else at.replace(tzinfo=dt.UTC)
        return x

    return pa.Table.from_arrays([pa.array([value(r.get(f.name), f.type) for r in rows], f.type) for f in kinds], schema=kinds)


class RecordingSource(DataSource):
    """``spark.readStream.format("recording").option("kind", ...).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return RECORDINGS[self.options["kind"]]

    def streamReader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(schema, self.options["path"], int(self.options.get("stretch", STRETCH)))


def follow(spark: SparkSession, kind: str, folder: str, stretch: int = STRETCH):
    """A stream of a recorder's growing files."""
    spark.dataSource.register(RecordingSource)
    return spark.readStream.format("recording").option("kind", kind).option("stretch", stretch).load(folder)
