"""WARC archives with a two-level capture index.

Archives: files of gzip members, one member for each record (WARC 1.1). Tasks
write them in the shared folder; a file counts only if the task that wrote it
committed the rows that name it, so lost executors and second attempts do no
harm. Of pages with equal payloads of at least ``revisit_bytes`` bytes, the one
with the largest id is stored as ``response``, the others as ``revisit`` without
the payload.

Index: one line for each capture (key, page id, type, file, offset, length),
sorted by a key that starts with the reversed host (``com,example,www)/path``).
First level: blocks of some thousand lines, compressed, in index files. Second
level: a sparse directory with the first key and the place of each block; blocks
grow with the number of captures so that the directory stays below
``most_blocks`` entries, and it is held on the driver. A lookup bisects the
directory, reads one block (or the few that a key spans) by a range read,
bisects its lines, and reads the records by range reads. Revisits find their
responses that way, in tasks; reading everything back goes block by block.

Folders are reached with pyarrow's file systems, from driver and tasks alike.

Defined results: a null payload is an empty one; a null url has the empty key;
of pages with equal payloads, a null page id is never the largest unless all are
null; rows repeated with the same page id and payload are alike in type; an
empty table gives an index without blocks; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written

REVISIT_BYTES = 1000
BLOCK_LINES = 2000
MOST_BLOCKS = 100_000
#: Bytes of archives that one task reads back at once.
STRETCH = 4 << 20
DATE = "2026-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def capture_key(url: str | None) -> str:
    """The url without scheme, user, default port and fragment, its host reversed."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.strip().lower()
    place = ",".join(reversed(host.split(".")))
    if port and (parts.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        place += f":{port}"
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _header_safe(value: str, also: str = "") -> str:
    return "".join(c if c > " " and c != "\x7f" and c not in also else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_id(page_id: str | None, digest: str) -> str:
    """The id of a page's record; whatever the page's id holds is escaped, and a null one has a form of its own."""
    return f"<urn:nopage:{digest}>" if page_id is None else f"<urn:page:{_header_safe(page_id, '%<>:')}:{digest}>"


def record_bytes(page_id: str | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: str | None, target: str | None = None, date: str = DATE) -> bytes:
    """One record, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if safe_url(url):
        lines.append(f"WARC-Target-URI: {safe_url(url)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", *([f"WARC-Refers-To-Target-URI: {safe_url(target)}"] if safe_url(target) else [])]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes

    @property
    def kind(self) -> str:
        return self.headers["WARC-Type"]

    def page(self, header: str = "WARC-Record-ID") -> str | None:
        found = self.headers.get(header, "")
        return unquote(found.removeprefix("<urn:page:").rpartition(":")[0]) if found.startswith("<urn:page:") else None


def parse_record(member: bytes) -> Record:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    return Record(headers, block.partition(b"\r\n\r\n")[2])


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = _place(uri)
    with system.open_input_file(path) as file:
        return file.read_at(length, offset)


class _Output:
    """A file of this task alone, opened at the first write."""

    def __init__(self, folder: str, ending: str):
        self.uri, self.folder, self.file, self.at = f"{folder}/{uuid.uuid4().hex}{ending}", folder, None, 0

    def add(self, data: bytes) -> int:
        if self.file is None:
            system, path = _place(self.uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.file = system.open_output_stream(path, compression=None)
        self.file.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


_CAPTURE = "key string, page_id string, kind string, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes a record for each page; (key, page_id as string, kind, file, offset, length) of the captures, as a written table."""
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    large = F.octet_length("payload") >= revisit_bytes
    # written, so that Spark sends few groups to all tasks, and can split a payload that very many pages share
    groups = written(rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.max_by("url", "page_id").alias("target"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("group"), "last", "target"), "warc-groups")
    # small payloads have no group; they get keys of their own, as one of them may be that of a third of all pages
    group = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small "), F.hex(F.xxhash64("digest", F.col("page_id").cast("string"), "url"))))
    typed = rows.withColumn("_key", group).join(groups, F.col("_key") == F.col("group"), "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    records = typed.select(
        F.col("page_id").cast("string"), "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("last").cast("string")).alias("refers_to"), "target"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = _Output(folder, ".warc.gz"), []
        for batch in batches:
            made = []
            for page, link, data, digest, kind, refers_to, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = record_bytes(page, link, data, digest, kind, refers_to, target)
                made.append((index_key(link), page, kind, out.uri, out.add(member), len(member)))
            done.append(made)
        out.close()  # rows that name the file leave only when it is whole
        for made in done:
            columns = list(zip(*made, strict=True)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "page_id", "kind", "file", "offset", "length"])

    return written(records.mapInArrow(write, _CAPTURE), "warc-captures")


@dataclass
class CaptureIndex:
    """The sparse directory: first key, file, offset and length of each block, and its first page id, in order of keys and page ids."""

    blocks: list[tuple[str, str, int, int, str | None]]
    #: Bytes of all records in the archives.
    record_bytes: int = 0

    def lookup(self, url: str) -> list[dict]:
        """All captures of a url."""
        key, found = index_key(url), []
        firsts = [b[0] for b in self.blocks]
        at = max(0, bisect.bisect_left(firsts, key) - 1)
        while at < len(self.blocks) and self.blocks[at][0] <= key:
            lines = read_block(*self.blocks[at][1:4])
            keys = [line.partition("\t")[0] for line in lines]
            found += [capture_of(line) for line in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
            at += 1
        return found

    def fetch(self, url: str) -> list[Record]:
        """The records of a url, each by a range read; a revisit has no payload of its own."""
        return [parse_record(read_range(c["file"], c["offset"], c["length"])) for c in self.lookup(url)]

    def captures(self, spark: SparkSession, blocks_per_task: int = 4) -> DataFrame:
        """All captures, read block by block in tasks."""
        rows = spark.createDataFrame([(i, *b[1:4]) for i, b in enumerate(self.blocks)], "i int, file string, offset long, length long")

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for place in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                    found = [capture_of(line) for line in read_block(*place)]
                    yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("key", pa.string()), ("page_id", pa.string()), ("kind", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

        return rows.repartition(max(1, -(-len(self.blocks) // blocks_per_task)), "i").mapInArrow(unpack, _CAPTURE)


def safe_url(url: str | None) -> str:
    """The url as a record's header holds it."""
    return _header_safe((url or "").strip())


def index_key(url: str | None) -> str:
    """The key of a url in the index: that of its form in a record, so that a revisit's header leads to it too."""
    return capture_key(safe_url(url))


def line_of(key: str, *rest) -> str:
    return f"{key}\t{json.dumps(rest, ensure_ascii=False)}"


def capture_of(line: str) -> dict:
    key, _, rest = line.partition("\t")
    return dict(zip(("key", "page_id", "kind", "file", "offset", "length"), (key, *json.loads(rest)), strict=True))


def read_block(uri: str, offset: int, length: int) -> list[str]:
    return zlib.decompress(read_range(uri, offset, length)).decode().split("\n")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, most_blocks: int = MOST_BLOCKS) -> CaptureIndex:
    """Sorts the captures by key into blocks; the directory comes to the driver (most_blocks entries, besides one for each task)."""
    total, size = captures.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    lines = max(block_lines, -(-total // most_blocks))
    clean = F.regexp_replace(F.coalesce("key", F.lit("")), "[\\t\\n]", "%20")
    ranged = captures.withColumn("key", clean).repartitionByRange(max(1, -(-total // (8 * lines))), "key", "page_id", "offset").sortWithinPartitions("key", "page_id", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, blocks = _Output(folder, ".cdx"), [], []

        def close_block(part: list[str]) -> None:
            data = zlib.compress("\n".join(part).encode(), 6)
            first = capture_of(part[0])
            blocks.append((first["key"], out.uri, out.add(data), len(data), first["page_id"]))

        for batch in batches:
            held += [line_of(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            while len(held) >= lines:
                close_block(held[:lines])
                held = held[lines:]
        if held:
            close_block(held)
        out.close()
        columns = list(zip(*blocks, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["first", "file", "offset", "length", "first_page"])

    directory = written(ranged.select("key", "page_id", "kind", "file", "offset", "length").mapInArrow(pack, "first string, file string, offset long, length long, first_page string"), "warc-directory")
    return CaptureIndex(sorted((tuple(r) for r in directory.collect()), key=lambda b: (*place_of(b[0], b[4]), b[1], b[2])), size)


def place_of(key: str, page_id: str | None) -> tuple[str, bool, str]:
    """Where a capture stands in the index: in the order of UTF-8 bytes (that of Python's code points), null before all ids, as Spark sorts."""
    return key, page_id is not None, page_id or ""


def find_captures(blocks: list[tuple], places: list[tuple], key: str, page_id: str | None, read: Callable[[int], list[str]]) -> list[dict]:
    """The captures of one page under one key: the directory's places are bisected for the block, and the block for its lines."""
    wanted = place_of(key, page_id)
    at, found = max(0, bisect.bisect_left(places, wanted) - 1), []
    while at < len(blocks) and places[at] <= wanted:
        lines = read(at)
        order = lambda line: place_of((c := capture_of(line))["key"], c["page_id"])
        found += [capture_of(line) for line in lines[bisect.bisect_left(lines, wanted, key=order) : bisect.bisect_right(lines, wanted, key=order)]]
        at += 1
    return found


def read_records(captures: DataFrame, record_bytes: int | None = None) -> DataFrame:
    """(page_id, kind, refers_to, payload_bytes, payload_digest, named_digest, target): every capture's record by a range read; size and digest are of the payload found (none for a revisit).

    Tasks take stretches of about ``STRETCH`` bytes of a file; ``record_bytes`` (by default summed up) gives their number.
    """
    if record_bytes is None:
        record_bytes = captures.agg(F.sum("length")).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        for batch in batches:
            made = []
            for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri != now:
                    if file:
                        file.close()
                    system, path = _place(uri)
                    now, file = uri, system.open_input_file(path)
                record = parse_record(file.read_at(length, offset))
                whole = record.kind == "response"
                digest = hashlib.sha1(record.payload).hexdigest()
                if whole and record.headers["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError(f"damaged record in {uri} at {offset}")
                named = record.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                target = record.headers.get("WARC-Refers-To-Target-URI", "")
                made.append((record.page(), record.kind, record.page("WARC-Refers-To"), len(record.payload) if whole else None, digest if whole else None, named, target))
            columns = list(zip(*made, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "kind", "refers_to", "payload_bytes", "payload_digest", "named_digest", "target"])
        if file:
            file.close()

    stretch = F.floor(F.col("offset") / STRETCH).alias("stretch")
    dealt = captures.select("file", "offset", "length", stretch).repartition(max(1, -(-record_bytes // STRETCH)), "file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return dealt.mapInArrow(read, "page_id string, kind string, refers_to string, payload_bytes long, payload_digest string, named_digest string, target string")


def resolve_revisits(records: DataFrame, index: CaptureIndex) -> DataFrame:
    """The records with the size and digest of revisits taken from the response they refer to, which is looked up in the index.

    Each response is asked for once. The directory (bounded by ``most_blocks``) goes to all tasks; a task bisects it,
    reads a block by a range read (once for all it asks there), bisects its lines, and reads the record by a range read.
    """
    spark = records.sparkSession
    again = records.filter("kind = 'revisit'").drop("payload_bytes", "payload_digest")
    shared = spark.sparkContext.broadcast((index.blocks, [place_of(b[0], b[4]) for b in index.blocks]))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, places = shared.value
        last: tuple[int, list[str]] = (-1, [])

        def read(at: int) -> list[str]:
            nonlocal last
            if last[0] != at:
                last = (at, read_block(*blocks[at][1:4]))
            return last[1]

        for batch in batches:
            made = []
            for page, named, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for c in find_captures(blocks, places, index_key(target), page, read):
                    if c["kind"] == "response":
                        payload = parse_record(read_range(c["file"], c["offset"], c["length"])).payload
                        if (digest := hashlib.sha1(payload).hexdigest()) == named:
                            made.append((page, named, len(payload), digest))
                            break
            columns = list(zip(*made, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int64(), pa.string()], strict=True)], names=["of_page", "of_named", "of_bytes", "of_digest"])

    asked = again.select("refers_to", "named_digest", "target").distinct().repartitionByRange("target", "refers_to").sortWithinPartitions("target", "refers_to")
    # written, so that Spark can split a response that very many revisits refer to
    stored = written(asked.mapInArrow(fetch, "of_page string, of_named string, of_bytes long, of_digest string"), "warc-stored")
    found = again.join(stored, again.refers_to.eqNullSafe(stored.of_page) & (again.named_digest == stored.of_named))
    columns = ["page_id", "kind", "refers_to", "payload_bytes", "payload_digest"]
    whole = records.filter("kind = 'response'").select(columns)
    return whole.unionAll(found.select("page_id", "kind", "refers_to", F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest")))


def archive(pages: DataFrame, folder: str | None = None, **kwargs) -> CaptureIndex:
    """Writes pages as archives with their index, in ``folder`` or a new one in the shared folder."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return build_index(write_archives(pages, folder, **kwargs), folder)
