"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a document's shingles of
five words (words: bytes other than ASCII white space, A-Z lower-cased; a text of
fewer words has one shingle, of all its words). The sketch of a union of parts
is the k smallest of the parts' hashes, so sketches merge in any order. From two
sketches come the estimated resemblance and containment, from one the number of
distinct shingles; with k or fewer shingles all three are exact.

As text, a sketch is the base64 form of its hashes in ascending order,
big-endian; equal shingle sets have equal text.

Defined results: a null or empty text has the empty sketch; two empty sketches
have likeness 1, an empty and another one 0; repeated rows are sketched alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import gram_hashes, lower_ascii, slices, word_hashes, word_spans, word_table

K = 128
SHINGLE = 5
#: Documents of a part on average, and parts; a task has about four.
ROWS_PER_PART = 1000
MOST_PARTS = 80_000
#: Code points of texts that are paired up at once.
CHARS_AT_ONCE = 1 << 20


def sketches(texts: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text, ascending."""
    table, out = word_table("nonspace"), []
    for first, end, data, offsets in slices(texts):
        data = lower_ascii(data)
        starts, ends, heads = word_spans(data, offsets, table)
        words = word_hashes(data, starts, ends)
        grams = gram_hashes(words, shingle)
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            n = b - a
            own = grams[a : b - shingle + 1] if n >= shingle else gram_hashes(words[a:b], n) if n else np.zeros(0, np.uint64)
            if len(own) > 4 * k:  # the smallest ones, with room for repeats; all of them if the room was too small
                near = np.unique(np.partition(own, 3 * k)[: 3 * k])
                own = near if len(near) >= k else own
            out.append(np.unique(own)[:k])
    return out


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the union's shingles that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = np.append(both[1:] == both[:-1], False)
    first = np.append(True, ~twice[:-1])  # each distinct hash once
    return float(twice[first][:k].sum() / min(k, first.sum()))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_shingles(a, k))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, n_shingles): the sketch of each text and the estimated number of its distinct shingles."""
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = sketches(batch.column(1), k, shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(s) for s in made], pa.string()), pa.array([distinct_shingles(s, k) for s in made], pa.float64())], names=[key, "fingerprint", "n_shingles"])

    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("fingerprint", T.StringType()), T.StructField("n_shingles", T.DoubleType())]))


def merge_fingerprints(rows: DataFrame, by: str, column: str = "fingerprint", k: int = K) -> DataFrame:
    """(by, fingerprint): the sketch of each group's union. Rows are dealt evenly and merged within each task first, so a large group meets as one sketch from each task."""
    schema = T.StructType([T.StructField(by, rows.schema[by].dataType), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sketch = None, None
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for name, text in zip(keys, batch.column(1).to_pylist(), strict=True):
                if sketch is not None and name == now:
                    sketch = merge(sketch, from_text(text), k)
                    continue
                if sketch is not None:
                    out.append((now, to_text(sketch)))
                now, sketch = name, from_text(text)
            yield _pairs(out, batch)
        if sketch is not None:
            yield _pairs([(now, to_text(sketch))], batch)

    def _pairs(out: list, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], batch.schema.field(0).type), pa.array([x for _, x in out], pa.string())], names=[by, "fingerprint"])

    parts = rows.select(F.col(f"`{by}`").alias(by), F.col(f"`{column}`").alias("fingerprint")).filter("fingerprint IS NOT NULL")
    once = parts.repartition(F.xxhash64("fingerprint")).sortWithinPartitions(by).mapInArrow(run, schema)
    return once.repartition(by).sortWithinPartitions(by).mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following one (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Each document's sketch beside that of its edited text and of the next document by descending id (the last one's next is the first).

    Documents are cut into parts by id (and a hash of the text, so that even one
    id may have very many rows). The parts' first keys, at most ``MOST_PARTS``,
    are found once, from ids alone, and go to all tasks: which part a document
    belongs to hangs on them only, and not on how Spark samples or deals a
    range. One shuffle brings parts together; a task compares the sorted
    documents of each part in a stream. The first and last document of each
    part are compared in a second pass.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text")
    parts = min(MOST_PARTS, max(48, docs.count() // ROWS_PER_PART))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    bounds = part_bounds(rows.select("doc_id", "h"), order, parts)
    rows = rows.withColumn("part", part_of(docs.sparkSession, bounds)("doc_id", "h"))
    schema = T.StructType.fromDDL(_RESULT.format(id=rows.schema["doc_id"].dataType.simpleString()))
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def results(ids: list, texts: list[str]) -> list[list]:
        """Columns of the result for all but the last of these neighbouring documents."""
        own = sketches(pa.array(texts, pa.large_string()), k, shingle)
        new = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        made = sketches(pa.array(new, pa.large_string()), k, shingle)
        return [
            ids[:-1],
            [len(t) for t in texts[:-1]],
            [hashlib.sha256(t.encode()).hexdigest() for t in new],
            [to_text(s) for s in own[:-1]],
            [to_text(s) for s in made],
            [resemblance(a, b, k) for a, b in zip(own[:-1], made, strict=True)],
            [resemblance(a, b, k) for a, b in zip(own[:-1], own[1:], strict=True)],
        ]

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str], bool]]:
        """(part, ids, texts, whether the part goes on) of neighbouring documents; what goes on begins with the last document before."""
        now, ids, texts, size = None, [], [], 0
        for batch in batches:
            for doc_id, part, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != now and ids:
                    yield now, ids, texts, False
                    ids, texts, size = [], [], 0
                now = part
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= CHARS_AT_ONCE and len(ids) > 1:
                    yield now, ids, texts, True
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if ids:
            yield now, ids, texts, False

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, _ in parts_of(batches):
            if len(ids) > 1:
                yield batch_of(results(ids, texts))

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last row of each part."""
        begun = False
        for part, ids, texts, goes_on in parts_of(batches):
            made = ([] if begun else [(ids[0], texts[0], part, "first")]) + ([] if goes_on else [(ids[-1], texts[-1], part, "last")])
            begun = goes_on
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), [id_type, pa.string(), pa.int32(), pa.string()], strict=True)], names=["doc_id", "text", "part", "edge"])

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row holds the last document of a task and the text of the first one of the next task."""
        for batch in batches:
            for row in batch.to_pylist():
                yield batch_of(results([row["doc_id"], None], [row["text"], row["after"]]))

    tasks = max(12, parts // 4)
    dealt = rows.repartition(tasks, "part").sortWithinPartitions("part", *order).select("doc_id", "part", "text")
    ends = dealt.mapInArrow(ends_of, T.StructType([rows.schema["doc_id"], rows.schema["text"], *T.StructType.fromDDL("part int, edge string").fields]))
    # the first row of a part goes to the part before it, that of the first part to the last one
    to = F.when(F.col("edge") == "last", F.col("part")).otherwise(F.pmod(F.col("part") - 1, F.lit(max(1, len(bounds)))))
    last, first = F.when(F.col("edge") == "last", F.struct("doc_id", "text")), F.when(F.col("edge") == "first", F.col("text"))
    pairs = ends.groupBy(to.alias("to")).agg(F.first(last, ignorenulls=True).alias("l"), F.first(first, ignorenulls=True).alias("after")).select("l.doc_id", "l.text", "after")
    return dealt.mapInArrow(pair_up, schema).unionAll(pairs.mapInArrow(join_ends, schema))


def in_order(a: tuple, b: tuple) -> int:
    """Compares keys (id, hash) by descending id, nulls last, and then by hash."""
    if a[0] != b[0]:
        return 1 if a[0] is None or (b[0] is not None and a[0] < b[0]) else -1
    return (a[1] > b[1]) - (a[1] < b[1])


def part_bounds(keys: DataFrame, order: list, parts: int) -> list[tuple]:
    """The first keys of parts of about equal size, in order: at most ``parts``; each is the key of a row."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    found = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(first, keys.schema)
    return sorted({tuple(r.values()) for r in found.toArrow().to_pylist()}, key=cmp_to_key(in_order))


def part_of(spark: SparkSession, bounds: list[tuple]):
    """The number of the part of a key, as a function of columns: that of the last bound not after it."""
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def part(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        key = cmp_to_key(in_order)
        return pa.array([max(0, bisect_right(shared.value, key(k), key=key) - 1) for k in zip(ids.to_pylist(), hashes.to_pylist(), strict=True)], pa.int32())

    return part
