"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over training token windows.

Words are runs of ASCII digits, ASCII letters (lower-cased) and bytes beyond
ASCII. A window is 13 consecutive words of a benchmark item; a shorter item is
one window. The hashes of all windows go to every task. A task hashes the
windows of its documents, looks them up, and compares the words of each hit
with the words of the benchmark window before it counts.

The benchmark is a fixed set; what is broadcast is checked against
``broadcast_bytes``. A larger benchmark is cut into blocks under that bound (an
item beyond it into parts that share their windows' words), and the documents are scanned once for each block, with the hits carried along.

Defined results: a null or empty text has no words and no hits; an item with no
words matches nothing; repeated documents are judged one by one; repeated items
with other ids all count; an item with a null id hits like any other and is not listed; an empty benchmark leaves all documents as they are;
other columns pass through, and those named like a result are replaced by it
(decontaminate() keeps them).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gram_hashes, lower_ascii, slices, word_hashes, word_spans, word_table, written

WINDOW = 13
BROADCAST_BYTES = 32 << 20
_RESULTS = ("n_words", "n_hit", "hit_words", "items", "contaminated")


def _windows(text: str, n: int) -> list[bytes]:
    data = lower_ascii(np.frombuffer(text.encode(), dtype=np.uint8))
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), word_table("alnum"))
    raw = data.tobytes()
    words = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
    if not words:
        return []
    size = min(n, len(words))
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


class NgramSet:
    """The windows of some benchmark items: by length a sorted array of hashes, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, str]], n: int = WINDOW):
        self.items: dict[bytes, list[str]] = {}
        for item, text in items:
            for window in set(_windows(text, n)):
                self.items.setdefault(window, []).extend([item] if item is not None else [])
        by_size: dict[int, list[bytes]] = {}
        for window in self.items:
            by_size.setdefault(window.count(b" ") + 1, []).append(window)
        self.hashes: dict[int, np.ndarray] = {}
        for size, windows in by_size.items():
            data = np.frombuffer(b" ".join(windows), dtype=np.uint8)
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), word_table("alnum"))
            self.hashes[size] = np.unique(gram_hashes(word_hashes(data, starts, ends), size)[::size])

    def scan(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[set[str] | None]]]:
        """For each run of texts: number of its first row, first word of each text (one more at the end), whether each word is hit, items of each text (None without a hit)."""
        table = word_table("alnum")
        for first, end, data, offsets in slices(column):
            data = lower_ascii(data)
            starts, ends, heads = word_spans(data, offsets, table)
            hashes = word_hashes(data, starts, ends)
            hit = np.zeros(len(starts) + 1, dtype=np.int64)
            items: list[set[str] | None] = [None] * (end - first)
            for size, known in self.hashes.items():
                grams = gram_hashes(hashes, size)
                bloom = np.zeros(1 << 20, dtype=bool)
                bloom[(known >> np.uint64(44)).astype(np.int64)] = True
                at = np.flatnonzero(bloom[(grams >> np.uint64(44)).astype(np.int64)])
                at = at[known[np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)] == grams[at]]
                text_of = np.searchsorted(heads, at, side="right") - 1
                inside = at + size <= heads[text_of + 1]
                for i, row in zip(at[inside].tolist(), text_of[inside].tolist(), strict=True):
                    window = b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + size], ends[i : i + size], strict=True))
                    if (found := self.items.get(window)) is not None:
                        hit[i] += 1
                        hit[i + size] -= 1
                        items[row] = (items[row] or set()).union(found)
            yield first, heads, np.cumsum(hit[:-1]) > 0, items


def _parts(text: str, window: int, most: int) -> Iterator[str]:
    """A text whose windows take more than ``most`` bytes in parts that hold each of its windows; each word stands in up to ``window`` of them."""
    if window * (len(text) + 64) <= most or window * (len(text.encode()) + 64) <= most:
        yield text
        return
    data = lower_ascii(np.frombuffer(text.encode(), dtype=np.uint8))
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), word_table("alnum"))
    raw, at = data.tobytes(), 0
    while at == 0 or at + window - 1 < len(starts):
        # as many words as fit, one window at least
        end = max(at + window, int(np.searchsorted(ends, (starts[at] if len(starts) else 0) + most // window - 64, side="right")))
        yield " ".join(raw[s:e].decode() for s, e in zip(starts[at:end], ends[at:end], strict=True))
        at = min(end, len(starts)) - window + 1
        if end >= len(starts):
            return


def _blocks(items: Iterator[tuple[str | None, str]], window: int, most: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items, long ones in parts, in blocks whose windows take about ``most`` bytes, one block in memory at a time."""
    block, size = [], 0
    for item, whole in items:
        for text in _parts(whole, window, most):
            cost = window * (len(text.encode()) + 64)
            if block and size + cost > most:
                yield block
                block, size = [], 0
            block.append((item, text))
            size += cost
    yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """docs with n_words, n_hit, hit_words (array of word numbers), items (item ids as sorted strings) and contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{item_text}`").cast("string")).toLocalIterator()
    blocks = _blocks(((r[0], r[1]) for r in items if r[1] is not None), window, broadcast_bytes)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in _RESULTS or c == text))
    hit_column, items_column, count_column = (f"{name}_{uuid.uuid4().hex}" for name in ("hit", "items", "count"))  # which no column has
    out = docs.select("*", F.lit(None).cast("array<int>").alias(hit_column), F.lit(None).cast("array<string>").alias(items_column))
    schema = T.StructType([*docs.schema.fields, T.StructField(hit_column, T.ArrayType(T.IntegerType())), T.StructField(items_column, T.ArrayType(T.StringType())), T.StructField(count_column, T.LongType())])
    grams = None
    for block in blocks:
        if grams is not None:  # what the block before has found is written, and its set is given up
            out = written(out.drop(count_column), "decontaminate")
            grams.destroy()
        grams = spark.sparkContext.broadcast(NgramSet(block, window))

        def scan(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                n_words, hits, found = [], batch.column(names.index(hit_column)).to_pylist(), batch.column(names.index(items_column)).to_pylist()
                for first, heads, hit, items in grams.value.scan(batch.column(names.index(text))):
                    n_words.append(np.diff(heads))
                    for row in range(len(heads) - 1):
                        if items[row] is not None:
                            at = np.flatnonzero(hit[heads[row] : heads[row + 1]]).tolist()
                            hits[first + row] = sorted({*(hits[first + row] or []), *at})
                            found[first + row] = sorted({*(found[first + row] or []), *items[row]})
                keep = [(name, batch.column(i)) for i, name in enumerate(names) if name not in (hit_column, items_column, count_column)]
                counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
                new = [(hit_column, pa.array(hits, pa.list_(pa.int32()))), (items_column, pa.array(found, pa.list_(pa.string()))), (count_column, pa.array(counts.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([c for _, c in [*keep, *new]], names=[c for c, _ in [*keep, *new]])

        out = out.mapInArrow(scan, schema)
    n_hit = F.coalesce(F.size(hit_column), F.lit(0)).cast("long")
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in _RESULTS),
        F.col(count_column).alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(hit_column, F.array().cast("array<int>")).alias("hit_words"),
        F.coalesce(items_column, F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col(count_column))).alias("contaminated"),
    )


def remove_spans(text: str, hit_words: list[int]) -> str:
    """The text without the bytes from the first to the last word of each run of hit words."""
    raw = text.encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), word_table("alnum"))
    out, at = [], 0
    for k, word in enumerate(hit_words):
        if k == 0 or word != hit_words[k - 1] + 1:
            out.append(raw[at : starts[word]])
        at = int(ends[word])
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **kwargs) -> DataFrame:
    """docs without contaminated documents, or (remove='spans') with all hit words cut from the texts."""
    # under other names, so that no column can clash with the results
    back = {c: "text" if c == text else f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(now) for c, now in back.items()))
    found = find_contamination(rows, benchmark, text="text", **kwargs)
    if remove == "documents":
        return found.filter(~F.col("contaminated")).select(*(F.col(now).alias(c) for c, now in back.items()))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(h) else remove_spans(t, list(h)) for t, h in zip(texts, hits, strict=True)], dtype=object)

    return found.select(*(cut(F.col(now), F.col("hit_words")).alias(c) if c == text else F.col(now).alias(c) for c, now in back.items()))

