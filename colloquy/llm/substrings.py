"""Substring dedup with suffix automata of reference shards.

A passage is a repeat if ``threshold`` consecutive words of it (words: bytes
other than ASCII white space) also start in a document with a smaller id. Words
covered by repeats are removed; the document with the smallest id keeps them.

Texts are dealt once, into a table bucketed by row, and each later step joins
what it has found to that table without moving a text again:

1. Every window's least hash of 16 words (a minimizer) is found; those that two
   documents share are kept.
2. Windows in a row with the same shared minimizer make a run, of at most
   ``RUN`` windows, so that it has a bounded number of words. Runs of the same
   words are one passage; its first document stands for it. In all others, the
   whole run is a repeat.
3. Passages that share windows with other passages are references for later
   documents. They are dealt into shards of a bounded number of words; the
   automaton of a shard goes to all tasks that hold passages routed to it (a
   shard with much to do is sent to many tasks).
4. A task streams its passages through the automaton, keeping the state of the
   longest suffix of at most ``threshold`` words that occurs in the shard: where
   that length is reached and the state was first seen in a smaller document,
   the window is a repeat. This comparison is of whole words; hashes of windows
   only say what is routed where. (That runs are of the same words is told by a
   128-bit digest of them.)

Defined results: ids are integers; a null id comes after all others and isn't
smaller than another null id. Null and empty texts have no words. Documents of
equal id don't count against each other; repeated rows are judged alike. Texts
of fewer words than the threshold are kept. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gram_hashes, slices, word_hashes, word_spans, word_table, written

THRESHOLD = 50
GRAM = 16
#: Windows that one reference shard holds on average; its automaton has about twice as many states.
SHARD_WINDOWS = 4096
#: Windows of one run at most.
RUN = 64
#: Words streamed through one copy of an automaton, on average.
SLICE_WORDS = 1 << 16
_NO_ID = (1 << 63) - 1


class SuffixAutomaton:
    """A generalised suffix automaton over words; passages are added in ascending order of document."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [_NO_ID]
        self.number: dict[bytes, int] = {}

    def add(self, words: list[bytes], doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for word in words:
            t = self.number.setdefault(word, len(self.number))
            p, q = last, nxt[last].get(t)
            cur = -1
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                first.append(doc)
                while p >= 0 and t not in nxt[p]:
                    nxt[p][t] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][t]
            if length[q] != length[p] + 1:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and nxt[p].get(t) == q:
                    nxt[p][t] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            if cur < 0:
                last = q
            else:
                link[cur], last = q, cur

    def repeats(self, words: list[bytes], doc: int, threshold: int) -> list[int]:
        """The starts of all runs of ``threshold`` words that stand in a passage of a smaller document."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        out, v, matched = [], 0, 0
        for i, word in enumerate(words):
            t = self.number.get(word, -1)
            while v and t not in nxt[v]:
                v = link[v]
                matched = length[v]
            v = nxt[v].get(t, 0)
            matched = matched + 1 if v else 0
            if matched >= threshold:
                while length[link[v]] >= threshold:
                    v = link[v]
                matched = min(matched, length[v])
                if first[v] < doc:
                    out.append(i + 1 - threshold)
        return out


def _rolling_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == n else np.minimum(x[: len(x) - (n - width)], x[n - width :])


def _minimizers(words: np.ndarray, threshold: int) -> np.ndarray:
    """For each window of ``threshold`` words, the least hash of the runs of words in it."""
    n = min(GRAM, threshold)
    if len(words) < threshold:
        return np.zeros(0, np.uint64)
    return _rolling_min(gram_hashes(words, n), threshold - n + 1)


def _windows_of(column: pa.Array, threshold: int, hashes: Callable[[np.ndarray, int], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, one hash for each window) of all rows, by a function of the words' hashes."""
    table = word_table("nonspace")
    for first, end, data, offsets in slices(column):
        starts, ends, heads = word_spans(data, offsets, table)
        found = hashes(word_hashes(data, starts, ends), threshold)
        for row in range(end - first):
            a, b = int(heads[row]), int(heads[row + 1]) - threshold + 1
            yield first + row, found[a : max(a, b)]


def _grams(texts: DataFrame, threshold: int) -> DataFrame:
    """(rid, doc, grams): the minimizers of each row, each once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(least).view(np.int64) for _, least in _windows_of(batch.column(2), threshold, _minimizers)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(g) for g in grams])).astype(np.int32)), pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists], names=["rid", "doc", "grams"])

    return texts.select("rid", "doc", "text").mapInArrow(scan, "rid long, doc long, grams array<long>")


def run_bounds(least: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows of the runs: neighbours with the same minimizer, one of the shared ones."""
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    lengths = np.diff(np.append(heads, len(least)))
    kept = np.isin(least[heads], shared)
    heads, lengths = heads[kept], lengths[kept]
    pieces = -(-lengths // RUN)
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(heads, pieces) + RUN * place
    return starts, np.minimum(RUN, np.repeat(heads + lengths, pieces) - starts)


def _runs_of(candidates: DataFrame, threshold: int) -> DataFrame:
    """(rid, doc, start, n, words): the runs of windows with a shared minimizer, and a digest of the words of each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(1).to_numpy()
            for row, least in _windows_of(batch.column(2), threshold, _minimizers):
                starts, lengths = run_bounds(least, batch.column(3)[row].values.to_numpy().view(np.uint64))
                words = batch.column(2)[row].as_py().encode().split()
                ends = np.cumsum([len(w) + 1 for w in words]).tolist()
                text, digests = b" ".join(words), []
                for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
                    digests.append(hashlib.blake2b(text[ends[a - 1] if a else 0 : ends[a + n + threshold - 2] - 1], digest_size=16).digest())
                k = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column(0)[row].as_py(), k), pa.int64()), pa.array(np.repeat(docs[row], k)), pa.array(starts.astype(np.int32)), pa.array(lengths.astype(np.int32)), pa.array(digests, pa.binary())],
                    names=["rid", "doc", "start", "n", "words"],
                )

    return candidates.mapInArrow(scan, "rid long, doc long, start int, n int, words binary")


def _windows(firsts: DataFrame, threshold: int) -> DataFrame:
    """(w, run, doc, pos): hash and place of the windows of the runs (array of run, start, n) that each row is the first of."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lists = batch.column(0).to_numpy(), batch.column(2)
            for row, full in _windows_of(batch.column(1), threshold, gram_hashes):
                run, start, n = (lists[row].values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full[np.repeat(start, n) + pos].view(np.int64)), pa.array(np.repeat(run, n)), pa.array(np.full(len(pos), docs[row])), pa.array(pos.astype(np.int32))], names=["w", "run", "doc", "pos"]
                )

    return firsts.mapInArrow(scan, "w long, run long, doc long, pos int")


def _runs(at: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """(first word, end word) of passages made of the windows at these ascending positions."""
    cuts = np.flatnonzero(np.diff(at) > threshold) + 1
    for part in np.split(at, cuts):
        yield int(part[0]), int(part[-1]) + threshold


def _stretches(placed: DataFrame, threshold: int) -> DataFrame:
    """(shard, query, doc, run, start, n, text): stretches of runs, as references (query 0) and to be streamed (query 1)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, out = text.encode().split(), []
                for r in runs:
                    windows = sorted(r["windows"], key=lambda x: (x["shard"], x["own"], x["pos"]))
                    for (shard, own), group in itertools.groupby(windows, lambda x: (x["shard"], x["own"])):
                        for start, end in _runs(np.unique([x["pos"] for x in group]), threshold):
                            out.append((shard, 1 - own, doc, r["run"], start, end - start, b" ".join(words[r["start"] + start : r["start"] + end])))
                columns = list(zip(*out, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "query", "doc", "run", "start", "n", "text"])

    return placed.mapInArrow(cut, "shard long, query int, doc long, run long, start int, n int, text binary")


_SPANS = "array<struct<start:int,end:int>>"
_SPAN_LIST = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _stream(dealt: DataFrame, threshold: int) -> DataFrame:
    """(run, spans): repeats found by streaming each slice's passages through its shard's automaton; rows of a slice come with the references first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, SuffixAutomaton()
        for batch in batches:
            keys, spans = [], []
            for shard, part, query, doc, key, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, part) != now:
                    now, automaton = (shard, part), SuffixAutomaton()
                words = text.split(b" ")
                if not query:
                    automaton.add(words, doc)
                elif at := automaton.repeats(words, doc, threshold):
                    keys.append(key)
                    spans.append([{"start": start + a, "end": start + b} for a, b in _runs(np.array(at), threshold)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spans, _SPAN_LIST)], names=["run", "spans"])

    return dealt.mapInArrow(run, f"run long, spans {_SPANS}")


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut_out(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans, words_sha256, kept from texts and the spans found in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, spans, sha, kept = [], [], [], [], []
            for one, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words, out, at = (one.as_py() or "").encode().split(), [], 0
                gone = merged([(s["start"], s["end"]) for s in found or ()])
                for a, b in gone:
                    out += words[at:a]
                    at = b
                out += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(out))
                spans.append([{"start": a, "end": b} for a, b in gone])
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                kept.append(b" ".join(out).decode() if gone else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPAN_LIST), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "words_sha256", "kept"],
            )

    return found.mapInArrow(run, f"doc_id long, n_words long, n_removed long, spans {_SPANS}, words_sha256 string, kept string")


class _Texts:
    """The texts as a table bucketed by row, which joins by row don't shuffle; dropped at the end of the block."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.spark, self.name = docs.sparkSession, f"colloquy_texts_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # the number of a row is fixed once it is written
        rows = docs.withColumn("rid", F.monotonically_increasing_id()).repartition(parts, "rid").sortWithinPartitions("rid")
        rows.write.format("parquet").bucketBy(parts, "rid").sortBy("rid").option("path", f"{scratch.root}/texts").saveAsTable(self.name)

    def __enter__(self) -> DataFrame:
        return self.spark.table(self.name)

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: int = THRESHOLD,
    shard_windows: int = SHARD_WINDOWS,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """key, n_words, n_removed, spans (removed words, as start and end), words_sha256 (of all words, joined by a space), and kept: the words left, joined by a space, null where none is removed."""
    ids = F.col(f"`{key}`").cast("long")
    given = docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(_NO_ID)).alias("doc"), F.col(f"`{text}`").alias("text"))
    with Scratch(docs.sparkSession, "substrings") as scratch, _Texts(given, scratch) as texts:
        spans = _find_spans(texts, scratch, threshold, shard_windows, slice_words)
        found = _cut_out(texts.join(spans, "rid", "left").select("doc_id", "text", "spans"))
        return written(found.withColumnRenamed("doc_id", key), "substrings")


def _find_spans(texts: DataFrame, scratch: Scratch, threshold: int, shard_windows: int, slice_words: int) -> DataFrame:
    """(rid, spans): where the repeats of each row are; what is read twice, or joined by a key that may be hot, is written."""
    grams = scratch.table(_grams(texts, threshold), "grams").select("rid", "doc", F.explode("grams").alias("h"))
    shared = scratch.table(grams.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("h"), "shared")
    listed = grams.select("rid", "h").join(shared, "h", "left_semi").groupBy("rid").agg(F.collect_list("h").alias("grams"))
    runs = scratch.table(_runs_of(texts.join(listed, "rid").select("rid", "doc", "text", "grams"), threshold), "runs")

    firsts = runs.groupBy("words").agg(F.min(F.struct("doc", "rid", "start", "n")).alias("f")).select("words", "f.*")
    firsts = scratch.table(firsts.withColumn("run", F.monotonically_increasing_id()), "firsts")
    own = firsts.groupBy("rid").agg(F.collect_list(F.struct("run", "start", "n")).alias("runs"))
    windows = scratch.table(_windows(texts.join(own, "rid").select("doc", "text", "runs"), threshold), "windows")

    repeated = windows.groupBy("w").agg(F.min("doc").alias("first"), F.min_by("run", "doc").alias("in"), F.max("doc").alias("last")).filter("first < last")
    repeated = scratch.table(repeated.select("w", "first", "in"), "repeated")
    shards = max(1, -(-repeated.count() // shard_windows))
    placed = windows.join(repeated, "w").filter("in = run OR first < doc").select("run", F.struct("pos", F.pmod(F.xxhash64("in"), F.lit(shards)).alias("shard"), (F.col("in") == F.col("run")).cast("int").alias("own")).alias("window"))
    # at most RUN windows of each run, and the runs of one row
    listed = placed.groupBy("run").agg(F.collect_list("window").alias("windows")).join(firsts.select("run", "rid", "start"), "run")
    listed = listed.groupBy("rid").agg(F.collect_list(F.struct("run", "start", "windows")).alias("runs"))
    stretches = scratch.table(_stretches(texts.join(listed, "rid").select("doc", "text", "runs"), threshold), "stretches")

    parts = scratch.table(stretches.filter("query = 1").groupBy("shard").agg(F.ceil(F.sum("n") / slice_words).cast("int").alias("parts")), "parts")
    queries = stretches.filter("query = 1").join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("run", "start"), F.col("parts")).cast("int"))
    references = stretches.filter("query = 0").join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["shard", "part", "query", "doc", "run", "start", "text"]
    dealt = references.select(columns).unionAll(queries.select(columns)).repartition("shard", "part").sortWithinPartitions("shard", "part", "query", "doc", "start")
    hits = _stream(dealt, threshold).groupBy("run").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    judged = scratch.table(firsts.select("words", "run", F.col("doc").alias("first")).join(hits, "run", "left").drop("run"), "judged")
    whole = F.array(F.struct(F.col("start"), (F.col("start") + F.col("n") + threshold - 1).alias("end")))
    moved = F.transform("spans", lambda x: F.struct((x["start"] + F.col("start")).alias("start"), (x["end"] + F.col("start")).alias("end")))
    found = runs.join(judged, "words").select("rid", F.when(F.col("doc") > F.col("first"), whole).otherwise(moved).alias("spans")).filter("spans IS NOT NULL")
    return found.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
