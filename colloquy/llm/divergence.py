"""Audit of how the sources of a language differ in their use of terms.

Terms are runs of letters (A-Z lower-cased; all beyond ASCII counts as letters).
A language keeps the terms that stand in at least ``min_docs`` of its documents.
A group (language, source), or the language as a whole, gives a term with
``count`` occurrences there p = 1 + floor(SCALE * (count + 1) / (N + V)), where V
terms are kept and N is the group's sum of counts. How far p lies from q is
floor((p - q)**2 / q).

Count columns are deduplicated: a term has a sparse vector of (source, count),
most terms share theirs with others, and pairs of sources are evaluated once for
each distinct vector and multiplied by the number of its terms. Where neither
source of a pair has the term, the value depends on the pair only, so a vector
costs its sources times all sources of the language, and the rest is counted.
Single terms of a group are ranked in their own rows.

Texts are counted by task into rows (language, source, term, count, documents)
before anything is shuffled: terms are found in the bytes of many texts at once, numbered by Arrow
(by their bytes, not by a hash) and counted by sorted numbers. Vectors are dealt by (language, part), with the
list of the language's sources before them, and each part hands on one sum for
each pair; so a language or source that holds most rows is spread (of a language with very
many sources, blocks of pairs go to tasks of their own), and nothing
is broadcast but by Spark's own check of a table's size. Ranks of terms are cut
by Spark in each task before the shuffle.

Defined results: null text, language and source are empty strings; each row is a
document of its own, repeated ones too; a group without terms has all pairs, and
no terms; a language without kept terms has pairs of value 0. Ties of values go
to the smaller item by UTF-8. An empty table gives no rows. Other columns are
ignored. Arithmetic is of integers throughout; counts beyond 9e9 are taken
through Python's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, release, slices, word_spans, written

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Occurrences of terms, and their bytes, that a task counts before it hands them on.
TALLY_TERMS, TALLY_BYTES = 1 << 21, 64 << 20
#: Rows of one batch of counts.
TALLY_ROWS = 100_000
#: Distinct vectors of one part.
PART_VECTORS = 1 << 14
#: Pairs whose sums a task holds at once; a language with more has its sources in several blocks.
BLOCK_PAIRS = 1 << 22
#: Cells of the matrix of counts that a task evaluates at once.
CELLS = 1 << 21
#: Bytes of terms: letters, and all beyond ASCII.
_LETTERS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n, docs: partial counts of each task; the same term may have several rows."""
    given = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c2) for c, c2 in ((lang, "lang"), (source, "source"), (text, "text"))))

    def tally(terms: list[pa.Array], docs: list[np.ndarray], group_of: list[int], names: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        """Counts of the waiting terms, whose documents are numbered: first by document and term, then by group and term."""
        found = pa.concat_arrays(terms).dictionary_encode()
        size = len(found.dictionary)
        both = np.concatenate(docs) * size + found.indices.to_numpy()
        both.sort()
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        times, doc = np.diff(first, append=len(both)), both[first] // size
        both = np.array(group_of, dtype=np.int64)[doc] * size + both[first] % size
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        n, d = np.add.reduceat(times[order], first), np.diff(first, append=len(both))
        langs, sources = (pa.array(part, pa.string()) for part in zip(*names, strict=True))
        for at in range(0, len(first), TALLY_ROWS):
            some = slice(at, at + TALLY_ROWS)
            group, term = np.divmod(both[first[some]], size)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(group)), sources.take(pa.array(group)), found.dictionary.take(pa.array(term)), pa.array(n[some]), pa.array(d[some])],
                names=["lang", "source", "term", "n", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        terms, docs, group_of, held = [], [], [], [0, 0]
        for batch in batches:
            own = [groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            for begin, end, data, offsets in slices(batch.column(2)):
                starts, ends, at = word_spans(data, offsets, _LETTERS)
                if len(starts):
                    letters = lower_ascii(data[_LETTERS[data]])
                    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
                    terms.append(pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(letters)))
                    docs.append(np.repeat(np.arange(len(group_of), len(group_of) + end - begin), np.diff(at)))
                    group_of += own[begin:end]
                    held = [held[0] + len(starts), held[1] + len(letters)]
                if held[0] > TALLY_TERMS or held[1] > TALLY_BYTES:
                    yield from tally(terms, docs, group_of, list(groups))
                    terms, docs, group_of, held = [], [], [], [0, 0]
        if terms:
            yield from tally(terms, docs, group_of, list(groups))
        release()

    return given.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, vector: the kept terms with their counts by source, ascending."""
    # one shuffle, by (lang, term), serves both sums
    sums = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return vectors.filter(F.col("docs") >= min_docs).select("lang", "term", "vector")


def likelihood(count: Column, total: Column, terms: Column) -> Column:
    """p of a count, exact: the products go beyond a long."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    narrow = count < 9 * 10**9
    return F.when(narrow, F.lit(1) + F.call_function("div", F.when(narrow, count + 1) * SCALE, total + terms)).otherwise(F.lit(1) + F.call_function("div", wide, (total + terms).cast("decimal(20,0)")))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def probabilities(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """p of a matrix of counts whose columns are groups with these totals."""
    if counts.size and int(counts.max()) >= 9 * 10**9:
        return ((counts.astype(object) + 1) * SCALE // (totals.astype(object) + terms) + 1).astype(np.int64)
    return (counts + 1) * SCALE // (totals + terms) + 1


class PairSums:
    """The sums over terms of one part for ordered pairs of the sources of a language: those whose first source is in a block of them."""

    def __init__(self, names: list[str], totals: np.ndarray, terms: int, block: int = 0, blocks: int = 1):
        self.names, self.totals, self.terms = names, totals, terms
        k = len(names)
        self.rows = range(k * block // blocks, k * (block + 1) // blocks)
        self.place = {name: i for i, name in enumerate(names)}
        self.zero = probabilities(np.zeros((1, k), np.int64), totals, terms)[0] if terms else np.ones(k, np.int64)
        self.sums, self.either = np.zeros((len(self.rows), k), np.int64), np.zeros((len(self.rows), k), np.int64)
        self.waiting: list[tuple[list, int]] = []

    def add(self, vector: list[dict], times: int) -> None:
        self.waiting.append((vector, times))
        if len(self.waiting) * len(self.names) >= CELLS:
            self.evaluate()

    def evaluate(self) -> None:
        """Evaluates the waiting vectors: each pair of which a source has the term, by the pair's first source and by its second."""
        times = np.array([t for _, t in self.waiting], dtype=np.int64)
        counts = np.zeros((len(times), len(self.names)), np.int64)
        for row, (vector, _) in enumerate(self.waiting):
            for cell in vector:
                counts[row, self.place[cell["source"]]] = cell["n"]
        self.waiting = []
        p, has = probabilities(counts, self.totals, self.terms), counts > 0
        first = slice(self.rows.start, self.rows.stop)
        for s in range(len(self.names)):
            rows = np.flatnonzero(has[:, s])
            if not len(rows):
                continue
            own, weight = p[rows, s][:, None], times[rows][:, None]
            if s in self.rows:
                others, r = p[rows], s - self.rows.start
                self.sums[r] += ((own - others) ** 2 // others * weight).sum(axis=0)
                self.either[r] += weight.sum()
            alone = np.where(has[rows, first], 0, weight)
            self.sums[:, s] += ((own - p[rows, first]) ** 2 // own * alone).sum(axis=0)
            self.either[:, s] += alone.sum(axis=0)

    def table(self, lang: str, whole: bool) -> pa.RecordBatch:
        """Sums of all pairs; ``whole`` adds all terms as if no source had them, which each part takes back for its own."""
        if self.waiting:
            self.evaluate()
        k = len(self.names)
        neither = (self.terms if whole else 0) - self.either
        base = (self.zero[self.rows.start : self.rows.stop, None] - self.zero[None, :]) ** 2 // self.zero[None, :]
        values = self.sums + neither * base if self.terms else self.sums
        a, b = np.nonzero(np.arange(self.rows.start, self.rows.stop)[:, None] != np.arange(k)[None, :])
        names = np.array(self.names, dtype=object)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(names[a + self.rows.start], pa.string()), pa.array(names[b], pa.string()), pa.array(values[a, b], pa.int64())], names=["lang", "source", "item", "value"])


def _pair_sums(dealt: DataFrame) -> DataFrame:
    """Rows of a (lang, part, block) come with the sources first, then the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, totals, terms, sums = None, [], [], 0, None

        def begin() -> PairSums:
            return PairSums(names, np.array(totals, np.int64), terms, *now[2:])

        for batch in batches:
            for lang, part, block, blocks, source, n, v, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, part, block, blocks) != now:
                    if now:
                        yield (sums or begin()).table(now[0], now[1] == 0)
                    now, names, totals, sums = (lang, part, block, blocks), [], [], None
                if vector is None:
                    names.append(source)
                    totals.append(n)
                    terms = v
                else:
                    sums = sums or begin()
                    sums.add(vector, n)
        if now:
            yield (sums or begin()).table(now[0], now[1] == 0)
        release()

    return dealt.mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, part_vectors: int = PART_VECTORS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    with Scratch(docs.sparkSession, "divergence") as scratch:
        terms = scratch.table(kept_terms(term_counts(docs, text, lang, source), min_docs), "terms")
        own = terms.select("lang", "term", F.explode("vector").alias("c")).select("lang", "term", "c.source", "c.n")
        names = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c2) for c, c2 in ((lang, "lang"), (source, "source"))))
        totals = own.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        kept = terms.groupBy("lang").agg(F.count("*").alias("v"))
        groups = names.distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
        groups = scratch.table(groups, "groups")
        vectors = scratch.table(terms.groupBy("lang", "vector").agg(F.count("*").alias("times")), "vectors")

        # a part makes a row for each pair, so it takes as many vectors as there are pairs at least
        sizes = groups.groupBy("lang").agg(F.count("*").alias("s")).join(vectors.groupBy("lang").agg(F.count("*").alias("d")), "lang", "left").withColumn("pairs", F.col("s") * F.col("s"))
        parts = scratch.table(
            sizes.select(
                "lang",
                F.greatest(F.lit(1), F.ceil(F.coalesce("d", F.lit(0)) / F.greatest(F.lit(part_vectors), F.col("pairs")))).cast("int").alias("parts"),
                F.least(F.col("s"), F.ceil(F.col("pairs") / block_pairs)).cast("int").alias("blocks"),
            ),
            "parts",
        )
        no_vector = F.lit(None).cast(vectors.schema["vector"].dataType)
        listed = groups.join(parts, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("deal"), "blocks", "source", "n", "v", no_vector.alias("vector"))
        spread = vectors.join(parts, "lang").select("lang", F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int").alias("deal"), "blocks", F.lit(None).cast("string").alias("source"), F.col("times").alias("n"), F.lit(0).cast("long").alias("v"), "vector")
        dealt = listed.unionAll(spread).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "deal", "block", "blocks", "source", "n", "v", "vector")
        dealt = dealt.repartition("lang", "deal", "block").sortWithinPartitions("lang", "deal", "block", F.col("vector").isNotNull(), "source")
        pairs = _pair_sums(dealt).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

        whole = F.aggregate("vector", F.lit(0).cast("long"), lambda a, c: a + c["n"])
        used = terms.select("lang", "term", whole.alias("all"), F.explode("vector").alias("c")).select("lang", "term", "all", "c.source", "c.n")
        about = scratch.table(groups.join(groups.groupBy("lang").agg(F.sum("n").alias("total")), "lang").select("lang", "source", F.col("n").alias("own"), "v", "total"), "about")
        rated = used.join(about, ["lang", "source"]).select("lang", "source", "term", likelihood(F.col("n"), F.col("own"), F.col("v")).alias("p"), likelihood(F.col("all"), F.col("total"), F.col("v")).alias("q"))
        ranked = rated.filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
        columns = ["lang", "source", "part", "item", "value", "rank"]
        return written(pairs.withColumn("part", F.lit("pair")).select(columns).unionAll(ranked.withColumn("part", F.lit("term")).select(columns)), "divergence")
