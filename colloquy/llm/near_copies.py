"""Near copies of a corpus: documents whose sets of five-word shingles have a Jaccard index of 0.8 or more.

Words are separated by white space and lower-cased; a text of fewer words has
one shingle, of all its words. Texts with the same words are one text from the
start. The first two searches join what is easily found, groups of any size, by few comparisons:

- MinHash: each text keeps its 64 smallest shingle hashes, and of these the
  minima under 30 permutations, in ten bands of three. Texts that agree in a band
  are compared with two of its texts: the one that meets most texts in all its bands, and one chosen by
  a hash; then with the text of the band that has the most links. (The source of a group of
  copies is near all of them, while two copies of it may be further apart than the index allows.)
- SimHash (drop_near_copies only): texts whose five-word fingerprints are within
  two bits, found by the grid of segment popcounts (simhash.linked). At an index of 0.8
  fingerprints differ in about ten bits; cells that far apart are met by nearly
  all texts, so the grid serves the closest copies and the bands reach the rest.
- What both missed: an exact prefix join over all texts (_unmet), which leaves out only pairs that are of one
  class by then. Texts that meet many others there carry marks of their shingles into the join, and
  candidates are then compared by bitmaps; both leave out only pairs that can't reach the index.

With ``native`` all is done in DataFrame operations (without bitmaps); the classes are the same.

All candidates of sizes that allow the index are verified on their whole shingle sets; those that
reach it are linked, and classes are the connected components of the links. So
no pair below the index is linked, and the classes are those of all pairs. The last search
meets every two texts of different classes that share one of their rarest shingles. Texts
that are almost, but not quite, within the index of very many others are compared by marks with each of
them inside the join; only pairs that the marks can't exclude become rows (of more than about 4600 shingles they exclude none).

No group is gathered in one place.

Defined results: null, empty and blank texts have the same (no) words and are one
class; repeated rows are of one class; an empty table gives no rows; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, one_row_each, release, row_keys, written
from .components import components
from .simhash import fingerprints, linked

SHINGLE = 5
LEAST = 0.8
LOWEST = 64
BANDS, ROWS = 10, 3
#: Texts whose prefixes are found at once.
ROWS_AT_ONCE = 1000
#: Which shingles come late in the common order: those that most of one text in so many have, by marks of their last bits.
PART_FOR_ORDER = 16
MOST_LATE = 200_000
LATE_MARKS = 1 << 22
#: Bits of a text's bitmap for each shingle at least.
BITS = 2
#: Texts of more than so many for one shingle of their prefixes carry marks: parities of their shingles, in so many longs.
FEW = 8
MARK_LONGS = 32


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def words_key(text: Column) -> Column:
    """Tells texts of different words apart."""
    return F.xxhash64(_words(text))


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once and not again in each inner function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shingles(words: Column, shingle: int) -> Column:
    grams = lambda w: F.when(F.size(w) <= shingle, F.array(F.xxhash64(w))).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (shingle - 1)), lambda i: F.xxhash64(F.slice(w, i, shingle))))
    return F.array_distinct(_bound(words, grams))


def _sketch(words: Column, shingle: int) -> Column:
    """(key, of): a hash of the words; the sorted hashes of the distinct shingles, and the bands."""
    least = lambda x, seed: F.array_min(F.transform(x, lambda h: F.xxhash64(h, F.lit(seed))))
    bands = lambda low: F.array(*(F.xxhash64(F.lit(b), *(least(low, b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)))
    of_grams = lambda grams: F.struct(grams.alias("grams"), _bound(F.slice(grams, 1, LOWEST), bands).alias("bands"))
    return _bound(words, lambda w: F.struct(F.xxhash64(w).alias("key"), _bound(F.sort_array(_shingles(w, shingle)), of_grams).alias("of")))


def _often(texts: DataFrame, text: str, shingle: int) -> DataFrame:
    """(gram): the shingles that come last in the order of all texts: those that most texts have.

    A part of the texts tells them. The order decides on how many pairs are compared only: any one finds the same.
    """
    source = F.col(f"`{text}`")
    some = texts.filter(F.pmod(F.xxhash64(source), F.lit(PART_FOR_ORDER)) == 0).select(source.alias("text")).distinct()
    grams = some.select(F.explode(_shingles(_words(F.col("text")), shingle)).alias("gram"))
    return grams.groupBy("gram").count().filter("count > 1").orderBy(F.desc("count"), "gram").limit(MOST_LATE).select("gram")


def _late(often: DataFrame) -> np.ndarray:
    """Marks of these shingles by the last bits of their hashes."""
    late = np.zeros(LATE_MARKS, dtype=bool)
    late[often.toPandas()["gram"].to_numpy(dtype=np.int64) & (LATE_MARKS - 1)] = True
    return late


def _bit(gram: Column) -> Column:
    """The long that has only the bit of the last six of the gram's."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), gram.bitwiseAND(63).cast("int"))


def _place(gram: Column, longs: int) -> Column:
    """Which of so many longs has the gram's bit, by the bits before the last six."""
    return F.shiftright(gram, 6).bitwiseAND(longs - 1).cast("int")


def _late_longs(often: DataFrame) -> DataFrame:
    """One row (late): the same marks, as an array of longs."""
    longs = LATE_MARKS // 64
    marked = often.groupBy(_place(F.col("gram"), longs).alias("at")).agg(F.bit_or(_bit(F.col("gram"))).alias("marks"))
    every = often.sparkSession.range(longs).select(F.col("id").cast("int").alias("at")).join(marked, "at", "left").select("at", F.coalesce("marks", F.lit(0)).alias("marks"))
    return every.agg(F.array_sort(F.collect_list(F.struct("at", "marks")))["marks"].alias("late"))


def _native_prefix(rows: DataFrame, late: Column, least: float) -> DataFrame:
    """(words, n, bands, prefix) of (words, bands, grams), as _with_prefix gives them."""
    most = F.size("grams") - F.ceil(least * F.size("grams") - 1e-9).cast("int") + 1
    marked = lambda longs, g: F.getbit(F.get(longs, _place(g, LATE_MARKS // 64)), g.bitwiseAND(63).cast("int"))
    rest = lambda longs, early: F.concat(early, F.slice(F.filter("grams", lambda g: marked(longs, g) == 1), F.lit(1), most - F.size(early)))
    first = lambda longs, early: F.when(F.size(early) >= most, F.slice(early, F.lit(1), most)).otherwise(rest(longs, early))
    # late stands once, so that Spark reads it in place and doesn't copy it into each row
    prefix = _bound(F.col("late"), lambda longs: _bound(F.filter("grams", lambda g: marked(longs, g) == 0), lambda early: first(longs, early)))
    return rows.withColumn("late", late).select("words", F.size("grams").alias("n"), "bands", prefix.alias("prefix"))


def _with_prefix(rows: DataFrame, late: np.ndarray, least: float) -> DataFrame:
    """(words, n, bands, prefix, bits) of (words, bands, grams): the number of shingles, the first floor((1 - least) n) + 1 of them in the common order, and their bitmap."""

    def prefixes(lists: pa.Array) -> pa.Array:
        grams, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        last = late[grams & (len(late) - 1)]
        # the arrays are sorted, and each of the two parts keeps its order
        early = np.concatenate([[0], np.cumsum(~last)])
        before = early[:-1] - early[starts][owner]
        pos = np.where(last, (early[ends] - early[starts])[owner] + np.arange(len(grams)) - starts[owner] - before, before)
        most = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
        taken = pos < most[owner]
        out = np.empty(most.sum(), dtype=np.int64)
        to = np.cumsum(most) - most
        out[to[owner[taken]] + pos[taken]] = grams[taken]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(most)]).astype(np.int32)), pa.array(out))

    def bitmaps(lists: pa.Array) -> pa.Array:
        """A bit for each value of the last bits of the shingles, by powers of two: a longer bitmap folds to a shorter one."""
        grams, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        wide = np.int64(8) << np.ceil(np.log2(np.maximum(BITS * sizes, 8) / 8)).astype(np.int64)
        ends = np.cumsum(wide)
        marks = np.zeros(ends[-1], dtype=bool)
        marks[np.repeat(ends - wide, sizes) + (grams & np.repeat(wide - 1, sizes))] = True
        at = np.concatenate([[0], ends // 8]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.packbits(marks, bitorder="little"))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                lists = part.column("grams")
                yield pa.RecordBatch.from_arrays([part.column("words"), pc.list_value_length(lists).cast(pa.int32()), part.column("bands"), prefixes(lists), bitmaps(lists)], names=["words", "n", "bands", "prefix", "bits"])
        release()

    return rows.select("words", "bands", "grams").mapInArrow(scan, "words long, n int, bands array<long>, prefix array<long>, bits binary")


def _bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, at the length of the shorter: no more than shingles that only one text has."""
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    wide, large, small = 8 * len(x), int.from_bytes(x, "little"), int.from_bytes(y, "little")
    while wide > 8 * len(y):
        wide //= 2
        large = large >> wide | large & (1 << wide) - 1
    return (large ^ small).bit_count()


def _apart(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_bits_apart(p, q) for p, q in zip(x, y, strict=True)], dtype="int32")

    return apart(a, b)


def _marks(sets: DataFrame) -> DataFrame:
    """(words, marks) of (words, grams), one row each: for each bit, whether the number of shingles with it is odd.

    The marks of two texts differ in no more bits than shingles that only one of them has.
    """
    grams = sets.select("words", F.explode("grams").alias("gram")).select("words", _place(F.col("gram"), MARK_LONGS).alias("at"), _bit(F.col("gram")).alias("bit"))
    longs = grams.groupBy("words").agg(*(F.bit_xor(F.when(F.col("at") == k, F.col("bit")).otherwise(0)).alias(f"m{k}") for k in range(MARK_LONGS)))
    return longs.select("words", F.array(*(f"m{k}" for k in range(MARK_LONGS))).alias("marks"))


def _unmet(sketch: DataFrame, roots: DataFrame, least: float, sets_of, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of texts of different roots; all that reach the index are among them.

    Two such texts share at least that part of the larger set, so each has one of the shared shingles in its
    prefix, as the order is common to all. Of the first one that they share, the places tell how many more there can be.
    Of the shingles of both, a part of (1 - least) / (1 + least) at most is in one only, and so are no more bits.
    ``sets_of`` gives the shingles of texts: those that meet many others are told from them by marks in the join.
    """
    rooted = sketch.select("words", "n", "prefix").join(roots.select(F.col("node").alias("words"), "root"), "words", "left")
    rows = rooted.select("words", "n", F.coalesce("root", "words").alias("root"), F.posexplode("prefix").alias("pos", "gram"))
    mixed = scratch.table(rows.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("texts")).filter("low < high").select("gram", (F.col("texts") > FEW).alias("many")), "mixed")
    held = scratch.table(rows.join(mixed, "gram"), "held")
    crowd = scratch.table(held.filter("many").select("words").distinct(), "crowd")
    marks = scratch.table(_marks(sets_of(crowd)), "marks")
    marked = scratch.table(held.drop("many").join(marks, "words", "left"), "marked")
    scratch.drop(mixed, held, marks)
    side = lambda name: marked.select("gram", *(F.col(c).alias(f"{name}_{c}") for c in ("words", "n", "pos", "root", "marks")))
    common = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    can = (F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n")) & (common >= least / (1 + least) * (F.col("a_n") + F.col("b_n")) - 1e-6)
    most_apart = (1 - least) / (1 + least) * (F.col("a_n") + F.col("b_n")) + 1e-6
    apart = F.aggregate(F.zip_with("a_marks", "b_marks", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, more: n + more)
    pairs = side("a").join(side("b"), "gram").filter((F.col("a_words") < F.col("b_words")) & (F.col("a_root") != F.col("b_root")) & can & F.coalesce(apart <= most_apart, F.lit(True)))
    met = scratch.table(pairs.select(F.col("a_words").alias("a"), F.col("b_words").alias("b")).distinct(), "met-in-prefix")
    scratch.drop(marked)
    if "bits" not in sketch.columns:
        return met
    of = lambda name: sketch.select(F.col("words").alias(name), F.col("n").alias(f"{name}_n"), F.col("bits").alias(f"{name}_bits"))
    unmet = scratch.table(met.join(of("a"), "a").join(of("b"), "b").filter(_apart(F.col("a_bits"), F.col("b_bits")) <= most_apart).select("a", "b"), "unmet")
    scratch.drop(met)
    return unmet


def near_classes(texts: DataFrame, text: str = "text", shingle: int = SHINGLE, least: float = LEAST, more: DataFrame | None = None, native: bool = False) -> DataFrame:
    """(words, root) of the texts that have near copies, by words_key: all of one root are a class; other texts are their own.

    more: further pairs (a, b) of words_key to be verified. native: in DataFrame operations only.
    """
    with Scratch(texts.sparkSession, "near") as scratch:
        source = F.col(f"`{text}`")
        found = texts.select(_sketch(_words(source), shingle).alias("s")).select(F.col("s.key").alias("words"), F.col("s.of.bands").alias("bands"), F.col("s.of.grams").alias("grams"))
        often = _often(texts, text, shingle)
        with_prefix = _native_prefix(found, scratch.table(_late_longs(often), "late").scalar(), least) if native else _with_prefix(found, _late(often), least)
        sketch = scratch.table(with_prefix.dropDuplicates(["words"]), "sketch")
        bands = sketch.select("words", "n", F.explode("bands").alias("band"))
        # written, so that the joins deal both sides themselves and Spark can split a band with very many texts
        sizes = scratch.table(bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        met = scratch.table(bands.join(sizes, "band"), "met")
        degrees = scratch.table(met.groupBy("words").agg(F.sum("size").alias("degree")), "degrees")
        asked = scratch.table((met.select("words").unionAll(more.select(F.explode(F.array("a", "b")))) if more is not None else met.select("words")).distinct(), "asked")
        keyed = texts.select(words_key(source).alias("words"), source.alias("text"))
        shingled = lambda rows: rows.select("words", _shingles(_words(F.col("text")), shingle).alias("grams"))
        sets_of = lambda rows: scratch.table(shingled(rows), "sets")
        # copies go before the shuffle, so that a text with very many of them meets no single task
        sets = sets_of(keyed.dropDuplicates(["words"]).join(asked, "words"))

        def with_chosen(ranked: DataFrame, *picks: Column) -> DataFrame:
            """Pairs of the texts of each band with its chosen ones, where the sizes allow the index."""
            chosen = ranked.groupBy("band").agg(F.array_distinct(F.array(*picks)).alias("c")).select("band", F.explode("c").alias("c")).select("band", F.col("c.words").alias("with"), F.col("c.n").alias("with_n"))
            pairs = met.join(scratch.table(chosen, "chosen"), "band").filter((F.least("n", "with_n") >= least * F.greatest("n", "with_n")) & (F.col("words") != F.col("with")))
            return pairs.select(F.least("words", "with").alias("a"), F.greatest("words", "with").alias("b"))

        def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
            both = pairs.join(sets.select(F.col("words").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("words").alias("b"), F.col("grams").alias("gb")), "b")
            common = F.size(F.array_intersect("ga", "gb"))
            links = both.select("a", "b", common.alias("n"), (F.size("ga") + F.size("gb")).alias("total")).filter(F.col("n") >= least * (F.col("total") - F.col("n")))
            return scratch.table(links.select("a", "b"), "links")

        text_of = F.struct("words", "n")
        first = with_chosen(met.join(degrees, "words"), F.max_by(text_of, F.struct("degree", F.xxhash64("words"))), F.min_by(text_of, F.xxhash64("words", "band")))
        first = scratch.table((first.unionAll(more.select("a", "b")) if more is not None else first).distinct(), "pairs")
        links = verified(first, sets)
        counts = scratch.table(links.select(F.explode(F.array("a", "b")).alias("words")).groupBy("words").count(), "counts")
        again = with_chosen(met.join(counts, "words"), F.max_by(text_of, F.struct("count", F.xxhash64("words"))))
        again = scratch.table(again.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
        links = links.unionAll(verified(again, sets))
        classes = components(links)
        scratch.drop(sets)
        unmet = _unmet(sketch, classes, least, lambda wanted: shingled(keyed.join(wanted, "words").dropDuplicates(["words"])), scratch)
        scratch.drop(sketch)
        if not unmet.isEmpty():
            wanted = scratch.table(unmet.select(F.explode(F.array("a", "b")).alias("words")).distinct(), "wanted")
            rest = verified(unmet, sets_of(keyed.join(wanted, "words").dropDuplicates(["words"])))
            classes = components(links.unionAll(rest)) if not rest.isEmpty() else classes
        return classes.select(F.col("node").alias("words"), "root")


def close_fingerprints(texts: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) of words_key whose fingerprints link: two of one fingerprint, or the first texts of two within two bits."""
    with Scratch(texts.sparkSession, "close") as scratch:
        source = F.col(f"`{text}`")
        found = fingerprints(texts.select(words_key(source).alias("words"), source.alias("text")), key="words", shingle=shingle)
        found = scratch.table(found.select(F.col("doc_id").alias("words"), "fp").dropDuplicates(["words"]), "fps")
        first = scratch.table(found.groupBy("fp").agg(F.min("words").alias("first")), "first")
        same = found.join(first, "fp").filter("words > first").select(F.col("first").alias("a"), F.col("words").alias("b"))
        links = linked(first.select("fp"), scratch)
        far = links.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
        return written(same.unionAll(far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), "close")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs with one row of each class: that of the smallest id, null ids last; of different texts with it the one of the smallest hash."""
    classes = near_classes(docs, text, shingle, least, more=close_fingerprints(docs, text, shingle))
    with Scratch(docs.sparkSession, "near-rows") as scratch:
        ids = docs.select(F.col(f"`{key}`").alias("id"), *row_keys(key, text), words_key(F.col(f"`{text}`")).alias("words"))
        of_words = scratch.table(ids.groupBy("words").agg(F.min(F.struct(F.col("id").isNull(), "id", "_tk", "_id")).alias("row")), "first")
        first = of_words.join(classes, "words", "left").groupBy(F.coalesce("root", "words").alias("root")).agg(F.min("row").alias("row"))
        keep = written(first.select("row._id", "row._tk"), "near-keep")
    return one_row_each(docs, keep, key, text)
