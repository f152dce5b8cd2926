"""Line dedup with a log-template tree, in DataFrame operations only.

A line's leaf in the tree is given by its number of tokens (separated by single
spaces) and its first ``leading`` tokens; tokens with a digit count as the
variable field ``<*>``. Within a leaf, a token at a place is constant if it
stands there in ``min_docs`` kinds of documents, and a variable field otherwise: this
gives each line its template. A template recurs if at least a share of
``similarity`` of its tokens is constant and ``min_docs`` kinds of documents have it;
lines of recurring templates are dropped.

What counts as a document: copies of one document must not make its own lines
recur, nor stop a line that recurs elsewhere. So different texts are counted (``kinds``), however many
documents have each. With ``classes`` (the pipeline) near copies, too, count once: the kind is
the class of near copies, found over the whole texts (five-word shingles of Jaccard
index 0.8 or more, near_copies). Pages that are alike beyond that index through
their boilerplate alone are near copies then, and their lines stay.

Everything is grouped on hashes of lines, leaves or templates with partial
aggregation first; no group of lines is gathered in one place. Only lines of
leaves that enough documents share are carried past the first step.

Defined results: a null text stays null and an empty one empty; blank lines are
never dropped and make no leaf; a text whose lines all go becomes empty, and its
row stays; repeated rows are treated alike; an empty table gives no rows; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_keys, written
from .near_copies import near_classes, words_key

MIN_DOCS = 3
LEADING = 3
SIMILARITY = 0.7
WILD = "<*>"


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(WILD)).otherwise(t))


def _lines(docs: DataFrame, key: str, text: str, leading: int) -> DataFrame:
    """(_id, _tk, pos, line, leaf) of all lines that aren't blank."""
    # the keys come first: beside the generator they would be worked out, and the text carried, for every line
    keyed = docs.select(*row_keys(key, text), F.split(F.col(f"`{text}`"), "\n").alias("lines"))
    each = keyed.select("_id", "_tk", F.posexplode("lines").alias("pos", "line")).filter(F.trim("line") != "")
    tokens = F.split("line", " ")
    return each.select("_id", "_tk", "pos", "line", F.xxhash64(F.size(tokens), _masked(F.slice(tokens, 1, leading))).alias("leaf"))


def _kinds(docs: DataFrame, text: str) -> DataFrame:
    """(_tk, sig): the class of near copies of each text."""
    names = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("_tk"), words_key(F.col(f"`{text}`")).alias("words")).distinct()
    return names.join(near_classes(docs, text, native=True), "words", "left").select("_tk", F.coalesce("root", "words").alias("sig"))


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, leading: int = LEADING, similarity: float = SIMILARITY, classes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(templates, places): (leaf, template, kinds) that recur, and (_id, _tk, pos, leaf, template) of their lines; both written."""
    with Scratch(docs.sparkSession, "lines") as scratch:
        lines = _lines(docs, key, text, leading)
        # written, so that the join deals both sides itself and Spark can split a leaf with very many lines
        leaves = scratch.table(lines.select("leaf", "_tk").distinct().groupBy("leaf").count().filter(F.col("count") >= min_docs).select("leaf"), "leaves")
        own = scratch.table(lines.join(leaves, "leaf", "left_semi").select("_id", "_tk", "pos", "leaf", "line", F.xxhash64("line").alias("lk")), "own")

        # one row for each line text and kind of document, then one for each token of it
        seen = own.groupBy("leaf", "lk", "_tk").agg(F.first("line").alias("line"))
        if classes:
            seen = scratch.table(seen, "by-text").join(scratch.table(_kinds(docs, text), "kinds"), "_tk").groupBy("leaf", "lk", "sig").agg(F.first("line").alias("line"))
        else:
            seen = seen.withColumnRenamed("_tk", "sig")
        seen = scratch.table(seen, "seen")
        tokens = seen.select("leaf", "lk", "sig", F.posexplode(_masked(F.split("line", " "))).alias("i", "token"))
        enough = tokens.filter(F.col("token") != WILD).select("leaf", "i", "token", "sig").distinct().groupBy("leaf", "i", "token").count().filter(F.col("count") >= min_docs)
        constants = scratch.table(enough.select("leaf", "i", "token", F.lit(True).alias("constant")), "constants")
        placed = scratch.table(seen.groupBy("leaf", "lk").agg(F.first("line").alias("line")), "line-texts").select("leaf", "lk", F.posexplode(_masked(F.split("line", " "))).alias("i", "token"))
        word = F.when(F.col("constant"), F.col("token")).otherwise(WILD)
        of_line = placed.join(constants, ["leaf", "i", "token"], "left").groupBy("leaf", "lk").agg(F.array_sort(F.collect_list(F.struct("i", word.alias("w")))).alias("ws"), F.count("constant").alias("constants"))
        of_line = scratch.table(of_line.filter(F.col("constants") >= similarity * F.size("ws")).select("leaf", "lk", F.array_join(F.col("ws.w"), " ").alias("template")), "of-line")
        kinds = seen.select("leaf", "lk", "sig").join(of_line, ["leaf", "lk"]).select("leaf", "template", "sig").distinct()
        templates = written(kinds.groupBy("leaf", "template").agg(F.count("*").alias("kinds")).filter(F.col("kinds") >= min_docs), "lines-templates")
        dropped = scratch.table(of_line.join(templates, ["leaf", "template"]).select("leaf", "lk", "template"), "dropped")
        places = own.select("_id", "_tk", "pos", "leaf", "lk").join(dropped, ["leaf", "lk"]).select("_id", "_tk", "pos", "leaf", "template")
        return templates, written(places, "lines-places")


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at these positions."""
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    return F.array_join(F.get(F.transform(F.array(F.split(text, "\n")), left), F.lit(0)), "\n")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: bool = False, **kwargs) -> DataFrame:
    """docs with the lines of recurring templates cut from the texts; with ``counts``, also n_lines and n_dropped (which replace columns of these names)."""
    _, places = recurring_lines(docs, key, text, **kwargs)
    gone = written(places.groupBy("_id", "_tk").agg(F.collect_set("pos").alias("_gone")), "lines-gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *row_keys(key, text))
    source = F.col(f"_row.`{text}`")
    cut = F.when(F.col("_gone").isNull(), source).otherwise(_without(source, F.col("_gone")))
    out = [cut.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    if counts:
        own = F.filter(F.split(source, "\n"), lambda x: F.trim(x) != "")
        out += [F.coalesce(F.size(own), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped")]
    return rows.join(gone, ["_id", "_tk"], "left").select(*out)
