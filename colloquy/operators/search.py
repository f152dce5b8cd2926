"""Search over chunk vectors: the metadata filter, exact cosine top-k, index upkeep and ranking metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

TOP_K = 15


def visible(caller: Column | str) -> Column:
    """Notes are seen by their owner only; part of every search, it can't be left out."""
    who = F.lit(caller) if isinstance(caller, str) else caller
    return (F.col("type") != "note") | (F.col("owner_sub") == who)


def search_filter(caller: Column | str, types: Sequence[str] | None = None, date_from: int | None = None, date_to: int | None = None) -> Column:
    """The privacy clause, and clauses for types and bounds that are given; no types is no clause, epoch 0 is a bound."""
    out = visible(caller)
    if types:
        out = out & F.col("type").isin(*types)
    if date_from is not None:
        out = out & (F.col("date_epoch") >= date_from)
    if date_to is not None:
        out = out & (F.col("date_epoch") <= date_to)
    return out


def compiled(tree: dict) -> Column:
    """A Column from a filter tree of $and, $or and {field: {$eq, $ne, $in, $gte, $lte: value}}."""
    (name, value), *more = tree.items()
    if more:
        return compiled({"$and": [{k: x} for k, x in tree.items()]})
    if name in ("$and", "$or"):
        first, *rest = map(compiled, value)
        for x in rest:
            first = first & x if name == "$and" else first | x
        return first
    c = F.col(name)
    ops = {"$eq": lambda x: c == x, "$ne": lambda x: c != x, "$in": lambda x: c.isin(*x), "$gte": lambda x: c >= x, "$lte": lambda x: c <= x}
    tests = [ops[op](x) for op, x in value.items()] if isinstance(value, dict) else [c == value]
    first, *rest = tests
    for x in rest:
        first = first & x
    return first


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; vectors need not be of unit length. Null for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1 - dot(a, b) / F.when(norm > 0, norm)


def top_k(vectors: DataFrame, query: Sequence[float], where: Column, k: int = TOP_K, key: str = "key", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows that pass the filter, by distance and key, with distance. Each task keeps k rows."""
    q = F.lit([float(x) for x in query])
    return vectors.filter(where).withColumn("distance", cosine_distance(F.col(embedding), q)).orderBy("distance", key).limit(k)


def top_k_join(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, key: str = "key", embedding: str = "embedding", most_queries: int = 1000) -> DataFrame:
    """query_id, rank, key, distance: for each query (query_id, query) the nearest of all vectors.

    The queries travel to the vectors in blocks of about ``most_queries``, so vectors are read once for each
    block. A task takes the distances of a batch of vectors to a block as one matrix product, keeps its k best
    rows for each query, and only those are shuffled. Rows of one query_id stay in one block. Null and zero
    vectors have no distance and are nobody's neighbours.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("e")).filter("e IS NOT NULL")
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("key", vectors.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    w = Window.partitionBy("query_id").orderBy("distance", "key")

    def of_block(ids: list, wanted: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, wanted))
        kinds = [to_arrow_type(f.dataType) for f in schema]

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best: list[list[tuple]] = [[] for _ in names]
            for batch in batches:
                keep_best(best, q, batch, k)
            columns = [[n for n, own in zip(names, best, strict=True) for _ in own], [x[1] for own in best for x in own], [x[0] for own in best for x in own]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        scored = rows.mapInArrow(nearest, schema)
        return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "key", "distance")

    parts, ids, block = [], [], []
    for query_id, query in queries.select("query_id", F.col("query").cast("array<double>")).orderBy("query_id").toLocalIterator():
        if len(block) >= most_queries and query_id != ids[-1]:
            parts.append(of_block(ids, np.array(block)))
            ids, block = [], []
        ids.append(query_id)
        block.append(query)
    if block:
        parts.append(of_block(ids, np.array(block)))
    if not parts:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, key {vectors.schema[key].dataType.simpleString()}, distance double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keep_best(best: list[list[tuple]], queries: np.ndarray, batch: pa.RecordBatch, k: int) -> None:
    """Adds the batch's (distance, key) rows to the k best of each query.

    A matrix product finds the rows that may count; their distances are then summed row by row, so that equal
    vectors get equal distances and ties go by key.
    """
    if not batch.num_rows:
        return
    keys = batch.column(0).to_pylist()
    e = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
    lengths, own = np.sqrt((e * e).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        rough = 1 - (e @ queries.T) / (lengths[:, None] * own[None, :])
    rough[~np.isfinite(rough)] = np.inf
    for j, query in enumerate(queries):
        column = rough[:, j]
        limit = np.partition(column, k - 1)[k - 1] if len(column) > k else np.inf
        if len(best[j]) == k:
            limit = min(limit, best[j][-1][0])
        at = np.flatnonzero((column <= limit + 1e-9) & np.isfinite(column))
        if len(at):
            exact = 1 - (e[at] * query).sum(axis=1) / (lengths[at] * own[j])
            best[j] = sorted([*best[j], *zip(exact.tolist(), (keys[i] for i in at), strict=True)])[:k]


def ranking_metrics(hits: DataFrame, golden: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """One row: hit_at_k for each k, and mrr. hits: query_id, rank, key. golden: query_id, expected. The best rank counts; none is a miss."""
    found = golden.join(hits.withColumnRenamed("key", "expected"), ["query_id", "expected"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    shares = [F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"hit_at_{k}") for k in ks]
    return found.agg(*shares, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("questions"))


def labelled_metrics(hits: DataFrame, questions: DataFrame, labels: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """The same where a hit is right if its label is the question's: only the labels of hits are looked up. questions: query_id, label. labels: key, label; a question is no answer to itself."""
    asked = questions.join(labels.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1"), "label", "left_semi")
    right = hits.join(labels.withColumnRenamed("label", "_found"), "key").join(asked, "query_id").filter((F.col("label") == F.col("_found")) & (F.col("key") != F.col("query_id")))
    golden = asked.select("query_id", F.lit(True).alias("expected"))
    return ranking_metrics(right.groupBy("query_id").agg(F.min("rank").alias("rank"), F.lit(True).alias("key")), golden, ks)


#: Least share of questions whose answer is among the first five hits.
GATE_LEAST = 0.7


def retrieval_gate(metrics: DataFrame, least: float = GATE_LEAST) -> DataFrame:
    """metrics (hit_at_5) with whether they pass."""
    return metrics.withColumn("passed", F.col("hit_at_5") >= least)


def stale_keys(previous: DataFrame, emitted: DataFrame) -> DataFrame:
    """doc, stale (keys to delete), put (keys to write). previous and emitted: doc, index_version, keys. After a change of version all earlier keys are stale."""
    none = F.array().cast("array<string>")
    both = previous.select("doc", F.col("keys").alias("old"), F.col("index_version").alias("v0")).join(emitted.select("doc", F.col("keys").alias("new"), F.col("index_version").alias("v1")), "doc", "full")
    old, new = F.coalesce("old", none), F.coalesce("new", none)
    stale = F.when(F.col("v0").eqNullSafe(F.coalesce("v1", "v0")), F.array_except(old, new)).otherwise(old)
    return both.select("doc", F.array_sort(stale).alias("stale"), F.array_sort(new).alias("put"))


def reconcile(vectors: DataFrame, previous: DataFrame, fresh: DataFrame, emitted: DataFrame) -> DataFrame:
    """The vectors (doc, key, index_version, ...) without stale keys, and with the fresh ones in place of those they replace."""
    gone = stale_keys(previous, emitted).select("doc", F.explode("stale").alias("key"))
    kept = vectors.join(gone, ["doc", "key"], "left_anti").join(fresh.select("doc", "key"), ["doc", "key"], "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def needs_indexing(meetings: DataFrame, version: int, force: bool = False) -> DataFrame:
    """meetings with action: skip (still open, or of the current version), or index."""
    open_ = F.col("status").isin("capturing", "processing")
    current = F.lit(not force) & F.col("index_version").eqNullSafe(F.lit(version))
    return meetings.withColumn("action", F.when(open_ | current, "skip").otherwise("index"))
