"""Quality by hierarchical empirical Bayes.

Document evidence: logistic models (quality, and toxicity) over some shape
features and the presence of telling words, fitted on a sample of at most
``most_labelled`` labelled rows: those with the smallest hash of their id. The
evidence is the model's log-odds less the log-odds of the base rate.

Sites: grouped sums of the models' quality probabilities give each host and each
path in it its mean. Means of sparse hosts are shrunk toward the global mean, and
those of sparse paths toward their host's, by pseudo-counts that are estimated
from the spread between groups (moments of the beta-binomial). A document's own
part is taken out of its path's sum first. The posterior joins the document's
evidence with its path's log-odds.

A document is kept if its posterior quality is at least 0.5 and its toxicity is
below 0.5. All texts are read whole and all documents enter the site means.

Defined results: null and empty texts have all features zero and are scored by
them; a null host or path is a site like any other; repeated rows get equal
scores but for their own part in the means; where the sample has no two kinds of
a label, that model gives the smoothed share of the label; labels of several
rows for one id count each; labels with null ids or without a document are left
out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, slices, word_hashes, word_spans, word_table, written

MOST_LABELLED = 8000
BUCKET_BITS = 16
#: Words (as buckets of their hash) that a model looks at.
WORDS = 192
RIDGE = 0.1
NEWTON_STEPS = 25
HEADS = ("quality", "toxic")
SHAPES = 8

_ODD = np.zeros(256, dtype=bool)
_ODD[[*b"#%&$*|!<>{}[]=+~^@\\/_"]] = True


def shapes_and_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape features (texts x SHAPES), and for each word the number of its text and its bucket."""
    texts = len(offsets) - 1
    starts, ends, heads = word_spans(lower_ascii(data), offsets, word_table("alnum"))
    hashes = word_hashes(lower_ascii(data), starts, ends)
    text_of = np.repeat(np.arange(texts), np.diff(heads))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags))[offsets])

    n = np.maximum(np.diff(heads), 1)
    size = np.maximum(np.diff(offsets), 1)
    same = np.append(False, hashes[1:] == hashes[:-1])[: len(hashes)]
    same[heads[:-1][heads[:-1] < len(hashes)]] = False  # a text's first word has none before it
    letters = (data >= 65) & (data <= 122)
    upper = (data >= 65) & (data <= 90)
    out = np.zeros((texts, SHAPES))
    out[:, 0] = np.log1p(np.diff(heads)) / 8
    out[:, 1] = np.bincount(text_of[same], minlength=texts) / n
    out[:, 2] = np.minimum(per_text(_ODD[data]) / n, 4)
    out[:, 3] = per_text(upper) / np.maximum(per_text(letters), 1)
    out[:, 4] = per_text((data >= 48) & (data <= 57)) / size
    out[:, 5] = per_text(data == 10) / n
    out[:, 6] = np.minimum((size / n) / 10, 4)
    out[:, 7] = per_text((data == 46) | (data == 44)) / n
    return out, text_of, (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Head:
    """One logistic model: buckets of its words, weights (bias, shapes, words) and the base rate."""

    buckets: np.ndarray
    weights: np.ndarray
    base: float

    def log_odds(self, shapes: np.ndarray, text_of: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = self.weights[0] + shapes @ self.weights[1 : 1 + SHAPES]
        if len(self.buckets) and len(bucket):
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            hit = self.buckets[at] == bucket
            present = np.unique(text_of[hit] * len(self.buckets) + at[hit])
            out = out + np.bincount(present // len(self.buckets), weights=self.weights[1 + SHAPES :][present % len(self.buckets)], minlength=len(shapes))
        return out


def fit(shapes: np.ndarray, buckets: list[np.ndarray], y: np.ndarray) -> Head:
    """A ridge logistic regression by Newton's method over the shapes and the WORDS most telling buckets."""
    n, good = len(y), float(y.sum())
    base = (good + 0.5) / (n + 1)
    if not n or good in (0.0, float(n)):
        return Head(np.zeros(0, np.int64), np.append(np.log(base / (1 - base)), np.zeros(SHAPES)), base)
    with_label, without = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    for b, label in zip(buckets, y, strict=True):
        (with_label if label else without)[b] += 1
    a, b = with_label / good, without / (n - good)
    spread = (with_label + without + 1) / n
    z = np.abs(a - b) / np.sqrt(spread * (1 / good + 1 / (n - good)))
    chosen = np.sort(np.argsort(-z, kind="stable")[:WORDS])
    x = np.zeros((n, 1 + SHAPES + len(chosen)))
    x[:, 0] = 1
    x[:, 1 : 1 + SHAPES] = shapes
    for i, own in enumerate(buckets):
        x[i, 1 + SHAPES :] = np.isin(chosen, own)
    ridge = np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-6
    ridge[1 : 1 + SHAPES] = 0.01
    w = np.zeros(x.shape[1])
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return Head(chosen, w, base)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most_labelled: int = MOST_LABELLED) -> dict[str, Head]:
    """The models of quality and toxicity, from a bounded sample of the labelled documents."""
    named = labels.select(F.col(f"`{key}`").alias("id"), *(F.col(h).cast("int").alias(h) for h in HEADS)).filter("id IS NOT NULL")
    # the sample is drawn before texts are joined: labels with the smallest hashes, some more for those without a document
    n = max(1, named.count())
    bound = int(min(1.0, 1.25 * most_labelled / n) * ((1 << 32) - 1))
    drawn = named.withColumn("draw", F.crc32(F.col("id").cast("string").cast("binary"))).filter(F.col("draw") <= bound)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.crc32(F.col("id").cast("string").cast("binary")) <= bound).join(drawn, "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, words = [], []
            for first, end, data, offsets in slices(batch.column(0)):
                shape, text_of, bucket = shapes_and_words(data, offsets)
                cuts = np.searchsorted(text_of, np.arange(end - first + 1))
                shapes += shape.tolist()
                words += [np.unique(bucket[a:b]).tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shapes, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int32()))], names=["draw", "tie", *HEADS, "shapes", "words"])

    made = rows.select("text", "draw", F.xxhash64("id", "text").alias("tie"), *HEADS).mapInArrow(features, "draw long, tie long, quality int, toxic int, shapes array<double>, words array<int>")
    sample = made.orderBy("draw", "tie", *HEADS).limit(most_labelled).toArrow()
    shapes = np.array(sample.column("shapes").to_pylist(), dtype=np.float64).reshape(-1, SHAPES)
    words = [np.asarray(w.values) for w in sample.column("words")]
    out = {}
    for head in HEADS:
        label = sample.column(head).to_pylist()
        known = [i for i, v in enumerate(label) if v is not None]
        out[head] = fit(shapes[known], [words[i] for i in known], np.array([float(label[i] > 0) for i in known]))
    return out


def score_documents(docs: DataFrame, heads: dict[str, Head], host: Column, path: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, host, path, p, evidence, toxicity) of each document: quality probability and evidence by the model alone."""
    shared = docs.sparkSession.sparkContext.broadcast(heads)
    rows = docs.select(F.col(f"`{key}`").alias(key), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quality, toxic = (shared.value[h] for h in HEADS)
        for batch in batches:
            odds, bad = [], []
            for _, _, data, offsets in slices(batch.column(3)):
                found = shapes_and_words(data, offsets)
                odds.append(quality.log_odds(*found))
                bad.append(toxic.log_odds(*found))
            odds = np.concatenate(odds) if odds else np.zeros(0)
            bad = np.concatenate(bad) if bad else np.zeros(0)
            squash = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            base = np.log(quality.base / (1 - quality.base))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(squash(odds)), pa.array(np.clip(odds, -30, 30) - base), pa.array(squash(bad))], names=[key, "host", "path", "p", "evidence", "toxicity"])

    more = [T.StructField(c, T.DoubleType()) for c in ("p", "evidence", "toxicity")]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], *more]))


def _pseudo_count(spread: Column, mean: Column, groups: Column, n: Column) -> Column:
    """How many documents the mean above is worth: from the share of the variance that lies between groups."""
    noise = mean * (1 - mean)
    share = (spread / n - noise * (groups - 1) / n) / F.greatest(noise, F.lit(1e-9))
    share = F.least(F.greatest(share, F.lit(1e-4)), F.lit(0.5))
    return 1 / share - 1


def posteriors(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """scored with host_posterior, path_posterior (without the document's own part), quality and keep."""
    # written, as they are read several times below, and so that Spark can split a site with very many documents
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    everything = hosts.agg(F.sum("host_n").alias("all_n"), F.sum("host_s").alias("all_s"), F.count("*").alias("hosts"))
    hosts = hosts.crossJoin(F.broadcast(everything)).withColumn("mean", F.col("all_s") / F.col("all_n"))  # one row
    between = hosts.agg(
        _pseudo_count(F.sum(F.col("host_n") * (F.col("host_s") / F.col("host_n") - F.col("mean")) ** 2), F.max("mean"), F.count("*"), F.max("all_n")).alias("host_weight")
    )
    hosts = hosts.crossJoin(F.broadcast(between)).withColumn("host_posterior", (F.col("host_s") + F.col("host_weight") * F.col("mean")) / (F.col("host_n") + F.col("host_weight")))
    inside = paths.withColumnRenamed("host", "path_host").join(hosts, F.col("path_host").eqNullSafe(F.col("host"))).drop("path_host")
    within = inside.agg(
        _pseudo_count(
            F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("host_s") / F.col("host_n")) ** 2), F.max("mean"), F.count("*") - F.max("hosts") + 1, F.max("all_n")
        ).alias("path_weight")
    )
    sites = written(inside.crossJoin(F.broadcast(within)).select(F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "s", "host_posterior", "path_weight"), "quality-sites")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    mean = (F.col("s") - F.col("p") + F.col("path_weight") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("path_weight"))
    mean = F.least(F.greatest(mean, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = joined.withColumn("path_posterior", mean)
    quality = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_posterior") / (1 - F.col("path_posterior"))))))
    return out.withColumn("quality", quality).select(
        key, "host", "path", "evidence", "host_posterior", "path_posterior", "quality", "toxicity", ((F.col("quality") >= 0.5) & (F.col("toxicity") < 0.5)).alias("keep")
    )


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, key: str = "doc_id", text: str = "text", **kwargs) -> DataFrame:
    """Every document with its evidence, site posteriors, quality, toxicity and keep; sites are source and, within it, language where none are given."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    heads = train(docs, labels, key, text, **kwargs)
    return posteriors(written(score_documents(docs, heads, host, path, key, text), "quality-scores"), key)
