"""A training corpus from raw documents: five stages, each written and read again by the next.

Rows that a stage rejects are gone for the later ones, and texts that it cuts stay
cut. All stages but the last return the columns of ``documents``; the last one
returns the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.bpe import encode
from colloquy.llm.common import fresh_path, remove
from colloquy.llm.decontaminate import decontaminate
from colloquy.llm.langid import UNDETERMINED, identify, train
from colloquy.llm.line_templates import dedup_lines
from colloquy.llm.near_copies import drop_near_copies

#: Share that the main language of a document must have in its mixture.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no letter) and those without a main one."""
    # under other names, so that no column can clash with the results
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(new) for c, new in names.items()))
    found = identify(rows, train(docs), text=names["text"], keep=tuple(rows.columns))
    main = F.coalesce(F.get("langs", F.lit(0))["share"], F.lit(0.0))
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (main >= LEAST_SHARE)).select(*(F.col(new).alias(c) for c, new in names.items()))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines of recurring templates from the texts; n_chars follows."""
    cut = dedup_lines(docs, classes=True)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, Jaccard 0.8 or more) stays: the one with the smallest id."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of the remaining texts."""
    return encode(docs).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: Mixture inference, near copies and BPE have no SQL form; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
