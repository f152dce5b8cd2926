"""The pipeline against a brute-force version of its last four stages, and the queries' registration."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import line_templates
from colloquy.llm.queries import ORACLES, QUERIES

from .test_operators import components_plainly, contaminated_plainly


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_stages_keep_columns(spark, awkward, nothing, tmp_path):
    awkward.limit(0).select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = awkward.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    for rows in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == rows.columns, name
            assert out.count() <= rows.count()
        last = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
        assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and last.count() == rows.count()


def test_line_dedup_counts_different_texts(spark):
    """The stage cuts lines that most of a page is made of."""
    rng = random.Random(2)
    line = lambda: " ".join("".join(rng.choice("abdeghilmnorstu") for _ in range(6)) for _ in range(10))
    shared = [line() for _ in range(10)]
    docs = spark.createDataFrame([(k, "\n".join([*shared, line(), line()])) for k in range(30)], "doc_id long, text string")
    assert {r.text.count("\n") for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {1}


def test_near_dedup_reaches_its_index(spark, awkward, nothing):
    """Pairs with five-word Jaccard 0.8 or more lose the later one, others and unrelated texts stay."""
    rng, texts = random.Random(3), []
    word = lambda: "".join(rng.choice("abdeghilmnorstu") for _ in range(7))
    for n, changes in ((100, 1), (200, 1), (500, 5), (1000, 10), (1000, 20), (100, 8)) * 5:
        words = [word() for _ in range(n)]
        other = list(words)
        for at in rng.sample(range(n), changes):
            other[at] = word()
        texts.append((words, other))
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    docs = [(2 * k + j, " ".join(w)) for k, pair in enumerate(texts) for j, w in enumerate(pair)] + [(1000, "two words"), (1001, "Two\nWORDS"), (1002, "two other words"), (None, "two words"), (1003, None), (1004, "")]
    want = {2 * k for k in range(len(texts))} | {2 * k + 1 for k, (a, b) in enumerate(texts) if len(grams(a) & grams(b)) < 0.8 * len(grams(a) | grams(b))} | {1000, 1002, 1003}
    assert len(want) < len(docs) - 20
    found = [r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()]
    assert sorted(found) == sorted(want)
    assert corpus_pipeline.near_dedup(spark, nothing, "").count() == 0
    assert corpus_pipeline.near_dedup(spark, awkward, "").columns == awkward.columns


def test_run_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(5)
    words = ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    docs = []
    for k in range(40):
        body = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(6, 14))) for _ in range(5))
        docs.append((k, body + ("\nAll rights reserved by us" if k % 4 == 0 else ""), "en", "s", 1))
    docs += [(100, docs[3][1], "en", "s", 1), (101, docs[3][1].capitalize(), "en", "s", 1), (102, "12 34", "en", "s", 1), (103, None, "en", "s", 1), (104, docs[7][1] + "\nsecret test words that nobody should ever train on because they are a test", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "secret test words that nobody should ever train on because they are a test")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = [(i, t) for i, t, *_ in docs if t and re.search(r"[^\W\d_]", t)]  # all are of one language
    lines = spark.createDataFrame(rows, "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in line_templates.dedup_lines(lines).collect()]
    assert all("All rights" not in t for _, t in rows)
    rows = [(i, t) for i, t in rows if (i, i) in {(a, c) for a, _, c in components_plainly(rows)}]
    kept = []
    for i, t in rows:
        n, hit, _ = contaminated_plainly(t, items)
        if not hit or 20 * len(hit) < n:
            kept.append((i, t))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in kept}
    found = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == want
    assert set(found) == set(range(40))
