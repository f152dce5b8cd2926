"""Near copies in DataFrame operations only, texts that are almost near copies of very many others, and terms counted by numbers."""

import random

import corpus_pipeline
from colloquy.llm import common, divergence, near_copies

from .test_proofs import near_plainly


def edited(n, copies, changes, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeghilmnorstu") for _ in range(7))
    base = [word() for _ in range(n)]
    out = []
    for _ in range(copies):
        own = list(base)
        for at in rng.sample(range(n), changes):
            own[at] = word()
        out.append(" ".join(own))
    return out


def classes_of(df, **more):
    """Sets of the doc_ids of each class of several texts."""
    words = {r.words: r.doc_id for r in df.select(near_copies.words_key(df["text"]).alias("words"), "doc_id").collect()}
    roots = {}
    for r in near_copies.near_classes(df, **more).collect():
        roots.setdefault(r.root, set()).add(words[r.words])
    return sorted(sorted(c) for c in roots.values())


def plain_classes(texts):
    found = {}
    for k, c in enumerate(near_plainly(texts)):
        found.setdefault(c, []).append(k)
    return sorted(c for c in found.values() if len(c) > 1)


def test_line_dedup_runs_no_python(spark, monkeypatch):
    """Pipeline: the stage is of DataFrame operations only, and finds the same classes as the scans over Arrow."""
    texts = [*edited(60, 12, 1, 1), *edited(150, 30, 4, 2), *edited(400, 5, 30, 3), "two words", "other words here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_classes(texts)
    assert want and classes_of(df) == want

    def never(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(df), name, never)
    monkeypatch.setattr(near_copies.F, "pandas_udf", never)
    monkeypatch.setattr(near_copies.F, "udf", never)
    assert classes_of(df, native=True) == want
    assert corpus_pipeline.line_dedup(spark, df, "").count() == len(texts)


def test_almost_near_copies_make_few_rows(spark, monkeypatch):
    """Pipeline: 200 texts just below the index of each other are told apart in the join, and don't leave it as pairs."""
    texts = edited(150, 200, 6, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made, table = {}, common.Scratch.table

    def counted(self, rows, name):
        out = table(self, rows, name)
        if name == "met-in-prefix":
            made[name] = out.count()
        return out

    monkeypatch.setattr(common.Scratch, "table", counted)
    want = plain_classes(texts)
    for native in (False, True):
        assert classes_of(df, native=native) == want
        assert made["met-in-prefix"] < 5 * len(texts), made


def test_terms_are_counted_without_a_loop_over_them(spark):
    """op11: a task counts 300,000 occurrences in few calls, and the counts are those of plain Python, whatever the bytes."""
    from .test_round3 import LOWER, TERM

    rng = random.Random(7)
    words = ["Été", "漢字", "The", "the", "x", "😀", "a\u00a0b", "e\u0301", "İ"] + ["".join(rng.choice("abcXYZ") for _ in range(5)) for _ in range(200)]
    docs = [(" ".join(rng.choices(words, k=3000)), rng.choice(["en", None]), rng.choice("ab")) for _ in range(100)] + [(None, "en", "a"), ("", "en", "a"), ("12 !", "en", "b"), ("the", "en", "b"), ("the", "en", "b")]
    want = {}
    for text, lang, source in docs:
        found = TERM.findall((text or "").translate(LOWER))
        for term in set(found):
            n, d = want.get((lang or "", source, term), (0, 0))
            want[lang or "", source, term] = n + found.count(term), d + 1
    given = spark.createDataFrame(docs, "text string, lang string, source string").coalesce(1)
    rows = divergence.term_counts(given).collect()
    assert {(r.lang, r.source, r.term): (r.n, r.docs) for r in rows} == want and len(rows) == len(want)
    assert not hasattr(divergence, "Counter")
