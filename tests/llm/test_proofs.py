"""Operators against plain Python that shares no code with them, and cases that only large or awkward inputs show."""

import base64
import math
import random
import re
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from colloquy.llm import bpe, decontaminate, fingerprints, langid, line_templates, near_copies, quality, sharding, simhash, warc

from .test_operators import texts_of

M64 = (1 << 64) - 1
rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]


def line(n=10, source=rng):
    return " ".join(source.choice(VOCABULARY) for _ in range(n))


# 1 ---------------------------------------------------------------------------
def grams_plainly(text):
    """For each word the buckets of its trigrams."""
    words = re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())
    return [[(((w[k] << 16 | w[k + 1] << 8 | w[k + 2]) * 2654435761) % (1 << 32)) >> 16 for k in range(len(w) - 2)] for w in (b" " + x + b" " for x in words)]


def model_plainly(rows):
    counts = defaultdict(Counter)
    for text, lang in rows:
        counts[lang].update(g for word in grams_plainly(text) for g in word)
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    return {lang: (lambda g, c=counts[lang], n=total[lang]: math.log(c[g] + 0.5) - math.log(n + 0.5 * 65536)) for lang in sorted(counts)}


def mixture_plainly(model, text):
    """(score, {language: share}) by expectation-maximisation and penalised likelihood."""
    names = list(model)
    logs = [[sum(model[n](g) for g in word) for n in names] for word in grams_plainly(text)]
    like = [[math.exp(max(x - max(row), -60)) for x in row] for row in logs]

    def em(w, rounds):
        for _ in range(rounds):
            shares = [[a * b for a, b in zip(row, w, strict=True)] for row in like]
            shares = [[x / sum(row) for x in row] for row in shares]
            w = [sum(col) / len(shares) for col in zip(*shares, strict=True)]
        return w

    w = em([1 / len(names)] * len(names), 6)
    order = sorted(range(len(names)), key=lambda k: (-w[k], k))
    best, chosen, fallen = -math.inf, 1, 0
    for k in range(1, len(names) + 1):
        own = [w[j] if j in order[:k] else 0.0 for j in range(len(names))]
        own = [x / sum(own) for x in own]
        value = sum(math.log(sum(a * b for a, b in zip(row, own, strict=True)) or 1e-300) for row in like) - 0.5 * (k - 1) * math.log(max(len(like), 2))
        if value > best:
            best, chosen, fallen = value, k, 0
        else:
            fallen += 1
        if fallen >= 2:
            break
    own = [w[j] if j in order[:chosen] else 0.0 for j in range(len(names))]
    own = [x / sum(own) for x in own]
    return w[order[0]], dict(zip(names, em(own, 4) if chosen > 1 else own, strict=True))


def tongues():
    """Six made-up languages with letters of their own."""
    out = {}
    for k, letters in enumerate(("abcde", "fghij", "klmno", "pqrst", "uvwxy", "aeiou")):
        r = random.Random(k)
        words = ["".join(r.choice(letters) for _ in range(r.randrange(3, 7))) for _ in range(60)]
        out[f"l{k}"] = lambda n, words=words, r=r: " ".join(r.choice(words) for _ in range(n))
    return out


def test_language_id_equals_plain_mixture(spark):
    speak = tongues()
    labelled = [(speak[lang](40), lang) for lang in speak for _ in range(5)]
    model = langid.train(spark.createDataFrame(labelled, "text string, lang string"))
    asked = [speak["l0"](30), f"{speak['l1'](30)} {speak['l3'](12)}", " ".join(speak[f"l{k}"](20) for k in range(5)), " ".join(speak[f"l{k}"](15) for k in range(6)), f"{speak['l5'](3)}! 12"]
    plain = model_plainly(labelled)
    rows = langid.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string"), model).collect()
    for r in rows:
        score, shares = mixture_plainly(plain, asked[r.doc_id])
        assert r.score == pytest.approx(score, abs=2e-3)
        assert {x.lang for x in r.langs} == {n for n, s in shares.items() if s > 1e-4}
        assert all(x.share == pytest.approx(shares[x.lang], abs=2e-3) for x in r.langs)
        assert r.lang_pred == max(shares, key=lambda n: (round(shares[n], 3), n == r.lang_pred))
    assert len(rows[2].langs) == 5  # as many languages as there are, not a fixed number


def test_language_id_of_one_long_word():
    """Words longer than a stretch give the same sums as in one piece."""
    import numpy as np

    logs = np.random.default_rng(0).normal(size=(1 << langid.BUCKET_BITS, 3)).astype(np.float32)
    data = np.frombuffer(b"abc " + b"xyz" * 4000 + b" de" * 50, dtype=np.uint8)
    grams, firsts, _ = langid.word_grams(data, np.array([0, len(data)]))
    want = np.add.reduceat(logs[grams], firsts, axis=0)
    old, langid.CELLS_AT_ONCE = langid.CELLS_AT_ONCE, 300
    try:
        assert np.allclose(langid._word_logs(logs, grams, firsts), want, rtol=1e-3, atol=1e-2)
    finally:
        langid.CELLS_AT_ONCE = old


def test_language_stage_drops_mixtures(spark):
    speak = tongues()
    docs = [(k, speak[f"l{k % 6}"](40), f"l{k % 6}") for k in range(60)] + [(100, " ".join(speak[f"l{k}"](20) for k in range(6)), None), (101, "12 34", None), (102, None, None), (103, speak["l2"](30), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, df, "").collect()} == {*range(60), 103}


# 2 ---------------------------------------------------------------------------
def draw_plainly(key, shard, weight):
    text = "\0null" if key is None else str(key)
    h = xxh64_intdigest(struct.pack("<i", shard), xxh64_intdigest(text.encode(), 42))
    return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight


def test_shards_equal_plain_draws(spark):
    keys = [None, *range(300), -5, 1 << 40]
    weights = [1.0, 2.5, 0.5, 1.0]
    found = sharding.assign_shards(spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string"), weights).collect()
    for r in found:
        best = min(range(4), key=lambda s: draw_plainly(r.doc_id, s, weights[s]))
        assert r.shard == best
        assert r.grown_shard == (4 if draw_plainly(r.doc_id, 4, 1.0) < draw_plainly(r.doc_id, best, weights[best]) else best)
    assert len({r.shard for r in found}) == 4 and any(r.grown_shard == 4 for r in found)


# 3 ---------------------------------------------------------------------------
def test_item_without_id_hits(spark):
    passage = line(20)
    docs = spark.createDataFrame([(1, f"{line(5)} {passage}"), (2, line(30))], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (7, line(20))], "item_id long, text string")
    for most in (1 << 20, 100):  # in one block and in blocks of one item
        found = {r.doc_id: (r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.find_contamination(docs, bench, broadcast_bytes=most).collect()}
        assert found == {1: (20, [], True), 2: (0, [], False)}


# 6 ---------------------------------------------------------------------------
def posteriors_plainly(rows):
    """rows: (id, host, path, p, evidence) to (host_posterior, path_posterior) by id."""
    paths, hosts = defaultdict(list), defaultdict(list)
    for _, host, path, p, _ in rows:
        paths[host, path].append(p)
        hosts[host].append(p)
    n, mean = len(rows), sum(p for *_, p, _ in rows) / len(rows)

    def weight(spread, groups):
        share = (spread / n - mean * (1 - mean) * (groups - 1) / n) / max(mean * (1 - mean), 1e-9)
        return 1 / min(max(share, 1e-4), 0.5) - 1

    average = lambda xs: sum(xs) / len(xs)
    host_weight = weight(sum(len(x) * (average(x) - mean) ** 2 for x in hosts.values()), len(hosts))
    path_weight = weight(sum(len(x) * (average(x) - average(hosts[h])) ** 2 for (h, _), x in paths.items()), len(paths) - len(hosts) + 1)
    host_posterior = {h: (sum(x) + host_weight * mean) / (len(x) + host_weight) for h, x in hosts.items()}
    out = {}
    for i, host, path, p, _ in rows:
        own = paths[host, path]
        m = (sum(own) - p + path_weight * host_posterior[host]) / (len(own) - 1 + path_weight)
        out[i] = (host_posterior[host], min(max(m, 1e-6), 1 - 1e-6))
    return out


def test_posteriors_equal_plain_ones(spark):
    r = random.Random(9)
    rows = [(k, r.choice(["a", "b", "c", None]), r.choice(["x", "y", None]), r.random() ** (1 + k % 3), r.uniform(-3, 3)) for k in range(200)] + [(500, "single", "page", 0.9, 1.0)]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, p double, evidence double").withColumn("toxicity", F.lit(0.1))
    want = posteriors_plainly(rows)
    for x in quality.posteriors(scored).collect():
        host, path = want[x.doc_id]
        assert (x.host_posterior, x.path_posterior) == (pytest.approx(host), pytest.approx(path))
        assert x.quality == pytest.approx(1 / (1 + math.exp(-(x.evidence + math.log(path / (1 - path))))))


# 7 ---------------------------------------------------------------------------
def near_plainly(texts):
    """A class for each text: connected by five-word Jaccard of 0.8 or more, over all pairs."""
    def grams(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(texts))]


def lines_plainly(texts, classes, min_docs=3, leading=3, similarity=0.7):
    """The texts without lines of recurring templates."""
    kind = dict(zip(range(len(texts)), near_plainly(texts) if classes else [texts.index(t) for t in texts], strict=True))
    wild = lambda t: "<*>" if re.search("[0-9]", t) else t
    rows = []
    for k, t in enumerate(texts):
        for at, text in enumerate((t or "").split("\n") if t is not None else []):
            if text.strip(" "):
                tokens = [wild(x) for x in text.split(" ")]
                rows.append((k, at, (len(tokens), tuple(tokens[:leading])), tokens))
    seen = defaultdict(set)
    for k, _, leaf, tokens in rows:
        for i, t in enumerate(tokens):
            if t != "<*>":
                seen[leaf, i, t].add(kind[k])
    named, kinds = [], defaultdict(set)
    for k, at, leaf, tokens in rows:
        constant = [len(seen[leaf, i, t]) >= min_docs for i, t in enumerate(tokens)]
        if sum(constant) >= similarity * len(tokens):
            template = (leaf, tuple(t if c else "<*>" for t, c in zip(tokens, constant, strict=True)))
            named.append((k, at, template))
            kinds[template].add(kind[k])
    gone = {(k, at) for k, at, template in named if len(kinds[template]) >= min_docs}
    return [None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (k, at) not in gone) for k, t in enumerate(texts)]


@pytest.mark.parametrize("classes", [False, True])
def test_lines_equal_plain_templates(spark, classes):
    """Pages of mostly shared lines, copies, near copies, notices with variable fields."""
    r = random.Random(21)
    shared = [line(source=r) for _ in range(6)]
    texts = ["\n".join([*shared, line(12, r), line(12, r)]) for _ in range(12)]
    texts += [f"{line(14, r)}\nposted on 2026-0{k}-11 by user{k} at noon\n\n{line(9, r)}" for k in range(1, 8)]
    body = [line(30, r) for _ in range(4)]
    texts += ["\n".join(body)] * 5
    for k in range(4):
        words = body[k].split()
        words[3] = f"changed{k}"
        texts.append("\n".join([*body[:k], " ".join(words), *body[k + 1 :]]))
    texts += [None, "", "   \n\t", shared[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x.text for x in line_templates.dedup_lines(df, classes=classes).collect()}
    assert [found[k] for k in range(len(texts))] == lines_plainly(texts, classes)
    if classes:
        assert all(not set(shared) & set(found[k].split("\n")) for k in range(12)) and all(found[k] == texts[k] for k in range(19, 28))


def test_text_of_many_lines(spark):
    text = "\n".join(f"own line {k} {'x' * (k % 7)}{chr(97 + k % 26)}" if k % 2 else "All rights with us" for k in range(100_000))
    df = spark.createDataFrame([(0, text), (1, "a b c\nAll rights with us"), (2, "d e f\nAll rights with us")], "doc_id long, text string")
    found = {r.doc_id: r for r in line_templates.dedup_lines(df, counts=True).collect()}
    assert found[0].n_lines == 100_000 and found[0].n_dropped == 50_000 and found[1].text == "a b c"


# 8 ---------------------------------------------------------------------------
def test_warc_with_hot_and_large_payloads(spark, tmp_path):
    """One payload in half of all pages, one short one in the others, and one of 20 MB."""
    big = "y" * 2000
    pages = [(k, f"http://h{k % 5}.example/{k}", big if k % 2 else "tiny") for k in range(400)] + [(1000, "http://z.example/", "z" * (20 << 20)), (None, None, "q" * 1500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.archive(df, f"{tmp_path}/w")
    found = {r.page_id: r for r in warc.resolve_revisits(warc.read_records(index.captures(spark), index.record_bytes), index).collect()}
    assert len(found) == len(pages)
    assert {k for k, r in found.items() if r.kind == "revisit"} == {str(k) for k in range(1, 399, 2)} and all(r.refers_to == "399" for r in found.values() if r.kind == "revisit")
    assert found["1000"].payload_bytes == 20 << 20 and found["0"].payload_bytes == 4 and found["1"].payload_bytes == 2000 and found[None].payload_bytes == 1500


# 9 ---------------------------------------------------------------------------
def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def sketch_plainly(text, k=128):
    words = re.findall(rb"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode())
    hashes = [mixed((sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w)) + len(w)) & M64) for w in words]
    size, out = min(5, len(hashes)), set()
    for at in range(len(hashes) - size + 1 if size else 0):
        h = 0
        for w in hashes[at : at + size]:
            h = (h * 0xD6E8FEB86659FD93 + w) & M64
        out.add(mixed(h))
    return sorted(out)[:k]


def likeness_plainly(a, b, k=128):
    if not a or not b:
        return float(len(a) == len(b))
    union = sorted({*a, *b})[:k]
    return sum(h in a and h in b for h in union) / len(union)


def test_fingerprints_equal_plain_sketches(awkward):
    """Ids and texts are in one order only where ids differ, so rows of one id are left out of the neighbours."""
    docs = awkward.filter("doc_id IS NOT NULL AND doc_id <> 4")
    text = {i: t or "" for i, t in texts_of(docs)}
    order = sorted(text, reverse=True)
    found = {r.doc_id: r for r in fingerprints.compare_neighbours(docs).collect()}
    assert sorted(found) == sorted(text)
    for k, i in enumerate(order):
        after = order[(k + 1) % len(order)]
        half = len(text[i]) // 2
        own, new, other = (sketch_plainly(t) for t in (text[i], text[i][: len(text[i]) - half] + text[after][:half], text[after]))
        coded = lambda s: base64.b64encode(b"".join(struct.pack(">Q", h) for h in s)).decode()
        assert (found[i].fingerprint, found[i].edited_fingerprint) == (coded(own), coded(new))
        assert found[i].near_edited == pytest.approx(likeness_plainly(own, new)) and found[i].near_next == pytest.approx(likeness_plainly(own, other))


@pytest.mark.parametrize("kind", ["decimal(12,2)", "smallint", "string", "date"])
def test_fingerprints_of_any_id(spark, kind):
    df = spark.range(30).select((F.date_add(F.lit("2026-01-01"), F.col("id").cast("int")) if kind == "date" else F.col("id").cast(kind)).alias("doc_id"), F.lit("a b c d e f").alias("text"))
    found = fingerprints.compare_neighbours(df)
    assert found.schema["doc_id"].dataType == df.schema["doc_id"].dataType and found.count() == 30
    one = fingerprints.compare_neighbours(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# 5, 10 -----------------------------------------------------------------------------
def test_one_word_of_megabytes(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(1 << 20))
    df = spark.createDataFrame([(1, word), (2, word + "x"), (3, f"a {word}")], "doc_id long, text string")
    for r in bpe.encode(df).collect():
        assert list(r.ids) == library.encode(r.text, add_special_tokens=False).ids
    assert simhash.find_components(df).count() == 3


def test_clashing_names(spark):
    names = ["_row", "_id", "_tk", "_keep_id", "_row_id", "_row_text", "_decontam_hit", "c0", "words", "root", "contaminated"]
    rows = [(1, line(30), *["mine"] * len(names)), (2, line(30), *["mine"] * len(names))]
    df = spark.createDataFrame([*rows, (3, rows[0][1], *["other"] * len(names))], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    bench = spark.createDataFrame([(1, "nothing of this")], "item_id long, text string")
    for out in (simhash.drop_near_duplicates(df), near_copies.drop_near_copies(df)):
        assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == sorted(rows)
    assert decontaminate.decontaminate(df, bench).columns == df.columns and decontaminate.decontaminate(df, bench).count() == 3
    assert line_templates.dedup_lines(df).columns == df.columns


def test_near_copies_equal_all_pairs(spark):
    """Groups of copies with few and many changes: the classes are those of all pairs. In the fifth group only the source is near all others."""
    r, texts = random.Random(5), []
    for n, copies, changes in ((40, 3, 0), (200, 8, 1), (300, 40, 2), (400, 5, 30), (400, 60, 6), (3, 4, 0)):
        words = line(n, r).split()
        texts.append(" ".join(words))
        for _ in range(copies):
            own = list(words)
            for at in r.sample(range(n), changes):
                own[at] = r.choice(VOCABULARY)
            texts.append(" ".join(own))
    classes = near_plainly(texts)
    first = {c: min(k for k in range(len(texts)) if classes[k] == c) for c in classes}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in near_copies.drop_near_copies(df).collect()) == sorted(set(first.values()))


def test_near_copies_lose_no_link(spark):
    """Pairs at the index exactly that agree in no band of MinHash (found among 15,000), between texts that share most of a passage."""
    texts = []
    for k in (109, 4496, 4506, 7277, 7554, 8059, 8214, 9249, 9642, 10066, 10682, 14016, 14940, 14973):
        r = random.Random(k)
        word = lambda: "".join(r.choice("abdeghilmnorstu") for _ in range(7))  # noqa: B023, E731
        words = [word() for _ in range(49)]
        texts += [" ".join(words), " ".join([*words[:24], word(), *words[25:]])]
    r = random.Random(1)
    passage = line(60, r)
    texts += [f"{passage} {line(30, r)}" for _ in range(300)]
    classes = near_plainly(texts)
    first = {c: min(k for k in range(len(texts)) if classes[k] == c) for c in classes}
    assert len(set(first.values())) == 14 + 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in near_copies.drop_near_copies(df).collect()) == sorted(set(first.values()))
