"""Source divergence, packing and centroid clustering against plain Python and the tokenizers library."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from colloquy.llm import clustering, divergence, packing

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11 --------------------------------------------------------------------------
def plain_audit(docs, top=200):
    counts, seen, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        words = Counter(TERM.findall((text or "").translate(LOWER)))
        counts[lang or "", source or ""].update(words)
        seen[lang or ""].update(words.keys())
        sources[lang or ""].add(source or "")
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        ns = {s: {t: counts[lang, s][t] for t in kept} for s in names}
        whole = {t: sum(ns[s][t] for s in names) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 1) // (sum(n.values()) + len(kept)) for t, c in n.items()} for s, n in [*ns.items(), (None, whole)]}
        for s in names:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in names if o != s]
            terms = [(t, (p[s][t] - p[None][t]) ** 2 // p[None][t]) for t in kept if ns[s][t] and p[s][t] > p[None][t]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(rows, 1) if part == "pair" or k <= top]
    return sorted(out)


def audit_rows(df, **more):
    return sorted(tuple(r) for r in divergence.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def sample(seed=5, n=300):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)] + ["Été", "漢字", "The", "the"]
    rows = [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ç", "z", None, "Z"])) for k in range(n)]
    return [*rows, *rows[:5], (1, None, "xx", "q"), (2, "", "xx", "r"), (3, "12 !", "yy", "q"), (4, "only once here", "zz", "q"), (None, "the " * 5000, "en", "a")]


def test_divergence(spark):
    rows = sample()
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, term int, rank string")
    assert audit_rows(docs) == plain_audit([r[1:] for r in rows])


def test_divergence_in_many_parts_and_tallies(spark, monkeypatch):
    rows = sample(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    monkeypatch.setattr(divergence, "PART_VECTORS", 4)
    assert audit_rows(docs, part_vectors=4, top=3, block_pairs=7) == plain_audit([r[1:] for r in rows], top=3)


def test_divergence_of_nothing_and_awkward(spark, awkward, nothing):
    from pyspark.sql import functions as F

    docs = awkward.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "s"))
    assert audit_rows(docs) == plain_audit([(r.text, r.lang, r.source) for r in docs.collect()])
    assert audit_rows(nothing.withColumn("source", F.lit("s"))) == []


def test_pair_sums_in_small_blocks_and_large_counts(monkeypatch):
    rng = random.Random(1)
    names, terms = ["a", "b", "c"], 12
    vectors = [([{"source": s, "n": n} for s, n in zip(names, row) if n], t) for row, t in (((5, 0, 1), 3), ((0, 0, 7), 2), ((1, 2, 3), 1), ((0, 10**10, 0), 6))]
    totals = np.array([sum(t * sum(c["n"] for c in v if c["source"] == s) for v, t in vectors) for s in names])
    p = lambda c, k: 1 + 10**9 * (c + 1) // (int(totals[k]) + terms)
    want = {}
    for a, b in itertools.permutations(range(3), 2):
        want[names[a], names[b]] = sum(t * ((x := p(dict((c["source"], c["n"]) for c in v).get(names[a], 0), a)) - (y := p(dict((c["source"], c["n"]) for c in v).get(names[b], 0), b))) ** 2 // y for v, t in [(v, 1) for v, t in vectors for _ in range(t)])
    monkeypatch.setattr(divergence, "CELLS", rng.choice([3, 6]))
    parts = []
    for k, some in enumerate((vectors[:2], vectors[2:])):
        sums = divergence.PairSums(names, totals, terms)
        for v, t in some:
            sums.add(v, t)
        parts.append({(r["source"], r["item"]): r["value"] for r in sums.table("en", k == 0).to_pylist()})
    assert {k: parts[0][k] + parts[1][k] for k in want} == want


def test_likelihood_is_exact_beyond_a_long(spark):
    from pyspark.sql import functions as F

    cases = [(0, 10, 3), (9 * 10**9 - 1, 10**10, 5), (9 * 10**9, 10**10, 5), (10**15, 10**16 + 1, 7)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r.p for r in df.select("c", divergence.likelihood(F.col("c"), F.col("n"), F.col("v")).alias("p")).orderBy("c").collect()]
    assert got == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases]


# 12 --------------------------------------------------------------------------
def judge_packing(spark, docs, pieces, capacity=2048):
    """All ids lie in one piece each, sequences are gapless, and what is below the capacity is a power of two."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.select("doc_id", "text").collect()]
    rows = pieces.collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    have = defaultdict(list)
    for r in rows:
        have[r.doc_id].append(r)
    want = defaultdict(list)
    for key, ids in coded:
        want[key].append(ids)
    assert set(have) == set(want)
    for key, texts in want.items():
        assert sum(r.length for r in have[key]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(have[key], key=lambda r: r.start):
                assert r.start == at and r.length > 0 and r.doc_tokens == len(texts[0]) and r.ids_crc32 == crc(texts[0][at : at + r.length])
                assert r.ids == texts[0][at : at + r.length]
                at += r.length
            assert at == len(texts[0])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity and (end == capacity or end & (end - 1) == 0)
    return sequences


def test_packing(spark, awkward, nothing):
    for pool in (4096, 4):
        judge_packing(spark, awkward, packing.pack(awkward, pool=pool, ids=True))
    assert packing.pack(nothing).count() == 0
    special = spark.createDataFrame([(1, "a <|endoftext|> b<|endoftext|>"), (2, " " * 5000 + "x"), (3, "é漢͸ ½ '’s"), (4, "a" * 100_000)], "doc_id long, text string")
    judge_packing(spark, special, packing.pack(special, ids=True))


def test_packing_keeps_most_documents_whole(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=int(rng.lognormvariate(5.5, 1)) + 1))) for k in range(1500)], "doc_id long, text string").repartition(2)
    pieces = packing.pack(docs, ids=True)
    judge_packing(spark, docs, pieces)
    short = [r for r in pieces.groupBy("doc_id", "doc_tokens").count().collect() if r.doc_tokens <= 2048]
    assert sum(r["count"] > 1 for r in short) / len(short) < 0.05


def test_best_counts_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(5))}
        room = rng.randrange(60)
        found = packing.best_counts(room, sorted(counts), counts.get)
        assert all(0 < n <= counts[k] for k, n in found.items())
        best = max((s for c in itertools.product(*(range(n + 1) for n in counts.values())) if (s := sum(x * k for x, k in zip(c, counts, strict=True))) <= room), default=0)
        assert sum(k * n for k, n in found.items()) == best


# 13 --------------------------------------------------------------------------
def plain_clusters(rows, dims=64, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (d2(v, centroids[c]), c)) for _, v in kept]
        if n < rounds:
            for c in range(len(centroids)):
                if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == c]:
                    centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, o, d2(v, centroids[o])) for (i, v), o in zip(kept, own, strict=True)]
    total, sums = sum(r[2] for r in out), Counter()
    for _, o, d in out:
        sums[o] += d
    return sorted(((i, o, d, sums[o], total, hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()) for i, o, d in out), key=str)


def clusters_of(df, **more):
    return sorted((tuple(r) for r in clustering.cluster(df, **more).drop("scanned").collect()), key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters(spark, kind):
    rng = random.Random(4)
    rows = [(k, [float(np.float32(rng.gauss(k % 5, 0.4))) for _ in range(64)]) for k in range(250)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [None, *[1.0] * 63]), (904, [float("nan"), *[1.0] * 63]), (905, [float("-inf"), *[1.0] * 63]), (906, [0.0] * 64)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, inertia string").repartition(5)
    assert clusters_of(df) == plain_clusters(rows)


def test_clusters_of_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([(k, [0.5] * 64) for k in range(40)], [(1, [1.0] * 64), (2, [-1.0] * 64), (3, [-0.99] * 64)], [(7, [2.0] * 64)]):
        assert clusters_of(spark.createDataFrame(rows, schema)) == plain_clusters(rows)
    assert clusters_of(spark.createDataFrame([], schema)) == [] == clusters_of(spark.createDataFrame([(1, None)], schema))
    with pytest.raises(Exception, match="fit a long"):
        clusters_of(spark.createDataFrame([(1, [1e300] * 64)], schema))
    large = [(k, [(-1) ** k * 1e6 + k * 1000.0 + j for j in range(64)]) for k in range(30)]
    assert clusters_of(spark.createDataFrame(large, schema)) == plain_clusters(large)


def test_bounds_spare_comparisons_and_change_nothing():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(rng.normal(0, 40, 8), 4, (400, 8)) for _ in range(6)]).round().astype(np.int32)
    before = x[:: len(x) // 6][:6].astype(np.int64)
    own, upper, lower = clustering.nearest(x, before)
    shares = []
    for _ in range(5):
        now = np.stack([x[own == c].sum(axis=0) // max(1, (own == c).sum()) if (own == c).any() else before[c] for c in range(6)])
        own, upper, lower, scanned = clustering.Bounds(before, now).assign(x, own, upper, lower)
        assert (own == clustering.squared(x, now).argmin(axis=1)).all()
        shares.append(scanned.mean())
        before = now
    assert shares[-1] < 0.2


# 4 ---------------------------------------------------------------------------
def test_run_bounds():
    from colloquy.llm import substrings

    least = np.array([5, 5, 5, 7, 9, 9, 5] + [4] * 150, dtype=np.uint64)
    starts, n = substrings.run_bounds(least, np.array([4, 5, 9], dtype=np.uint64))
    assert list(zip(starts.tolist(), n.tolist(), strict=True)) == [(0, 3), (4, 2), (6, 1), (7, 64), (71, 64), (135, 22)]
    assert [len(x) for x in substrings.run_bounds(least[:0], least)] == [0, 0]


def test_a_long_copied_text_is_cut_in_linear_time(spark):
    """400,000 words copied with a change in each thousand: runs and stretches stay bounded, and what is left is right."""
    from colloquy.llm import substrings

    rng = random.Random(8)
    words = [f"w{rng.randrange(50_000)}" for _ in range(400_000)]
    changed = [f"x{k}" if k % 1000 == 500 else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, "same " * 5000), (4, "same " * 3000)], "doc_id long, text string")
    found = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert (found[1].n_removed, found[3].n_removed, found[4].n_removed) == (0, 0, 3000)
    assert found[2].kept.split() == [w for k, w in enumerate(changed) if k % 1000 == 500]


# memory and awkward names ----------------------------------------------------
def test_language_id_of_a_long_text_equals_short_pieces(monkeypatch):
    """A text read piece by piece gives what it gives in one, and takes the memory of a piece."""
    import resource

    from colloquy.llm import langid

    rng = np.random.default_rng(0)
    logs = np.log(rng.dirichlet(np.full(1 << langid.BUCKET_BITS, 0.2), 5).T + 1e-7).astype(np.float32)
    text = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3000)).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    whole = langid.infer(logs, data, np.array([0, len(data)]))
    monkeypatch.setattr(langid, "piece_bytes", lambda languages: 700)
    pieces = langid.infer(logs, data, np.array([0, len(data)]))
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(whole, pieces, strict=True))
    monkeypatch.undo()
    logs = np.log(rng.random((1 << langid.BUCKET_BITS, 64)) + 1e-3).astype(np.float32)
    long = np.frombuffer(b"abc def xyz " * 250_000, dtype=np.uint8)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    langid.infer(logs, long, np.array([0, len(long)]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_an_item_beyond_the_bound_is_cut(spark):
    from colloquy.llm import decontaminate as dc

    words = [f"w{k}" for k in range(3000)]
    items = [("long", " ".join(words)), ("short", "only five words are here"), ("none", " !! ")]
    blocks = list(dc._blocks(iter(items), 13, 20_000))
    assert len(blocks) > 10 and all(sum(13 * (len(t.encode()) + 64) for _, t in b) <= 20_000 for b in blocks)
    windows = {w for b in blocks for _, t in b for w in dc._windows(t, 13)}
    assert windows == {w for _, t in items for w in dc._windows(t, 13)}
    docs = spark.createDataFrame([(1, " ".join(words[500:700]), 1), (2, "nothing of it", 2), (3, "only FIVE words are here", 3)], "doc_id long, text string, _decontam_hit int")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = {r.doc_id: r for r in dc.find_contamination(docs, benchmark, broadcast_bytes=20_000).collect()}
    assert (found[1].n_hit, found[1].items, found[1]._decontam_hit) == (200, ["long"], 1)
    assert (found[2].n_hit, found[3].n_hit, found[3].items) == (0, 5, ["short"])


def test_remembered_words_are_bounded_in_bytes(monkeypatch):
    from colloquy.llm import bpe

    encoder = bpe.load().encoder()
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 1 << 20)
    for k in range(30):
        encoder.encode([chr(97 + k % 26) * 100_000 + str(k), "hello world"])
        assert encoder.bytes <= 1 << 20
    monkeypatch.undo()
    assert encoder.encode(["hello world"])[0].tolist() == bpe.Encoder(bpe.load()).encode(["hello world"])[0].tolist()


def test_archives_of_awkward_ids(spark):
    from colloquy.llm import warc
    from colloquy.llm.common import written

    body = "x" * 2000
    rows = [("None", "http://a/1", body), ("a\nb: c", "http://a/2", body), ("", "http://a/3", "short"), (None, "http://a/4", body), ("p:q%20<>", "http://a/5", "y" * 1500), ("z", None, "y" * 1500)]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id string, url string, html string, kind int, key string")
    index = warc.archive(pages)
    found = {r.page_id: r for r in warc.resolve_revisits(written(warc.read_records(index.captures(spark), index.record_bytes), "t"), index).collect()}
    assert set(found) == {r[0] for r in rows}
    assert {k: (r.kind, r.refers_to, r.payload_bytes) for k, r in found.items()} == {
        "None": ("revisit", "a\nb: c", 2000), "a\nb: c": ("response", None, 2000), "": ("response", None, 5), None: ("revisit", "a\nb: c", 2000), "p:q%20<>": ("revisit", "z", 1500), "z": ("response", None, 1500),
    }


def test_revisits_find_responses_by_bisection(spark, tmp_path):
    """Small blocks, a url with very many captures, keys that span blocks, and odd urls: each revisit's response is found in the index."""
    from colloquy.llm import warc

    body = lambda k: f"<p>{k}" + "é" * 600
    urls = ["http://same.example/x", "http://same.example/x", " http://b c.example/ü?\t1 ", None, "HTTP://D.example:80/"]
    rows = [(k, urls[k % 5] if k % 3 else f"http://h{k}.example/", body(k % 40)) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    index = warc.build_index(warc.write_archives(pages, f"{tmp_path}/w"), f"{tmp_path}/w", block_lines=7)
    assert len(index.blocks) > 40
    found = {int(r.page_id): r for r in warc.resolve_revisits(warc.read_records(index.captures(spark), index.record_bytes), index).collect()}
    for k, _, html in rows:
        last = 360 + k % 40
        data = html.encode()
        want = ("response", None) if k == last else ("revisit", str(last))
        assert (found[k].kind, found[k].refers_to) == want and found[k].payload_bytes == len(data) and found[k].payload_digest == hashlib.sha1(data).hexdigest()
    read = lambda at: warc.read_block(*index.blocks[at][1:4])
    places = [warc.place_of(b[0], b[4]) for b in index.blocks]
    for k, url, _ in rows:
        assert [c["page_id"] for c in warc.find_captures(index.blocks, places, warc.index_key(url), str(k), read)] == [str(k)]
    assert warc.find_captures(index.blocks, places, warc.index_key("http://none.example"), "1", read) == []


# 2 ---------------------------------------------------------------------------
def test_copies_of_a_row_get_gapless_slots(spark):
    """A row that is repeated beyond a block is counted and made again in runs."""
    from colloquy.llm import sharding

    rows = [(7, "same")] * 2500 + [(k, f"text {k}") for k in range(300)] + [(None, None)] * 40 + [(7, "other")] * 3
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), [1.0, 2.0, 1.0], rows_per_block=100).collect()
    assert sorted(((r.doc_id, r.size) for r in found), key=str) == sorted(((k, 16 + len(t or "")) for k, t in rows), key=str)
    for shard in range(3):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in found if r.doc_id == 7}) == 1


# 6 ---------------------------------------------------------------------------
def test_quality_features_fit_and_evidence_again(spark):
    """Features by plain Python, the fit by the gradient of its penalised loss, evidence and toxicity by the weights; sites from urls."""
    import re

    from pyspark.sql import functions as F

    from colloquy.llm import quality
    from colloquy.llm.common import lower_ascii, word_hashes

    rng = random.Random(11)
    good, bad = "river garden music letter window".split(), "CLICK win$$ http://x now!! cheap".split()
    texts = {k: " ".join(rng.choices(good if k % 2 else bad, k=rng.randrange(3, 30))) + rng.choice([".", ",\n", " 12"]) for k in range(240)}
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def shapes(t):
        words = word.findall(t.translate(LOWER))
        n, raw = max(len(words), 1), t.encode()
        letters = sum(65 <= c <= 122 for c in raw)
        return [
            math.log1p(len(words)) / 8, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, min(sum(chr(c) in "#%&$*|!<>{}[]=+~^@\\/_" for c in raw) / n, 4), sum(65 <= c <= 90 for c in raw) / max(letters, 1),
            sum(48 <= c <= 57 for c in raw) / max(len(raw), 1), raw.count(b"\n") / n, min(max(len(raw), 1) / n / 10, 4), sum(c in b".," for c in raw) / n,
        ]

    def buckets(t):
        out = set()
        for w in word.findall(t.translate(LOWER)):
            data = np.frombuffer(w.encode(), dtype=np.uint8)
            out.add(int(word_hashes(lower_ascii(data), np.array([0]), np.array([len(data)]))[0] >> np.uint64(64 - quality.BUCKET_BITS)))
        return out

    docs = spark.createDataFrame([(k, t, f"http://{'good' if k % 2 else 'bad'}{k % 3}.example/{k % 4}/p{k}") for k, t in texts.items()], "doc_id long, text string, url string")
    labels = spark.createDataFrame([(k, int(k % 2), int(k % 5 == 0)) for k in range(160)], "doc_id long, quality int, toxic int")
    heads = quality.train(docs, labels)
    for head, y in (("quality", [k % 2 for k in range(160)]), ("toxic", [int(k % 5 == 0) for k in range(160)])):
        h = heads[head]
        x = np.array([[1, *shapes(texts[k]), *(float(b in buckets(texts[k])) for b in h.buckets)] for k in range(160)])
        ridge = np.array([1e-6, *[0.01] * quality.SHAPES, *[quality.RIDGE] * len(h.buckets)])
        p = 1 / (1 + np.exp(-np.clip(x @ h.weights, -30, 30)))
        assert np.abs(x.T @ (p - np.array(y)) + ridge * h.weights).max() < 1e-3 and h.base == (sum(y) + 0.5) / 161
    host, path = F.element_at(F.split("url", "/"), 3), F.element_at(F.split("url", "/"), 4)
    found = {r.doc_id: r for r in quality.classify(docs, labels, host, path).collect()}
    assert len(found) == 240 and {(r.host, r.path) for r in found.values()} == {(f"{'good' if k % 2 else 'bad'}{k % 3}.example", str(k % 4)) for k in range(240)}
    for k, t in texts.items():
        odds = {}
        for head in quality.HEADS:
            h = heads[head]
            odds[head] = float(np.array([1, *shapes(t), *(float(b in buckets(t)) for b in h.buckets)]) @ h.weights)
        base = heads["quality"].base
        assert found[k].evidence == pytest.approx(max(-30, min(30, odds["quality"])) - math.log(base / (1 - base)), abs=1e-6)
        assert found[k].toxicity == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, odds["toxic"])))), abs=1e-6)
    held = [k for k in range(160, 240)]
    assert sum((found[k].quality >= 0.5) == bool(k % 2) for k in held) >= 78


# 9 ---------------------------------------------------------------------------
def test_neighbours_do_not_hang_on_how_ranges_are_sampled(spark, monkeypatch):
    """Without reuse of exchanges and without adaptive plans, with rows beyond Spark's samples, ids beyond 2**53 and nulls: every next document is the right one."""
    from colloquy.llm import fingerprints

    monkeypatch.setattr(fingerprints, "ROWS_PER_PART", 20)
    rng = random.Random(12)
    ids = rng.sample(range(2**60, 2**60 + 10**6), 6000)
    rows = [(i, f"text of {i} {rng.random()}") for i in ids] + [(None, f"none {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    settings = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "3"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = fingerprints.compare_neighbours(docs).select("doc_id", "edited_sha256").collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(found) == len(rows)
    order = sorted((r for r in rows if r[0] is not None), reverse=True)
    got = {r.doc_id: r.edited_sha256 for r in found if r.doc_id is not None}
    edit = lambda a, b: hashlib.sha256(fingerprints.edited(a, b).encode()).hexdigest()
    assert all(got[a[0]] == edit(a[1], b[1]) for a, b in itertools.pairwise(order))
    nulls = [t for i, t in rows if i is None]
    assert got[order[-1][0]] in {edit(order[-1][1], t) for t in nulls}
    last = [r.edited_sha256 for r in found if r.doc_id is None]
    assert sum(d in {edit(t, order[0][1]) for t in nulls} for d in last) == 1 and len(last) == len(nulls)


def test_bitmaps_leave_out_no_near_copy(spark):
    """Pipeline: bits that differ are no more than shingles that only one text has, at any two lengths; what is far apart is told so, and shuffle files go with the table."""
    from pyspark.sql import functions as F

    from colloquy.llm import common, near_copies

    rng = random.Random(5)
    sets = [sorted(rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)) for n in (1, 3, 60, 64, 65, 500, 700)]
    sets += [sorted(sets[-1][:620] + sets[0]), sorted(sets[-2][100:] + sets[2])]
    rows = spark.createDataFrame([(k, [], s) for k, s in enumerate(sets)], "words long, bands array<long>, grams array<long>")
    late = np.zeros(near_copies.LATE_MARKS, dtype=bool)
    bits = {r.words: bytes(r.bits) for r in near_copies._with_prefix(rows, late, 0.8).collect()}
    for a, b in itertools.combinations(range(len(sets)), 2):
        apart = near_copies._bits_apart(bits[a], bits[b])
        assert apart <= len(set(sets[a]) ^ set(sets[b])) and apart == near_copies._bits_apart(bits[b], bits[a])
    assert near_copies._bits_apart(bits[5], bits[6]) > (500 + 700) / 9 and all(8 * len(bits[k]) >= 2 * len(s) for k, s in enumerate(sets))
    assert near_copies._bits_apart(bits[5], bits[5]) == 0
    df, seen = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), spark.conf.get(common.SHUFFLES_GO, None)
    assert common.written(df, "gone").count() == 7 and spark.conf.get(common.SHUFFLES_GO, None) == seen
