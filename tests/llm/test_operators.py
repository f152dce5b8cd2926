"""Each operator on the awkward table against plain Python, and on an empty one."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from colloquy.llm.common import Scratch
from colloquy.llm import bpe, decontaminate, fingerprints, langid, line_templates, quality, sharding, simhash, substrings, warc


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1 ---------------------------------------------------------------------------
def test_language_id(spark, awkward, nothing):
    docs = spark.createDataFrame(
        [(k, f"the house and the garden of the town {k}", "en") for k in range(20)] + [(100 + k, f"das haus und der garten der stadt {k}", "de") for k in range(20)], "doc_id long, text string, lang string"
    )
    model = langid.train(docs)
    assert model[0] == ["de", "en"]
    asked = spark.createDataFrame([(1, "the garden of the house"), (2, "der garten und das haus"), (3, None), (4, "12 - 34"), (5, "the garden of the house and the town der garten der stadt und das haus"), (1, "the garden of the house")], "doc_id long, text string")
    found = langid.identify(asked, model).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 6 and by[1].lang_pred == "en" and by[2].lang_pred == "de"
    assert by[3].lang_pred == by[4].lang_pred == "und" and by[3].score == 0 and not by[4].langs
    assert {x.lang for x in by[5].langs} == {"de", "en"} and sum(x.share for x in by[5].langs) == pytest.approx(1, abs=1e-3)
    assert all(0 <= r.score <= 1 for r in found)
    assert langid.identify(awkward, model).count() == awkward.count()
    assert langid.identify(nothing, model).count() == 0
    untrained = langid.train(nothing)
    assert untrained[0] == [] and {r.lang_pred for r in langid.identify(asked, untrained).collect()} == {"und"}


# 2 ---------------------------------------------------------------------------
def test_sharding(awkward, nothing):
    found = sharding.assign_shards(awkward, [1.0] * 5, rows_per_block=3).collect()
    assert len(found) == awkward.count()
    for shard in range(5):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    assert all(r.grown_shard in (r.shard, 5) for r in found)
    for key, group in itertools.groupby(sorted(found, key=lambda r: str(r.doc_id)), key=lambda r: str(r.doc_id)):
        assert len({r.shard for r in group}) == 1, key
    sizes = sorted((r.size, r.text_crc32) for r in found)
    assert sizes == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in texts_of(awkward))
    assert sharding.assign_shards(nothing, [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(awkward, [1.0, 0.0])


def test_sharding_follows_weights(spark):
    keys = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    counts = {r.shard: r["count"] for r in sharding.assign_shards(keys, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert counts[1] / 40_000 == pytest.approx(0.75, abs=0.02)


# 3 ---------------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated_plainly(text, items, n=13):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in body or ""))
        size = min(n, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1 if own else 0):
            if tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found.add(str(item))
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("most", [1 << 20, 1500])
def test_decontamination(spark, awkward, nothing, most):
    text = dict(texts_of(awkward))
    items = [(1, " ".join(text[2].split()[5:40])), (2, "Été ÜBER"), (3, None), (4, ""), (5, "word word"), (6, "not here at all"), (7, text[1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(awkward.drop("n_words"), bench, broadcast_bytes=most).collect()
    assert len(found) == awkward.count()
    for r in found:
        n, hit, own = contaminated_plainly(r.text, items)
        assert (r.n_words, sorted(r.hit_words), sorted(r["items"]), r.n_hit) == (n, hit, own, len(hit)), r.doc_id
        assert r.contaminated == (bool(hit) and 20 * len(hit) >= n)
    assert decontaminate.find_contamination(nothing, bench).count() == 0
    clean = decontaminate.decontaminate(awkward, bench)
    assert clean.columns == awkward.columns and clean.count() == sum(not r.contaminated for r in found)
    cut = decontaminate.decontaminate(awkward, bench, remove="spans")
    assert cut.count() == awkward.count()
    for _, t in texts_of(cut.filter("doc_id = 11")):
        assert WORD.findall(t) == []
    assert decontaminate.decontaminate(awkward, bench.filter("false")).count() == awkward.count()


# 4 ---------------------------------------------------------------------------
def repeats_plainly(docs, n):
    first = {}
    for i, t in docs:
        w = (t or "").split() if t and t.isascii() else re.findall("[^\x20\x09-\x0d]+", t or "")
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, np.inf), np.inf if i is None else i)
    out = []
    for i, t in docs:
        w, gone = re.findall("[^\x20\x09-\x0d]+", t or ""), set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (np.inf if i is None else i):
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [50, 5])
def test_repeats(awkward, nothing, n):
    found = substrings.remove_repeats(awkward, threshold=n, shard_windows=64, slice_words=500)
    digest = F.coalesce(F.sha2("kept", 256), "words_sha256")
    assert sorted(rows_of(found, "doc_id", "n_words", "n_removed", digest), key=str) == repeats_plainly(texts_of(awkward), n)
    for r in found.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert substrings.remove_repeats(nothing).count() == 0


def test_automaton_against_sets():
    rng = np.random.default_rng(3)
    passages = [(d, [b"%d" % x for x in rng.integers(0, 3, 60)]) for d in range(1, 8)]
    automaton = substrings.SuffixAutomaton()
    for d, words in passages:
        automaton.add(words, d)
    for doc in (3, 9):
        query = [b"%d" % x for x in rng.integers(0, 3, 80)]
        seen = {tuple(w[k : k + 6]) for d, w in passages if d < doc for k in range(55)}
        assert automaton.repeats(query, doc, 6) == [k for k in range(75) if tuple(query[k : k + 6]) in seen]


# 5 ---------------------------------------------------------------------------
def test_bpe(awkward, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    coded = bpe.encode(awkward, decoded=True)
    for r in coded.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want, r.doc_id
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(nothing).count() == 0
    again = bpe.decode(coded.drop("decoded"))
    assert sorted(rows_of(again, "decoded")) == sorted(rows_of(coded, "decoded"))


# 6 ---------------------------------------------------------------------------
def test_quality(spark, awkward, nothing):
    good = [(k, f"a plain sentence number {k} about quiet rivers and small towns, with calm words.", "s1", "en") for k in range(60)]
    bad = [(100 + k, f"buy*** now### {k}%%% cheap$$$ deals&&& click***", "s2", "en") for k in range(60)]
    docs = spark.createDataFrame([*good, *bad, (900, None, "s1", None), (901, "", None, "en"), (902, "a plain sentence about quiet towns.", "s3", "en"), (903, "buy*** cheap$$$ now###", "s3", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(100 + k, 0, 1) for k in range(60)] + [(None, 1, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(found) == 124
    assert all(found[k].keep for k in range(60)) and not any(found[100 + k].keep for k in range(60))
    assert found[902].keep and not found[903].keep
    everywhere = sum(r.host == "s1" for r in found.values())
    assert everywhere == 61 and found[902].host_posterior < found[0].host_posterior
    # a sparse host lies between its own mean and the global one
    assert found[100].host_posterior < found[902].host_posterior < found[0].host_posterior
    assert quality.classify(docs, labels.filter("false")).count() == 124
    assert quality.classify(docs.filter("false"), labels).count() == 0
    assert quality.classify(awkward.withColumn("source", F.lit(None)), labels).count() == awkward.count()


# 7 ---------------------------------------------------------------------------
def test_line_templates(spark, awkward, nothing):
    body = lambda k: f"story {chr(97 + k)}{chr(97 + k)} of one place\n{chr(97 + k) * 3} went home {chr(97 + k) * 2} then"
    docs = [(k, f"{body(k)}\nposted on 2026-0{k}-11 by user{k} at noon\n\nAll rights reserved.") for k in range(1, 6)]
    copies = [(20 + k, "same text in all copies of this page\nwith a last line here") for k in range(6)]
    df = spark.createDataFrame([*docs, *copies, (90, None), (91, ""), (None, "All rights reserved.\nmine alone, a line")], "doc_id long, text string")
    found = {r.doc_id: r for r in line_templates.dedup_lines(df, counts=True).collect()}
    for k in range(1, 6):
        assert found[k].text == f"{body(k)}\n" and found[k].n_dropped == 2 and found[k].n_lines == 4
    assert all(found[20 + k].n_dropped == 0 for k in range(6))
    assert found[90].text is None and found[91].text == "" and found[None].text == "mine alone, a line"
    assert line_templates.dedup_lines(nothing).columns == nothing.columns and line_templates.dedup_lines(nothing).count() == 0
    assert line_templates.dedup_lines(awkward).count() == awkward.count()
    templates = line_templates.recurring_lines(df)[0]
    assert ("posted on <*> by <*> at noon", 5) in rows_of(templates, "template", "kinds")


def test_line_templates_by_classes(spark, awkward, nothing):
    """With classes of near copies: mostly shared pages lose their shared lines, and copies neither make a line recur nor stop one."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    line = lambda n=10: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line() for _ in range(10)]
    pages = [(k, "\n".join([*shared, line(), line()])) for k in range(30)]
    notice = "All rights are with the owner of this page"
    body, near, near_rows = "\n".join(line(40) for _ in range(4)), [line(40) for _ in range(6)], []
    different = [(100 + k, f"{line()}\n{notice}\n{line()}") for k in range(8)]
    copies = [(200 + k, f"{body}\n{notice}") for k in range(20)]
    for k in range(8):
        words = near[k % 6].split()
        words[k] = f"changed{k}"
        near_rows.append((300 + k, "\n".join([*near[: k % 6], " ".join(words), *near[k % 6 + 1 :]])))
    df = spark.createDataFrame([*pages, *different, *copies, *near_rows], "doc_id long, text string")
    found = {r.doc_id: r for r in line_templates.dedup_lines(df, counts=True, classes=True).collect()}
    assert all(found[k].n_dropped == 10 and not set(shared) & set(found[k].text.split("\n")) for k, _ in pages)
    assert all(found[k].n_dropped == 1 and notice not in found[k].text for k, _ in [*different, *copies])
    assert all(found[k].n_dropped == 0 for k, _ in near_rows)
    assert line_templates.dedup_lines(nothing, classes=True).count() == 0
    assert line_templates.dedup_lines(awkward, classes=True).count() == awkward.count()


# 8 ---------------------------------------------------------------------------
def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 1200
    pages = [(1, "http://a.example.com/x?q=1#f", big), (2, "https://A.example.com:443/x?q=1", big), (3, "http://b.example.org", "short"), (4, "http://b.example.org", "short"), (5, None, None), (6, "not a url\n", big), (7, "http://[bad", "\r\n\r\nWARC/1.1"), (3, "http://b.example.org", "short")]
    df = spark.createDataFrame([(*p, 9) for p in pages], "page_id long, url string, html string, kind int")
    index = warc.archive(df, f"{tmp_path}/w")
    found = sorted(rows_of(warc.resolve_revisits(warc.read_records(index.captures(spark)), index), "page_id", "kind", "refers_to", "payload_bytes", "payload_digest"), key=str)
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        again = html == big and page != 6
        want.append((str(page), "revisit" if again else "response", "6" if again else None, len(data), hashlib.sha1(data).hexdigest()))
    assert found == sorted(want, key=str)
    assert sorted(c["page_id"] for c in index.lookup("http://a.example.com/x?q=1")) == ["1", "2"]
    assert [r.payload.decode() for r in index.fetch("http://b.example.org/")] == ["short"] * 3
    assert index.lookup("http://nowhere.example") == []
    empty = warc.archive(df.filter("false"), f"{tmp_path}/e")
    assert empty.blocks == [] and empty.lookup("http://x") == [] and empty.captures(spark).count() == 0


def test_warc_blocks(spark, tmp_path):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".example.com/p"), (F.col("id") % 50).cast("string")).alias("url"), F.lit("x").alias("html"))
    index = warc.build_index(warc.write_archives(pages, f"{tmp_path}/w"), f"{tmp_path}/w", block_lines=13)
    assert len(index.blocks) >= 500 // 13
    for k in (0, 123, 499):
        url = f"http://h{k % 7}.example.com/p{k % 50}"
        assert sorted(int(c["page_id"]) for c in index.lookup(url)) == [i for i in range(500) if (i % 7, i % 50) == (k % 7, k % 50)]
    assert index.captures(spark).count() == 500


# 9 ---------------------------------------------------------------------------
def test_fingerprints(awkward, nothing):
    found = fingerprints.compare_neighbours(awkward).collect()
    assert len(found) == awkward.count()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, r)
    text = {i: t or "" for i, t in texts_of(awkward)}
    order = [14, 13, 12, 11, 10, 9, 8, 7, 6, 5]
    for a, b in itertools.pairwise(order):
        half = len(text[a]) // 2
        new = text[a][: len(text[a]) - half] + text[b][:half]
        assert by[a].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= by[a].near_edited <= 1 and 0 <= by[a].near_next <= 1
    assert by[3].fingerprint == by[4].fingerprint and by[7].fingerprint == by[8].fingerprint == by[9].fingerprint == ""
    assert by[9].near_next == 1.0 and by[4].n_chars == len(text[4])
    assert fingerprints.compare_neighbours(nothing).count() == 0


def test_sketches_estimate(spark):
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 10**9, 6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    import pyarrow as pa

    x, y, z = fingerprints.sketches(pa.array([a, b, " ".join(words)]), 512)
    assert fingerprints.resemblance(x, y, 512) == pytest.approx(1 / 3, abs=0.08)
    assert fingerprints.containment(x, z, 512) == pytest.approx(1, abs=0.1)
    assert fingerprints.distinct_shingles(z, 512) == pytest.approx(5996, rel=0.15)
    parts = spark.createDataFrame([("s", fingerprints.to_text(x)), ("s", fingerprints.to_text(y))], "site string, fingerprint string")
    merged = fingerprints.merge_fingerprints(parts, "site", k=512).first()
    assert np.array_equal(fingerprints.from_text(merged.fingerprint), fingerprints.merge(x, y, 512))


# 10 --------------------------------------------------------------------------
def simhash_plainly(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_plainly(docs):
    fps = {simhash_plainly(t) for _, t in docs}
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(b)] = find(a)
    ids = {}
    for i, t in docs:
        ids.setdefault(find(simhash_plainly(t)), []).append(i)
    least = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    return sorted(((i, simhash_plainly(t), least[find(simhash_plainly(t))]) for i, t in docs), key=str)


def test_simhash(awkward, nothing):
    found = [(i, fp & (1 << 64) - 1, c) for i, fp, c in rows_of(simhash.find_components(awkward), "doc_id", "fp", "component_id")]
    assert sorted(found, key=str) == components_plainly(texts_of(awkward))
    assert simhash.find_components(nothing).count() == 0
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len({c for _, _, c in found})


def test_simhash_links(spark):
    """Fingerprints at known distances: chains link, three bits apart don't."""
    base = 0x0123456789ABCDEF
    far = base ^ 0x7000000000000001
    values = [base, base ^ 3, base ^ 3 ^ (3 << 40), far, far ^ (1 << 63), 0, 5]
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    with Scratch(spark, "test") as scratch:
        links = {frozenset((a & (1 << 64) - 1, b & (1 << 64) - 1)) for a, b in rows_of(simhash.linked(fps, scratch), "a", "b")}
    joined = {frozenset(p) for p in itertools.combinations(values, 2) if (p[0] ^ p[1]).bit_count() <= 2}
    assert links == joined
