"""Cases of the conversation operators with known answers."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.functions import models
from colloquy.functions import text as tx
from colloquy.functions import values as v
from colloquy.operators import analytics, captions, chunking, citations, gates, grounding, intervals, merging, search, speakers, transcripts
from colloquy.sources import tables

TIMELINE = [("m", 0, 0.0, "Juan"), ("m", 1, 10.0, "María"), ("m", 2, 20.0, "Juan"), ("m", 3, 30.0, "María")]
SEG = "meeting_id string, ord int, source string, label string, start_time double, end_time double, text string, confidence double"
CAP = "meeting_id string, ord int, t double, speaker_name string, text string, final boolean"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def segments(spark, *rows):
    return spark.createDataFrame([("m", k, *r) for k, r in enumerate(rows)], SEG)


def readings(spark, rows=TIMELINE):
    return spark.createDataFrame(rows, "meeting_id string, ord int, t double, name string")


def caps(spark, *rows):
    return spark.createDataFrame([("m", k, *r) for k, r in enumerate(rows)], CAP)


def correlated(spark, segs, cap_rows=(), timeline=TIMELINE):
    out = speakers.correlate(segs, readings(spark, list(timeline)), caps(spark, *cap_rows) if cap_rows else caps(spark, (0.0, "x", "", False)), "me")
    return {r.seg_id: r for r in out.collect()}, speakers.correlation_scores(out).first()


def test_global_vote(spark):
    segs = segments(spark, ("tab", "spk_0", 0.0, 7.0, "a", 0.9), ("tab", "spk_0", 10.0, 12.0, "b", 0.9), ("tab", "spk_9", 100.0, 110.0, "c", 0.9), ("mic", "spk_0", 2.0, 5.0, "d", None))
    found = {r.ord: (r.speaker, r.resolved) for r in speakers.global_vote(segs, readings(spark), "me").collect()}
    assert found == {0: ("Juan", True), 1: ("Juan", True), 2: ("spk_9", False), 3: ("me", True)}


def test_anchor_beats_readings(spark):
    segs = segments(spark, ("tab", "spk_0", 11.0, 14.0, "vamos a revisar el presupuesto anual", 0.8))
    cap_rows = [(11.0, "María", "Vamos a revisar el presupuesto anual", True), (11.5, "Pedro", "otra cosa muy distinta ahora", True), (12.0, "Ana", "vamos a revisar el presupuesto anual", False)]
    found, scores = correlated(spark, segs, cap_rows, [("m", 0, 10.0, "Juan"), ("m", 1, 20.0, "x")])
    assert (found["s0"].speaker, found["s0"].label_source, found["s0"].agrees) == ("María", "caption", False)
    assert found["s0"].speaker_confidence >= 0.5 and scores.caption_agreement_pct == 0


def test_recycled_label(spark):
    segs = segments(spark, ("tab", "spk_0", 10.0, 25.0, "uno", 0.9), ("tab", "spk_0", 150.0, 160.0, "dos", 0.9))
    found, _ = correlated(spark, segs, (), [("m", 0, 0.0, "Juan"), ("m", 1, 100.0, "María"), ("m", 2, 200.0, "María")])
    assert (found["s0"].speaker, found["s1"].speaker) == ("Juan", "María")


def test_scores_without_anchor(spark):
    segs = segments(spark, ("tab", "spk_0", 1.0, 8.0, "uno", 0.9), ("tab", "spk_9", 500.0, 510.0, "dos", 0.9))
    found, scores = correlated(spark, segs)
    assert found["s0"].resolved and not found["s1"].resolved
    assert scores.unresolved_pct == 50 and scores.caption_agreement_pct is None


def test_sentinel_and_ties(spark):
    segs = segments(spark, ("tab", "spk_0", 1.0, 4.0, "misma frase para todos", 0.9))
    found, _ = correlated(spark, segs, [(2.0, "Unknown", "misma frase para todos", True)])
    assert found["s0"].label_source == "timeline"
    found, scores = correlated(spark, segs, [(2.0, "Juan", "misma frase para todos", True), (3.0, "Pedro", "misma frase para todos", True)])
    assert found["s0"].speaker == "Juan" and found["s0"].label_margin == 0 and scores.label_margin_min == 0


def test_caption_segments_keep_their_names(spark):
    segs = segments(spark, ("caption", "Ana", 1.0, 4.0, "hola a todos hoy", None), ("mic", "x", 5.0, 6.0, "sí", None))
    found, scores = correlated(spark, segs, [(2.0, "Pedro", "hola a todos hoy", True)])
    assert (found["s0"].speaker, found["s1"].speaker) == ("Ana", "me") and scores.caption_agreement_pct is None


def test_containment(spark):
    r = one(
        spark,
        accents=tx.quote_exists(F.lit("REUNIÓN, ayer"), F.lit("la reunion ayer fue larga")),
        inserted=tx.quote_exists(F.lit("el presupuesto sube veinte"), F.lit("dijo que el presupuesto sube un veinte por ciento")),
        absent=tx.quote_exists(F.lit("algo muy distinto"), F.lit("el presupuesto sube")),
        inside=tx.containment(F.lit("ok"), F.lit("el broker")),
        empty=tx.containment(F.lit(""), F.lit("x")),
        both=tx.overlap_score(F.lit("sube un veinte por ciento"), F.lit("un veinte")),
    )
    assert (r.accents, r.inserted, r.absent, r.inside, r.empty, r.both) == (True, True, False, 0, 0, 1)


def test_containment_forms_agree(spark):
    import random

    rng = random.Random(2)
    rows = [([rng.choice("abcd") for _ in range(rng.randrange(0, 9))], [rng.choice("abcd") for _ in range(rng.randrange(0, 15))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "n array<string>, h array<string>")
    assert df.filter(F.abs(tx.containment_of_tokens(F.col("n"), F.col("h")) - tx.sliding_containment("n", "h")) > 1e-9).count() == 0


def test_find_quotes(spark):
    turns = spark.createDataFrame([("m", 1, "nada que ver"), ("m", 2, "vamos a cerrar el lunes próximo"), ("m", 3, "vamos a cerrar el lunes próximo")], "meeting_id string, ord long, text string")
    quotes = spark.createDataFrame([("m", 0, "cerrar el lunes"), ("m", 1, "no está"), ("m", 2, "")], "meeting_id string, quote_id int, quote string")
    assert [tuple(r) for r in grounding.find_quotes(quotes, turns).collect()] == [("m", 0, 2, 1.0)]


def test_numbers_and_negations(spark):
    r = one(spark, same=tx.audit(F.lit("1.500 pesos"), F.lit("1500 pesos")), flip=tx.audit(F.lit("jamás pagan 3,5"), F.lit("pagan 4")))
    assert list(map(list, r.same)) == [[], [], []]
    assert list(map(list, r.flip)) == [["35"], ["4"], ["jamas"]]


def test_merge_bounds(spark):
    stream = segments(spark, ("tab", "a", 0.0, 5.0, "uno", 0.5), ("tab", "b", 5.0, 10.0, "dos", 0.5), ("mic", "c", 0.0, 9.0, "tres", 0.5), ("tab", "d", 30.0, 31.0, "cuatro", None))
    batch = spark.createDataFrame([("m", 0, 4.0, 6.0, "X", 0.9), ("m", 1, 10.0, 10.5, "Y", 0.7), ("m", 2, 33.0, 34.0, "Z", 0.7), ("m", 3, 32.5, 34.0, "W", 0.7)], "meeting_id string, ord int, start_time double, end_time double, text string, confidence double")
    found = {r.ord: (r.text, r.provenance) for r in merging.merge_transcripts(stream, batch).collect()}
    assert found == {0: ("X", "batch"), 1: ("Y", "batch"), 2: ("tres", "streaming"), 3: ("W", "batch")}


def test_word_segments(spark):
    items = [("m", 0, "punctuation", None, None, ".", None), ("m", 1, "p", 0.0, 0.3, "hola", 0.9), ("m", 2, "punctuation", None, None, ",", None), ("m", 3, "p", 1.1, 1.2, "que", 0.7), ("m", 4, "p", 2.01, 2.2, "tal", 0.5), ("m", 5, "punctuation", None, None, "?", None), ("m", 6, "p", 2.3, 2.4, "bien", None)]
    df = spark.createDataFrame(items, "meeting_id string, ord int, type string, start_time double, end_time double, content string, confidence double")
    out = merging.segments_of_words(merging.words_of_items(df)).orderBy("ord").collect()
    assert [r.text for r in out] == ["hola, que", "tal?", "bien"]
    many = spark.createDataFrame([("m", k, k * 0.5, k * 0.5 + 0.4, "w", 1.0) for k in range(45)], "meeting_id string, ord int, start_time double, end_time double, text string, confidence double")
    assert [len(r.text.split()) for r in merging.segments_of_words(many).orderBy("ord").collect()] == [20, 20, 5]


def test_as_of(spark):
    turns = spark.createDataFrame([("m", 1, 5.0), ("m", 2, 5.0), ("m", 3, 200.0)], "meeting_id string, o int, s double")
    taps = spark.createDataFrame([("m", 4.9), ("m", 5.0), ("m", 199.0), ("m", 1000.0)], "meeting_id string, t double")
    for width in (None, 50.0):
        out = intervals.as_of(taps, turns, ["meeting_id"], "t", "s", "o", ["o"], width).collect()
        assert {r.t: r.match and r.match.o for r in out} == {4.9: None, 5.0: 2, 199.0: 2, 1000.0: 3}


def test_clean_transcript(spark):
    segs = spark.createDataFrame([("m", k, f"s{k}", "A", k * 1.0, k + 1.0, f"t{k} no") for k in range(4)], "meeting_id string, ord int, seg_id string, speaker string, start_time double, end_time double, text string")
    draft = spark.createDataFrame([("m", 0, ["s2", "s0"], "B", "x"), ("m", 1, ["s0", "s9"], "C", "y"), ("m", 2, ["s1"], "D", "t1 no")], "meeting_id string, turn_ix int, source_ids array<string>, speaker string, text string")
    turns = transcripts.build_clean(draft, segs)
    assert [(r.id, list(r.source_ids), list(r.tags)) for r in turns.orderBy("ord").collect()] == [("T1", ["s2", "s0"], []), ("T2", ["s1"], []), ("T3", ["s3"], ["raw-fallback"])]
    fixed = transcripts.ground_violations(transcripts.audit_turns(turns, segs)).orderBy("ord").collect()
    assert fixed[0].text == "t2 no t0 no" and list(fixed[0].tags) == ["raw-grounded"] and fixed[1].text == "t1 no"


def test_p10_and_gates(spark):
    for n in (1, 10, 11, 30, 31):
        values = [k / n for k in range(n)]
        segs = segments(spark, *(("tab", "x", 0.0, 1.0, "t", c) for c in values))
        assert gates.asr_scores(segs).first().p10_confidence == pytest.approx(sorted(values)[int(0.1 * (n - 1))])
    none = segments(spark, ("tab", "x", 0.0, 1.0, "t", None))
    assert tuple(gates.asr_scores(none).first()) == ("m", 0.0, 0.0)
    assert gates.asr_scores(segments(spark, ("caption", "x", 0.0, 1.0, "t", 0.3))).count() == 0
    lit = F.lit
    r = one(
        spark,
        a1=gates.gate_a(lit(15.0), lit(0.3), lit(None).cast("double")), a2=gates.gate_a(lit(15.1), lit(0.3), lit(None).cast("double")), a3=gates.gate_a(lit(0.0), lit(1.0), lit(79.9)),
        e1=gates.gate_e(lit(1), lit(0), lit(0.1), lit(0), lit("haiku")), e2=gates.gate_e(lit(1), lit(0), lit(0.1), lit(1), lit("haiku")),
        e3=gates.gate_e(lit(1), lit(1), lit(0.1), lit(1), lit("sonnet")), e4=gates.gate_e(lit(5), lit(0), lit(0.5), lit(2), lit("opus")), e5=gates.gate_e(lit(0), lit(0), lit(0.0), lit(0), lit("haiku")),
    )
    assert (r.a1.fired, r.a2.reason, r.a3.reason) == (False, "unresolved", "agreement")
    assert [tuple(x) for x in (r.e1, r.e2, r.e3, r.e4, r.e5)] == [("repair", None), ("publish", None), ("synthesize", "opus"), ("publish", None), ("publish", None)]


def test_windows():
    assert chunking.window_bounds([300, 300, 300]) == [(0, 2), (1, 3)]
    assert chunking.window_bounds([900, 900, 900]) == [(0, 1), (1, 2), (2, 3)]
    assert chunking.window_bounds([250, 240, 300]) == [(0, 2), (1, 3)]
    assert chunking.window_bounds([]) == []


def test_search_filter(spark):
    rows = spark.createDataFrame([("a", "note", "u1", 0), ("b", "note", "u2", 5), ("c", "chapter", None, 9)], "key string, type string, owner_sub string, date_epoch long")
    keys = lambda f: sorted(r.key for r in rows.filter(f).collect())
    assert keys(search.search_filter("u1")) == ["a", "c"] and keys(search.search_filter("u1", [])) == ["a", "c"]
    assert keys(search.search_filter("u1", None, 0, 0)) == ["a"] and keys(search.search_filter("u2", ["note"], 1)) == ["b"]
    assert keys(search.compiled({"$and": [{"$or": [{"type": {"$ne": "note"}}, {"owner_sub": "u1"}]}, {"date_epoch": {"$gte": 0, "$lte": 8}}]})) == ["a"]


def test_citations(spark):
    answers = spark.createDataFrame([("q", "See [M:a:b:T2] and [M:x]  or [N:n1] [N:zz] [bad] [M:a:b:T2] [M:18:48 x]")], "answer_id string, text string")
    hits = spark.createDataFrame([("q", 1, "chapter", "a:b", None, "Title", 86400), ("q", 2, "note", None, "n1", None, None), ("q", 3, "chapter", "zz", None, "Z", 0), ("q", 4, "chapter", "18:48 x", None, "C", 0)], "answer_id string, rank int, type string, meeting_id string, note_id string, title string, date_epoch long")
    cleaned, cited = citations.resolve_citations(answers, hits)
    assert cleaned.first().text == "See [M:a:b:T2] and or [N:n1] [bad] [M:a:b:T2] [M:18:48 x]"
    assert [(r.ref, r.turn, r.title, r.date, r.url) for r in cited.orderBy("n").collect()] == [("M:a:b:T2", "T2", "Title", "1970-01-02", "/meeting?id=a%3Ab&turn=T2"), ("N:n1", None, "", "", "/notes?id=n1"), ("M:18:48 x", None, "C", "", "/meeting?id=18%3A48%20x")]


def test_ids(spark):
    r = one(spark, a=v.id_time(F.lit(0)), b=v.id_time(F.lit(32**9)), c=v.id_time(F.lit(35)), s=tx.slug(F.lit("¡Reunión Ñandú #3!")), e=tx.slug(F.lit("***")))
    assert (r.a, r.b, r.c, r.s, r.e) == ("0" * 10, "1" + "0" * 9, "0000000013", "reunion-nandu-3", "reunion")


def test_captions(spark):
    r = one(
        spark, n1=captions.is_notice(F.lit("Ana JOINED the meeting")), n2=captions.is_notice(F.lit("cuando me uní ayer alguien dijo que otra persona joined the call muy tarde ya")), n3=captions.is_notice(F.lit(" ")),
        l1=captions.is_roster_label(F.lit("PÉREZ JUAN")), l2=captions.is_roster_label(F.lit("AWS GCP")), l3=captions.is_roster_label(F.lit("HOLA, JUAN")), t=captions.clean_title(F.lit("(3) Chat | Plan 2026 | App")),
    )
    assert (r.n1, r.n2, r.n3, r.l1, r.l2, r.l3) == (True, False, True, True, False, False)


def test_tables(spark):
    t = spark.createDataFrame([(k, f"v{k}") for k in range(10)], "id int, v string")
    first = tables.page(t, ["id"], 4).collect()
    assert [r.id for r in first] == [9, 8, 7, 6]
    assert [r.id for r in tables.page(t, ["id"], 4, [6]).collect()] == [5, 4, 3, 2]
    decoded = spark.createDataFrame([(first[-1].cursor,)], "c string").select(v.cursor_parts(F.col("c"))).first()[0]
    assert decoded == ["6"]
    state, winners = tables.put_if_absent(t, spark.createDataFrame([(3, "late"), (50, "b"), (50, "a")], "id int, v string"), ["id"], ["v"])
    assert {r.id: r.v for r in state.collect()}[50] == "a" and {r.v for r in winners.collect()} == {"v3", "a"}


def test_talk_time(spark):
    turns = spark.createDataFrame([("m", 0, "A", 0.0, 8.0, "x y"), ("m", 1, "B", 8.0, 7.0, "x"), ("m", 2, "C", 9.0, None, "a b c d e")], "meeting_id string, ord int, speaker string, start_time double, end_time double, text string")
    out = {r.speaker: r for r in analytics.talk_time(turns).collect()}
    assert (out["A"].seconds, out["B"].seconds, out["C"].seconds) == (8.0, 0.0, 2.0)
    assert out["A"].dominant and out["A"].pct == 80 and not out["C"].dominant


def test_debounce(spark):
    rows = [("m", t, s) for t, s in ((0.0, False), (10.0, True), (12.9, False), (30.0, True), (33.0, True), (40.0, False), (47.9, True), (60.0, False), (70.0, False))]
    df = spark.createDataFrame(rows, "k string, t double, s boolean")
    out = [(r.since, r.state) for r in intervals.debounced(df, ["k"], "t", "s", 3.0, 8.0).orderBy("since").collect()]
    assert out == [(30.0, True), (60.0, False)]


def test_models(spark):
    import json

    rows = spark.createDataFrame([("ok",), ("fix",), ("bad",)], "prompt string")

    def model(prompt, fault):
        verdict = "SUPPORTED" if prompt == "ok" or (prompt == "fix" and fault) else "MAYBE"
        return json.dumps({"claims": [{"claim": prompt, "verdict": verdict, "quote": "q"}]})

    out = {r.prompt: r for r in models.call(rows, "verify", model).collect()}
    assert out["ok"].error is None and out["fix"].result.claims[0].verdict == "SUPPORTED"
    assert out["bad"].result is None and "verdict" in out["bad"].error
    assert models.invalid("summarise", {"text": "no anchor"}) and models.invalid("summarise", {"text": "x [T9]"}, {"T1"})


def test_silence_batch(spark):
    from colloquy.streaming import capture as streams

    t0 = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("m", t0 + dt.timedelta(seconds=s)) for s in (0, 299, 700)], "meeting_id string, ts timestamp")
    assert sorted(r.captions for r in streams.silence_sessions(df).collect()) == [1, 2]


def test_top_k_join_of_many_queries(spark):
    """More queries than a block holds: all get their nearest rows, as in one block."""
    vectors = spark.range(90).select(F.col("id").alias("key"), F.array(F.cos("id"), F.sin("id"), F.lit(0.5)).alias("embedding"))
    queries = vectors.select(F.col("key").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(tuple(r) for r in search.top_k_join(vectors, queries, 3).collect())
    blocks = sorted(tuple(r) for r in search.top_k_join(vectors, queries, 3, most_queries=40).collect())
    assert blocks == whole and len(whole) == 270
    assert [q for q, rank, key, _ in blocks if rank == 1 and q == key] == list(range(90))


def test_forms_that_are_easily_wrong(spark):
    """Cases in which a near miss of the rule gives another answer."""
    lit = F.lit
    r = one(
        spark, d1=v.duration(lit(59.6)), d2=v.duration(lit(89.7)), d3=v.duration(lit(59.4)), r=v.renamed(F.array(lit("a"), lit("b")), lit("a"), lit("b")), s=tx.slug(lit("x" * 59 + " yz")), e0=v.epoch_date(lit(0)),
        c1=tx.clean_name(lit("Ana Paz \u00b7 Guest")), c2=tx.clean_name(lit("Ana (Sales) (Unverified), muted")), c3=tx.clean_name(lit("Ana is speaking | x")), n1=tx.normalize(lit("\u0439\u03ac \u00c9")),
        t1=captions.clean_title(lit("Weekly | Budget review")), t2=captions.clean_title(lit("(2) Weekly | Microsoft Teams")), t3=captions.clean_title(lit("Calendar | Microsoft Teams")),
        g=analytics.note_guard(lit("x"), lit("voice")), k=F.to_json(tx.references(lit("[M:a b:c:T3] [N:q:T3] [M:] [M:a b:c:T3]"))),
    )
    assert (r.d1, r.d2, r.d3, list(r.r), r.s, r.e0) == ("1 min", "2 min", "59 s", ["b", "b"], "x" * 59 + "-", None)
    assert (r.c1, r.c2, r.c3, r.n1) == ("Ana Paz", "Ana (Sales)", "Ana", "\u0438\u03b1 e")
    assert (r.t1, r.t2, r.t3, r.g) == ("Weekly | Budget review", "Weekly", None, "ok")
    assert r.k == '[{"ref":"M:a b:c:T3","kind":"M","id":"a b:c","turn":"T3"},{"ref":"N:q:T3","kind":"N","id":"q:T3","turn":""}]'


def test_every_malformed_answer_is_refused():
    bad = (None, 1, "x", [], {}, {"text": None}, {"text": " "}, {"claims": None}, {"claims": []}, {"claims": ["x"]}, {"claims": [{"claim": 3, "verdict": "PARTIAL"}]}, {"claims": [{"claim": "a", "verdict": "AMBIGUOUS"}]},
           {"title": 3, "text": "x"}, {"turns": ["x"]}, {"turns": []}, {"turns": [{"sourceIds": [1], "speaker": "a", "text": "b"}]}, {"answer": 5}, {"query": 3})
    for name in models.CONTRACTS:
        for data in bad:
            if name == "extract" and isinstance(data, dict):
                continue  # all fields of this one may be missing
            assert models.invalid(name, data), (name, data)
    assert models.invalid("extract", {"decisions": [{"text": "a"}]}) and models.invalid("extract", {"participants": [1]})
    assert models.invalid("verify", {"claims": [{"claim": "a", "verdict": "UNCERTAIN"}]}) is None
    assert models.invalid("plan", {"searchQuery": "a"}) == "$.timeIsExplicit: not a boolean" and models.invalid("plan", {"searchQuery": "a", "timeIsExplicit": True, "fromEpoch": "x"})
    assert models.invalid("memory", {"answer_md": " "}) and models.invalid("clean_note", {"title": " ", "cleanText": "x"}) and models.invalid("clean_note", {"title": "a", "cleanText": " "})


def test_answers_are_brought_to_their_contract():
    made = models.checked("verify", {"claims": [{"claim": "a", "verdict": "PARTIAL", "turnId": "T1", "critical": True}, {"claim": "b", "verdict": "PARTIAL", "quote": "", "critical": 1}]})
    assert made["claims"] == [{"claim": "a", "verdict": "PARTIAL", "quote": None, "turnId": "T1", "critical": True}, {"claim": "b", "verdict": "PARTIAL", "quote": None, "turnId": None, "critical": False}]
    made = models.checked("extract", {"actionItems": [{"text": "a", "verbatimQuote": "b", "turnId": "T1", "inferred": True, "done": "yes", "owner": ""}]})
    assert made["actionItems"][0] == {"text": "a", "verbatimQuote": "b", "turnId": "T1", "inferred": True, "done": False, "owner": None, "due": None} and made["decisions"] == []
    assert models.checked("plan", {"searchQuery": "a", "timeIsExplicit": False, "fromEpoch": 1.5, "targetTypes": []})["fromEpoch"] == 1.5
    given = {"title": " " + "é" * 59 + "😀x ", "cleanText": " y "}
    assert models.checked("clean_note", given) == {"title": "é" * 59 + "\ufffd", "cleanText": " y "} and given["title"].endswith("x ")


def test_writes_keep_what_they_do_not_replace(spark, tmp_path):
    rows = lambda ids, x: spark.createDataFrame([("t", m, x) for m in ids], "tenant_id string, meeting_id string, x int")
    tables.write_artifact(rows(["m1", "m2"], 1), f"{tmp_path}/a", "notes")
    tables.write_artifact(rows(["m2", "m3"], 2), f"{tmp_path}/a", "notes")
    found = tables.read_artifact(spark, f"{tmp_path}/a", "notes", "x int, tenant_id string, meeting_id string").collect()
    assert sorted((r.meeting_id, r.x) for r in found) == [("m1", 1), ("m2", 2), ("m3", 2)]
    vectors = lambda keys, x: spark.createDataFrame([("t", 1, k, x) for k in keys], "tenant_id string, index_version int, key string, x int")
    for keys, x in ((["a", "b"], 1), (["b", "c"], 2)):
        tables.write_vectors(vectors(keys, x), f"{tmp_path}/v")
    assert sorted((r.key, r.x) for r in spark.read.parquet(f"{tmp_path}/v").collect()) == [("a", 1), ("b", 2), ("c", 2)]
    captions_ = spark.createDataFrame([("m", 0, dt.datetime(2026, 1, 1, 9, 8, 7), "Ana", "hola")], "meeting_id string, ord int, at timestamp, speaker string, text string")
    for _ in range(2):
        tables.append_transcript(captions_, f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t/text").collect()] == ["[09:08:07] Ana: hola"] * 2
    tables.write_archive(spark.createDataFrame([("b.txt", "two"), ("a.txt", "one")], "name string, content string"), f"{tmp_path}/x.zip")
    import zipfile

    with zipfile.ZipFile(f"{tmp_path}/x.zip") as archive:
        assert archive.namelist() == ["a.txt", "b.txt"] and archive.read("b.txt") == b"two" and archive.testzip() is None


def test_recall_alignment_is_exact(spark):
    """Against every emitted line by plain Python, whatever its time."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    said = [" ".join(rng.choice("uno dos tres cuatro cinco seis".split()) for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    shown = [" ".join(w for w in s.split() if rng.random() < 0.7).upper() + "." for s in said[::2]]
    truth = spark.createDataFrame([("m", k, s) for k, s in enumerate(said)], "meeting_id string, ord int, text string")
    emitted = spark.createDataFrame([("m", s) for s in shown], "meeting_id string, text string")
    form = lambda s: " ".join(s.split()).rstrip(".,;:?! ").lower()
    for r in analytics.align_recall(truth, emitted).collect():
        best = max(SequenceMatcher(None, form(r.text), form(s), autojunk=False).ratio() for s in shown)
        assert r.found == (best >= 0.6) and r.best == pytest.approx(best if best >= 0.6 else 0.0)


def test_matching_ratio_is_difflibs():
    """Block by block against difflib; unrelated long texts end early."""
    import random
    import time
    from difflib import SequenceMatcher

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("thaneiorsé\U0001f600") for _ in range(rng.randrange(1, 8)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    texts += [" ".join(w for w in t.split() if rng.random() < 0.8) for t in texts[:30]] + ["", "a", "aaaaaaa", "abababab"]
    for p, q in [(rng.choice(texts), rng.choice(texts)) for _ in range(400)] + [(t, t[3:]) for t in texts]:
        told = SequenceMatcher(None, p, q, autojunk=False).ratio()
        assert models._matching_ratio(p, q, 0.0) == told
        assert models._matching_ratio(p, q, 0.6) == (told if told >= 0.6 else 0.0)
    long = [" ".join(word() for _ in range(200)) for _ in range(2)]
    t0 = time.perf_counter()
    SequenceMatcher(None, *long, autojunk=False).ratio()
    t1 = time.perf_counter()
    models._matching_ratio(*long, 0.6)
    assert time.perf_counter() - t1 < (t1 - t0) / 3


def test_edits_and_revisions_of_long_texts(spark):
    """Distances against the plain table, with and without a bound; a very long line takes seconds at most."""
    import random
    import time

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(5)
    for _ in range(200):
        a = "".join(rng.choice("abcdé\U0001f600 ") for _ in range(rng.randrange(0, 150)))
        b = "".join(c for c in a if rng.random() < 0.7) if rng.random() < 0.5 else "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 150)))
        d, most = distance(a, b), rng.randrange(0, 120)
        assert tx._edits(a, b) == d and tx._edits(a, b, most) == min(d, most + 1)
    pairs = [("hola a todos", "hola a todos los que"), ("abc", "xyz"), ("", "a"), (None, "a"), ("abcde", "abcxx"), ("abcde", "abcde")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.r for r in df.select(tx.is_revision("a", "b").alias("r")).collect()] == [True, False, False, None, True, True]
    long = "".join(rng.choice("thaneiors ") for _ in range(12_000))
    t = time.perf_counter()
    tx._edits(long, long[::-1])
    assert time.perf_counter() - t < 5


def test_edits_of_many_pairs(monkeypatch):
    """Pairs that go through the table together have the distances of the plain table, whatever their lengths, bounds, groups and looks; together they take far less time."""
    import random
    import time

    from colloquy.functions import distances

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(11)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pairs = []
    for _ in range(300):
        letters = rng.choice(["ab", "abcdé\U0001f600 ", "a", "thequickbrownfx "])
        a = text(letters, rng.choice([0, 1, 7, 8, 9, 63, 64, 65, 130, 180]))
        near = "".join(c for c in a if rng.random() < 0.8) + text(letters, 3)
        pairs.append((a, rng.choice([a, a[::-1], near, a[20:] + a[:20], text(letters, rng.randrange(0, 180))])))
    a, b = zip(*pairs)
    plain = [distance(x, y) for x, y in pairs]
    most = [rng.choice([0, d, max(0, d - 1), d + 1, int(0.4 * max(len(x), len(y))) + 1, rng.randrange(0, 200)]) for (x, y), d in zip(pairs, plain)]
    for size, look in ((1, 16), (64, 1), (32_768, 16), (32_768, 5)):
        monkeypatch.setattr(distances, "COLUMN_BYTES", size)
        monkeypatch.setattr(distances, "LOOK", look)
        assert distances.edits_of(a, b).tolist() == plain
        assert distances.edits_of(a, b, most).tolist() == [min(d, k + 1) for d, k in zip(plain, most)]
    monkeypatch.undo()
    lines = [text("thaneiors ", 400) for _ in range(1500)]
    t0 = time.perf_counter()
    together = distances.edits_of(lines, [x[::-1] for x in lines], [161] * len(lines))
    t1 = time.perf_counter()
    assert [distances.edits(x, x[::-1], 161) for x in lines[:300]] == together[:300].tolist()
    assert t1 - t0 < time.perf_counter() - t1


def test_revision_makes_forms_once(spark):
    """White space is collapsed as one regular expression does, and a query makes each form once and deals lines over all tasks, also those of one file."""
    from colloquy.plans import texts

    rows = spark.createDataFrame([(f"{c}a{c}{c}b {c} d{c}?{c}.",) for c in map(chr, (*range(1, 0x2100), 0x3000, 0xFEFF, 0x1F600))] + [(None,), ("",), (" . ",)], "t string")
    former = F.rtrim(tx.strip(F.regexp_replace("t", r"(?U)\s+", " ")), F.lit(".,;:?! "))
    assert rows.filter(~tx.comparable("t").eqNullSafe(former)).count() == 0
    out = texts.revision(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 4 and "RepartitionByExpression [doc_id" in plan


def test_embeddings_are_made_in_pieces(spark):
    """A batch of many rows gives batches of few vectors; rows, columns and nulls stay."""
    rows = spark.range(1000).repartition(1).selectExpr("id", "CASE WHEN id % 7 <> 0 THEN concat('t', id) END AS text")
    made = models.embed(rows)
    found = {r.id: (r.text, r.embedding) for r in made.collect()}
    assert len(found) == 1000
    for k in (0, 255, 256, 999):
        text = None if k % 7 == 0 else f"t{k}"
        assert found[k][0] == text and found[k][1] == pytest.approx(models.hash_embedding(text or "").tolist())
    batch = pa.RecordBatch.from_pydict({"text": ["t"] * 1000})
    assert max(b.num_rows for b in models._with_vectors(iter([batch]), 0, models.hash_embedding)) <= models.EMBED_ROWS


def test_answers_are_parsed_once(monkeypatch):
    """A call copies no answer; checked() leaves what it is given as it is."""
    import json

    parsed, loads = [], json.loads
    monkeypatch.setattr(models.json, "loads", lambda text: parsed.append(text) or loads(text))
    assert models._called(lambda prompt, fault: '{"answer_md": "yes"}', "memory", "p", None) == ('{"answer_md": "yes", "citations": []}', None)
    assert len(parsed) == 1
    given = {"answer_md": "yes"}
    assert models.checked("memory", given)["citations"] == [] and given == {"answer_md": "yes"}


def test_losses_compare_each_line_once(spark):
    """Tables of lines that hold one another share their comparisons."""
    said = "uno dos tres cuatro cinco"
    truth = spark.createDataFrame([("m", 0, said), ("m", 1, "nada de esto 77")], "meeting_id string, ord int, text string")
    lines = spark.createDataFrame([("m", said[:-2]), ("m", "otra cosa")], "meeting_id string, text string")
    found = analytics.attribute_losses(truth, lines, [lines, lines, lines])
    assert {r.ord: r.stage for r in found.collect()} == {0: "MATCHED", 1: "SOURCE"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_folding_of_other_scripts(spark):
    """Marks beyond U+036F leave a blank, compatibility ideographs become plain ones, Hangul stays whole."""
    cases = {"がんばる": "か んは る", "Ñandú ÀÉ": "nandu ae", "\uf900 x": "\u8c48 x", "क़लम": "क लम", "한국": "한국", "plain ASCII!": "plain ascii", "ё": "е"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", tx.normalize("t").alias("n")).collect()} == cases


def test_names_in_spanish_order(spark):
    df = spark.createDataFrame([(["Ñandu", "Nube", "Nzogi", "ana", "Ána", "Nube"],)], "participants array<string>")
    assert [r.name for r in analytics.participants(df).collect()] == ["ana", "Ána", "Nube", "Nzogi", "Ñandu"]


def test_losses_go_to_the_first_stage_without_the_line(spark):
    from difflib import SequenceMatcher

    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 6)))
    truth = [("m", k, " ".join(word() for _ in range(rng.randrange(1, 6))) + rng.choice(["", ".", " ?"])) for k in range(60)] + [("m", 60, ""), ("n", 0, "alone here")]
    changed = lambda t: t if rng.random() < 0.4 else t[:-1] + word()
    pools = [[(m, changed(t)) for m, _, t in truth if rng.random() < 0.8] for _ in range(4)]
    form = lambda t: " ".join(t.split()).rstrip(".,;:?! ").lower()

    def plain(m, text, pool):
        return max((SequenceMatcher(None, form(text), form(p), autojunk=False).ratio() for k, p in pool if k == m and form(p) and form(text)), default=0.0) >= 0.6

    want = {}
    for m, k, t in truth:
        emitted, *stages = (plain(m, t, p) for p in pools)
        want[m, k] = "MATCHED" if emitted else next((n for n, seen in zip(analytics.LOSSES, stages) if not seen), "PIPELINE")
    frame = lambda rows: spark.createDataFrame(rows, "meeting_id string, text string")
    found = analytics.attribute_losses(spark.createDataFrame(truth, "meeting_id string, ord int, text string"), frame(pools[0]), [frame(p) for p in pools[1:]])
    assert {(r.meeting_id, r.ord): r.stage for r in found.collect()} == want and len(set(want.values())) == 5
    assert sum(r.lines for r in analytics.loss_report(found).collect()) == len(truth)


def test_a_write_of_vectors_that_stopped_is_finished(spark, tmp_path):
    """The copy was complete, the table lost its partition: the next write brings it back before it adds its own."""
    import shutil

    rows = lambda *r: spark.createDataFrame(list(r), "tenant_id string, index_version int, key string, x int")
    path = f"{tmp_path}/vectors"
    tables.write_vectors(rows(("t", 1, "a", 1), ("t", 1, "b", 1), ("u", 1, "c", 1)), path)
    rows(("t", 1, "a", 1), ("t", 1, "b", 2)).write.partitionBy("tenant_id", "index_version").parquet(f"{path}.next")
    shutil.rmtree(f"{path}/tenant_id=t")
    tables.write_vectors(rows(("u", 1, "d", 3)), path)
    found = sorted((r.tenant_id, r.key, r.x) for r in spark.read.parquet(path).collect())
    assert found == [("t", "a", 1), ("t", "b", 2), ("u", "c", 1), ("u", "d", 3)]


def test_items_are_sorted_in_parts_that_do_not_grow(spark, monkeypatch):
    """Ten times the items are dealt over ten times the tasks, and the cut after every 20 words stays."""
    monkeypatch.setattr(merging, "ITEMS_PER_TASK", 100)
    rows = [(m, k, "pronunciation", k * 0.4, k * 0.4 + 0.3, f"w{k}", 0.5) for m in range(100) for k in range(45)]
    items = spark.createDataFrame(rows, "meeting_id long, ord long, type string, start_time double, end_time double, content string, confidence double")
    words = merging.words_of_items(items)
    assert words.rdd.getNumPartitions() == 45 and words.count() == 4500
    assert sorted(len(r.text.split()) for r in merging.segments_of_words(words).collect()) == [5] * 100 + [20] * 200


def test_every_letter_folds_alike(spark):
    """the set of letters with other marks is parted by range, and no letter is lost or added by that."""
    import unicodedata

    def plain(c):
        found = unicodedata.normalize("NFD", c)
        if found == c or 0xAC00 <= ord(c) < 0xD7A4 or unicodedata.category(c)[0] not in "LN":
            return "" if 0x300 <= ord(c) < 0x370 else c
        return found[0] + " " * any(not 0x300 <= ord(m) < 0x370 for m in found[1:])

    df = spark.createDataFrame([(i, chr(i)) for i in range(0xC0, 0x30000) if not 0xD800 <= i < 0xE000], "id long, c string")
    found = df.select("id", tx.fold("c").alias("f")).toPandas()
    assert all(f == plain(chr(i)) for i, f in zip(found["id"], found["f"], strict=True))
    blanked = tx._folding()[2]
    assert blanked.startswith("[\u0622-") and max(len(part) for part in blanked.split("&&")) < 60  # one set of all was tried member by member


def test_quotes_meet_turns_in_one_pass(spark):
    """few quotes go to the turns, whose tokens are made once; turns that lack a fifth of the tokens aren't slid over."""
    turns = spark.createDataFrame([("m", k, f"alpha{k % 7} beta{k % 5} gamma{k % 3} delta omega kappa sigma") for k in range(200)], "meeting_id string, ord long, text string")
    quotes = spark.createDataFrame([("m", 0, "alpha3 beta4 gamma0 delta omega"), ("m", 1, "omega omega omega kappa"), ("m", 2, "delta omega kappa sigma nowhere")], "meeting_id string, quote_id int, quote string")
    found = grounding.find_quotes(quotes, turns)
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 3
    pairs = quotes.join(turns, "meeting_id").select("quote_id", "ord", tx.containment("quote", "text").alias("score")).filter("score >= 0.8")
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (-r.score, r.ord)):
        want.setdefault(r.quote_id, (r.ord, r.score))
    assert {r.quote_id: (r.turn_ord, r.score) for r in found.collect()} == want and set(want) == {0, 2}
