"""Streams replayed from files: what they publish equals the batch forms and plain Python, across restarts."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators import analytics, gates
from colloquy.sources import recordings, replay
from colloquy.streaming import capture, captions as streams, revisions, sinks, views

T0 = dt.datetime(2026, 1, 1, 10)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def seconds(ts):
    return round((ts - T0).total_seconds(), 3)


def run(spark, stream, tmp_path, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    query = replay.append_stream(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint", None)
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/{name}")


def record(spark, rows, kind, folder):
    """One file for each row, so that a stream may take them in several batches."""
    for row in rows:
        names = T.StructType.fromDDL(replay.RECORDINGS[kind]).names
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{next(COUNTER):05d}.json", "w") as file:
            file.write(json.dumps({n: x.isoformat() if isinstance(x, dt.datetime) else x for n, x in zip(names, row, strict=False)}) + "\n")


COUNTER = iter(range(10**6))
OBSERVED = [
    ("m", 0, at(0), "Ana", "hola a"), ("m", 1, at(0.7), "Ana", "hola a todos"), ("m", 2, at(1.0), "Ana", "hola a"), ("m", 3, at(1.5), "Luis", "buen día"),
    ("m", 4, at(9.0), "Luis", "otra frase nueva"), ("m", 5, at(9.5), "Luis", "   "), ("z", 6, at(5000), "fin", "fin"),
]
PUBLISHED = [(0, "Ana", "hola a todos"), (1.5, "Luis", "buen día"), (9, "Luis", "otra frase nueva")]


def published(df, meeting="m"):
    return sorted((seconds(r.ts), r.speaker, r.text) for r in df.filter(F.col("meeting_id") == meeting).collect())


# revisions -------------------------------------------------------------------
def test_replay_keeps_the_first_time(spark):
    assert published(revisions.replay_captions(spark.createDataFrame([(*r, None) for r in OBSERVED], replay.RECORDINGS["captions"]))) == PUBLISHED


def test_merge_revisions(spark, tmp_path):
    record(spark, OBSERVED, "captions", f"{tmp_path}/in")
    assert published(run(spark, revisions.merge_revisions(replay.read_recording(spark, "captions", f"{tmp_path}/in")), tmp_path, "out")) == PUBLISHED


def test_a_stop_publishes_what_is_pending(spark, tmp_path):
    rows = [("m", 0, at(0), "Ana", "hola"), ("m", 1, at(1), "Ana", "hola a todos"), ("m", 2, at(1.5), None, None, True)]
    record(spark, rows, "captions", f"{tmp_path}/in")
    assert published(run(spark, revisions.merge_revisions(replay.read_recording(spark, "captions", f"{tmp_path}/in")), tmp_path, "out")) == [(0, "Ana", "hola a todos")]


# lines -----------------------------------------------------------------------
def finals(spark, tmp_path, rows, partials=False):
    record(spark, rows, "mutations", f"{tmp_path}/in")
    out = run(spark, streams.finalize_lines(replay.read_recording(spark, "mutations", f"{tmp_path}/in"), partials=partials), tmp_path, "out")
    return [(r.line_id, r.author, r.text, seconds(r.ts), r.final) for r in out.filter("meeting_id = 'm'").orderBy("utterance", "final", F.length("text")).collect()]


def test_lines_settle_together_and_the_stop_flushes(spark, tmp_path):
    """A new line starts the settling of all older ones again; edits until then count, times are the first ones, and the last line isn't lost."""
    rows = [
        ("m", at(0), 1, "Ana", "one"), ("m", at(1), 2, "Luis", "two"), ("m", at(2), 3, "Ana", "three"), ("m", at(2.6), 1, "Ana", "one more"), ("m", at(2.8), 2, "Luis", "two and a half"),
        ("m", at(3), 3, None, "three b"), ("m", at(4), None, None, None, False, True), ("z", at(5000), 9, "fin", "fin"),
    ]
    assert finals(spark, tmp_path, rows) == [(1, "Ana", "one more", 0, True), (2, "Luis", "two and a half", 1, True), (3, "Ana", "three b", 2, True)]


def test_lines_recycled_removed_and_without_author(spark, tmp_path):
    rows = [
        ("m", at(0), 1, "Ana", "hola"), ("m", at(0.5), 1, "Ana", " hola a todos "), ("m", at(0.6), 3, "", "sin autor"), ("m", at(0.8), 1, "Luis", "sí"), ("m", at(4), 1, "Luis", "sí, claro"),
        ("m", at(5), 2, "Ana", "  "), ("m", at(6), 1, None, None, True), ("m", at(7), 1, None, None, True),
    ]
    assert finals(spark, tmp_path, rows) == [(1, "Ana", "hola a todos", 0, True), (1, "Luis", "sí, claro", 0.8, True)]


def test_partials_mirror_each_edit(spark, tmp_path):
    rows = [("m", at(0), 1, "Ana", "uno"), ("m", at(1), 1, "Ana", "uno dos"), ("m", at(2), 1, None, None, True)]
    assert finals(spark, tmp_path, rows, partials=True) == [(1, "Ana", "uno", 0, False), (1, "Ana", "uno dos", 0, False), (1, "Ana", "uno dos", 0, True)]


# views -----------------------------------------------------------------------
def polls_of(seed, n=60):
    """A view whose last lines are shown, now and then none; lines grow."""
    rng, lines, out = random.Random(seed), [], []
    for k in range(n):
        if rng.random() < 0.5:
            lines.append((rng.choice(["Ana", "Luis"]), " ".join(rng.choices("uno dos tres cuatro cinco seis".split(), k=3))))
        elif lines:
            lines[-1] = (lines[-1][0], lines[-1][1] + " " + rng.choice("uno dos tres".split()))
        shown = [] if rng.random() < 0.2 else lines[-rng.randrange(1, 4) :]
        out.append((f"m{seed}", k, at(0.75 * k), [{"speaker": s, "text": t} for s, t in shown], False))
    return [*out, (f"m{seed}", n, at(0.75 * n), [], True)]


def plain_watch(polls):
    before, pending, done, fresh = None, None, [], []

    def flush():
        nonlocal pending
        if pending:
            done.append((seconds(pending[2]), pending[0], pending[1]))
        pending = None

    for _, k, ts, shown, stopped in polls:
        shown = [(x["speaker"], x["text"]) for x in shown]
        new = [x for x in shown if before is not None and x not in before]
        before = shown or before
        fresh += [(k, *x) for x in new]
        for speaker, text in new:
            if pending and pending[0] == speaker and revisions.is_revision(pending[1], text):
                if len(revisions.comparable(text)) > len(revisions.comparable(pending[1])):
                    pending = (speaker, text, pending[2], ts)
            elif not (pending and pending[0] == speaker and revisions.is_revision(text, pending[1])):
                flush()
                pending = (speaker, text, ts, ts)
        if pending and (ts - pending[3]).total_seconds() >= 2:
            flush()
        if stopped:
            flush()
    return fresh, done


def test_views_over_three_restarts(spark, tmp_path):
    recorded = {seed: polls_of(seed) for seed in (1, 2)}
    watched = lines = None
    for part in range(3):
        for polls in recorded.values():
            third = len(polls) // 3 + 1
            record(spark, polls[part * third : (part + 1) * third], "views", f"{tmp_path}/in")
        lines = run(spark, views.new_snapshot_lines(replay.read_recording(spark, "views", f"{tmp_path}/in")), tmp_path, "lines")
        watched = run(spark, views.watch_captions(replay.read_recording(spark, "views", f"{tmp_path}/in")), tmp_path, "watched")
    for seed, polls in recorded.items():
        fresh, done = plain_watch(polls)
        assert published(watched, f"m{seed}") == sorted(done) and len(done) > 3
        assert sorted((r.poll, r.speaker, r.text) for r in lines.filter(F.col("meeting_id") == f"m{seed}").collect()) == sorted(fresh)
    batch = spark.createDataFrame([p for polls in recorded.values() for p in polls], replay.RECORDINGS["views"])
    assert published(views.replay_views(batch), "m1") == sorted(plain_watch(recorded[1])[1])


def test_sampling_loses_what_is_shown_between_polls(spark):
    """750 ms sampling, seeding, revision and settling of a dense recording."""
    shown = [
        (0, []), (100, [("Ana", "never polled")]), (800, [("Ana", "seed")]), (900, [("Ana", "seed"), ("Ana", "skipped by sampling")]), (1600, [("Ana", "seed"), ("Luis", "buen")]),
        (2400, [("Ana", "seed"), ("Luis", "buen dia a todos")]), (3200, []), (4500, [("Luis", "buen dia a todos")]), (5300, [("Luis", "otra cosa muy distinta"), ("Ana", "fin")]),
    ]
    df = spark.createDataFrame([("m", at(t / 1000), s) for t, s in shown] + [("n", at(0), [("x", "only seed")])], "meeting_id string, ts timestamp, shown array<struct<speaker:string,text:string>>")
    assert published(views.replay_views(df, 0.75)) == [(1.6, "Luis", "buen dia a todos"), (5.3, "Ana", "fin"), (5.3, "Luis", "otra cosa muy distinta")]
    assert ("Ana", "skipped by sampling") in [x[1:] for x in published(views.replay_views(df))]


def screens(n=30):
    """Texts by poll each second: in the baseline, just after it, for 15 s, broken after 10, like a caption, and spelled otherwise."""
    for k in range(n):
        chunks = [("Toolbar", False), ("Ana: hola", True)]
        chunks += [("  Late  ONE", False)] if 3 <= k < 17 else []
        chunks += [("Stays long", False), ("STAYS   long", False)] if 5 <= k < 21 else []
        chunks += [("breaks", False)] if 4 <= k < 14 or 15 <= k < 25 else []
        yield ("m", k + 1, at(k), [{"chunk": c, "caption_like": like} for c, like in chunks], k == n - 1)


def test_chrome_stream_equals_batch(spark, tmp_path):
    record(spark, list(screens()), "screens", f"{tmp_path}/in")
    out = run(spark, views.learn_chrome(replay.read_recording(spark, "screens", f"{tmp_path}/in", 7)), tmp_path, "out")
    assert sorted((r.chunk, seconds(r.ts)) for r in out.collect()) == [("stays long", 20), ("toolbar", 0)]
    rows = spark.createDataFrame(list(screens()), replay.RECORDINGS["screens"]).select("meeting_id", "poll", (F.col("poll") - 1.0).alias("t"), F.inline("chunks"))
    assert sorted(r.chunk for r in views.learned_chrome(rows).collect()) == ["stays long", "toolbar"]


def test_chrome_baseline_is_strict(spark):
    rows = spark.createDataFrame([("m", 1, 0.0, "x", True), ("m", 2, 2.9, "in", False), ("m", 3, 3.0, "out", False)], "meeting_id string, poll long, t double, chunk string, caption_like boolean")
    assert [r.chunk for r in views.learned_chrome(rows).collect()] == ["in"]


# captures --------------------------------------------------------------------
def test_three_reasons_to_end(spark, tmp_path):
    rows = [
        ("said", at(0), "surface"), ("said", at(5), "caption"), ("said", at(100), "caption"), ("said", at(250), "surface"), ("said", at(250), "ring"), ("said", at(251), "read"),
        ("mute", at(0), "surface"), ("mute", at(50), "surface"), ("mute", at(60), "read"), ("over", at(0), "caption"), ("over", at(10), "ended"), ("over", at(11), "ended"),
        ("none", at(0), "ended"), ("none", at(1), "read"), ("again", at(0), "caption"), ("again", at(400), "caption"), ("zz", at(9000), "surface"),
    ]
    record(spark, sorted(rows, key=lambda r: r[1]), "captures", f"{tmp_path}/in")
    stream = capture.finalize_captures(replay.read_recording(spark, "captures", f"{tmp_path}/in", 3))
    out = sorted((r.meeting_id, r.reason, seconds(r.ended_at), r.captions, r.ring_seen, r.reads) for r in run(spark, stream, tmp_path, "out").collect())
    assert out == [
        ("again", "silence", 300, 1, False, 0), ("again", "silence", 700, 1, False, 0), ("mute", "absence", 110, 0, False, 1), ("over", "ended", 10, 1, False, 0), ("said", "silence", 400, 2, True, 1),
    ]


def test_debounce_stream(spark, tmp_path):
    """The changes are those of the batch form, and nobody leaves who hasn't joined."""
    rows = [("m", at(s), p) for s, p in ((0, False), (9, False), (10, True), (12.9, False), (30, True), (33, True), (40, False), (47.9, True), (60, False), (70, False), (71, True), (75, False))] + [("z", at(5000), True)]
    record(spark, rows, "presence", f"{tmp_path}/in")
    out = run(spark, capture.debounce_presence(replay.read_recording(spark, "presence", f"{tmp_path}/in", 4)), tmp_path, "out").filter("meeting_id = 'm'").orderBy("since").collect()
    assert [(seconds(r.since), r.present) for r in out] == [(30, True), (60, False)]


def test_silence_sessions_stream(spark, tmp_path):
    record(spark, [("m", k, at(s), "Ana", "x") for k, s in enumerate((0, 100, 900, 20_000))], "captions", f"{tmp_path}/in")
    stream = capture.silence_sessions(replay.read_recording(spark, "captions", f"{tmp_path}/in"))
    assert sorted(r.captions for r in run(spark, stream, tmp_path, "out").collect()) == [1, 2]


# batches, crashes and sinks --------------------------------------------------
def test_dedupe_batches(spark, tmp_path):
    record(spark, [("m", 1, at(0), []), ("m", 1, at(1), []), ("m", 2, at(2), []), ("n", 1, at(3), [])], "batches", f"{tmp_path}/in")
    stream = streams.dedupe_batches(replay.read_recording(spark, "batches", f"{tmp_path}/in"))
    assert sorted((r.meeting_id, r.seq) for r in run(spark, stream, tmp_path, "out").collect()) == [("m", 1), ("m", 2), ("n", 1)]


class Broken(Exception):
    pass


def segment_batch(meeting, seq, n):
    return (meeting, seq, at(seq), [{"source": "tab", "label": "A", "start_time": 0.0, "end_time": 1.0, "text": f"{meeting}{seq}{k}"} for k in range(n)])


def test_a_stop_in_mid_batch_changes_nothing(spark, tmp_path):
    """The second batch writes, then fails before it is committed; after a restart it runs again with the same number. Resent batches count once."""
    for k in range(6):
        record(spark, [segment_batch("m", k, k + 1), segment_batch("n", k % 3, 2)], "batches", f"{tmp_path}/in")
    target, failures = f"{tmp_path}/out", [1]

    def start():
        stream = streams.dedupe_batches(replay.read_recording(spark, "batches", f"{tmp_path}/in", 3)).select("meeting_id", "seq", F.size("segments").alias("n"))

        def write(batch, number):
            sinks.append_once(batch, number, target)
            if number in failures:
                failures.remove(number)
                raise Broken

        return sinks.each_batch(stream, write, f"{tmp_path}/checkpoint", None)

    with pytest.raises(Exception, match="Broken"):
        start().awaitTermination(120)
    start().awaitTermination(120)
    out = spark.read.parquet(target)
    assert sorted((r.meeting_id, r.seq, r.n) for r in out.collect()) == sorted([("m", k, k + 1) for k in range(6)] + [("n", k, 2) for k in range(3)])
    counters = out.groupBy("meeting_id").agg(F.sum("n").alias("segments"))
    assert {r.meeting_id: r.segments for r in counters.collect()} == {"m": 21, "n": 6}

    # what the crash left: stored batches of captures without an end
    finished = spark.createDataFrame([("n",)], "meeting_id string")
    stream = capture.unfinished(replay.read_recording(spark, "batches", f"{tmp_path}/in"), finished)
    assert {r.meeting_id for r in run(spark, stream.select("meeting_id", "seq"), tmp_path, "orphans").collect()} == {"m"}


def test_upserts_survive_a_stop_between_two_tables(spark, tmp_path):
    record(spark, [segment_batch("m", k, 1) for k in range(4)] + [segment_batch("m", 0, 3)], "batches", f"{tmp_path}/in")
    sizes = sinks.LatestTable(spark, f"{tmp_path}/sizes", ["meeting_id", "seq"], "meeting_id string, seq long, n int")
    last = sinks.LatestTable(spark, f"{tmp_path}/last", ["meeting_id"], "meeting_id string, seq long", order="seq")
    failures = [2]

    def late(batch):
        if failures:
            failures.pop()
            raise Broken
        return batch.select("meeting_id", "seq")

    def start():
        stream = replay.read_recording(spark, "batches", f"{tmp_path}/in", 2)
        write = sinks.upsert_all((sizes, lambda b: b.dropDuplicates(["meeting_id", "seq"]).select("meeting_id", "seq", F.size("segments").alias("n"))), (last, late))
        return sinks.each_batch(stream, write, f"{tmp_path}/checkpoint", None)

    with pytest.raises(Exception, match="Broken"):
        start().awaitTermination(120)
    assert last.rows().count() == 0 and sizes.rows().count() == 2
    start().awaitTermination(120)
    want = [("m", 0, 3), ("m", 1, 1), ("m", 2, 1), ("m", 3, 1)]
    rows = lambda: sorted((r.meeting_id, r.seq, r.n) for r in sizes.rows().collect())
    assert rows() == want and [(r.meeting_id, r.seq) for r in last.rows().collect()] == [("m", 0)]
    for _ in range(2):
        sizes.compact()
        assert rows() == want
    sizes.write(spark.createDataFrame([("m", 1, None, True), ("m", 9, 9, False)], "meeting_id string, seq long, n int, _deleted boolean"), 3)
    sizes.write(spark.createDataFrame([("m", 1, None, True), ("m", 9, 9, False)], "meeting_id string, seq long, n int, _deleted boolean"), 3)
    want = [("m", 0, 3), ("m", 2, 1), ("m", 3, 1), ("m", 9, 9)]
    assert rows() == want
    sizes.compact()
    assert rows() == want and sizes.rows().columns == ["meeting_id", "seq", "n"]


def test_a_base_that_is_not_complete_does_not_count(spark, tmp_path):
    table = sinks.LatestTable(spark, f"{tmp_path}/t", ["k"], "k long, v string")
    assert table.rows().count() == 0
    table.write(spark.createDataFrame([(1, "a")], "k long, v string"), 0)
    os.makedirs(f"{tmp_path}/t/bases/base=7")
    assert [tuple(r) for r in table.rows().collect()] == [(1, "a")]


def test_growing_files_are_read_once(spark, tmp_path):
    """Lines appended to a file, a line that isn't complete yet, and new files, over three restarts; stretches shorter than a line."""
    folder, n = tmp_path / "in", 0
    folder.mkdir()
    text = lambda k: json.dumps({"meeting_id": "m", "ord": k, "ts": at(k).isoformat(), "speaker": "Ana", "text": "é" * k})
    for part in range(3):
        with open(folder / "a.jsonl", "a") as file:
            for _ in range(5):
                file.write(text(n) + "\n")
                n += 1
            if part < 2:
                half = text(n)
                file.write(half[: len(half) // 2])
        out = run(spark, recordings.follow(spark, "captions", str(folder), 40), tmp_path, "out")
        assert sorted(r.ord for r in out.collect()) == list(range(n))
        if part < 2:
            with open(folder / "a.jsonl", "a") as file:
                file.write(half[len(half) // 2 :] + "\n")
            n += 1
        (folder / f"b{part}.jsonl").write_text(text(n) + "\n\n")
        n += 1
    out = run(spark, recordings.follow(spark, "captions", str(folder)), tmp_path, "out")
    assert sorted((r.ord, seconds(r.ts), len(r.text), r.stopped) for r in out.collect()) == [(k, k, k, None) for k in range(n)]


def test_growing_recording_feeds_the_watcher(spark, tmp_path):
    folder, polls = tmp_path / "in", polls_of(3)
    folder.mkdir()
    for part in (polls[:25], polls[25:]):
        with open(folder / "views.jsonl", "a") as file:
            for m, k, ts, shown, stopped in part:
                file.write(json.dumps({"meeting_id": m, "poll": k, "ts": ts.isoformat(), "shown": shown, "stopped": stopped}) + "\n")
        out = run(spark, views.watch_captions(recordings.follow(spark, "views", str(folder))), tmp_path, "out")
    assert published(out, "m3") == sorted(plain_watch(polls)[1])


# rates -----------------------------------------------------------------------
def test_hourly_rates_stream(spark, tmp_path):
    """Windows in update mode, upserted by batch; an hour without points is there and doesn't breach."""
    rng = random.Random(9)
    points = [(at(3600 * h + 60 * k), rng.random() < 0.4, rng.random() < 0.1) for h in (0, 1, 4, 5) for k in range(20)]
    for k in range(0, len(points), 8):
        spark.createDataFrame(points[k : k + 8], "ts timestamp, escalated boolean, needs_review boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "hour timestamp, n long, escalation_rate double, review_rate double, escalation_alarm boolean, review_alarm boolean"
    table = sinks.LatestTable(spark, f"{tmp_path}/rates", ["hour"], schema)
    stream = spark.readStream.schema("ts timestamp, escalated boolean, needs_review boolean").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in").withWatermark("ts", "2 hours")
    sinks.each_batch(gates.fleet_rates(stream), table.write, f"{tmp_path}/checkpoint", None, "update").awaitTermination(120)
    out = sorted(tuple(r) for r in gates.every_hour(table.rows()).select(*[c.split()[0] for c in schema.split(", ")]).collect())
    want = gates.every_hour(gates.fleet_rates(spark.createDataFrame(points, "ts timestamp, escalated boolean, needs_review boolean")))
    assert out == sorted(tuple(r) for r in want.select(*[c.split()[0] for c in schema.split(", ")]).collect())
    assert [r[1] for r in out] == [20, 20, 0, 0, 20, 20] and out[2][2:] == (None, None, False, False)


# the rest --------------------------------------------------------------------
def test_align_and_dictate(spark):
    truth = spark.createDataFrame([("m", 0, 1.0, "Hola a todos"), ("m", 1, 500.0, "nadie lo vio")], "meeting_id string, ord int, t double, text string")
    emitted = spark.createDataFrame([("m", 2.0, "hola a todoz"), ("m", 900.0, "nadie lo vio")], "meeting_id string, t double, text string")
    assert [r.found for r in analytics.align_recall(truth, emitted).orderBy("ord").collect()] == [True, True]
    results = spark.createDataFrame([("s", 1, True, "dos"), ("s", 0, True, "uno"), ("s", 2, False, "tre")], "session_id string, ord int, final boolean, text string")
    assert analytics.dictation_text(results).first().text == "uno dos"
    assert results.select(capture.end_reason(F.lit(False), F.lit(300), F.lit(True), F.lit(0))).first()[0] == "silence"
    polls = spark.range(25).select(F.lit("m").alias("meeting_id"), F.col("id").alias("poll"))
    assert [r.poll for r in replay.every_nth(polls).orderBy("poll").collect()] == [0, 10, 20]


def test_edits_within_equals_the_full_distance():
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 12)))
    for _ in range(3000):
        a, b, most = word(), word(), rng.randrange(0, 9)
        assert revisions.edits_within(a, b, most) == (distance(a, b) <= most), (a, b, most)


def test_a_capture_makes_few_trips_to_the_state():
    """of a key's events the state and its one timer are read and written once, and nothing is given where nothing ended."""
    from pyspark.sql import Row

    calls = []

    class Store:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, row):
            calls.append("update")
            self.held = row

        def clear(self):
            calls.append("clear")
            self.held = None

    class Handle:
        state = Store()

        def getValueState(self, *_):
            return self.state

        def registerTimer(self, ms):
            calls.append(("on", ms))

        def deleteTimer(self, ms):
            calls.append(("off", ms))

    made = capture.CaptureFinalizer()
    made.init(Handle())
    told = lambda *rows: list(made.handleInputRows(("m",), iter([Row(meeting_id="m", ts=None, kind=k, us=s if s is None else s * 1_000_000) for s, k in rows]), None))
    assert told((20, "caption"), (10, "caption"), (None, "caption")) == [] and calls == ["get", "update", ("on", 320_000)]
    calls.clear()
    assert told((30, "read")) == [] and calls == ["get", "update"]
    calls.clear()
    ended = told((320, "caption"), (321, "ended"))
    assert [(r.reason, r.ended_us, r.captions, r.reads) for r in ended] == [("silence", 320_000_000, 2, 1), ("ended", 321_000_000, 1, 0)]
    assert calls == ["get", "clear", ("off", 320_000)]
