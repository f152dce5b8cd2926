"""Snapshots of a caption view, polled: what is new in each, which of it is captions, and which texts are part of the screen.

A poll is one row (meeting_id, poll, ts, shown, stopped): ``shown`` is an array
of (speaker, text) in order, empty where the view shows none. The first poll that
shows any only seeds the comparison, and a poll without any leaves it as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .revisions import PENDING, PUBLISHED, Pending, frame, only_timer, replayed

BASELINE_SECONDS, PERSISTENCE_SECONDS = 3.0, 15.0
#: A meeting without a stop is forgotten after so long without polls.
IDLE = pd.Timedelta(hours=1)
SHOWN = "array<struct<speaker:string,text:string>>"
NEW_LINES = "meeting_id string, poll long, ts timestamp, pos int, speaker string, text string"


def pairs(shown: object) -> list[tuple[str, str]]:
    return [] if shown is None else [(x["speaker"], x["text"]) for x in shown]


class Watch:
    """What a watcher of one meeting knows: the last snapshot that showed captions, and the pending caption."""

    def __init__(self, before: list[tuple[str, str]] | None = None, pending: Pending | None = None, every: float = 0.0):
        self.before, self.pending, self.every, self.next = before, pending or Pending(), every, None

    def fresh(self, shown: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
        """Captions (place, speaker, text) that the last snapshot didn't show."""
        if not shown:
            return []
        known = None if self.before is None else set(self.before)
        self.before = shown
        return [] if known is None else [(k, *x) for k, x in enumerate(shown) if x not in known]

    def poll(self, at: pd.Timestamp, shown: list[tuple[str, str]], stopped: bool = False) -> None:
        """New captions are submitted, then what is pending is published if it has stood; a stop publishes it anyway."""
        if self.next is not None and at < self.next and not stopped:
            return
        self.next = at + pd.Timedelta(seconds=self.every)
        for _, speaker, text in self.fresh(shown):
            self.pending.submit(speaker, text, at)
        self.pending.settle(at)
        if stopped:
            self.stop()

    def stop(self) -> None:
        self.pending.flush()
        self.before = None

    def taken(self, key: str) -> list[tuple]:
        return self.pending.taken(key)


class _Polls(StatefulProcessor):
    """Common to what follows polls: the last snapshot in state, forgotten at a stop or after an idle hour."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"shown {SHOWN}")

    def _watch(self) -> Watch:
        return Watch(pairs(self.last.get()[0]) if self.last.exists() else None)

    def _store(self, watch: Watch, at: pd.Timestamp | None) -> None:
        if watch.before is not None:
            self.last.update(([{"speaker": s, "text": t} for s, t in watch.before],))
        elif self.last.exists():
            self.last.clear()
        only_timer(self.handle, at and at + IDLE)

    def close(self) -> None:
        pass


class SnapshotDifference(_Polls):
    """The lines of each poll that the last one didn't show."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watch, out, at = self._watch(), [], None
        for row in pd.concat(list(rows)).sort_values(["ts", "poll"]).itertuples():
            out += [(key[0], row.poll, row.ts, *x) for x in watch.fresh(pairs(row.shown))]
            at = row.ts
            if row.stopped:
                watch.stop()
                at = None
        self._store(watch, at)
        yield frame(out, NEW_LINES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._store(Watch(), None)
        yield frame([], NEW_LINES)


class ViewWatcher(_Polls):
    """Polls to published captions: differences, revisions and stability in one state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("pending", PENDING)

    def _finish(self, key: tuple, watch: Watch, at: pd.Timestamp | None) -> pd.DataFrame:
        self._store(watch, at)
        if watch.pending.now:
            self.open.update(watch.pending.now)
        elif self.open.exists():
            self.open.clear()
        return frame(watch.taken(key[0]), PUBLISHED)

    def _resume(self) -> Watch:
        watch = self._watch()
        watch.pending = Pending(self.open.get() if self.open.exists() else None)
        return watch

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watch, at = self._resume(), None
        for row in pd.concat(list(rows)).sort_values(["ts", "poll"]).itertuples():
            watch.poll(row.ts, pairs(row.shown), bool(row.stopped))
            at = None if row.stopped else row.ts
        yield self._finish(key, watch, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watch = self._resume()
        watch.stop()
        yield self._finish(key, watch, None)


def _by_meeting(polls: DataFrame, processor: StatefulProcessor, out: str, watermark: str) -> DataFrame:
    return polls.withWatermark("ts", watermark).groupBy("meeting_id").transformWithStateInPandas(processor, outputStructType=out, outputMode="append", timeMode="EventTime")


def new_snapshot_lines(polls: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """meeting_id, poll, ts, pos, speaker, text of each poll's new lines, as a stream."""
    return _by_meeting(polls, SnapshotDifference(), NEW_LINES, watermark)


def watch_captions(polls: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """The published captions of a stream of polls."""
    return _by_meeting(polls, ViewWatcher(), PUBLISHED, watermark)


def replay_views(polls: DataFrame, every: float = 0.0) -> DataFrame:
    """What a watcher publishes of recorded polls (meeting_id, ts, shown), looking at one at most each ``every`` seconds: what sampling loses shows against a denser recording."""
    return replayed(
        polls.select("meeting_id", "ts", "shown"), ["ts"], lambda: Watch(every=every), lambda watch, row: watch.poll(row.ts, pairs(row.shown)), Watch.stop, PUBLISHED
    )


def chunk_form(chunk: Column) -> Column:
    """Trimmed, white space collapsed, lower case: how texts of the screen are compared."""
    return F.lower(F.trim(F.regexp_replace(chunk, r"\s+", " ")))


class ChromeLearner(StatefulProcessor):
    """Texts that belong to the screen: there in the first seconds, or without a break for long; those that look like captions are immune.

    State: when each text that is on screen was first seen, and what has been learned; a text that goes is forgotten.
    """

    def __init__(self, baseline: float, persistence: float):
        self.baseline, self.persistence = baseline, persistence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "ts timestamp")
        self.first = handle.getMapState("first", "chunk string", "ts timestamp")
        self.learned = handle.getMapState("learned", "chunk string", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values(["ts", "poll"])
        start = self.start.get()[0] if self.start.exists() else None
        before = {k[0]: v[0] for k, v in self.first.iterator()}
        known = {k[0] for k, _ in self.learned.iterator()}
        first, out, stopped = dict(before), [], False
        for row in polls.itertuples():
            start = row.ts if start is None else start
            chunks = [(" ".join(x["chunk"].split()).lower(), bool(x["caption_like"])) for x in row.chunks if x["chunk"]]
            present = {c for c, _ in chunks if c}
            immune = {c for c, like in chunks if like}
            found = {c for c, like in chunks if c and not like} if (row.ts - start).total_seconds() < self.baseline else set()
            for c in present - immune:
                if (row.ts - first.setdefault(c, row.ts)).total_seconds() >= self.persistence:
                    found.add(c)
            first = {c: t for c, t in first.items() if c in present}
            out += [(key[0], c, row.ts) for c in sorted(found - known)]
            known |= found
            stopped = bool(row.stopped)
        if stopped:
            self._forget()
        else:
            self.start.update((start,))
            for c in before.keys() - first.keys():
                self.first.removeKey((c,))
            for c, t in first.items():
                if before.get(c) != t:
                    self.first.updateValue((c,), (t,))
            for _, c, t in out:
                self.learned.updateValue((c,), (t,))
            only_timer(self.handle, polls["ts"].iloc[-1] + IDLE)
        yield frame(out, "meeting_id string, chunk string, ts timestamp")

    def _forget(self) -> None:
        for state in (self.start, self.first, self.learned):
            if state.exists():
                state.clear()
        only_timer(self.handle, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        yield frame([], "meeting_id string, chunk string, ts timestamp")

    def close(self) -> None:
        pass


def learn_chrome(polls: DataFrame, baseline: float = BASELINE_SECONDS, persistence: float = PERSISTENCE_SECONDS, watermark: str = "10 seconds") -> DataFrame:
    """meeting_id, chunk, ts of each text when it is learned, once; polls: meeting_id, poll, ts, chunks (array of chunk, caption_like), stopped."""
    return _by_meeting(polls, ChromeLearner(baseline, persistence), "meeting_id string, chunk string, ts timestamp", watermark)


def learned_chrome(polls: DataFrame, baseline: float = BASELINE_SECONDS, persistence: float = PERSISTENCE_SECONDS) -> DataFrame:
    """meeting_id, chunk: the same of a whole recording, by islands of polls; polls: meeting_id, poll (1, 2, ...), t (seconds from the start), chunk, caption_like."""
    shown = polls.select("meeting_id", "poll", "t", chunk_form(F.col("chunk")).alias("chunk"), "caption_like").filter("chunk <> ''")
    each = shown.groupBy("meeting_id", "chunk", "poll").agg(F.min("t").alias("t"), F.bool_or("caption_like").alias("immune"), (~F.bool_and("caption_like")).alias("plain"))
    w = Window.partitionBy("meeting_id", "chunk").orderBy("poll")
    runs = each.withColumn("_run", F.col("poll") - F.row_number().over(w)).groupBy("meeting_id", "chunk", "_run")
    free = F.when(~F.col("immune"), F.col("t"))
    found = runs.agg(F.min(F.when(F.col("plain"), F.col("t"))).alias("plain"), F.min(free).alias("t0"), F.max(free).alias("t1"))
    return found.filter((F.col("plain") < baseline) | (F.col("t1") - F.col("t0") >= persistence)).select("meeting_id", "chunk").distinct()
