"""The life of a capture: presence, silence, why it ends, what its signals were, and captures that a crash left behind."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .revisions import frame

SILENCE = "300 seconds"
SILENCE_SECONDS, ABSENCE_SECONDS = 300, 60
CHANGES = "meeting_id string, since timestamp, present boolean"
ENDED_AT = "meeting_id string, reason string, ended_us long, captions long, ring_seen boolean, reads long, heartbeat_us long"
#: A capture before its first event; times are in microseconds.
FRESH = {"captions": 0, "caption": None, "surface": None, "ring": False, "reads": 0, "heartbeat": None}


class PresenceDebouncer(StatefulProcessor):
    """A meeting's presence by polls. A change is believed at the first poll by which it has held for ``join_after`` or ``leave_after`` seconds; nobody leaves who hasn't joined."""

    def __init__(self, join_after: float, leave_after: float):
        self.needed = {True: join_after, False: leave_after}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "joined boolean, present boolean, since timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        joined, present, since = tuple(self.state.get()) if self.state.exists() else (False, None, None)
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            if present is None or row.present != present:
                present, since = bool(row.present), row.ts
            if present != joined and (row.ts - since).total_seconds() >= self.needed[present]:
                joined = present
                out.append((key[0], since, present))
        self.state.update((joined, present, since))
        yield frame(out, CHANGES)

    def close(self) -> None:
        pass


def debounce_presence(readings: DataFrame, join_after: float = 3.0, leave_after: float = 8.0, watermark: str = "10 seconds") -> DataFrame:
    """readings (meeting_id, ts, present) to the changes that lasted (meeting_id, since, present)."""
    return readings.withWatermark("ts", watermark).groupBy("meeting_id").transformWithStateInPandas(
        PresenceDebouncer(join_after, leave_after), outputStructType=CHANGES, outputMode="append", timeMode="EventTime"
    )


def silence_sessions(captions: DataFrame, gap: str = SILENCE, watermark: str | None = "1 hour", keys: tuple[str, ...] = ("meeting_id",)) -> DataFrame:
    """keys, since, until, captions: runs of captions without a silence as long as the gap; batch and stream alike."""
    rows = captions.withWatermark("ts", watermark) if watermark and captions.isStreaming else captions
    found = rows.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("captions"))
    return found.select(*keys, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "captions")


def end_reason(ended: Column, silent_seconds: Column, ever_captioned: Column, absent_seconds: Column) -> Column:
    """Why a capture is over: 'ended', 'silence' (300 s), 'absence' (60 s and never captioned), or null."""
    return F.when(ended, "ended").when(ever_captioned & (silent_seconds >= SILENCE_SECONDS), "silence").when(~ever_captioned & (absent_seconds >= ABSENCE_SECONDS), "absence")


def signal_health(events: DataFrame, keys: tuple[str, ...] = ("meeting_id",)) -> DataFrame:
    """Running state of a capture's signals from events (kind caption, ring or read; ts)."""
    return events.groupBy(*keys).agg(
        F.bool_or(F.col("kind") == "caption").alias("captions_seen"), F.bool_or(F.col("kind") == "ring").alias("ring_seen"),
        F.count_if(F.col("kind") == "read").alias("reads"), F.max("ts").alias("last_heartbeat"),
    )


class CaptureFinalizer(StatefulProcessor):
    """Ends a capture by the first of two clocks, or by a marker, and gives its signals then.

    Each caption sets the clock of silence; while there was none, each sight of the meeting sets the clock of
    absence, which the first caption switches off for good. A marker counts once there was any activity.
    A row after the end begins a new capture of the same meeting.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("capture", "captions long, caption long, surface long, ring boolean, reads long, heartbeat long")

    @staticmethod
    def _due(now: dict) -> tuple[int | None, str]:
        if now["caption"] is not None:
            return now["caption"] + SILENCE_SECONDS * 1_000_000, "silence"
        return (None if now["surface"] is None else now["surface"] + ABSENCE_SECONDS * 1_000_000), "absence"

    @staticmethod
    def _row(key: tuple, now: dict, reason: str, at: int) -> Row:
        return Row(meeting_id=key[0], reason=reason, ended_us=at, captions=now["captions"], ring_seen=now["ring"], reads=now["reads"], heartbeat_us=now["heartbeat"])

    def _load(self) -> dict | None:
        found = self.state.get()
        return found and dict(zip(FRESH, found, strict=True))

    def _store(self, before: dict | None, now: dict) -> None:
        """Each call on the handle is a trip to the JVM: the one timer is known from the state, and only what has changed is told."""
        old, due = before and self._due(before)[0], self._due(now)[0]
        if now != (before or FRESH):
            self.state.update(tuple(now.values())) if now != FRESH else self.state.clear()
        if old != due:
            if old is not None:
                self.handle.deleteTimer(old // 1000)
            if due is not None:
                self.handle.registerTimer(due // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self._load()
        now = dict(before or FRESH)
        for row in sorted((r for r in rows if r.us is not None), key=lambda r: r.us):
            due, reason = self._due(now)
            if due is not None and row.us >= due:
                yield self._row(key, now, reason, due)
                now = dict(FRESH)
            if row.kind == "ended":
                if now["caption"] is not None or now["surface"] is not None:
                    yield self._row(key, now, "ended", row.us)
                    now = dict(FRESH)
                continue
            if row.kind == "surface":
                now["surface"] = row.us
                continue
            now["heartbeat"] = row.us
            if row.kind == "caption":
                now["captions"], now["caption"] = now["captions"] + 1, row.us
            elif row.kind == "ring":
                now["ring"] = True
            elif row.kind == "read":
                now["reads"] += 1
        self._store(before, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self._load()
        due, reason = self._due(now) if now else (None, "")
        if now:
            self.state.clear()
        if due is not None:
            yield self._row(key, now, reason, due)

    def close(self) -> None:
        pass


def finalize_captures(events: DataFrame, watermark: str = "30 seconds") -> DataFrame:
    """events (meeting_id, ts, kind: caption, surface, ring, read or ended) to ended captures with their reason and signals. Events without a time tell nothing."""
    rows = events.withWatermark("ts", watermark).select("meeting_id", "ts", "kind", F.unix_micros("ts").alias("us"))
    found = rows.groupBy("meeting_id").transformWithState(CaptureFinalizer(), outputStructType=ENDED_AT, outputMode="append", timeMode="EventTime")
    times = {"ended_us": F.timestamp_micros("ended_us").alias("ended_at"), "heartbeat_us": F.timestamp_micros("heartbeat_us").alias("last_heartbeat")}
    return found.select(*(times.get(c, F.col(c)) for c in found.columns))


def unfinished(segments: DataFrame, finished: DataFrame) -> DataFrame:
    """Stored rows of captures that no end was recorded for: what is left to recover after a crash. segments may be a stream; finished is a table by meeting_id."""
    return segments.join(finished.select("meeting_id"), "meeting_id", "left_anti")
