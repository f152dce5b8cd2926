"""Caption lines that are edited in place, as a stream of mutations.

Stateful operators here and beside are ``transformWithStateInPandas`` processors
on the RocksDB state store; state is bounded by a meeting's open lines. Timers
run in event time, so that a replay gives what the live run gave.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .revisions import frame, only_timer

SETTLE_SECONDS = 1.2
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINE = "author string, text string, ts timestamp, utterance long, superseded boolean"
SPOKEN = "meeting_id string, line_id long, utterance long, author string, text string, ts timestamp, final boolean"


class OpenLines:
    """The lines of one meeting that aren't final yet, and the one time at which those under a newer line settle.

    A line keeps the time it was first seen, and its author where an edit tells none. A new line supersedes all
    others and starts the clock of settling again for them all; another author on a line ends the utterance on it
    and supersedes nothing. Each utterance has a number of its own.
    """

    def __init__(self, lines: dict[int, tuple], due: pd.Timestamp | None, utterances: int, partials: bool):
        self.lines, self.due, self.utterances, self.partials, self.out = lines, due, utterances, partials, []

    def _put(self, line: int, author: str, text: str, at: pd.Timestamp, utterance: int | None, superseded: bool) -> None:
        if utterance is None:
            self.utterances += 1
            utterance = self.utterances
        self.lines[line] = (author, text, at, utterance, superseded)
        if self.partials:
            self.out.append((line, utterance, author, text, at, False))

    def _final(self, line: int) -> None:
        author, text, at, utterance, _ = self.lines.pop(line)
        self.out.append((line, utterance, author, text, at, True))

    def touch(self, line: int, author: str | None, text: str | None, at: pd.Timestamp) -> None:
        text, old = (text or "").strip(), self.lines.get(line)
        author = (author or "").strip() or (old[0] if old else "")
        if not text or not author:
            return
        if old and old[0] != author:
            self._final(line)
            self._put(line, author, text, at, None, False)
        elif old:
            self._put(line, author, text, old[2], old[3], old[4])
        else:
            self.lines = {k: (*v[:4], True) for k, v in self.lines.items()}
            if self.lines:
                self.due = at + pd.Timedelta(seconds=SETTLE_SECONDS)
            self._put(line, author, text, at, None, False)

    def remove(self, line: int) -> None:
        if line in self.lines:
            self._final(line)

    def settle(self, at: pd.Timestamp) -> None:
        if self.due is not None and at >= self.due:
            self.due = None
            for line in [k for k, v in self.lines.items() if v[4]]:
                self._final(line)

    def stop(self) -> None:
        self.due = None
        for line in list(self.lines):
            self._final(line)


class LineFinalizer(StatefulProcessor):
    """Lines are final when removed, when another author takes them, when they have settled under a newer one, or at the stop."""

    def __init__(self, partials: bool):
        self.partials = partials

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "line_id long", LINE)
        self.clock = handle.getValueState("clock", "due timestamp, utterances long")

    def _load(self) -> OpenLines:
        self.before = {k[0]: tuple(v) for k, v in self.lines.iterator()}
        due, utterances = self.clock.get() if self.clock.exists() else (None, 0)
        return OpenLines(dict(self.before), None if pd.isna(due) else due, utterances, self.partials)

    def _store(self, state: OpenLines) -> None:
        for line in self.before.keys() - state.lines.keys():
            self.lines.removeKey((line,))
        for line, value in state.lines.items():
            if self.before.get(line) != value:
                self.lines.updateValue((line,), value)
        self.clock.update((state.due, state.utterances))
        only_timer(self.handle, state.due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            state.settle(row.ts)
            if row.stopped:
                state.stop()
            elif row.removed:
                state.remove(row.line_id)
            else:
                state.touch(row.line_id, row.author, row.text, row.ts)
        self._store(state)
        yield frame([(key[0], *x) for x in state.out], SPOKEN)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        if state.due is not None and state.due.timestamp() * 1000 <= expiredTimerInfo.getExpiryTimeInMs() + 1:
            state.settle(state.due)
        self._store(state)
        yield frame([(key[0], *x) for x in state.out], SPOKEN)

    def close(self) -> None:
        pass


def finalize_lines(mutations: DataFrame, watermark: str = "10 seconds", partials: bool = False) -> DataFrame:
    """mutations (meeting_id, ts, line_id, author, text, removed, stopped) to final captions; with ``partials`` each edit too, for a live view."""
    return mutations.withWatermark("ts", watermark).groupBy("meeting_id").transformWithStateInPandas(
        LineFinalizer(partials), outputStructType=SPOKEN, outputMode="append", timeMode="EventTime"
    )


def dedupe_batches(batches: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each (meeting, seq) once, within the watermark; state older than it is dropped."""
    return batches.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["meeting_id", "seq"])
