"""Captions whose text grows: one pending caption for each meeting, published when another begins, when it has stood, or at the end.

The rules are in ``Pending``, which the streams and the replays of recordings share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STABLE_SECONDS = 2.0
REVISION_LEAST = 0.6
PUBLISHED = "meeting_id string, speaker string, text string, ts timestamp"
PENDING = "speaker string, text string, since timestamp, changed timestamp"


def comparable(text: str) -> str:
    return " ".join(text.split()).rstrip(".,;:?! ")


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits lead from one text to the other: only the diagonals that near are walked."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        last, left = row[low - 1], i if low == 1 and i <= most else far
        row[low - 1] = left
        for j in range(low, high + 1):
            above = row[j] if j < i + most else far
            left = min(above + 1, left + 1, last + (x != b[j - 1]), far)
            last, row[j] = above, left
        if min(row[low - 1 : high + 1]) > most:
            return False
    return row[len(b)] <= most


def is_revision(before: str, after: str) -> bool:
    """Whether the later text goes on from the earlier one, or is similar enough: edits of at most 0.4 of the longer length."""
    p, c = comparable(before).lower(), comparable(after).lower()
    if not p:
        return False
    if len(c) >= len(p) and c.startswith(p):
        return True
    longest = max(len(p), len(c))
    return bool(c) and edits_within(p, c, int((1 - REVISION_LEAST) * longest + 1e-9))


class Pending:
    """The caption of a meeting that isn't published yet, and what has been published since ``taken``.

    A longer revision by the same speaker takes its place; it keeps the time of its first observation, and
    only the clock of its stability starts again. A shorter form of it is ignored. Anything else publishes it.
    """

    def __init__(self, state: tuple | None = None):
        self.now, self.done = state and tuple(state), []

    def submit(self, speaker: str, text: str, at: pd.Timestamp) -> None:
        if not (text or "").strip():
            return
        if self.now and self.now[0] == speaker:
            if is_revision(self.now[1], text):
                if len(comparable(text)) > len(comparable(self.now[1])):
                    self.now = (speaker, text, self.now[2], at)
                return
            if is_revision(text, self.now[1]):
                return
        self.flush()
        self.now = (speaker, text, at, at)

    def settle(self, at: pd.Timestamp) -> None:
        if self.now and (at - self.now[3]).total_seconds() >= STABLE_SECONDS:
            self.flush()

    def flush(self) -> None:
        if self.now:
            self.done.append(self.now[:3])
        self.now = None

    def taken(self, key: str) -> list[tuple]:
        out, self.done = [(key, *x) for x in self.done], []
        return out


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])


def only_timer(handle: StatefulProcessorHandle, at: pd.Timestamp | None) -> None:
    """The key's one timer is at this time from now on, or off."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if at is not None:
        handle.registerTimer(int(at.timestamp() * 1000))


class RevisionMerger(StatefulProcessor):
    """Observations to published captions. The timer of stability is the meeting's only one; a stop publishes what is pending."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", PENDING)

    def _store(self, pending: Pending) -> None:
        if pending.now:
            self.state.update(pending.now)
        elif self.state.exists():
            self.state.clear()
        only_timer(self.handle, pending.now and pending.now[3] + pd.Timedelta(seconds=STABLE_SECONDS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending = Pending(self.state.get() if self.state.exists() else None)
        for row in pd.concat(list(rows)).sort_values(["ts", "ord"]).itertuples():
            pending.settle(row.ts)
            if row.stopped:
                pending.flush()
            else:
                pending.submit(row.speaker, row.text, row.ts)
        self._store(pending)
        yield frame(pending.taken(key[0]), PUBLISHED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending = Pending(self.state.get() if self.state.exists() else None)
        pending.flush()
        self._store(pending)
        yield frame(pending.taken(key[0]), PUBLISHED)

    def close(self) -> None:
        pass


def merge_revisions(captions: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """captions (meeting_id, ord, ts, speaker, text, stopped) to the published ones, each once, at its longest, with the time it was first seen."""
    return captions.withWatermark("ts", watermark).groupBy("meeting_id").transformWithStateInPandas(
        RevisionMerger(), outputStructType=PUBLISHED, outputMode="append", timeMode="EventTime"
    )


def replayed(rows: DataFrame, order: list[str], begin: Callable[[], object], step: Callable[[object, tuple], None], end: Callable[[object], None], out: str) -> DataFrame:
    """Walks the rows of each meeting in order through an object that has ``taken``, in one pass over sorted partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                if state is None or row.meeting_id != key:
                    if state is not None:
                        end(state)
                        found += state.taken(key)
                    key, state = row.meeting_id, begin()
                step(state, row)
                found += state.taken(key)
            yield frame(found, out)
        if state is not None:
            end(state)
            yield frame(state.taken(key), out)

    return rows.repartition("meeting_id").sortWithinPartitions("meeting_id", *order).mapInPandas(run, out)


def _observe(pending: Pending, row: tuple) -> None:
    pending.settle(row.ts)
    pending.submit(row.speaker, row.text, row.ts)


def replay_captions(observed: DataFrame) -> DataFrame:
    """The published captions of recorded observations (meeting_id, ord, ts, speaker, text): what the stream gives, in batch."""
    return replayed(observed.select("meeting_id", "ord", "ts", "speaker", "text"), ["ts", "ord"], Pending, _observe, Pending.flush, PUBLISHED)
