"""Packing of token sequences by minimum bin slack.

A document's tokens, with an end token, are cut into full windows as far as
they go; what remains of it goes to the task's pool, a multiset of remaining
lengths. A window begins with the longest remaining piece. Which others join it
is found by subset-sum dynamic programming over the counts of the lengths: a
bitset holds the sums that can be reached, each length enters with its count
split into powers of two, and the steps are traced back from the sum nearest to
the room that is left, which gives how many pieces of each length to take. Where
no sum fills the window, the longest piece that is left is cut to fill it, so
all windows are full while the pool lasts. The tail of a task, less than one
window, is cut into sequences of powers of two, which need no padding.

A task packs its own rows: nothing is shuffled. Its memory is bounded by the
pool (``pool`` pieces below the capacity) and one text. Ids of sequences are
made of the task's number and a count in the task; the rows are written, so that
a task that runs again can't deal pieces anew under the eyes of a reader.

Defined results: a null or empty text has the end token only; repeated rows and
null keys are documents of their own; special tokens of the file found in a text
become their id, as the tokenizer does it. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_symbols
from .common import release, written

CAPACITY, END = 2048, 1
#: Pieces that a task holds before it packs; it packs until half of them are left.
POOL = 4096
#: Rows of one output batch.
ROWS = 1 << 12


class ByteBpe:
    """A byte-level BPE of a tokenizer file, in the form that the tiktoken library takes; built once in a worker."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, byte = spec["model"], {c: b for b, c in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if token not in self.special}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or made != sorted(made):
            raise ValueError("only a byte-level BPE with ids in the order of its merges is supported")
        self._encoding = None

    def __getstate__(self) -> dict:
        return {"special": self.special, "ranks": self.ranks, "_encoding": None}

    def encode(self, text: str) -> np.ndarray:
        if self._encoding is None:
            import tiktoken

            #: Fixed value: the pattern by which such a pre-tokenizer cuts.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self._encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=self.special)
        return self._encoding.encode_to_numpy(text, allowed_special="all")


def best_counts(room: int, lengths: list[int], count) -> dict[int, int]:
    """How many pieces of each length fill the room best; ``lengths`` ascend, ``count`` gives how many there are of one."""
    mask, sums, steps = (1 << room + 1) - 1, 1, []
    for length in reversed(lengths[: bisect_right(lengths, room)]):
        left, times = min(count(length), room // length), 1
        while left:
            take = min(times, left)
            steps.append((length, take, sums))
            sums |= (sums << length * take) & mask
            left -= take
            times *= 2
        if sums >> room & 1:
            break
    best, chosen = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= length * take
    return chosen


class Packer:
    """The pool of one task: pieces (key, start, ids, tokens of the document) by length, and the rows made of them."""

    def __init__(self, task: int, capacity: int, end: int, pool: int, ids: bool):
        self.capacity, self.end, self.most, self.ids = capacity, end, pool, ids
        self.pieces: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []
        self.held, self.sequence = 0, task << 32
        self.rows: list[tuple] = []

    def add(self, key: object, ids: np.ndarray) -> None:
        ids = np.append(ids, ids.dtype.type(self.end))
        n, start = len(ids), 0
        while n - start >= self.capacity:
            self._emit([(key, start, ids[start : start + self.capacity], n)])
            start += self.capacity
        if start < n:
            # a copy, so that a long document doesn't stay in memory for its end
            self._put((key, start, ids[start:].copy() if start else ids, n))
        if self.held >= self.most:
            self.pack(self.most // 2)

    def _put(self, piece: tuple) -> None:
        length = len(piece[2])
        if length not in self.pieces:
            insort(self.lengths, length)
            self.pieces[length] = []
        self.pieces[length].append(piece)
        self.held += 1

    def _take(self, length: int) -> tuple:
        found = self.pieces[length]
        piece = found.pop()
        if not found:
            del self.pieces[length], self.lengths[bisect_left(self.lengths, length)]
        self.held -= 1
        return piece

    def pack(self, until: int = 0) -> None:
        """Makes sequences until so many pieces are left; with none left, the tail too."""
        while self.held > until:
            window = [self._take(self.lengths[-1])]
            room = self.capacity - len(window[0][2])
            for length, times in best_counts(room, self.lengths, lambda n: len(self.pieces[n])).items():
                window += [self._take(length) for _ in range(times)]
                room -= length * times
            if room and self.held:  # every piece that is left is longer than the room, or it would have joined
                key, start, ids, n = self._take(self.lengths[-1])
                window.append((key, start, ids[:room], n))
                self._put((key, start + room, ids[room:], n))
                room = 0
            if room:
                self._tail(window)
            else:
                self._emit(window)

    def _tail(self, window: list[tuple]) -> None:
        total = sum(len(p[2]) for p in window)
        for bit in range(total.bit_length() - 1, -1, -1):
            need, part = total & 1 << bit, []
            while need:
                key, start, ids, n = window.pop(0)
                part.append((key, start, ids[:need], n))
                if len(ids) > need:
                    window.insert(0, (key, start + need, ids[need:], n))
                need -= min(need, len(ids))
            if part:
                self._emit(part)

    def _emit(self, window: list[tuple]) -> None:
        offset = 0
        for key, start, ids, n in window:
            self.rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset, ids if self.ids else None))
            offset += len(ids)
        self.sequence += 1


def pack(
    docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, pool: int = POOL, ids: bool = False
) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece, and its ids where asked for."""
    bpe = docs.sparkSession.sparkContext.broadcast(ByteBpe(path))
    fields = T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if ids else "")).fields
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kind = Packer(TaskContext.get().partitionId(), capacity, end, pool, ids), None

        def made() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True))
            packer.rows = []
            lists = [pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32()))] if ids else []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *lists], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for k, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(k, bpe.value.encode(one.as_py() or ""))
                if len(packer.rows) >= ROWS:
                    yield made()
        packer.pack()
        if packer.rows:
            yield made()
        release()

    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return written(rows.mapInArrow(run, schema), "packing")
