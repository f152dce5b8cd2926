"""BPE encoding and decoding with a pair occurrence index.

A task turns a slice of its texts into words (normalise, split by the
tokenizer's pattern) and encodes all words that are new to it at once. All
their symbols stand in one array with links to the neighbours. The index maps
the rank of each adjacent pair to all positions where the pair stands. Active
ranks leave a heap in ascending order; all positions of a rank are merged
together (of overlapping ones, every second from the left), the neighbouring
pairs get new ranks, and their positions are added to the lists of those.
Positions that earlier merges made stale are dropped when their rank comes up.

Decoding looks the token of each id up and joins tokens by a space, as a
tokenizer file without a decoder asks for.

Defined results: a null or empty text has no ids and decodes to the empty text;
special tokens of the file found in a text become their id, as the file says;
repeated rows are encoded alike; an empty table gives no rows; other columns
pass through, and columns named ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, slices

SLICE_BYTES = 4 << 20
#: Bytes that the words a worker remembers may take, with their ids; beyond it, it starts afresh.
KNOWN_BYTES = 64 << 20
#: What a remembered word takes besides its bytes and ids.
WORD_COST = 140
_NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printable else extra))
        extra += b not in printable
    return out


#: Letters (L) and numbers (N) that Unicode 16 added; the tokenizers library knows them, Python's tables may not.
UNICODE_16 = {
    "L": "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4"
    "\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0"
    "\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0",
    "N": "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa",
}
#: Below this code point a text needs short character classes only.
LATIN_END = 0x250


def char_class(kind: str, end: int = sys.maxunicode + 1) -> str:
    """The inside of a regular expression's class: all characters below end of a general category L or N."""
    out, first = [], None
    for c in range(end + 1):
        if c < end and unicodedata.category(chr(c))[0] == kind:
            first = c if first is None else first
        elif first is not None:
            out.append(f"{chr(first)}-{chr(c - 1)}")
            first = None
    return "".join(out) + (UNICODE_16[kind] if end > LATIN_END else "")


def compiled(pattern: str, end: int = sys.maxunicode + 1) -> re.Pattern:
    """The pattern with \\p{L}, \\p{N} and white space spelled out, so that it doesn't hang on a library's Unicode version."""
    space = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    for name, chars in (("\\p{L}", char_class("L", end)), ("\\p{N}", char_class("N", end)), ("\\s", space)):
        pattern = pattern.replace(name, chars)
    return re.compile(pattern)


class Bpe:
    """The tables of a tokenizer file (BPE with a word-end suffix): bounded by its vocabulary."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("only BPE with a word-end suffix and without a decoder is supported")
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if set(steps) - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"unknown normalizers: {steps}")
        self.nfc, self.lower = "NFC" in steps, "Lowercase" in steps
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, k in [*vocab.items(), *self.special.items()]:
            self.tokens[k] = token
        suffix, symbols = model["end_of_word_suffix"], byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in symbols], dtype=np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        self.size = size
        self.left, self.right, self.made = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        keys = self.left * size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self._encoder: Encoder | None = None

    def encoder(self) -> Encoder:
        """The encoder of this process: a worker that runs further tasks goes on with the words it knows."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where the file has no such merge."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], _NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and where each word's begin (one more at the end)."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(data)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        # neighbours; n stands for none
        after = np.arange(1, n + 2, dtype=np.int64)
        after[ends - 1] = n
        before = np.arange(-1, n, dtype=np.int64)
        before[ends - lengths] = n
        before[n] = n
        symbols = np.append(symbols, -1)
        alive = np.ones(n + 1, dtype=bool)
        alive[n] = False

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enters the pairs that begin at these positions."""
            at = at[after[at] < n]
            rank = self.ranks(symbols[at], symbols[after[at]])
            at, rank = at[rank < _NONE], rank[rank < _NONE]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        add(np.arange(n, dtype=np.int64))
        while active:
            r = heapq.heappop(active)
            at = np.concatenate(found) if len(found := index.pop(r)) > 1 else found[0]
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (symbols[at] == a)]
            at = at[symbols[after[at]] == b]
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.append(True, at[1:] != at[:-1])]
                if a == b:  # in a chain of overlapping positions, every second one from the left
                    chained = np.append(False, after[at[:-1]] == at[1:])
                    heads = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - heads) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbols[at] = self.made[r]
            alive[gone] = False
            after[at] = after[gone]
            before[after[gone]] = at
            before[n] = n
            left = before[at]
            add(np.concatenate([at, left[left < n]]))
        keep = alive[:n]
        counts = np.add.reduceat(keep, ends - lengths) if n else np.zeros(0, np.int64)
        return symbols[:n][keep].astype(np.int32), np.append(0, np.cumsum(counts))


class Encoder:
    """Encodes texts in one task, remembering the words it has seen."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.find, self.find_latin = compiled(bpe.pattern).findall, compiled(bpe.pattern, LATIN_END).findall
        self.beyond_latin = re.compile(f"[^\0-{chr(LATIN_END - 1)}]").search
        self.cut = re.compile("(" + "|".join(map(re.escape, bpe.special)) + ")").split
        self.forget()

    def forget(self) -> None:
        self.word: dict[str, int] = {}
        self.bytes = 0
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)
        if self.bpe.special:  # under keys that no word can have
            self._enter([f"\0{s}" for s in self.bpe.special], np.array([*self.bpe.special.values()], dtype=np.int32), np.arange(len(self.bpe.special) + 1))

    def _enter(self, words: list[str], ids: np.ndarray, starts: np.ndarray) -> None:
        self.bytes += sum(map(len, words)) + ids.nbytes + WORD_COST * len(words)
        self.word.update(zip(words, range(len(self.word), len(self.word) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, starts[1:] + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    def words(self, text: str) -> list[str]:
        """The words of a text; white space falls between them, so runs of it need no replacing."""
        if any(s in text for s in self.bpe.special):
            out = []
            for part in self.cut(text):
                out += [f"\0{part}"] if part in self.bpe.special else self.plain(part)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if self.bpe.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.bpe.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return (self.find if self.beyond_latin(text) else self.find_latin)(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the offsets of the texts."""
        # numbers of known words are kept, and of the words themselves only the new ones
        numbers, late, late_at, lengths, n = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)], [], 0
        for text in texts:
            words = self.words(text)
            own = np.fromiter(map(self.word.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
            if len(missing := np.flatnonzero(own < 0)):
                late += [words[k] for k in missing.tolist()]
                late_at.append(missing + n)
            numbers.append(own)
            lengths.append(len(words))
            n += len(words)
        at = np.concatenate(numbers)
        if late:
            new = list(dict.fromkeys(late))
            self._enter(new, *self.bpe.encode_words(new))
            at[np.concatenate(late_at)] = [self.word[w] for w in late]
            del new
        counts = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.starts[at] - (ends - counts), counts)]
        per_text = np.append(0, ends)[np.append(0, np.cumsum(lengths, dtype=np.int64))]
        if self.bytes > KNOWN_BYTES:
            self.forget()
        return ids, per_text


def load(path: str | None = None) -> Bpe:
    """The tables of the tokenizer file at path, read on the driver (word_bpe_49k.json of the public tokenizers where none is given)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return Bpe(json.load(file))


def _strings(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens.take(ids.values)), " ")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with ids (array of int), and with decoded (the text made of the ids again) where asked for."""
    bpe = docs.sparkSession.sparkContext.broadcast(load(path))
    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decoded else [])]
    names = [c for c in docs.columns if c not in {f.name for f in new}]
    source = docs.select(*(F.col(f"`{c}`") for c in names), *([F.col(f"`{text}`").alias("_text")] if text not in names else []))
    take = text if text in names else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = bpe.value.encoder(), pa.array(bpe.value.tokens, pa.string())
        for batch in batches:
            column = batch.column(batch.schema.names.index(take))
            for first, end, _, _ in slices(column, SLICE_BYTES):
                ids, offsets = encoder.encode([t or "" for t in column.slice(first, end - first).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                made = [lists, *([_strings(tokens, lists)] if decoded else [])]
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.names.index(c)) for c in names), *made], names=[*names, *(f.name for f in new)])
        release()

    return source.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), *new]))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the text of each array of ids; null ids decode to the empty text."""
    bpe = rows.sparkSession.sparkContext.broadcast(load(path))
    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        tokens = bpe.value.tokens
        return pd.Series(["" if x is None else " ".join([tokens[k] for k in x]) for x in column], dtype=object)

    return rows.withColumn(name, text(F.col(f"`{ids}`")))
