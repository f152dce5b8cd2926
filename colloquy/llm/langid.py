"""Language identification by multilingual mixture inference.

Training sums hashed byte trigrams of lower-cased words (with their boundaries)
for each language: tasks count, a grouped sum over (language, bucket) combines.
The model is languages x buckets numbers, so both are bounded.

For a document, each word has a likelihood under each language, the product of
its trigram probabilities. Expectation-maximisation over the words estimates the
proportions of the languages. The language set is the one of the sets {best},
{best two}, ... by proportion with the largest penalised likelihood
(log-likelihood minus half the log of the word count for each further
language; all sizes up to the number of languages are tried until two in a row fall below the best), and the proportions are then estimated again within it. lang_pred is
the language with the largest proportion, score its proportion among all
languages before the selection.

Defined results: a null text or one without a letter is ``und`` with score 0 and
no proportions; ties go to the language first by name; repeated rows get equal
results; without any training row every text is ``und``; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, release, slices

BUCKET_BITS = 16
#: Languages that a model may have at most.
MOST_LANGUAGES = 256
SMOOTHING = 0.5
ROUNDS, ROUNDS_AGAIN = 6, 4
#: Log-probabilities that are taken from the model at once.
CELLS_AT_ONCE = 1 << 22
SLICE = 1 << 19
UNDETERMINED = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[128:] = True
_LETTER[ord("a") : ord("z") + 1] = True


def word_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words, where each word's begin, and for each text the number of its first word (one more at the end)."""
    texts = len(offsets) - 1
    padded = np.full(len(data) + texts + 1, 32, dtype=np.uint8)  # a blank before each text and at the end
    padded[1 + np.arange(len(data)) + np.repeat(np.arange(texts), np.diff(offsets))] = lower_ascii(data)
    letter = _LETTER[padded]
    padded[~letter] = 32
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    heads = np.searchsorted(starts, offsets + np.arange(texts + 1))
    wide = padded.astype(np.uint32)
    grams = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    grams = (grams * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    # trigram i stands at bytes i to i + 2; a word from s to e has those from s - 1 to e - 2
    counts = ends - starts
    firsts = np.append(0, np.cumsum(counts))
    at = np.arange(firsts[-1]) + np.repeat(starts - 1 - firsts[:-1], counts)
    return grams[at], firsts[:-1], heads


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages by name, log-probabilities of buckets x languages), from all rows with text and language."""
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for first, end, data, offsets in slices(batch.column(1), SLICE):
                grams, firsts, heads = word_grams(data, offsets)
                bounds = np.append(firsts, len(grams))[heads]
                for name in dict.fromkeys(langs[first:end]):
                    own = np.repeat(langs[first:end] == name, np.diff(bounds))
                    sums[name] = sums.get(name, 0) + np.bincount(grams[own], minlength=1 << BUCKET_BITS)
        release()
        for name, values in sums.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(values[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("buckets")).limit(MOST_LANGUAGES + 1).toArrow()
    if table.num_rows > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(table.column("lang").to_pylist())
    counts = np.zeros((1 << BUCKET_BITS, len(names)))
    for name, buckets in zip(table.column("lang").to_pylist(), table.column("buckets"), strict=True):
        pairs = buckets.values
        counts[pairs.field("bucket").to_numpy(), names.index(name)] = pairs.field("n").to_numpy()
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * (1 << BUCKET_BITS)) if names else counts
    return names, logs.astype(np.float32)


def _word_logs(logs: np.ndarray, grams: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The log-likelihoods of words x languages, a stretch of whole words at a time, so that a text of any length needs memory for its words and not for all its trigrams."""
    step = max(1, CELLS_AT_ONCE // max(1, logs.shape[1]))
    out, bounds, at = np.empty((len(firsts), logs.shape[1]), dtype=np.float32), np.append(firsts, len(grams)), 0
    while at < len(firsts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + step, side="right")) - 1)
        for a in range(int(bounds[at]), int(bounds[end]), step) if end == at + 1 else (int(bounds[at]),):  # a word longer than a stretch is summed in parts
            if end == at + 1:
                part = logs[grams[a : min(a + step, int(bounds[end]))]].sum(axis=0)
                out[at] = part if a == bounds[at] else out[at] + part
            else:
                out[at:end] = np.add.reduceat(logs[grams[a : int(bounds[end])]], firsts[at:end] - a, axis=0)
        at = end
    return out


def piece_bytes(languages: int) -> int:
    """Bytes of text whose words' likelihoods a task holds at once: the more languages, the fewer."""
    return int(min(SLICE, max(1 << 14, 2 * CELLS_AT_ONCE // max(1, languages))))


class _Words:
    """Likelihoods of the words of some texts under all languages.

    Texts of one piece are held; a longer one is read piece by piece, cut beside
    a letter, each time its words are asked for, so its memory is that of a piece.
    (Letters without a break that fill a piece count as a word.)
    """

    def __init__(self, logs: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.logs, self.data, self.offsets, self.piece = logs, data, offsets, piece_bytes(logs.shape[1])
        self.held = None if len(offsets) == 2 and len(data) > self.piece else [self._of(data, offsets)]
        self.counts = np.zeros(len(offsets) - 1, np.int64)
        for of, _ in self.parts():
            self.counts += np.bincount(of, minlength=len(self.counts))

    def _of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams, firsts, heads = word_grams(data, offsets)
        words = _word_logs(self.logs, grams, firsts)
        words -= words.max(axis=1, keepdims=True)
        return np.repeat(np.arange(len(offsets) - 1), np.diff(heads)), np.exp(np.maximum(words, -60.0, out=words), out=words)

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the text, likelihoods) of the words, texts in order."""
        if self.held is not None:
            yield from self.held
            return
        at = 0
        while at < len(self.data):
            end = min(at + self.piece, len(self.data))
            if end < len(self.data) and len(gaps := np.flatnonzero(~_LETTER[lower_ascii(self.data[at:end])])):
                end = at + int(gaps[-1]) + 1
            yield self._of(self.data[at:end], np.array([0, end - at]))
            at = end


def _sums(of: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """Adds rows of values to the rows of their texts."""
    if len(of):
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        out[of[cuts]] += np.add.reduceat(values, cuts, axis=0)


def _em(words: _Words, weights: np.ndarray, rounds: int, only: np.ndarray | None = None) -> np.ndarray:
    """Proportions (texts x languages) after some rounds, of the texts asked for."""
    for _ in range(rounds):
        sums = np.zeros(weights.shape)
        for of, likely in words.parts():
            if only is not None:
                keep = only[of]
                of, likely = of[keep], likely[keep]
            shares = likely * weights[of]
            shares /= shares.sum(axis=1, keepdims=True)
            _sums(of, shares, sums)
        weights = (sums / np.maximum(words.counts, 1)[:, None]).astype(np.float32)
    return weights


def infer(logs: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions within the chosen set, proportions among all languages) of texts x languages; zeros for texts without a word."""
    texts, languages = len(offsets) - 1, logs.shape[1]
    words = _Words(logs, data, offsets)
    some = words.counts > 0
    full = _em(words, np.full((texts, languages), 1 / languages, dtype=np.float32), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    ranked = np.take_along_axis(full, order, axis=1)
    ranked[:, 0] += 1e-9
    # the log-likelihood of each set {best}, {best two}, ...: sums over ranks give all of them in one pass
    value = np.zeros((texts, languages))
    for of, likely in words.parts():
        mixed = np.take_along_axis(likely, order[of], axis=1)
        mixed *= ranked[of]
        _sums(of, np.log(np.cumsum(mixed, axis=1, out=mixed), out=mixed), value)
    within = np.maximum(np.cumsum(ranked, axis=1, dtype=np.float64), 1e-300)
    value -= words.counts[:, None] * np.log(within) + 0.5 * np.arange(languages) * np.log(np.maximum(words.counts, 2))[:, None]
    best, size, fallen = value[:, 0].copy(), np.ones(texts, dtype=np.int64), np.zeros(texts, dtype=np.int64)
    for k in range(2, languages + 1):
        better = (value[:, k - 1] > best) & (fallen < 2)
        fallen = np.where(better, 0, fallen + 1)
        size, best = np.where(better, k, size), np.where(better, value[:, k - 1], best)
        if (fallen >= 2).all():
            break
    chosen = np.where(rank < size[:, None], full, 0) + np.where(rank == 0, 1e-9, 0)
    chosen = np.where(some[:, None], chosen / chosen.sum(axis=1, keepdims=True), 0.0)
    many = some & (size > 1)
    if many.any():
        chosen[many] = _em(words, chosen.astype(np.float32), ROUNDS_AGAIN, many)[many]
    return chosen, np.where(some[:, None], full, 0.0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score and langs (array of language and share, the largest first)."""
    names, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    names_kept = [c for c in keep if c not in ("lang_pred", "score", "langs")]
    kept = [F.col(f"`{c}`") for c in names_kept]
    letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    # a text that is kept goes to Python once
    rows = docs.select(*kept, letter, *([] if text in names_kept else [F.col(f"`{text}`").alias("_text")]))
    n = len(kept)
    at = names_kept.index(text) if text in names_kept else n + 1
    schema = T.StructType([*rows.schema.fields[:n], *T.StructType.fromDDL("lang_pred string, score double, langs array<struct<lang:string,share:double>>").fields])
    columns = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = batch.column(n).to_numpy(zero_copy_only=False)
            pred, score, langs = [], [], []
            for first, end, data, offsets in slices(batch.column(at), piece_bytes(len(names))):
                chosen, full = infer(shared.value, data, offsets) if names else (np.zeros((end - first, 0)),) * 2
                for row in range(end - first):
                    if not letter[first + row] or not chosen[row].any():
                        pred.append(UNDETERMINED)
                        score.append(0.0)
                        langs.append([])
                        continue
                    order = np.argsort(-chosen[row], kind="stable")
                    top = int(order[0])
                    pred.append(names[top])
                    score.append(min(1.0, float(full[row, top])))
                    langs.append([{"lang": names[k], "share": float(chosen[row, k])} for k in order if chosen[row, k] > 1e-4])
            made = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=columns)
        release()

    return rows.mapInArrow(run, schema)
