"""Language models as pluggable functions: contracts, validation with one corrective retry, embeddings.

The model is a Python callable from a prompt (and an error to correct, or None)
to a JSON text. It runs in tasks over Arrow batches; rows whose answer stays
invalid carry an error and go on.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[str, str | None], str]

_ITEM = "text:string,verbatimQuote:string,turnId:string,inferred:boolean"
_CLAIM = "claims array<struct<claim:string,verdict:string,quote:string,turnId:string,critical:boolean>>"
#: Result of each call, as a schema: the fields that an answer is brought to.
CONTRACTS = {
    "clean": "turns array<struct<sourceIds:array<string>,speaker:string,text:string>>, chapters array<struct<startTime:double,title:string>>, qualityScore double, garbledPct double",
    "extract": f"decisions array<struct<{_ITEM}>>, actionItems array<struct<{_ITEM},owner:string,due:string,done:boolean>>, openQuestions array<struct<{_ITEM}>>, keyNumbers array<struct<{_ITEM}>>, participants array<string>",
    "summarise": "text string",
    "verify": _CLAIM,
    "rejudge": _CLAIM,
    "repair": "text string",
    "answer": "answer string, sufficient boolean",
    "plan": "searchQuery string, timeIsExplicit boolean, fromEpoch double, toEpoch double, targetTypes array<string>",
    "clean_note": "title string, cleanText string",
    "memory": "answer_md string, citations array<string>",
}
#: Verdicts on a claim.
VERDICTS = ("SUPPORTED", "PARTIAL", "UNSUPPORTED", "UNCERTAIN")
EMBED_CHARS = 40_000


class Broken(ValueError):
    """An answer that breaks its contract; the text names the place."""


def _need(holds: bool, path: str, what: str) -> None:
    if not holds:
        raise Broken(f"{path}: {what}")


def _text(data: dict, name: str, path: str, optional: bool = False) -> str | None:
    value = data.get(name)
    if optional and value in (None, ""):
        return None
    _need(isinstance(value, str), f"{path}.{name}", "not a string")
    return value


def _number(data: dict, name: str, path: str, optional: bool = False) -> None:
    value = data.get(name)
    if not (optional and value is None):
        _need(isinstance(value, int | float) and not isinstance(value, bool) and value == value, f"{path}.{name}", "not a number")


def _list(data: dict, name: str, path: str, optional: bool = False) -> list:
    value = data.get(name)
    if optional and value is None:
        return []
    _need(isinstance(value, list), f"{path}.{name}", "not an array")
    return value


def _texts(data: dict, name: str, path: str, optional: bool = False) -> list[str]:
    values = _list(data, name, path, optional)
    for i, value in enumerate(values):
        _need(isinstance(value, str), f"{path}.{name}[{i}]", "not a string")
    return values


def _objects(data: dict, name: str, optional: bool = False) -> Iterator[tuple[str, dict]]:
    for i, value in enumerate(_list(data, name, "$", optional)):
        _need(isinstance(value, dict), f"$.{name}[{i}]", "not an object")
        yield f"$.{name}[{i}]", value


def _clean(data: dict, turn_ids: set[str] | None) -> None:
    for path, turn in _objects(data, "turns"):
        _need(len(_texts(turn, "sourceIds", path)) > 0, f"{path}.sourceIds", "empty")
        _text(turn, "speaker", path), _text(turn, "text", path)
    _need(len(data["turns"]) > 0, "$.turns", "empty")
    for path, chapter in _objects(data, "chapters", optional=True):
        _number(chapter, "startTime", path), _text(chapter, "title", path)
    _number(data, "qualityScore", "$", optional=True), _number(data, "garbledPct", "$", optional=True)


def _extract(data: dict, turn_ids: set[str] | None) -> None:
    for name in ("decisions", "actionItems", "openQuestions", "keyNumbers"):
        data[name] = _list(data, name, "$", optional=True)
        for path, item in _objects(data, name):
            for field in ("text", "verbatimQuote", "turnId"):
                _text(item, field, path)
            item["inferred"] = item.get("inferred") is True
            if name == "actionItems":
                item["owner"], item["due"] = _text(item, "owner", path, optional=True), _text(item, "due", path, optional=True)
                item["done"] = item.get("done") is True
    data["participants"] = _texts(data, "participants", "$", optional=True)


def _anchored(data: dict, turn_ids: set[str] | None) -> None:
    text = _text(data, "text", "$")
    _need(text.strip() != "", "$.text", "empty")
    anchors = set(re.findall(r"\[(T\d+)\]", text))
    _need(len(anchors) > 0, "$.text", "no anchors")
    unknown = sorted(anchors - turn_ids) if turn_ids is not None else []
    _need(not unknown, "$.text", f"unknown turn {', '.join(unknown)}")


def _claims(data: dict, turn_ids: set[str] | None) -> None:
    for path, claim in _objects(data, "claims"):
        _need(_text(claim, "verdict", path) in VERDICTS, f"{path}.verdict", f"not one of {', '.join(VERDICTS)}")
        claim["quote"], claim["turnId"] = _text(claim, "quote", path, optional=True), _text(claim, "turnId", path, optional=True)
        _text(claim, "claim", path)
        claim["critical"] = claim.get("critical") is True
    _need(len(data["claims"]) > 0, "$.claims", "empty")


def _filled(data: dict, name: str) -> str:
    value = _text(data, name, "$")
    _need(value.strip() != "", f"$.{name}", "empty")
    return value


def _answer(data: dict, turn_ids: set[str] | None) -> None:
    _text(data, "answer", "$")
    _need(isinstance(data.get("sufficient", True), bool), "$.sufficient", "not a boolean")


def _memory(data: dict, turn_ids: set[str] | None) -> None:
    _filled(data, "answer_md")
    data["citations"] = _texts(data, "citations", "$", optional=True)


def _plan(data: dict, turn_ids: set[str] | None) -> None:
    _filled(data, "searchQuery")
    _number(data, "fromEpoch", "$", optional=True), _number(data, "toEpoch", "$", optional=True)
    # an empty list of types is none
    data["targetTypes"] = _texts(data, "targetTypes", "$", optional=True) or None
    _need(isinstance(data.get("timeIsExplicit"), bool), "$.timeIsExplicit", "not a boolean")


def _note(data: dict, turn_ids: set[str] | None) -> None:
    data["title"] = cut_units(_text(data, "title", "$").strip(), NOTE_TITLE)
    _need(data["title"] != "", "$.title", "empty")
    _filled(data, "cleanText")


def cut_units(text: str, most: int) -> str:
    """The first so many UTF-16 units of a text; half a pair becomes U+FFFD."""
    return text.encode("utf-16-le")[: 2 * most].decode("utf-16-le", "replace")


NOTE_TITLE = 60
_CHECKS = {"clean": _clean, "extract": _extract, "summarise": _anchored, "verify": _claims, "rejudge": _claims, "repair": _anchored, "answer": _answer, "plan": _plan, "clean_note": _note, "memory": _memory}


def checked(name: str, data: object, turn_ids: set[str] | None = None) -> dict:
    """The answer with the fields of its contract (flags are true only where they say so, a title is cut); raises Broken where it can't hold. Any JSON value is taken."""
    return _checked_in_place(name, json.loads(json.dumps(data)), turn_ids)


def _checked_in_place(name: str, data: object, turn_ids: set[str] | None) -> dict:
    """checked() of an answer that nothing else holds, which needs no copy."""
    _need(isinstance(data, dict), "$", "not an object")
    _CHECKS[name](data, turn_ids)
    return data


def invalid(name: str, data: object, turn_ids: set[str] | None = None) -> str | None:
    """Why an answer breaks its contract, with the path of the fault; None if it holds."""
    try:
        checked(name, data, turn_ids)
    except Broken as fault:
        return str(fault)
    return None


def _called(model: Model, name: str, prompt: str, turn_ids: list[str] | None) -> tuple[str | None, str | None]:
    fault = None
    for _ in range(2):
        try:
            return json.dumps(_checked_in_place(name, json.loads(model(prompt, fault)), set(turn_ids) if turn_ids is not None else None)), None
        except Broken as broken:
            fault = str(broken)
        except ValueError as error:
            fault = f"$: {error}"
    return None, fault


def call(rows: DataFrame, name: str, model: Model, prompt: str = "prompt", turn_ids: str | None = None) -> DataFrame:
    """rows with ``result`` (struct of the contract, null on failure) and ``error``; each prompt is tried twice at most, the second time with the fault told."""
    columns = [F.col(prompt)] + ([F.col(turn_ids)] if turn_ids else [F.lit(None).cast("array<string>")])

    @F.pandas_udf("result string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for prompts, ids in batches:
            made = [_called(model, name, p, None if i is None else list(i)) for p, i in zip(prompts, ids, strict=True)]
            yield pd.DataFrame(made, columns=["result", "error"])

    out = rows.withColumn("_call", run(*columns))
    return out.withColumns({"result": F.from_json("_call.result", CONTRACTS[name]), "error": F.col("_call.error")}).drop("_call")


def output_cap(text: Column, least: int = 24_000, most: int = 64_000) -> Column:
    """Tokens that a rewrite may take: half the characters, within bounds."""
    return F.least(F.greatest(F.floor(F.length(text) / 2), F.lit(least)), F.lit(most))


def hash_embedding(text: str, size: int = 1024) -> np.ndarray:
    """A unit vector from the SHA-256 of the text: equal texts are equal, all others unrelated. For tests and isolation checks."""
    digest = hashlib.sha256(text.encode()).digest()
    raw = np.frombuffer((digest * (-(-size // len(digest))))[:size], dtype=np.uint8).astype(np.float32) - 127.5
    return raw / np.linalg.norm(raw)


#: Vectors of a batch at most: 1 MB at 1024 components.
EMBED_ROWS = 256


def _with_vectors(batches: Iterator[pa.RecordBatch], at: int, vector_of: Callable[[str | None], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The batches with the vectors of a text column; vectors are far wider than texts, so that a batch is made in pieces."""
    for batch in batches:
        for start in range(0, batch.num_rows, EMBED_ROWS):
            part = batch.slice(start, EMBED_ROWS)
            vectors = [vector_of(value) for value in part.column(at).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, vectors)], dtype=np.int32))
            made = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(vectors)))
            yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "embedding"])


def embed(rows: DataFrame, text: str = "text", embedder: Callable[[str], np.ndarray] = hash_embedding) -> DataFrame:
    """rows with embedding: the unit vector of the first 40,000 characters of the text."""

    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    at = rows.columns.index(text)

    def vector_of(value: str | None) -> np.ndarray:
        vector = np.asarray(embedder((value or "")[:EMBED_CHARS]), dtype=np.float32)
        norm = np.linalg.norm(vector)
        return vector / norm if norm else vector

    return rows.mapInArrow(lambda batches: _with_vectors(batches, at, vector_of), schema)


def with_prompt(kits: DataFrame, kit: str, prompt: str) -> DataFrame:
    """The catalogue (kit, prompts array) with a prompt added to a kit."""
    return kits.withColumn("prompts", F.when(F.col("kit") == kit, F.array_append("prompts", F.lit(prompt))).otherwise(F.col("prompts")))


def _ranks(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, 4, ... characters the numbers of the strings of that length at each place of both texts, as far as they share any; memory is linear in the texts."""
    out, size = [], 1
    _, found = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = found[: len(x)], found[len(x) :]
    while len(a) and len(b):
        seen = np.zeros(max(a.max(), b.max()) + 1, dtype=bool)
        seen[b] = True
        if not seen[a].any():
            break
        out.append((a, b))
        more = len(seen)
        _, found = np.unique(np.concatenate((a[:-size] * more + a[size:], b[:-size] * more + b[size:])), return_inverse=True)
        a, b, size = found[: max(len(a) - size, 0)], found[max(len(a) - size, 0) :], 2 * size
    return out


def _longest_block(ranks: list, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """(i, j, size) of the longest string that both ranges hold, the first by i, then j; size 0 if there is none."""
    best = None
    for p, (a, b) in enumerate(ranks):
        u, w = a[alo : max(ahi - (1 << p) + 1, alo)], b[blo : max(bhi - (1 << p) + 1, blo)]
        if not len(u) or not len(w):
            break
        held = np.zeros(max(u.max(), w.max()) + 1, dtype=bool)
        held[w] = True
        i = np.flatnonzero(held[u])
        if not len(i):
            break
        held[:] = False
        held[u[i]] = True
        best = p, i + alo, np.flatnonzero(held[w]) + blo
    if best is None:
        return 0, 0, 0
    p, i, j = best
    a, b = ranks[p]
    # a string of up to twice that length is told by the numbers at its beginning and its end
    size, more, ka, kb = 1 << p, int(max(a.max(), b.max())) + 1, a[i], b[j]
    for q in range(p - 1, -1, -1):
        tail = size + (1 << q) - (1 << p)
        u, w = i[i + tail + (1 << p) <= ahi], j[j + tail + (1 << p) <= bhi]
        x, y = a[u] * more + a[u + tail], b[w] * more + b[w + tail]
        hit = np.isin(x, y)
        if hit.any():
            keep = np.isin(y, x)
            size, i, j, ka, kb = size + (1 << q), u[hit], w[keep], x[hit], y[keep]
    return int(i[0]), int(j[int((kb == ka[0]).argmax())]), size


def _matching_ratio(p: str, q: str, least: float) -> float:
    """SequenceMatcher(None, p, q, autojunk=False).ratio() from least up, else 0.0.

    Regions between blocks are searched largest first; what they could still match is at most their shorter
    side, so the search ends as soon as the rest can't reach ``least``.
    """
    both = len(p) + len(q)
    if not both:
        return 1.0
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (p, q))
    ranks, matched, open_, todo = None, 0, min(len(p), len(q)), [(-min(len(p), len(q)), 0, len(p), 0, len(q))]
    while todo:
        # the division is the one of ratio(), so that bounds and results round alike
        if 2.0 * (matched + open_) / both < least:
            return 0.0
        most, alo, ahi, blo, bhi = heapq.heappop(todo)
        open_ += most
        ranks = _ranks(x, y) if ranks is None else ranks
        i, j, size = _longest_block(ranks, alo, ahi, blo, bhi)
        if size:
            matched += size
            for a, b, c, d in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                if a < b and c < d:
                    shorter = min(b - a, d - c)
                    open_ += shorter
                    heapq.heappush(todo, (-shorter, a, b, c, d))
    found = 2.0 * matched / both
    return found if found >= least else 0.0


def sequence_ratio(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """Twice the matched characters over all characters, by longest matching blocks (which an edit distance doesn't give), from ``least`` up; 0 below."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_matching_ratio(p or "", q or "", least) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)
