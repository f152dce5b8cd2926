"""Edit distances of pairs of texts, a column of the table at a time as the bits of two integers; pairs of like lengths share the integers.

With a bound only the band of rows that a path within it can still reach is kept: the rows above and below it
count one more edit each, which is never less than their value, so what is within the bound is exact. A pair
is done as soon as no row of its column can lead to the bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of a column of a group, of the rows that its letters have, and characters that are numbered at once.
COLUMN_BYTES, ROWS_BYTES, PIECE_CHARS = 32_768, 32_000_000, 8_000_000
#: Columns from one look at what the rows can reach to the next, and looks in a long text.
LOOK, LOOKS = 16, 24


def edits(a: str, b: str, most: int | None = None) -> int:
    """The edit distance of one pair; with ``most``, anything above it is most + 1."""
    return int(edits_of([a], [b], None if most is None else [most])[0])


def edits_of(a: Sequence[str], b: Sequence[str], most: Sequence[int] | None = None) -> np.ndarray:
    """The edit distances of pairs; with ``most``, anything above it is most + 1. Time grows with the product of the lengths over a machine word."""
    sizes = np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), dtype=np.int64, count=len(a))
    pieces = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PIECE_CHARS)) + 1
    bounds = None if most is None else np.asarray(most, dtype=np.int64)
    out = np.zeros(len(a), dtype=np.int64)
    for start, stop in zip([0, *pieces], [*pieces, len(a)], strict=True):
        out[start:stop] = _piece(a[start:stop], b[start:stop], None if bounds is None else bounds[start:stop])
    return out


def _piece(a: Sequence[str], b: Sequence[str], most: np.ndarray | None) -> np.ndarray:
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    m, n = (np.array([len(p[k]) for p in pairs], dtype=np.int64) for k in (0, 1))
    out = m if most is None else np.where(m - n > most, most + 1, np.minimum(m, most + 1))
    open_ = np.flatnonzero(n > 0) if most is None else np.flatnonzero((n > 0) & (m - n <= most))
    if not len(open_):
        return out
    texts = "".join(t for p in pairs for t in p)
    begins = np.concatenate(([0], np.cumsum([len(t) for p in pairs for t in p])))
    both = np.frombuffer(texts.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    seen = np.zeros(int(both.max()) + 1, dtype=bool)
    seen[both] = True
    letters = int(seen.sum()) + 2  # number 0 is none, and the last one fills up
    numbers = np.append(np.cumsum(seen).astype(np.int32)[both], np.int32([0, letters - 1]))
    level = lambda size: np.where(size <= 128, -(-size // 16), 8 + np.ceil(np.log(np.maximum(size, 128) / 128) / np.log(1.15)).astype(np.int64))
    kind = level(m) * 1000 + level(n)
    order = open_[np.argsort(kind[open_], kind="stable")]
    for alike in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        wide = -(-int(m[alike].max() + n[alike].max() - n[alike].min()) // 8)
        size = max(1, min(COLUMN_BYTES // wide, ROWS_BYTES // (wide * letters)))
        for begin in range(0, len(alike), size):
            k = alike[begin : begin + size]
            # a common end changes no distance: it gives all pairs as many columns
            last = int(n[k].max())
            rows, columns = m[k] + last - n[k], np.full(len(k), last)
            part = lambda start, real, full: numbers[
                np.where((at := np.arange(int(full.max()))) < real[:, None], start[:, None] + at, np.where(at < full[:, None], len(both) + 1, len(both)))
            ]
            out[k] = _together(part(begins[2 * k], m[k], rows), part(begins[2 * k + 1], n[k], columns), letters, rows, None if most is None else most[k])
    return out


def _together(rows: np.ndarray, columns: np.ndarray, letters: int, m: np.ndarray, most: np.ndarray | None) -> np.ndarray:
    """The distances of pairs of numbered letters, a pair in each row of both arrays; there are m rows of the table, and as many columns for all."""
    (count, n), wide = columns.shape, -(-rows.shape[1] // 8)
    table = _table(rows, letters, wide) if count > 1 else None
    out = np.zeros(count, dtype=np.int64) if most is None else most + 1
    pair, top = np.arange(count), np.zeros(count, dtype=np.int64)  # top: the value above the first row that is kept
    up = down = np.zeros((count, 0), dtype=np.uint8)  # where the column grows and falls, in the kept bytes of rows from first to end
    first = end = 0
    before, after = (n, 8 * wide) if most is None else (int(((most - m + n) // 2).max()), int(((most + m - n) // 2).max()))
    step = max(LOOK, min(n // LOOKS, ROWS_BYTES // (count * wide)))
    for start in range(0, n, step):
        stop = min(n, start + step)
        if most is not None and start:
            least, before, after = _reach(up, down, top, 8 * first - start, m - n, most)
            keep = np.flatnonzero(least <= most)
            if not len(keep):
                return out
            pair, top, m, most, columns, up, down = (v[keep] for v in (pair, top, m, most, columns, up, down))
            before, after = int(before[keep].max()), int(after[keep].max())
        begin = min(wide - 1, max(first, (start - before) // 8))
        stays = max(begin + 1, min(wide, -(-(stop + after) // 8)))
        if stays > end:
            up, down = (np.concatenate((v, np.full((len(v), stays - end), x, dtype=np.uint8)), axis=1) for v, x in ((up, 255), (down, 0)))
        top = top + _net(up[:, : begin - first], down[:, : begin - first])
        up, down = (v[:, begin - first : stays - first] for v in (up, down))
        first, end = begin, stays
        up, down = _walk(up, down, _matches(table, rows, columns[:, start:stop], pair * letters, first, end))
        top += stop - start
    ended = m <= 8 * end
    inside = np.packbits(np.arange(8 * (end - first)) < (m - 8 * first)[:, None], axis=1, bitorder="little")
    found = top + _net(up & inside, down & inside)
    out[pair[ended]] = (found if most is None else np.minimum(found, most + 1))[ended]
    return out


def _table(rows: np.ndarray, letters: int, wide: int) -> np.ndarray:
    """The rows that hold a letter, as bits: a line for each letter of each pair."""
    table = np.zeros((len(rows) * letters, wide + 1), dtype=np.uint8)
    at, i = np.arange(len(rows))[:, None] * letters, np.arange(rows.shape[1])
    np.add.at(table.reshape(-1), ((at + rows) * (wide + 1) + i // 8).reshape(-1), np.tile((1 << i % 8).astype(np.uint8), len(rows)))
    table[at[:, 0]] = 0
    return table


def _matches(table: np.ndarray | None, rows: np.ndarray, columns: np.ndarray, offset: np.ndarray, first: int, end: int) -> Iterator[int]:
    """For each column the rows from first to end that have its letter, with a byte between two pairs."""
    if table is None:
        line = columns[0].tolist()
        found = {c: int.from_bytes(np.packbits(rows[0, 8 * first : 8 * end] == c, bitorder="little").tobytes(), "little") for c in set(line)}
        yield from (found[c] for c in line)
    else:
        lines = table[(offset[:, None] + columns).T.reshape(-1), first : end + 1]
        lines[:, -1] = 0
        lines, size = lines.tobytes(), len(columns) * (end - first + 1)
        yield from (int.from_bytes(lines[k : k + size], "little") for k in range(0, len(lines), size))


def _walk(up: np.ndarray, down: np.ndarray, matches: Iterator[int]) -> tuple[np.ndarray, np.ndarray]:
    """The columns after these, to the last one that matches are given for. What a pair carries over ends in the byte after it."""
    count, wide = up.shape
    between = np.zeros((count, 1), dtype=np.uint8)
    number = lambda v: int.from_bytes(np.concatenate((v, between), axis=1).tobytes(), "little")
    bits = lambda v: np.frombuffer(v.to_bytes(count * (wide + 1), "little"), dtype=np.uint8).reshape(count, wide + 1)[:, :-1]
    each = lambda line: int.from_bytes((line + b"\0") * count, "little")
    all_, lows = each(b"\xff" * wide), each(b"\1" + bytes(wide - 1))
    p, q = number(up), number(down)
    for eq in matches:
        x = eq | q
        h = (((eq & p) + p) ^ p) | eq
        grows, falls = (q | (all_ ^ (h | p))) << 1 | lows, (p & h) << 1
        p, q = (falls | (all_ ^ (x | grows))) & all_, grows & x
    return bits(p), bits(q)


def _net(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    return np.bitwise_count(up).sum(axis=1, dtype=np.int64) - np.bitwise_count(down).sum(axis=1, dtype=np.int64)


def _reach(up: np.ndarray, down: np.ndarray, top: np.ndarray, at: int, goal: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the rows of a column can lead to: no more than the least distance, and how far before and after the column a path within the bound may get, by eight rows at a time. The row of ``top`` lies ``at`` after the column, and the last of all ``goal``."""
    grow, fall = (np.bitwise_count(v).astype(np.int32) for v in (up, down))
    value = top[:, None] + np.cumsum(grow - fall, axis=1) - grow  # none of the eight is less
    low = at + 8 * np.arange(up.shape[1]) + 1
    rest = np.maximum(np.maximum(low - goal[:, None], goal[:, None] - low - 7), 0)
    least = np.minimum((value + rest).min(axis=1), top + np.abs(at - goal))
    before = (most - goal - np.minimum((low + value).min(axis=1), at + top)) // 2
    after = (most + goal + np.maximum((low + 7 - value).max(axis=1), at - top)) // 2
    return least, before, after
