"""Text as Columns: matching forms, token sets, similarity, markers, slugs and renderings."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .distances import edits as _edits  # noqa: F401
from .distances import edits_of

#: Unicode white space around a text, which trim() alone leaves.
_EDGES = r"(?U)^\s+|\s+$"
_MARKS = "".join(map(chr, range(0x0300, 0x0370)))
_HANGUL = range(0xAC00, 0xD7A4)

#: Negations that a rewrite must not add or lose.
NEGATIONS = ("no", "not", "never", "nunca", "jamas", "ni", "tampoco", "nadie", "ninguno", "ninguna", "nada", "sin")
#: States in labels of people that aren't part of the name.
SPEAKING = "is speaking|está hablando|muted|silenciado"
QUOTE_LEAST = 0.8
REVISION_LEAST = 0.6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _folding() -> tuple[str, str, str]:
    """Letters that decompose, their base letters, and those of them with a mark that isn't folded: it leaves a blank.

    Hangul syllables stay whole: they decompose into letters only, alike on both sides of a comparison.
    """
    letters, bases, blanked = [], [], []
    for code in range(0x00C0, sys.maxunicode + 1):
        found = unicodedata.normalize("NFD", chr(code))
        if found == chr(code) or code in _HANGUL or unicodedata.category(chr(code))[0] not in "LN":
            continue
        letters.append(chr(code))
        bases.append(found[0])
        if any(m not in _MARKS for m in found[1:]):
            blanked.append(chr(code))
    return "".join(letters), "".join(bases), _set_of(blanked)


def _set_of(chars: list[str]) -> str:
    """A regular expression of one of the characters. They are parted by range, so that another character is compared with few: a plain set beyond Latin-1 is tried member by member."""
    parts: dict[int, list[str]] = {}
    for c in chars:
        parts.setdefault(ord(c) >> 7, []).append(c)
    near = "".join(f"[{min(p)}-{max(p)}&&[{''.join(p)}]]" for p in parts.values())
    return f"[{min(chars)}-{max(chars)}&&[{near}]]"


def fold(c: Column | str) -> Column:
    """The text without accents; stays in the JVM. Marks of U+0300-036F go, other marks of a letter become a blank."""
    letters, bases, blanked = _folding()
    text = _col(c)
    spaced = F.regexp_replace(text, f"({blanked})", "$1 ")
    # letters are looked up one by one, which plain texts needn't
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(spaced, letters + _MARKS, bases)).otherwise(text)


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), _EDGES, "")


def normalize(c: Column | str) -> Column:
    """Matching form: lower case, folded, only letters and numbers with single spaces between."""
    return F.trim(F.regexp_replace(fold(F.lower(_col(c))), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column | str) -> Column:
    """Tokens of the matching form; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(normalize(c), F.lit("")), " "), lambda t: t != "")


def multiset_hits(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))


def containment(needle: Column | str, hay: Column | str) -> Column:
    """Share of the needle's tokens in the best window of the hay, 0 to 1; the window is the needle's length and a quarter more."""
    n, h = tokens(needle), tokens(hay)
    return containment_of_tokens(n, h)


def containment_of_tokens(n: Column, h: Column) -> Column:
    width = F.least(F.size(h), F.size(n) + F.ceil(F.size(n) / 4).cast("int"))
    aligned = F.contains(F.concat(F.lit(" "), F.array_join(h, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(n, " "), F.lit(" ")))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: multiset_hits(n, F.slice(h, i, width))))
    return F.when((F.size(n) == 0) | (F.size(h) == 0), 0.0).when(aligned, 1.0).otherwise(best / F.size(n))


def _contained(n: list[str], h: list[str]) -> float:
    """The containment of one pair of token lists: the window slides, in time linear in the hay."""
    if n is None or h is None or not len(n) or not len(h):
        return 0.0
    need: dict[str, int] = {}
    for t in n:
        need[t] = need.get(t, 0) + 1
    if need.keys().isdisjoint(h):
        return 0.0
    if f" {' '.join(n)} " in f" {' '.join(h)} ":
        return 1.0
    width, seen, hits, most = min(len(h), len(n) + -(-len(n) // 4)), dict.fromkeys(need, 0), 0, 0
    for i, t in enumerate(h):
        if t in seen:
            seen[t] += 1
            hits += seen[t] <= need[t]
        if i >= width and (old := h[i - width]) in seen:
            hits -= seen[old] <= need[old]
            seen[old] -= 1
        if i + 1 >= width:
            most = max(most, hits)
    return most / len(n)


def sliding_containment(needle: Column | str, hay: Column | str) -> Column:
    """containment_of_tokens() for long arrays, in an Arrow function.

    The expression form counts anew in each window; beyond a few tokens it is
    slower than the trip to Python.
    """
    @F.pandas_udf("double")
    def best(needles: pd.Series, hays: pd.Series) -> pd.Series:
        return pd.Series([_contained(n, h) for n, h in zip(needles, hays, strict=True)], dtype="float64")

    return best(_col(needle), _col(hay))


def sliding_overlap(a: Column | str, b: Column | str) -> Column:
    """The larger containment of the two directions, with one trip to Python."""
    @F.pandas_udf("double")
    def best(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([max(_contained(x, y), _contained(y, x)) for x, y in zip(left, right, strict=True)], dtype="float64")

    return best(_col(a), _col(b))


def overlap_score(a: Column | str, b: Column | str) -> Column:
    return F.greatest(containment(a, b), containment(b, a))


def quote_exists(quote: Column | str, text: Column | str, least: float = QUOTE_LEAST) -> Column:
    return sliding_containment(tokens(quote), tokens(text)) >= least


def similarity(a: Column | str, b: Column | str, least: float | None = None) -> Column:
    """1 less the edit distance over the longer length, case aside; 0 if one is empty or null. With ``least``, what is below it is only known to be so."""
    return _similarity(F.lower(_col(a)), F.lower(_col(b)), least)


def _similarity(x: Column, y: Column, least: float | None) -> Column:
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        some = ((x.str.len() > 0) & (y.str.len() > 0)).to_numpy(dtype=bool)
        x, y = x[some].tolist(), y[some].tolist()
        longest = np.fromiter((max(len(p), len(q)) for p, q in zip(x, y, strict=True)), dtype=np.int64, count=len(x))
        out[some] = 1 - edits_of(x, y, None if least is None else np.floor(longest * (1 - least)).astype(np.int64) + 1) / longest
        return pd.Series(out)

    return of(x, y)


def comparable(c: Column | str) -> Column:
    """White space collapsed, end punctuation off."""
    # a lone blank stays as it is, and only blanks are left at the edges
    return F.rtrim(F.ltrim(F.regexp_replace(_col(c), r"(?U)\s(?:\s+|(?<! ))", " ")), F.lit(".,;:?! "))


def is_revision(before: Column | str, after: Column | str) -> Column:
    """Whether the later caption text continues or corrects the earlier one."""
    return goes_on(F.lower(comparable(before)), F.lower(comparable(after)))


def goes_on(before: Column | str, after: Column | str) -> Column:
    """is_revision() of comparable() texts in lower case. They are read several times: as columns of a step before, they are made once."""
    p, c = _col(before), _col(after)
    grown = F.startswith(c, p)
    # texts that go on need no distance
    alike = _similarity(F.when(~grown, p), F.when(~grown, c), REVISION_LEAST)
    return (p != "") & (grown | (alike >= REVISION_LEAST))


def estimated_tokens(c: Column | str) -> Column:
    return F.ceil(F.length(_col(c)) / 4).cast("long")


def words(c: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c)).cast("long")


def numbers(c: Column | str) -> Column:
    """Distinct numbers of a text, group and decimal separators taken out."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"\d+(?:[.,]\d+)*"), 0)
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, "[.,]", "")))


def negations(c: Column | str) -> Column:
    return F.array_intersect(F.array_distinct(tokens(c)), F.lit(list(NEGATIONS)))


def audit(raw: Column | str, clean: Column | str) -> Column:
    """struct of missing_numbers, introduced_numbers and negation_flips between a text and its rewrite."""
    a, b, p, q = numbers(raw), numbers(clean), negations(raw), negations(clean)
    return F.struct(
        F.array_except(a, b).alias("missing_numbers"),
        F.array_except(b, a).alias("introduced_numbers"),
        F.concat(F.array_except(p, q), F.array_except(q, p)).alias("negation_flips"),
    )


def violated(found: Column) -> Column:
    return F.size(found["missing_numbers"]) + F.size(found["introduced_numbers"]) + F.size(found["negation_flips"]) > 0


def describe_violation(sources: Column, found: Column) -> Column:
    part = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{title}: "), F.array_join(xs, ", ")))
    told = F.concat_ws(
        "; ", part("numbers lost", found["missing_numbers"]), part("numbers introduced", found["introduced_numbers"]), part("negations changed", found["negation_flips"])
    )
    return F.concat(F.lit("- segments "), F.array_join(sources, ", "), F.lit(": "), told)


def chunks(c: Column | str) -> Column:
    """Lines of a captured control's text: object marks, carriage returns and bars break lines, tabs are blanks; trimmed, empty ones go."""
    plain = F.translate(_col(c), "\ufffc\r|\t", "\n\n\n ")
    return F.filter(F.transform(F.split(F.coalesce(plain, F.lit("")), "\n"), strip), lambda s: s != "")


def reference_of(kind: Column, meeting: Column, turn: Column, note: Column) -> Column:
    """The reference of a search hit, without brackets: a note's id, or a meeting's with the turn where the hit has one (summaries and digests have none)."""
    place = F.when(F.coalesce(turn, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(":"), turn))
    return F.when(kind == "note", F.concat(F.lit("N:"), note)).otherwise(F.concat(F.lit("M:"), meeting, place))


def turn_anchors(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"\[(T\d+)\]"), 1))


REFERENCE = r"\[M:([^\]]+?)(?::(T\d+))?\]|\[N:([^\]]+?)\]"


def references(c: Column | str) -> Column:
    """Distinct citation markers in order, as structs of ref (without brackets), kind, id and turn.

    [M:id] and [M:id:T3] name a meeting, [N:id] a note; ids may hold blanks and colons, a note has no turn.
    """
    part = lambda k: F.regexp_extract_all(_col(c), F.lit(REFERENCE), k)
    rows = F.arrays_zip(part(0).alias("ref"), part(1).alias("meeting"), part(2).alias("turn"), part(3).alias("note"))
    named = lambda r: F.struct(
        F.substring(r["ref"], F.lit(2), F.length(r["ref"]) - 2).alias("ref"), F.when(r["meeting"] != "", "M").otherwise("N").alias("kind"),
        F.when(r["meeting"] != "", r["meeting"]).otherwise(r["note"]).alias("id"), r["turn"].alias("turn"),
    )
    return F.array_distinct(F.transform(rows, named))


def strip_references(c: Column | str, refs: Column) -> Column:
    """The text without the markers of the given refs; blanks are collapsed, and ends trimmed, only if any went."""
    cut = F.aggregate(refs, _col(c), lambda text, ref: F.replace(text, F.concat(F.lit("["), ref, F.lit("]")), F.lit("")))
    return F.when(F.size(refs) > 0, strip(F.regexp_replace(cut, r"[ \t]{2,}", " "))).otherwise(_col(c))


def strip_anchors(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\s*\[T\d+\]", "")


def strip_emphasis(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\*\*([^*]+)\*\*", "$1")


def with_anchor(c: Column | str, turn: Column) -> Column:
    mark = F.concat(F.lit("["), turn, F.lit("]"))
    return F.when(F.contains(_col(c), mark), _col(c)).otherwise(F.concat(_col(c), F.lit(" "), mark))


def slug(c: Column | str, most: int = 60, empty: str = "reunion") -> Column:
    """Folded lower-case words joined by hyphens, cut to a length at last (so that it may end in a hyphen)."""
    made = F.regexp_replace(fold(F.lower(_col(c))), "[^a-z0-9]+", "-")
    cut = F.left(F.regexp_replace(made, "^-+|-+$", ""), F.lit(most))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(empty))


def html_escape(c: Column | str) -> Column:
    out = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def uri_component(c: Column | str) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    out = F.url_encode(_col(c))
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def initials(c: Column | str) -> Column:
    """First letters of the first and last word, upper case."""
    w = words(c)
    first, last = F.upper(F.left(F.get(w, F.lit(0)), F.lit(1))), F.upper(F.left(F.get(w, F.size(w) - 1), F.lit(1)))
    return F.when(F.size(w) == 0, "?").when(F.size(w) == 1, first).otherwise(F.concat(first, last))


def safe_name(c: Column | str, most: int = 200) -> Column:
    """Only letters, digits, dot, underscore and hyphen, cut to a length."""
    return F.left(F.regexp_replace(_col(c), "[^0-9A-Za-z._-]", "-"), F.lit(most))


def hashed_name(prefix: str, c: Column | str) -> Column:
    """prefix, a shortened safe form and ten digits of the SHA-256: collision-safe and bounded."""
    return F.concat(F.lit(prefix), F.lower(safe_name(c, 40)), F.lit("-"), F.substring(F.sha2(_col(c), 256), 1, 10))


def title_of(c: Column | str, most: int = 60) -> Column:
    return F.substring(strip(_col(c)), 1, most)


def first_paragraph(c: Column | str) -> Column:
    """The first paragraph that isn't a heading; empty if there is none."""
    parts = F.transform(F.split(_col(c), r"\n\s*\n"), strip)
    return F.coalesce(F.get(F.filter(parts, lambda p: (p != "") & ~F.startswith(p, F.lit("#"))), F.lit(0)), F.lit(""))


def summary_sections(c: Column | str) -> Column:
    """The text before the first '## ' line, then a section for each such line; blank ones go."""
    return F.filter(F.transform(F.split(_col(c), r"(?m)(?=^## )"), strip), lambda s: s != "")


def occurrences(text: Column | str, query: Column) -> Column:
    """How often the query stands in the text, case aside, not overlapping."""
    low, q = F.lower(_col(text)), F.lower(query)
    return F.when(F.length(q) == 0, F.lit(0)).otherwise(((F.length(low) - F.length(F.replace(low, q, F.lit("")))) / F.length(q)).cast("int"))


def clean_name(c: Column | str) -> Column:
    """A name from an accessible label: what stands before the first of , · |, without what tells of speaking or muting, and without the mark of unverified people."""
    first = F.get(F.split(_col(c), "[,·|]"), F.lit(0))
    said = F.regexp_replace(first, rf"(?i)\b({SPEAKING})\b.*$", "")
    return strip(F.regexp_replace(said, r"(?i)^(.*?)\(unverified\)", "$1"))
