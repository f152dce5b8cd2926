"""Quotes and claims against the transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

SUPPORTED, PARTIAL, UNSUPPORTED, UNCERTAIN = "SUPPORTED", "PARTIAL", "UNSUPPORTED", "UNCERTAIN"
BULLET_LEAST = 0.6
#: Probes that are sent to all tasks at most; beyond, both sides are shuffled.
SMALL_PROBES = 200_000


def find_quotes(quotes: DataFrame, turns: DataFrame, keys: list[str] | None = None, least: float = tx.QUOTE_LEAST) -> DataFrame:
    """keys, quote_id, turn_ord, score: for each quote the turn (of equal keys) that holds it best, at least ``least``; the first turn on ties.

    quotes: keys, quote_id, quote. turns: keys, ord, text. Only turns that share
    one of the quote's rarer tokens are compared: a containment of ``least``
    needs that share of the quote's tokens, so at least one of any
    floor((1 - least) n) + 1 of them is in the turn. Of those turns, the ones that hold
    that share of its tokens at all go to the sliding window.
    """
    keys = ["meeting_id"] if keys is None else keys
    q = quotes.select(*keys, "quote_id", tx.tokens("quote").alias("needle")).filter(F.size("needle") > 0)
    t = turns.select(*keys, F.col("ord").alias("turn_ord"), tx.tokens("text").alias("hay"))
    # the longest tokens stand for the rarer ones; repeats in the quote count, so probes are taken from the multiset
    by_length = F.transform(F.sort_array(F.transform("needle", lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x")))), lambda s: s["x"])
    need = F.floor((1 - least) * F.size("needle") + 1e-9).cast("int") + 1
    q = q.withColumn("probes", F.array_distinct(F.slice(by_length, F.lit(1), need)))
    probes = q.select(*keys, "quote_id", F.explode("probes").alias("probe"))
    # a bounded number of probes goes to the turns, which then stay where they are and are tokenized once; else only ids of pairs travel
    small = not quotes.isStreaming and probes.limit(SMALL_PROBES + 1).count() <= SMALL_PROBES
    if small:
        held = t.select(*keys, "turn_ord", "hay", F.explode(F.array_distinct("hay")).alias("probe"))
        met = held.join(F.broadcast(probes), [*keys, "probe"]).join(F.broadcast(q), [*keys, "quote_id"])
        # a pair counts at the first of the quote's probes that the turn holds
        pairs = met.filter(F.get(F.array_intersect("probes", "hay"), F.lit(0)) == F.col("probe"))
    else:
        held = t.select(*keys, "turn_ord", F.explode(F.array_distinct("hay")).alias("probe"))
        met = held.join(probes, [*keys, "probe"]).select(*keys, "quote_id", "turn_ord").distinct()
        pairs = met.join(q, [*keys, "quote_id"]).join(t, [*keys, "turn_ord"])
    pairs = pairs.filter(F.size(F.filter("needle", lambda x: F.array_contains("hay", x))) >= least * F.size("needle") - 1e-9)
    scored = pairs.select(*keys, "quote_id", "turn_ord", tx.sliding_containment("needle", "hay").alias("score")).filter(F.col("score") >= least)
    best = scored.groupBy(*keys, "quote_id").agg(F.max(F.struct("score", (-F.col("turn_ord")).alias("back"))).alias("b"))
    return best.select(*keys, "quote_id", (-F.col("b.back")).alias("turn_ord"), F.col("b.score").alias("score"))


def locate(quotes: DataFrame, clean: DataFrame, raw: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """find_quotes() in the clean turns, and in the raw segments for quotes that aren't there; with column ``place``."""
    keys = ["meeting_id"] if keys is None else keys
    first = find_quotes(quotes, clean, keys).withColumn("place", F.lit("clean"))
    rest = quotes.join(first.select(*keys, "quote_id"), [*keys, "quote_id"], "left_anti")
    return first.unionByName(find_quotes(rest, raw, keys).withColumn("place", F.lit("raw")))


def validate_items(items: DataFrame, hits: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items with a hit, their turn replaced by the hit's; counts kept and dropped by key). items have quote_id."""
    keys = ["meeting_id"] if keys is None else keys
    joined = items.join(hits.select(*keys, "quote_id", "turn_ord"), [*keys, "quote_id"], "left")
    counts = joined.groupBy(*keys).agg(F.count("turn_ord").alias("kept"), F.count_if(F.col("turn_ord").isNull()).alias("dropped"))
    return joined.filter(F.col("turn_ord").isNotNull()), counts


def ground_claims(claims: DataFrame, hits: DataFrame, rejudged: DataFrame, rejudged_hits: DataFrame) -> DataFrame:
    """claims (meeting_id, claim_ix, verdict, quote) with the final verdict and turn_ord.

    An unsupported claim stays so. Another needs a quote that is in the
    transcript; else its second judgement (same meeting and place) counts if its
    quote is there, and the claim is unsupported if not.
    """
    rows = claims.join(hits.select("meeting_id", F.col("quote_id").alias("claim_ix"), F.col("turn_ord").alias("hit")), ["meeting_id", "claim_ix"], "left")
    again = rejudged.select("meeting_id", "claim_ix", F.col("verdict").alias("verdict2")).join(
        rejudged_hits.select("meeting_id", F.col("quote_id").alias("claim_ix"), F.col("turn_ord").alias("hit2")), ["meeting_id", "claim_ix"]
    )
    rows = rows.join(again, ["meeting_id", "claim_ix"], "left")
    stays = F.col("verdict") == UNSUPPORTED
    first = F.col("hit").isNotNull()
    second = F.col("hit2").isNotNull() & (F.col("verdict2") != UNSUPPORTED)
    return rows.select(
        *(c for c in claims.columns if c != "verdict"),
        F.when(stays, UNSUPPORTED).when(first, F.col("verdict")).when(second, F.col("verdict2")).otherwise(UNSUPPORTED).alias("verdict"),
        F.when(stays, None).when(first, F.col("hit")).when(second, F.col("hit2")).alias("turn_ord"),
    )


def mark_critical(claims: DataFrame, critical_turns: DataFrame) -> DataFrame:
    """claims with critical set where their turn is one of the critical ones (keys meeting_id, turn_ord); never cleared."""
    marks = critical_turns.select("meeting_id", "turn_ord").distinct().withColumn("_mark", F.lit(True))
    joined = claims.join(marks, ["meeting_id", "turn_ord"], "left")
    return joined.withColumn("critical", F.coalesce("critical", F.lit(False)) | F.coalesce("_mark", F.lit(False))).drop("_mark")


def verification_tally(claims: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = ["meeting_id"] if keys is None else keys
    bad = F.col("verdict") == UNSUPPORTED
    return claims.groupBy(*keys).agg(
        F.count_if(F.col("verdict") == SUPPORTED).alias("supported"),
        F.count_if(F.col("verdict") == PARTIAL).alias("partial"),
        F.count_if(F.col("verdict") == UNCERTAIN).alias("uncertain"),
        F.count_if(bad).alias("unsupported"),
        F.avg(bad.cast("double")).alias("unsupported_rate"),
        F.count_if(bad & F.coalesce(F.col("critical"), F.lit(False))).alias("critical_unsupported"),
    )


def unsupported_claims(claims: DataFrame, meetings: DataFrame) -> DataFrame:
    """The unsupported claims of meetings that need a review."""
    return claims.filter(F.col("verdict") == UNSUPPORTED).join(meetings.filter("status = 'needs_review'").select("meeting_id"), "meeting_id", "left_semi")


def bullet_matches(claim: Column, bullet: Column, least: float = BULLET_LEAST) -> Column:
    """One text contains the other, or they share enough of their longer words (over 3 letters)."""
    a, b = tx.normalize(claim), tx.normalize(bullet)
    keep = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) > 3))
    x, y = keep(a), keep(b)
    smaller = F.least(F.size(x), F.size(y))
    share = F.size(F.array_intersect(x, y)) / F.when(smaller > 0, smaller)
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a) | (F.coalesce(share, F.lit(0.0)) >= least))
