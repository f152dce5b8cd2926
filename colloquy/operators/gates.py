"""Recognition scores and the decision gates over them: each gate is a chain of conditions with a reason code.

A score that is null did not exist and is skipped; a zero score counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Thresholds as deployed.
A_UNRESOLVED, A_MARGIN, A_AGREEMENT = 15.0, 0.3, 80.0
B_MEAN, B_P10 = 0.8, 0.5
C_MEAN, C_P10, C_WER, C_QUALITY, C_GARBLED = 0.8, 0.5, 0.35, 0.5, 20.0
E_RATE = 0.1
AUDIO_WAIT = 1200.0
TIERS = ("haiku", "sonnet", "opus")
ESCALATION_ALARM, REVIEW_ALARM = 0.25, 0.15


def _p10(column: str) -> Column:
    """The value at place floor(0.1 (n - 1)) of the sorted values, which is the discrete percentile; nulls don't count."""
    return F.expr(f"percentile_disc(0.1) WITHIN GROUP (ORDER BY {column})")


def asr_scores(segments: DataFrame) -> DataFrame:
    """meeting_id, mean_confidence, p10_confidence of the segments that aren't captions; 0 where none has a confidence; no row without such segments."""
    asr = segments.filter("source <> 'caption'")
    return asr.groupBy("meeting_id").agg(
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.coalesce(_p10("confidence"), F.lit(0.0)).alias("p10_confidence")
    )


def tab_scores(segments: DataFrame) -> DataFrame:
    tab = F.when(F.col("source") == "tab", F.col("confidence"))
    rows = segments.withColumn("_tab", tab)
    return rows.groupBy("meeting_id").agg(
        F.coalesce(F.avg("_tab"), F.lit(0.0)).alias("tab_mean_confidence"),
        F.coalesce(_p10("_tab"), F.lit(0.0)).alias("tab_p10_confidence"),
        F.count_if(F.col("source") == "tab").alias("tab_segments"),
    )


def wer_proxy(segments: DataFrame, captions: DataFrame) -> DataFrame:
    """meeting_id, caption_wer_proxy: 1 - 2 |A and B| / (|A| + |B|) over the token multisets of final captions and recognised segments; no row if either is empty."""

    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("meeting_id", F.explode(tx.tokens("text")).alias("token")).groupBy("meeting_id", "token").agg(F.count("*").alias(name))

    a, b = counts(captions.filter("final"), "in_captions"), counts(segments.filter("source <> 'caption'"), "in_segments")
    both = a.join(b, ["meeting_id", "token"], "full").na.fill(0, ["in_captions", "in_segments"])
    sums = both.groupBy("meeting_id").agg(F.sum("in_captions").alias("a"), F.sum("in_segments").alias("b"), F.sum(F.least("in_captions", "in_segments")).alias("hits"))
    return sums.filter("a > 0 AND b > 0").select("meeting_id", (1 - 2 * F.col("hits") / (F.col("a") + F.col("b"))).alias("caption_wer_proxy"))


def _chain(*steps: tuple[Column, bool, str], otherwise: tuple[bool, str | None] = (False, None)) -> Column:
    fired, reason = F.lit(otherwise[0]), F.lit(otherwise[1]).cast("string")
    for condition, value, why in reversed(steps):
        fired = F.when(condition, F.lit(value)).otherwise(fired)
        reason = F.when(condition, F.lit(why)).otherwise(reason)
    return F.struct(fired.alias("fired"), reason.alias("reason"))


def gate_a(unresolved_pct: Column, margin: Column, agreement: Column) -> Column:
    """Speaker repair."""
    return _chain((unresolved_pct > A_UNRESOLVED, True, "unresolved"), (margin < A_MARGIN, True, "margin"), (agreement < A_AGREEMENT, True, "agreement"))


def _told(name: str, form: str, value: Column, sign: str, bound: float) -> Column:
    return F.format_string(f"{name} {form} {sign} {bound:g}", value)


def told_gate_a(unresolved_pct: Column, margin: Column, agreement: Column) -> Column:
    """The reason of gate_a as text with the value and its bound; null where it doesn't fire."""
    return (
        F.when(unresolved_pct > A_UNRESOLVED, _told("unresolvedPct", "%.1f", unresolved_pct, ">", A_UNRESOLVED))
        .when(margin < A_MARGIN, _told("labelMarginMin", "%.2f", margin, "<", A_MARGIN)).when(agreement < A_AGREEMENT, _told("captionAgreementPct", "%.1f", agreement, "<", A_AGREEMENT))
    )


def told_gate_b(consent_tier: Column, sources: Column, tab_segments: Column, flagged: Column, mean: Column, p10: Column) -> Column:
    """The reason of gate_b, whether it fires or is closed; null where all is well. Texts are fixed values."""
    return (
        F.when(~consent_tier.eqNullSafe(F.lit(2)), "no upload consent (tier < 2): re-ASR unavailable")
        .when(~F.coalesce(F.array_contains(sources, "tab"), F.lit(False)), "no tab audio declared at finalize")
        .when(tab_segments == 0, "no tab ASR segments: batch merge has nothing to attach to")
        .when(F.coalesce(flagged, F.lit(False)), "meeting flagged important")
        .when(mean < B_MEAN, _told("tabMeanConfidence", "%.2f", mean, "<", B_MEAN)).when(p10 < B_P10, _told("tabP10Confidence", "%.2f", p10, "<", B_P10))
    )


def told_gate_c(mean: Column, p10: Column, wer: Column, quality: Column, garbled: Column, has_asr: Column) -> Column:
    """The reason of gate_c; null where it doesn't fire. Texts are fixed values."""
    return (
        F.when(mean.isNull() & has_asr, "no asr scores: conservative tier")
        .when(mean < C_MEAN, _told("meanConfidence", "%.2f", mean, "<", C_MEAN)).when(p10 < C_P10, _told("p10Confidence", "%.2f", p10, "<", C_P10))
        .when(wer > C_WER, _told("captionWerProxy", "%.2f", wer, ">", C_WER))
        .when(quality < C_QUALITY, F.format_string("self-report qualityScore %.2f", quality)).when(garbled > C_GARBLED, F.format_string("self-report garbledPct %.1f", garbled))
    )


def told_gate_e(unsupported: Column, critical: Column, rate: Column, prior: Column, tier: Column) -> Column:
    """The reason of gate_e's action. Texts are fixed values."""
    at = F.format_string("unsupportedRate %.2f", rate)
    mild = (rate <= E_RATE) & (critical == 0)
    trigger = F.when(critical > 0, F.concat(critical.cast("string"), F.lit(" critical claim(s) unsupported"))).otherwise(F.concat(at, F.lit(f" > {E_RATE:g}")))
    end = F.when(tier == "haiku", ": escalate to sonnet").when(tier == "sonnet", ": escalate to opus").otherwise(": ladder exhausted, publish needs_review")
    return (
        F.when(unsupported == 0, "0 unsupported")
        .when(mild & (prior == 0), F.concat(at, F.lit(f" ≤ {E_RATE:g}, no critical: targeted repair"))).when(mild, F.concat(at, F.lit(", no critical: acceptable residual")))
        .otherwise(F.concat(trigger, end))
    )


def gate_b(consent_tier: Column, sources: Column, tab_segments: Column, flagged: Column, mean: Column, p10: Column) -> Column:
    """A second recognition pass; closed without consented, declared tab audio."""
    return _chain(
        (~consent_tier.eqNullSafe(F.lit(2)), False, "no consent"),
        (~F.coalesce(F.array_contains(sources, "tab"), F.lit(False)), False, "no tab audio"),
        (tab_segments == 0, False, "no tab segments"),
        (F.coalesce(flagged, F.lit(False)), True, "flagged"),
        (mean < B_MEAN, True, "mean"),
        (p10 < B_P10, True, "p10"),
    )


def audio_wait(ready: Column, now: Column, anchor: Column) -> Column:
    """'ready', 'timeout' or 'wait'; an unknown age counts as timed out."""
    young = F.coalesce(now - anchor <= AUDIO_WAIT, F.lit(False))
    return F.when(F.coalesce(ready, F.lit(False)), "ready").when(~young, "timeout").otherwise("wait")


def gate_c(mean: Column, p10: Column, wer: Column, quality: Column, garbled: Column, has_asr: Column) -> Column:
    """The larger model for synthesis."""
    return _chain(
        (mean.isNull() & has_asr, True, "no scores"),
        (mean < C_MEAN, True, "mean"),
        (p10 < C_P10, True, "p10"),
        (wer > C_WER, True, "wer"),
        (quality < C_QUALITY, True, "self quality"),
        (garbled > C_GARBLED, True, "garbled"),
    )


def raised_tier(hint: Column, fired: Column) -> Column:
    return F.when((hint == "haiku") & fired, "sonnet").otherwise(hint)


def gate_d(dropped: Column) -> Column:
    return dropped > 0


def gate_e(unsupported: Column, critical: Column, rate: Column, prior: Column, tier: Column) -> Column:
    """struct of action (publish, repair, synthesize) and tier to go to."""
    mild = (rate <= E_RATE) & (critical == 0)
    action = F.when(unsupported == 0, "publish").when(mild & (prior == 0), "repair").when(mild, "publish").when(tier.isin("haiku", "sonnet"), "synthesize").otherwise("publish")
    up = F.when(tier == "haiku", "sonnet").when(tier == "sonnet", "opus")
    return F.struct(action.alias("action"), F.when(action == "synthesize", up).alias("tier"))


def publish_status(unsupported: Column) -> Column:
    return F.when(unsupported == 0, "ready").otherwise("needs_review")


def last_decision(decisions: DataFrame, gate: str, default: bool = True) -> DataFrame:
    """meeting_id, fired of the last evaluation of a gate; the default where it was never evaluated. decisions: meeting_id, eval_ix, gate, fired."""
    own = F.col("gate") == gate
    return decisions.groupBy("meeting_id").agg(F.coalesce(F.max_by(F.when(own, F.col("fired")), F.when(own, F.col("eval_ix"))), F.lit(default)).alias("fired"))


def prior_evaluations(decisions: DataFrame, gate: str = "gateE") -> DataFrame:
    """decisions with prior: evaluations of the gate in the meeting before each."""
    w = Window.partitionBy("meeting_id").orderBy("eval_ix").rowsBetween(Window.unboundedPreceding, -1)
    return decisions.withColumn("prior", F.count(F.when(F.col("gate") == gate, 1)).over(w))


def escalated(decisions: DataFrame, tiers: DataFrame) -> DataFrame:
    """meeting_id, escalated: a tier above the first, or one of gates A, B, C, E fired."""
    fired = decisions.groupBy("meeting_id").agg(F.bool_or(F.col("fired") & F.col("gate").isin("gateA", "gateB", "gateC", "gateE")).alias("fired"))
    return tiers.join(fired, "meeting_id", "left").select("meeting_id", ((F.col("tier") != "haiku") | F.coalesce("fired", F.lit(False))).alias("escalated"))


def fleet_rates(points: DataFrame, ts: str = "ts", escalated: str = "escalated", review: str = "needs_review") -> DataFrame:
    """hour, n, escalation_rate, review_rate, and whether each alarm is on; hours without points have no row."""
    hourly = points.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("n"), F.avg(F.col(escalated).cast("double")).alias("escalation_rate"), F.avg(F.col(review).cast("double")).alias("review_rate"))
    return hourly.select(
        F.col("w.start").alias("hour"), "n", "escalation_rate", "review_rate",
        (F.col("escalation_rate") > ESCALATION_ALARM).alias("escalation_alarm"), (F.col("review_rate") > REVIEW_ALARM).alias("review_alarm"),
    )


def every_hour(rates: DataFrame) -> DataFrame:
    """rates with the hours between the first and the last that have no points: n is 0, no rate, and no alarm, as missing data doesn't breach."""
    span = rates.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).filter("a IS NOT NULL")
    hours = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    off = {c: F.coalesce(c, F.lit(False)) for c in ("escalation_alarm", "review_alarm")}
    return hours.join(rates, "hour", "left").withColumns({"n": F.coalesce("n", F.lit(0)), **off})
