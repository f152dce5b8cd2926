"""Queries of quality scores, gates and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics, gates, grounding
from ..streaming import capture as streams
from . import inputs as i
from .inputs import sql
from .speaking import _containment

R6 = lambda c: F.round(c, 6).alias(c)


def asr_scores(spark, d):
    return gates.asr_scores(i.segments(spark, d)).select("meeting_id", R6("mean_confidence"), R6("p10_confidence"))


def tab_scores(spark, d):
    return gates.tab_scores(i.segments(spark, d)).select("meeting_id", R6("tab_mean_confidence"), R6("tab_p10_confidence"), "tab_segments")


def wer_proxy(spark, d):
    return gates.wer_proxy(i.segments(spark, d), i.captions(spark, d)).select("meeting_id", R6("caption_wer_proxy"))


def _gated(rows, column):
    return rows.select("meeting_id", F.col(f"{column}.fired").alias("fired"), F.coalesce(f"{column}.reason", F.lit("")).alias("reason"))


def _facts(spark, d):
    """Made-up scores of a meeting for each event."""
    e = i.read(spark, d, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("meeting_id"), (k * 7 % 40).cast("double").alias("unresolved"), ((k * 3 % 10) / 10).alias("margin"), F.when(k % 3 != 0, (k * 11 % 101).cast("double")).alias("agreement"),
        F.when(k % 6 != 0, (k * 13 % 101) / 100).alias("mean"), ((k * 17 % 101) / 100).alias("p10"), F.when(k % 4 != 0, (k * 19 % 101) / 100).alias("wer"), ((k * 23 % 101) / 100).alias("quality"),
        (k * 29 % 40).cast("double").alias("garbled"), (k % 5 != 0).alias("has_asr"), (k % 3).alias("tier"), F.when(k % 2 == 0, F.array(F.lit("mic"), F.lit("tab"))).otherwise(F.array(F.lit("mic"))).alias("sources"),
        (k % 4).alias("tab_n"), (k % 9 == 0).alias("flagged"), (k * 5 % 12).alias("claims"), (k * 31 % 7).alias("bad"), F.floor(k % 8 / 7).alias("critical"), (k % 2).alias("prior"),
        F.element_at(F.lit(["haiku", "sonnet", "opus"]), (k % 3 + 1).cast("int")).alias("draft"),
    )


FACTS = """facts AS (SELECT event_id AS meeting_id, CAST(event_id * 7 % 40 AS DOUBLE) AS unresolved, (event_id * 3 % 10) / 10.0::DOUBLE AS margin, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id * 11 % 101 AS DOUBLE) END AS agreement,
  CASE WHEN event_id % 6 <> 0 THEN (event_id * 13 % 101) / 100.0::DOUBLE END AS mean, (event_id * 17 % 101) / 100.0::DOUBLE AS p10, CASE WHEN event_id % 4 <> 0 THEN (event_id * 19 % 101) / 100.0::DOUBLE END AS wer, (event_id * 23 % 101) / 100.0::DOUBLE AS quality,
  CAST(event_id * 29 % 40 AS DOUBLE) AS garbled, event_id % 5 <> 0 AS has_asr, event_id % 3 AS tier, event_id % 2 = 0 AS has_tab, event_id % 4 AS tab_n, event_id % 9 = 0 AS flagged, event_id * 31 % 7 AS bad,
  event_id * 5 % 12 AS claims, (event_id % 8) // 7 AS critical, event_id % 2 AS prior, ['haiku', 'sonnet', 'opus'][event_id % 3 + 1] AS draft FROM events)"""


def gate_a(spark, d):
    return _gated(_facts(spark, d).withColumn("g", gates.gate_a(F.col("unresolved"), F.col("margin"), F.col("agreement"))), "g")


def gate_reasons(spark, d):
    f, rate = _facts(spark, d), F.col("bad") / F.greatest(F.col("claims"), F.lit(1))
    told = {
        "A": gates.told_gate_a(F.col("unresolved") + F.lit(0.26), F.col("margin"), F.col("agreement")),
        "B": gates.told_gate_b(*map(F.col, ("tier", "sources", "tab_n", "flagged", "mean", "p10"))),
        "C": gates.told_gate_c(*map(F.col, ("mean", "p10", "wer", "quality", "garbled", "has_asr"))),
        "E": gates.told_gate_e(F.col("bad"), F.col("critical"), rate, F.col("prior"), F.col("draft")),
    }
    return f.select("meeting_id", F.explode(F.create_map(*(x for k, c in told.items() for x in (F.lit(k), c)))).alias("gate", "reason"))


def gate_b(spark, d):
    return _gated(_facts(spark, d).withColumn("g", gates.gate_b(*map(F.col, ("tier", "sources", "tab_n", "flagged", "mean", "p10")))), "g")


def gate_c(spark, d):
    return _gated(_facts(spark, d).withColumn("g", gates.gate_c(*map(F.col, ("mean", "p10", "wer", "quality", "garbled", "has_asr")))), "g")


def gate_d(spark, d):
    return _facts(spark, d).select("meeting_id", gates.gate_d(F.col("bad")).alias("fired"))


def gate_e(spark, d):
    rate = F.col("bad") / F.greatest(F.col("claims"), F.lit(1))
    g = gates.gate_e(F.col("bad"), F.col("critical"), rate, F.col("prior"), F.col("draft"))
    return _facts(spark, d).select("meeting_id", g["action"].alias("action"), F.coalesce(g["tier"], F.lit("")).alias("tier"), gates.publish_status(F.col("bad")).alias("status"))


def audio_wait(spark, d):
    f = _facts(spark, d)
    return f.select("meeting_id", gates.audio_wait(F.col("flagged"), F.col("unresolved") * 60, F.when(F.col("tier") != 0, F.col("garbled"))).alias("action"))


def raised_tier(spark, d):
    return _facts(spark, d).select("meeting_id", gates.raised_tier(F.col("draft"), F.col("flagged")).alias("tier"))


def last_gate(spark, d):
    return gates.last_decision(i.gate_log(spark, d), "gateC")


def prior_gate(spark, d):
    return gates.prior_evaluations(i.gate_log(spark, d)).select("meeting_id", "eval_ix", "prior")


def escalated(spark, d):
    log = i.gate_log(spark, d)
    tiers = log.select("meeting_id").distinct().withColumn("tier", F.when(F.col("meeting_id") % 4 == 0, "sonnet").otherwise("haiku"))
    return gates.escalated(log, tiers)


def fleet_rates(spark, d):
    e = i.events(spark, d).withColumns({"escalated": F.col("value") > 50, "needs_review": F.col("event_type") == "error"})
    return gates.fleet_rates(e).select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "n", R6("escalation_rate"), R6("review_rate"), "escalation_alarm", "review_alarm")


def fleet_hours(spark, d):
    """The rates of large events by hour, with the hours that have none."""
    e = i.events(spark, d).filter("value > 90").withColumns({"escalated": F.col("value") > 50, "needs_review": F.col("event_type") == "error"})
    rows = gates.every_hour(gates.fleet_rates(e))
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "n", R6("escalation_rate"), R6("review_rate"), "escalation_alarm", "review_alarm")


def verification_tally(spark, d):
    return grounding.verification_tally(i.claims(spark, d)).select("meeting_id", "supported", "partial", "uncertain", "unsupported", R6("unsupported_rate"), "critical_unsupported")


def critical_claims(spark, d):
    c = i.claims(spark, d).withColumn("turn_ord", F.col("claim_ix") % 13)
    marks = c.filter("turn_ord % 5 = 0").select("meeting_id", "turn_ord")
    return grounding.mark_critical(c, marks).select("meeting_id", "claim_ix", "critical")


def unsupported_claims(spark, d):
    c = i.claims(spark, d)
    meetings = c.select("meeting_id").distinct().withColumn("status", F.when(F.col("meeting_id") % 2 == 0, "needs_review").otherwise("ready"))
    return grounding.unsupported_claims(c, meetings).select("meeting_id", "claim_ix")


def quote_validation(spark, d):
    """Each benchmark item as a quote, against the lines of all documents."""
    quotes = i.read(spark, d, "benchmark").select(F.lit(0).alias("k"), F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    turns = i.lines(spark, d).select(F.lit(0).alias("k"), (F.col("doc_id") * 100_000 + F.col("ord")).alias("ord"), "text")
    return grounding.find_quotes(quotes, turns, ["k"]).select("quote_id", "turn_ord", R6("score"))


def quote_containment(spark, d):
    """The first half of each turn's words, backwards every third, against the turn itself."""
    w = tx.words("text")
    half = F.slice(w, F.lit(1), F.greatest(F.floor(F.size(w) / 2).cast("int"), F.lit(1)))
    rows = i.turns(spark, d).select("meeting_id", "ord", F.array_join(F.when(F.col("ord") % 3 == 0, F.reverse(half)).otherwise(half), " ").alias("q"), "text")
    score = tx.sliding_containment(tx.tokens("q"), tx.tokens("text"))
    return rows.select("meeting_id", "ord", F.round(score, 6).alias("score"))


def bullet_match(spark, d):
    t = i.turns(spark, d)
    pairs = t.alias("a").join(t.alias("b"), (F.col("a.meeting_id") == F.col("b.meeting_id")) & (F.col("b.ord") == F.col("a.ord") + 1))
    return pairs.select(F.col("a.meeting_id").alias("meeting_id"), F.col("a.ord").alias("ord"), grounding.bullet_matches(F.col("a.text"), F.when(F.col("a.ord") % 3 == 0, F.substring_index("a.text", " ", 9)).otherwise(F.concat_ws(" ", F.substring_index("a.text", " ", 5), F.substring_index("b.text", " ", 4)))).alias("matches"))


def claim_grounding(spark, d):
    c = i.claims(spark, d).select("meeting_id", "claim_ix", "verdict")
    hits = c.filter("claim_ix % 3 <> 0").select("meeting_id", F.col("claim_ix").alias("quote_id"), (F.col("claim_ix") % 8).alias("turn_ord"))
    again = c.filter("claim_ix % 3 = 0").select("meeting_id", "claim_ix", F.when(F.col("claim_ix") % 2 == 0, "PARTIAL").otherwise("UNSUPPORTED").alias("verdict"))
    hits2 = again.filter("claim_ix % 4 = 0").select("meeting_id", F.col("claim_ix").alias("quote_id"), F.lit(2).alias("turn_ord"))
    return grounding.ground_claims(c, hits, again, hits2).select("meeting_id", "claim_ix", "verdict", F.col("turn_ord").cast("long").alias("turn_ord"))


def recall_report(spark, d):
    t = i.turns(spark, d).select("text", (F.col("ord") % 5 != 0).alias("seen"), (F.col("ord") % 3 != 0).alias("stable"), (F.col("ord") % 7 != 0).alias("emitted"))
    overall, lost = analytics.recall_report(t, ["seen", "stable", "emitted"])
    ratios = overall.select(F.lit("overall").alias("stage"), F.lit(None).cast("long").alias("lines"), F.lit(None).cast("long").alias("words"), R6("line_recall"), R6("word_recall"))
    return ratios.unionByName(lost.select("stage", "lines", "words"), allowMissingColumns=True)


def silence_sessions(spark, d):
    rows = streams.silence_sessions(i.events(spark, d), "6 hours", None, ("user_id",))
    return rows.select("user_id", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"), "captions")


def signal_health(spark, d):
    kind = F.when(F.col("event_type") == "click", "caption").when(F.col("event_type") == "view", "ring").otherwise("read")
    rows = streams.signal_health(i.events(spark, d).withColumn("kind", kind), ("user_id",))
    return rows.select("user_id", "captions_seen", "ring_seen", "reads", F.date_format("last_heartbeat", "yyyy-MM-dd HH:mm:ss").alias("last_heartbeat"))


QUERIES = {f.__name__: f for f in (
    asr_scores, tab_scores, wer_proxy, gate_a, gate_reasons, gate_b, gate_c, gate_d, gate_e, audio_wait, raised_tier, last_gate, prior_gate, escalated, fleet_rates, fleet_hours, verification_tally,
    critical_claims, unsupported_claims, quote_validation, quote_containment, bullet_match, claim_grounding, recall_report, silence_sessions, signal_health,
)}


def facts(query: str) -> str:
    return f"WITH {FACTS}\n{query}"


def chain(*steps: tuple[str, bool, str]) -> str:
    fired = " ".join(f"WHEN {c} THEN {str(v).lower()}" for c, v, _ in steps)
    reason = " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in steps)
    return facts(f"SELECT meeting_id, CASE {fired} ELSE false END AS fired, CASE {reason} ELSE '' END AS reason FROM facts")


_P10 = "coalesce(list_sort(list({c}) FILTER ({c} IS NOT NULL))[1 + CAST(floor(0.1 * (count({c}) - 1)) AS BIGINT)], 0)"
_BULLET = "CASE WHEN p.ord % 3 = 0 THEN array_to_string(string_split(p.text, ' ')[1:9], ' ') ELSE array_to_string(string_split(p.text, ' ')[1:5], ' ') || ' ' || array_to_string(string_split(q.text, ' ')[1:4], ' ') END"
ORACLES = {
    "asr_scores": sql(f"SELECT meeting_id, round(coalesce(avg(confidence), 0), 6) AS mean_confidence, round({_P10.format(c='confidence')}, 6) AS p10_confidence FROM segments WHERE source <> 'caption' GROUP BY 1", "base", "segments"),
    "tab_scores": sql(f"SELECT meeting_id, round(coalesce(avg(c), 0), 6) AS tab_mean_confidence, round({_P10.format(c='c')}, 6) AS tab_p10_confidence, count(*) FILTER (source = 'tab') AS tab_segments FROM (SELECT *, CASE WHEN source = 'tab' THEN confidence END AS c FROM segments) GROUP BY 1", "base", "segments"),
    "wer_proxy": sql(f"""SELECT meeting_id, round(1 - 2 * sum(least(a, b)) / (sum(a) + sum(b)), 6) AS caption_wer_proxy FROM (SELECT meeting_id, t, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b FROM
        (SELECT meeting_id, t, count(*) AS n FROM (SELECT meeting_id, unnest({i.tokens('text')}) AS t FROM captions WHERE final) GROUP BY ALL) x FULL JOIN
        (SELECT meeting_id, t, count(*) AS n FROM (SELECT meeting_id, unnest({i.tokens('text')}) AS t FROM segments WHERE source <> 'caption') GROUP BY ALL) y USING (meeting_id, t)) GROUP BY 1 HAVING sum(a) > 0 AND sum(b) > 0""", "base", "segments", "captions"),
    "gate_a": chain(("unresolved > 15", True, "unresolved"), ("margin < 0.3", True, "margin"), ("agreement < 80", True, "agreement")),
    "gate_reasons": facts("""SELECT meeting_id, 'A' AS gate, CASE WHEN unresolved + 0.26 > 15 THEN printf('unresolvedPct %.1f > 15', unresolved + 0.26) WHEN margin < 0.3 THEN printf('labelMarginMin %.2f < 0.3', margin)
        WHEN agreement < 80 THEN printf('captionAgreementPct %.1f < 80', agreement) END AS reason FROM facts
        UNION ALL SELECT meeting_id, 'B', CASE WHEN tier <> 2 THEN 'no upload consent (tier < 2): re-ASR unavailable' WHEN NOT has_tab THEN 'no tab audio declared at finalize' WHEN tab_n = 0 THEN 'no tab ASR segments: batch merge has nothing to attach to'
        WHEN flagged THEN 'meeting flagged important' WHEN mean < 0.8 THEN printf('tabMeanConfidence %.2f < 0.8', mean) WHEN p10 < 0.5 THEN printf('tabP10Confidence %.2f < 0.5', p10) END FROM facts
        UNION ALL SELECT meeting_id, 'C', CASE WHEN mean IS NULL AND has_asr THEN 'no asr scores: conservative tier' WHEN mean < 0.8 THEN printf('meanConfidence %.2f < 0.8', mean) WHEN p10 < 0.5 THEN printf('p10Confidence %.2f < 0.5', p10)
        WHEN wer > 0.35 THEN printf('captionWerProxy %.2f > 0.35', wer) WHEN quality < 0.5 THEN printf('self-report qualityScore %.2f', quality) WHEN garbled > 20 THEN printf('self-report garbledPct %.1f', garbled) END FROM facts
        UNION ALL SELECT meeting_id, 'E', CASE WHEN bad = 0 THEN '0 unsupported' WHEN rate <= 0.1 AND critical = 0 AND prior = 0 THEN told || ' ≤ 0.1, no critical: targeted repair' WHEN rate <= 0.1 AND critical = 0 THEN told || ', no critical: acceptable residual'
        ELSE CASE WHEN critical > 0 THEN critical || ' critical claim(s) unsupported' ELSE told || ' > 0.1' END || CASE draft WHEN 'haiku' THEN ': escalate to sonnet' WHEN 'sonnet' THEN ': escalate to opus' ELSE ': ladder exhausted, publish needs_review' END END
        FROM (SELECT *, bad / greatest(claims, 1)::DOUBLE AS rate, printf('unsupportedRate %.2f', bad / greatest(claims, 1)::DOUBLE + 1e-9) AS told FROM facts)"""),
    "gate_b": chain(("tier <> 2", False, "no consent"), ("NOT has_tab", False, "no tab audio"), ("tab_n = 0", False, "no tab segments"), ("flagged", True, "flagged"), ("mean < 0.8", True, "mean"), ("p10 < 0.5", True, "p10")),
    "gate_c": chain(("mean IS NULL AND has_asr", True, "no scores"), ("mean < 0.8", True, "mean"), ("p10 < 0.5", True, "p10"), ("wer > 0.35", True, "wer"), ("quality < 0.5", True, "self quality"), ("garbled > 20", True, "garbled")),
    "gate_d": facts("SELECT meeting_id, bad > 0 AS fired FROM facts"),
    "gate_e": facts("""SELECT meeting_id, action, CASE WHEN action = 'synthesize' THEN CASE draft WHEN 'haiku' THEN 'sonnet' ELSE 'opus' END ELSE '' END AS tier, CASE WHEN bad = 0 THEN 'ready' ELSE 'needs_review' END AS status FROM
        (SELECT *, CASE WHEN bad = 0 THEN 'publish' WHEN bad / greatest(claims, 1) <= 0.1 AND critical = 0 THEN CASE WHEN prior = 0 THEN 'repair' ELSE 'publish' END WHEN draft IN ('haiku', 'sonnet') THEN 'synthesize' ELSE 'publish' END AS action FROM facts)"""),
    "audio_wait": facts("SELECT meeting_id, CASE WHEN flagged THEN 'ready' WHEN coalesce(unresolved * 60 - CASE WHEN tier <> 0 THEN garbled END <= 1200, false) THEN 'wait' ELSE 'timeout' END AS action FROM facts"),
    "raised_tier": facts("SELECT meeting_id, CASE WHEN draft = 'haiku' AND flagged THEN 'sonnet' ELSE draft END AS tier FROM facts"),
    "last_gate": sql("SELECT meeting_id, coalesce(arg_max(fired, eval_ix) FILTER (gate = 'gateC'), true) AS fired FROM gate_log GROUP BY 1", "gate_log"),
    "prior_gate": sql("SELECT meeting_id, eval_ix, count(*) FILTER (gate = 'gateE') OVER (PARTITION BY meeting_id ORDER BY eval_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM gate_log", "gate_log"),
    "escalated": sql("SELECT meeting_id, meeting_id % 4 = 0 OR bool_or(fired AND gate <> 'gateD') AS escalated FROM gate_log GROUP BY 1", "gate_log"),
    "fleet_rates": "SELECT *, escalation_rate > 0.25 AS escalation_alarm, review_rate > 0.15 AS review_alarm FROM (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS escalation_rate, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS review_rate FROM events GROUP BY 1)",
    "fleet_hours": """WITH r AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END) AS e, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS v FROM events WHERE value > 90 GROUP BY 1),
        hours AS (SELECT unnest(generate_series((SELECT min(h) FROM r), (SELECT max(h) FROM r), INTERVAL 1 HOUR)) AS h)
        SELECT strftime(h, '%Y-%m-%d %H:%M') AS hour, coalesce(n, 0) AS n, round(e, 6) AS escalation_rate, round(v, 6) AS review_rate, coalesce(e > 0.25, false) AS escalation_alarm, coalesce(v > 0.15, false) AS review_alarm FROM hours LEFT JOIN r USING (h)""",
    "verification_tally": sql("SELECT meeting_id, count(*) FILTER (verdict = 'SUPPORTED') AS supported, count(*) FILTER (verdict = 'PARTIAL') AS partial, count(*) FILTER (verdict = 'UNCERTAIN') AS uncertain, count(*) FILTER (verdict = 'UNSUPPORTED') AS unsupported, round(avg(CASE WHEN verdict = 'UNSUPPORTED' THEN 1.0 ELSE 0 END), 6) AS unsupported_rate, count(*) FILTER (verdict = 'UNSUPPORTED' AND critical) AS critical_unsupported FROM claims GROUP BY 1", "claims"),
    "critical_claims": sql("SELECT meeting_id, claim_ix, critical OR claim_ix % 13 IN (0, 5, 10) AS critical FROM claims", "claims"),
    "unsupported_claims": sql("SELECT meeting_id, claim_ix FROM claims WHERE verdict = 'UNSUPPORTED' AND meeting_id % 2 = 0", "claims"),
    "quote_validation": "WITH lines AS MATERIALIZED (" + i.CTES["lines"] + f"""),
        q AS MATERIALIZED (SELECT item_id AS quote_id, {i.tokens('text')} AS n FROM benchmark),
        l AS MATERIALIZED (SELECT doc_id * 100000 + ord AS turn_ord, {i.tokens('text')} AS h FROM lines),
        qt AS (SELECT quote_id, len(list_distinct(n)) - 0.2 * len(n) AS need, unnest(list_distinct(n)) AS t FROM q), lt AS (SELECT turn_ord, unnest(list_distinct(h)) AS t FROM l WHERE len(h) > 0),
        near AS MATERIALIZED (SELECT quote_id, turn_ord FROM qt JOIN lt USING (t) GROUP BY quote_id, turn_ord HAVING count(*) >= max(need)),
        scored AS (SELECT quote_id, turn_ord, {_containment('n', 'h')} AS score FROM near JOIN q USING (quote_id) JOIN l USING (turn_ord))
        SELECT quote_id, arg_max(turn_ord, (score, -turn_ord)) AS turn_ord, round(max(score), 6) AS score FROM scored WHERE score >= 0.8 GROUP BY 1""",
    "quote_containment": sql(rf"""SELECT meeting_id, ord, round({_containment('n', 'h')}, 6) AS score FROM (SELECT meeting_id, ord, {i.tokens('q')} AS n, {i.tokens('text')} AS h FROM
        (SELECT meeting_id, ord, text, array_to_string(CASE WHEN ord % 3 = 0 THEN list_reverse(half) ELSE half END, ' ') AS q FROM (SELECT *, w[1 : greatest(len(w) // 2, 1)] AS half FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM turns))))""", "base", "turns"),
    "bullet_match": sql(f"""SELECT meeting_id, ord, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a) OR coalesce(len(list_intersect(x, y)) / nullif(least(len(x), len(y)), 0), 0) >= 0.6) AS matches FROM
        (SELECT *, list_distinct(list_filter(string_split(a, ' '), lambda t: length(t) > 3)) AS x, list_distinct(list_filter(string_split(b, ' '), lambda t: length(t) > 3)) AS y FROM
        (SELECT p.meeting_id, p.ord, {i.norm('p.text')} AS a, {i.norm(_BULLET)} AS b FROM turns p JOIN turns q ON p.meeting_id = q.meeting_id AND q.ord = p.ord + 1))""", "base", "turns"),
    "claim_grounding": sql("""SELECT meeting_id, claim_ix, CASE WHEN verdict = 'UNSUPPORTED' THEN verdict WHEN claim_ix % 3 <> 0 THEN verdict WHEN claim_ix % 4 = 0 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS verdict,
        CASE WHEN verdict = 'UNSUPPORTED' THEN NULL WHEN claim_ix % 3 <> 0 THEN claim_ix % 8 WHEN claim_ix % 4 = 0 THEN 2 END AS turn_ord FROM claims""", "claims"),
    "recall_report": sql("""SELECT coalesce(stage, 'overall') AS stage, CASE WHEN stage IS NOT NULL THEN lines END AS lines, CASE WHEN stage IS NOT NULL THEN words END AS words, CASE WHEN stage IS NULL THEN round(lines / sum(lines) OVER (), 6) END AS line_recall,
        CASE WHEN stage IS NULL THEN round(words / sum(words) OVER (), 6) END AS word_recall FROM (SELECT stage, count(*) AS lines, CAST(sum(words) AS BIGINT) AS words FROM
        (SELECT CASE WHEN ord % 5 = 0 THEN 'seen' WHEN ord % 3 = 0 THEN 'stable' WHEN ord % 7 = 0 THEN 'emitted' END AS stage, words FROM base) GROUP BY 1)""", "base"),
    "silence_sessions": "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS until, count(*) AS captions FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events)) GROUP BY user_id, s",
    "signal_health": "SELECT user_id, bool_or(event_type = 'click') AS captions_seen, bool_or(event_type = 'view') AS ring_seen, count(*) FILTER (event_type NOT IN ('click', 'view')) AS reads, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_heartbeat FROM events GROUP BY 1",
}
