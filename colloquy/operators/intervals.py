"""Joins over time: intervals from points, overlap joins, as-of and nearest joins.

Range joins are met in time buckets: both sides go to each bucket that they
touch, the join is an equi-join on keys and bucket, and a pair counts only in
the later of the two sides' first buckets. So a key with very many rows spreads
over its buckets, and no join is planned as a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 120.0


def _buckets(low: Column, high: Column, width: float) -> Column:
    first, last = F.floor(low / width), F.floor(high / width)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array(first))


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_bounds: tuple[Column, Column], right_bounds: tuple[Column, Column], condition: Column, width: float = BUCKET_SECONDS) -> DataFrame:
    """Pairs of equal keys whose (closed) bounds meet and that satisfy the condition; columns of both sides beside the keys must differ."""
    l_rows = left.withColumns({"_l0": F.floor(left_bounds[0] / width), "_bucket": F.explode(_buckets(*left_bounds, width))})
    r_rows = right.withColumns({"_r0": F.floor(right_bounds[0] / width), "_bucket": F.explode(_buckets(*right_bounds, width))})
    pairs = l_rows.join(r_rows, [*keys, "_bucket"]).filter((F.col("_bucket") == F.greatest("_l0", "_r0")) & condition)
    return pairs.drop("_bucket", "_l0", "_r0")


def speaking_intervals(readings: DataFrame, keys: Sequence[str] = ("meeting_id",), t: str = "t", order: str = "ord") -> DataFrame:
    """Each reading holds until the next one: rows with ``until``; the last one and those of no length go."""
    w = Window.partitionBy(*keys).orderBy(t, order)
    return readings.withColumn("until", F.lead(t).over(w)).filter(F.col("until") > F.col(t))


def overlap_by_name(segments: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("meeting_id",), width: float = BUCKET_SECONDS) -> DataFrame:
    """keys, ord, name, overlap and first (the order of the first interval that overlaps): seconds that each name speaks within each segment (start_time, end_time); intervals have t, until, name, ord."""
    sides = intervals.select(*keys, "t", "until", "name", F.col("ord").alias("_interval"))
    pairs = band_join(
        segments.select(*keys, "ord", "start_time", "end_time"), sides, keys, (F.col("start_time"), F.col("end_time")), (F.col("t"), F.col("until")),
        (F.col("start_time") < F.col("until")) & (F.col("end_time") > F.col("t")), width,
    )
    length = F.least("end_time", "until") - F.greatest("start_time", "t")
    return pairs.filter(length > 0).groupBy(*keys, "ord", "name").agg(F.sum(length).alias("overlap"), F.min("_interval").alias("first"))


def max_overlap(probes: DataFrame, targets: DataFrame, keys: Sequence[str] = ("meeting_id",), width: float = BUCKET_SECONDS) -> DataFrame:
    """keys, probe, target, overlap: the target with the greatest overlap (over 0, the lowest order on ties); both sides have ord, start_time, end_time."""
    p = probes.select(*keys, F.col("ord").alias("probe"), F.col("start_time").alias("p0"), F.col("end_time").alias("p1"))
    q = targets.select(*keys, F.col("ord").alias("target"), F.col("start_time").alias("q0"), F.col("end_time").alias("q1"))
    pairs = band_join(p, q, keys, (F.col("p0"), F.col("p1")), (F.col("q0"), F.col("q1")), (F.col("p0") < F.col("q1")) & (F.col("p1") > F.col("q0")), width)
    best = F.max(F.struct((F.least("p1", "q1") - F.greatest("p0", "q0")).alias("overlap"), (-F.col("target")).alias("back"))).alias("best")
    return pairs.groupBy(*keys, "probe").agg(best).filter("best.overlap > 0").select(*keys, "probe", (-F.col("best.back")).alias("target"), "best.overlap")


def nearest_gap(probes: DataFrame, targets: DataFrame, most: float, keys: Sequence[str] = ("meeting_id",), width: float = BUCKET_SECONDS) -> DataFrame:
    """keys, probe, target, gap: the target with the smallest gap below ``most`` seconds (the lowest order on ties)."""
    p = probes.select(*keys, F.col("ord").alias("probe"), F.col("start_time").alias("p0"), F.col("end_time").alias("p1"))
    q = targets.select(*keys, F.col("ord").alias("target"), F.col("start_time").alias("q0"), F.col("end_time").alias("q1"))
    gap = F.greatest(F.col("q0") - F.col("p1"), F.col("p0") - F.col("q1"))
    pairs = band_join(p, q, keys, (F.col("p0") - most, F.col("p1") + most), (F.col("q0"), F.col("q1")), gap < most, width)
    return pairs.groupBy(*keys, "probe").agg(F.min(F.struct(gap.alias("gap"), F.col("target"))).alias("best")).select(*keys, "probe", "best.target", "best.gap")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str, right_order: str, columns: Sequence[str], width: float | None = None) -> DataFrame:
    """left with struct ``match``: the last right row (by time, then order) at or before the left row's time, null where there is none.

    Both sides are merged in one window. With ``width``, windows are of (key,
    bucket of time), and the last right row before each bucket comes from a
    grouped maximum, so that a hot key spreads over its buckets.
    """
    width = width or 1e12
    payload = F.struct(F.col(right_t).alias("_t"), F.col(right_order).alias("_o"), *columns)
    rows = left.select(*keys, F.col(left_t).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    points = right.select(*keys, F.col(right_t).alias("_at"), F.lit(0).alias("_side"), F.col(right_order).alias("_order"), payload.alias("match"))
    both = rows.unionByName(points, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / width))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("match", F.last("match", ignorenulls=True).over(w)).filter("_side = 1")
    bucket = F.floor(F.col("_at") / width)
    ends = points.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(F.max("match").alias("_end"))
    every = found.select(*keys, "_bucket").distinct().join(ends, [*keys, "_bucket"], "full")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    merged = found.join(carried, [*keys, "_bucket"], "left").withColumn("match", F.coalesce("match", "_carry"))
    return merged.select("_left.*", F.struct(*(F.col(f"match.{c}") for c in columns)).alias("_m"), F.col("match").isNotNull().alias("_has")).withColumn(
        "match", F.when(F.col("_has"), F.col("_m"))
    ).drop("_m", "_has")


def edges(readings: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Only the rows whose value differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    return readings.withColumn("_before", before).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_n")


def with_closing(changes: DataFrame, stops: DataFrame, keys: Sequence[str], value: str, t: str) -> DataFrame:
    """changes, and for each key of stops (keys, stopped_at) one more row with its last value at that time: readings hold until the next one, so the last needs an end."""
    last = changes.groupBy(*keys).agg(F.max_by(value, t).alias(value))
    closing = last.join(stops, list(keys)).select(*keys, F.col("stopped_at").alias(t), value)
    return changes.select(*keys, t, value).unionByName(closing)


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column) -> DataFrame:
    """rows with ``island``: a number that grows at each row where ``breaks`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("island", F.sum(F.coalesce(breaks.cast("int"), F.lit(0))).over(w))


def debounced(rows: DataFrame, keys: Sequence[str], t: str, state: str, join_after: float, leave_after: float) -> DataFrame:
    """keys, since, until, state: changes of presence, believed where a run of equal polls lasts as long as needed, from its first poll to its last; t in seconds.

    A run that is too short belongs to the state before it, and nobody leaves who hasn't joined.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    runs = islands(rows.withColumn("_prev", F.lag(state).over(w)), keys, [t], ~F.col("_prev").eqNullSafe(F.col(state)))
    runs = runs.groupBy(*keys, "island").agg(F.min(t).alias("since"), F.max(t).alias("last"), F.first(state).alias("state"))
    sure = runs.filter(F.col("last") - F.col("since") >= F.when(F.col("state"), join_after).otherwise(leave_after))
    by_time = Window.partitionBy(*keys).orderBy("since")
    changes = sure.withColumn("_b", F.coalesce(F.lag("state").over(by_time), F.lit(False))).filter(F.col("_b") != F.col("state"))
    return changes.withColumn("until", F.lead("since").over(by_time)).select(*keys, "since", "until", "state")
