"""Numbers, times, arrays and JSON as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet of sortable ids, and that of Spark's base 32.
ID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Short month names for dates in lists.
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def round_half_up(c: Column) -> Column:
    """Rounds halves toward plus infinity, for negative numbers too."""
    return F.floor(c + 0.5)


def mmss(seconds: Column) -> Column:
    """mm:ss, both padded."""
    whole = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("int"), whole % 60)


def clock(seconds: Column) -> Column:
    """m:ss, minutes not padded."""
    whole = F.floor(F.greatest(seconds, F.lit(0))).cast("int")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("int"), whole % 60)


def duration(seconds: Column) -> Column:
    """Whole seconds (rounded first) below a minute, minutes below an hour, else hours and minutes."""
    s = F.greatest(round_half_up(seconds), F.lit(0))
    minutes = round_half_up(s / 60).cast("int")
    hours = F.floor(minutes / 60).cast("int")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(minutes % 60 == 0, F.concat(hours.cast("string"), F.lit(" h")))
        .otherwise(F.concat(hours.cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min")))
    )


def date_prefix(iso: Column) -> Column:
    return F.left(iso, F.lit(10))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def epoch_date(seconds: Column) -> Column:
    """The day; none for 0, which stands for an unknown time."""
    return F.when(seconds != 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))


def short_date(ts: Column) -> Column:
    """Day, short month name and year."""
    month = F.element_at(F.lit(list(MONTHS)), F.month(ts))
    return F.concat_ws(" ", F.dayofmonth(ts).cast("string"), month, F.year(ts).cast("string"))


def short_time(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def short_date_time(ts: Column) -> Column:
    return F.concat(short_date(ts), F.lit(", "), short_time(ts))


def in_days(ts: Column, first: Column, last: Column | None = None) -> Column:
    """Whether ts falls on the days from first to last, both included; one day if last is missing or null."""
    end = first if last is None else F.coalesce(last, first)
    return (ts >= F.date_trunc("day", first)) & (ts < F.date_trunc("day", end) + F.expr("INTERVAL 1 DAY"))


def id_time(millis: Column) -> Column:
    """The ten leading characters of a sortable id: time in base 32; orders as the time does."""
    return F.translate(F.lpad(F.conv(millis.cast("string"), 10, 32), 10, "0"), CONV_DIGITS, ID_DIGITS)


def toggle(xs: Column, x: Column) -> Column:
    """xs without x, or with x added where it was missing."""
    return F.when(F.array_contains(xs, x), F.array_remove(xs, x)).otherwise(F.array_append(xs, x))


def renamed(xs: Column, old: Column, new: Column) -> Column:
    return F.transform(xs, lambda x: F.when(x == old, new).otherwise(x))


def last_n(xs: Column, n: int) -> Column:
    return F.slice(xs, F.greatest(F.size(xs) - n + 1, F.lit(1)), n)


def patched(old: Column, patch: Column) -> Column:
    """A map with the patch's entries over the old ones."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(patch, k))
    return F.when(old.isNull(), patch).when(patch.isNull(), old).otherwise(F.map_concat(kept, patch))


def json_or(c: Column, schema: str, default: Column) -> Column:
    """The parsed JSON, or the default where it doesn't parse."""
    return F.coalesce(F.from_json(c, schema), default)


def cursor(*parts: Column) -> Column:
    """An opaque page cursor: base64 of the JSON array of the last key."""
    return F.base64(F.to_json(F.array(*(p.cast("string") for p in parts))).cast("binary"))


def cursor_parts(c: Column) -> Column:
    return F.from_json(F.unbase64(c).cast("string"), "array<string>")


def token_expiry(token: Column) -> Column:
    """Seconds of the ``exp`` claim of a signed web token; null where there is none."""
    body = F.translate(F.get(F.split(token, "[.]"), F.lit(1)), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.exp").cast("long")


def rendered_json(c: Column) -> Column:
    """JSON with fields in the order of the schema, nulls kept: equal values give equal text."""
    return F.to_json(c, {"ignoreNullFields": "false"})
