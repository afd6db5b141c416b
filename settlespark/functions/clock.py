"""Settlement-clock expressions.

A London delivery day has 46, 48 or 50 half-hours. A period number counts elapsed
half-hours since local midnight, so it is computed from instants, never from
wall-clock differences. All functions are plain column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from settlespark.constants import HALF_HOUR_S, LONDON


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(c) -> Column:
    """UTC instant of a timestamp, naive timestamp or text column."""
    return col(c).cast("timestamp")


def naive(c) -> Column:
    """UTC instant as a timestamp without zone, for output."""
    return col(c).cast("timestamp_ntz")


def seconds(c) -> Column:
    return F.unix_seconds(instant(c))


def add_seconds(c, n) -> Column:
    """Instant plus ``n`` seconds, keeping microseconds."""
    n = F.lit(n) if not isinstance(n, Column) else n
    return F.timestamp_micros(F.unix_micros(instant(c)) + n.cast("long") * F.lit(1_000_000))


def floor_to(c, width_s: int) -> Column:
    s = seconds(c)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(width_s)))


def half_hour(c) -> Column:
    return floor_to(c, HALF_HOUR_S)


def local_time(c) -> Column:
    return F.from_utc_timestamp(instant(c), LONDON)


def delivery_date(c) -> Column:
    return F.to_date(local_time(c))


def day_start(day) -> Column:
    """UTC instant at which a London calendar day starts."""
    return F.to_utc_timestamp(col(day).cast("date").cast("timestamp"), LONDON)


def day_end(day) -> Column:
    return day_start(F.date_add(col(day).cast("date"), 1))


def periods_in_day(day) -> Column:
    return ((seconds(day_end(day)) - seconds(day_start(day))) / HALF_HOUR_S).cast("int")


def settlement_period(c) -> Column:
    elapsed = seconds(c) - seconds(day_start(delivery_date(c)))
    return (F.floor(elapsed / HALF_HOUR_S) + 1).cast("int")


def settlement_instant(day, period) -> Column:
    """UTC instant of a period of a local day; null when the day lacks the period."""
    p = col(period).cast("int")
    start = seconds(day_start(day)) + (p - 1) * HALF_HOUR_S
    return F.when((p >= 1) & (p <= periods_in_day(day)), F.timestamp_seconds(start))


def source_or_settlement_instant(start_text, day, period) -> Column:
    """Prefer the source's own start time; fall back to day and period row by row."""
    return F.coalesce(parse_instant(start_text), settlement_instant(day, period))


def parse_instant(text) -> Column:
    """Lenient text to instant; unreadable text is null. Seconds may be absent."""
    t = col(text).cast("string")
    whole = F.regexp_replace(t, r"([T ]\d{1,2}:\d{2})(?=Z|[+-]|\s*$)", "$1:00")
    return F.coalesce(t.try_cast("timestamp"), whole.try_cast("timestamp"))


def issue_instant(delivery, hour: int = 13, minute: int = 0, wall_clock: bool = False) -> Column:
    """Issue time on the day before delivery.

    The default counts absolute hours from delivery midnight minus 24 hours. For issue
    times after the clock change this is the same wall-clock time; ``wall_clock=True``
    makes it so for any hour.
    """
    if not (0 <= hour <= 23 and 0 <= minute <= 59):
        raise ValueError("issue time out of range")
    day = delivery_date(delivery)
    offset = hour * 3600 + minute * 60
    if wall_clock:
        local = F.timestamp_seconds(seconds(F.date_sub(day, 1).cast("timestamp")) + F.lit(offset))
        return F.to_utc_timestamp(local, LONDON)
    return F.timestamp_seconds(seconds(day_start(day)) - F.lit(24 * 3600 - offset))


def lead_hours(issue, delivery) -> Column:
    return (F.unix_micros(instant(delivery)) - F.unix_micros(instant(issue))) / F.lit(3_600_000_000.0)


def gb_time(c) -> Column:
    return F.date_format(local_time(c), "HH:mm")


def gb_label(c) -> Column:
    """Local time with its zone name, e.g. ``2026-07-15 13:00 BST``."""
    zone = F.when(local_time(c) == instant(c), F.lit("GMT")).otherwise(F.lit("BST"))
    return F.concat_ws(" ", F.date_format(local_time(c), "yyyy-MM-dd HH:mm"), zone)


def utc_text(c) -> Column:
    """Canonical text key of an instant."""
    return F.date_format(instant(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_text(c) -> Column:
    return F.date_format(col(c).cast("date"), "yyyy-MM-dd")


def duration_minutes(text, strict: bool = True) -> Column:
    """Minutes of ``PT..H..M``; any other text is an error, or null without ``strict``."""
    t = col(text)
    def part(unit):
        # A leading zero makes an absent part read as zero, without a failed cast.
        return F.concat(F.lit("0"), F.regexp_extract(t, rf"(\d+){unit}", 1)).cast("int")
    total = part("H") * 60 + part("M")
    readable = t.rlike(r"^PT(\d+H)?(\d+M)?$") & (total > 0)
    return (
        F.when(t.isNull(), F.lit(None).cast("int"))
        .when(t == "PT60M", 60).when(t == "PT30M", 30).when(t == "PT15M", 15)  # the usual steps need no pattern
        .when(readable, total)
        .otherwise((F.raise_error(F.concat(F.lit("unsupported duration "), t)) if strict else F.lit(None)).cast("int"))
    )


def date_chunks(first, end, days: int) -> Column:
    """Array of non-overlapping ``[start, end)`` date pairs covering ``[first, end)``."""
    if days < 1:
        raise ValueError("chunks need at least one day")
    a, b = col(first).cast("date"), col(end).cast("date")
    starts = F.sequence(a, F.date_sub(b, 1), F.expr(f"interval {int(days)} days"))
    pairs = F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.least(F.date_add(s, days), b).alias("end"))
    )
    return F.when(b > a, pairs).otherwise(
        F.raise_error(F.lit("window end must be later than its start")).cast(
            "array<struct<start:date,end:date>>"
        )
    )
