"""Settlement clocks: spines, gap checks, completeness and clock differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from settlespark.constants import HALF_HOUR_S
from settlespark.errors import GuardError
from settlespark.functions import clock
from settlespark.operators.blocks import GRID_BLOCK, row_lags


def with_settlement_columns(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """UTC and local time, delivery date and period number of each row."""
    return df.withColumns({
        "timestamp_utc": clock.instant(ts), "timestamp_local": clock.local_time(ts),
        "delivery_date": clock.delivery_date(ts), "settlement_period": clock.settlement_period(ts),
    })


def dates_between(df: DataFrame, first: str, end: str, out: str = "delivery_date") -> DataFrame:
    """One row per date in ``[first, end)`` for each input row."""
    dates = F.sequence(F.col(first).cast("date"), F.date_sub(F.col(end).cast("date"), 1))
    return df.withColumn(out, F.explode(dates))


def settlement_spine(days: DataFrame, day: str = "delivery_date", step_s: int = HALF_HOUR_S) -> DataFrame:
    """All period starts of each local day: 46, 48 or 50 half-hours."""
    start, end = clock.seconds(clock.day_start(day)), clock.seconds(clock.day_end(day))
    ticks = F.sequence(start, end - step_s, F.lit(step_s).cast("long"))
    return (
        days.select("*", F.posexplode(ticks).alias("_i", "_s"))
        .withColumn("timestamp", F.timestamp_seconds("_s"))
        .withColumn("settlement_period", F.col("_i") + 1)
        .drop("_i", "_s")
    )


def window_clock(spark, first: str, end: str, step_s: int = HALF_HOUR_S) -> DataFrame:
    """Expected clock of a ``[first, end)`` window of local dates."""
    span = spark.range(1).select(F.lit(first).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    days = dates_between(span, "a", "b").drop("a", "b")
    return settlement_spine(days, step_s=step_s)


def clock_violations(df: DataFrame, keys: Sequence[str], ts: str, step_s: int = HALF_HOUR_S) -> DataFrame:
    """Duplicates and gaps per series against a regular clock."""
    prior = row_lags(df.select(*keys, ts), keys, ts, {"_before": (ts, 1)}, block_s=GRID_BLOCK)
    gap = clock.seconds(ts) - clock.seconds("_before")
    return prior.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(gap == 0).alias("duplicate_count"),
        F.count_if((gap != 0) & (gap != step_s)).alias("gap_count"),
        F.max(gap).alias("largest_gap_s"),
    )


def require_regular_clock(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    bad = clock_violations(df, keys, ts).where("duplicate_count > 0 or gap_count > 0")
    if not bad.isEmpty():
        raise GuardError(f"clock is not regular: {bad.first().asDict()}")
    return df


def clock_difference(expected: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """Clock times on one side only, flagged ``missing`` or ``extra``.

    One aggregation over the union replaces two anti-joins.
    """
    on = list(on)
    tagged = (
        expected.select(*on, F.lit(True).alias("_e"), F.lit(False).alias("_a"))
        .unionByName(actual.select(*on, F.lit(False).alias("_e"), F.lit(True).alias("_a")))
    )
    sides = tagged.groupBy(*on).agg(F.bool_or("_e").alias("_e"), F.bool_or("_a").alias("_a"))
    return (
        sides.where(F.col("_e") != F.col("_a"))
        .withColumn("difference", F.when(F.col("_e"), "missing").otherwise("extra"))
        .drop("_e", "_a")
    )


def without_days(clock_df: DataFrame, days: DataFrame, day: str = "delivery_date") -> DataFrame:
    """Clock minus whole excluded days."""
    return clock_df.join(days.select(day).distinct(), day, "left_anti")


def period_completeness(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Distinct periods seen per series and local day, against the day's own length.

    Two aggregation levels: the first is keyed by the period itself, so a hot day spreads.
    """
    keys = list(keys)
    seen = df.select(*keys, F.col(ts).alias("_t")).groupBy(*keys, "_t").count()
    daily = seen.groupBy(*keys, clock.delivery_date("_t").alias("delivery_date")).agg(
        F.count("_t").alias("observed_periods"), F.sum("count").alias("row_count")
    )
    return daily.withColumn("expected_periods", clock.periods_in_day("delivery_date").cast("long")).withColumn(
        "missing_periods", F.col("expected_periods") - F.col("observed_periods")
    )


def missing_dates(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Calendar dates absent between the first and last date of each series.

    Each date is unfolded to the absent ones before it, so only dates that are there are shuffled. A series
    has at most as many of them as the calendar. A null key equals no other: all dates of its span are absent.
    """
    keys = list(keys)
    seen = df.select(*keys, F.col(day).cast("date").alias("_d")).where("_d IS NOT NULL").distinct()
    after = F.date_add(F.lag("_d").over(Window.partitionBy(*keys).orderBy("_d")), 1)
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    gaps = seen.select(*keys, F.when(named, after).otherwise(F.coalesce(after, "_d")).alias("_a"), F.when(named, F.date_sub("_d", 1)).otherwise(F.col("_d")).alias("_z"))
    return gaps.where("_a <= _z").select(*keys, F.explode(F.sequence("_a", "_z")).alias("missing_date"))


def seam_days(missing: DataFrame, seams: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Missing periods by local day, classified against the allowed seam dates.

    ``excluded`` days are missing as a whole and lie on a seam; anything else is a fault.
    ``seams`` has one ``seam_date`` column.
    """
    daily = missing.groupBy(clock.delivery_date(ts).alias("delivery_date")).agg(
        F.count_distinct(ts).alias("missing_rows")
    )
    at = seams.select(F.col("seam_date").cast("date").alias("delivery_date"), F.lit(True).alias("_seam")).distinct()
    whole = F.col("missing_rows") == clock.periods_in_day("delivery_date")
    verdict = (
        F.when(F.col("_seam").isNull(), "outside_seam").when(whole, "excluded").otherwise("partial_day")
    )
    return daily.join(at, "delivery_date", "left").withColumn("verdict", verdict).drop("_seam")


def require_seam_days_only(days: DataFrame) -> DataFrame:
    """The excluded days, or an error when any missing day is not a whole seam day."""
    bad = days.where("verdict <> 'excluded'")
    if not bad.isEmpty():
        raise GuardError(f"missing periods cannot be excluded: {bad.first().asDict()}")
    return days.select("delivery_date")
