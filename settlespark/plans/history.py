"""Merge collected archives into one leakage-safe set of source tables.

An archive is a collection window. Tables of all archives come as one DataFrame with an
``archive`` column; ``windows`` has ``archive, start_date, end_date`` and, for the checks,
``revision, failed_steps, audit_errors``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from settlespark.constants import ARCHIVE_REVISION, MERGE_REVISION
from settlespark.errors import GuardError
from settlespark.functions import clock
from settlespark.functions.values import prefixed
from settlespark.operators.point_in_time import latest_revision, require_no_future_information
from settlespark.operators.series import require_contiguous
from settlespark.operators.timeline import clock_difference, require_seam_days_only, seam_days, window_clock
from settlespark.session import durable, side_by_side
from settlespark.sources.tables import write_checked


def checked_windows(windows: DataFrame, first: str, end: str) -> DataFrame:
    """Archives that passed collection and together span ``[first, end)`` without gaps."""
    bad = windows.where(
        (F.col("revision") != ARCHIVE_REVISION) | (F.col("failed_steps") > 0) | (F.col("audit_errors") > 0)
    )
    if not bad.isEmpty():
        raise GuardError(f"archive did not pass collection: {bad.first().asDict()}")
    one = windows.withColumn("_all", F.lit(0))
    require_contiguous(one, "_all", "start_date", "end_date", first, end)
    return windows


def clocked(df: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per time of a source or of the expected clock, with what is wrong: conflicting repeats and gaps.

    One aggregation over both sides tells repeats, their conflicts and missing times together.
    """
    columns = [c for c in df.columns if c not in ("archive", "timestamp")]
    # Rows of one time conflict if they differ in any column; nulls are equal.
    mark = F.xxhash64(F.array(*[F.col(c).isNull() for c in columns]), *columns)
    body = df.select("timestamp", *columns, mark.alias("_mark"), F.lit(False).alias("_asked"))
    asked = expected.select("timestamp", F.lit(True).alias("_asked"))
    return body.unionByName(asked, allowMissingColumns=True).groupBy("timestamp").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in columns], F.bool_or("_asked").alias("_asked"),
        F.min("_mark").alias("_low"), F.max("_mark").alias("_high"))


CLOCK_SCRATCH = ["_asked", "_low", "_high"]


def clock_faults() -> list[Column]:
    found = {"conflicts": "_asked AND _low <> _high", "missing": "_asked AND _low IS NULL", "rows": "_asked AND _low IS NOT NULL"}
    return [F.count_if(F.expr(c)).alias(n) for n, c in found.items()]


def judge_clock(counts: dict, label: str, exact: bool = True) -> None:
    if counts["conflicts"]:
        raise GuardError(f"{label} has {counts['conflicts']} times with conflicting rows")
    if exact and counts["missing"]:
        raise GuardError(f"{label} does not match the expected clock: {counts['missing']} times are missing")


def on_clock(df: DataFrame, expected: DataFrame, label: str, exact: bool = True) -> DataFrame:
    """Rows on the expected clock, one per time; conflicting repeats and gaps fail."""
    rows = durable(clocked(df, expected))
    judge_clock(rows.agg(*clock_faults()).first().asDict(), label, exact)
    return rows.where("_asked AND _low IS NOT NULL").drop(*CLOCK_SCRATCH)


def point_in_time_embedded(
    revisions: DataFrame, windows: DataFrame, expected: DataFrame, hour: int = 13, minute: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Latest revision known at each period's issue time, and the excluded seam days.

    A whole day without an eligible revision is tolerated only where an archive starts.
    """
    issue = clock.issue_instant("timestamp", hour, minute)
    inside = revisions.drop("archive").join(expected.select("timestamp"), "timestamp", "left_semi")
    tie = [c for c in inside.columns if c not in ("timestamp", "published_at_utc")]
    chosen = latest_revision(inside, ["timestamp"], "published_at_utc", issue, tie=tie)
    chosen = durable(chosen.withColumn("selected_issue_time_utc", issue))
    missing = clock_difference(expected, chosen, ["timestamp"]).where("difference = 'missing'")
    # Seams are archive starts other than the first.
    edge = windows.agg(F.min("start_date")).first()[0]
    seams = windows.where(F.col("start_date") > F.lit(edge)).select(F.col("start_date").alias("seam_date"))
    excluded = require_seam_days_only(seam_days(missing, seams))
    require_no_future_information(chosen, "selected_issue_time_utc", ["published_at_utc"])
    return chosen, excluded


def hourly_weather_group(rows: DataFrame, group: str, end: str) -> DataFrame:
    """Hourly rows of the clock, prefixed, with the last hour carried to the exclusive end."""
    edge = clock.day_start(F.lit(end))
    twice = F.when(F.col("timestamp") == clock.add_seconds(edge, -3600), F.array(F.col("timestamp"), edge)).otherwise(F.array("timestamp"))
    return prefixed(rows.withColumn("timestamp", F.explode(twice)), f"weather_{group}_", ["timestamp", *CLOCK_SCRATCH])


def merge_archives(
    windows: DataFrame, tables: dict[str, DataFrame], first: str, end: str, output: str,
    half_hourly: Sequence[str] = ("price", "demand", "fuel", "interconnectors", "inertia"),
    weather: Sequence[str] = ("demand", "wind", "solar"), hour: int = 13, minute: int = 0,
) -> DataFrame:
    """Write the merged source tables under ``output`` and return a one-row summary.

    A half-hour clock is exact for every source after the seam days are taken out of all
    of them.
    """
    spark = windows.sparkSession
    checked_windows(windows, first, end)
    full = window_clock(spark, first, end)
    hours = window_clock(spark, first, end, step_s=3600)
    embedded, excluded = point_in_time_embedded(tables["embedded"], windows, full, hour, minute)
    excluded = durable(excluded)
    training = durable(full.join(excluded, "delivery_date", "left_anti"))

    def save(name, shape=lambda rows: rows, clock_rows=training, exact=True):
        counts = write_checked(shape(clocked(tables[name], clock_rows)), f"{output}/{name}", clock_faults(),
                               lambda n: judge_clock(n, name, exact), F.expr("_asked AND _low IS NOT NULL"), CLOCK_SCRATCH)
        return counts["rows"]

    jobs = {name: partial(save, name) for name in half_hourly}
    jobs |= {f"weather_{g}": partial(save, f"weather_{g}", lambda rows, g=g: hourly_weather_group(rows, g, end), hours) for g in weather}
    if "neighbour_prices" in tables:
        jobs["neighbour_prices"] = partial(save, "neighbour_prices", exact=False)
    jobs["embedded"] = lambda: write_checked(embedded, f"{output}/embedded", [F.count(F.lit(1)).alias("rows")], lambda n: None)["rows"]
    rows = side_by_side(spark, jobs)
    return spark.range(1).select(
        F.lit(MERGE_REVISION).alias("workflow_revision"),
        F.lit(first).alias("start_date_inclusive"), F.lit(end).alias("end_date_exclusive"),
        full.select(F.count(F.lit(1))).scalar().alias("full_calendar_half_hour_rows"),
        training.select(F.count(F.lit(1))).scalar().alias("training_half_hour_rows"),
        hours.select(F.count(F.lit(1))).scalar().alias("expected_hour_rows"),
        tables["embedded"].select(F.count(F.lit(1))).scalar().alias("embedded_raw_revision_rows"),
        excluded.select(F.sort_array(F.collect_list(clock.date_text("delivery_date")))).scalar().alias("excluded_settlement_dates_local"),
        F.create_map(*[F.lit(x) for n, c in sorted(rows.items()) for x in (n, c)]).alias("source_rows"),
    )
