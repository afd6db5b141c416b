"""Feature table of a delivery day, and the daily market report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from settlespark.errors import GuardError, need_columns
from settlespark.functions import clock
from settlespark.functions.features import calendar_features, position_limits, weather_features
from settlespark.functions.values import prefixed
from settlespark.operators.quality import issue_window_faults, require_no_nulls
from settlespark.operators.relations import join_many_to_one, require_aligned
from settlespark.operators.risk import energy_and_peaks, single_sources
from settlespark.operators.series import carry_to_boundary, interpolate_to
from settlespark.operators.timeline import settlement_spine
from settlespark.plans.collect import fallback_profile
from settlespark.session import durable


def weather_on_spine(weather: dict[str, DataFrame], spine: DataFrame) -> DataFrame:
    """Hourly weather of all groups on the half-hours of the spine; gaps are an error.

    The last hour is carried to the end of the span, as the final half-hour lies after it. All
    groups lie on one axis, which is interpolated once.
    """
    edge = spine.agg(clock.add_seconds(F.max("timestamp"), 1800)).first()[0]
    hourly, values = None, []
    for group, rows in weather.items():
        known = prefixed(rows.where(F.col("timestamp") <= F.lit(edge)), f"weather_{group}_", ["timestamp"])
        whole = carry_to_boundary(known.withColumn("_all", F.lit(0)), ["_all"], "timestamp", F.lit(edge)).drop("_all")
        hourly = whole if hourly is None else hourly.unionByName(whole, allowMissingColumns=True)
        values += [c for c in known.columns if c != "timestamp"]
    aligned = durable(interpolate_to(hourly, spine.select("timestamp"), [], "timestamp", values))
    return require_no_nulls(aligned, values, "weather")


def features_of_days(
    days: DataFrame, weather: dict[str, DataFrame], profile: str, features: Sequence[str],
    history: DataFrame | None = None, fallbacks: Sequence[str] = (),
) -> DataFrame:
    """Leakage-safe features of all ``days``, which have ``delivery_date`` and ``issue_time_utc``: 46, 48 or 50 rows each.

    ``history`` supplies the seven-day profile of the ``fallbacks`` components.
    """
    if not issue_window_faults(days, "issue_time_utc", "delivery_date").isEmpty():
        raise GuardError("the issue time must lie in the two days before the delivery day")
    out = spine = settlement_spine(days).drop("settlement_period")
    if weather:
        out = join_many_to_one(out, weather_on_spine(weather, spine), ["timestamp"], check=False)
    if fallbacks:
        if history is None:
            raise GuardError("the fallback components need recent history")
        out = fallback_profile(history, out, fallbacks)
    out = weather_features(calendar_features(out)).withColumn("model_profile", F.lit(profile))
    return require_no_nulls(out, features, "day features")


def day_features(
    spark, day: str, issue_utc: str, weather: dict[str, DataFrame], profile: str, features: Sequence[str],
    history: DataFrame | None = None, fallbacks: Sequence[str] = (),
) -> DataFrame:
    """``features_of_days`` for one delivery day."""
    days = spark.range(1).select(F.lit(day).cast("date").alias("delivery_date"), F.lit(issue_utc).cast("timestamp").alias("issue_time_utc"))
    return features_of_days(days, weather, profile, features, history, fallbacks)


# Columns of the half-hourly report and their source.
REPORT_COLUMNS = {
    "demand_mw": "demand_mw", "embedded_wind_mw": "embedded_wind_mw", "transmission_wind_mw": "transmission_wind_mw",
    "total_wind_mw": "total_wind_mw", "solar_mw": "embedded_solar_mw", "nuclear_mw": "nuclear_mw", "net_import_mw": "net_import_mw",
    "residual_before_nuclear_mw": "residual_before_nuclear_mw", "residual_after_nuclear_mw": "residual_after_nuclear_mw",
    "net_system_short_mw": "net_system_short_mw", "inertia_gvas": "inertia_gvas",
    "price_p10_gbp_mwh": "p10", "price_p50_gbp_mwh": "p50", "price_p90_gbp_mwh": "p90", "negative_price_probability": "negative_probability",
}


def half_hourly_report(system: DataFrame, price: DataFrame, keys: Sequence[str] = (), check: bool = True) -> DataFrame:
    """System and price forecast side by side, one row per settlement period."""
    on = [*keys, "timestamp"]
    quantiles = price.select(*on, "p10", "p50", "p90", "negative_probability")
    if check:
        require_aligned(system, quantiles, on)
    joined = system.join(quantiles, on)
    need_columns(joined, REPORT_COLUMNS.values(), "report input")
    return joined.select(
        *keys, clock.delivery_date("timestamp").alias("delivery_date"), clock.settlement_period("timestamp").alias("settlement_period"),
        clock.gb_time("timestamp").alias("gb_time"), *[F.col(s).alias(n) for n, s in REPORT_COLUMNS.items()],
    )


def daily_market_report(
    system: DataFrame, price: DataFrame, risk: DataFrame, keys: Sequence[str] = (), capital_gbp: float = 500_000.0,
    budget_fraction: float = 0.02, reference_mwh: float = 100.0,
) -> dict[str, DataFrame]:
    """Half-hourly table, daily energy and peaks, price summary and position limits.

    All days and models in ``keys`` are reported in the same jobs.
    """
    group = [*keys, "delivery_date"]
    day = {"delivery_date": clock.delivery_date("timestamp")}
    dated, priced = system.withColumns(day), price.withColumns(day)
    sources = [c.removeprefix("component_source_") for c in system.columns if c.startswith("component_source_")]
    tables = {
        "half_hourly": half_hourly_report(system, price, keys),
        "energy_and_peaks": energy_and_peaks(
            dated, group, "timestamp", ["demand_mw", "total_wind_mw", "embedded_solar_mw", "nuclear_mw", "net_import_mw"],
            ["demand_mw", "total_wind_mw", "embedded_solar_mw", "residual_after_nuclear_mw", "net_system_short_mw"], ["nuclear_mw"]),
        "price_extremes": energy_and_peaks(priced, group, "timestamp", [], ["p50"], ["p50"]),
        "price_summary": priced.groupBy(*group).agg(
            F.min("p50").alias("p50_min_gbp_mwh"), F.avg("p50").alias("p50_mean_gbp_mwh"), F.max("p50").alias("p50_max_gbp_mwh"),
            F.max("negative_probability").alias("maximum_negative_price_probability")),
        "position_limits": risk.withColumns(position_limits("scenario_var", "expected_shortfall", capital_gbp, budget_fraction, reference_mwh)),
    }
    if sources:
        tables["component_sources"] = single_sources(dated, group, sources)
    return tables
