"""Feature and physics expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from settlespark.constants import NON_FEATURES, REALISED_COLUMNS
from settlespark.errors import need_columns
from settlespark.functions.clock import col, local_time


def arcsinh_price(value, scale: float = 50.0) -> Column:
    """Signed price transform."""
    if scale <= 0:
        raise ValueError("scale must be positive")
    return F.asinh(col(value) / F.lit(float(scale)))


def price_from_arcsinh(value, scale: float = 50.0) -> Column:
    if scale <= 0:
        raise ValueError("scale must be positive")
    return F.sinh(col(value)) * F.lit(float(scale))


def calendar_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Cyclical half-hour, weekday and year features on the London clock."""
    local = local_time(ts)
    slot = F.hour(local) * 2 + F.floor(F.minute(local) / 30)
    weekday = F.weekday(local)
    turn = {"hh": slot / 48.0, "dow": weekday / 7.0, "year": F.dayofyear(local) / 365.25}
    waves = {
        f"{name}_{fn.__name__}": fn(F.lit(2 * math.pi) * part)
        for name, part in turn.items() for fn in (F.sin, F.cos)
    }
    return df.withColumns({
        **waves,
        "is_weekend": (weekday >= 5).cast("int"),
        "month": F.month(local),
    })


# Base temperatures of heating and cooling degrees.
HEATING_BASE_C, COOLING_BASE_C = 15.5, 22.0
# Nominal grid frequency, the level that warns, and the drop in Hz for each GW that response leaves uncovered.
NOMINAL_HZ, WARNING_HZ, HZ_PER_GW = 50.0, 49.2, 0.02


def weather_features(df: DataFrame) -> DataFrame:
    """Heating and cooling degrees and cubed wind speed, for the columns present."""
    new = {}
    if "temperature_c" in df.columns:
        new["hdd"] = F.greatest(F.lit(HEATING_BASE_C) - F.col("temperature_c"), F.lit(0.0))
        new["cdd"] = F.greatest(F.col("temperature_c") - F.lit(COOLING_BASE_C), F.lit(0.0))
        for name in ("hdd", "cdd"):
            new[name] = F.when(F.col("temperature_c").isNotNull(), new[name])
    if "wind_speed_ms" in df.columns:
        wind = F.when(F.col("wind_speed_ms").isNotNull(), F.greatest(F.col("wind_speed_ms"), F.lit(0.0)))
        new["wind_speed_cubed"] = wind * wind * wind
    return df.withColumns(new) if new else df


def balance_layers(df: DataFrame, require_battery: bool = False) -> DataFrame:
    """Residual-demand layers; battery output is used when the table has it."""
    parts = ["demand_mw", "embedded_wind_mw", "embedded_solar_mw", "transmission_wind_mw",
             "nuclear_mw", "net_import_mw"]
    need_columns(df, parts + (["battery_net_mw"] if require_battery else []), "balance input")
    wind = F.col("embedded_wind_mw") + F.col("transmission_wind_mw")
    renewable = wind + F.col("embedded_solar_mw")
    before = F.col("demand_mw") - renewable
    after = before - F.col("nuclear_mw")
    short = after - F.col("net_import_mw")
    if "battery_net_mw" in df.columns:
        short = short - F.col("battery_net_mw")
    return df.withColumns({
        "total_wind_mw": wind, "renewable_mw": renewable,
        "residual_before_nuclear_mw": before, "residual_after_nuclear_mw": after,
        "net_system_short_mw": short,
    })


def potential_layers(df: DataFrame) -> DataFrame:
    """Full balance plus potentials and nuclear modulation where their inputs exist."""
    out = balance_layers(df, require_battery=True)
    new = {}
    if "curtailed_wind_mw" in df.columns:
        new["wind_potential_mw"] = F.col("total_wind_mw") + F.col("curtailed_wind_mw")
    if "curtailed_solar_mw" in df.columns:
        new["solar_potential_mw"] = F.col("embedded_solar_mw") + F.col("curtailed_solar_mw")
    if "nuclear_available_mw" in df.columns:
        gap = F.col("nuclear_available_mw") - F.col("nuclear_mw")
        new["nuclear_modulation_mw"] = F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))
    return out.withColumns(new) if new else out


def prepare_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Calendar, weather and, when all components are present, balance layers."""
    out = weather_features(calendar_features(df, ts))
    full = {"demand_mw", "embedded_wind_mw", "embedded_solar_mw", "transmission_wind_mw",
            "nuclear_mw", "net_import_mw", "battery_net_mw"}
    return potential_layers(out) if full <= set(out.columns) else out


def numeric_features(df: DataFrame, exclude=None, keep_realised: bool = False) -> list[str]:
    """Numeric and boolean columns that a day-ahead model may use."""
    banned = set(NON_FEATURES if exclude is None else exclude)
    if not keep_realised:
        banned |= REALISED_COLUMNS
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [n for n, t in df.dtypes if (t in kinds or t.startswith("decimal")) and n not in banned]


def frequency_screen(
    inertia, largest_loss_mw: float, response_mw: float, delivery_s: float = 1.0,
    nominal_hz: float = NOMINAL_HZ, warning_hz: float = WARNING_HZ,
) -> dict[str, Column]:
    """Rate of change of frequency, nadir estimate and low-frequency warning."""
    stored = F.when(col(inertia).isNotNull(), F.greatest(col(inertia).cast("double"), F.lit(1.0)))
    shortfall_gw = max(largest_loss_mw - response_mw, 0.0) / 1000.0
    rocof = F.lit(-nominal_hz * largest_loss_mw / 1000.0) / (F.lit(2.0) * stored)
    nadir = F.lit(nominal_hz) - F.abs(rocof) * F.lit(delivery_s) - F.lit(HZ_PER_GW * shortfall_gw)
    return {
        "initial_rocof_hz_per_s": rocof,
        "estimated_nadir_hz": nadir,
        "low_frequency_warning": nadir < F.lit(warning_hz),
    }


def position_limits(
    var, shortfall, capital_gbp: float, budget_fraction: float, reference_mwh: float,
) -> dict[str, Column]:
    """Largest volumes that stay inside the daily risk budget."""
    if capital_gbp <= 0 or not 0 < budget_fraction <= 1 or reference_mwh <= 0:
        raise ValueError("capital, budget fraction and reference position must be positive")
    budget = capital_gbp * budget_fraction
    v, e = col(var), col(shortfall)
    bad = F.raise_error(F.lit("VaR and expected shortfall must be positive")).cast("double")
    by_var = F.when(v > 0, F.lit(reference_mwh * budget) / v).otherwise(bad)
    by_es = F.when(e > 0, F.lit(reference_mwh * budget) / e).otherwise(bad)
    return {
        "daily_risk_budget_gbp": F.lit(budget),
        "var_budget_utilisation_percent": F.lit(100.0) * v / F.lit(budget),
        "es_budget_utilisation_percent": F.lit(100.0) * e / F.lit(budget),
        "maximum_volume_var_mwh": by_var,
        "maximum_volume_expected_shortfall_mwh": by_es,
        "maximum_volume_binding_mwh": F.least(by_var, by_es),
    }
