"""Fixed values that results depend on. Stated once, in natural order."""

LONDON = "Europe/London"
HALF_HOUR_S = 1800

# Component columns of the two modelling profiles.
FULL_COMPONENTS = [
    "demand_mw", "embedded_wind_mw", "embedded_solar_mw", "transmission_wind_mw",
    "nuclear_mw", "net_import_mw", "battery_net_mw", "inertia_gvas",
]
CORE_COMPONENTS = [c for c in FULL_COMPONENTS if c != "battery_net_mw"]
SIGNED_COMPONENTS = {"net_import_mw", "battery_net_mw"}
BALANCE_LAYERS = [
    "total_wind_mw", "renewable_mw", "residual_before_nuclear_mw",
    "residual_after_nuclear_mw", "net_system_short_mw",
]

# Profile names written into tables.
PROFILE_FULL = "full"
PROFILE_CORE = "core_without_battery"

# Columns that are never model features: keys, targets and layers derived from targets.
NON_FEATURES = {
    "timestamp", "timestamp_utc", "timestamp_local", "delivery_time_utc",
    "delivery_date", "issue_time_utc", "price_gbp_mwh", "marginal_technology",
    "model_profile", *FULL_COMPONENTS, *BALANCE_LAYERS,
}
# Realised outcomes that would leak into a day-ahead model when used as features.
REALISED_COLUMNS = {
    "curtailed_wind_mw", "curtailed_solar_mw", "nuclear_available_mw",
    "nuclear_outage_mw", "wind_potential_mw", "solar_potential_mw",
    "nuclear_modulation_mw",
}

# Keys of the log tables.
FORECAST_KEY = ["model_version", "issue_time_utc", "delivery_time_utc"]
ACTUAL_KEY = ["delivery_time_utc", "actual_revision"]
SCORE_KEY = ["forecast_id", "actual_revision"]
FORECAST_HISTORY_KEY = ["model_version", "forecast_issue_time_utc", "delivery_date"]
GRADING_HISTORY_KEY = ["model_version", "delivery_date", "actual_revision"]
RISK_LOG_KEY = ["model_version", "issue_time_utc", "delivery_date"]

# Market-index provider kept by the price reader.
PRICE_PROVIDER = "APXMIDP"

# Components allowed to switch to the seven-day fallback, and its lag.
FALLBACK_COMPONENTS = {"demand_mw", "nuclear_mw"}
FALLBACK_LAG_S = 168 * 3600
MIN_OPERATIONAL_ERROR_ROWS = 500

# Deployment gate thresholds.
GATE_MIN_DAYS = 30
GATE_MIN_IMPROVEMENT = 5.0
GATE_COVERAGE = (0.70, 0.90)
GATE_MIN_LEAD_HOURS = 8.0

# One-sided 95 % normal quantile and the default lookback.
Z_95 = 1.6448536269514722
LOOKBACK = 1440

# Revision tags carried by archives and reports.
ARCHIVE_REVISION = "historical-v4"
MERGE_REVISION = "history-artifact-merge-v2"
GATE_REVISION = "deployment-gate-v1"
