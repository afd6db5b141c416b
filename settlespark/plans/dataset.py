"""Assemble the half-hourly modelling table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from settlespark import constants as K
from settlespark.errors import GuardError, MissingColumns, need_columns
from settlespark.functions import clock
from settlespark.operators.point_in_time import last_by, latest_revision
from settlespark.operators.quality import mapped, require_components, require_no_nulls
from settlespark.operators.relations import column_from_first, join_many_to_one, join_one_to_one
from settlespark.operators.series import interpolate_to
from settlespark.sources.tables import keyed_by_instant

# Targets taken from whichever source table has the configured column.
OPTIONAL_TARGETS = ["net_import_mw", "battery_net_mw", "curtailed_wind_mw", "curtailed_solar_mw",
                    "nuclear_available_mw", "nuclear_outage_mw"]
WEATHER = ("weather_demand", "weather_wind", "weather_solar")


def modelling_table(tables: dict[str, DataFrame], config: dict, check: bool = True, gaps: bool = False) -> DataFrame:
    """One row per period: targets, features, issue time and profile.

    ``tables`` holds price, demand, fuel, embedded, inertia and three weather tables;
    ``config`` names their columns. Nothing missing is filled: a gap in a required target
    is an error, or stays null with ``gaps``. Every join is on ``timestamp``, so Spark can share one partitioning.
    """
    names, optional = config["columns"], config.get("optional_columns", {})
    required = require_components(config.get("required_components"))
    t = {n: (keyed_by_instant(d, strict=False) if "timestamp" in d.columns else d) for n, d in tables.items()}

    base = t["price"].select("timestamp", F.col(mapped(names, "price_gbp_mwh")).alias("price_gbp_mwh"))
    demand = t["demand"].select("timestamp", F.col(mapped(names, "demand_mw")).alias("demand_mw"))
    wind, nuclear = mapped(names, "transmission_wind_mw"), mapped(names, "nuclear_mw")
    fuel = need_columns(t["fuel"], [wind, nuclear], "fuel mix").select(
        "timestamp", F.col(wind).alias("transmission_wind_mw"), F.col(nuclear).alias("nuclear_mw"))
    base = join_one_to_one(base, demand, ["timestamp"], check=check)
    base = join_one_to_one(base, fuel, ["timestamp"], check=check)

    hour, minute = (int(config.get("issue_time", {}).get(k, d)) for k, d in (("local_hour", 13), ("local_minute", 0)))
    base = base.withColumn("issue_time_utc", clock.issue_instant("timestamp", hour, minute))

    # The issue time follows from the delivery time, so eligibility needs no join.
    stamp, pub = mapped(names, "embedded_timestamp"), mapped(names, "embedded_published_at")
    sun, gust = mapped(names, "embedded_solar_mw"), mapped(names, "embedded_wind_mw")
    revisions = need_columns(t["embedded"], [stamp, pub, sun, gust], "embedded forecasts").select(
        clock.instant(stamp).alias("timestamp"), clock.instant(pub).alias("_pub"),
        F.col(gust).alias("embedded_wind_mw"), F.col(sun).alias("embedded_solar_mw"))
    chosen = latest_revision(revisions, ["timestamp"], "_pub", clock.issue_instant("timestamp", hour, minute),
                             tie=["embedded_wind_mw", "embedded_solar_mw"]).drop("_pub")
    base = join_many_to_one(base, chosen, ["timestamp"], check=False)

    when, gva = mapped(names, "inertia_timestamp"), mapped(names, "inertia_gvas")
    need_columns(t["inertia"], [when, gva], "inertia")
    inertia = t["inertia"].select(clock.instant(when).alias("timestamp"), F.col(gva).alias("inertia_gvas"))
    base = join_many_to_one(base, last_by(inertia, ["timestamp"], ["inertia_gvas"]), ["timestamp"], check=False)

    # All weather lies on one hourly axis, which is interpolated once.
    hourly, values = None, []
    for group in WEATHER:
        numeric = [c for c, k in t[group].dtypes if k in ("double", "float", "int", "bigint") and c != "timestamp"]
        clash = set(numeric) & set(values)
        if clash:
            raise GuardError(f"weather tables share columns {sorted(clash)}")
        part = t[group].select("timestamp", *numeric)
        hourly, values = part if hourly is None else hourly.unionByName(part, allowMissingColumns=True), values + numeric
    aligned = interpolate_to(hourly, base.select("timestamp"), [], "timestamp", values)
    base = join_many_to_one(base, aligned, ["timestamp"], check=False)

    for target in OPTIONAL_TARGETS:
        source = optional.get(target)
        if source:
            found = column_from_first(t, source).select("timestamp", F.col(source).alias(target))
            base = join_many_to_one(base, last_by(found, ["timestamp"], [target]), ["timestamp"], check=False)
        elif target in required:
            raise MissingColumns(f"the profile needs a source column for {target}")

    profile = K.PROFILE_FULL if "battery_net_mw" in required else K.PROFILE_CORE
    out = base.withColumns({"delivery_time_utc": F.col("timestamp"), "model_profile": F.lit(profile)})
    return require_no_nulls(out, ["price_gbp_mwh", *required], "modelling table") if check and not gaps else out
