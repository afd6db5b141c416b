"""JSON payload readers.

A payload is one JSON text per row. Its record list is unwrapped, and each record becomes
a map of text values with plain lower-case names, so that spelling variants are resolved
per record without inferring a schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from settlespark.constants import PRICE_PROVIDER
from settlespark.errors import MissingColumns
from settlespark.functions import clock, values
from settlespark.operators.point_in_time import last_by
from settlespark.operators.relations import distinct_categories, listed_only, sum_by_category

# Places where a payload may hold its record list, most direct first.
RECORD_PATHS = ["$", "$.data", "$.data.records", "$.records", "$.records.records", "$.result", "$.result.records"]
RECORDS = "array<map<string,string>>"

# Field spellings of the sources.
FIELDS = {
    "date": ["settlementDate", "settlement_date"],
    "period": ["settlementPeriod", "settlement_period"],
    "start": ["startTime", "start_time", "timeFrom", "time_from"],
    "price": ["price", "marketIndexPrice", "market_index_price"],
    "provider": ["dataProvider", "data_provider"],
    "volume": ["volume", "marketIndexVolume", "market_index_volume"],
    "fuel": ["fuelType", "fuel_type"],
    "fuel_mw": ["generation", "quantity", "value"],
    "demand": ["nationalDemand", "initialDemandOutturn", "demand", "value"],
    "interconnector": ["interconnectorName", "interconnector_name"],
    "interconnector_mw": ["generation", "value"],
    "unit": ["bmUnit", "bm_unit"],
    "unit_reference": ["bmUnit", "bm_unit", "elexonBmUnit"],
    "unit_mwh": ["quantity", "meteredVolume", "metered_volume"],
    "unit_fuel": ["fuelType", "fuel_type"],
    "unit_party": ["leadPartyName", "lead_party_name"],
    "unit_name": ["name", "bmUnitName", "bm_unit_name"],
    "unit_capacity": ["generationCapacity", "generation_capacity"],
    "published": ["forecast_datetime"],
    "embedded_wind": ["embedded_wind_forecast"],
    "embedded_solar": ["embedded_solar_forecast"],
    "embedded_wind_capacity": ["embedded_wind_capacity"],
    "embedded_solar_capacity": ["embedded_solar_capacity"],
    "inertia": ["outturn_inertia", "outturn_inertia_gva_s"],
    "market_inertia": ["market_provided_inertia", "market_provided_inertia_gva_s"],
}
# Columns of a generic record table read as instants when present.
TIME_COLUMNS = ["timestamp", "datetime", "forecast_datetime", "settlement_date", "date"]


def records(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """One row per record: ``keep`` columns and a ``rec`` map.

    With ``strict`` a payload that is no JSON or has no record list is an error; otherwise it
    yields no rows, and ``payload_status`` tells why.
    """
    # Parsed once as a column of its own: every path below reads the same document.
    parse = F.parse_json if strict else F.try_parse_json
    parsed = payloads.select(*keep, parse(payload).alias("_doc"))
    found = _record_list("_doc")
    if strict:
        found = F.coalesce(found, F.raise_error(F.lit("payload holds no record list")).cast(RECORDS))
    # Names are made plain inside the array, before rows multiply and filters copy the map.
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ -", "abcdefghijklmnopqrstuvwxyz__"
    plain = F.transform(found, lambda r: F.transform_keys(r, lambda k, v: F.translate(F.trim(k), upper, lower)))
    return parsed.select(*keep, F.explode(plain).alias("rec"))


def _record_list(doc: str) -> Column:
    return F.coalesce(*[F.try_variant_get(doc, p, RECORDS) for p in RECORD_PATHS])


def payload_status(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``status`` (success, no_rows or failed), ``message`` and ``record_count`` to each payload, without failing."""
    d = payloads.withColumn("_doc", F.try_parse_json(payload))
    d = d.withColumn("record_count", F.coalesce(F.size(_record_list("_doc")), F.lit(-1)).cast("long"))
    message = F.when(F.col("_doc").isNull(), "payload is no JSON").when(F.col("record_count") < 0, "payload holds no record list")
    status = F.when(message.isNotNull(), "failed").when(F.col("record_count") == 0, "no_rows").otherwise("success")
    return d.withColumns({"status": status, "message": message}).withColumn("record_count", F.greatest("record_count", F.lit(0).cast("long"))).drop("_doc")


def field(name: str) -> Column:
    """Text of a source field under any of its spellings."""
    return F.coalesce(*[F.col("rec")[a.lower()] for a in FIELDS[name]])


def absent_fields(recs: DataFrame, names: Sequence[str]) -> list[str]:
    """Fields that no record has. One aggregation over the records."""
    has = [
        F.bool_or(F.arrays_overlap(F.map_keys("rec"), F.array(*[F.lit(a.lower()) for a in FIELDS[n]]))).alias(n)
        for n in names
    ]
    row = recs.agg(*has).first()
    return [n for n in names if not row[n]]


def require_fields(recs: DataFrame, names: Sequence[str]) -> DataFrame:
    absent = absent_fields(recs, names)
    if absent:
        raise MissingColumns(f"records have no field for {absent}")
    return recs


def _texts(recs: DataFrame, keep: Sequence[str], *names: str) -> DataFrame:
    """The named fields as plain columns, with delivery date and period already read.

    A projection of its own, so that later filters repeat column references and not the
    look-ups behind them.
    """
    return recs.select(
        *keep, field("date").try_cast("date").alias("settlement_date"),
        values.number(field("period")).cast("int").alias("settlement_period"),
        field("start").alias("_start"), *[field(n).alias(f"_{n}") for n in names],
    )


def _by_start() -> Column:
    """Delivery instant: the source's start time, else date and period."""
    return F.coalesce(clock.parse_instant("_start"), _by_period())


def _by_period() -> Column:
    return clock.settlement_instant("settlement_date", "settlement_period")


def market_index(recs: DataFrame, keep: Sequence[str] = (), provider: str = PRICE_PROVIDER) -> DataFrame:
    """Half-hourly market-index prices of one provider."""
    texts = _texts(recs.where(field("provider") == provider), keep, "provider", "price", "volume")
    return texts.select(
        *keep, _by_start().alias("timestamp"), "settlement_date", "settlement_period",
        F.col("_provider").alias("data_provider"), values.number("_price").alias("price_gbp_mwh"),
        values.number("_volume").alias("market_index_volume_mwh"),
    ).where("timestamp is not null and price_gbp_mwh is not null")


def fuel_long(recs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _texts(recs, keep, "fuel", "fuel_mw").select(
        *keep, _by_start().alias("timestamp"), F.lower("_fuel").alias("fuel_type"),
        values.number("_fuel_mw").alias("generation_mw"),
    ).where("timestamp is not null")


def fuel_mix(recs: DataFrame, fuels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Generation per fuel, one column each. A missing cell stays null, a fuel that is not listed is an error."""
    return sum_by_category(fuel_long(recs, keep), [*keep, "timestamp"], "fuel_type", "generation_mw",
                           [f.lower() for f in fuels], "fuel_{}_mw")


def demand(recs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _texts(recs, keep, "demand").select(
        *keep, _by_start().alias("timestamp"), values.number("_demand").alias("demand_mw")
    ).where("timestamp is not null and demand_mw is not null")


def interconnector_long(recs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _texts(recs, keep, "interconnector", "interconnector_mw").select(
        *keep, _by_start().alias("timestamp"), F.lower("_interconnector").alias("interconnector"),
        values.number("_interconnector_mw").alias("flow_mw"),
    ).where("timestamp is not null")


def interconnectors(recs: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Flow per interconnector and their sum, which is null only if all are null. A link that is not listed is an error."""
    names = [n.lower() for n in names]
    wide = sum_by_category(interconnector_long(recs, keep), [*keep, "timestamp"], "interconnector", "flow_mw",
                           names, "interconnector_{}_mw")
    return wide.withColumn("net_import_mw", values.row_sum([f"interconnector_{n}_mw" for n in names]))


def unit_generation(recs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Metered half-hour energy per unit and its mean power."""
    energy = values.number("_unit_mwh")
    return _texts(recs, keep, "unit", "unit_mwh").select(
        *keep, _by_start().alias("timestamp"), F.col("_unit").alias("bm_unit"),
        energy.alias("generation_mwh"), (energy * 2.0).alias("generation_mw"),
    ).where("timestamp is not null and generation_mw is not null")


def unit_reference(recs: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Static unit facts, the last record per unit under ``order``."""
    facts = recs.select(
        *order, field("unit_reference").alias("bm_unit"), field("unit_fuel").alias("fuel_type"),
        field("unit_party").alias("lead_party"), field("unit_name").alias("name"),
        values.number(field("unit_capacity")).alias("generation_capacity_mw"),
    )
    rank = list(order) or ["fuel_type", "lead_party", "name", "generation_capacity_mw"]
    return last_by(facts, ["bm_unit"], rank).drop(*order)


def embedded_forecasts(recs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every publication of the embedded wind and solar forecasts."""
    measures = ["embedded_wind", "embedded_solar", "embedded_wind_capacity", "embedded_solar_capacity"]
    return _texts(recs, keep, "published", *measures).select(
        *keep, _by_period().alias("timestamp"), "settlement_date", "settlement_period",
        clock.parse_instant("_published").alias("published_at_utc"),
        *[values.number(f"_{m}").alias(f"{m}_mw") for m in measures],
    ).where("timestamp is not null and published_at_utc is not null")


def inertia(recs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Outturn and market inertia and the gap closed by intervention."""
    out = _texts(recs, keep, "inertia", "market_inertia").select(
        *keep, _by_period().alias("timestamp"), "settlement_date", "settlement_period",
        values.number("_inertia").alias("outturn_inertia_gvas"),
        values.number("_market_inertia").alias("market_provided_inertia_gvas"),
    ).where("timestamp is not null")
    gap = F.col("outturn_inertia_gvas") - F.col("market_provided_inertia_gvas")
    return out.withColumn("inertia_intervention_gap_gvas", gap)


def generic_table(df: DataFrame) -> DataFrame:
    """Plain column names, and instants for the usual time columns."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    renamed = df.toDF(*[n if names.count(n) == 1 else c for n, c in zip(names, df.columns)])
    times = {c: clock.parse_instant(c) for c in TIME_COLUMNS if c in renamed.columns}
    return renamed.withColumns(times) if times else renamed


def as_table(recs: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Records as columns of text, with the usual time columns read.

    Without ``names`` the field names are looked up first.
    """
    names = names or distinct_categories(recs.select(F.explode(F.map_keys("rec")).alias("n")), "n")
    return generic_table(recs.select(*[F.col("rec")[n].alias(n) for n in names]))


def in_date_window(recs: DataFrame, first: str, end: str) -> DataFrame:
    """Records whose delivery date lies in ``[first, end)``."""
    day = F.coalesce(field("date"), F.col("rec")["date"]).try_cast("date")
    return recs.where((day >= F.lit(first).cast("date")) & (day < F.lit(end).cast("date")))


def preset_reader(name: str):
    """Reader of a named dataset, by its prefix."""
    if name.startswith("embedded_"):
        return embedded_forecasts
    if name.startswith("inertia_") and name != "inertia_cost":
        return inertia
    return as_table


def hourly_weather(payloads: DataFrame, variables: Sequence[str], site: str = "site", payload: str = "payload") -> DataFrame:
    """Hourly arrays to rows, with the site kept as a column."""
    arrays = ", ".join(f"`{v}`: array<double>" for v in variables)
    doc = F.from_json(payload, f"hourly struct<time: array<string>, {arrays}>")["hourly"]
    hours = F.when(doc["time"].isNotNull(), F.arrays_zip(doc["time"], *[doc[v] for v in variables])).otherwise(
        F.raise_error(F.lit("weather payload has no hourly time")).cast(
            f"array<struct<time: string, {', '.join(f'`{v}`: double' for v in variables)}>>"
        )
    )
    hours = hours.cast(f"array<struct<time: string, {', '.join(f'`{v}`: double' for v in variables)}>>")
    rows = payloads.select(F.col(site), F.explode(hours).alias("h"))
    return rows.select(F.col(site), clock.parse_instant("h.time").alias("timestamp"), *[F.col(f"h.{v}").alias(v) for v in variables])


def weather_wide(hours: DataFrame, sites: Sequence[str], variables: Sequence[str], site: str = "site") -> DataFrame:
    """One column per site and variable. A single aggregation replaces a chain of joins.

    A site that is not listed is an error.
    """
    cells = [
        listed_only(site, sites, F.max(F.when(F.col(site) == s, F.col(v)))).alias(f"{s}_{v}") for s in sites for v in variables
    ]
    return hours.groupBy("timestamp").agg(*cells)
