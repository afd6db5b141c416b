"""Payload readers. Spark turns every event or line item into a small payload of the
source's shape, and the readers take it apart again, so the work grows with the tables."""

from pyspark.sql import functions as F

from settlespark.functions import clock
from settlespark.plans import collect
from settlespark.sources import documents, records as src
from settlespark.workload.registry import day_start, out, query

KINDS = ["click", "view", "purchase", "signup", "error"]
# Delivery of an event in the source's terms: its date and one of 46 periods.
SLOT = f"""SELECT *, CAST(ts AS DATE) AS d, event_id % 46 + 1 AS p, {day_start('CAST(ts AS DATE)')} + (event_id % 46) * INTERVAL '30 minutes' AS timestamp FROM events"""


def slots(t):
    return t.events.withColumns({"d": F.to_date("ts"), "p": F.col("event_id") % 46 + 1})


def dated(**fields):
    """A record with the usual date and period names plus the given fields."""
    named = [F.date_format("d", "yyyy-MM-dd").alias("settlementDate"), F.col("p").alias("settlementPeriod")]
    return F.struct(*named, *[v.alias(k) for k, v in fields.items()])


def payload(record, place: str):
    """A payload that holds one record at one of the usual places."""
    body = {
        "data": F.struct(F.array(record).alias("data")), "records": F.struct(F.array(record).alias("records")),
        "result.records": F.struct(F.struct(F.array(record).alias("records")).alias("result")), "": F.array(record),
    }[place]
    return F.to_json(body, {"ignoreNullFields": "false"})


@query("market_index", f"""
SELECT event_id, timestamp, d AS settlement_date, p AS settlement_period, 'APXMIDP' AS data_provider, value AS price_gbp_mwh, value * 2 AS market_index_volume_mwh
FROM ({SLOT}) WHERE event_type <> 'error'""", dates=["settlement_date"])
def market_index(t):
    rec = dated(dataProvider=F.when(F.col("event_type") == "error", "OTHER").otherwise("APXMIDP"), price=F.col("value"), volume=F.col("value") * 2)
    recs = src.records(slots(t).select("event_id", payload(rec, "data").alias("payload")), keep=["event_id"])
    return out(src.market_index(recs, keep=["event_id"]))


@query("fuel_mix", f"""
SELECT timestamp, round(sum(value) FILTER (event_type = 'click'), 6) AS fuel_click_mw, round(sum(value) FILTER (event_type = 'view'), 6) AS fuel_view_mw,
  round(sum(value) FILTER (event_type = 'purchase'), 6) AS fuel_purchase_mw,
  round(sum(value) FILTER (event_type = 'signup'), 6) AS fuel_signup_mw, round(sum(value) FILTER (event_type = 'error'), 6) AS fuel_error_mw FROM ({SLOT}) GROUP BY 1""")
def fuel_mix(t):
    rec = dated(fuelType=F.upper("event_type"), generation=F.col("value"))
    recs = src.records(slots(t).select(payload(rec, "").alias("payload")))
    return out(src.fuel_mix(recs, [k.upper() for k in KINDS]))


@query("demand_outturn", """
SELECT event_id, ts AS timestamp, value AS demand_mw FROM events WHERE event_type <> 'view'""")
def demand_outturn(t):
    rec = dated(startTime=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
                initialDemandOutturn=F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("string")))
    recs = src.records(slots(t).select("event_id", payload(rec, "result.records").alias("payload")), keep=["event_id"])
    return out(src.demand(recs, keep=["event_id"]))


@query("interconnector_flows", f"""
SELECT timestamp, {', '.join(f"round(sum(value) FILTER (event_type = '{k}'), 6) AS interconnector_{k}_mw" for k in KINDS)}, round(sum(value), 6) AS net_import_mw FROM ({SLOT}) GROUP BY 1""")
def interconnector_flows(t):
    rec = dated(interconnectorName=F.initcap("event_type"), generation=F.col("value"))
    recs = src.records(slots(t).select(payload(rec, "records").alias("payload")))
    return out(src.interconnectors(recs, [k.title() for k in KINDS]))


@query("unit_generation", f"""
SELECT event_id, timestamp, 'U' || user_id AS bm_unit, value AS generation_mwh, value * 2 AS generation_mw FROM ({SLOT})""")
def unit_generation(t):
    rec = dated(bmUnit=F.concat(F.lit("U"), F.col("user_id").cast("string")), quantity=F.col("value"))
    recs = src.records(slots(t).select("event_id", payload(rec, "data").alias("payload")), keep=["event_id"])
    return out(src.unit_generation(recs, keep=["event_id"]))


@query("unit_reference", """
SELECT 'U' || user_id AS bm_unit, event_type AS fuel_type, CAST(NULL AS VARCHAR) AS lead_party, 'unit ' || user_id AS name, value AS generation_capacity_mw FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def unit_reference(t):
    rec = F.struct(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("elexonBmUnit"), F.col("event_type").alias("fuelType"),
                   F.concat(F.lit("unit "), F.col("user_id").cast("string")).alias("bmUnitName"), F.col("value").alias("generationCapacity"))
    recs = src.records(t.events.select("event_id", payload(rec, "data").alias("payload")), keep=["event_id"])
    return out(src.unit_reference(recs, order=["event_id"]))


@query("embedded_forecasts", f"""
SELECT timestamp, d AS settlement_date, p AS settlement_period, value AS embedded_wind_mw, value / 2 AS embedded_solar_mw, ts AS published_at_utc,
  value * 4 AS embedded_wind_capacity_mw, CAST(NULL AS DOUBLE) AS embedded_solar_capacity_mw FROM ({SLOT})""", dates=["settlement_date"])
def embedded_forecasts(t):
    rec = F.struct(F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss").alias("SETTLEMENT_DATE"), F.col("p").alias("SETTLEMENT_PERIOD"), F.col("value").alias("EMBEDDED_WIND_FORECAST"),
                   (F.col("value") / 2).alias("Embedded Solar-Forecast"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Forecast_Datetime"),
                   (F.col("value") * 4).alias("EMBEDDED_WIND_CAPACITY"))
    recs = src.records(slots(t).select(payload(rec, "records").alias("payload")))
    return out(src.preset_reader("embedded_2025")(recs))


@query("inertia", f"""
SELECT event_id, timestamp, d AS settlement_date, p AS settlement_period, value AS outturn_inertia_gvas, round(value * 0.75, 6) AS market_provided_inertia_gvas,
  round(value - value * 0.75, 6) AS inertia_intervention_gap_gvas FROM ({SLOT})""", dates=["settlement_date"])
def inertia(t):
    rec = F.struct(F.date_format("d", "yyyy-MM-dd").alias("Settlement Date"), F.col("p").alias("Settlement Period"), F.col("value").alias("Outturn Inertia"),
                   (F.col("value") * 0.75).alias("Market Provided Inertia"))
    recs = src.records(slots(t).select("event_id", payload(rec, "result.records").alias("payload")), keep=["event_id"])
    return out(src.inertia(recs, keep=["event_id"]))


@query("generic_records", """
SELECT event_id, ts AS datetime, event_type AS event_kind, value FROM events""")
def generic_records(t):
    odd = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(" Datetime "), F.col("event_type").alias("Event Kind"), "value")
    return out(src.generic_table(odd))


@query("date_window_records", f"""
SELECT event_id, value FROM ({SLOT}) WHERE d >= DATE '2024-01-05' AND d < DATE '2024-01-25'""")
def date_window_records(t):
    rec = dated(value=F.col("value"))
    recs = src.records(slots(t).select("event_id", payload(rec, "data").alias("payload")), keep=["event_id"])
    kept = src.in_date_window(recs, "2024-01-05", "2024-01-25")
    return out(kept.select("event_id", F.col("rec")["value"].cast("double").alias("value")))


@query("indexed_landing", f"""
SELECT count(*) AS records, round(sum(value), 6) AS total, true AS only_files_of_the_window FROM ({SLOT}) WHERE d >= DATE '2024-01-05' AND d < DATE '2024-01-25'""")
def indexed_landing(t):
    """A delivery window read from a landing whose files are known by their dates; files of other dates are not opened."""
    from settlespark.session import shared_path
    from settlespark.sources import landing, tables
    path, index = shared_path(t.spark, "landing"), shared_path(t.spark, "index")
    first = slots(t).select(payload(dated(value=F.col("value")), "data").alias("payload"), F.col("event_type").alias("source"), F.col("d").alias("landed_date"))
    tables.land_payloads(first.repartition("landed_date"), path)
    landing.index_landing(t.spark, path, index)
    found = landing.read_window(t.spark, path, index, "2024-01-05", "2024-01-25")
    days = {f.split("landed_date=")[1][:10] for f in found.inputFiles()}
    recs = src.in_date_window(src.records(found), "2024-01-05", "2024-01-25")
    return out(recs.agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("rec")["value"].cast("double")).alias("total")).withColumn(
        "only_files_of_the_window", F.lit(bool(days) and min(days) >= "2024-01-05" and max(days) < "2024-01-25")))


@query("absent_fields", """SELECT 'published' AS absent_field FROM events HAVING count(*) > 0""")
def absent_fields(t):
    rec = dated(price=F.col("value"), dataProvider=F.col("event_type"))
    recs = src.records(slots(t).select(payload(rec, "data").alias("payload")))
    absent = src.absent_fields(recs, ["date", "period", "price", "provider", "published"])
    return t.spark.createDataFrame([(a,) for a in absent], "absent_field string")


HOURS = """w AS (SELECT event_type AS site, event_id, date_trunc('hour', ts) AS a, value FROM events),
h AS (SELECT site, event_id, unnest([a, a + INTERVAL '1 hour']) AS timestamp, unnest([value, round(value + 1, 6)]) AS temperature_2m, unnest([NULL, round(value / 2, 6)]) AS cloud_cover FROM w)"""


def weather_payloads(t):
    hour = clock.floor_to("ts", 3600)
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm")
    body = F.struct(F.struct(
        F.array(text(hour), text(clock.add_seconds(hour, 3600))).alias("time"), F.array(F.col("value"), F.col("value") + 1).alias("temperature_2m"),
        F.array(F.lit(None).cast("double"), F.col("value") / 2).alias("cloud_cover")).alias("hourly"))
    return t.events.select(F.col("event_type").alias("site"), F.to_json(body).alias("payload"))


@query("hourly_weather", f"WITH {HOURS} SELECT site, timestamp, temperature_2m, cloud_cover FROM h")
def hourly_weather(t):
    return out(src.hourly_weather(weather_payloads(t), ["temperature_2m", "cloud_cover"]))


@query("weather_by_site", f"""
WITH {HOURS} SELECT timestamp, {', '.join(f"max({v}) FILTER (site = '{s}') AS {s}_{v}" for s in KINDS for v in ('temperature_2m', 'cloud_cover'))} FROM h GROUP BY 1""")
def weather_by_site(t):
    hours = src.hourly_weather(weather_payloads(t), ["temperature_2m", "cloud_cover"])
    return out(src.weather_wide(hours, KINDS, ["temperature_2m", "cloud_cover"]))


# One XML document per event: two hourly points, or an acknowledgement for errors.
XML = """<?xml version="1.0" encoding="UTF-8"?><Publication_MarketDocument xmlns="urn:x:publication:7:3"><createdDateTime>%s</createdDateTime><TimeSeries>\
<mRID>s%d</mRID><in_Domain.mRID>%s</in_Domain.mRID><out_Domain.mRID>GB</out_Domain.mRID><currency_Unit.name>EUR</currency_Unit.name><Period><timeInterval><start>%s</start></timeInterval>\
<resolution>PT60M</resolution><Point><position>1</position><price.amount>%s</price.amount><quantity>%s</quantity></Point><Point><position>3</position><price.amount>-%s</price.amount><quantity>%s</quantity></Point></Period></TimeSeries></Publication_MarketDocument>"""
REFUSAL = """<Acknowledgement_MarketDocument xmlns="urn:x:ack:7:0"><Reason><code>999</code><text>No data, token: abc%d</text></Reason></Acknowledgement_MarketDocument>"""


def xml_documents(t, **columns):
    """Documents with their event and further ``columns`` of it.

    Few tasks read the events, which are small; they are dealt to all cores before texts are made and parsed.
    """
    events = t.events.repartition(3 * t.spark.sparkContext.defaultParallelism)
    hour = clock.floor_to("ts", 3600)
    v = F.col("value").cast("string")
    doc = F.format_string(XML, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "event_id", "event_type", F.date_format(hour, "yyyy-MM-dd'T'HH:mm'Z'"), v, v, v, v)
    xml = F.when(F.col("event_type") == "error", F.format_string(REFUSAL, "event_id")).otherwise(doc)
    return events.select("event_id", xml.alias("xml"), *[c.alias(n) for n, c in columns.items()])


@query("xml_points", """
SELECT event_id, date_trunc('hour', ts) + h * INTERVAL '1 hour' AS timestamp, CASE h WHEN 0 THEN value ELSE -value END AS price_eur_mwh, CAST(60 AS BIGINT) AS resolution_minutes,
  date_trunc('second', ts) AS published_at_utc, 's' || event_id AS series_id, event_type AS in_domain, 'GB' AS out_domain, 'EUR' AS currency
FROM events, (VALUES (0), (2)) AS p(h) WHERE event_type <> 'error'""")
def xml_points(t):
    p = documents.timeseries_points(xml_documents(t), "price.amount", "price_eur_mwh", keep=["event_id"], strict=False)
    return out(p.select("event_id", "timestamp", "price_eur_mwh", "resolution_minutes", "published_at_utc", "series_id", "in_domain", "out_domain", "currency"))


XML_HALF_HOURS = """SELECT event_id, date_trunc('hour', ts) + h * INTERVAL '30 minutes' AS timestamp, CASE WHEN h < 2 THEN value ELSE {sign}value END AS {name}
FROM events, (VALUES (0), (1), (4), (5)) AS p(h) WHERE event_type <> 'error'"""


@query("xml_prices", XML_HALF_HOURS.format(sign="-", name="price_eur_mwh"))
def xml_prices(t):
    return out(documents.day_ahead_prices(xml_documents(t), keep=["event_id"], strict=False).select("event_id", "timestamp", "price_eur_mwh"))


@query("xml_flows", XML_HALF_HOURS.format(sign="", name="flow_mw"))
def xml_flows(t):
    return out(documents.physical_flows(xml_documents(t), keep=["event_id"], strict=False).select("event_id", "timestamp", "flow_mw"))


@query("xml_schedules", XML_HALF_HOURS.format(sign="", name="scheduled_exchange_mw"))
def xml_schedules(t):
    return out(documents.scheduled_exchanges(xml_documents(t), keep=["event_id"], strict=False).select("event_id", "timestamp", "scheduled_exchange_mw"))


@query("document_status", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'unavailable' ELSE 'success' END AS status, CASE event_type WHEN 'error' THEN '999: No data, token: ***' END AS message FROM events""")
def document_status(t):
    return out(documents.document_status(xml_documents(t)).select("event_id", "status", "message"))


@query("landed_payloads", f"""
SELECT event_type AS source, d AS landed_date, count(*) AS payloads, round(sum(value), 6) AS total FROM ({SLOT}) WHERE d >= DATE '2024-01-03' AND d < DATE '2024-01-28' GROUP BY 1, 2""", dates=["landed_date"])
def landed_payloads(t):
    from settlespark.session import shared_path
    from settlespark.sources.tables import land_payloads, read_landed
    path = shared_path(t.spark, "landed")
    land_payloads(slots(t).select(payload(dated(value=F.col("value")), "data").alias("payload"), F.col("event_type").alias("source"), F.col("d").alias("landed_date")), path)
    recs = src.records(read_landed(t.spark, path, first="2024-01-03", end="2024-01-28"), keep=["source", "landed_date"])
    return out(recs.groupBy("source", "landed_date").agg(F.count(F.lit(1)).alias("payloads"), F.sum(F.col("rec")["value"].cast("double")).alias("total")))


@query("collected_prices", f"""
SELECT timestamp, value AS price_gbp_mwh FROM ({SLOT}) WHERE event_type <> 'error' AND d >= DATE '2024-01-01' AND d < DATE '2024-02-01'
QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY event_id DESC) = 1""")
def collected_prices(t):
    rec = dated(dataProvider=F.when(F.col("event_type") == "error", "OTHER").otherwise("APXMIDP"), price=F.col("value"), volume=F.col("value"))
    chunks = slots(t).select(F.col("event_id").alias("chunk"), payload(rec, "data").alias("payload"))
    return out(collect.combined(src.market_index(src.records(chunks, keep=["chunk"]), keep=["chunk"]), ["timestamp"], ["chunk"], "2024-01-01", "2024-02-01", "prices").select("timestamp", "price_gbp_mwh"))


@query("collected_units", f"""
SELECT timestamp, 'U' || user_id AS bm_unit, value * 2 AS generation_mw FROM ({SLOT}) QUALIFY row_number() OVER (PARTITION BY timestamp, user_id ORDER BY event_id DESC) = 1""")
def collected_units(t):
    rec = dated(bmUnit=F.concat(F.lit("U"), F.col("user_id").cast("string")), quantity=F.col("value"))
    chunks = slots(t).select(F.col("event_id").alias("chunk"), payload(rec, "data").alias("payload"))
    return out(collect.combined(src.unit_generation(src.records(chunks, keep=["chunk"]), keep=["chunk"]), ["timestamp", "bm_unit"], ["chunk"], "2024-01-01", "2024-02-01", "units").select("timestamp", "bm_unit", "generation_mw"))


@query("unit_sources", f"""
WITH g AS (SELECT timestamp, 'U' || user_id AS unit, value * 2 AS mw FROM ({SLOT}) QUALIFY row_number() OVER (PARTITION BY timestamp, user_id ORDER BY event_id % 3 DESC, event_id DESC) = 1),
u AS (SELECT DISTINCT 'U' || user_id AS unit, 'Party' || (user_id % 3) AS party FROM events)
SELECT 'unit_generation' AS table_name, timestamp, unit, CASE WHEN true THEN NULL END::VARCHAR AS lead_party, count(*) OVER (PARTITION BY timestamp, unit) > 0 AS present FROM g UNION ALL SELECT 'units', NULL, unit, party, true FROM u""")
def unit_sources(t):
    """Unit generation and unit reference from one landing, parsed once: which units and periods there are, and whose."""
    from settlespark.session import shared_path
    unit, landed = F.concat(F.lit("U"), F.col("user_id").cast("string")), F.date_add(F.lit("2024-03-01").cast("date"), (F.col("event_id") % 3).cast("int"))
    gen = slots(t).select(F.lit("unit_generation").alias("source"), landed.alias("landed_date"), payload(dated(bmUnit=unit, quantity=F.col("value")), "data").alias("payload"))
    ref = t.events.select(F.lit("units").alias("source"), F.lit("2024-03-01").cast("date").alias("landed_date"),
                          payload(F.struct(unit.alias("bmUnit"), F.concat(F.lit("Party"), (F.col("user_id") % 3).cast("string")).alias("leadPartyName")), "data").alias("payload"))
    saved = collect.unit_sources(gen.unionByName(ref), "2024-01-01", "2024-02-01", shared_path(t.spark, "units"))
    made, units = (t.spark.read.parquet(saved[n]) for n in ("unit_generation", "units"))
    none = F.lit(None)
    party = next(c for c in units.columns if "party" in c)
    return out(made.select(F.lit("unit_generation").alias("table_name"), "timestamp", F.col("bm_unit").alias("unit"), none.cast("string").alias("lead_party"), F.col("generation_mw").isNotNull().alias("present")).unionByName(
        units.select(F.lit("units").alias("table_name"), none.cast("timestamp").alias("timestamp"), F.col("bm_unit").alias("unit"), F.col(party).alias("lead_party"), F.lit(True).alias("present"))))


@query("weather_source", f"""
WITH {HOURS} SELECT timestamp, {', '.join(f"max({v}) FILTER (site = '{s}') AS {s}_{v}" for s in KINDS for v in ('temperature_2m', 'cloud_cover'))} FROM h WHERE timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31' GROUP BY 1""")
def weather_source(t):
    """The weather job: all sites on the settlement window; the hour that spills over its end is trimmed."""
    return out(collect.weather_source(weather_payloads(t), KINDS, ["temperature_2m", "cloud_cover"], "2024-01-01", "2024-01-31"))


@query("preset_source", f"""
SELECT timestamp, pub AS published_at_utc, w AS embedded_wind_mw, s AS embedded_solar_mw FROM (SELECT timestamp, d, date_trunc('second', ts) - INTERVAL '2 days' AS pub, value AS w, value / 2 AS s FROM ({SLOT})) WHERE d >= DATE '2024-01-05' AND d < DATE '2024-01-25'""")
def preset_source(t):
    """A named reference dataset of embedded forecasts, for a window of delivery dates."""
    pub = F.date_format(clock.add_seconds("ts", -2 * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rec = dated(forecast_datetime=pub, embedded_wind_forecast=F.col("value"), embedded_solar_forecast=F.col("value") / 2)
    found = collect.preset_source(src.records(slots(t).select(payload(rec, "data").alias("payload"))), "embedded_forecasts", "2024-01-05", "2024-01-25")
    return out(found.select("timestamp", "published_at_utc", "embedded_wind_mw", "embedded_solar_mw"))


@query("market_collection", """
WITH p AS (SELECT product, event_type AS border, date_trunc('hour', ts) + h * INTERVAL '30 minutes' AS timestamp FROM events, (VALUES (0), (1), (4), (5)) AS x(h), (VALUES ('prices'), ('physical_flows'), ('scheduled_exchanges')) AS n(product) WHERE event_type <> 'error')
SELECT product AS table_name, count(DISTINCT timestamp) AS row_count FROM p GROUP BY 1 UNION ALL SELECT 'status', 15 FROM events HAVING count(*) > 0
UNION ALL SELECT 'successful_items', 12 FROM events HAVING count(*) > 0""")
def market_collection(t):
    """Three products over all borders from one pass over the documents, one border of which refuses."""
    from settlespark.session import shared_path
    side = F.when(F.col("user_id") % 2 == 0, "in").otherwise("out")
    docs = xml_documents(t, border=F.col("event_type"), direction=side).drop("event_id")
    every = docs.withColumn("product", F.explode(F.array(F.lit("price"), F.lit("flow"), F.lit("schedule"))))
    saved = collect.market_collection(every, KINDS, shared_path(t.spark, "markets"))
    counts = [t.spark.read.parquet(p).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, p in saved.items()]
    overall = collect.overall_status(t.spark.read.parquet(saved["status"])).select(F.lit("successful_items").alias("table_name"), F.col("successful_items").alias("row_count"))
    return out(counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3]).unionByName(overall))


@query("border_status", """
SELECT event_type AS border, CASE event_type WHEN 'error' THEN 'unavailable' ELSE 'success' END AS status, count(*) AS documents, CASE event_type WHEN 'error' THEN 0 ELSE count(*) * 2 END AS row_count FROM events GROUP BY 1""")
def border_status(t):
    docs = xml_documents(t, border=F.col("event_type"))
    return out(collect.item_status(docs, ["border"], "price.amount"))


@query("border_prices", """
WITH p AS (SELECT event_type AS border, date_trunc('hour', ts) + h * INTERVAL '30 minutes' AS timestamp, CASE WHEN h < 2 THEN value ELSE -value END AS v, date_trunc('second', ts) AS pub
  FROM events, (VALUES (0), (1), (4), (5)) AS x(h) WHERE event_type <> 'error'),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY border, timestamp ORDER BY pub DESC, v DESC) = 1)
SELECT timestamp, """ + ", ".join(f"max(v) FILTER (border = '{k}') AS {k}_day_ahead_price_eur_mwh, max(pub) FILTER (border = '{k}') AS {k}_price_published_at_utc" for k in KINDS) + """ FROM k GROUP BY 1""")
def border_prices(t):
    docs = xml_documents(t, border=F.col("event_type"))
    return out(collect.neighbour_prices(docs, KINDS))


@query("border_flows", """
WITH p AS (SELECT event_type AS border, CASE user_id % 2 WHEN 0 THEN 'in' ELSE 'out' END AS direction, date_trunc('hour', ts) + h * INTERVAL '30 minutes' AS timestamp, value AS v, date_trunc('second', ts) AS pub
  FROM events, (VALUES (0), (1), (4), (5)) AS x(h) WHERE event_type <> 'error'),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY border, direction, timestamp ORDER BY pub DESC, v DESC) = 1),
n AS (SELECT timestamp, border, coalesce(max(v) FILTER (direction = 'in'), 0) - coalesce(max(v) FILTER (direction = 'out'), 0) AS net FROM k GROUP BY 1, 2)
SELECT timestamp, """ + ", ".join(f"round(coalesce(max(net) FILTER (border = '{k}'), 0), 6) + 0.0 AS {k}_net_import_mw" for k in KINDS) + """,
  round(""" + " + ".join(f"coalesce(max(net) FILTER (border = '{k}'), 0)" for k in KINDS) + """, 6) + 0.0 AS net_import_mw FROM n GROUP BY 1""")
def border_flows(t):
    side = F.when(F.col("user_id") % 2 == 0, "in").otherwise("out")
    docs = xml_documents(t, border=F.col("event_type"), direction=side)
    return out(collect.border_flows(docs, KINDS).select("timestamp", *[f"{k}_net_import_mw" for k in KINDS], "net_import_mw"))


# Odd documents among good ones: half of the views have a step in days, half of the clicks a text position.
ODD = "event_type = 'view' AND event_id % 2 = 0 OR event_type = 'click' AND event_id % 2 = 0"


def odd_documents(t):
    view, click = F.col("xml").contains("<in_Domain.mRID>view<"), F.col("xml").contains("<in_Domain.mRID>click<")
    odd = F.col("event_id") % 2 == 0
    xml = F.when(view & odd, F.replace("xml", F.lit("PT60M"), F.when(F.col("event_id") % 4 == 0, "P1D").otherwise("PT5M"))).when(
        click & odd, F.replace("xml", F.lit("<position>3<"), F.lit("<position>third<"))).otherwise(F.col("xml"))
    return xml_documents(t, border=F.col("event_type")).withColumn("xml", xml)


@query("odd_document_points", f"""
SELECT event_id, date_trunc('hour', ts) + h * INTERVAL '1 hour' AS timestamp, CASE h WHEN 0 THEN value ELSE -value END AS price_eur_mwh
FROM events, (VALUES (0), (2)) AS p(h) WHERE event_type <> 'error' AND NOT ({ODD})""")
def odd_document_points(t):
    p = documents.timeseries_points(odd_documents(t), "price.amount", "price_eur_mwh", keep=["event_id"], strict=False)
    return out(p.select("event_id", "timestamp", "price_eur_mwh"))


@query("odd_document_status", f"""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'unavailable' WHEN {ODD} THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN event_type = 'error' THEN '999: No data, token: ***' WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'unsupported step P1D' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'unsupported step PT5M'
    WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'unreadable position third' END AS message FROM events""")
def odd_document_status(t):
    return out(documents.document_status(odd_documents(t)).select("event_id", "status", "message"))


@query("odd_border_status", f"""
SELECT event_type AS border, CASE WHEN event_type = 'error' THEN 'unavailable' WHEN count(*) FILTER ({ODD}) > 0 THEN 'failed' ELSE 'success' END AS status, count(*) AS documents,
  CASE event_type WHEN 'error' THEN 0 ELSE 2 * count(*) FILTER (NOT ({ODD})) END AS row_count FROM events GROUP BY 1""")
def odd_border_status(t):
    return out(collect.item_status(odd_documents(t), ["border"], "price.amount"))


@query("payload_status", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'failed' WHEN 2 THEN 'no_rows' ELSE 'success' END AS status,
  CASE event_id % 5 WHEN 0 THEN 'payload is no JSON' WHEN 1 THEN 'payload holds no record list' END AS message, CAST(event_id % 5 > 2 AS BIGINT) AS record_count, CASE WHEN event_id % 5 > 2 THEN value END AS value FROM events""")
def payload_status(t):
    good, kind = payload(dated(value=F.col("value")), "data"), F.col("event_id") % 5
    body = F.when(kind == 0, F.substring(good, 1, 20)).when(kind == 1, '{"note": 1}').when(kind == 2, '{"data": []}').otherwise(good)
    landed = slots(t).select("event_id", body.alias("payload"))
    found = src.records(landed, keep=["event_id"], strict=False).select("event_id", F.col("rec")["value"].cast("double").alias("value"))
    return out(src.payload_status(landed).select("event_id", "status", "message", "record_count").join(found, "event_id", "left"))


# Chunks overlap in time and repeat a fuel or link: half a day's landing is summed, the later chunk wins.
CHUNKED = f"""c AS (SELECT *, event_id % 7 AS chunk, DATE '2024-03-01' + CAST(event_id % 3 AS INTEGER) AS landed FROM ({SLOT})),
sums AS (SELECT landed, chunk, timestamp, event_type, sum(value) AS v FROM c GROUP BY ALL),
last AS (SELECT * FROM sums QUALIFY dense_rank() OVER (PARTITION BY timestamp ORDER BY landed DESC, chunk DESC) = 1),
one AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY landed DESC, chunk DESC, value DESC) = 1)"""


@query("collected_core", f"""
WITH {CHUNKED}
SELECT 'fuel' AS table_name, timestamp, {', '.join(f"round(max(v) FILTER (event_type = '{k}'), 6) AS {k}" for k in KINDS)}, CAST(NULL AS DOUBLE) AS total FROM last GROUP BY 2
UNION ALL SELECT 'interconnectors', timestamp, {', '.join(f"round(max(v) FILTER (event_type = '{k}'), 6)" for k in KINDS)}, round(sum(v), 6) FROM last GROUP BY 2
UNION ALL SELECT x, timestamp, {', '.join('NULL' for _ in KINDS)}, value FROM one, (VALUES ('price'), ('demand')) AS n(x)""")
def collected_core(t):
    """Four tables written by one job from landed chunks, and read back as one."""
    from settlespark.session import shared_path
    base = slots(t).withColumns({"chunk": F.col("event_id") % 7, "landed_date": F.date_add(F.lit("2024-03-01").cast("date"), (F.col("event_id") % 3).cast("int"))})
    bodies = {"price": dated(dataProvider=F.lit("APXMIDP"), price=F.col("value"), volume=F.col("value")), "demand": dated(demand=F.col("value")),
              "fuel": dated(fuelType=F.col("event_type"), generation=F.col("value")), "interconnectors": dated(interconnectorName=F.col("event_type"), generation=F.col("value"))}
    sides = [base.select(F.lit(n).alias("source"), "landed_date", "chunk", payload(b, "data").alias("payload")) for n, b in bodies.items()]
    landed = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
    saved = collect.core_sources(landed, "2024-01-01", "2024-02-01", shared_path(t.spark, "core"), KINDS, KINDS)
    none = F.lit(None).cast("double")
    read = {n: t.spark.read.parquet(p) for n, p in saved.items()}
    wide = {"fuel": ("fuel_{}_mw", none), "interconnectors": ("interconnector_{}_mw", F.col("net_import_mw")), "price": (None, F.col("price_gbp_mwh")), "demand": (None, F.col("demand_mw"))}
    parts = [read[n].select(F.lit(n).alias("table_name"), "timestamp", *[(F.col(c.format(k)) if c else none).alias(k) for k in KINDS], total.alias("total")) for n, (c, total) in wide.items()]
    return out(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
