"""Ordered operators, pivots, energy, peaks and storage."""

from pyspark.sql import functions as F

from settlespark.functions import clock
from settlespark.operators import relations as rel, risk, series
from settlespark.workload.registry import COMPONENTS, HH, day, out, period, query


@query("lag_features", f"""
WITH {HH} SELECT series, ts, round(price, 6) AS price, n, {', '.join(f"round(lag(price, {k}) OVER w, 6) AS lag_price_{k}" for k in (1, 2, 48, 96, 336))}
FROM hh WINDOW w AS (PARTITION BY series ORDER BY ts)""")
def lag_features(t):
    return out(series.lag_features(t.hh, ["series"], "ts", ["price"]))


@query("same_period_persistence", f"""
WITH {HH} SELECT series, ts, round(lag(price, 48) OVER (PARTITION BY series ORDER BY ts), 6) AS persistence FROM hh""")
def same_period_persistence(t):
    return out(series.same_period_persistence(t.hh, ["series"], "ts", "price").select("series", "ts", "persistence"))


@query("price_changes", f"""
WITH {HH}, c AS (SELECT series, ts, price - lag(price) OVER (PARTITION BY series ORDER BY ts) AS change FROM hh)
SELECT series, ts, round(change, 6) AS change FROM c WHERE change IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= 500""")
def price_changes(t):
    return out(series.last_changes(t.hh, ["series"], "ts", "price", 500).select("series", "ts", "change"))


@query("holdout_split", f"""
WITH {HH} SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= 100 AS is_test FROM hh""")
def holdout_split(t):
    return out(series.holdout_split(t.hh, ["series"], "ts", 100).select("series", "ts", "is_test"))


@query("expanding_folds", f"""
WITH {HH}, p AS (SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM hh)
SELECT series, ts, CAST(CASE WHEN pos >= n - 5 * (n // 6) THEN (pos - (n - 5 * (n // 6))) // (n // 6) END AS DOUBLE) AS fold FROM p""")
def expanding_folds(t):
    folds = series.expanding_folds(t.hh, ["series"], "ts", 5)
    return out(folds.select("series", "ts", F.col("fold").cast("double").alias("fold")))


@query("interpolated_half_hours", f"""
WITH hourly AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2),
span AS (SELECT series, min(ts) - INTERVAL '1 hour' AS a, max(ts) + INTERVAL '1 hour' AS z FROM hourly GROUP BY 1),
ask AS (SELECT series, unnest(generate_series(a, z, INTERVAL '30 minutes')) AS ts FROM span),
axis AS (SELECT a.series, a.ts, h.v FROM ask a LEFT JOIN hourly h USING (series, ts)),
near AS (SELECT series, ts, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t0, last_value(v IGNORE NULLS) OVER b AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS t1, first_value(v IGNORE NULLS) OVER f AS v1 FROM axis
  WINDOW b AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, ts, round(CASE WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (epoch(ts) - epoch(t0)) / (epoch(t1) - epoch(t0)) END, 10) AS v FROM near""")
def interpolated_half_hours(t):
    hourly = t.events.groupBy(F.col("event_type").alias("series"), clock.floor_to("ts", 3600).alias("ts")).agg(F.avg("value").alias("v"))
    span = hourly.groupBy("series").agg(clock.seconds(F.min("ts")).alias("a"), clock.seconds(F.max("ts")).alias("z"))
    ask = span.select("series", F.explode(F.sequence(F.col("a") - 3600, F.col("z") + 3600, F.lit(1800).cast("long"))).alias("s"))
    return out(series.interpolate_to(hourly, ask.select("series", F.timestamp_seconds("s").alias("ts")), ["series"], "ts", ["v"]), 10)


@query("carried_boundary", f"""
WITH {HH} SELECT series, ts, round(price, 6) AS price, n FROM hh UNION ALL
SELECT series, TIMESTAMP '2024-02-01 00:00:00', round(price, 6), n FROM hh QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) = 1""")
def carried_boundary(t):
    return out(series.carry_to_boundary(t.hh, ["series"], "ts", F.lit("2024-02-01").cast("timestamp")))


@query("state_of_charge", """
WITH RECURSIVE p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_id,
  CASE WHEN value - 20 >= 0 THEN -0.5 * (value - 20) / 0.93 ELSE -0.5 * (value - 20) * 0.93 END AS shift FROM events),
s AS (SELECT user_id, rn, event_id, least(60.0, greatest(0.0, 30.0 + shift)) AS soc FROM p WHERE rn = 1
  UNION ALL SELECT p.user_id, p.rn, p.event_id, least(60.0, greatest(0.0, s.soc + p.shift)) FROM s JOIN p ON p.user_id = s.user_id AND p.rn = s.rn + 1)
SELECT user_id, event_id, round(soc, 6) AS battery_soc_mwh FROM s""")
def state_of_charge(t):
    p = t.events.select("user_id", "event_id", "ts", (F.col("value") - 20).alias("power"))
    soc = series.state_of_charge(p, ["user_id"], "ts", "power", 30.0, 60.0, tie=["event_id"])
    return out(soc.select("user_id", "event_id", "battery_soc_mwh"))


@query("window_contiguity", """
WITH w AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS a, CAST(date_trunc('month', o_orderdate) + INTERVAL '1 month' AS DATE) AS z FROM orders GROUP BY ALL)
SELECT o_custkey, a, z, lead(a) OVER (PARTITION BY o_custkey ORDER BY a) AS next_start,
  CAST(lead(a) OVER (PARTITION BY o_custkey ORDER BY a) = z AS VARCHAR) AS adjoins FROM w""", dates=["a", "z", "next_start"])
def window_contiguity(t):
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    w = t.orders.select("o_custkey", month.alias("a"), F.add_months(month, 1).alias("z")).distinct()
    return out(series.window_contiguity(w, "o_custkey", "a", "z").withColumn("adjoins", F.col("adjoins").cast("string")))


@query("period_numbers", f"""
SELECT event_id, dense_rank() OVER (PARTITION BY event_type, {day("ts + INTERVAL '150 days'")} ORDER BY time_bucket(INTERVAL '30 minutes', ts)) AS settlement_period FROM events""")
def period_numbers(t):
    d = t.events.select("event_id", "event_type", clock.add_seconds("ts", 150 * 86400).alias("ts"))
    return out(series.day_period_numbers(d, "ts", ["event_type"]).select("event_id", "settlement_period"))


@query("to_half_hourly", """
WITH src AS (SELECT event_type AS in_domain, value,
    CASE event_type WHEN 'click' THEN 15 WHEN 'view' THEN 15 WHEN 'signup' THEN 60 ELSE 30 END AS res,
    CASE WHEN event_type IN ('click', 'view') THEN time_bucket(INTERVAL '15 minutes', ts)
         WHEN event_type = 'signup' THEN time_bucket(INTERVAL '1 hour', ts) ELSE time_bucket(INTERVAL '30 minutes', ts) END AS b FROM events),
one AS (SELECT in_domain, b, res, avg(value) AS v FROM src GROUP BY 1, 2, 3),
wide AS (SELECT in_domain, v, unnest(CASE WHEN res = 60 THEN [b, b + INTERVAL '30 minutes'] ELSE [time_bucket(INTERVAL '30 minutes', b)] END) AS timestamp FROM one)
SELECT timestamp, in_domain, 'GB' AS out_domain, round(avg(v), 6) AS v, CAST(30 AS BIGINT) AS resolution_minutes FROM wide GROUP BY 1, 2, 3""")
def to_half_hourly(t):
    kind = F.col("event_type")
    res = F.when(kind.isin("click", "view"), 15).when(kind == "signup", 60).otherwise(30)
    at = F.when(res == 15, clock.floor_to("ts", 900)).when(res == 60, clock.floor_to("ts", 3600)).otherwise(clock.half_hour("ts"))
    one = t.events.groupBy(kind.alias("in_domain"), F.lit("GB").alias("out_domain"), at.alias("timestamp"), res.alias("resolution_minutes")).agg(F.avg("value").alias("v"))
    return out(series.to_half_hourly(one, "v"))


KINDS = ["click", "view", "purchase", "signup", "error"]


@query("category_sums", """
SELECT time_bucket(INTERVAL '30 minutes', ts) AS timestamp, round(sum(value) FILTER (event_type = 'click'), 6) AS fuel_click_mw,
  round(sum(value) FILTER (event_type = 'view'), 6) AS fuel_view_mw, round(sum(value) FILTER (event_type = 'error'), 6) AS fuel_error_mw,
  round(sum(value) FILTER (event_type = 'purchase'), 6) AS fuel_purchase_mw, round(sum(value) FILTER (event_type = 'signup'), 6) AS fuel_signup_mw FROM events GROUP BY 1""")
def category_sums(t):
    d = t.events.withColumn("timestamp", clock.half_hour("ts"))
    return out(rel.sum_by_category(d, ["timestamp"], "event_type", "value", KINDS, "fuel_{}_mw"))


@query("found_category_sums", """
SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS "status_F", round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS "status_O",
  round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 6) AS "status_P" FROM orders GROUP BY 1""", dates=["d"])
def found_category_sums(t):
    found = rel.distinct_categories(t.orders, "o_orderstatus")
    return out(rel.sum_by_category(t.orders.withColumn("d", F.to_date("o_orderdate")), ["d"], "o_orderstatus", "o_totalprice", found, "status_{}"))


UNITS = """units AS (SELECT DISTINCT user_id AS bm_unit, CASE user_id % 3 WHEN 0 THEN 'battery' WHEN 1 THEN 'pumped_storage' ELSE 'other' END AS technology,
  CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS sign FROM events), gen AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS timestamp, user_id AS bm_unit, value AS generation_mw FROM events)"""


def units(t):
    m = F.col("user_id") % 3
    return t.events.select(F.col("user_id").alias("bm_unit"), F.when(m == 0, "battery").when(m == 1, "pumped_storage").otherwise("other").alias("technology"),
                           F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1).alias("sign")).distinct()


def generation(t):
    return t.events.select(clock.half_hour("ts").alias("timestamp"), F.col("user_id").alias("bm_unit"), F.col("value").alias("generation_mw"))


@query("storage_series", f"""
WITH {UNITS} SELECT timestamp, round(coalesce(sum(generation_mw * sign) FILTER (technology = 'battery'), 0), 6) AS battery_net_mw,
  round(coalesce(sum(generation_mw * sign) FILTER (technology = 'pumped_storage'), 0), 6) AS pumped_storage_net_mw,
  round(coalesce(sum(generation_mw * sign) FILTER (technology = 'other'), 0), 6) AS other_net_mw FROM gen JOIN units USING (bm_unit) GROUP BY 1""")
def storage_series(t):
    return out(rel.signed_by_technology(generation(t), units(t), ["battery", "pumped_storage", "other"]))


@query("technology_output", f"""
WITH {UNITS} SELECT timestamp, round(-sum(generation_mw), 6) AS generation_mw FROM gen JOIN units USING (bm_unit) WHERE technology = 'battery' GROUP BY 1""")
def technology_output(t):
    return out(rel.technology_output(generation(t), units(t), "Battery", sign=-1.0))


FLOWS = """f AS (SELECT event_type AS border, user_id % 2 AS direction, time_bucket(INTERVAL '30 minutes', ts) AS timestamp, sum(value) AS flow_mw FROM events GROUP BY 1, 2, 3)"""


def flows(t):
    return t.events.groupBy(F.col("event_type").alias("border"), (F.col("user_id") % 2).alias("direction"), clock.half_hour("ts").alias("timestamp")).agg(F.sum("value").alias("flow_mw"))


@query("directional_flows", f"""
WITH {FLOWS} SELECT border, timestamp, round(coalesce(sum(flow_mw) FILTER (direction = 0), 0), 6) AS gb_import_mw,
  round(coalesce(sum(flow_mw) FILTER (direction = 1), 0), 6) AS gb_export_mw,
  round(coalesce(sum(flow_mw) FILTER (direction = 0), 0) - coalesce(sum(flow_mw) FILTER (direction = 1), 0), 6) AS gb_net_import_mw FROM f GROUP BY 1, 2""")
def directional_flows(t):
    f = flows(t)
    return out(rel.directional_flows(f.where("direction = 0"), f.where("direction = 1"), "gb", keys=["border", "timestamp"]))


@query("total_net_import", f"""
WITH {FLOWS} SELECT timestamp, round(sum(CASE direction WHEN 0 THEN flow_mw ELSE -flow_mw END), 6) AS net_import_mw FROM f GROUP BY 1""")
def total_net_import(t):
    f = flows(t)
    borders = [rel.directional_flows(f.where((F.col("border") == b) & (F.col("direction") == 0)), f.where((F.col("border") == b) & (F.col("direction") == 1)), b)
               for b in KINDS]
    return out(rel.total_net_import(borders).select("timestamp", "net_import_mw"))


@query("daily_energy_and_peaks", f"""
WITH {COMPONENTS} SELECT {day('timestamp')} AS delivery_date, round(sum(demand_mw) * 0.5, 6) AS demand_mw_energy_mwh, round(sum(net_import_mw) * 0.5, 6) AS net_import_mw_energy_mwh,
  max(demand_mw) AS peak_demand_mw, arg_max(timestamp, demand_mw ORDER BY timestamp) AS peak_demand_mw_at,
  min(nuclear_mw) AS minimum_nuclear_mw, min(timestamp) FILTER (nuclear_mw = lo) AS minimum_nuclear_mw_at
FROM (SELECT *, min(nuclear_mw) OVER (PARTITION BY {day('timestamp')}) AS lo FROM components) GROUP BY 1""", dates=["delivery_date"])
def daily_energy_and_peaks(t):
    d = t.components.withColumn("delivery_date", clock.delivery_date("timestamp"))
    return out(risk.energy_and_peaks(d, ["delivery_date"], "timestamp", ["demand_mw", "net_import_mw"], ["demand_mw"], ["nuclear_mw"]))


@query("component_sources", """
SELECT user_id, component, CASE WHEN min(source) = max(source) THEN min(source) ELSE 'mixed' END AS source FROM (
  SELECT user_id, 'demand_mw' AS component, CASE WHEN value > 100 THEN 'fallback_d7' ELSE 'model' END AS source FROM events
  UNION ALL SELECT user_id, 'nuclear_mw', event_type FROM events WHERE event_type = 'click') GROUP BY 1, 2""")
def component_sources(t):
    d = t.events.select("user_id", F.when(F.col("value") > 100, "fallback_d7").otherwise("model").alias("component_source_demand_mw"),
                        F.when(F.col("event_type") == "click", F.col("event_type")).alias("component_source_nuclear_mw"))
    return out(risk.single_sources(d, ["user_id"], ["demand_mw", "nuclear_mw"]))


@query("latest_days", f"""
WITH {COMPONENTS} SELECT {day('timestamp')} AS delivery_date, round(sum(demand_mw) * 0.5, 6) AS demand_mwh FROM components GROUP BY 1 ORDER BY 1 DESC LIMIT 14""", dates=["delivery_date"])
def latest_days(t):
    d = t.components.groupBy(clock.delivery_date("timestamp").alias("delivery_date")).agg((F.sum("demand_mw") * 0.5).alias("demand_mwh"))
    return out(d.orderBy(F.desc("delivery_date")).limit(14))


@query("ordered_revisions", """SELECT user_id, ts, value FROM events ORDER BY user_id, ts""")
def ordered_revisions(t):
    return out(t.events.select("user_id", "ts", "value").orderBy("user_id", "ts"))


@query("stacked_chunks", """
SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def stacked_chunks(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return out(a.unionByName(b, allowMissingColumns=True))
