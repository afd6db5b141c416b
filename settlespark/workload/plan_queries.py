"""Log tables, jobs, models and streams over the shared tables."""

from functools import reduce

from pyspark.sql import functions as F

from settlespark import constants as K
from settlespark.functions import clock
from settlespark.operators import risk, scoring, timeline
from settlespark.plans import day_ahead, dataset, history, logs, models
from settlespark.session import durable, shared_path
from settlespark.streaming import jobs
from settlespark.workload.registry import COMPONENTS, HH, day, day_length, day_start, out, period, query
from settlespark.workload.score_queries import FORECASTS, RISK, SCORES, actuals, forecasts, rounded, scenario_risks, scores

MIDDLE = "2024-01-16"
GRID = f"""{COMPONENTS}, span AS (SELECT {day('min(timestamp)')} AS a, {day('max(timestamp)')} + 1 AS z FROM components),
grid AS (SELECT unnest(generate_series({day_start('a')}, {day_start('z')} - INTERVAL '30 minutes', INTERVAL '30 minutes')) AS timestamp FROM span),
train AS (SELECT timestamp FROM grid WHERE {day('timestamp')} <> {day('TIMESTAMP ' + chr(39) + MIDDLE + chr(39))})"""


@query("store_append", f"""
WITH {FORECASTS} SELECT model_version, issue_time_utc, delivery_time_utc, forecast_id, {rounded(['p10', 'p50', 'p90'])}, negative_probability FROM forecasts""")
def store_append(t):
    log, f = logs.forecast_log(t.spark, shared_path(t.spark, "forecasts")), forecasts(t)
    cut = F.lit(MIDDLE).cast("timestamp")
    logs.append_forecast_batch(log, f.where(F.col("delivery_time_utc") < cut).drop("forecast_id"))
    logs.append_forecast_batch(log, f.where(F.col("delivery_time_utc") >= cut))
    return out(log.read())


@query("store_append_new", f"""
WITH {FORECASTS} SELECT delivery_time_utc, actual_revision, round(actual_price + CASE WHEN delivery_time_utc < TIMESTAMP '{MIDDLE}' THEN 0.5 ELSE 0 END, 6) AS actual_price FROM actuals""")
def store_append_new(t):
    log, a = logs.actual_log(t.spark, shared_path(t.spark, "actuals")), actuals(t)
    early = a.where(F.col("delivery_time_utc") < F.lit(MIDDLE).cast("timestamp"))
    log.append_new(early.withColumn("actual_price", F.col("actual_price") + 0.5))
    log.append_new(a.unionByName(a))
    return out(log.read())


@query("store_upsert", f"""
WITH {SCORES} SELECT forecast_id, actual_revision, delivery_time_utc, round(error + CASE WHEN actual_revision = 'final' AND delivery_time_utc < TIMESTAMP '{MIDDLE}' THEN 2 ELSE 0 END, 6) AS error,
  CASE WHEN actual_revision = 'final' AND delivery_time_utc < TIMESTAMP '{MIDDLE}' THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-02-01' END AS graded_at_utc FROM scores""")
def store_upsert(t):
    log = logs.score_log(t.spark, shared_path(t.spark, "scores"))
    s = scores(t).select("forecast_id", "actual_revision", "delivery_time_utc", "error")
    log.upsert(s.withColumn("graded_at_utc", F.lit("2024-02-01").cast("timestamp")))
    # A later run: part of the rows moved, the rest only by rounding noise.
    moved = (F.col("actual_revision") == "final") & (F.col("delivery_time_utc") < F.lit(MIDDLE).cast("timestamp"))
    again = s.withColumn("error", F.when(moved, F.col("error") + 2).otherwise(F.col("error") * (1 + 1e-12)))
    log.upsert(again.withColumn("graded_at_utc", F.lit("2024-03-01").cast("timestamp")))
    return out(log.read())


@query("grade_store", f"""
WITH {SCORES} SELECT forecast_id, actual_revision, delivery_time_utc, p10_p90_covered, {rounded(['error', 'persistence_price', 'persistence_absolute_error'])} FROM scores""")
def grade_store(t):
    f, a, s = (make(t.spark, shared_path(t.spark, n)) for n, make in (("f", logs.forecast_log), ("a", logs.actual_log), ("s", logs.score_log)))
    logs.append_forecast_batch(f, forecasts(t))
    a.append_new(actuals(t))
    logs.grade_store(f, a, s)
    return out(s.read().select("forecast_id", "actual_revision", "delivery_time_utc", "p10_p90_covered", "error", "persistence_price", "persistence_absolute_error"))


@query("stored_days", f"""
WITH {HH}, have AS (SELECT DISTINCT series, {day('ts')} AS d, ts FROM hh), ask AS (SELECT DISTINCT o.series, {day('h.ts')} AS d, h.ts FROM (SELECT DISTINCT series FROM hh) o, (SELECT DISTINCT ts FROM hh WHERE series = 'click') h),
s AS (SELECT coalesce(a.series, b.series) AS model_version, coalesce(a.d, b.d) AS delivery_date, count(b.ts) AS stored, count(*) FILTER (a.ts IS NULL OR b.ts IS NULL) AS faults, count(a.ts) AS asked
  FROM ask a FULL JOIN have b ON a.series = b.series AND a.ts = b.ts GROUP BY 1, 2)
SELECT model_version, delivery_date, stored AS stored_periods, CASE WHEN stored = 0 THEN 'absent' WHEN faults = 0 THEN 'exact' ELSE 'misaligned' END AS status FROM s WHERE asked > 0""", dates=["delivery_date"])
def stored_days(t):
    have = t.hh.select(F.col("series").alias("model_version"), F.col("ts").alias("delivery_time_utc"))
    # Every model is asked for the periods of one of them.
    names = F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup", "error")])
    ask = have.where("model_version = 'click'").select(F.explode(names).alias("model_version"), "delivery_time_utc")
    return out(logs.stored_day_status(have, ask))


@query("complete_days", f"""
WITH c AS (SELECT *, {day('timestamp')} AS delivery_date FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) AS timestamp, round(avg(value), 6) AS price FROM events GROUP BY 1))
SELECT timestamp, price, delivery_date FROM c WHERE delivery_date IN (SELECT delivery_date FROM c GROUP BY 1 HAVING count(*) = {day_length('delivery_date')})""", dates=["delivery_date"])
def complete_days(t):
    p = t.events.groupBy(clock.half_hour("ts").alias("timestamp")).agg(F.round(F.avg("value"), 6).alias("price"))
    return out(logs.complete_days(p, []))


DAILY = f"""{COMPONENTS}, daily AS (SELECT 'v1' AS model_version, {day_start(day('min(timestamp)'))} - INTERVAL '11 hours' AS forecast_issue_time_utc, {day('timestamp')} AS delivery_date,
  count(*) AS period_count, round(avg(inertia_gvas), 6) AS p50_mean_gbp_mwh FROM components GROUP BY {day('timestamp')})"""


def daily_reports(t):
    c = t.components.withColumn("delivery_date", clock.delivery_date("timestamp"))
    return c.groupBy("delivery_date").agg(F.count(F.lit(1)).alias("period_count"), F.round(F.avg("inertia_gvas"), 6).alias("p50_mean_gbp_mwh")).select(
        F.lit("v1").alias("model_version"), clock.issue_instant(clock.day_start("delivery_date")).alias("forecast_issue_time_utc"), "delivery_date", "period_count", "p50_mean_gbp_mwh")


@query("history_upsert", f"WITH {DAILY} SELECT model_version, forecast_issue_time_utc, delivery_date, period_count, CASE WHEN period_count < 48 THEN 0 ELSE p50_mean_gbp_mwh END AS p50_mean_gbp_mwh FROM daily", dates=["delivery_date"])
def history_upsert(t):
    log, rows = logs.history_log(t.spark, shared_path(t.spark, "history"), K.FORECAST_HISTORY_KEY), daily_reports(t)
    log.keep_history(rows.where(F.col("delivery_date") < F.lit(MIDDLE).cast("date")))
    log.keep_history(rows)  # the stored half is equal and left alone
    fixed = F.when(F.col("period_count") < 48, F.lit(0.0)).otherwise(F.col("p50_mean_gbp_mwh"))
    log.keep_history(rows.withColumn("p50_mean_gbp_mwh", fixed), replace=True)
    return out(log.read())


@query("summary_merge", f"""
WITH {DAILY} SELECT delivery_date, model_version, CASE WHEN delivery_date >= DATE '{MIDDLE}' THEN CAST(period_count AS DOUBLE) END AS graded_periods, p50_mean_gbp_mwh FROM daily""", dates=["delivery_date"])
def summary_merge(t):
    log, rows = logs.history_log(t.spark, shared_path(t.spark, "summary"), ["delivery_date"]), daily_reports(t)
    log.merge_columns(rows.select("delivery_date", "model_version", "p50_mean_gbp_mwh"))
    graded = rows.where(F.col("delivery_date") >= F.lit(MIDDLE).cast("date"))
    log.merge_columns(graded.select("delivery_date", F.col("period_count").cast("double").alias("graded_periods"), F.lit(None).cast("string").alias("model_version")))
    return out(log.read())


@query("registered_forecasts", f"""
WITH {RISK}, n AS (SELECT {day('timestamp')} AS delivery_date, count(*) AS period_count FROM components GROUP BY 1)
SELECT delivery_date, 'v1' AS model_version, period_count, round(scenario_var, 6) AS scenario_var_gbp, round(expected_shortfall, 6) AS expected_shortfall_gbp,
  round(worst_loss, 6) AS worst_loss_gbp, round(best_profit, 6) AS best_profit_gbp FROM risk JOIN n USING (delivery_date)""", dates=["delivery_date"])
def registered_forecasts(t):
    risks = scenario_risks(t)
    n = t.components.groupBy(clock.delivery_date("timestamp").alias("delivery_date")).agg(F.count(F.lit(1)).alias("period_count"))
    reports = risks.join(n, "delivery_date").withColumns({
        "model_version": F.lit("v1"), "forecast_issue_time_utc": clock.issue_instant(clock.day_start("delivery_date")), "expected_period_count": F.col("period_count")})
    h = logs.history_log(t.spark, shared_path(t.spark, "fh"), K.FORECAST_HISTORY_KEY)
    s = logs.history_log(t.spark, shared_path(t.spark, "fs"), ["delivery_date"])
    logs.register_forecasts(h, s, reports)
    return out(s.read().drop("forecast_issue_time_utc"))


@query("registered_gradings", f"""
WITH {SCORES}, a AS (SELECT actual_revision, {day('delivery_time_utc')} AS delivery_date, count(*) AS actual_periods FROM actuals GROUP BY 1, 2),
g AS (SELECT model_version, actual_revision, {day('delivery_time_utc')} AS delivery_date, count(*) AS graded_periods, avg(absolute_error) AS mae, count(*) FILTER (actual_negative) AS neg FROM scores GROUP BY 1, 2, 3),
m AS (SELECT model_version, count(DISTINCT {day('delivery_time_utc')}) AS graded_delivery_days_total FROM scores GROUP BY 1)
SELECT m.model_version, a.actual_revision, a.delivery_date, a.actual_periods, coalesce(g.graded_periods, 0) AS graded_periods, round(g.mae, 6) AS model_mae_gbp_mwh,
  'shadow_only' AS deployment_mode, graded_delivery_days_total FROM a CROSS JOIN m LEFT JOIN g USING (model_version, actual_revision, delivery_date)
QUALIFY row_number() OVER (PARTITION BY a.delivery_date ORDER BY coalesce(g.graded_periods, 0) DESC, a.actual_revision DESC, m.model_version DESC) = 1""", dates=["delivery_date"])
def registered_gradings(t):
    s = scores(t)
    gate = scoring.deployment_gate(s, min_improvement=1000.0)
    h = logs.history_log(t.spark, shared_path(t.spark, "gh"), K.GRADING_HISTORY_KEY)
    m = logs.history_log(t.spark, shared_path(t.spark, "gs"), ["delivery_date"])
    logs.register_gradings(h, m, s, actuals(t), gate)
    logs.register_gradings(h, m, s, actuals(t), gate)  # a second run changes nothing
    return out(m.read().select("model_version", "actual_revision", "delivery_date", "actual_periods", "graded_periods", "model_mae_gbp_mwh", "deployment_mode", "graded_delivery_days_total"))


@query("grading_history", f"""
WITH {SCORES}, a AS (SELECT actual_revision, {day('delivery_time_utc')} AS delivery_date, count(*) AS actual_periods FROM actuals GROUP BY 1, 2),
g AS (SELECT model_version, actual_revision, {day('delivery_time_utc')} AS delivery_date, count(*) AS graded_periods FROM scores GROUP BY 1, 2, 3), m AS (SELECT DISTINCT model_version FROM scores)
SELECT m.model_version, a.actual_revision, a.delivery_date, a.actual_periods, coalesce(g.graded_periods, 0) AS graded_periods FROM a CROSS JOIN m LEFT JOIN g USING (model_version, actual_revision, delivery_date)""", dates=["delivery_date"])
def grading_history(t):
    s = scores(t)
    h = logs.history_log(t.spark, shared_path(t.spark, "gh"), K.GRADING_HISTORY_KEY)
    logs.register_gradings(h, logs.history_log(t.spark, shared_path(t.spark, "gs"), ["delivery_date"]), s, actuals(t), scoring.deployment_gate(s))
    return out(h.read().select("model_version", "actual_revision", "delivery_date", "actual_periods", "graded_periods"))


@query("graded_in_spans", f"""
WITH {SCORES} SELECT forecast_id, actual_revision, {rounded(['error', 'persistence_price'])} FROM scores""")
def graded_in_spans(t):
    """Actuals arrive in two halves of the month; each run grades the dates it touches and the day after."""
    f, a, s = (make(t.spark, shared_path(t.spark, n)) for n, make in (("f", logs.forecast_log), ("a", logs.actual_log), ("s", logs.score_log)))
    logs.append_forecast_batch(f, forecasts(t))
    cut, local = F.lit(MIDDLE).cast("date"), clock.delivery_date("delivery_time_utc")
    for half in (actuals(t).where(local < cut), actuals(t).where(local >= cut)):
        span = a.append_new(half).agg(F.min(local), F.max(local)).first()
        logs.grade_store(f, a, s, span)
    return out(s.read().select("forecast_id", "actual_revision", "error", "persistence_price"))


@query("appended_forecast_days", f"""
WITH {FORECASTS} SELECT model_version, forecast_id, delivery_time_utc, {rounded(['p50'])} FROM forecasts""")
def appended_forecast_days(t):
    """All days of all models, appended at once and then offered again for reuse."""
    f = durable(forecasts(t))
    log = logs.forecast_log(t.spark, shared_path(t.spark, "days"))
    logs.log_forecast_days(log, f)
    logs.log_forecast_days(log, f, reuse=True)
    return out(log.read().select("model_version", "forecast_id", "delivery_time_utc", "p50"))


@query("appended_actuals", f"""
WITH {GRID}, p AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS timestamp, round(avg(value), 6) AS price FROM events GROUP BY 1)
SELECT timestamp AS delivery_time_utc, 'initial' AS actual_revision, coalesce(price, 0) AS actual_price FROM grid LEFT JOIN p USING (timestamp)""")
def appended_actuals(t):
    """Prices of whole days appended in two windows that overlap; what is known already is skipped."""
    grid = t.events.agg(clock.delivery_date(F.min("ts")).alias("a"), F.date_add(clock.delivery_date(F.max("ts")), 1).alias("z"))
    a, z = grid.first()
    prices = t.events.groupBy(clock.half_hour("ts").alias("timestamp")).agg(F.round(F.avg("value"), 6).alias("price_gbp_mwh"))
    whole = timeline.settlement_spine(timeline.dates_between(grid, "a", "z")).select("timestamp").join(prices, "timestamp", "left").fillna(0.0)
    log = logs.actual_log(t.spark, shared_path(t.spark, "actuals"))
    logs.append_actuals(log, whole, str(a), MIDDLE, "initial")
    logs.append_actuals(log, whole.withColumn("price_gbp_mwh", F.when(F.col("timestamp") < F.lit(MIDDLE).cast("timestamp"), -1.0).otherwise(F.col("price_gbp_mwh"))), str(a), str(z), "initial")
    return out(log.read())


@query("risk_log", f"""
WITH {RISK} SELECT 'v1' AS model_version, {day_start('delivery_date')} - INTERVAL '11 hours' AS issue_time_utc, delivery_date, {rounded(['scenario_var', 'expected_shortfall', 'worst_loss', 'best_profit'])} FROM risk""", dates=["delivery_date"])
def risk_log(t):
    rows = scenario_risks(t).withColumns({"model_version": F.lit("v1"), "issue_time_utc": clock.issue_instant(clock.day_start("delivery_date"))})
    log = logs.history_log(t.spark, shared_path(t.spark, "risk"), K.RISK_LOG_KEY)
    log.keep_history(rows)
    log.keep_history(rows)
    return out(log.read())


@query("history_index", f"""
WITH {DAILY}, archived AS (SELECT DISTINCT {day('ts')} AS delivery_date FROM events WHERE event_type = 'click'),
s AS (SELECT delivery_date, CASE WHEN period_count = 48 THEN period_count ELSE 0 END AS g, p50_mean_gbp_mwh AS mae FROM daily),
d AS (SELECT delivery_date FROM archived UNION SELECT delivery_date FROM s)
SELECT d.delivery_date, a.delivery_date IS NOT NULL AS has_report, CASE WHEN coalesce(g, 0) > 0 THEN 'Graded (' || g || ' periods)' ELSE 'Pending' END AS grading,
  coalesce(format('{{:,.2f}}', mae), '—') AS model_mae, '—' AS persistence_mae, '—' AS improvement, '—' AS coverage FROM d LEFT JOIN archived a USING (delivery_date) LEFT JOIN s USING (delivery_date)""", dates=["delivery_date"])
def history_index(t):
    none = F.lit(None).cast("double")
    summary = daily_reports(t).select("delivery_date", F.when(F.col("period_count") == 48, F.col("period_count")).otherwise(0).alias("graded_periods"),
                                      F.col("p50_mean_gbp_mwh").alias("model_mae_gbp_mwh"), none.alias("persistence_mae_gbp_mwh"), none.alias("improvement_percent"), none.alias("p10_p90_coverage"))
    archived = t.events.where("event_type = 'click'").select(clock.delivery_date("ts").alias("delivery_date")).distinct()
    return out(logs.history_index(summary, archived))


# --- datasets and reports ---------------------------------------------------------------

def source_tables(t):
    # Forecasts are published two days before; the last weather hour is carried.
    shifted, c = clock.add_seconds(clock.half_hour("ts"), 2 * 86400), t.components
    hourly = t.events.groupBy(clock.floor_to("ts", 3600).alias("timestamp")).agg(F.round(F.avg("value"), 4).alias("temp"))
    return {
        "price": c.select("timestamp", F.col("inertia_gvas").alias("p")), "demand": c.select("timestamp", F.col("demand_mw").alias("d")),
        "fuel": c.select("timestamp", F.col("transmission_wind_mw").alias("fuel_wind_mw"), F.col("nuclear_mw").alias("fuel_nuclear_mw"), "net_import_mw"),
        "embedded": t.events.select(shifted.alias("timestamp"), F.col("ts").alias("pub"), F.col("value").alias("w"), (F.col("value") / 2).alias("s")),
        "inertia": c.select("timestamp", F.col("inertia_gvas").alias("gva")),
        "weather_demand": hourly, "weather_wind": hourly.withColumnRenamed("temp", "wind"), "weather_solar": hourly.withColumnRenamed("temp", "sun"),
    }


MAPPING = {
    "columns": {"price_gbp_mwh": "p", "demand_mw": "d", "transmission_wind_mw": "fuel_wind_mw", "nuclear_mw": "fuel_nuclear_mw", "embedded_timestamp": "timestamp",
                "embedded_published_at": "pub", "embedded_wind_mw": "w", "embedded_solar_mw": "s", "inertia_timestamp": "timestamp", "inertia_gvas": "gva"},
    "optional_columns": {"net_import_mw": "net_import_mw"}, "required_components": K.CORE_COMPONENTS,
}


@query("modelling_table", f"""
WITH {COMPONENTS}, e AS (SELECT time_bucket(INTERVAL '30 minutes', ts) + INTERVAL '48 hours' AS timestamp, ts AS pub, value AS w, value / 2 AS s FROM events),
emb AS (SELECT * FROM e WHERE pub <= {day_start(day('timestamp'))} - INTERVAL '11 hours' QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY pub DESC) = 1),
h AS (SELECT date_trunc('hour', ts) AS t, round(avg(value), 4) AS v FROM events GROUP BY 1),
wx AS (SELECT c.timestamp, CASE WHEN b.t IS NULL OR b.t = a.t THEN a.v ELSE a.v + (b.v - a.v) * (epoch(c.timestamp) - epoch(a.t)) / (epoch(b.t) - epoch(a.t)) END AS temp
  FROM components c ASOF LEFT JOIN h a ON c.timestamp >= a.t ASOF LEFT JOIN h b ON c.timestamp <= b.t)
SELECT c.timestamp, c.timestamp AS delivery_time_utc, c.inertia_gvas AS price_gbp_mwh, c.demand_mw, c.transmission_wind_mw, c.nuclear_mw, {day_start(day('c.timestamp'))} - INTERVAL '11 hours' AS issue_time_utc,
  emb.w AS embedded_wind_mw, emb.s AS embedded_solar_mw, c.inertia_gvas, round(temp, 10) AS temp, round(temp, 10) AS wind, round(temp, 10) AS sun, round(c.net_import_mw, 6) + 0.0 AS net_import_mw, 'core_without_battery' AS model_profile
FROM components c LEFT JOIN emb USING (timestamp) LEFT JOIN wx USING (timestamp)""")
def modelling_table(t):
    """All periods; those without a forecast published two days before, as in the first two days, keep null."""
    return out(dataset.modelling_table(source_tables(t), MAPPING, gaps=True), 10)


@query("merged_archives", f"""
WITH {COMPONENTS}, span AS (SELECT {day('min(timestamp)')} AS a, {day('max(timestamp)')} + 1 AS z FROM components)
SELECT 'history-artifact-merge-v2' AS workflow_revision, CAST((epoch({day_start('z')}) - epoch({day_start('a')})) / 1800 AS BIGINT) AS full_calendar_half_hour_rows,
  CAST((epoch({day_start('z')}) - epoch({day_start('a')})) / 1800 AS BIGINT) - 48 AS training_half_hour_rows, CAST((epoch({day_start('z')}) - epoch({day_start('a')})) / 3600 AS BIGINT) AS expected_hour_rows,
  CAST({day('TIMESTAMP ' + chr(39) + MIDDLE + chr(39))} AS VARCHAR) AS excluded FROM span""")
def merged_archives(t):
    summary, _ = merged(t)
    return out(summary.select("workflow_revision", "full_calendar_half_hour_rows", "training_half_hour_rows", "expected_hour_rows",
                              F.array_join("excluded_settlement_dates_local", ",").alias("excluded")))


def merged(t):
    """Two archives of all sources, cut at the middle of the month: the summary and the folder of the merged tables."""
    grid = t.events.agg(clock.delivery_date(F.min("ts")).alias("a"), F.date_add(clock.delivery_date(F.max("ts")), 1).alias("z"))
    a, z = grid.first()
    spine = timeline.settlement_spine(timeline.dates_between(grid, "a", "z")).select("timestamp")
    filled = spine.join(t.components, "timestamp", "left").fillna(0.0)
    early = F.col("timestamp") < F.lit(MIDDLE).cast("timestamp")
    archived = lambda d: d.withColumn("archive", F.when(early, "one").otherwise("two"))
    seam = clock.delivery_date("timestamp") == F.lit(MIDDLE).cast("date")
    # Every period has a timely publication except the first day of the second archive.
    published = F.when(seam, clock.add_seconds("timestamp", 60)).otherwise(clock.add_seconds(clock.issue_instant("timestamp"), -3600))
    embedded = archived(filled.select("timestamp", "embedded_wind_mw", "embedded_solar_mw", published.alias("published_at_utc")))
    hours = timeline.settlement_spine(timeline.dates_between(grid, "a", "z"), step_s=3600).select("timestamp")
    weather = archived(hours.join(t.events.groupBy(clock.floor_to("ts", 3600).alias("timestamp")).agg(F.avg("value").alias("temp")), "timestamp", "left").fillna(0.0))
    tables = {n: archived(filled.select("timestamp", c)) for n, c in
              (("price", "inertia_gvas"), ("demand", "demand_mw"), ("fuel", "nuclear_mw"), ("interconnectors", "net_import_mw"), ("inertia", "inertia_gvas"))}
    tables |= {"embedded": embedded, "weather_demand": weather, "weather_wind": weather, "weather_solar": weather}
    bounds = [("one", str(a), MIDDLE), ("two", MIDDLE, str(z))]
    windows = t.spark.createDataFrame(bounds, "archive string, s string, e string").select(
        "archive", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"), F.lit(history.ARCHIVE_REVISION).alias("revision"),
        F.lit(0).alias("failed_steps"), F.lit(0).alias("audit_errors"))
    path = shared_path(t.spark, "merged")
    return history.merge_archives(windows, tables, str(a), str(z), path), path


@query("merged_sources", f"""
WITH {GRID}, n AS (SELECT timestamp, coalesce(inertia_gvas, 0) AS inertia_gvas, coalesce(demand_mw, 0) AS demand_mw, coalesce(nuclear_mw, 0) AS nuclear_mw, coalesce(net_import_mw, 0) AS net_import_mw FROM train LEFT JOIN components USING (timestamp))
{' UNION ALL '.join(f"SELECT '{n}' AS table_name, timestamp, round({c}, 6) + 0.0 AS value FROM n" for n, c in (('price', 'inertia_gvas'), ('demand', 'demand_mw'), ('fuel', 'nuclear_mw'), ('interconnectors', 'net_import_mw'), ('inertia', 'inertia_gvas')))}""")
def merged_sources(t):
    """Every row of the five half-hourly tables that a merge of two archives leaves."""
    _, path = merged(t)
    columns = (("price", "inertia_gvas"), ("demand", "demand_mw"), ("fuel", "nuclear_mw"), ("interconnectors", "net_import_mw"), ("inertia", "inertia_gvas"))
    parts = [t.spark.read.parquet(f"{path}/{n}").select(F.lit(n).alias("table_name"), "timestamp", F.col(c).alias("value")) for n, c in columns]
    return out(reduce(lambda x, y: x.unionByName(y), parts))


@query("merged_revisions", f"""
WITH {GRID} SELECT timestamp, coalesce(embedded_wind_mw, 0) AS embedded_wind_mw, coalesce(embedded_solar_mw, 0) AS embedded_solar_mw, {day_start(day('timestamp'))} - INTERVAL '12 hours' AS published_at_utc,
  {day_start(day('timestamp'))} - INTERVAL '11 hours' AS selected_issue_time_utc FROM train LEFT JOIN components USING (timestamp)""")
def merged_revisions(t):
    """The revisions that were known at each period's issue time; the seam day, published too late, has none."""
    _, path = merged(t)
    return out(t.spark.read.parquet(f"{path}/embedded"))


@query("merged_weather", f"""
WITH {GRID}, h AS (SELECT date_trunc('hour', ts) AS timestamp, avg(value) AS temp FROM events GROUP BY 1),
hours AS (SELECT unnest(generate_series({day_start('a')}, {day_start('z')} - INTERVAL '1 hour', INTERVAL '1 hour')) AS timestamp FROM span),
w AS (SELECT timestamp, round(coalesce(temp, 0), 6) AS temp FROM hours LEFT JOIN h USING (timestamp)),
e AS (SELECT * FROM w UNION ALL SELECT timestamp + INTERVAL '1 hour', temp FROM w WHERE timestamp = (SELECT max(timestamp) FROM w))
SELECT g AS weather, timestamp, temp FROM e, (VALUES ('demand'), ('wind'), ('solar')) AS x(g)""")
def merged_weather(t):
    """Hourly weather of three groups on the exact clock, with the last hour carried to the end."""
    _, path = merged(t)
    parts = [t.spark.read.parquet(f"{path}/weather_{g}").select(F.lit(g).alias("weather"), "timestamp", F.col(f"weather_{g}_temp").alias("temp")) for g in ("demand", "wind", "solar")]
    return out(reduce(lambda x, y: x.unionByName(y), parts))


@query("half_hourly_report", f"""
WITH {COMPONENTS} SELECT {day('timestamp')} AS delivery_date, {period('timestamp')} AS settlement_period, strftime(timestamp AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London', '%H:%M') AS gb_time,
  demand_mw, embedded_solar_mw AS solar_mw, round(net_import_mw, 6) + 0.0 AS net_import_mw, round(inertia_gvas - 5, 6) AS price_p10_gbp_mwh, inertia_gvas AS price_p50_gbp_mwh, round(inertia_gvas + 5, 6) AS price_p90_gbp_mwh,
  round(demand_mw - embedded_wind_mw - transmission_wind_mw - embedded_solar_mw, 6) AS residual_before_nuclear_mw FROM components""", dates=["delivery_date"])
def half_hourly_report(t):
    system, price = report_inputs(t)
    rows = day_ahead.half_hourly_report(system, price)
    return out(rows.select("delivery_date", "settlement_period", "gb_time", "demand_mw", "solar_mw", "net_import_mw", "price_p10_gbp_mwh", "price_p50_gbp_mwh", "price_p90_gbp_mwh", "residual_before_nuclear_mw"))


def report_inputs(t):
    from settlespark.functions.features import balance_layers
    system = balance_layers(t.components.drop("battery_net_mw"))
    p = F.col("inertia_gvas")
    price = t.components.select("timestamp", (p - 5).alias("p10"), p.alias("p50"), (p + 5).alias("p90"), (p < 60).cast("double").alias("negative_probability"))
    return system, price


@query("report_price_summary", f"""
WITH {COMPONENTS} SELECT {day('timestamp')} AS delivery_date, min(inertia_gvas) AS p50_min_gbp_mwh, round(avg(inertia_gvas), 6) AS p50_mean_gbp_mwh, max(inertia_gvas) AS p50_max_gbp_mwh,
  max((inertia_gvas < 60)::DOUBLE) AS maximum_negative_price_probability FROM components GROUP BY 1""", dates=["delivery_date"])
def report_price_summary(t):
    system, price = report_inputs(t)
    return out(day_ahead.daily_market_report(system, price, scenario_risks(t))["price_summary"])


ENERGY = (("demand_mw", "demand_mw"), ("total_wind_mw", "embedded_wind_mw + transmission_wind_mw"), ("embedded_solar_mw", "embedded_solar_mw"), ("nuclear_mw", "nuclear_mw"), ("net_import_mw", "net_import_mw"))
LAYERS = f"""{COMPONENTS}, s AS (SELECT timestamp, {day('timestamp')} AS delivery_date, demand_mw, embedded_wind_mw + transmission_wind_mw AS total_wind_mw, embedded_solar_mw, nuclear_mw, net_import_mw, inertia_gvas,
  demand_mw - (embedded_wind_mw + transmission_wind_mw + embedded_solar_mw) - nuclear_mw AS residual_after_nuclear_mw, demand_mw - (embedded_wind_mw + transmission_wind_mw + embedded_solar_mw) - nuclear_mw - net_import_mw AS net_system_short_mw FROM components)"""


def _extreme(name, column, worst="max"):
    return f"round({worst}({column}), 6) + 0.0 AS {name}, arg_{worst}(timestamp, round({column}, 6) {'-' if worst == 'max' else '+'} epoch(timestamp) / 1e13) AS {name}_at"


@query("report_energy_and_peaks", f"""
WITH {LAYERS} SELECT delivery_date, {', '.join(f"round(sum(round({c}, 6)) * 0.5, 6) + 0.0 AS {c}_energy_mwh" for c, _ in ENERGY)},
  {', '.join(_extreme(f'peak_{c}', c) for c in ('demand_mw', 'total_wind_mw', 'embedded_solar_mw'))}, {_extreme('minimum_nuclear_mw', 'nuclear_mw', 'min')} FROM s GROUP BY 1""", dates=["delivery_date"])
def report_energy_and_peaks(t):
    system, price = report_inputs(t)
    rounded_system = system.withColumns({c: F.round(c, 6) for c in ("demand_mw", "total_wind_mw", "embedded_solar_mw", "nuclear_mw", "net_import_mw")})
    found = day_ahead.daily_market_report(rounded_system, price, scenario_risks(t))["energy_and_peaks"]
    return out(found.select("delivery_date", *[f"{c}_energy_mwh" for c, _ in ENERGY],
                            *[f"{n}{e}" for n in ("peak_demand_mw", "peak_total_wind_mw", "peak_embedded_solar_mw", "minimum_nuclear_mw") for e in ("", "_at")]))


@query("report_price_extremes", f"""
WITH {COMPONENTS} SELECT {day('timestamp')} AS delivery_date, {_extreme('peak_p50', 'inertia_gvas')}, {_extreme('minimum_p50', 'inertia_gvas', 'min')} FROM components GROUP BY 1""", dates=["delivery_date"])
def report_price_extremes(t):
    system, price = report_inputs(t)
    return out(day_ahead.daily_market_report(system, price.withColumn("p50", F.round("p50", 6)), scenario_risks(t))["price_extremes"])


@query("report_position_limits", f"""
WITH {RISK} SELECT delivery_date, {rounded(['scenario_var', 'expected_shortfall', 'worst_loss', 'best_profit'])}, 10000.0 AS daily_risk_budget_gbp, round(least(1000000 / scenario_var, 1000000 / expected_shortfall), 6) AS maximum_volume_binding_mwh
FROM risk WHERE scenario_var > 0 AND expected_shortfall > 0""", dates=["delivery_date"])
def report_position_limits(t):
    system, price = report_inputs(t)
    losing = scenario_risks(t).where("scenario_var > 0 and expected_shortfall > 0")
    return out(day_ahead.daily_market_report(system, price, losing)["position_limits"].select(
        "delivery_date", "scenario_var", "expected_shortfall", "worst_loss", "best_profit", "daily_risk_budget_gbp", "maximum_volume_binding_mwh"))


@query("report_component_sources", f"""
WITH {COMPONENTS}, d AS (SELECT {day('timestamp')} AS delivery_date, 'model' AS demand_mw, CASE WHEN {period('timestamp')} > 24 THEN 'fallback_d7' ELSE 'model' END AS nuclear_mw FROM components)
SELECT delivery_date, component, CASE WHEN min(source) = max(source) THEN min(source) ELSE 'mixed' END AS source FROM (SELECT delivery_date, 'demand_mw' AS component, demand_mw AS source FROM d UNION ALL SELECT delivery_date, 'nuclear_mw', nuclear_mw FROM d) GROUP BY 1, 2""", dates=["delivery_date"])
def report_component_sources(t):
    system, price = report_inputs(t)
    late = clock.settlement_period("timestamp") > 24
    marked = system.withColumns({"component_source_demand_mw": F.lit("model"), "component_source_nuclear_mw": F.when(late, "fallback_d7").otherwise("model")})
    return out(day_ahead.daily_market_report(marked, price, scenario_risks(t))["component_sources"])


# --- features of delivery days ------------------------------------------------------------

@query("features_of_days", f"""
WITH {GRID}, h AS (SELECT date_trunc('hour', ts) AS t, avg(value) AS v FROM events GROUP BY 1),
hours AS (SELECT unnest(generate_series({day_start('a')}, {day_start('z')}, INTERVAL '1 hour')) AS t FROM span),
w AS (SELECT hours.t, round(coalesce(v, 0), 4) AS v FROM hours LEFT JOIN h USING (t)),
n AS (SELECT timestamp, coalesce(demand_mw, 0) AS demand_mw FROM grid LEFT JOIN components USING (timestamp)),
d AS (SELECT g.timestamp, {day('g.timestamp')} AS delivery_date, {day_start(day('g.timestamp'))} - INTERVAL '11 hours' AS issue_time_utc, p.demand_mw AS fallback_d7_demand_mw FROM grid g JOIN n p ON p.timestamp = g.timestamp - INTERVAL '168 hours')
SELECT d.timestamp, delivery_date, issue_time_utc, round(fallback_d7_demand_mw, 6) AS fallback_d7_demand_mw, round(a.v + (b.v - a.v) * (epoch(d.timestamp) - epoch(a.t)) / 3600, 6) AS weather_demand_temp,
  round(2 * (a.v + (b.v - a.v) * (epoch(d.timestamp) - epoch(a.t)) / 3600), 6) AS weather_wind_temp, (isodow(timezone('Europe/London', timezone('UTC', d.timestamp))) > 5)::BIGINT AS is_weekend, 'core_without_battery' AS model_profile
FROM d JOIN w a ON a.t = date_trunc('hour', d.timestamp) JOIN w b ON b.t = date_trunc('hour', d.timestamp) + INTERVAL '1 hour'""", dates=["delivery_date"])
def features_of_days(t):
    """Features of every delivery day that has a week of history before it."""
    grid = t.events.agg(clock.delivery_date(F.min("ts")).alias("a"), F.date_add(clock.delivery_date(F.max("ts")), 1).alias("z"))
    days = timeline.dates_between(grid, "a", "z")
    history = timeline.settlement_spine(days).select("timestamp").join(t.components.select("timestamp", "demand_mw"), "timestamp", "left").fillna(0.0)
    hours = timeline.settlement_spine(timeline.dates_between(grid.withColumn("z", F.date_add("z", 1)), "a", "z"), step_s=3600).select("timestamp")
    measured = t.events.groupBy(clock.floor_to("ts", 3600).alias("timestamp")).agg(F.round(F.avg("value"), 4).alias("temp"))
    weather = hours.join(measured, "timestamp", "left").fillna(0.0)
    wanted = timeline.dates_between(grid.withColumn("a", F.date_add("a", 7)), "a", "z").select("delivery_date", clock.issue_instant(clock.day_start("delivery_date")).alias("issue_time_utc"))
    found = day_ahead.features_of_days(wanted, {"demand": weather, "wind": weather.withColumn("temp", F.col("temp") * 2)}, K.PROFILE_CORE,
                                       ["hh_sin", "weather_demand_temp", "weather_wind_temp", "fallback_d7_demand_mw"], history, ["demand_mw"])
    return out(found.select("timestamp", "delivery_date", "issue_time_utc", "fallback_d7_demand_mw", "weather_demand_temp", "weather_wind_temp", "is_weekend", "model_profile"))


@query("prepared_features", f"""
WITH {COMPONENTS} SELECT timestamp, round(greatest(15.5 - demand_mw / 100, 0), 6) AS hdd, round(greatest(demand_mw / 100 - 22, 0), 6) AS cdd, round(pow(inertia_gvas / 50, 3), 6) AS wind_speed_cubed,
  CAST(month(timezone('Europe/London', timezone('UTC', timestamp))) AS BIGINT) AS month, round(sin(2 * pi() * ({period('timestamp')} - 1) / 48), 6) + 0.0 AS hh_sin,
  round(embedded_wind_mw + transmission_wind_mw, 6) AS total_wind_mw, round(demand_mw - (embedded_wind_mw + transmission_wind_mw + embedded_solar_mw) - nuclear_mw - net_import_mw - 1, 6) + 0.0 AS net_system_short_mw,
  round(greatest(50 - nuclear_mw, 0), 6) AS nuclear_modulation_mw FROM components""")
def prepared_features(t):
    from settlespark.functions.features import prepare_features
    c = t.components.withColumns({"temperature_c": F.col("demand_mw") / 100, "wind_speed_ms": F.col("inertia_gvas") / 50, "battery_net_mw": F.lit(1.0), "nuclear_available_mw": F.lit(50.0)})
    return out(prepare_features(c).select("timestamp", "hdd", "cdd", "wind_speed_cubed", "month", "hh_sin", "total_wind_mw", "net_system_short_mw", "nuclear_modulation_mw"))


# --- models: the twins state what holds of any fit ---------------------------------------

def training_rows(t):
    from settlespark.functions.features import calendar_features, weather_features
    c = t.components.withColumn("price_gbp_mwh", F.col("inertia_gvas") - 40).withColumn("temperature_c", F.col("demand_mw") / 100)
    return weather_features(calendar_features(c.drop("battery_net_mw"))).withColumn("model_profile", F.lit(K.PROFILE_CORE))


@query("fitted_price_model", f"""
WITH {COMPONENTS} SELECT timestamp, round(inertia_gvas - 40, 6) AS price_gbp_mwh, true AS in_range, true AS same_when_loaded FROM components""")
def fitted_price_model(t):
    """Predictions lie within the range of the target, and a saved model predicts the same."""
    df = durable(training_rows(t))
    features = ["hh_sin", "hh_cos", "temperature_c", "demand_mw"]
    model = models.fit_regressor(df, features, "price_gbp_mwh", "arcsinh")
    path = shared_path(t.spark, "price")
    model.save(path)
    both = models.Regressor.load(path).predict(model.predict(df, "prediction"), "again")
    low, high = df.agg(F.min("price_gbp_mwh"), F.max("price_gbp_mwh")).first()
    return out(both.select("timestamp", "price_gbp_mwh", F.col("prediction").between(low - 1e-6, high + 1e-6).alias("in_range"), (F.col("prediction") == F.col("again")).alias("same_when_loaded")))


@query("out_of_fold_predictions", f"""
WITH {COMPONENTS}, n AS (SELECT timestamp, demand_mw, row_number() OVER (ORDER BY timestamp) AS i, count(*) OVER () AS n FROM components)
SELECT timestamp, true AS in_range FROM n WHERE i > n - 5 * (n // 6)""")
def out_of_fold_predictions(t):
    """Five folds: the last five of six equal blocks have a prediction, the first has none."""
    df = training_rows(t)
    low, high = df.agg(F.min("demand_mw"), F.max("demand_mw")).first()
    folds = models.out_of_fold(df, ["hh_sin", "hh_cos", "temperature_c"], "demand_mw")
    return out(folds.select("timestamp", F.col("oof_demand_mw").between(low - 1e-6, high + 1e-6).alias("in_range")))


@query("curtailment_forecast", f"""
WITH {COMPONENTS} SELECT timestamp, true AS probability_in_range, true AS volume_not_negative, true AS expected_is_product FROM components""")
def curtailment_forecast(t):
    df = training_rows(t)
    # Wind above its mean is curtailed: both kinds of rows exist however many events a period has.
    level = df.agg(F.avg("embedded_wind_mw")).first()[0]
    df = df.withColumn("curtailed", F.greatest(F.col("embedded_wind_mw") - F.lit(level), F.lit(0.0)))
    fitted = models.fit_curtailment(df, ["hh_sin", "temperature_c", "embedded_wind_mw"], "curtailed")
    p, v, e = (F.col(c) for c in ("curtailment_probability", "conditional_curtailed_mw", "expected_curtailed_mw"))
    return out(models.predict_curtailment(fitted, df).select("timestamp", p.between(0, 1).alias("probability_in_range"), (v >= 0).alias("volume_not_negative"), (F.abs(e - p * v) < 1e-9).alias("expected_is_product")))


@query("marginal_technology", f"""
WITH {COMPONENTS} SELECT timestamp, true AS in_range, 1.0 AS total FROM components""")
def marginal_technology(t):
    df = training_rows(t)
    # Levels are means of the table: fixed ones make all rows one class where a period has many events.
    nuclear, wind = df.agg(F.avg("nuclear_mw"), F.avg("embedded_wind_mw")).first()
    df = df.withColumn("label", F.when(F.col("nuclear_mw") > F.lit(nuclear), "nuclear").when(F.col("embedded_wind_mw") > F.lit(wind), "wind").otherwise("gas"))
    model = models.fit_classes(df, ["nuclear_mw", "embedded_wind_mw", "hh_sin"], "label")
    kinds = ["gas", "nuclear", "wind"]
    names = [F.col(f"probability_{c}") for c in kinds]
    ok = names[0].between(0, 1) & names[1].between(0, 1) & names[2].between(0, 1)
    return out(models.class_probabilities(model, df, kinds).select("timestamp", ok.alias("in_range"), F.round(names[0] + names[1] + names[2], 9).alias("total")))


@query("platform_forecast", f"""
WITH {COMPONENTS}, w AS (SELECT b.timestamp FROM components b JOIN components a ON a.timestamp = b.timestamp - INTERVAL '168 hours')
SELECT {day('timestamp')} AS delivery_date, count(*) AS periods, count(*) AS ordered_quantiles, count(*) AS periods_of_day, true AS tail_beyond_var, true AS extremes_in_order FROM w GROUP BY 1""", dates=["delivery_date"])
def platform_forecast(t):
    """All five outputs of a forecast by a freshly trained bundle, folded to facts of each day.

    The fallback is what was observed 168 hours before; periods without it are not forecast.
    """
    from settlespark.operators.point_in_time import timestamp_lags
    df, path = durable(training_rows(t)), shared_path(t.spark, "models")
    rows = df.count()
    models.train(df, path, holdout_rows=max(2, rows // 5))
    models.prepare_bundle(df, path, holdout_rows=max(2, rows // 5))
    live = df.withColumn("_k", F.lit(0))
    for c in ("demand_mw", "nuclear_mw"):
        live = timestamp_lags(live, ["_k"], "timestamp", c, {f"fallback_d7_{c}": K.FALLBACK_LAG_S})
    made = models.forecast(live.drop("_k").dropna(subset=["fallback_d7_demand_mw", "fallback_d7_nuclear_mw"]), path)
    day = clock.delivery_date("timestamp").alias("delivery_date")
    points = made["points"].groupBy(day).agg(F.count(F.lit(1)).alias("periods"))
    prices = made["prices"].groupBy(day).agg(F.count_if((F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90"))).alias("ordered_quantiles"))
    summary = made["summary"].select("delivery_date", F.col("period_count").alias("periods_of_day"))
    risks = made["risk"].select("delivery_date", (F.col("expected_shortfall") >= F.col("scenario_var") - 1e-9).alias("tail_beyond_var"),
                                ((F.col("worst_loss") >= F.col("expected_shortfall") - 1e-9) & (F.col("worst_loss") >= -F.col("best_profit"))).alias("extremes_in_order"))
    return out(points.join(prices, "delivery_date").join(summary, "delivery_date").join(risks, "delivery_date"))


@query("hashed_scenarios", f"""
WITH {COMPONENTS} SELECT timestamp, CAST(1000 AS BIGINT) AS scenarios, CAST(1000 AS BIGINT) AS found_in_the_pool, true AS same_when_dealt_anew FROM components""")
def hashed_scenarios(t):
    """The default draw: every path's error stands in the error table, however the points are partitioned."""
    from settlespark.workload.score_queries import error_rows
    points, errors, targets = error_rows(t)
    points, errors = durable(points), durable(errors)
    pool = errors.select(F.round("net_import_mw", 6).alias("e")).where("e IS NOT NULL").distinct()
    base = points.select("timestamp", F.col("net_import_mw").alias("base"))

    def digests(rows):
        paths = risk.error_scenarios(rows, errors, targets).select("timestamp", "net_import_mw", F.xxhash64("scenario", *targets).cast("decimal(38,0)").alias("h"))
        drawn = paths.join(base, "timestamp").withColumn("e", F.round(F.round(F.col("net_import_mw") - F.col("base"), 9), 6))
        hits = drawn.join(pool.withColumn("hit", F.lit(1)), "e", "left")
        return hits.groupBy("timestamp").agg(F.count(F.lit(1)).alias("scenarios"), F.count("hit").alias("found_in_the_pool"), F.sum("h").alias("h"))

    one, other = digests(points.repartition(2)), digests(points.repartition(7)).select("timestamp", F.col("h").alias("h2"))
    return out(one.join(other, "timestamp").select("timestamp", "scenarios", "found_in_the_pool", (F.col("h") == F.col("h2")).alias("same_when_dealt_anew")))


@query("daily_block_scenarios", f"""
WITH {COMPONENTS} SELECT {day('timestamp')} AS delivery_date, count(*) * 1000 AS paths_rows, CAST(1000 AS BIGINT) AS scenarios, true AS one_error_day_a_path, true AS errors_of_that_day, true AS same_when_dealt_anew
FROM components GROUP BY 1""", dates=["delivery_date"])
def daily_block_scenarios(t):
    """Every path of a day takes its errors from one observed day, the same however the points are partitioned."""
    from settlespark.workload.score_queries import error_rows
    points, errors, targets = error_rows(t)
    # A period without an error gets none, so that whole days can be drawn.
    grid = t.events.agg(clock.delivery_date(F.min("ts")).alias("a"), F.date_add(clock.delivery_date(F.max("ts")), 1).alias("z"))
    spine = timeline.settlement_spine(timeline.dates_between(grid, "a", "z")).select("timestamp")
    points, errors = durable(points), durable(spine.join(errors, "timestamp", "left").fillna(0.0, targets))
    base = points.select("timestamp", F.col("net_import_mw").alias("base"))
    pool = errors.dropna(subset=targets).select(clock.delivery_date("timestamp").alias("error_date"), F.round("net_import_mw", 6).alias("e")).distinct()

    def digests(rows):
        paths = risk.daily_error_scenarios(rows, errors, targets).withColumn("delivery_date", clock.delivery_date("timestamp"))
        moved = paths.join(base, "timestamp").withColumn("e", F.round(F.round(F.col("net_import_mw") - F.col("base"), 9), 6))
        met = moved.join(pool.withColumn("hit", F.lit(1)), ["error_date", "e"], "left")
        per_path = met.groupBy("delivery_date", "scenario").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("error_date").alias("days"), F.count("hit").alias("hits"),
            F.sum(F.xxhash64("timestamp", "scenario", *targets).cast("decimal(38,0)")).alias("h"))
        return per_path.groupBy("delivery_date").agg(
            F.sum("n").alias("paths_rows"), F.count(F.lit(1)).alias("scenarios"), (F.max("days") == 1).alias("one_error_day_a_path"),
            (F.sum("hits") == F.sum("n")).alias("errors_of_that_day"), F.sum("h").alias("h"))

    one, other = digests(points.repartition(2)), digests(points.repartition(7)).select("delivery_date", F.col("h").alias("h2"))
    return out(one.join(other, "delivery_date").withColumn("same_when_dealt_anew", F.col("h") == F.col("h2")).drop("h", "h2"))


@query("gate_evidence", f"""
WITH {SCORES}, d AS (SELECT model_version, {day('delivery_time_utc')} AS d, count(DISTINCT delivery_time_utc) AS n FROM scores GROUP BY 1, 2),
c AS (SELECT model_version, count(*) AS days, date_diff('day', min(d), max(d)) + 1 - count(*) AS gaps, count(*) FILTER ({day_length('d')} <> n) AS odd, CAST(sum({day_length('d')} - n) AS BIGINT) AS lost FROM d GROUP BY 1),
e AS (SELECT model_version, avg(absolute_error) FILTER (persistence_absolute_error IS NOT NULL) AS mm, avg(persistence_absolute_error) AS pm, avg(p10_p90_covered::INT) AS cov,
  min(epoch(delivery_time_utc) - epoch(issue_time_utc)) / 3600 AS lead FROM scores GROUP BY 1),
m AS (SELECT *, days >= 30 AS enough, 100 * (pm - mm) / nullif(pm, 0) AS gain FROM c JOIN e USING (model_version))
SELECT model_version, 'minimum_shadow_days' AS rule, 'at least 30 days' AS required, CAST(days AS VARCHAR) AS observed, enough AS passed FROM m
UNION ALL SELECT model_version, 'consecutive_delivery_days', 'no missing date', gaps || ' missing dates', enough AND gaps = 0 FROM m
UNION ALL SELECT model_version, 'complete_periods', 'no incomplete day', odd || ' incomplete days, ' || lost || ' missing periods', enough AND odd = 0 FROM m
UNION ALL SELECT model_version, 'pre_delivery_issue_time', 'at least 8 h', CAST(round(lead, 4) AS VARCHAR), lead >= 8 FROM m
UNION ALL SELECT model_version, 'beats_persistence', 'at least 5 %', coalesce(CAST(round(gain, 4) AS VARCHAR), 'none'), coalesce(gain >= 5, false) FROM m
UNION ALL SELECT model_version, 'interval_coverage', '0.7 to 0.9', CAST(round(cov, 4) AS VARCHAR), cov BETWEEN 0.7 AND 0.9 FROM m""")
def gate_evidence(t):
    return out(scoring.gate_evidence(scoring.deployment_gate(scores(t))))


@query("gate_latest_revision", f"""
WITH {SCORES}, l AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY model_version, issue_time_utc, delivery_time_utc ORDER BY (actual_revision = 'final')::INT DESC) = 1)
SELECT model_version, count(*) AS graded_periods, round(avg(absolute_error) FILTER (persistence_absolute_error IS NOT NULL), 6) AS model_mae_gbp_mwh, round(avg(persistence_absolute_error), 6) AS persistence_mae_gbp_mwh FROM l GROUP BY 1""")
def gate_latest_revision(t):
    gate = scoring.deployment_gate(scores(t), latest=["initial", "final"])
    return out(gate.select("model_version", "graded_periods", "model_mae_gbp_mwh", "persistence_mae_gbp_mwh"))


# --- tables of other kinds -----------------------------------------------------------------

@query("csv_round_trip", """
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders""")
def csv_round_trip(t):
    """Orders as CSV and JSON lines, read back and set against each other; times become instants again."""
    from settlespark.sources import tables
    path = shared_path(t.spark, "plain")
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    csv = tables.read_table(t.spark, tables.write_table(rows, f"{path}/orders.csv"))
    lines = tables.read_table(t.spark, tables.write_table(rows, f"{path}/orders.json"))
    both = tables.keyed_by_instant(csv).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.col("timestamp").alias("o_orderdate"))
    return out(both.join(lines.select("o_orderkey", "o_totalprice"), "o_orderkey"))


@query("readable_times", """
SELECT event_id, ts AS timestamp FROM events WHERE event_type <> 'error'""")
def readable_times(t):
    from settlespark.sources import tables
    odd = F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return out(tables.keyed_by_instant(t.events.select("event_id", odd.alias("timestamp")), strict=False))


@query("seven_day_profile", f"""
WITH {COMPONENTS} SELECT b.timestamp, round(a.demand_mw, 6) AS fallback_d7_demand_mw, round(a.nuclear_mw, 6) AS fallback_d7_nuclear_mw
FROM components b JOIN components a ON a.timestamp = b.timestamp - INTERVAL '168 hours'""")
def seven_day_profile(t):
    from settlespark.plans.collect import fallback_profile
    history = t.components.select("timestamp", "demand_mw", "nuclear_mw")
    known = history.select(clock.add_seconds("timestamp", 7 * 86400).alias("timestamp")).join(t.components.select("timestamp"), "timestamp", "left_semi")
    return out(fallback_profile(history, known, ["demand_mw", "nuclear_mw"]))


@query("refusals", """
SELECT guard, true AS refused, n AS row_count FROM (SELECT count(*) AS n FROM events), (SELECT unnest(['empty_table', 'far_rows', 'gaps', 'repeated_key', 'unlisted_category', 'repeated_time', 'unknown_component', 'unmapped_column', 'absent_column', 'late_issue', 'unbalanced_profile']) AS guard)""")
def refusals(t):
    """Guards over the whole events table, each given something to refuse."""
    from settlespark.errors import GuardError, MissingColumns, need_columns
    from settlespark.operators import point_in_time, quality, relations
    from settlespark.sources import tables
    events, n = t.events, t.events.count()
    cases = {
        "empty_table": lambda: tables.write_table(events.where("value > 1e12"), shared_path(t.spark, "none")),
        "far_rows": lambda: quality.trim_window(events, "ts", F.lit("2023-01-01").cast("timestamp"), F.lit("2023-01-02").cast("timestamp")),
        "gaps": lambda: quality.require_no_nulls(events.withColumn("value", F.nullif("value", F.lit(0.0))).withColumn("gap", F.when(F.col("event_type") != "error", 1)), ["value", "gap"]),
        "repeated_key": lambda: relations.require_unique(events, ["event_type"]),
        "unlisted_category": lambda: relations.sum_by_category(events, ["user_id"], "event_type", "value", ["click"]).write.format("noop").mode("overwrite").save(),
        "unknown_component": lambda: quality.require_components([*K.CORE_COMPONENTS, *sorted({r.event_type for r in events.select("event_type").distinct().collect()})]),
        "unmapped_column": lambda: quality.mapped({c: "REQUIRED_" + c for c in events.columns}, "value"),
        "absent_column": lambda: need_columns(events, ["event_id", "price_gbp_mwh"], "events"),
        "late_issue": lambda: quality.require_after_issue(events, F.col("ts"), "ts"),
        "unbalanced_profile": lambda: quality.component_profile(events.withColumn("model_profile", F.when(F.col("event_type") == "error", K.PROFILE_FULL).otherwise(K.PROFILE_CORE))),
        "repeated_time": lambda: point_in_time.timestamp_lags(events.withColumn("ts", F.date_trunc("day", "ts")), ["event_type"], "ts", "value", {"x": 60}).write.format("noop").mode("overwrite").save(),
    }
    rows = []
    for name, case in cases.items():
        try:
            case()
            rows.append((name, False, n))
        except (GuardError, Exception) as error:
            known = isinstance(error, (GuardError, MissingColumns)) or "not among the listed" in str(error) or "repeated ts" in str(error)
            rows.append((name, known, n))
    return t.spark.createDataFrame(rows, "guard string, refused boolean, row_count long")


# --- streams ----------------------------------------------------------------------------

def event_stream(t):
    return jobs.file_stream(t.spark, t.dir, t.events.schema, "events.parquet")


def finished(stream_query):
    stream_query.awaitTermination()
    if stream_query.exception() is not None:
        raise stream_query.exception()


@query("stream_half_hours", f"""
WITH {HH} SELECT h.series AS event_type, h.ts, round(h.price + 50, 6) AS value, h.n FROM hh h WHERE h.ts + INTERVAL '30 minutes' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""")
def stream_half_hours(t):
    path = shared_path(t.spark, "stream")
    finished(jobs.write_table(jobs.half_hourly_means(event_stream(t), "ts", ["event_type"], "value"), f"{path}/out", f"{path}/state"))
    return out(t.spark.read.parquet(f"{path}/out"))


@query("stream_actuals", f"""
SELECT delivery_time_utc, 'initial' AS actual_revision, min(value) AS actual_price FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) AS delivery_time_utc, value FROM events
  QUALIFY row_number() OVER (PARTITION BY time_bucket(INTERVAL '30 minutes', ts) ORDER BY ts, value) = 1) GROUP BY 1""")
def stream_actuals(t):
    path = shared_path(t.spark, "stream")
    log = logs.actual_log(t.spark, f"{path}/log")
    # The first event of a half-hour, by time and price, carries its price; the others repeat its key.
    rows = event_stream(t).select(clock.half_hour("ts").alias("delivery_time_utc"), F.lit("initial").alias("actual_revision"), F.col("value").alias("actual_price"),
                                  (-F.unix_micros("ts")).alias("early"), (-F.col("value")).alias("low"))
    finished(jobs.ingest_actuals(rows, log, f"{path}/state", ["early", "low"]))
    return out(log.read())


@query("stream_latest_revision", """
SELECT user_id, CAST(ts AS DATE)::TIMESTAMP AS delivery, ts AS published_at_utc, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1""")
def stream_latest_revision(t):
    path = shared_path(t.spark, "stream")
    log = logs.LogTable(t.spark, f"{path}/log", ["user_id", "delivery"], day=F.to_date("delivery"))
    s = event_stream(t).select("user_id", F.to_date("ts").cast("timestamp").alias("delivery"), F.col("ts").alias("published_at_utc"), "event_id", "value")
    latest = jobs.latest_revisions(s, ["user_id"], "delivery", "published_at_utc", ["event_id"], "60 days")
    finished(jobs.run_batches(latest, log.upsert, f"{path}/state", mode="update"))
    return out(log.read())


@query("stream_scores", f"""
WITH {FORECASTS} SELECT f.forecast_id, f.model_version, a.actual_revision, a.delivery_time_utc, {rounded(['actual_price'])}, round(f.p50 - a.actual_price, 6) AS error,
  round(abs(f.p50 - a.actual_price), 6) AS absolute_error, a.actual_price BETWEEN f.p10 AND f.p90 AS p10_p90_covered FROM forecasts f JOIN actuals a USING (delivery_time_utc)""")
def stream_scores(t):
    path = shared_path(t.spark, "stream")
    forecasts(t).write.parquet(f"{path}/f")
    actuals(t).write.parquet(f"{path}/a")
    f, a = (jobs.file_stream(t.spark, f"{path}/{n}", t.spark.read.parquet(f"{path}/{n}").schema) for n in ("f", "a"))
    finished(jobs.write_table(jobs.scores(f, a), f"{path}/out", f"{path}/state"))
    return out(t.spark.read.parquet(f"{path}/out"))


@query("stream_grading", f"""
WITH {SCORES} SELECT forecast_id, actual_revision, {rounded(['error', 'persistence_price'])} FROM scores""")
def stream_grading(t):
    path = shared_path(t.spark, "stream")
    f, a, s = (make(t.spark, f"{path}/{n}") for n, make in (("fl", logs.forecast_log), ("al", logs.actual_log), ("sl", logs.score_log)))
    logs.append_forecast_batch(f, forecasts(t))
    actuals(t).repartition(2).write.parquet(f"{path}/in")
    arriving = jobs.file_stream(t.spark, f"{path}/in", t.spark.read.parquet(f"{path}/in").schema, files_per_trigger=1)
    finished(jobs.grade_on_arrival(arriving, f, a, s, f"{path}/state"))
    return out(s.read().select("forecast_id", "actual_revision", "error", "persistence_price"))


@query("stream_state_grading", f"""
WITH {SCORES} SELECT forecast_id, actual_revision, {rounded(['error', 'persistence_price', 'persistence_absolute_error'])}, p10_p90_covered FROM scores""")
def stream_state_grading(t):
    """Forecasts and prices arrive in any order, and half of the prices twice; the score log ends as batch grading has it."""
    from settlespark.streaming import grading
    path = shared_path(t.spark, "stream")
    early = F.pmod(F.xxhash64("delivery_time_utc"), F.lit(2)) == 0
    forecasts(t).repartition(2, F.xxhash64("forecast_id")).write.parquet(f"{path}/f")
    for part in (actuals(t).where(early), actuals(t), actuals(t).where(early)):
        part.coalesce(1).write.mode("append").parquet(f"{path}/a")
    f, a = (jobs.file_stream(t.spark, f"{path}/{n}", t.spark.read.parquet(f"{path}/{n}").schema, files_per_trigger=1) for n in ("f", "a"))
    log = logs.score_log(t.spark, f"{path}/scores")
    finished(grading.grade_statefully(f, a, log, f"{path}/state", horizon_s=60 * 86400))
    return out(log.read().select("forecast_id", "actual_revision", "error", "persistence_price", "persistence_absolute_error", "p10_p90_covered"))
