"""Grading, gate, risk and scenario queries."""

from pyspark.sql import functions as F

from settlespark.functions import clock, features
from settlespark.operators import risk, scoring
from settlespark.operators.point_in_time import timestamp_lags
from settlespark.workload.registry import COMPONENTS, HH, day, day_length, out, query

# Forecasts: last half-hour's price of the same series as P50, with a fixed band.
# Actuals: the half-hourly prices. Two revisions, the second with a small correction.
FORECASTS = f"""{HH}, forecasts AS (SELECT a.series AS model_version, a.ts - INTERVAL '10 hours' AS issue_time_utc, a.ts AS delivery_time_utc,
  b.price - 15 AS p10, b.price AS p50, b.price + 15 AS p90, CASE WHEN b.price < 0 THEN 0.8 ELSE 0.1 END AS negative_probability,
  a.series || '|' || strftime(a.ts - INTERVAL '10 hours', '%Y-%m-%dT%H:%M:%SZ') || '|' || strftime(a.ts, '%Y-%m-%dT%H:%M:%SZ') AS forecast_id
  FROM hh a JOIN hh b ON a.series = b.series AND b.ts = a.ts - INTERVAL '30 minutes'),
actuals AS (SELECT ts AS delivery_time_utc, 'initial' AS actual_revision, round(avg(price), 9) AS actual_price FROM hh GROUP BY 1
  UNION ALL SELECT ts, 'final', round(avg(price), 9) + 1 FROM hh GROUP BY 1)"""
SCORES = f"""{FORECASTS}, scores AS (SELECT f.forecast_id, f.model_version, f.issue_time_utc, a.actual_revision, f.delivery_time_utc, a.actual_price,
  f.p50 AS forecast_p50, f.p50 - a.actual_price AS error, abs(f.p50 - a.actual_price) AS absolute_error, (f.p50 - a.actual_price) * (f.p50 - a.actual_price) AS squared_error,
  a.actual_price BETWEEN f.p10 AND f.p90 AS p10_p90_covered, a.actual_price < 0 AS actual_negative, f.negative_probability AS predicted_negative_probability,
  p.actual_price AS persistence_price, abs(p.actual_price - a.actual_price) AS persistence_absolute_error
  FROM forecasts f JOIN actuals a USING (delivery_time_utc)
  LEFT JOIN actuals p ON p.actual_revision = a.actual_revision AND p.delivery_time_utc = a.delivery_time_utc - INTERVAL '24 hours')"""


def forecasts(t):
    from settlespark.functions.values import forecast_id
    lagged = timestamp_lags(t.hh, ["series"], "ts", "price", {"prior": 1800}).where("prior is not null")
    f = lagged.select(
        F.col("series").alias("model_version"), clock.add_seconds("ts", -36000).alias("issue_time_utc"), F.col("ts").alias("delivery_time_utc"),
        (F.col("prior") - 15).alias("p10"), F.col("prior").alias("p50"), (F.col("prior") + 15).alias("p90"),
        F.when(F.col("prior") < 0, 0.8).otherwise(0.1).alias("negative_probability"))
    return f.withColumn("forecast_id", forecast_id())


def actuals(t):
    base = t.hh.groupBy(F.col("ts").alias("delivery_time_utc")).agg(F.round(F.avg("price"), 9).alias("p"))
    revisions = F.array(F.struct(F.lit("initial").alias("r"), F.lit(0.0).alias("d")), F.struct(F.lit("final").alias("r"), F.lit(1.0).alias("d")))
    return base.select("delivery_time_utc", F.explode(revisions).alias("x"), "p").select(
        "delivery_time_utc", F.col("x.r").alias("actual_revision"), (F.col("p") + F.col("x.d")).alias("actual_price"))


def scores(t):
    return scoring.grade(forecasts(t), actuals(t))


def rounded(columns):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query("grade_scores", f"""
WITH {SCORES} SELECT forecast_id, model_version, issue_time_utc, actual_revision, delivery_time_utc, p10_p90_covered, actual_negative, predicted_negative_probability,
  round(squared_error, 4) AS squared_error, {rounded(['actual_price', 'forecast_p50', 'error', 'absolute_error', 'persistence_price', 'persistence_absolute_error'])} FROM scores""")
def grade_scores(t):
    return out(scores(t).drop("graded_at_utc").withColumn("squared_error", F.round("squared_error", 4)))


def _daily(model, base):
    return f"""SELECT model_version, actual_revision, {day('delivery_time_utc')} AS delivery_date, count(*) AS graded_periods,
  round(avg({model}), 6) AS model_mae_gbp_mwh, round(sqrt(avg(squared_error)), 6) AS model_rmse_gbp_mwh, round(avg(error), 6) AS model_bias_gbp_mwh,
  round(avg({base}), 6) AS persistence_mae_gbp_mwh, round(avg(p10_p90_covered::INT), 6) AS p10_p90_coverage, count(*) FILTER (actual_negative) AS actual_negative_periods,
  round(100 * (avg({base}) - avg({model})) / nullif(avg({base}), 0), 6) AS improvement_percent FROM scores GROUP BY 1, 2, 3"""


@query("daily_grading", f"WITH {SCORES} {_daily('absolute_error', 'persistence_absolute_error')}", dates=["delivery_date"])
def daily_grading(t):
    return out(scoring.daily_grading(scores(t)))


@query("daily_grading_comparable", f"WITH {SCORES} {_daily('CASE WHEN persistence_absolute_error IS NOT NULL THEN absolute_error END', 'persistence_absolute_error')}", dates=["delivery_date"])
def daily_grading_comparable(t):
    return out(scoring.daily_grading(scores(t), comparable_only=True))


@query("deployment_gate", f"""
WITH {SCORES}, d AS (SELECT model_version, {day('delivery_time_utc')} AS d, count(DISTINCT delivery_time_utc) AS periods FROM scores GROUP BY 1, 2),
dd AS (SELECT model_version, count(*) AS graded_delivery_days, min(d) AS first_delivery_date, max(d) AS last_delivery_date,
  count(*) FILTER ({day_length('d')} <> periods) AS incomplete_days, CAST(sum({day_length('d')} - periods) AS BIGINT) AS missing_periods FROM d GROUP BY 1),
m AS (SELECT model_version, count(*) AS graded_periods, count(persistence_absolute_error) AS comparable_persistence_periods,
  avg(absolute_error) FILTER (persistence_absolute_error IS NOT NULL) AS mm, avg(persistence_absolute_error) AS pm,
  avg(p10_p90_covered::INT) AS cov, min(epoch(delivery_time_utc) - epoch(issue_time_utc)) / 3600 AS lead FROM scores GROUP BY 1),
r AS (SELECT *, 100 * (pm - mm) / nullif(pm, 0) AS imp, last_delivery_date - first_delivery_date + 1 - graded_delivery_days AS missing_date_count FROM m JOIN dd USING (model_version)),
g AS (SELECT model_version, graded_periods, comparable_persistence_periods, graded_delivery_days, first_delivery_date, last_delivery_date, round(mm, 6) AS model_mae_gbp_mwh,
  round(pm, 6) AS persistence_mae_gbp_mwh, round(cov, 6) AS p10_p90_coverage, round(lead, 6) AS minimum_lead_hours, incomplete_days, missing_periods,
  round(imp, 6) AS improvement_percent, missing_date_count, graded_delivery_days >= 30 AS minimum_shadow_days,
  graded_delivery_days >= 30 AND missing_date_count = 0 AS consecutive_delivery_days, graded_delivery_days >= 30 AND incomplete_days = 0 AS complete_periods,
  lead >= 8 AS pre_delivery_issue_time, coalesce(imp >= 5, false) AS beats_persistence, coalesce(cov BETWEEN 0.7 AND 0.9, false) AS interval_coverage FROM r)
SELECT *, minimum_shadow_days AND consecutive_delivery_days AND complete_periods AND pre_delivery_issue_time AND beats_persistence AND interval_coverage AS deployment_ready,
  CASE WHEN minimum_shadow_days AND consecutive_delivery_days AND complete_periods AND pre_delivery_issue_time AND beats_persistence AND interval_coverage
  THEN 'eligible_for_controlled_operational_review' ELSE 'shadow_only' END AS mode FROM g""", dates=["first_delivery_date", "last_delivery_date"], ints=["missing_date_count"])
def deployment_gate(t):
    return out(scoring.deployment_gate(scores(t)))


@query("gate_missing_dates", """
WITH d AS (SELECT DISTINCT o_orderpriority AS model_version, CAST(o_orderdate AS DATE) AS d FROM orders),
e AS (SELECT model_version, CAST(unnest(generate_series(min(d), max(d), INTERVAL '1 day')) AS DATE) AS missing_date FROM d GROUP BY 1)
SELECT e.* FROM e ANTI JOIN d ON e.model_version = d.model_version AND e.missing_date = d.d""", dates=["missing_date"])
def gate_missing_dates(t):
    # Noon lies on the same date in both zones.
    s = t.orders.select(F.col("o_orderpriority").alias("model_version"), clock.add_seconds("o_orderdate", 43200).alias("delivery_time_utc"))
    return out(scoring.gate_missing_dates(s))


@query("gate_reports", f"""
WITH {SCORES}, s AS (SELECT * FROM scores WHERE {day('delivery_time_utc')} <> DATE '2024-01-10' AND delivery_time_utc <> TIMESTAMP '2024-01-20 12:00:00'),
d AS (SELECT model_version, {day('delivery_time_utc')} AS d, count(DISTINCT delivery_time_utc) AS n FROM s GROUP BY 1, 2),
e AS (SELECT model_version, CAST(unnest(generate_series(min(d), max(d), INTERVAL '1 day')) AS DATE) AS d FROM d GROUP BY 1),
g AS (SELECT model_version, string_agg('"' || CAST(d AS VARCHAR) || '"', ',' ORDER BY d) AS dates FROM e ANTI JOIN d USING (model_version, d) GROUP BY 1),
p AS (SELECT model_version, string_agg('"' || CAST(d AS VARCHAR) || '":' || ({day_length('d')} - n), ',' ORDER BY d) AS short FROM d WHERE {day_length('d')} <> n GROUP BY 1)
SELECT model_version, 'deployment-gate-v1' AS revision, count(*) AS graded_periods, 'shadow_only' AS mode, '[' || coalesce(any_value(dates), '') || ']' AS missing_dates, '{{' || coalesce(any_value(short), '') || '}}' AS missing_periods
FROM s LEFT JOIN g USING (model_version) LEFT JOIN p USING (model_version) GROUP BY 1""")
def gate_reports(t):
    """Reports on scores that lack a day and a period."""
    s = scores(t).where((clock.delivery_date("delivery_time_utc") != F.lit("2024-01-10").cast("date")) & (F.col("delivery_time_utc") != F.lit("2024-01-20 12:00:00").cast("timestamp")))
    r = scoring.gate_report(scoring.deployment_gate(s, min_improvement=1000.0), scoring.gate_missing_dates(s), scoring.gate_missing_periods(s))
    found = {n: F.get_json_object("report", f"$.{p}") for n, p in (("revision", "workflow_revision"), ("graded_periods", "metrics.graded_periods"), ("mode", "mode"),
                                                                  ("missing_dates", "missing_dates"), ("missing_periods", "missing_periods"))}
    return out(r.select("model_version", *[(c.cast("long") if n == "graded_periods" else c).alias(n) for n, c in found.items()]))


@query("holdout_score", f"""
WITH {HH}, x AS (SELECT a.series, a.price AS actual, b.price AS baseline, c.price AS prediction, row_number() OVER (PARTITION BY a.series ORDER BY a.ts DESC) AS rn
  FROM hh a LEFT JOIN hh b ON a.series = b.series AND b.ts = a.ts - INTERVAL '24 hours' LEFT JOIN hh c ON a.series = c.series AND c.ts = a.ts - INTERVAL '30 minutes'),
s AS (SELECT series, avg(abs(actual - prediction)) FILTER (baseline IS NOT NULL AND prediction IS NOT NULL) AS mm,
  avg(abs(actual - baseline)) FILTER (baseline IS NOT NULL AND prediction IS NOT NULL) AS bm,
  count(*) FILTER (baseline IS NOT NULL AND prediction IS NOT NULL) AS comparison_rows, count(*) AS holdout_rows, count(*) - count(baseline) AS baseline_missing_rows FROM x WHERE rn <= 300 GROUP BY 1)
SELECT series, round(mm, 6) AS model_mae, round(bm, 6) AS baseline_mae, comparison_rows, holdout_rows, baseline_missing_rows, round(100 * (bm - mm) / bm, 6) AS improvement_percent FROM s""")
def holdout_score(t):
    from settlespark.operators.series import last_rows
    lagged = timestamp_lags(t.hh, ["series"], "ts", "price", {"baseline": 86400, "prediction": 1800})
    return out(scoring.holdout_score(last_rows(lagged, ["series"], "ts", 300), "price", "prediction", "baseline", ["series"]))


@query("fallback_choice", f"""
WITH {COMPONENTS}, l AS (SELECT timestamp, 'demand_mw' AS target, demand_mw AS value FROM components UNION ALL SELECT timestamp, 'nuclear_mw', nuclear_mw FROM components
  UNION ALL SELECT timestamp, 'inertia_gvas', inertia_gvas FROM components),
p AS (SELECT a.timestamp, a.target, a.value, b.value AS fallback FROM l a LEFT JOIN l b ON a.target = b.target AND b.timestamp = a.timestamp - INTERVAL '168 hours'),
s AS (SELECT target, CASE WHEN target <> 'inertia_gvas' THEN avg(abs(value - fallback)) END AS f, CASE WHEN target <> 'inertia_gvas' THEN count(fallback) ELSE 0 END AS n,
  CASE target WHEN 'demand_mw' THEN 10000.0 WHEN 'nuclear_mw' THEN 1.0 END AS m FROM p WHERE timestamp >= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT target, round(f, 6) AS fallback_d7_holdout_mae, n AS fallback_comparison_rows, m AS model_holdout_mae,
  CASE WHEN coalesce(f < m, f IS NOT NULL) THEN 'fallback_d7' ELSE 'model' END AS source, round(CASE WHEN coalesce(f < m, f IS NOT NULL) THEN f ELSE m END, 6) AS selected_holdout_mae FROM s""")
def fallback_choice(t):
    return out(scoring.fallback_choice(t.components, "timestamp", ["demand_mw", "nuclear_mw", "inertia_gvas"],
                                       F.col("timestamp") >= F.lit("2024-01-20").cast("timestamp"), {"demand_mw": 10000.0, "nuclear_mw": 1.0}))


@query("archive_status", f"""
WITH {FORECASTS}, d AS (SELECT model_version, {day('delivery_time_utc')} AS delivery_date, count(DISTINCT delivery_time_utc) AS period_count, count(DISTINCT issue_time_utc) AS issues FROM forecasts GROUP BY 1, 2)
SELECT model_version, delivery_date, period_count, {day_length('delivery_date')} - period_count AS missing_periods, CAST(0 AS BIGINT) AS extra_periods,
  issues = 1 AS single_issue_time, issues = 1 AND period_count = {day_length('delivery_date')} AS complete FROM d""", dates=["delivery_date"])
def archive_status(t):
    return out(scoring.archive_status(forecasts(t)))


@query("parametric_var", f"""
WITH {HH}, c AS (SELECT series, ts, price - lag(price) OVER (PARTITION BY series ORDER BY ts) AS change FROM hh),
k AS (SELECT * FROM c WHERE change IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= 1440)
SELECT series, round(100 * stddev_samp(change) * 1.6448536269514722, 6) AS parametric_var, count(*) AS changes FROM k GROUP BY 1""")
def parametric_var(t):
    return out(risk.parametric_var(t.hh, ["series"], "ts", "price", -100.0))


@query("historical_var", f"""
WITH {HH}, c AS (SELECT series, ts, price - lag(price) OVER (PARTITION BY series ORDER BY ts) AS change FROM hh),
k AS (SELECT series, -100 * change AS loss FROM c WHERE change IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= 1440),
q AS (SELECT series, quantile_cont(loss, 0.95) AS var FROM k GROUP BY 1)
SELECT series, round(any_value(var), 6) AS var, round(avg(loss) FILTER (loss >= var), 6) AS expected_shortfall FROM k JOIN q USING (series) GROUP BY 1""")
def historical_var(t):
    return out(risk.historical_var(t.hh, ["series"], "ts", "price", 100.0))


# Scenarios: every half-hour gets 1,000 joint draws, the default, from the error rows. The draw is a
# plain remainder here because the hash used by default has no SQL twin.
N_DRAWS = 1000
ERRORS = f"""{COMPONENTS}, e0 AS (SELECT a.timestamp, a.demand_mw - b.demand_mw AS demand_mw, a.net_import_mw - b.net_import_mw AS net_import_mw, a.nuclear_mw - b.nuclear_mw AS nuclear_mw
    FROM components a LEFT JOIN components b ON b.timestamp = a.timestamp - INTERVAL '24 hours'),
  errors AS (SELECT *, row_number() OVER (ORDER BY timestamp) - 1 AS idx FROM e0 WHERE demand_mw IS NOT NULL),
  draws AS (SELECT timestamp, demand_mw, net_import_mw, nuclear_mw, unnest(range({N_DRAWS})) AS scenario FROM components),
  paths AS (SELECT d.timestamp, d.scenario, greatest(d.demand_mw + e.demand_mw, 0) AS demand_mw, d.net_import_mw + e.net_import_mw AS net_import_mw,
    greatest(d.nuclear_mw + e.nuclear_mw, 0) AS nuclear_mw
    FROM draws d JOIN errors e ON e.idx = (d.scenario * 7919 + CAST(epoch(d.timestamp) // 1800 AS BIGINT) * 104729 + 42) % (SELECT count(*) FROM errors)),
  priced AS (SELECT *, {day('timestamp')} AS delivery_date, 0.05 * (demand_mw - 4 * nuclear_mw - 3 * net_import_mw) - 20 AS price FROM paths)"""


def error_rows(t):
    from settlespark.operators.point_in_time import timestamp_lags as lags
    targets = ["demand_mw", "net_import_mw", "nuclear_mw"]
    c = t.components.select("timestamp", *targets)
    long = c.unpivot(["timestamp"], targets, "target", "value")
    e = lags(long, ["target"], "timestamp", "value", {"before": 86400})
    wide = e.groupBy("timestamp").pivot("target", targets).agg(F.first(F.col("value") - F.col("before")))
    return c, wide, targets


def remainder_draw(scenario, ts, n):
    return F.pmod(scenario * 7919 + F.floor(clock.seconds(ts) / 1800) * 104729 + 42, n)


def priced_paths(t):
    points, errors, targets = error_rows(t)
    paths = risk.error_scenarios(points, errors, targets, scenarios=N_DRAWS, draw=remainder_draw)
    price = (F.col("demand_mw") - 4 * F.col("nuclear_mw") - 3 * F.col("net_import_mw")) * 0.05 - 20
    return paths.withColumn("price", price).withColumn("delivery_date", clock.delivery_date("timestamp"))


@query("error_scenarios", f"""
WITH {ERRORS} SELECT timestamp, scenario, round(demand_mw, 6) + 0.0 AS demand_mw, round(net_import_mw, 6) + 0.0 AS net_import_mw, round(nuclear_mw, 6) + 0.0 AS nuclear_mw FROM paths""")
def error_scenarios(t):
    return out(priced_paths(t).select("timestamp", "scenario", "demand_mw", "net_import_mw", "nuclear_mw"))


@query("price_quantiles", f"""
WITH {ERRORS} SELECT timestamp, round(quantile_cont(price, 0.1), 6) AS p10, round(quantile_cont(price, 0.5), 6) AS p50, round(quantile_cont(price, 0.9), 6) AS p90,
  round(avg((price < 0)::INT), 6) AS negative_probability FROM priced GROUP BY 1""")
def price_quantiles(t):
    return out(risk.price_quantiles(priced_paths(t), ["timestamp"], "price"))


@query("daily_distribution", f"""
WITH {ERRORS}, q AS (SELECT delivery_date, timestamp, quantile_cont(price, 0.5) AS p50, avg((price < 0)::INT) AS neg FROM priced GROUP BY 1, 2),
c AS (SELECT delivery_date, count(*) AS period_count, min(p50) AS a, max(p50) AS b, CAST(sum(CAST(p50 AS DECIMAL(38,12))) AS DOUBLE) / count(p50) AS m, max(neg) AS n FROM q GROUP BY 1),
s AS (SELECT delivery_date, scenario, min(price) AS lo, max(price) AS hi FROM priced GROUP BY 1, 2),
w AS (SELECT delivery_date, avg((lo < 0)::INT) AS anyneg, {', '.join(f"quantile_cont({c}, 0.{p}) AS {c}{p}0" for c in ('lo', 'hi') for p in (1, 5, 9))} FROM s GROUP BY 1)
SELECT delivery_date, period_count, round(a, 6) AS p50_daily_min_gbp_mwh, round(b, 6) AS p50_daily_max_gbp_mwh, round(m, 6) AS p50_daily_mean_gbp_mwh,
  round(n, 6) AS maximum_period_negative_probability, round(anyneg, 6) AS probability_any_negative_period,
  {', '.join(f"round({c}{p}, 6) AS distribution_daily_{n}_p{p}" for c, n in (('lo', 'min'), ('hi', 'max')) for p in (10, 50, 90))} FROM c JOIN w USING (delivery_date)""", dates=["delivery_date"])
def daily_distribution(t):
    paths = priced_paths(t)
    quantiles = risk.price_quantiles(paths, ["delivery_date", "timestamp"], "price")
    return out(risk.daily_distribution(paths, quantiles, ["delivery_date"], "price"))


RISK = f"""{ERRORS}, points AS (SELECT timestamp, 0.05 * (demand_mw - 4 * nuclear_mw - 3 * net_import_mw) - 20 AS reference FROM components),
  loss AS (SELECT delivery_date, scenario, round(-sum((price - reference) * 50), 6) AS loss FROM priced JOIN points USING (timestamp) GROUP BY 1, 2),
  v AS (SELECT delivery_date, quantile_cont(loss, 0.95) AS var FROM loss GROUP BY 1),
  risk AS (SELECT delivery_date, any_value(var) AS scenario_var, avg(loss) FILTER (loss >= var) AS expected_shortfall, max(loss) AS worst_loss, max(-loss) AS best_profit
    FROM loss JOIN v USING (delivery_date) GROUP BY 1)"""


def scenario_risks(t):
    paths = priced_paths(t)
    reference = t.components.select("timestamp", ((F.col("demand_mw") - 4 * F.col("nuclear_mw") - 3 * F.col("net_import_mw")) * 0.05 - 20).alias("reference"))
    return risk.scenario_risk(paths.join(reference, "timestamp"), ["delivery_date"], "price", "reference", 100.0)


@query("scenario_risk", f"""
WITH {RISK} SELECT delivery_date, {rounded(['scenario_var', 'expected_shortfall', 'worst_loss', 'best_profit'])} FROM risk""", dates=["delivery_date"])
def scenario_risk(t):
    return out(scenario_risks(t))


@query("position_limits", f"""
WITH {RISK} SELECT delivery_date, 10000.0 AS daily_risk_budget_gbp, round(100 * scenario_var / 10000, 8) AS var_budget_utilisation_percent,
  round(100 * expected_shortfall / 10000, 8) AS es_budget_utilisation_percent, round(1000000 / scenario_var, 8) AS maximum_volume_var_mwh,
  round(1000000 / expected_shortfall, 8) AS maximum_volume_expected_shortfall_mwh, round(least(1000000 / scenario_var, 1000000 / expected_shortfall), 8) AS maximum_volume_binding_mwh FROM risk WHERE scenario_var > 0 AND expected_shortfall > 0""", dates=["delivery_date"])
def position_limits(t):
    # Limits exist only for days that can lose money; others are an error by design.
    losing = scenario_risks(t).where("scenario_var > 0 and expected_shortfall > 0")
    return out(losing.select("delivery_date", *[c.alias(n) for n, c in features.position_limits(
        "scenario_var", "expected_shortfall", 500_000.0, 0.02, 100.0).items()]), 8)
