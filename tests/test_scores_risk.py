import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from settlespark.functions import features
from settlespark.operators import risk, scoring


def gate_scores(spark, days=30, error=8.0, base=10.0):
    t = pd.date_range("2026-01-01", periods=48 * days, freq="30min")
    pdf = pd.DataFrame({
        "model_version": "m", "issue_time_utc": t.normalize() - pd.Timedelta(hours=11), "delivery_time_utc": t,
        "absolute_error": error, "persistence_absolute_error": base, "p10_p90_covered": np.arange(len(t)) % 5 != 0, "actual_revision": "initial"})
    return spark.createDataFrame(pdf)


def test_gate_passes_a_complete_month(spark):
    row = scoring.deployment_gate(gate_scores(spark)).first()
    assert row.deployment_ready and row.mode == "eligible_for_controlled_operational_review"
    assert row.improvement_percent == pytest.approx(20.0) and row.p10_p90_coverage == pytest.approx(0.8)
    assert row.minimum_lead_hours == 11.0 and row.graded_delivery_days == 30


@pytest.mark.parametrize("change, rule", [
    (lambda d: d.where("delivery_time_utc < '2026-01-30'"), "minimum_shadow_days"),
    (lambda d: d.where("date(delivery_time_utc) <> '2026-01-10'"), "consecutive_delivery_days"),
    (lambda d: d.where("delivery_time_utc <> '2026-01-10 05:00:00'"), "complete_periods"),
    (lambda d: d.withColumn("issue_time_utc", F.expr("delivery_time_utc - interval 7 hours")), "pre_delivery_issue_time"),
    (lambda d: d.withColumn("persistence_absolute_error", F.lit(8.1)), "beats_persistence"),
    (lambda d: d.withColumn("p10_p90_covered", F.lit("True")), "interval_coverage"),
])
def test_each_gate_rule_can_fail_alone(spark, change, rule):
    row = scoring.deployment_gate(change(gate_scores(spark, days=30 if rule == "minimum_shadow_days" else 31))).first()
    assert not row[rule] and not row.deployment_ready and row.mode == "shadow_only"


def test_gate_without_scores_and_with_revisions(spark):
    scores = gate_scores(spark)
    models = spark.createDataFrame([("m",), ("none",)], "model_version string")
    rows = {r.model_version: r for r in scoring.deployment_gate(scores, models).collect()}
    assert rows["m"].deployment_ready and not rows["none"].deployment_ready and rows["none"].graded_periods == 0
    later = scores.withColumn("actual_revision", F.lit("final")).withColumn("absolute_error", F.lit(100.0))
    both = scores.unionByName(later)
    assert not scoring.deployment_gate(both).first().beats_persistence
    assert scoring.deployment_gate(both, revision="initial").first().deployment_ready
    assert '"deployment_ready":true' in scoring.gate_report(scoring.deployment_gate(scores)).first().report


def test_gate_report_lists_missing_dates_and_periods(spark):
    import json
    scores = gate_scores(spark, days=31).where("date(delivery_time_utc) <> '2026-01-10' and delivery_time_utc not in ('2026-01-12 05:00:00', '2026-01-12 05:30:00')")
    scores = scores.unionByName(gate_scores(spark).withColumn("model_version", F.lit("whole")))
    report = scoring.gate_report(scoring.deployment_gate(scores), scoring.gate_missing_dates(scores), scoring.gate_missing_periods(scores))
    found = {r.model_version: json.loads(r.report) for r in report.collect()}
    assert found["m"]["missing_dates"] == ["2026-01-10"] and found["m"]["missing_periods"] == {"2026-01-12": 2}
    assert found["whole"]["missing_dates"] == [] and found["whole"]["missing_periods"] == {} and found["whole"]["deployment_ready"]
    assert {g["rule"]: g["passed"] for g in found["m"]["gates"]}["complete_periods"] is False and len(found["m"]["gates"]) == 6


def test_gate_of_the_last_revision(spark):
    scores = gate_scores(spark)
    later = scores.where("delivery_time_utc < '2026-01-02'").withColumns({"actual_revision": F.lit("final"), "absolute_error": F.lit(0.0)})
    both = scores.unionByName(later)
    row = scoring.deployment_gate(both, latest=["initial", "final"]).first()
    assert row.graded_periods == 1440 and row.model_mae_gbp_mwh == pytest.approx(8.0 * 29 / 30)
    with pytest.raises(Exception, match="not among the listed"):
        scoring.deployment_gate(both, latest=["initial"]).collect()


def test_grading_one_row(frame):
    f = frame([("m", "2026-07-31 12:00:00", "2026-08-01 00:00:00", 20.0, 30.0, 40.0, 0.1, "id")],
              "model_version string, issue_time_utc string, delivery_time_utc string, p10 double, p50 double, p90 double, negative_probability double, forecast_id string",
              ["issue_time_utc", "delivery_time_utc"])
    a = frame([("2026-08-01 00:00:00", "initial", 35.0), ("2026-07-31 00:00:00", "initial", 33.0), ("2026-07-31 00:00:00", "final", 1.0)],
              "delivery_time_utc string, actual_revision string, actual_price double", ["delivery_time_utc"])
    rows = scoring.grade(f, a).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.absolute_error, r.squared_error, r.p10_p90_covered, r.actual_negative) == (5.0, 25.0, True, False)
    assert (r.persistence_price, r.persistence_absolute_error) == (33.0, 2.0)
    day = scoring.daily_grading(scoring.grade(f, a)).first()
    assert day.model_mae_gbp_mwh == 5.0 and day.improvement_percent == pytest.approx(-150.0)


def test_two_improvement_definitions(frame):
    rows = [("m", "r", "2026-01-01 00:00:00", 1.0, 1.0, 1.0, 2.0, "true", "false"), ("m", "r", "2026-01-01 00:30:00", 9.0, 9.0, 81.0, None, "0", "1")]
    s = frame(rows, "model_version string, actual_revision string, delivery_time_utc string, error double, absolute_error double, squared_error double, "
              "persistence_absolute_error double, p10_p90_covered string, actual_negative string", ["delivery_time_utc"])
    assert scoring.daily_grading(s).first().improvement_percent == pytest.approx(100 * (2 - 5) / 2)
    only = scoring.daily_grading(s, comparable_only=True).first()
    assert only.improvement_percent == pytest.approx(50.0) and only.p10_p90_coverage == 0.5 and only.actual_negative_periods == 1


def test_scenario_risk_uses_half_hour_energy(frame):
    df = frame([("d", s, p, v, 50.0) for s, v in ((0, 60.0), (1, 40.0)) for p in (0, 1)], "d string, scenario int, period int, price double, ref double")
    r = risk.scenario_risk(df, ["d"], "price", "ref", 10.0, 0.5).first()
    assert (r.worst_loss, r.best_profit, r.scenario_var, r.expected_shortfall) == (100.0, 100.0, 0.0, 100.0)


def test_var_matches_numpy(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": "a", "t": pd.date_range("2026-01-01", periods=300, freq="30min"), "p": rng.normal(50, 20, 300)})
    df, change = spark.createDataFrame(pdf), np.diff(pdf.p)[-200:]
    h = risk.historical_var(df, ["k"], "t", "p", 100.0, 0.95, 200).first()
    loss = -100.0 * change
    var = np.quantile(loss, 0.95)
    assert h["var"] == pytest.approx(var) and h.expected_shortfall == pytest.approx(loss[loss >= var].mean())
    p = risk.parametric_var(df, ["k"], "t", "p", -100.0, lookback=200).first()
    assert p.parametric_var == pytest.approx(100 * change.std(ddof=1) * 1.6448536269514722) and p.changes == 200


def scenario_inputs(spark):
    t = pd.date_range("2026-01-01", periods=48, freq="30min")
    points = spark.createDataFrame(pd.DataFrame({"timestamp": t, "demand_mw": 10.0, "net_import_mw": -5.0}))
    errors = spark.createDataFrame(pd.DataFrame({
        "timestamp": pd.date_range("2025-01-01", periods=200, freq="30min"), "demand_mw": np.linspace(-30, 30, 200), "net_import_mw": np.linspace(-3, 3, 200)}))
    return points, errors


def test_error_scenarios_draw_whole_rows_and_repeat(spark):
    points, errors = scenario_inputs(spark)
    runs = [
        risk.error_scenarios(points.repartition(n), errors.repartition(n), ["demand_mw", "net_import_mw"], 50).orderBy("timestamp", "scenario").toPandas()
        for n in (1, 5)
    ]
    pd.testing.assert_frame_equal(*runs)
    r = runs[0]
    assert len(r) == 48 * 50 and (r.demand_mw >= 0).all() and (r.net_import_mw < 0).all()
    free = r[r.demand_mw > 0]
    np.testing.assert_allclose(free.demand_mw - 10, 10 * (free.net_import_mw + 5), atol=1e-9)  # errors stay joined
    assert r.net_import_mw.nunique() > 150
    other = risk.error_scenarios(points, errors, ["demand_mw", "net_import_mw"], 50, seed=7).orderBy("timestamp", "scenario").toPandas()
    assert not other.equals(r)


def test_error_scenarios_need_complete_rows(spark):
    points, errors = scenario_inputs(spark)
    with pytest.raises(ValueError):
        risk.error_scenarios(points, errors, ["demand_mw"], 0)
    with pytest.raises(Exception, match="no complete error rows"):
        risk.error_scenarios(points, errors.withColumn("demand_mw", F.lit(None).cast("double")), ["demand_mw"], 5).collect()


def test_price_transform_round_trip(frame):
    df = frame([(v,) for v in (-250.0, -1.0, 0.0, 50.0, 500.0)], "v double")
    back = df.select(features.price_from_arcsinh(features.arcsinh_price("v", 50.0), 50.0).alias("b"), "v").collect()
    assert all(r.b == pytest.approx(r.v) for r in back)
    with pytest.raises(ValueError):
        features.arcsinh_price("v", 0)


def test_cyclical_features_are_bounded(spark):
    df = spark.createDataFrame(pd.DataFrame({"timestamp": pd.date_range("2026-01-01", periods=100, freq="30min")}))
    got = features.calendar_features(df).toPandas()
    waves = got[[c for c in got.columns if c.endswith(("_sin", "_cos"))]]
    assert waves.shape[1] == 6 and waves.abs().max().max() <= 1
    assert got.is_weekend.sum() == 4  # 2026-01-01 is a Thursday; the last rows are Saturday's


def test_position_limits_match_a_published_day(frame):
    df = frame([(7638.831431809186, 8833.691845596159)], "v double, e double")
    got = df.select(*[c.alias(n) for n, c in features.position_limits("v", "e", 500_000.0, 0.02, 100.0).items()]).first()
    assert got.maximum_volume_var_mwh == pytest.approx(130.91007556939365)
    assert got.maximum_volume_binding_mwh == pytest.approx(113.20295268150291)
    with pytest.raises(Exception, match="must be positive"):
        frame([(0.0, 1.0)], "v double, e double").select(*features.position_limits("v", "e", 1.0, 0.5, 1.0).values()).collect()
