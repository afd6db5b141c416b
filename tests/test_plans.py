import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from settlespark import constants as K
from settlespark.errors import GuardError
from settlespark.functions import clock
from settlespark.operators import timeline
from settlespark.plans import collect, dataset, day_ahead, history, logs, models
from settlespark.streaming import jobs


def forecast_day(spark, day="2026-08-01", issue="2026-07-31 12:00:00", model="m", p50=30.0):
    spine = timeline.window_clock(spark, day, str(pd.Timestamp(day).date() + pd.Timedelta(days=1)))
    return spine.select(F.lit(model).alias("model_version"), F.lit(issue).cast("timestamp").alias("issue_time_utc"), F.col("timestamp").alias("delivery_time_utc"),
                        F.lit(20.0).alias("p10"), F.lit(p50).alias("p50"), F.lit(40.0).alias("p90"), F.lit(0.1).alias("negative_probability"))


def test_forecast_log_is_immutable(spark, tmp_path):
    log, rows = logs.forecast_log(spark, str(tmp_path / "f")), forecast_day(spark)
    assert logs.log_forecast_day(log, rows) == "appended_new_immutable_day"
    assert log.read().count() == 48 and log.read().first().forecast_id.startswith("m|2026-07-31T12:00:00Z|")
    with pytest.raises(GuardError, match="already stored"):
        logs.append_forecasts(log, forecast_day(spark, issue="2026-07-31 13:00:00"))
    with pytest.raises(GuardError, match="immutable"):
        logs.append_forecast_batch(log, rows)
    with pytest.raises(GuardError, match="immutable"):
        logs.append_forecast_batch(logs.forecast_log(spark, str(tmp_path / "g")), rows.unionByName(rows))
    with pytest.raises(GuardError, match="one model"):
        logs.append_forecasts(log, rows.unionByName(forecast_day(spark, "2026-08-02")))
    assert logs.log_forecast_day(log, rows, reuse=True) == "reused_existing_immutable_day"
    with pytest.raises(GuardError, match="same periods"):
        logs.log_forecast_day(log, rows.where("delivery_time_utc < '2026-08-01 12:00:00'"), reuse=True)
    with pytest.raises(GuardError, match="after the issue"):
        logs.log_forecast_day(log, forecast_day(spark, issue="2026-08-01 12:00:00"))
    assert log.read().count() == 48


def test_actuals_cover_whole_days(spark, tmp_path):
    log = logs.actual_log(spark, str(tmp_path / "a"))
    prices = timeline.window_clock(spark, "2026-08-01", "2026-08-02").select("timestamp", F.lit(35.0).alias("price_gbp_mwh"))
    assert logs.append_actuals(log, prices, "2026-08-01", "2026-08-02", "initial").count() == 48
    assert logs.append_actuals(log, prices.withColumn("price_gbp_mwh", F.lit(1.0)), "2026-08-01", "2026-08-02", "initial").count() == 0
    assert log.read().agg(F.min("actual_price")).first()[0] == 35.0
    with pytest.raises(GuardError, match="do not cover"):
        logs.append_actuals(log, prices.where("timestamp > '2026-08-01 05:00:00'"), "2026-08-01", "2026-08-02", "final")


def test_grading_is_idempotent_and_picks_up_late_baselines(spark, tmp_path):
    f, a, s = (make(spark, str(tmp_path / n)) for n, make in (("f", logs.forecast_log), ("a", logs.actual_log), ("s", logs.score_log)))
    with pytest.raises(GuardError):
        logs.grade_store(f, a, s)
    logs.append_forecasts(f, forecast_day(spark))
    today = timeline.window_clock(spark, "2026-08-01", "2026-08-02").select("timestamp", F.lit(35.0).alias("price_gbp_mwh"))
    logs.append_actuals(a, today, "2026-08-01", "2026-08-02", "initial")
    assert logs.grade_store(f, a, s).count() == 48
    assert logs.grade_store(f, a, s).count() == 0
    prior = timeline.window_clock(spark, "2026-07-31", "2026-08-01").select("timestamp", F.lit(36.0).alias("price_gbp_mwh"))
    logs.append_actuals(a, prior, "2026-07-31", "2026-08-01", "initial")
    assert logs.grade_store(f, a, s).count() == 48
    got = s.read().agg(F.count("*"), F.avg("absolute_error"), F.avg("persistence_absolute_error")).first()
    assert tuple(got) == (48, 5.0, 1.0)


def test_history_rules(spark, frame, tmp_path):
    rows = frame([("m", "2026-07-31 12:00:00", "2026-08-01", 1.0)], "model_version string, forecast_issue_time_utc string, delivery_date string, v double", ["forecast_issue_time_utc"])
    log = logs.history_log(spark, str(tmp_path / "h"), K.FORECAST_HISTORY_KEY)
    log.keep_history(rows)
    assert log.keep_history(rows).count() == 0
    with pytest.raises(GuardError, match="conflicting"):
        log.keep_history(rows.withColumn("v", F.lit(2.0)))
    log.keep_history(rows.withColumn("v", F.lit(2.0)), replace=True)
    assert [r.v for r in log.read().collect()] == [2.0]
    summary = logs.history_log(spark, str(tmp_path / "s"), ["delivery_date"])
    summary.merge_columns(rows.select("delivery_date", "v"))
    summary.merge_columns(rows.select("delivery_date", F.lit(7.0).alias("w")))
    r = summary.read().first()
    assert (r.v, r.w) == (1.0, 7.0)


def archive_tables(spark, first="2025-12-31", middle="2026-01-01", end="2026-01-03", late_day=None):
    """Two archives; each period has a timely revision and a late one that must not win."""
    spine = timeline.window_clock(spark, first, end)
    hours = timeline.window_clock(spark, first, end, step_s=3600)
    tag = F.when(F.col("delivery_date") < middle, "one").otherwise("two")
    issue = clock.issue_instant("timestamp")
    shift = F.when(F.col("delivery_date") == F.lit(late_day), 7200).otherwise(-3600) if late_day else F.lit(-3600)
    timely = spine.select("timestamp", tag.alias("archive"), F.lit(2000.0).alias("embedded_wind_mw"), F.lit(1.0).alias("embedded_solar_mw"),
                          clock.add_seconds(issue, shift).alias("published_at_utc"))
    late = timely.withColumn("embedded_wind_mw", F.lit(9999.0)).withColumn("published_at_utc", clock.add_seconds(issue, 18000))
    tables = {n: spine.select("timestamp", tag.alias("archive"), F.lit(1.0).alias("v")) for n in ("price", "demand", "fuel", "interconnectors", "inertia")}
    weather = hours.select("timestamp", tag.alias("archive"), F.hour("timestamp").cast("double").alias("t"))
    tables |= {"embedded": timely.unionByName(late), **{f"weather_{g}": weather for g in ("demand", "wind", "solar")}}
    windows = spark.createDataFrame([("one", first, middle), ("two", middle, end)], "archive string, s string, e string").select(
        "archive", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"), F.lit("historical-v4").alias("revision"), F.lit(0).alias("failed_steps"), F.lit(0).alias("audit_errors"))
    return windows, tables


def test_archives_merge_point_in_time(spark, tmp_path):
    windows, tables = archive_tables(spark, "2026-01-01", "2026-01-02", "2026-01-03")
    r = history.merge_archives(windows, tables, "2026-01-01", "2026-01-03", str(tmp_path)).first()
    assert (r.training_half_hour_rows, r.excluded_settlement_dates_local, r.embedded_raw_revision_rows) == (96, [], 192)
    chosen = spark.read.parquet(str(tmp_path / "embedded"))
    assert chosen.count() == 96 and chosen.where("embedded_wind_mw <> 2000").isEmpty()
    weather = spark.read.parquet(str(tmp_path / "weather_demand")).orderBy(F.desc("timestamp")).limit(2).collect()
    assert r.source_rows["weather_demand"] == 49 and weather[0].weather_demand_t == weather[1].weather_demand_t


def test_archive_seam_day_is_excluded_everywhere(spark, tmp_path):
    windows, tables = archive_tables(spark, late_day="2026-01-01")
    r = history.merge_archives(windows, tables, "2025-12-31", "2026-01-03", str(tmp_path)).first()
    assert (r.full_calendar_half_hour_rows, r.training_half_hour_rows) == (144, 96)
    assert r.excluded_settlement_dates_local == ["2026-01-01"] and set(r.source_rows.values()) == {96, 73}
    windows, tables = archive_tables(spark, late_day="2026-01-02")
    with pytest.raises(GuardError, match="cannot be excluded"):
        history.merge_archives(windows, tables, "2025-12-31", "2026-01-03", str(tmp_path / "b"))


def test_archive_checks(spark, tmp_path):
    windows, tables = archive_tables(spark)
    for change in (windows.withColumn("failed_steps", F.lit(1)), windows.withColumn("revision", F.lit("v3")), windows.where("archive = 'one'")):
        with pytest.raises(GuardError):
            history.merge_archives(change, tables, "2025-12-31", "2026-01-03", str(tmp_path))
    clash = tables["price"].unionByName(tables["price"].withColumn("v", F.lit(2.0)))
    gap = tables["price"].where("timestamp <> '2026-01-01 05:00:00'")
    for broken in (clash, gap):
        with pytest.raises(GuardError):
            history.merge_archives(windows, tables | {"price": broken}, "2025-12-31", "2026-01-03", str(tmp_path))


def modelling_sources(spark):
    windows, t = archive_tables(spark)
    cols = lambda n, **c: t[n].select("timestamp", *[F.lit(v).alias(k) for k, v in c.items()])
    return {
        "price": cols("price", price_gbp_mwh=50.0), "demand": cols("demand", demand_mw=30000.0),
        "fuel": cols("fuel", fuel_wind_mw=5000.0, fuel_nuclear_mw=4000.0), "interconnectors": cols("interconnectors", net_import_mw=-100.0),
        "embedded": t["embedded"].drop("archive"), "inertia": cols("inertia", outturn_inertia_gvas=150.0),
        **{f"weather_{g}": t[f"weather_{g}"].select("timestamp", F.col("t").alias(f"{g}_t")) for g in ("demand", "wind", "solar")},
    }


CONFIG = {
    "columns": {"price_gbp_mwh": "price_gbp_mwh", "demand_mw": "demand_mw", "transmission_wind_mw": "fuel_wind_mw", "nuclear_mw": "fuel_nuclear_mw",
                "embedded_timestamp": "timestamp", "embedded_published_at": "published_at_utc", "embedded_wind_mw": "embedded_wind_mw",
                "embedded_solar_mw": "embedded_solar_mw", "inertia_timestamp": "timestamp", "inertia_gvas": "outturn_inertia_gvas"},
    "optional_columns": {"net_import_mw": "net_import_mw"}, "required_components": K.CORE_COMPONENTS,
}


def test_modelling_table(spark):
    out = dataset.modelling_table(modelling_sources(spark), CONFIG)
    r = out.agg(F.count("*").alias("n"), F.max("embedded_wind_mw").alias("w"), F.min("model_profile").alias("p")).first()
    assert (r.n, r.w, r.p) == (144, 2000.0, "core_without_battery")
    half = out.where("timestamp = '2026-01-01 05:30:00'").first()
    assert half.demand_t == 5.5 and str(half.issue_time_utc) == "2025-12-31 13:00:00"
    src = modelling_sources(spark)
    with pytest.raises(GuardError, match="gaps"):
        dataset.modelling_table(src | {"inertia": src["inertia"].where("timestamp < '2026-01-01'")}, CONFIG)
    with pytest.raises(GuardError, match="repeats key"):
        dataset.modelling_table(src | {"demand": src["demand"].unionByName(src["demand"])}, CONFIG)
    with pytest.raises(KeyError):
        dataset.modelling_table(src, CONFIG | {"required_components": K.FULL_COMPONENTS})
    with pytest.raises(KeyError):
        dataset.modelling_table(src, CONFIG | {"optional_columns": {"net_import_mw": "absent"}})


@pytest.mark.parametrize("day, rows", [("2026-03-29", 46), ("2026-10-25", 50)])
def test_day_features(spark, day, rows):
    before, after = (str((pd.Timestamp(day) + pd.Timedelta(days=d)).date()) for d in (-1, 1))
    hourly = timeline.window_clock(spark, before, after, step_s=3600).select("timestamp", F.hour("timestamp").cast("double").alias("t"))
    past = str((pd.Timestamp(day) - pd.Timedelta(days=8)).date())
    hist = timeline.window_clock(spark, past, after).select("timestamp", F.lit(1.0).alias("demand_mw"), F.lit(2.0).alias("nuclear_mw"))
    features = ["hh_sin", "weather_demand_t", "weather_wind_t", "fallback_d7_demand_mw"]
    args = dict(weather={"demand": hourly, "wind": hourly}, profile="core_without_battery", features=features, history=hist, fallbacks=["demand_mw", "nuclear_mw"])
    out = day_ahead.day_features(spark, day, f"{before} 13:00:00", **args)
    assert out.count() == rows and out.where("fallback_d7_demand_mw is null or weather_demand_t is null").isEmpty()
    for issue in (f"{day} 13:00:00", "2026-01-01 00:00:00"):
        with pytest.raises(GuardError, match="issue time"):
            day_ahead.day_features(spark, day, issue, **args)
    with pytest.raises(GuardError, match="gaps"):
        day_ahead.day_features(spark, day, f"{before} 13:00:00", **(args | {"history": hist.where(F.col("timestamp") > F.lit(day).cast("timestamp"))}))


def test_market_report(spark):
    spine = timeline.window_clock(spark, "2026-08-20", "2026-08-21")
    n = F.col("settlement_period").cast("double")
    system = spine.select("timestamp", *[(n * k).alias(c) for k, c in enumerate(
        ["demand_mw", "embedded_wind_mw", "embedded_solar_mw", "transmission_wind_mw", "nuclear_mw", "net_import_mw", "inertia_gvas", "total_wind_mw",
         "residual_before_nuclear_mw", "residual_after_nuclear_mw", "net_system_short_mw"], 1)], F.lit("model").alias("component_source_demand_mw"),
        F.when(n > 3, "model").otherwise("fallback_d7").alias("component_source_nuclear_mw"))
    price = spine.select("timestamp", (n - 1).alias("p10"), n.alias("p50"), (n + 1).alias("p90"), F.lit(0.25).alias("negative_probability"))
    risk = spark.createDataFrame([("2026-08-20", 7638.831431809186, 8833.691845596159)], "delivery_date string, scenario_var double, expected_shortfall double")
    r = day_ahead.daily_market_report(system, price, risk)
    first = r["half_hourly"].orderBy("settlement_period").first()
    assert (first.gb_time, first.settlement_period, first.solar_mw, first.price_p50_gbp_mwh) == ("00:00", 1, 3.0, 1.0)
    e = r["energy_and_peaks"].first()
    assert e.demand_mw_energy_mwh == sum(range(1, 49)) / 2 and e.minimum_nuclear_mw == 5.0
    assert str(e.peak_demand_mw_at) == "2026-08-20 22:30:00"
    assert r["price_summary"].first().p50_mean_gbp_mwh == 24.5
    assert {x.component: x.source for x in r["component_sources"].collect()} == {"demand_mw": "model", "nuclear_mw": "mixed"}
    assert r["position_limits"].first().maximum_volume_binding_mwh == pytest.approx(113.20295268150291)
    with pytest.raises(GuardError, match="align"):
        day_ahead.half_hourly_report(system, price.limit(47))


def test_fallback_profile_needs_history(spark):
    spine = timeline.window_clock(spark, "2026-08-20", "2026-08-21").select("timestamp")
    hist = timeline.window_clock(spark, "2026-08-13", "2026-08-14").select("timestamp", F.lit(5.0).alias("demand_mw"))
    assert collect.fallback_profile(hist, spine, ["demand_mw"]).where("fallback_d7_demand_mw = 5").count() == 48
    with pytest.raises(GuardError):
        collect.fallback_profile(hist.limit(40), spine, ["demand_mw"])


# --- models -----------------------------------------------------------------------------

QUICK = {"maxIter": 5, "maxDepth": 3, "seed": 42}


def linear(spark, rows=240):
    t = pd.date_range("2026-01-01", periods=rows, freq="30min")
    x = np.sin(np.arange(rows) / 7.0) * 10
    return spark.createDataFrame(pd.DataFrame({"timestamp": t, "x": x, "target": 2 * x}))


def test_out_of_fold_leaves_the_first_block(spark):
    df = linear(spark)
    oof = models.out_of_fold(df, ["x"], "target", 4, params=QUICK).join(df, "timestamp").toPandas().sort_values("timestamp")
    assert len(oof) == 240 - 240 // 5 and oof.timestamp.min() == pd.Timestamp("2026-01-02")
    assert (oof.oof_target - oof.target).abs().mean() < 3
    score = models.holdout(df, ["x"], "target", 60, params=QUICK)
    assert score["comparison_rows"] == 60 and score["model_mae"] < 3 and score["holdout_rows"] == 60
    with pytest.raises(GuardError):
        models.fit_regressor(df.withColumn("target", F.lit(None).cast("double")), ["x"], "target")
    with pytest.raises(ValueError):
        models.fit_regressor(df, ["x"], "target", "log")


def test_regressor_survives_storage(spark, tmp_path):
    df = linear(spark)
    model = models.fit_regressor(df, ["x"], "target", "arcsinh", params=QUICK)
    model.save(str(tmp_path / "m"))
    again = models.Regressor.load(str(tmp_path / "m"))
    pair = again.predict(model.predict(df, "a"), "b")
    assert pair.where("abs(a - b) > 1e-9").isEmpty() and again.transform == "arcsinh"


def test_curtailment_needs_both_kinds(spark):
    df = linear(spark).withColumn("cut", F.greatest(F.col("target"), F.lit(0.0)))
    out = models.predict_curtailment(models.fit_curtailment(df, ["x"], "cut", QUICK), df)
    assert out.where("abs(expected_curtailed_mw - curtailment_probability * conditional_curtailed_mw) > 1e-9 or curtailment_probability not between 0 and 1").isEmpty()
    with pytest.raises(GuardError):
        models.fit_curtailment(df.withColumn("cut", F.lit(0.0)), ["x"], "cut", QUICK)
    classes = models.fit_classes(df.withColumn("kind", F.when(F.col("x") > 0, "wind").otherwise("gas")), ["x"], "kind", trees=5)
    p = models.class_probabilities(classes, df)
    assert p.where("abs(probability_gas + probability_wind - 1) > 1e-9").isEmpty()
    assert p.where("predicted_kind <> if(x > 0, 'wind', 'gas')").count() < 10


def test_bundle_switches_to_the_seven_day_profile(spark, tmp_path):
    t = pd.date_range("2026-01-01", periods=48 * 40, freq="30min")
    shape = np.tile(np.arange(48.0), 40)
    df = spark.createDataFrame(pd.DataFrame({"timestamp": t, "demand_mw": 30000 + shape, "nuclear_mw": 4000 + shape, "inertia_gvas": 150 + shape}))
    path = str(tmp_path)
    targets = ["demand_mw", "nuclear_mw", "inertia_gvas"]
    meta = {"model_profile": "core_without_battery", "component_targets": targets, "metrics": {"demand_mw": {"model_mae": 1000.0}, "nuclear_mw": {"model_mae": 500.0}, "inertia_gvas": {"model_mae": 0.1}}}
    models.save_json(spark, meta, f"{path}/metadata")
    df.select("timestamp", *[F.lit(1.0).alias(c) for c in targets]).write.parquet(f"{path}/component_errors")
    out = models.prepare_bundle(df, path, holdout_rows=480)
    assert [out["component_strategy"][t]["source"] for t in targets] == ["fallback_d7", "fallback_d7", "model"]
    assert out["operational_error_rows"] == 48 * 33 >= 1440
    assert spark.read.parquet(f"{path}/operational_errors").where("demand_mw <> 0 or inertia_gvas <> 1").isEmpty()
    with pytest.raises(GuardError, match="error history"):
        models.prepare_bundle(df, path, holdout_rows=480, min_rows=10_000)
    live = df.limit(48).withColumns({"fallback_d7_demand_mw": F.lit(1.0), "fallback_d7_nuclear_mw": F.lit(2.0)})
    bundle = models.bundle_metadata(spark, path) | {"component_targets": ["demand_mw", "nuclear_mw"]}
    r = models.point_forecasts(live, path, bundle).first()
    assert (r.demand_mw, r.nuclear_mw, r.component_source_demand_mw) == (1.0, 2.0, "fallback_d7")


# --- streams ----------------------------------------------------------------------------

def test_streamed_actuals_replay_harmlessly(spark, tmp_path):
    rows = timeline.window_clock(spark, "2026-08-01", "2026-08-02").select(F.col("timestamp").alias("delivery_time_utc"), F.lit("initial").alias("actual_revision"), F.lit(1.0).alias("actual_price"))
    rows.unionByName(rows).write.parquet(str(tmp_path / "in"))
    log = logs.actual_log(spark, str(tmp_path / "log"))
    for run in ("one", "two"):  # the second run starts without state, as after a lost checkpoint
        stream = jobs.file_stream(spark, str(tmp_path / "in"), rows.schema)
        jobs.ingest_actuals(stream, log, str(tmp_path / run)).awaitTermination()
        assert log.read().count() == 48


def test_streamed_half_hours_close_behind_the_watermark(spark, tmp_path):
    pdf = pd.DataFrame({"ts": pd.to_datetime(["2026-01-01 00:05", "2026-01-01 00:20", "2026-01-01 00:40", "2026-01-01 03:00"]), "k": "a", "v": [1.0, 3.0, 5.0, 9.0]})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    jobs.write_table(jobs.half_hourly_means(stream, "ts", ["k"], "v"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r.v, r.n) for r in got] == [(2.0, 2), (5.0, 1)]


def test_log_reads_only_the_dates_of_the_batch(spark, tmp_path):
    log = logs.LogTable(spark, str(tmp_path / "log"), ["delivery_time_utc"])
    rows = spark.range(40).select((F.lit("2026-03-01").cast("timestamp").cast("long") + F.col("id") * 86400).cast("timestamp").alias("delivery_time_utc"), F.col("id").alias("v"))
    log.append_unique(rows)
    few = rows.where("v between 10 and 12")
    listed = {f.split("log_date=")[1][:10] for f in log._prior(log.versions.latest(), log._landed(few)).inputFiles()}
    assert listed == {"2026-03-11", "2026-03-12", "2026-03-13"}
    with pytest.raises(GuardError, match="immutable"):
        log.append_unique(few)
    with pytest.raises(GuardError, match="repeats key"):
        log.upsert(few.unionByName(few))
    assert log.append_new(rows.withColumn("v", F.lit(0).cast("long"))).count() == 0 and log.read().count() == 40


def test_repeated_lag_times_are_refused_and_untimed_rows_kept(frame):
    from settlespark.operators import point_in_time as pit
    df = frame([("a", "2026-01-01 00:00:00", 1.0), ("a", "2026-01-01 00:00:00", 2.0)], "k string, t string, v double", times=["t"])
    with pytest.raises(Exception, match="repeated t"):
        pit.timestamp_lags(df, ["k"], "t", "v", {"x": 60}).collect()
    gaps = frame([("a", None, 1.0), ("a", None, 2.0), ("a", "2026-01-01 00:00:00", 3.0)], "k string, t string, v double", times=["t"])
    assert pit.timestamp_lags(gaps, ["k"], "t", "v", {"x": 60}).count() == 3


def test_charge_keeps_long_payloads_exact_and_blocks_do_not_matter(frame):
    from settlespark.operators import series
    rows = [("u", f"2026-01-01 {h:02d}:{m:02d}:00", (-1.0) ** h * 3, 2 ** 53 + 1 if h % 2 else None) for h in range(12) for m in (0, 30)]
    df = frame(rows, "k string, t string, p double, n long", times=["t"])
    got = [sorted(map(tuple, series.state_of_charge(df, ["k"], "t", "p", 1.0, 5.0, block_s=b).select("t", "n", "battery_soc_mwh").collect())) for b in (1, 86400)]
    assert [x[:2] for x in got[0]] == [x[:2] for x in got[1]] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(*got))
    assert {x[1] for x in got[0]} == {None, 2 ** 53 + 1}


def test_forecast_days_of_many_models_are_logged_at_once(spark, tmp_path):
    log = logs.forecast_log(spark, str(tmp_path / "f"))
    first = forecast_day(spark).unionByName(forecast_day(spark, model="n"))
    rows = first.unionByName(forecast_day(spark, "2026-08-02", "2026-08-01 12:00:00"))
    assert {r.action for r in logs.log_forecast_days(log, first).collect()} == {"appended_new_immutable_day"}
    with pytest.raises(GuardError, match="already stored"):
        logs.log_forecast_days(log, rows)
    got = {(r.model_version, str(r.delivery_date)): r.action for r in logs.log_forecast_days(log, rows, reuse=True).collect()}
    kept, new = "reused_existing_immutable_day", "appended_new_immutable_day"
    assert got == {("m", "2026-08-01"): kept, ("n", "2026-08-01"): kept, ("m", "2026-08-02"): new} and log.read().count() == 144
    with pytest.raises(GuardError, match="other periods"):
        logs.log_forecast_days(log, rows.where("delivery_time_utc < '2026-08-02 12:00:00'"), reuse=True)
    with pytest.raises(GuardError, match="after the issue"):
        logs.log_forecast_days(log, forecast_day(spark, "2026-08-03", "2026-08-03 12:00:00"))


def test_the_forecast_query_stores_all_days_of_all_models(spark, monkeypatch):
    from settlespark.workload import load, plan_queries
    made = []
    monkeypatch.setattr(plan_queries.logs, "forecast_log", lambda *a, f=logs.forecast_log: made.append(f(*a)) or made[-1])
    load().QUERIES["appended_forecast_days"](spark, "/root/testdata/sf0.001").count()
    stored = made[0].read().withColumn("d", clock.delivery_date("delivery_time_utc"))
    assert stored.select("model_version").distinct().count() > 1 and stored.select("d").distinct().count() > 3
