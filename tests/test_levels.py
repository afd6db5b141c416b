"""Borders scanned in a tree, error days drawn as blocks, landed files found by their dates, grading in stream state."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from settlespark.operators import blocks, risk, series, timeline


def nodes(spark, n=400):
    rng = random.Random(1)
    rows = [(k, at, rng.choice([None, float(at)]), rng.randint(0, 3)) for k in "ab" for at in sorted(rng.sample(range(-500, 3000), n))]
    return spark.createDataFrame(rows + [("a", blocks.LAST_BLOCK, 1.0, 2)], "k string, at long, v double, n long").withColumn("w", F.col("v"))


@pytest.mark.parametrize("fan, levels", [(8, 4), (64, 2), (4000, 2)])
def test_levels_hand_on_what_one_window_does(spark, fan, levels):
    kinds = {"n": "sum", "v": "last", "w": "next"}
    flat = blocks.scan_borders(nodes(spark), ["k"], "at", kinds, 1).toPandas().sort_values(["k", "at"]).reset_index(drop=True)
    tree = blocks.scan_borders(nodes(spark), ["k"], "at", kinds, levels, fan).toPandas().sort_values(["k", "at"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(flat, tree[flat.columns], check_dtype=False)
    # No window sees more than the members of one group, but at the top.
    held = nodes(spark).where(F.col("at") < blocks.LAST_BLOCK).groupBy("k", F.floor(F.col("at") / fan)).count().agg(F.max("count")).first()[0]
    assert held <= fan


def test_levels_of_the_calendar():
    assert [blocks.levels_of(w) for w in (28 * 86400, 86400, 3600, 1)] == [1, 2, 2, 3]


def test_opening_states_in_levels(spark):
    rng = random.Random(2)
    rows = [("u", at, rng.uniform(-3, 3), 0.0, 5.0) for at in range(300)]
    ends = spark.createDataFrame(rows, "k string, _blk long, _a double, _lo double, _hi double")
    one, many = (series._opening_states(ends, ["k"], "_blk", F.lit(2.0), levels, 8).toPandas().sort_values("_blk")["_x0"].round(9).tolist() for levels in (1, 3))
    assert one == many and len(one) == 300


def test_second_blocks_equal_wide_ones(spark):
    rows = spark.range(3000).select(F.lit("k").alias("k"), (F.lit("2026-01-01").cast("timestamp").cast("long") + F.col("id") * 97).cast("timestamp").alias("t"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("v"))
    got = [sorted(map(tuple, blocks.nearest_known(rows, ["k"], "t", {"v": F.col("v")}, block_s=b, ahead=True).select("t", "prev_v", "next_v").collect()), key=str) for b in (1, blocks.GRID_BLOCK)]
    numbered = [sorted(map(tuple, blocks.number_rows(rows, ["k"], "t", block_s=b).select("t", "_pos", "_total").collect())) for b in (1, blocks.GRID_BLOCK)]
    assert got[0] == got[1] and numbered[0] == numbered[1]


def test_days_are_drawn_whole(spark):
    errors = timeline.window_clock(spark, "2026-03-27", "2026-03-31").select("timestamp", (F.dayofmonth("delivery_date") * 100 + F.col("settlement_period")).cast("double").alias("e"))
    errors = errors.where("timestamp <> '2026-03-28 05:00:00'")  # a day with a gap is not drawn
    points = timeline.window_clock(spark, "2026-10-24", "2026-10-27").select("timestamp", F.lit(0.0).alias("e"))
    paths = risk.daily_error_scenarios(points, errors, ["e"], scenarios=40, signed={"e"}).toPandas()
    paths["day"], paths["period"] = paths["e"] // 100, paths["e"] % 100
    paths["date"] = (paths["timestamp"] + pd.Timedelta(hours=1)).where(paths["timestamp"] < "2026-10-25 01:00", paths["timestamp"]).dt.date
    assert set(paths["day"]) == {27.0, 29.0, 30.0} and len(paths) == 40 * (48 + 50 + 48)
    for _, path in paths.groupby(["scenario", "date"]):
        path = path.sort_values("timestamp")
        assert path["day"].nunique() == path["error_date"].nunique() == 1 and path["period"].is_monotonic_increasing
        assert path["period"].iloc[0] == 1 and path["period"].max() == {27.0: 48, 29.0: 46, 30.0: 48}[path["day"].iloc[0]]
    with pytest.raises(Exception, match="no complete error days"):
        risk.daily_error_scenarios(points, errors.where("timestamp > '2026-03-30 12:00:00'"), ["e"], scenarios=2).collect()


def test_landing_index_skips_files_and_learns_new_ones(spark, tmp_path):
    import json
    from settlespark.sources import landing, tables

    def land(day, *dates):
        body = json.dumps({"data": [{"settlementDate": d, "settlementPeriod": 1, "value": 1} for d in dates]})
        tables.land_payloads(spark.createDataFrame([(body, "s", day)], "payload string, source string, landed_date string").coalesce(1), path)

    path, index = str(tmp_path / "landing"), str(tmp_path / "index")
    land("2026-01-02", "2026-01-01", "2026-01-02")
    land("2026-01-05", "2026-01-05")
    land("2026-01-06", "no date")
    assert landing.index_landing(spark, path, index) == 3 and landing.index_landing(spark, path, index) == 0
    land("2026-01-09", "2026-01-09")  # not in the index yet: has to be read
    days = {f.split("landed_date=")[1][:10] for f in landing.read_window(spark, path, index, "2026-01-02", "2026-01-04").inputFiles()}
    assert days == {"2026-01-02", "2026-01-06", "2026-01-09"}
    assert landing.index_landing(spark, path, index) == 1
    found = landing.read_window(spark, path, index, "2026-01-05", "2026-01-06")
    assert {str(r.landed_date) for r in found.collect()} == {"2026-01-05", "2026-01-06"}


def test_stateful_grading_equals_batch_grading(spark, tmp_path):
    from settlespark.operators import scoring
    from settlespark.plans import logs
    from settlespark.streaming import grading, jobs
    spine = timeline.window_clock(spark, "2026-03-01", "2026-03-04").select(F.col("timestamp").alias("delivery_time_utc"))
    forecasts = spine.where("delivery_time_utc >= '2026-03-02'").select(
        F.concat(F.lit("m|"), F.col("delivery_time_utc").cast("string")).alias("forecast_id"), F.lit("m").alias("model_version"),
        (F.col("delivery_time_utc") - F.expr("INTERVAL 20 HOURS")).alias("issue_time_utc"), "delivery_time_utc", F.lit(-5.0).alias("p10"), F.lit(0.0).alias("p50"), F.lit(5.0).alias("p90"))
    actuals = spine.select("delivery_time_utc", F.explode(F.array(F.lit("initial"), F.lit("final"))).alias("actual_revision")).withColumn("actual_price", F.hour("delivery_time_utc").cast("double") - 8)
    rows = actuals.collect()
    random.Random(3).shuffle(rows)
    for part in (rows[:100], rows[60:], rows[:30]):  # overlapping and replayed batches in any order
        spark.createDataFrame(part, actuals.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    forecasts.coalesce(1).write.parquet(str(tmp_path / "f"))
    streams = [jobs.file_stream(spark, str(tmp_path / n), spark.read.parquet(str(tmp_path / n)).schema, files_per_trigger=1) for n in ("f", "a")]
    log = logs.score_log(spark, str(tmp_path / "scores"))
    grading.grade_statefully(*streams, log, str(tmp_path / "state"), horizon_s=30 * 86400).awaitTermination()
    columns = ["forecast_id", "actual_revision", "error", "persistence_price", "p10_p90_covered", "actual_negative"]
    assert sorted(map(tuple, log.read().select(*columns).collect()), key=str) == sorted(map(tuple, scoring.grade(forecasts, actuals).select(*columns).collect()), key=str)
