"""Ordered operators against pandas, with tiny blocks so that every border is crossed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from settlespark.errors import GuardError
from settlespark.operators import blocks, point_in_time as pit, series


def sample(rows=400, hot=0.6, seed=1):
    """Uneven series: one holds most rows, times are irregular and unsorted."""
    rng = np.random.default_rng(seed)
    k = np.where(rng.random(rows) < hot, "hot", rng.choice(["b", "c"], rows))
    t = pd.Timestamp("2026-03-20") + pd.to_timedelta(np.sort(rng.choice(20 * 86400, rows, replace=False)), unit="s")
    pdf = pd.DataFrame({"k": k, "t": t, "v": rng.normal(size=rows).round(3), "id": np.arange(rows)})
    return pdf.sample(frac=1, random_state=seed)


@pytest.fixture(params=[3600, 3 * 86400])
def block(request):
    return request.param


def collected(df, sort=("k", "t")):
    return df.toPandas().sort_values(list(sort)).reset_index(drop=True)


def test_positions_and_lags(spark, block):
    pdf = sample()
    df = spark.createDataFrame(pdf)
    got = collected(blocks.row_lags(df, ["k"], "t", {"l1": ("v", 1), "l7": ("v", 7)}, block_s=block, rows_per_task=10))
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    for n in (1, 7):
        np.testing.assert_allclose(got[f"l{n}"], want.groupby("k").v.shift(n))
    numbered = collected(blocks.number_rows(df, ["k"], "t", block_s=block))
    assert (numbered["_pos"] == want.groupby("k").cumcount()).all()
    assert (numbered["_total"] == want.groupby("k").v.transform("size")).all()


def test_nearest_known_both_ways(spark, block):
    pdf = sample()
    pdf.loc[pdf.id % 3 != 0, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    got = collected(blocks.nearest_known(df, ["k"], "t", {"v": F.col("v")}, block_s=block, ahead=True))
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    np.testing.assert_allclose(got["prev_v"].astype(float), want.groupby("k").v.ffill())
    np.testing.assert_allclose(got["next_v"].astype(float), want.groupby("k").v.bfill())


def test_asof_join_matches_pandas(spark, block):
    left, right = sample(seed=2), sample(rows=150, seed=3)[["k", "t", "v"]].rename(columns={"t": "pub", "v": "w"})
    right.loc[right.index[:5], "pub"] = left.t.iloc[:5].to_numpy()  # equal times count
    a, b = spark.createDataFrame(left), spark.createDataFrame(right)
    got = pit.asof_join(a, b, "t", "pub", ["k"], tie=["w"], block_s=block).toPandas().sort_values("id").reset_index(drop=True)
    ordered = right.sort_values(["pub", "w"])
    want = pd.merge_asof(left.sort_values("t"), ordered, left_on="t", right_on="pub", by="k").sort_values("id").reset_index(drop=True)
    np.testing.assert_allclose(got.w.astype(float), want.w.astype(float))
    assert (got.pub.isna() == want.pub.isna()).all() and len(got) == len(left)


def test_asof_join_is_the_same_under_any_partitioning(spark):
    left, right = spark.createDataFrame(sample(seed=4)), spark.createDataFrame(sample(rows=99, seed=5).rename(columns={"t": "pub"}).drop(columns="id"))
    runs = [
        pit.asof_join(left.repartition(n), right.repartition(n), "t", "pub", ["k"], tie=["v"]).orderBy("id").toPandas() for n in (1, 7)
    ]
    pd.testing.assert_frame_equal(*runs)
    assert {"v", "v_right"} <= set(runs[0].columns)


def test_asof_join_keeps_rows_without_time_or_match(frame):
    left = frame([("a", None, 1), ("a", "2026-01-01 00:00:00", 2), ("z", "2026-01-05 00:00:00", 3)], "k string, t string, id int", ["t"])
    right = frame([("a", "2026-01-02 00:00:00", 5.0), ("a", None, 6.0)], "k string, pub string, v double", ["pub"])
    got = pit.asof_join(left, right, "t", "pub", ["k"]).orderBy("id").collect()
    assert [(r.id, r.v) for r in got] == [(1, None), (2, None), (3, None)]


def test_fit_block_narrows_until_it_fits(spark):
    df = spark.createDataFrame(sample())
    assert blocks.fit_block(df, ["k"], "t") == blocks.WIDTHS[0]
    width = blocks.fit_block(df, ["k"], "t", max_rows=20)
    top = df.groupBy("k", blocks.block_of("t", width)).count().agg(F.max("count")).first()[0]
    assert top <= 20 and width < blocks.WIDTHS[0]


def test_latest_revision_known_at_issue(frame):
    df = frame([("d", "2026-07-30 08:00:00", 10.0), ("d", "2026-07-31 08:00:00", 11.0), ("d", "2026-07-31 15:00:00", 99.0), ("d", None, 5.0)],
               "delivery string, published_at_utc string, value double", ["published_at_utc"])
    got = pit.latest_revision(df, ["delivery"], issue="2026-07-31 13:00:00").collect()
    assert [r.value for r in got] == [11.0]
    assert pit.latest_revision(df, ["delivery"], issue="2026-07-31 15:00:00").first().value == 99.0  # inclusive
    with pytest.raises(KeyError):
        pit.latest_revision(df, ["nope"])


def test_future_information_is_refused(frame):
    df = frame([("2026-07-31 13:00:00", "2026-07-31 14:00:00")], "issue_time_utc string, weather_published_at_utc string", ["issue_time_utc", "weather_published_at_utc"])
    with pytest.raises(GuardError, match="weather_published_at_utc"):
        pit.require_no_future_information(df)
    pit.require_no_future_information(df.withColumn("weather_published_at_utc", F.col("issue_time_utc")))


def test_timestamp_lag_is_by_time_not_by_row(frame):
    df = frame([("s", "2026-01-01 00:00:00", 1.0), ("s", "2026-01-02 00:00:00", 2.0), ("s", "2026-01-04 00:00:00", 4.0)], "k string, t string, v double", ["t"])
    got = pit.timestamp_lags(df, ["k"], "t", "v", {"before": 86400}).orderBy("t").collect()
    assert [r.before for r in got] == [None, 1.0, None] and [r.v for r in got] == [1.0, 2.0, 4.0]


def test_interpolation_matches_pandas(spark, block):
    rng = np.random.default_rng(6)
    known = pd.DataFrame({"t": pd.date_range("2026-01-01", periods=60, freq="h"), "a": rng.normal(size=60), "b": rng.normal(size=60)})
    known.loc[10:13, "a"] = np.nan
    grid = pd.DataFrame({"t": pd.date_range("2025-12-31 22:00", "2026-01-03 14:00", freq="30min")})
    src = spark.createDataFrame(known).withColumn("a", F.nanvl("a", F.lit(None)))
    got = series.interpolate_to(src, spark.createDataFrame(grid), [], "t", ["a", "b"], block_s=block).toPandas().sort_values("t")
    x = known.set_index("t")
    want = x.reindex(x.index.union(grid.t)).interpolate(method="time").reindex(grid.t)
    np.testing.assert_allclose(got[["a", "b"]].astype(float), want[["a", "b"]])


@pytest.mark.parametrize("batch", [7, 10_000])
def test_state_of_charge_matches_a_loop(spark, block, batch):
    pdf = sample(seed=7)
    pdf["v"] = pdf.v * 40
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = collected(series.state_of_charge(spark.createDataFrame(pdf), ["k"], "t", "v", 25.0, 50.0, block_s=block))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = []
    for _, g in pdf.sort_values(["k", "t"]).groupby("k"):
        soc = 25.0
        for p in g.v:
            soc = min(50.0, max(0.0, soc - 0.5 * p / 0.93 if p >= 0 else soc - 0.5 * p * 0.93))
            want.append(soc)
    np.testing.assert_allclose(got.battery_soc_mwh, want, atol=1e-9)
    with pytest.raises(ValueError):
        series.state_of_charge(spark.createDataFrame(pdf), ["k"], "t", "v", 1.0, 0.0)


def test_folds_follow_expanding_splits(spark):
    pdf = pd.DataFrame({"k": "a", "t": pd.date_range("2026-01-01", periods=23, freq="30min")})
    got = series.expanding_folds(spark.createDataFrame(pdf), ["k"], "t", 4).orderBy("t").toPandas().fold
    size = 23 // 5
    assert got.isna().sum() == 23 - 4 * size
    assert got.dropna().astype(int).tolist() == [k for k in range(4) for _ in range(size)]
    with pytest.raises(Exception, match="too few rows"):
        series.expanding_folds(spark.createDataFrame(pdf.head(5)), ["k"], "t", 4).collect()


def test_holdout_must_be_shorter_than_the_series(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "t": pd.date_range("2026-01-01", periods=10, freq="30min")}))
    assert series.holdout_split(df, ["k"], "t", 3).where("is_test").count() == 3
    with pytest.raises(Exception, match="smaller than the series"):
        series.holdout_split(df, ["k"], "t", 10).collect()


def points(frame, rows):
    df = frame(rows, "timestamp string, v double, resolution_minutes int, in_domain string, out_domain string", ["timestamp"])
    return df


def test_half_hourly_steps(frame):
    rows = [("2026-01-01 00:00:00", 1.0, 60, "FR", None), ("2026-01-01 01:00:00", 2.0, 15, "FR", None), ("2026-01-01 01:15:00", 4.0, 15, "FR", None),
            ("2026-01-01 01:00:00", 9.0, 15, "BE", None), ("2026-01-01 02:00:00", 5.0, 30, "FR", None)]
    got = series.to_half_hourly(points(frame, rows), "v").orderBy("in_domain", "timestamp").collect()
    assert [(r.in_domain, r.timestamp.strftime("%H:%M"), r.v, r.resolution_minutes) for r in got] == [
        ("BE", "01:00", 9.0, 30), ("FR", "00:00", 1.0, 30), ("FR", "00:30", 1.0, 30), ("FR", "01:00", 3.0, 30), ("FR", "02:00", 5.0, 30)]
    with pytest.raises(Exception, match="cannot convert minutes"):
        series.to_half_hourly(points(frame, [("2026-01-01 00:00:00", 1.0, 45, "FR", None)]), "v").collect()


def test_contiguous_windows(frame):
    good = [("one", "2026-01-01", "2026-02-01"), ("one", "2026-02-01", "2026-03-01")]
    make = lambda rows: frame(rows, "s string, a string, z string").select("s", F.to_date("a").alias("a"), F.to_date("z").alias("z"))
    series.require_contiguous(make(good), "s", "a", "z", "2026-01-01", "2026-03-01")
    for rows, last in ((good, "2026-04-01"), ([good[0], ("one", "2026-02-02", "2026-03-01")], "2026-03-01")):
        with pytest.raises(GuardError):
            series.require_contiguous(make(rows), "s", "a", "z", "2026-01-01", last)


def test_boundary_row_repeats_the_last(frame):
    df = frame([("a", "2026-01-01 00:00:00", 1.0), ("a", "2026-01-01 01:00:00", 2.0)], "k string, t string, v double", ["t"])
    got = series.carry_to_boundary(df, ["k"], "t", F.lit("2026-01-01 02:00:00").cast("timestamp")).orderBy("t").collect()
    assert [r.v for r in got] == [1.0, 2.0, 2.0] and got[-1].t.hour == 2
