"""Versions of log tables: writers that interleave, readers that stay on their version, files that are listed."""

import pytest
from pyspark.sql import functions as F

from settlespark.errors import GuardError
from settlespark.plans import logs
from settlespark.plans.commits import Versions


def rows_of(spark, first, count, value=1.0):
    start = F.lit(first).cast("timestamp").cast("long")
    return spark.range(count).select((start + F.col("id") * 43200).cast("timestamp").alias("delivery_time_utc"), F.lit(value).alias("v"))


def interleaved(monkeypatch, other, times=1):
    """Run ``other`` just before the next ``times`` publications of the table under test."""
    real, left = Versions.publish, [times]

    def publish(self, *args):
        if left[0]:
            left[0] -= 1
            other()
        return real(self, *args)

    monkeypatch.setattr(Versions, "publish", publish)


def test_of_two_writers_of_one_key_one_is_refused(spark, tmp_path, monkeypatch):
    log, twin = (logs.LogTable(spark, str(tmp_path / "log"), ["delivery_time_utc"]) for _ in range(2))
    log.append_unique(rows_of(spark, "2026-03-01", 4))
    interleaved(monkeypatch, lambda: twin.append_unique(rows_of(spark, "2026-03-05", 4, 2.0)))
    with pytest.raises(GuardError, match="immutable"):
        log.append_unique(rows_of(spark, "2026-03-06", 4, 3.0))
    got = {(str(r.delivery_time_utc), r.v) for r in log.read().collect()}
    assert len(got) == log.read().count() == 8 and {v for _, v in got} == {1.0, 2.0}
    assert log.versions.numbers() == [1, 2]
    # The refused rows are gone, not only hidden.
    assert sum(len(c) for c in log.versions.latest().commits.values()) == len(list((tmp_path / "log" / "data").glob("commit=*/log_date=*")))


def test_writers_of_different_keys_both_get_in(spark, tmp_path, monkeypatch):
    log, twin = (logs.LogTable(spark, str(tmp_path / "log"), ["delivery_time_utc"]) for _ in range(2))
    log.append_new(rows_of(spark, "2026-03-01", 4))
    interleaved(monkeypatch, lambda: twin.append_new(rows_of(spark, "2026-03-03", 4, 2.0)))
    added = log.append_new(rows_of(spark, "2026-03-02", 8, 3.0))
    # 2 March is stored, 3 and 4 March came from the other writer; only 5 March is new.
    assert {str(r.delivery_time_utc)[:10] for r in added.collect()} == {"2026-03-05"}
    assert [r.v for r in log.read().orderBy("delivery_time_utc").collect()] == [1.0] * 4 + [2.0] * 4 + [3.0] * 2


def test_a_write_gives_up_after_one_retry(spark, tmp_path, monkeypatch):
    log, twin = (logs.LogTable(spark, str(tmp_path / "log"), ["delivery_time_utc"]) for _ in range(2))
    days = iter(["2026-04-01", "2026-04-11", "2026-04-21"])
    real, inside = Versions.publish, []

    def publish(self, *args):
        if not inside:
            inside.append(1)
            twin.append_unique(rows_of(spark, next(days), 2))
            inside.clear()
        return real(self, *args)

    monkeypatch.setattr(Versions, "publish", publish)
    with pytest.raises(GuardError, match="written by others"):
        log.append_unique(rows_of(spark, "2026-03-01", 2))
    assert log.read().count() == 4


def test_a_reader_sees_the_old_rows_or_the_new_never_both(spark, tmp_path):
    log = logs.LogTable(spark, str(tmp_path / "log"), ["delivery_time_utc"])
    log.upsert(rows_of(spark, "2026-03-01", 6))
    before = log.read()
    log.upsert(rows_of(spark, "2026-03-02", 2, 9.0))
    assert sorted(r.v for r in before.collect()) == [1.0] * 6
    assert sorted(r.v for r in log.read().collect()) == [1.0] * 4 + [9.0] * 2
    assert log.upsert(rows_of(spark, "2026-03-02", 2, 9.0 + 1e-12)).count() == 0 and len(log.versions.numbers()) == 2


def test_a_guard_that_fails_leaves_no_version(spark, tmp_path):
    log = logs.history_log(spark, str(tmp_path / "h"), ["delivery_date"])
    day = spark.createDataFrame([("2026-03-01", 1.0)], "delivery_date string, v double")
    log.keep_history(day)
    with pytest.raises(GuardError, match="conflicting"):
        log.keep_history(day.withColumn("v", F.lit(2.0)))
    assert log.versions.numbers() == [1] and log.keep_history(day).count() == 0


def test_later_columns_join_the_schema_and_old_versions_expire(spark, tmp_path):
    log = logs.LogTable(spark, str(tmp_path / "log"), ["delivery_time_utc"])
    log.append_unique(rows_of(spark, "2026-03-01", 2))
    log.append_unique(rows_of(spark, "2026-03-03", 2).withColumn("w", F.lit("x")))
    for value in (5.0, 6.0):
        log.upsert(rows_of(spark, "2026-03-01", 2, value).withColumn("w", F.lit("y")))
    assert log.versions.expire(keep=1) == 2 and log.versions.numbers() == [4]
    assert sorted((r.v, r.w) for r in log.read().collect()) == [(1.0, "x")] * 2 + [(6.0, "y")] * 2
    untimed = spark.createDataFrame([(None, 1.0, None)], "delivery_time_utc timestamp, v double, w string")
    log.append_new(untimed)
    assert log.read().where("delivery_time_utc IS NULL").count() == 1


def test_one_day_is_logged_without_reading_the_rest_of_the_store(spark, tmp_path, monkeypatch):
    from settlespark.functions import clock
    from settlespark.operators import timeline

    def day(first, end):
        return timeline.window_clock(spark, first, end).select(
            F.lit("m").alias("model_version"), F.col("timestamp").alias("delivery_time_utc"),
            clock.issue_instant(clock.day_start(clock.delivery_date("timestamp"))).alias("issue_time_utc"), F.lit(1.0).alias("p50"))

    log = logs.forecast_log(spark, str(tmp_path / "f"))
    assert logs.log_forecast_days(log, day("2026-03-01", "2026-03-21")).count() == 20
    seen, real = [], Versions.read
    monkeypatch.setattr(Versions, "read", lambda self, *a: seen.append(real(self, *a)) or seen[-1])
    assert logs.log_forecast_day(log, day("2026-03-10", "2026-03-11"), reuse=True) == "reused_existing_immutable_day"
    logs.log_forecast_day(log, day("2026-03-21", "2026-03-22"))
    logs.log_forecast_days(log, day("2026-03-20", "2026-03-23").where("delivery_time_utc < '2026-03-21' or delivery_time_utc >= '2026-03-22'"), reuse=True)
    days = [{f.split("log_date=")[1][:10] for f in s.inputFiles()} for s in seen]
    assert max(map(len, days)) <= 2 and set().union(*days) == {"2026-03-10", "2026-03-20", "2026-03-21"}
