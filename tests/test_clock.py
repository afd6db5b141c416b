import datetime as dt

import pytest
from pyspark.sql import functions as F

from settlespark.errors import GuardError
from settlespark.functions import clock
from settlespark.operators import timeline


@pytest.mark.parametrize("day, periods", [("2026-03-29", 46), ("2026-10-25", 50), ("2026-07-15", 48)])
def test_days_have_their_own_length(spark, frame, day, periods):
    days = frame([(day,)], "d string").select(F.to_date("d").alias("delivery_date"))
    rows = timeline.settlement_spine(days).select(
        "settlement_period", clock.settlement_period("timestamp").alias("p"), clock.delivery_date("timestamp").alias("d"),
        clock.settlement_instant("delivery_date", "settlement_period").alias("back"), "timestamp").collect()
    assert [r.settlement_period for r in rows] == list(range(1, periods + 1))
    assert all(r.p == r.settlement_period and str(r.d) == day and r.back == r.timestamp for r in rows)


def test_period_outside_the_day_is_null(frame):
    df = frame([("2026-03-29", 46), ("2026-03-29", 47), ("2026-10-25", 50), ("2026-07-15", 0), (None, 1), ("2026-07-15", None)], "d string, p int")
    got = [r[0] for r in df.select(clock.settlement_instant("d", "p")).collect()]
    assert [g is None for g in got] == [False, True, False, True, True, True]


def test_issue_time_default_and_wall_clock(frame):
    # The day after the spring change: 13:00 agrees, half past midnight does not.
    df = frame([("2026-03-30 10:00:00",)], "t string", ["t"])
    row = df.select(clock.utc_text(clock.issue_instant("t")), clock.utc_text(clock.issue_instant("t", wall_clock=True)),
                    clock.utc_text(clock.issue_instant("t", 0, 30)), clock.utc_text(clock.issue_instant("t", 0, 30, wall_clock=True))).first()
    assert row[0] == row[1] == "2026-03-29T12:00:00Z"
    assert (row[2], row[3]) == ("2026-03-28T23:30:00Z", "2026-03-29T00:30:00Z")
    with pytest.raises(ValueError):
        clock.issue_instant("t", 24)


def test_date_chunks_do_not_overlap(frame):
    df = frame([("2025-07-01", "2025-08-01")], "a string, z string")
    chunks = df.select(clock.date_chunks("a", "z", 15).alias("c")).first().c
    assert [str(c.start) for c in chunks] == ["2025-07-01", "2025-07-16", "2025-07-31"]
    assert [str(c.end) for c in chunks] == ["2025-07-16", "2025-07-31", "2025-08-01"]
    with pytest.raises(Exception, match="later than its start"):
        frame([("2025-07-01", "2025-07-01")], "a string, z string").select(clock.date_chunks("a", "z", 15)).collect()
    with pytest.raises(ValueError):
        clock.date_chunks("a", "z", 0)


def test_durations(frame):
    df = frame([("PT60M",), ("PT1H30M",), ("PT15M",), (None,)], "t string")
    assert [r[0] for r in df.select(clock.duration_minutes("t")).collect()] == [60, 90, 15, None]
    for bad in ("P1D", "PT", "PT0M", "xPT15M"):
        with pytest.raises(Exception, match="unsupported duration"):
            frame([(bad,)], "t string").select(clock.duration_minutes("t")).collect()


def test_instants_without_seconds(frame):
    df = frame([("2026-07-30T00:00Z",), ("2026-07-30T02:00:00+02:00",), ("2026-07-30 00:00",), ("x",)], "t string")
    got = [r[0] for r in df.select(clock.utc_text(clock.parse_instant("t"))).collect()]
    assert got == ["2026-07-30T00:00:00Z"] * 3 + [None]


def test_labels(frame):
    df = frame([("2026-07-15 12:00:00",), ("2026-01-15 12:00:00",)], "t string", ["t"])
    assert [r[0] for r in df.select(clock.gb_label("t")).collect()] == ["2026-07-15 13:00 BST", "2026-01-15 12:00 GMT"]


def test_regular_clock_guard(frame):
    good = [("a", f"2026-01-01 0{h}:{m}:00") for h in range(3) for m in ("00", "30")]
    df = frame(good, "k string, t string", ["t"])
    timeline.require_regular_clock(df, ["k"], "t")
    for broken in (good[:2] + good[3:], good + good[:1]):
        with pytest.raises(GuardError):
            timeline.require_regular_clock(frame(broken, "k string, t string", ["t"]), ["k"], "t")


def test_window_clock_counts(spark):
    assert timeline.window_clock(spark, "2026-03-28", "2026-03-30").count() == 48 + 46
    assert timeline.window_clock(spark, "2026-03-28", "2026-03-30", step_s=3600).count() == 24 + 23


def test_seam_days_guard(spark, frame):
    clock_df = timeline.window_clock(spark, "2026-01-01", "2026-01-03")
    seams = frame([("2026-01-01",)], "seam_date string")
    whole = clock_df.where("delivery_date = '2026-01-01'")
    assert [str(r[0]) for r in timeline.require_seam_days_only(timeline.seam_days(whole, seams)).collect()] == ["2026-01-01"]
    partial = whole.where("settlement_period > 1")
    outside = clock_df.where("delivery_date = '2026-01-02'")
    for bad in (partial, outside):
        with pytest.raises(GuardError):
            timeline.require_seam_days_only(timeline.seam_days(bad, seams))


def test_missing_dates(frame):
    df = frame([("m", "2026-01-01"), ("m", "2026-01-04"), ("n", "2026-01-02")], "k string, d string")
    got = timeline.missing_dates(df, ["k"], "d").orderBy("missing_date").collect()
    assert [(r.k, r.missing_date) for r in got] == [("m", dt.date(2026, 1, 2)), ("m", dt.date(2026, 1, 3))]


def test_missing_dates_are_unfolded_without_a_join(frame):
    df = frame([("m", "2026-01-01"), ("m", "2026-01-04"), ("m", "2026-01-04"), ("m", None), ("n", None), (None, "2026-01-01"), (None, "2026-01-03")], "k string, d string")
    found = timeline.missing_dates(df, ["k"], "d")
    got = sorted((r.k or "", r.missing_date.day) for r in found.collect())
    assert got == [("", 1), ("", 2), ("", 3), ("m", 2), ("m", 3)]
    # What is shuffled are the dates that are there: nothing is exchanged once they are unfolded.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("Window")
