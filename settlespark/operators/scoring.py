"""Forecast grading, daily metrics, fallback choice and the deployment gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from settlespark import constants as K
from settlespark.errors import need_columns
from settlespark.functions import clock, values
from settlespark.operators.point_in_time import last_by, timestamp_lags
from settlespark.operators.timeline import missing_dates, period_completeness


def actuals_with_persistence(actuals: DataFrame, lag_s: int = 86400) -> DataFrame:
    """Actuals per revision with the same revision's price exactly a day earlier."""
    one = last_by(actuals, ["actual_revision", "delivery_time_utc"], ["actual_price"])
    return timestamp_lags(one, ["actual_revision"], "delivery_time_utc", "actual_price", {"persistence_price": lag_s})


def grade(forecasts: DataFrame, actuals: DataFrame, graded_at: Column | None = None) -> DataFrame:
    """One score row per forecast and actual revision of its delivery period."""
    need_columns(forecasts, ["forecast_id", "model_version", "issue_time_utc", "delivery_time_utc", "p10", "p50", "p90"], "forecasts")
    need_columns(actuals, [*K.ACTUAL_KEY, "actual_price"], "actuals")
    # A revision that repeats a delivery keeps its rows; only the baseline is de-duplicated.
    baseline = actuals_with_persistence(actuals).select("delivery_time_utc", "actual_revision", "persistence_price")
    truth = actuals.select("delivery_time_utc", F.col("actual_revision").cast("string"), values.number("actual_price").alias("actual_price"))
    joined = forecasts.join(truth, "delivery_time_utc").join(baseline, ["delivery_time_utc", "actual_revision"], "left")
    return joined.select(*score_columns(forecasts.columns, graded_at))


def score_columns(forecast_columns: Sequence[str], graded_at: Column | None = None) -> list[Column]:
    """The columns of a score row, from a forecast beside its actual price and baseline."""
    error = F.col("p50") - F.col("actual_price")
    chance = F.col("negative_probability") if "negative_probability" in forecast_columns else F.lit(None).cast("double")
    covered = F.coalesce(F.col("actual_price").between(F.col("p10"), F.col("p90")), F.lit(False))
    return [
        F.col("forecast_id"), F.col("model_version").cast("string").alias("model_version"), F.col("issue_time_utc"),
        F.col("actual_revision"), F.col("delivery_time_utc"), F.col("actual_price"), F.col("p50").alias("forecast_p50"),
        error.alias("error"), F.abs(error).alias("absolute_error"), (error * error).alias("squared_error"),
        covered.alias("p10_p90_covered"),
        F.coalesce(F.col("actual_price") < 0, F.lit(False)).alias("actual_negative"),
        chance.alias("predicted_negative_probability"), F.col("persistence_price"),
        F.abs(F.col("persistence_price") - F.col("actual_price")).alias("persistence_absolute_error"),
        (graded_at if graded_at is not None else F.current_timestamp()).alias("graded_at_utc"),
    ]


def daily_grading(scores: DataFrame, comparable_only: bool = False) -> DataFrame:
    """Daily error metrics per model and revision.

    By default the model's error uses all rows and the baseline's its own non-null rows;
    ``comparable_only`` restricts both to rows that have both errors.
    """
    model, base = values.number("absolute_error"), values.number("persistence_absolute_error")
    both = model.isNotNull() & base.isNotNull()
    if comparable_only:
        model, base = F.when(both, model), F.when(both, base)
    covered = values.boolean("p10_p90_covered")
    daily = scores.groupBy("model_version", "actual_revision", clock.delivery_date("delivery_time_utc").alias("delivery_date")).agg(
        F.count(F.lit(1)).alias("graded_periods"),
        F.avg(model).alias("model_mae_gbp_mwh"),
        F.sqrt(F.avg(values.number("squared_error"))).alias("model_rmse_gbp_mwh"),
        F.avg(values.number("error")).alias("model_bias_gbp_mwh"),
        F.avg(base).alias("persistence_mae_gbp_mwh"),
        F.avg(covered.cast("double")).alias("p10_p90_coverage"),
        F.count_if(values.boolean("actual_negative")).alias("actual_negative_periods"),
    )
    return daily.withColumn("improvement_percent", values.improvement_percent("model_mae_gbp_mwh", "persistence_mae_gbp_mwh"))


def holdout_score(df: DataFrame, actual: str, prediction: str, baseline: str, keys: Sequence[str] = ()) -> DataFrame:
    """Model against the 24 h baseline over rows where all three values exist."""
    a, p, b = (values.number(c) for c in (actual, prediction, baseline))
    both = a.isNotNull() & p.isNotNull() & b.isNotNull()
    out = df.groupBy(*keys).agg(
        F.avg(F.when(both, F.abs(a - p))).alias("model_mae"),
        F.avg(F.when(both, F.abs(a - b))).alias("baseline_mae"),
        F.count_if(both).alias("comparison_rows"),
        F.count(F.lit(1)).alias("holdout_rows"),
        F.count_if(b.isNull()).alias("baseline_missing_rows"),
    )
    gain = values.improvement_percent("model_mae", "baseline_mae")
    return out.withColumn("improvement_percent", F.when(F.col("baseline_mae") == 0, F.lit(0.0)).otherwise(gain))


def deployment_gate(
    scores: DataFrame, models: DataFrame | None = None, revision: str | None = None, latest: Sequence[str] = (),
    min_days: int = K.GATE_MIN_DAYS, min_improvement: float = K.GATE_MIN_IMPROVEMENT,
    coverage: tuple[float, float] = K.GATE_COVERAGE, min_lead_hours: float = K.GATE_MIN_LEAD_HOURS,
) -> DataFrame:
    """Six pass/fail rules per model version, for all models in one job.

    Three aggregation levels (delivery, day, model) keep every shuffle key fine until the
    last. ``models`` lists versions to report even without scores. ``revision`` restricts
    the scores to one actual revision; ``latest``, revisions from the first to the last, keeps the
    last one that each forecast has been graded with. By default all revisions count.
    """
    need_columns(scores, ["model_version", "issue_time_utc", "delivery_time_utc", "absolute_error",
                          "persistence_absolute_error", "p10_p90_covered"], "scores")
    rows = scores if revision is None else scores.where(F.col("actual_revision") == revision)
    if latest:
        rows = last_revision(rows, latest)
    model, base = values.number("absolute_error"), values.number("persistence_absolute_error")
    both = model.isNotNull() & base.isNotNull()
    covered = values.boolean("p10_p90_covered")
    by_delivery = rows.groupBy("model_version", clock.instant("delivery_time_utc").alias("_t")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(both).alias("nc"), F.sum(F.when(both, model)).alias("sm"), F.sum(F.when(both, base)).alias("sb"),
        F.count(covered).alias("ncov"), F.count_if(covered).alias("cov"),
        F.max(clock.instant("issue_time_utc")).alias("latest_issue"),
    )
    # The smallest lead of a delivery belongs to its latest issue.
    by_day = by_delivery.groupBy("model_version", clock.delivery_date("_t").alias("delivery_date")).agg(
        F.count(F.lit(1)).alias("periods"), F.sum("n").alias("n"), F.sum("nc").alias("nc"),
        F.sum("sm").alias("sm"), F.sum("sb").alias("sb"), F.sum("ncov").alias("ncov"), F.sum("cov").alias("cov"),
        F.min(clock.lead_hours("latest_issue", "_t")).alias("lead"),
    ).withColumn("short", clock.periods_in_day("delivery_date") - F.col("periods"))
    per_model = by_day.groupBy("model_version").agg(
        F.sum("n").alias("graded_periods"), F.sum("nc").alias("comparable_persistence_periods"),
        F.count(F.lit(1)).alias("graded_delivery_days"),
        F.min("delivery_date").alias("first_delivery_date"), F.max("delivery_date").alias("last_delivery_date"),
        (F.sum("sm") / F.nullif(F.sum("nc"), F.lit(0))).alias("model_mae_gbp_mwh"),
        (F.sum("sb") / F.nullif(F.sum("nc"), F.lit(0))).alias("persistence_mae_gbp_mwh"),
        (F.sum("cov") / F.nullif(F.sum("ncov"), F.lit(0))).alias("p10_p90_coverage"),
        F.min("lead").alias("minimum_lead_hours"),
        F.count_if(F.col("short") != 0).alias("incomplete_days"),
        F.sum("short").alias("missing_periods"),
    )
    if models is not None:
        per_model = models.select("model_version").distinct().join(per_model, "model_version", "left").fillna(
            0, ["graded_periods", "comparable_persistence_periods", "graded_delivery_days"]
        )
    days = F.col("graded_delivery_days")
    gaps = F.date_diff("last_delivery_date", "first_delivery_date") + 1 - days
    enough = days >= min_days
    rules = {
        "minimum_shadow_days": enough,
        "consecutive_delivery_days": enough & (gaps == 0),
        "complete_periods": enough & (F.col("incomplete_days") == 0),
        "pre_delivery_issue_time": F.col("minimum_lead_hours") >= min_lead_hours,
        "beats_persistence": F.col("improvement_percent") >= min_improvement,
        "interval_coverage": F.col("p10_p90_coverage").between(*coverage),
    }
    gain = values.improvement_percent("model_mae_gbp_mwh", "persistence_mae_gbp_mwh")
    passed = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    out = per_model.withColumn("improvement_percent", gain).withColumn("missing_date_count", gaps).withColumns(passed)
    ready = F.lit(True)
    for k in passed:
        ready = ready & F.col(k)
    return out.withColumn("deployment_ready", ready).withColumn(
        "mode", F.when(ready, "eligible_for_controlled_operational_review").otherwise("shadow_only")
    )


def last_revision(scores: DataFrame, order: Sequence[str]) -> DataFrame:
    """Of the scores of each forecast that with the revision which comes last in ``order``; an unlisted revision is an error."""
    place = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("actual_revision"))
    unknown = F.raise_error(F.concat(F.lit("revision not among the listed: "), F.coalesce("actual_revision", F.lit("null")))).cast("bigint")
    ranked = scores.withColumn("_place", F.when(place > 0, place).otherwise(unknown))
    return last_by(ranked, ["model_version", "issue_time_utc", "delivery_time_utc"], ["_place"]).select(*scores.columns)


def gate_missing_dates(scores: DataFrame) -> DataFrame:
    """The dates behind a failed consecutive-days rule."""
    return missing_dates(scores.withColumn("delivery_date", clock.delivery_date("delivery_time_utc")), ["model_version"], "delivery_date")


def gate_missing_periods(scores: DataFrame) -> DataFrame:
    """``model_version, delivery_date, missing_periods``: the days behind a failed complete-periods rule."""
    short = period_completeness(scores, ["model_version"], "delivery_time_utc").where("missing_periods <> 0")
    return short.select("model_version", "delivery_date", "missing_periods")


def gate_evidence(gate: DataFrame, min_days: int = K.GATE_MIN_DAYS, min_improvement: float = K.GATE_MIN_IMPROVEMENT,
                  coverage: tuple[float, float] = K.GATE_COVERAGE, min_lead_hours: float = K.GATE_MIN_LEAD_HOURS) -> DataFrame:
    """``model_version, rule, required, observed, passed``: a row for each rule, with what it asked for and what it saw."""
    facts = {
        "minimum_shadow_days": (f"at least {min_days} days", F.col("graded_delivery_days").cast("string")),
        "consecutive_delivery_days": ("no missing date", F.concat(F.coalesce("missing_date_count", F.lit(0)).cast("string"), F.lit(" missing dates"))),
        "complete_periods": ("no incomplete day", F.concat(F.coalesce("incomplete_days", F.lit(0)).cast("string"), F.lit(" incomplete days, "), F.coalesce("missing_periods", F.lit(0)).cast("string"), F.lit(" missing periods"))),
        "pre_delivery_issue_time": (f"at least {min_lead_hours:g} h", F.round("minimum_lead_hours", 4).cast("string")),
        "beats_persistence": (f"at least {min_improvement:g} %", F.round("improvement_percent", 4).cast("string")),
        "interval_coverage": (f"{coverage[0]:g} to {coverage[1]:g}", F.round("p10_p90_coverage", 4).cast("string")),
    }
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(need).alias("required"), F.coalesce(seen, F.lit("none")).alias("observed"), F.col(r).alias("passed"))
                     for r, (need, seen) in facts.items()])
    return gate.select("model_version", F.explode(rows).alias("e")).select("model_version", "e.*")


def gate_report(gate: DataFrame, missing: DataFrame | None = None, periods: DataFrame | None = None, **thresholds) -> DataFrame:
    """One JSON report per model: metrics, rules with their evidence, missing dates and periods, verdict and warning.

    ``missing`` is the table of ``gate_missing_dates``, ``periods`` that of ``gate_missing_periods``;
    their dates, as many as the calendar of the scores has, are listed per model.
    """
    evidence = gate_evidence(gate, **thresholds)
    rules = evidence.groupBy("model_version").agg(F.array_sort(F.collect_list(F.struct("rule", "required", "observed", "passed"))).alias("gates"))
    names = {"minimum_shadow_days", "consecutive_delivery_days", "complete_periods", "pre_delivery_issue_time", "beats_persistence", "interval_coverage"}
    metrics = [c for c in gate.columns if c not in {*names, "deployment_ready", "mode", "model_version"}]
    joined = gate.join(rules, "model_version")
    dates, days = F.lit(None).cast("array<string>"), F.lit(None).cast("map<string,bigint>")
    if missing is not None:
        listed = missing.groupBy("model_version").agg(F.array_sort(F.collect_set(clock.date_text("missing_date"))).alias("_dates"))
        joined, dates = joined.join(listed, "model_version", "left"), F.col("_dates")
    if periods is not None:
        short = periods.groupBy("model_version").agg(F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(clock.date_text("delivery_date"), F.col("missing_periods").cast("bigint"))))).alias("_short"))
        joined, days = joined.join(short, "model_version", "left"), F.col("_short")
    warning = F.when(~F.col("deployment_ready"), "not ready for operational use; forecasts stay in shadow mode")
    body = F.to_json(F.struct(
        F.lit(K.GATE_REVISION).alias("workflow_revision"), "deployment_ready", "mode", warning.alias("warning"),
        F.struct("model_version", *metrics).alias("metrics"), "gates",
        F.coalesce(dates, F.array().cast("array<string>")).alias("missing_dates"),
        F.coalesce(days, F.create_map().cast("map<string,bigint>")).alias("missing_periods"),
    ), {"ignoreNullFields": "false"})
    return joined.select("model_version", body.alias("report"))


def fallback_choice(
    df: DataFrame, ts: str, targets: Sequence[str], holdout_from: Column, model_mae: dict[str, float],
    eligible=frozenset(K.FALLBACK_COMPONENTS), keys: Sequence[str] = (),
) -> DataFrame:
    """Source per component: seven-day persistence where it beats the model's holdout.

    ``df`` is the wide modelling table. Targets become rows, so all of them are compared in
    one pass.
    """
    keys = list(keys)
    long = df.select(*keys, ts, *[F.col(t).cast("double").alias(t) for t in targets]).unpivot([*keys, ts], list(targets), "target", "value")
    lagged = timestamp_lags(long, [*keys, "target"], ts, "value", {"fallback": K.FALLBACK_LAG_S})
    holdout = lagged.where(holdout_from)
    gap = F.abs(F.col("value") - F.col("fallback"))
    can = F.col("target").isin(sorted(eligible))
    per = holdout.groupBy(*keys, "target").agg(
        F.when(can, F.avg(gap)).alias("fallback_d7_holdout_mae"),
        F.when(can, F.count(gap)).otherwise(0).alias("fallback_comparison_rows"),
    )
    known = F.lit(None).cast("double")
    for t, m in model_mae.items():
        known = F.when(F.col("target") == t, F.lit(m).cast("double")).otherwise(known)
    fallback = F.col("fallback_d7_holdout_mae")
    better = F.coalesce((fallback < F.col("model_holdout_mae")) | (fallback.isNotNull() & F.col("model_holdout_mae").isNull()), F.lit(False))
    return per.withColumn("model_holdout_mae", known).withColumn(
        "source", F.when(better, "fallback_d7").otherwise("model")
    ).withColumn("selected_holdout_mae", F.when(better, fallback).otherwise(F.col("model_holdout_mae")))


def archive_status(forecasts: DataFrame) -> DataFrame:
    """Per model and local day: periods stored, on the clock, and a single issue time."""
    t = clock.instant("delivery_time_utc")
    per_period = forecasts.groupBy("model_version", t.alias("_t")).agg(
        F.min(clock.instant("issue_time_utc")).alias("_a"), F.max(clock.instant("issue_time_utc")).alias("_z")
    )
    on_clock = F.pmod(F.unix_micros("_t"), F.lit(1_800_000_000)) == 0
    daily = per_period.groupBy("model_version", clock.delivery_date("_t").alias("delivery_date")).agg(
        F.count(F.lit(1)).alias("period_count"), F.count_if(on_clock).alias("_on"),
        F.min("_a").alias("_a"), F.max("_z").alias("_z"),
    )
    expected = clock.periods_in_day("delivery_date").cast("long")
    return daily.select(
        "model_version", "delivery_date", "period_count",
        (expected - F.col("_on")).alias("missing_periods"), (F.col("period_count") - F.col("_on")).alias("extra_periods"),
        (F.col("_a") == F.col("_z")).alias("single_issue_time"),
        ((F.col("_on") == expected) & (F.col("period_count") == F.col("_on")) & (F.col("_a") == F.col("_z"))).alias("complete"),
    )
