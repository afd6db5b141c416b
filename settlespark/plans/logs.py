"""Log tables on plain Parquet: immutable appends, skip-known appends and upserts.

A log is partitioned by local delivery date and written in versions (``commits``): guards look at
one version, and the write takes effect only if no other has come between. Then guards and write
are repeated once on the new version. Guards read only the stored dates between the first and last
of the batch, and upserts replace only the dates they touch.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from settlespark import constants as K
from settlespark.errors import GuardError, need_columns
from settlespark.functions import clock, values
from settlespark.operators import scoring
from settlespark.operators.point_in_time import last_by
from settlespark.operators.relations import duplicate_keys, require_unique
from settlespark.operators.timeline import clock_difference, period_completeness, settlement_spine
from settlespark.plans.commits import DAY, Version, Versions
from settlespark.session import durable


class LogTable:
    """A keyed log. ``day`` gives each row's partition date from its own columns. Later writes may add columns."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], day: Column | None = None):
        self.spark, self.path, self.key = spark, path, list(key)
        self.day = day if day is not None else clock.delivery_date("delivery_time_utc")
        self.versions = Versions(spark, path)

    def stored(self) -> DataFrame | None:
        """All rows of the last version, or None before the first. Later writes don't change what it reads."""
        return self.stored_between(None, None)

    def stored_between(self, first, last) -> DataFrame | None:
        """Stored rows of the dates from ``first`` to ``last``; files of other dates are not listed."""
        version = self.versions.latest()
        return self.versions.read(version, first, last) if version.number else None

    def read(self) -> DataFrame:
        rows = self.stored()
        if rows is None:
            raise GuardError(f"log {self.path} is empty")
        return rows.drop(DAY)

    def _prior(self, version: Version, batch: DataFrame) -> DataFrame | None:
        """Rows of a version on the dates that the batch spans."""
        if not version.number:
            return None
        span = batch.agg(F.min(DAY).alias("a"), F.max(DAY).alias("z")).first()
        return self.versions.read(version, span.a, span.z)

    def _landed(self, rows: DataFrame) -> DataFrame:
        need_columns(rows, self.key, "log rows")
        times = {c: clock.instant(c) for c in rows.columns if c.endswith("_utc")}
        return durable(rows.withColumns(times).withColumn(DAY, self.day))

    def _landed_once(self, rows: DataFrame) -> DataFrame:
        """Landed rows; a key that repeats in the batch is an error."""
        batch = self._landed(rows)
        clash = duplicate_keys(batch, self.key).first()
        if clash is not None:
            raise GuardError(f"the batch repeats key {clash.asDict()}")
        return batch

    def _committed(self, work: Callable[[Version], tuple[DataFrame, DataFrame | None]], replace: bool) -> DataFrame:
        """Run ``work`` on the last version and store the rows it gives; once more if another write came first.

        ``work`` returns its result and the rows to store, or None for nothing. It raises what its
        guards find, before anything is visible.
        """
        for _ in range(2):
            version = self.versions.latest()
            result, rows = work(version)
            if rows is None:
                return result
            # Few files per date; a large date is still split over tasks by size.
            commit = self.versions.stage(rows.hint("rebalance", F.col(DAY)))
            known = version.schema.names if version.schema else []
            schema = T.StructType([*(version.schema or ()), *[f for f in rows.schema if f.name not in known]])
            if self.versions.publish(version, schema, commit, replace):
                return result
            self.versions.discard(commit)
        raise GuardError(f"log {self.path} is being written by others")

    @property
    def _join_key(self) -> list[str]:
        # The partition date follows from the key; the span of dates has pruned the partitions.
        return [*self.key, DAY]

    def append_unique(self, rows: DataFrame) -> DataFrame:
        """Append rows; any key already stored, or repeated in the batch, is an error."""
        batch = self._landed(rows)

        def work(version):
            old = self._prior(version, batch)
            repeated = duplicate_keys(batch, self.key).select(*self.key)
            if old is not None:
                repeated = repeated.unionByName(batch.join(old.select(*self._join_key), self._join_key, "left_semi").select(*self.key))
            clash = repeated.first()
            if clash is not None:
                raise GuardError(f"refusing to overwrite immutable row {clash.asDict()}")
            return batch.drop(DAY), batch

        return self._committed(work, replace=False)

    def append_new(self, rows: DataFrame, order: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
        """Append rows with unseen keys; known keys are skipped.

        A key repeated in the batch is stored once, its last row under ``order``. Columns to
        ``drop`` are not stored.
        """
        batch = self._landed(rows)
        rest = [c for c in rows.columns if c not in self.key]
        last = last_by(batch, self.key, list(order) or rest or self.key)

        def work(version):
            old = self._prior(version, batch)
            fresh = last if old is None else last.join(old.select(*self._join_key), self._join_key, "left_anti")
            fresh = durable(fresh.drop(*drop))
            return fresh.drop(DAY), None if version.number and fresh.isEmpty() else fresh

        return self._committed(work, replace=False)

    def _changed(self, batch: DataFrame, old: DataFrame, ignore: Sequence[str]) -> DataFrame:
        compared = [(c, t) for c, t in batch.dtypes if c not in {*self._join_key, *ignore}]
        shared = [c for c, _ in compared if c in old.columns]
        known = old.select(*self._join_key, F.lit(True).alias("_known"), *[F.col(c).alias(f"_old_{c}") for c in shared])
        differs = F.col("_known").isNull()
        for c, t in compared:
            differs = differs | (~values.same_value(f"_old_{c}", c, t) if c in shared else F.lit(True))
        joined = batch.join(known, self._join_key, "left")
        return joined.where(differs).select(*batch.columns, "_known")

    def _over(self, rows: DataFrame, old: DataFrame | None) -> DataFrame:
        """``rows`` and the stored rows of other keys, on the dates of ``rows``: what these dates hold from now on."""
        if old is None:
            return rows
        days = rows.select(DAY).distinct()
        kept = old.join(days, DAY, "left_semi").join(rows.select(*self._join_key), self._join_key, "left_anti")
        return kept.unionByName(rows, allowMissingColumns=True)

    def upsert(self, rows: DataFrame, ignore: Sequence[str] = ("graded_at_utc",)) -> DataFrame:
        """Store new and materially changed rows and return them.

        Doubles are compared with a tolerance; ``ignore`` columns do not count as a change.
        """
        return self._merged(rows, ignore, lambda changed: None)

    def keep_history(self, rows: DataFrame, replace: bool = False) -> DataFrame:
        """Add history rows: an equal row is a no-op, a differing one an error or a replacement."""
        def refuse(changed):
            clash = None if replace else changed.where("_known").select(*self.key).first()
            if clash is not None:
                raise GuardError(f"conflicting immutable history row {clash.asDict()}")
        return self._merged(rows, (), refuse)

    def _merged(self, rows: DataFrame, ignore: Sequence[str], guard: Callable[[DataFrame], None]) -> DataFrame:
        batch = self._landed_once(rows)

        def work(version):
            old = self._prior(version, batch)
            if old is None:
                return batch.drop(DAY), batch
            changed = durable(self._changed(batch, old, ignore))
            guard(changed)
            changed = changed.drop("_known")
            return changed.drop(DAY), None if changed.isEmpty() else self._over(changed, old)

        return self._committed(work, replace=True)

    def merge_columns(self, rows: DataFrame) -> DataFrame:
        """Column-wise merge: a given value wins, an absent one leaves the stored value."""
        batch = self._landed_once(rows)
        extra = [c for c in batch.columns if c not in self._join_key]

        def work(version):
            old = self._prior(version, batch)
            if old is None:
                return batch.drop(DAY), batch
            stored = [c for c in old.columns if c not in self._join_key]
            prior = old.select(*self._join_key, *[F.col(c).alias(f"_old_{c}") for c in stored])
            cells = [F.coalesce(c, f"_old_{c}").alias(c) if c in stored else F.col(c) for c in extra]
            cells += [F.col(f"_old_{c}").alias(c) for c in stored if c not in extra]
            whole = durable(batch.join(prior, self._join_key, "left").select(*self._join_key, *cells))
            return whole.drop(DAY), self._over(whole, old)

        return self._committed(work, replace=True)


def forecast_log(spark, path) -> LogTable:
    return LogTable(spark, path, K.FORECAST_KEY)


def actual_log(spark, path) -> LogTable:
    return LogTable(spark, path, K.ACTUAL_KEY)


def score_log(spark, path) -> LogTable:
    return LogTable(spark, path, K.SCORE_KEY)


def append_forecasts(log: LogTable, rows: DataFrame) -> DataFrame:
    """Append one model's forecast of one local day, refusing a day already stored."""
    day = clock.delivery_date("delivery_time_utc")
    facts = rows.agg(
        F.min("model_version").alias("m0"), F.max("model_version").alias("m1"), F.min(day).alias("d0"), F.max(day).alias("d1")
    ).first()
    if facts.m0 != facts.m1 or facts.d0 != facts.d1:
        raise GuardError("a forecast append holds one model version and one delivery day")
    old = log.stored_between(facts.d0, facts.d0)
    if old is not None and not old.where(F.col("model_version") == facts.m0).isEmpty():
        raise GuardError(f"a forecast of {facts.m0} for {facts.d0} is already stored")
    return append_forecast_batch(log, rows)


def append_forecast_batch(log: LogTable, rows: DataFrame) -> DataFrame:
    """Append forecasts of many models and days at once under the same immutable key."""
    return log.append_unique(rows if "forecast_id" in rows.columns else rows.withColumn("forecast_id", values.forecast_id()))


def stored_day_status(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per model and day of ``wanted``: absent, exact or misaligned in the store."""
    on = ["model_version", "delivery_date", "delivery_time_utc"]
    dated = lambda d: d.select("model_version", clock.delivery_date("delivery_time_utc").alias("delivery_date"), "delivery_time_utc").distinct()
    ask, have = dated(wanted), dated(stored)
    days = ask.select("model_version", "delivery_date").distinct()
    have = have.join(days, ["model_version", "delivery_date"], "left_semi")
    faults = clock_difference(ask, have, on).groupBy("model_version", "delivery_date").agg(F.count(F.lit(1)).alias("_faults"))
    seen = have.groupBy("model_version", "delivery_date").agg(F.count(F.lit(1)).alias("stored_periods"))
    out = days.join(seen, ["model_version", "delivery_date"], "left").join(faults, ["model_version", "delivery_date"], "left")
    status = F.when(F.col("stored_periods").isNull(), "absent").when(F.col("_faults").isNull(), "exact").otherwise("misaligned")
    return out.withColumn("status", status).withColumn("stored_periods", F.coalesce("stored_periods", F.lit(0))).drop("_faults")


def _stored_beside(log: LogTable, rows: DataFrame) -> DataFrame | None:
    """Stored rows of the delivery dates that ``rows`` span; one day is looked up in a long store without reading the rest."""
    day = clock.delivery_date("delivery_time_utc")
    span = rows.agg(F.min(day), F.max(day)).first()
    return log.stored_between(*span)


def log_forecast_day(log: LogTable, rows: DataFrame, reuse: bool = False) -> str:
    """Append a forecast day, or keep an exact stored one when ``reuse`` is set."""
    late = rows.where(clock.instant("delivery_time_utc") <= clock.instant("issue_time_utc"))
    if not late.isEmpty():
        raise GuardError("delivery periods must lie after the issue time")
    old = _stored_beside(log, rows) if reuse else None
    if old is not None:
        found = stored_day_status(old, rows).limit(2).collect()
        if len(found) != 1:
            raise GuardError("a repair run holds exactly one delivery day")
        if found[0].status == "misaligned":
            raise GuardError("the stored forecast does not cover the same periods")
        if found[0].status == "exact":
            return "reused_existing_immutable_day"
    append_forecasts(log, rows)
    return "appended_new_immutable_day"


def log_forecast_days(log: LogTable, rows: DataFrame, reuse: bool = False) -> DataFrame:
    """``log_forecast_day`` for all models and days of ``rows`` at once: ``(model_version, delivery_date, status, action)``.

    All is checked before anything is written; days that are stored are refused, or with
    ``reuse`` kept if they hold the same periods.
    """
    late = rows.where(clock.instant("delivery_time_utc") <= clock.instant("issue_time_utc"))
    if not late.isEmpty():
        raise GuardError("delivery periods must lie after the issue time")
    on, day = ["model_version", "delivery_date"], clock.delivery_date("delivery_time_utc")
    old = _stored_beside(log, rows)
    if old is None:
        found = rows.select("model_version", day.alias("delivery_date")).distinct().withColumn("status", F.lit("absent"))
    else:
        found = stored_day_status(old, rows).select(*on, "status")
    found = durable(found)
    bad = found.where(F.col("status") == "misaligned" if reuse else F.col("status") != "absent").first()
    if bad is not None:
        what = "stored with other periods" if reuse else "already stored"
        raise GuardError(f"a forecast of {bad.model_version} for {bad.delivery_date} is {what}")
    absent = found.where("status = 'absent'")
    if not absent.isEmpty():
        fresh = rows.withColumn("delivery_date", day).join(absent.select(*on), on, "left_semi")
        append_forecast_batch(log, fresh.select(*rows.columns))
    action = F.when(F.col("status") == "absent", "appended_new_immutable_day").otherwise("reused_existing_immutable_day")
    return found.withColumn("action", action)


def append_actuals(log: LogTable, prices: DataFrame, first: str, end: str, revision: str) -> DataFrame:
    """Append a window of actual prices of one revision; every period must be present."""
    a, z = clock.day_start(F.lit(first)), clock.day_start(F.lit(end))
    t = clock.instant("timestamp")
    inside = prices.where((t >= a) & (t < z)).select(
        t.alias("delivery_time_utc"), F.col("price_gbp_mwh").alias("actual_price"), F.lit(revision).alias("actual_revision")
    )
    days = prices.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))).alias("delivery_date"))
    spine = settlement_spine(days).select(F.col("timestamp").alias("delivery_time_utc"))
    if not clock_difference(spine, inside, ["delivery_time_utc"]).isEmpty() or not duplicate_keys(inside, ["delivery_time_utc"]).isEmpty():
        raise GuardError(f"actual prices do not cover [{first}, {end}) exactly once")
    return log.append_new(inside)


def complete_days(prices: DataFrame, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Rows of complete local days only, with the day."""
    whole = period_completeness(prices, keys, ts).where("missing_periods = 0 and row_count = expected_periods")
    dated = prices.withColumn("delivery_date", clock.delivery_date(ts))
    return dated.join(whole.select(*keys, "delivery_date"), [*keys, "delivery_date"], "left_semi")


def grade_store(forecasts: LogTable, actuals: LogTable, scores: LogTable, span: tuple | None = None) -> DataFrame:
    """Grade stored forecasts; only new or changed score rows are written.

    ``span``, the first and last date of new rows, grades those dates and the day after, whose
    baseline they are; without it all history is graded.
    """
    if span is None:
        f, a = forecasts.stored(), actuals.stored()
    else:
        first, last = (datetime.date.fromisoformat(str(d)) for d in span)
        day = datetime.timedelta(days=1)
        f, a = forecasts.stored_between(first, last + day), actuals.stored_between(first - day, last + day)
    if f is None or a is None:
        raise GuardError("forecasts and actuals must be stored before grading")
    return scores.upsert(scoring.grade(f.drop(DAY), a.drop(DAY)))


# --- review tables ----------------------------------------------------------------------

def forecast_history(reports: DataFrame) -> DataFrame:
    """History rows of forecast runs from their daily reports."""
    need_columns(reports, [*K.FORECAST_HISTORY_KEY, "period_count", "expected_period_count", "scenario_var",
                           "expected_shortfall", "worst_loss", "best_profit"], "daily reports")
    short = F.col("period_count") != F.col("expected_period_count")
    if not reports.where(short).isEmpty():
        raise GuardError("a daily report does not cover its settlement day")
    renamed = {
        "scenario_var": "scenario_var_gbp", "expected_shortfall": "expected_shortfall_gbp", "worst_loss": "worst_loss_gbp",
        "best_profit": "best_profit_gbp", "p50_daily_min_gbp_mwh": "p50_min_gbp_mwh", "p50_daily_mean_gbp_mwh": "p50_mean_gbp_mwh",
        "p50_daily_max_gbp_mwh": "p50_max_gbp_mwh",
    }
    return reports.drop("expected_period_count").withColumnsRenamed(renamed)


def history_log(spark, path, key) -> LogTable:
    return LogTable(spark, path, key, day=F.col("delivery_date").cast("date"))


def register_forecasts(history: LogTable, summary: LogTable, reports: DataFrame) -> DataFrame:
    """Add forecast runs to the immutable history and to the daily summary."""
    rows = forecast_history(reports)
    added = history.keep_history(rows)
    summary.merge_columns(rows)
    return added


def register_gradings(history: LogTable, summary: LogTable, scores: DataFrame, actuals: DataFrame, gate: DataFrame) -> DataFrame:
    """Daily metrics with the gate's verdict into the grading history and the summary.

    A date whose actuals exist but whose forecasts do not still gets a row of zero periods.
    The history keeps a row for each model and revision. The summary, keyed by date, gets one:
    of the model with most graded periods, the last revision by name, then the last model.
    """
    day = clock.delivery_date("delivery_time_utc").alias("delivery_date")
    counted = actuals.groupBy("actual_revision", day).agg(F.count(F.lit(1)).alias("actual_periods"))
    models = gate.select(
        "model_version", "deployment_ready", F.col("mode").alias("deployment_mode"),
        F.col("graded_delivery_days").alias("graded_delivery_days_total"), F.col("improvement_percent").alias("deployment_improvement_percent"),
        F.col("model_mae_gbp_mwh").alias("deployment_model_mae_gbp_mwh"), F.col("persistence_mae_gbp_mwh").alias("deployment_persistence_mae_gbp_mwh"),
        F.col("p10_p90_coverage").alias("deployment_p10_p90_coverage"),
    )
    # One row per model, date and revision; both sides are short: dates, and versions of one forecaster.
    asked = counted.withColumn("_on", F.lit(1)).join(models.select("model_version", F.lit(1).alias("_on")), "_on").drop("_on")
    daily = scoring.daily_grading(scores)
    rows = asked.join(daily, ["model_version", "actual_revision", "delivery_date"], "left").join(models, "model_version").fillna(0, ["graded_periods"])
    rows = durable(rows)
    changed = history.keep_history(rows, replace=True)
    summary.merge_columns(last_by(rows, ["delivery_date"], ["graded_periods", "actual_revision", "model_version"]))
    return changed


def history_index(summary: DataFrame, archived: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per date with a report or a summary, latest first: grading state and figures.

    Of several summary rows for a date the last under ``order`` counts; without an order a
    repeated date is an error.
    """
    last = last_by(summary, ["delivery_date"], list(order)) if order else require_unique(summary, ["delivery_date"], "summary")
    dates = archived.select("delivery_date").union(last.select("delivery_date")).distinct()
    joined = dates.join(archived.select("delivery_date", F.lit(True).alias("has_report")).distinct(), "delivery_date", "left").join(last, "delivery_date", "left")
    graded = F.coalesce(F.col("graded_periods").cast("long"), F.lit(0))
    return joined.select(
        "delivery_date", F.coalesce("has_report", F.lit(False)).alias("has_report"),
        F.when(graded > 0, F.concat(F.lit("Graded ("), graded.cast("string"), F.lit(" periods)"))).otherwise("Pending").alias("grading"),
        values.figure("model_mae_gbp_mwh").alias("model_mae"), values.figure("persistence_mae_gbp_mwh").alias("persistence_mae"),
        values.figure("improvement_percent", suffix="%").alias("improvement"), values.figure("p10_p90_coverage", 3).alias("coverage"),
    ).orderBy(F.desc("delivery_date"))
