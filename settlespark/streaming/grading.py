"""Grading as a stateful stream: forecasts and actual prices meet in the state of their delivery period.

The logs are not read again. A period's state holds its forecasts, its prices by revision and the
prices a day earlier; it is cleared by a timer once the watermark has passed the period by the horizon.
Whatever arrives first waits for the rest, so the order of arrival and replays do not matter.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from settlespark.functions import clock
from settlespark.operators import scoring
from settlespark.plans.logs import LogTable
from settlespark.streaming.jobs import run_batches

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FORECAST = "model_version string, issue_time_utc timestamp, p10 double, p50 double, p90 double, negative_probability double"
_OUT = f"forecast_id string, {_FORECAST}, actual_revision string, delivery_time_utc timestamp, actual_price double, persistence_price double"
_SCORE = Row(*[c.split()[0] for c in _OUT.split(", ")])


def events(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Both streams as one, by the delivery period they concern: a price also concerns the period a day later."""
    f = forecasts if "negative_probability" in forecasts.columns else forecasts.withColumn("negative_probability", F.lit(None).cast("double"))
    body = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in _FORECAST.split(", ")]
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _FORECAST.split(", ")]
    ahead = f.select(F.col("delivery_time_utc").alias("slot"), F.lit("forecast").alias("kind"), F.col("forecast_id").cast("string").alias("name"), *body, F.lit(None).cast("double").alias("price"))
    own = F.struct(F.col("delivery_time_utc").alias("slot"), F.lit("price").alias("kind"))
    next_day = F.struct(clock.add_seconds("delivery_time_utc", 86400).alias("slot"), F.lit("baseline").alias("kind"))
    seen = actuals.select(F.explode(F.array(own, next_day)).alias("e"), F.col("actual_revision").cast("string").alias("name"), F.col("actual_price").cast("double").alias("price"))
    return ahead.unionByName(seen.select("e.slot", "e.kind", "name", *none, "price"))


class Grader(StatefulProcessor):
    """Scores of one delivery period. What is stored first stays; only pairs that an event touches are given again."""

    def __init__(self, horizon_s: int):
        self.horizon = timedelta(seconds=horizon_s)

    def init(self, handle) -> None:
        self.handle = handle
        self.forecasts = handle.getMapState("forecasts", "name string", _FORECAST)
        self.prices = handle.getMapState("prices", "name string", "price double")
        self.baselines = handle.getMapState("baselines", "name string", "price double")

    def handleInputRows(self, key, rows, timers):
        fresh_forecasts, fresh_revisions = set(), set()
        for r in rows:
            if r.kind == "forecast":
                if not self.forecasts.containsKey((r.name,)):
                    self.forecasts.updateValue((r.name,), (r.model_version, r.issue_time_utc, r.p10, r.p50, r.p90, r.negative_probability))
                    fresh_forecasts.add(r.name)
            else:
                store = self.prices if r.kind == "price" else self.baselines
                if not store.containsKey((r.name,)):
                    store.updateValue((r.name,), (r.price,))
                    fresh_revisions.add(r.name)
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(int((key[0] + self.horizon).timestamp() * 1000))
        revisions = {k[0]: v[0] for k, v in self.prices.iterator()}
        for name, body in self.forecasts.iterator() if revisions else ():
            for revision, price in revisions.items():
                if name[0] in fresh_forecasts or revision in fresh_revisions:
                    base = self.baselines.getValue((revision,)) if self.baselines.containsKey((revision,)) else (None,)
                    yield _SCORE(name[0], *body, revision, key[0], price, base[0])

    def handleExpiredTimer(self, key, timers, expired):
        for state in (self.forecasts, self.prices, self.baselines):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def scores(forecasts: DataFrame, actuals: DataFrame, horizon_s: int = 10 * 86400) -> DataFrame:
    """Score rows as forecasts and prices arrive, for update mode; a row is given again when its baseline comes later.

    Events later than the watermark, which lags by ``horizon_s``, are dropped: batch grading of the
    logs stays the truth for them. The query must start with ``PROVIDER`` as the state store's provider.
    """
    late = events(forecasts, actuals).withWatermark("slot", f"{horizon_s} seconds")
    found = late.groupBy("slot").transformWithState(Grader(horizon_s), _OUT, "Update", "EventTime")
    return found.select(*scoring.score_columns(found.columns))


def grade_statefully(forecasts: DataFrame, actuals: DataFrame, score_log: LogTable, checkpoint: str, horizon_s: int = 10 * 86400) -> StreamingQuery:
    """Keep a score log up to date from two streams; neither log is scanned again."""
    conf, name = forecasts.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, PROVIDER)  # a query keeps the settings it starts with
    try:
        return run_batches(scores(forecasts, actuals, horizon_s), lambda batch: score_log.upsert(batch) and None, checkpoint, mode="update")
    finally:
        conf.set(name, before)
