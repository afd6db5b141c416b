"""Structured Streaming counterparts of the batch operators.

Batch grading stays the truth: rows later than the watermark are dropped here and picked
up by the next batch run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from settlespark.functions import clock
from settlespark.plans.logs import LogTable, grade_store
from settlespark.session import durable


def file_stream(spark: SparkSession, directory: str, schema, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a directory as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(directory)


def half_hourly_means(stream: DataFrame, ts: str, keys: Sequence[str], value: str, delay: str = "1 hour") -> DataFrame:
    """Tumbling half-hour means. A window is final once the watermark has passed it."""
    late = stream.withWatermark(ts, delay)
    return late.groupBy(*keys, F.window(ts, "30 minutes").alias("_w")).agg(
        F.avg(value).alias(value), F.count(F.lit(1)).alias("n")
    ).select(*keys, F.col("_w.start").alias(ts), value, "n")


def latest_revisions(stream: DataFrame, keys: Sequence[str], delivery: str, published: str, tie: Sequence[str] = (), horizon: str = "2 days") -> DataFrame:
    """Latest publication per delivery as it arrives, for update mode.

    The watermark on the delivery time bounds the state to the open deliveries.
    """
    rest = [c for c in stream.columns if c not in {*keys, delivery}]
    rank = F.struct(F.col(published), *[F.col(t) for t in tie])
    top = stream.withWatermark(delivery, horizon).groupBy(delivery, *keys).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
    return top.select(delivery, *keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def scores(forecasts: DataFrame, actuals: DataFrame, delay: str = "2 days") -> DataFrame:
    """Forecast errors as actuals arrive: a stream-stream join on the delivery time.

    Both sides are watermarked, so state is dropped once a delivery can no longer match.
    """
    f = forecasts.withColumnRenamed("delivery_time_utc", "_f").withWatermark("_f", delay)
    a = actuals.withColumnRenamed("delivery_time_utc", "_a").withWatermark("_a", delay)
    joined = f.join(a, F.col("_f") == F.col("_a"))
    error = F.col("p50") - F.col("actual_price")
    return joined.select(
        "forecast_id", "model_version", "actual_revision", F.col("_a").alias("delivery_time_utc"), "actual_price",
        error.alias("error"), F.abs(error).alias("absolute_error"),
        F.col("actual_price").between(F.col("p10"), F.col("p90")).alias("p10_p90_covered"),
    )


def run_batches(stream: DataFrame, work: Callable[[DataFrame], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available in micro-batches. ``work`` must tolerate a replay."""
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: work(batch)).trigger(availableNow=True).start()
    )


def write_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Final rows to Parquet, exactly once."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingest_actuals(stream: DataFrame, log: LogTable, checkpoint: str, order: Sequence[str] = ()) -> StreamingQuery:
    """Actual prices into their log; known keys are skipped.

    A key repeated in a micro-batch is stored once, its last row under ``order``, which is not
    stored; the log's key check makes replays harmless.
    """
    def work(batch: DataFrame) -> None:
        log.append_new(batch, order, drop=order)
    return run_batches(stream, work, checkpoint)


def grade_on_arrival(stream: DataFrame, forecasts: LogTable, actuals: LogTable, score_log: LogTable, checkpoint: str) -> StreamingQuery:
    """Append each batch of actuals and grade the dates it touches; only changed scores are rewritten.

    The span comes from the batch, not from what was new in it, so a replay grades again.
    """
    def work(batch: DataFrame) -> None:
        batch = durable(batch)
        actuals.append_new(batch)
        day = clock.delivery_date("delivery_time_utc")
        span = batch.agg(F.min(day), F.max(day)).first()
        if span[0] is not None:
            grade_store(forecasts, actuals, score_log, span)
    return run_batches(stream, work, checkpoint)
