"""Table readers and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from settlespark.errors import GuardError, need_columns
from settlespark.functions import clock


def _suffix(path: str) -> str:
    name = path.rstrip("/").lower()
    return "csv" if name.endswith((".csv", ".csv.gz")) else "json" if name.endswith((".json", ".jsonl")) else "parquet"


def read_table(spark: SparkSession, path: str | list[str], schema=None) -> DataFrame:
    """Parquet, CSV with a header, or JSON lines, chosen by suffix.

    Many paths are one scan. CSV without a schema stays text: no pass over the data to
    guess types.
    """
    paths = [path] if isinstance(path, str) else list(path)
    kind = _suffix(paths[0])
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).csv(paths)
    return reader.json(paths) if kind == "json" else reader.parquet(*paths)


def read_instants(spark: SparkSession, path: str) -> DataFrame:
    """Parquet whose zoneless times are UTC instants.

    They are read as instants and not cast afterwards, so that time filters reach the file.
    """
    found = spark.read.parquet(path).schema
    fields = [
        T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable)
        for f in found.fields
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_if_present(spark: SparkSession, path: str, schema=None, merge: bool = False) -> DataFrame | None:
    """The Parquet table, or None when the path does not exist yet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.option("mergeSchema", merge).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=(), refuse_empty: bool = True) -> str:
    """Write Parquet, CSV or JSON by suffix; an empty table is refused before writing."""
    if refuse_empty and df.isEmpty():
        raise GuardError(f"refusing to write an empty table to {path}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    kind = _suffix(path)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)
    return path


def write_checked(df: DataFrame, path: str, counts: Sequence[Column], judge: Callable[[dict], None], keep: Column | None = None, drop: Sequence[str] = ()) -> dict:
    """Write the rows of ``df`` that ``keep`` once, and give the table its place when ``judge`` has passed the counts.

    ``counts`` are aggregates over all rows, taken while these are written; they are returned. A judge
    that raises leaves the table that was there.
    """
    spark, seen, draft = df.sparkSession, Observation(f"counts of {path}"), f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    rows = df.observe(seen, *counts)
    (rows if keep is None else rows.where(keep)).drop(*drop).write.parquet(draft)
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, made = hadoop.Path(path), hadoop.Path(draft)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        judge(seen.get)
        fs.delete(place, True)
        fs.mkdirs(place.getParent())
        fs.rename(made, place)
    finally:
        fs.delete(made, True)
    return seen.get


def land_payloads(df: DataFrame, path: str, source: str = "source", day: str = "landed_date") -> str:
    """Raw payloads as JSON lines, laid out by source and date for later pruning."""
    need_columns(df, [source, day, "payload"], "payloads")
    df.write.mode("append").partitionBy(source, day).json(path)
    return path


def read_landed(spark: SparkSession, path: str, source: str | None = None, first=None, end=None) -> DataFrame:
    """Landed payloads; source and date bounds prune directories before any file is read."""
    df = spark.read.schema("payload string, source string, landed_date date").json(path)
    if source is not None:
        df = df.where(F.col("source") == source)
    if first is not None:
        df = df.where(F.col("landed_date") >= F.lit(first).cast("date"))
    if end is not None:
        df = df.where(F.col("landed_date") < F.lit(end).cast("date"))
    return df


def keyed_by_instant(df: DataFrame, ts: str = "timestamp", strict: bool = True) -> DataFrame:
    """The table with a UTC instant key.

    ``strict`` makes an unreadable time an error; otherwise such rows are dropped.
    """
    need_columns(df, [ts], "table")
    t = clock.parse_instant(ts) if dict(df.dtypes)[ts] == "string" else clock.instant(ts)
    if strict:
        t = F.coalesce(t, F.raise_error(F.lit(f"invalid time in {ts}")).cast("timestamp"))
        return df.withColumn(ts, t)
    return df.withColumn(ts, t).where(F.col(ts).isNotNull())
