"""Query registry and the stand-in views that map the test tables to market data.

The shared test tables hold no power data. Two views stand in for it, the same in both
engines: ``hh``, a half-hourly signed price per event type, and ``components``, one wide
row of system components per half-hour. Both read the whole events table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from settlespark.functions import clock
from settlespark.session import utc_session
from settlespark.sources.tables import read_instants

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The test tables of one scale, with instants in UTC."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = utc_session(spark), sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return read_instants(self.spark, f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def hh(self) -> DataFrame:
        return self.events.groupBy(F.col("event_type").alias("series"), clock.half_hour("ts").alias("ts")).agg(
            F.round(F.avg("value") - 50, 9).alias("price"), F.count(F.lit(1)).alias("n")
        )

    @cached_property
    def components(self) -> DataFrame:
        def total(kind):
            return F.round(F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)), 6)
        return self.events.groupBy(clock.half_hour("ts").alias("timestamp")).agg(
            F.round(F.sum("value") * 10, 6).alias("demand_mw"),
            total("click").alias("embedded_wind_mw"), total("view").alias("embedded_solar_mw"),
            total("purchase").alias("transmission_wind_mw"), total("signup").alias("nuclear_mw"),
            (total("error") - 20).alias("net_import_mw"),
            (F.count(F.lit(1)) - 5).cast("double").alias("battery_net_mw"),
            F.round(F.avg("value") * 3, 6).alias("inertia_gvas"),
        )


def query(name: str, sql: str | None = None, dates=(), ints=()):
    """Register a query and its SQL twin.

    ``dates`` and ``ints`` name result columns that the SQL side casts to the same text or
    long type that ``out`` gives them.
    """
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            casts = [f"CAST({c} AS VARCHAR) AS {c}" for c in dates] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql
        return fn
    return add


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Result types both engines share: zoneless times, date text, longs, rounded doubles."""
    def shape(c: str, t: str) -> Column:
        if t == "timestamp":
            return clock.naive(c).alias(c)
        if t in ("int", "smallint", "tinyint"):
            return F.col(c).cast("long").alias(c)
        if t == "date":
            return clock.date_text(c).alias(c)
        if t in ("double", "float"):
            return F.round(F.col(c).cast("double"), digits).alias(c)
        return F.col(c)
    return df.select(*[shape(c, t) for c, t in df.dtypes])


# --- SQL fragments ----------------------------------------------------------------------

HH = """hh AS (SELECT event_type AS series, time_bucket(INTERVAL '30 minutes', ts) AS ts,
  round(avg(value) - 50, 9) AS price, count(*) AS n FROM events GROUP BY 1, 2)"""


def _total(kind: str) -> str:
    return f"round(sum(CASE WHEN event_type = '{kind}' THEN value ELSE 0 END), 6)"


COMPONENTS = f"""components AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS timestamp,
  round(sum(value) * 10, 6) AS demand_mw, {_total('click')} AS embedded_wind_mw,
  {_total('view')} AS embedded_solar_mw, {_total('purchase')} AS transmission_wind_mw,
  {_total('signup')} AS nuclear_mw, {_total('error')} - 20 AS net_import_mw,
  CAST(count(*) - 5 AS DOUBLE) AS battery_net_mw, round(avg(value) * 3, 6) AS inertia_gvas
  FROM events GROUP BY 1)"""


def local(x: str) -> str:
    return f"(({x}) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London')"


def day(x: str) -> str:
    return f"CAST({local(x)} AS DATE)"


def day_start(d: str) -> str:
    return f"(CAST({d} AS TIMESTAMP) AT TIME ZONE 'Europe/London' AT TIME ZONE 'UTC')"


def day_length(d: str) -> str:
    return f"CAST((epoch({day_start(f'({d}) + 1')}) - epoch({day_start(d)})) / 1800 AS BIGINT)"


def period(x: str) -> str:
    return f"(CAST(floor((epoch({x}) - epoch({day_start(day(x))})) / 1800) AS BIGINT) + 1)"
