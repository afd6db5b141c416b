"""Collection jobs over landed payloads. Fetching is not part of the library: each job
reads all landed chunks in one scan, so nothing loops over files on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, functions as F

from settlespark.errors import GuardError
from settlespark.functions import clock
from settlespark.functions.values import row_sum
from settlespark.operators.point_in_time import last_by
from settlespark.operators.quality import judge_window, require_no_nulls, trim_window, window_count_columns
from settlespark.operators.relations import listed_only
from settlespark.session import durable, shared_path, side_by_side
from settlespark.sources import documents, records as src
from settlespark.sources.tables import write_checked, write_table


def combined(df: DataFrame, key: Sequence[str], order: Sequence[str], first: str, end: str, label: str) -> DataFrame:
    """Last row per key over all chunks, inside the ``[first, end)`` settlement window."""
    # Landed first: the window is counted and written from what was parsed once.
    kept = durable(last_by(df, key, order))
    return trim_window(kept, "timestamp", clock.day_start(F.lit(first)), clock.day_start(F.lit(end)), label=label)


def staged_records(landed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Records of all landed sources, unwrapped in one scan and written by source; a reader of one source reads its folder."""
    spark = landed.sparkSession
    rows = src.records(landed, keep=["source", *keep])
    path = shared_path(spark, "records")
    rows.write.partitionBy("source").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _published(df: DataFrame, key: Sequence[str], order: Sequence[str], first: str, end: str, label: str, path: str, tie: Sequence[str] = ()) -> str:
    """Write the last row per key inside the window, which is checked while the rows are written.

    Of rows that are equal in ``order`` the largest by ``tie`` is the last.
    """
    a, z, t = clock.day_start(F.lit(first)), clock.day_start(F.lit(end)), clock.instant("timestamp")
    counts = window_count_columns("timestamp", a, z)
    write_checked(last_by(df, key, [*order, *tie]), path, counts, lambda n: judge_window(n, label), (t >= a) & (t < z), order)
    return path


def core_sources(
    landed: DataFrame, first: str, end: str, output: str, fuels: Sequence[str], links: Sequence[str],
) -> dict[str, str]:
    """Prices, demand, fuel mix and interconnectors from landed payloads to four tables.

    ``landed`` has ``source``, ``landed_date`` and ``payload``, and may have ``chunk``. Records
    of one fuel or link are summed within a chunk; of chunks that hold the same time, the
    last by landing date and then by ``chunk``, or a hash of the payload, gives all its columns.
    Of several prices or demands of one time in one chunk the largest counts.
    Payloads are read and parsed once; each table is written once.
    """
    order = ["landed_date", "chunk"]
    if "chunk" not in landed.columns:
        landed = landed.withColumn("chunk", F.xxhash64("payload"))
    staged = staged_records(landed.where(F.col("source").isin("price", "demand", "fuel", "interconnectors")), order)

    def recs(name):
        return staged.where(F.col("source") == name).drop("source")

    parsed = {
        "price": src.market_index(recs("price"), order), "demand": src.demand(recs("demand"), order),
        "fuel": src.fuel_mix(recs("fuel"), fuels, order), "interconnectors": src.interconnectors(recs("interconnectors"), links, order),
    }
    ties = {"price": ["price_gbp_mwh", "market_index_volume_mwh"], "demand": ["demand_mw"]}
    return side_by_side(landed.sparkSession, {
        n: partial(_published, df, ["timestamp"], order, first, end, n, f"{output}/{n}", ties.get(n, ())) for n, df in parsed.items()})


def unit_sources(landed: DataFrame, first: str, end: str, output: str) -> dict[str, str]:
    """Unit generation and unit reference tables from landed payloads, which are read and parsed once."""
    order = ["landed_date"]
    staged = staged_records(landed.where(F.col("source").isin("unit_generation", "units")), order)

    def recs(name):
        return staged.where(F.col("source") == name).drop("source")

    made = src.unit_generation(recs("unit_generation"), order)
    return side_by_side(landed.sparkSession, {
        "unit_generation": partial(_published, made, ["timestamp", "bm_unit"], order, first, end, "units", f"{output}/unit_generation", ["generation_mwh"]),
        "units": partial(write_table, src.unit_reference(recs("units"), order), f"{output}/units"),
    })


def weather_source(landed: DataFrame, sites: Sequence[str], variables: Sequence[str], first: str, end: str) -> DataFrame:
    """Hourly weather of all sites on the settlement window, one column per cell."""
    wide = src.weather_wide(src.hourly_weather(landed, variables), sites, variables)
    return trim_window(wide, "timestamp", clock.day_start(F.lit(first)), clock.day_start(F.lit(end)), label="weather")


def preset_source(recs: DataFrame, name: str, first: str | None = None, end: str | None = None) -> DataFrame:
    """A named reference dataset, optionally only its ``[first, end)`` delivery dates."""
    if (first is None) != (end is None):
        raise ValueError("give both window dates or neither")
    kept = recs if first is None else src.in_date_window(recs, first, end)
    out = src.preset_reader(name)(kept)
    out = durable(out) if out.columns else None
    if out is None or out.isEmpty():
        raise GuardError(f"no records for {name}")
    return out


def _read(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Parsed documents; those that are parsed already are taken as they are."""
    return docs if "d" in docs.columns else documents.parsed(docs, keep=keep)


def neighbour_prices(docs: DataFrame, borders: Sequence[str], border: str = "border") -> DataFrame:
    """Day-ahead price and publication time per border, one row per half-hour.

    A document that refuses or fails yields no rows; see ``item_status``. A border that is not
    listed is an error.
    """
    points = documents.points_of(_read(docs, [border]), "price.amount", "price_eur_mwh", [border], strict=False)
    half = documents.to_half_hourly(points, "price_eur_mwh", domains=[border], order=["published_at_utc"])
    cells = [
        cell for b in borders for cell in (
            listed_only(border, borders, F.max(F.when(F.col(border) == b, F.col("price_eur_mwh")))).alias(f"{b}_day_ahead_price_eur_mwh"),
            listed_only(border, borders, F.max(F.when(F.col(border) == b, F.col("published_at_utc")))).alias(f"{b}_price_published_at_utc"),
        )
    ]
    return half.groupBy("timestamp").agg(*cells)


def border_flows(
    docs: DataFrame, borders: Sequence[str], border: str = "border", direction: str = "direction",
    out: str = "net_import_mw", suffix: str = "",
) -> DataFrame:
    """Import, export and net flow per border and their total, positive into GB.

    ``direction`` is ``in`` or ``out``. All borders and directions pass one scan and one
    aggregation.
    """
    points = documents.points_of(_read(docs, [border, direction]), "quantity", "flow_mw", [border, direction], strict=False)
    half = documents.to_half_hourly(points, "flow_mw", domains=[border, direction], order=["published_at_utc"])
    def cell(b, d):
        return F.coalesce(listed_only(border, borders, F.max(F.when((F.col(border) == b) & (F.col(direction) == d), F.col("flow_mw")))), F.lit(0.0))
    cells = [cell(b, d).alias(f"{b}{suffix}_{n}_mw") for b in borders for d, n in (("in", "import"), ("out", "export"))]
    wide = half.groupBy("timestamp").agg(*cells)
    nets = {f"{b}{suffix}_net_import_mw": F.col(f"{b}{suffix}_import_mw") - F.col(f"{b}{suffix}_export_mw") for b in borders}
    return wide.withColumns(nets).withColumn(out, row_sum(list(nets), null_as_zero=True))


def item_status(docs: DataFrame, keys: Sequence[str], value_field: str) -> DataFrame:
    """Status and parsed rows of each collected item; a failed item hides no other one."""
    keys, d = list(keys), F.col("d")
    seen = _read(docs, keys).select(*keys, documents.status_of(d, F.col("acknowledged")).alias("_s"), documents.point_count(d, value_field).alias("_n"))
    n = F.sum("_n").cast("long")
    status = (
        F.when(F.bool_or(F.col("_s") == "failed"), "failed").when(F.bool_or(F.col("_s") == "unavailable"), "unavailable")
        .when(n > 0, "success").otherwise("no_rows")
    )
    return seen.groupBy(*keys).agg(status.alias("status"), F.count(F.lit(1)).alias("documents"), n.alias("row_count"))


def overall_status(items: DataFrame) -> DataFrame:
    """Roll item statuses up to success, partial or failed."""
    counts = items.agg(
        F.count_if(F.col("status") == "success").alias("successful_items"),
        F.count_if(F.col("status").isin("failed", "unavailable")).alias("failed_or_unavailable_items"),
        F.count_if(F.col("status").isin("skipped", "no_rows")).alias("other_items"),
    )
    overall = F.when(F.col("failed_or_unavailable_items") == 0, "success").when(F.col("successful_items") > 0, "partial").otherwise("failed")
    return counts.withColumn("overall_status", overall)


def market_collection(docs: DataFrame, borders: Sequence[str], output: str) -> dict[str, str]:
    """Prices, physical flows and scheduled exchanges of all borders, with a status table.

    ``docs`` has ``product``, ``border``, ``direction`` and ``xml``. Partial success is
    kept; only a run without any usable document fails. Documents are read and parsed once, into a
    table by product that the statuses and the three tables read.
    """
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "documents")
    read = documents.parsed(docs, keep=["product", "border", "direction"])
    read.write.partitionBy("product").parquet(path)
    staged = spark.read.schema(read.schema).parquet(path)
    items = item_status(staged.where("product = 'price'"), ["product", "border"], "price.amount").unionByName(
        item_status(staged.where("product <> 'price'"), ["product", "border"], "quantity"))
    saved = {"status": write_table(items, f"{output}/status")}
    if spark.read.parquet(saved["status"]).where("status = 'success'").isEmpty():
        raise GuardError("no usable document; see the status table")
    jobs = {
        "prices": neighbour_prices(staged.where("product = 'price'"), borders),
        "physical_flows": border_flows(staged.where("product = 'flow'"), borders),
        "scheduled_exchanges": border_flows(staged.where("product = 'schedule'"), borders, out="scheduled_net_import_mw", suffix="_scheduled"),
    }
    return saved | side_by_side(spark, {n: partial(write_table, df, f"{output}/{n}", refuse_empty=False) for n, df in jobs.items()})


def fallback_profile(history: DataFrame, spine: DataFrame, columns: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Values observed exactly 168 hours before each period of ``spine``; all must exist."""
    past = history.select(clock.add_seconds(ts, 7 * 86400).alias(ts), *[F.col(c).alias(f"fallback_d7_{c}") for c in columns])
    out = spine.join(past, ts, "left")
    return require_no_nulls(out, [f"fallback_d7_{c}" for c in columns], "seven-day profile")
