"""Data guards, physical bounds and table profiles."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from multiprocessing import TimeoutError
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from settlespark import constants as K
from settlespark.errors import GuardError, MissingColumns, need_columns
from settlespark.functions import clock
from settlespark.functions.values import non_negative, redacted


def window_count_columns(ts: str, start: Column, end: Column, tolerance_s: int = 86400) -> list[Column]:
    """Counts of rows inside ``[start, end)``, spilled within the tolerance, far outside, and untimed."""
    t = clock.instant(ts)
    inside = (t >= start) & (t < end)
    far = (t < clock.add_seconds(start, -tolerance_s)) | (t >= clock.add_seconds(end, tolerance_s))
    return [F.count_if(inside).alias("inside_rows"), F.count_if(~inside & ~far).alias("spilled_rows"),
            F.count_if(far).alias("far_rows"), F.count_if(t.isNull()).alias("untimed_rows")]


def window_counts(df: DataFrame, ts: str, start: Column, end: Column, tolerance_s: int = 86400, keys: Sequence[str] = ()) -> DataFrame:
    """Rows inside ``[start, end)``, spilled within the tolerance, far outside, and untimed."""
    return df.groupBy(*keys).agg(*window_count_columns(ts, start, end, tolerance_s))


def judge_window(counts: dict, label: str) -> None:
    """Rows far outside a window, unreadable times and an empty window are errors."""
    if counts["untimed_rows"]:
        raise GuardError(f"{label} has {counts['untimed_rows']} invalid times")
    if counts["far_rows"]:
        raise GuardError(f"{label} has {counts['far_rows']} rows far outside the requested window")
    if not counts["inside_rows"]:
        raise GuardError(f"{label} has no rows inside the requested window")


def trim_window(df: DataFrame, ts: str, start: Column, end: Column, tolerance_s: int = 86400, label: str = "table") -> DataFrame:
    """Keep ``[start, end)``. Rows far outside, unreadable times and an empty result fail."""
    judge_window(window_counts(df, ts, start, end, tolerance_s).first().asDict(), label)
    t = clock.instant(ts)
    return df.where((t >= start) & (t < end))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, null_rows`` from one aggregation over all columns."""
    columns = list(columns)
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "null_rows"
    )


def require_no_nulls(df: DataFrame, columns: Sequence[str], label: str = "table") -> DataFrame:
    need_columns(df, columns, label)
    bad = null_counts(df, columns).where("null_rows > 0").collect()
    if bad:
        raise GuardError(f"{label} has gaps: { {r.column_name: r.null_rows for r in bad} }")
    return df


def physical_bounds(df: DataFrame, components: Sequence[str], signed=frozenset(K.SIGNED_COMPONENTS)) -> DataFrame:
    """Clip components that cannot be negative; a null or NaN component is an error."""
    def bounded(c):
        gap = F.raise_error(F.lit(f"component forecast has nulls: {c}")).cast("double")
        return F.coalesce(non_negative(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))), gap)
    return df.withColumns({c: bounded(c) for c in components if c in df.columns and c not in signed})


def clip_counts(df: DataFrame, components: Sequence[str], signed=frozenset(K.SIGNED_COMPONENTS), keys: Sequence[str] = ()) -> DataFrame:
    """How many values of each component the bounds change."""
    counts = [
        (F.lit(0).cast("long") if c in signed or c not in df.columns else F.count_if(F.col(c) < 0)).alias(c)
        for c in components
    ]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *counts).drop("_n")


def require_after_issue(df: DataFrame, issue: Column, delivery: str = "delivery_time_utc") -> DataFrame:
    late = df.where(clock.instant(delivery) <= issue)
    if not late.isEmpty():
        raise GuardError("delivery periods must lie after the issue time")
    return df


def issue_window_faults(df: DataFrame, issue: str, day: str) -> DataFrame:
    """Rows whose issue is not within the two days before the delivery day."""
    gap = clock.seconds(clock.day_start(day)) - clock.seconds(issue)
    return df.where((gap <= 0) | (gap > 2 * 86400))


def component_profile(df: DataFrame) -> tuple[str, list[str]]:
    """Modelling profile of a table, from its rows or, failing that, its columns."""
    marks = set()
    if "model_profile" in df.columns:
        low, high = df.agg(F.min("model_profile"), F.max("model_profile")).first()
        marks = {m for m in (low, high) if m is not None}
    if not marks:
        targets = [c for c in K.FULL_COMPONENTS if c in df.columns]
        return (K.PROFILE_FULL if "battery_net_mw" in targets else K.PROFILE_CORE), targets
    known = {K.PROFILE_FULL: K.FULL_COMPONENTS, K.PROFILE_CORE: K.CORE_COMPONENTS}
    if len(marks) > 1 or not marks <= set(known):
        raise GuardError(f"inconsistent model profiles: {sorted(marks)}")
    profile = marks.pop()
    return profile, list(need_columns(df, known[profile], "profile") and known[profile])


def require_components(configured: Sequence[str] | None) -> list[str]:
    """Validate a configured component list against the supported profiles."""
    wanted = list(K.FULL_COMPONENTS if configured is None else configured)
    unknown, lacking = set(wanted) - set(K.FULL_COMPONENTS), set(K.CORE_COMPONENTS) - set(wanted)
    if not wanted or unknown or lacking:
        raise GuardError(f"component list: unknown {sorted(unknown)}, lacking {sorted(lacking)}")
    return wanted


def mapped(columns: dict, key: str) -> str:
    """A configured source column; unset or placeholder values are refused."""
    name = str(columns.get(key) or "")
    if not name or name.startswith("REQUIRED_"):
        raise MissingColumns(f"the mapping must set {key}")
    return name


# --- profiles ---------------------------------------------------------------------------

TIME_KEYS = ["timestamp", "delivery_time_utc", "published_at_utc", "settlement_date"]


def _row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row; nulls count by their place."""
    kinds = dict(df.dtypes)
    cells = [F.to_json(F.struct(c)) if "map<" in kinds[c] or kinds[c] == "variant" else F.col(c) for c in df.columns]
    nulls = F.array(*[F.col(c).isNull() for c in df.columns])
    return [F.xxhash64(nulls, *cells), F.xxhash64(F.lit(1), *cells, nulls)]


def table_profile(df: DataFrame, name: str, time_column: str | None = None, sample: int = 2) -> DataFrame:
    """A table in one row: rows, columns with types and null counts, duplicates, time range and first rows.

    One scan: every row becomes an entry of its digest and one of its time, the first rows also one
    of their text, and a single aggregation folds equal entries. Rows with one digest have the same
    nulls, so null counts need no second pass. Wide values are hashed where they lie.
    """
    ts = time_column or next((c for c in TIME_KEYS if c in df.columns), None)
    t = F.lit(None).cast("timestamp") if ts is None else clock.parse_instant(ts) if dict(df.dtypes)[ts] == "string" else clock.instant(ts)
    a, b = _row_digest(df)
    nulls, none = F.array(*[F.col(c).isNull() for c in df.columns]), F.lit(None).cast("bigint")
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    empty, blank = F.array().cast("array<boolean>"), F.lit(None).cast("string")

    def entry(kind, x, y=none, mask=empty, body=blank):
        return F.struct(F.lit(kind).alias("kind"), x.alias("a"), y.alias("b"), mask.alias("nulls"), body.alias("text"))

    first = F.when(F.col("_place").bitwiseAND((1 << 33) - 1) < sample, entry("text", F.col("_place"), body=text))
    entries = [entry("row", a, b, nulls), *([entry("time", F.unix_micros(t))] if ts else []), first]
    spread = df.withColumn("_place", F.monotonically_increasing_id()).select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    # All of an entry is its key and only a count is added up, which a hash table holds without sorting.
    folded = spread.groupBy("kind", "a", "b", "nulls", "text").agg(F.count(F.lit(1)).alias("n"))

    def of(kind, value):
        return F.sum(F.when(F.col("kind") == kind, value))

    known = F.col("a").isNotNull()
    missing = [F.coalesce(of("row", F.when(F.col("nulls")[i], F.col("n")).otherwise(0)), F.lit(0)).alias(f"_n{i}") for i in range(len(df.columns))]
    out = folded.agg(
        F.coalesce(of("row", F.col("n")), F.lit(0)).alias("row_count"), F.coalesce(of("row", F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), *missing,
        (F.coalesce(of("time", F.when(known, 0).otherwise(F.col("n"))), F.lit(0)) if ts else none).alias("invalid_timestamps"),
        F.timestamp_micros(F.min(F.when(F.col("kind") == "time", F.col("a")))).alias("timestamp_min"),
        F.timestamp_micros(F.max(F.when(F.col("kind") == "time", F.col("a")))).alias("timestamp_max"),
        (F.coalesce(of("time", F.when(known, F.col("n") - 1)), F.lit(0)) if ts else none).alias("duplicate_timestamps"),
        # The first rows of each partition are offered, the first of all are kept.
        F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("a", "text")))), 1, sample).alias("_first"),
    )
    counts = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"_n{i}").alias("value")) for i, c in enumerate(df.columns)])
    return out.select(
        F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"),
        sum((F.col(f"_n{i}") for i in range(len(df.columns))), F.lit(0).cast("long")).alias("null_cells"),
        "duplicate_rows", F.lit(ts).alias("timestamp_column"), "invalid_timestamps", "timestamp_min", "timestamp_max", "duplicate_timestamps",
        F.map_from_entries(F.filter(counts, lambda x: x["value"] > 0)).alias("null_counts"),
        F.create_map(*[F.lit(x) for c, kind in df.dtypes for x in (c, kind)]).alias("data_types"), F.col("_first.text").alias("sample"),
    )


def column_profile(df: DataFrame, name: str) -> DataFrame:
    """Null count and type of each column."""
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return null_counts(df, df.columns).select(
        F.lit(name).alias("table_name"), "column_name", types[F.col("column_name")].alias("data_type"), "null_rows"
    )


def sample_rows(df: DataFrame, n: int = 2) -> DataFrame:
    """The first rows of a table as JSON text."""
    return df.limit(n).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("sample"))


PROFILE = ("table_name string, row_count bigint, column_count bigint, null_cells bigint, duplicate_rows bigint, timestamp_column string, invalid_timestamps bigint, "
           "timestamp_min timestamp, timestamp_max timestamp, duplicate_timestamps bigint, null_counts map<string,bigint>, data_types map<string,string>, sample array<string>")


def audit_tables(spark: SparkSession, tables: dict[str, DataFrame | Exception | Callable[[], DataFrame]], parallelism: int = 4, seconds: float | None = None) -> DataFrame:
    """Profiles of many tables, in a row each; one that cannot be opened or read becomes a row with its error.

    Every table is profiled by jobs of its own, several side by side, so a corrupt file ends the
    profile of its table only. With ``seconds`` a profile that takes longer is cancelled. A value may be
    a function that opens the table. The number of tables is a directory listing, not data.
    """
    context = spark.sparkContext

    def profiled(name, source, group):
        context.setJobGroup(group, f"profile of {name}", interruptOnCancel=True)
        if isinstance(source, Exception):
            raise source
        return table_profile(source if isinstance(source, DataFrame) else source(), name).first()

    rows = []
    with ThreadPool(parallelism) as pool:
        run = inheritable_thread_target(spark)(profiled)
        started = [(name, group, pool.apply_async(run, (name, source, group))) for name, source in sorted(tables.items()) for group in [f"audit-{uuid.uuid4().hex}"]]
        for name, group, job in started:
            try:
                rows.append((*job.get(seconds), None))
            except TimeoutError:
                context.cancelJobGroup(group)
                rows.append((name, *[None] * 12, f"profile cancelled after {seconds:g} s"))
            except Exception as error:
                rows.append((name, *[None] * 12, f"{type(error).__name__}: {error}"))
    return spark.createDataFrame(rows, f"{PROFILE}, error string").withColumn("error", redacted("error"))
