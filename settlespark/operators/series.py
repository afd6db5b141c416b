"""Ordered operators on series: lags, tails, folds, resampling, interpolation, storage."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from settlespark.errors import GuardError
from settlespark.functions import clock
from settlespark.operators.blocks import (
    FAN, GRID_BLOCK, block_of, fit_block, levels_of, nearest_known, number_rows, row_lags,
)
from settlespark.session import durable

# Scans run on Python workers, which need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lag_features(
    df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str],
    lags: Sequence[int] = (1, 2, 48, 96, 336), block_s: int = GRID_BLOCK,
) -> DataFrame:
    """``lag_<column>_<n>``: value ``n`` rows earlier, for the columns the table has."""
    new = {f"lag_{c}_{n}": (c, n) for c in columns if c in df.columns for n in lags}
    return row_lags(df, keys, ts, new, block_s=block_s) if new else df


def same_period_persistence(df, keys, ts, value, periods: int = 48, out="persistence") -> DataFrame:
    """Value one settlement day earlier by row count."""
    return row_lags(df, keys, ts, {out: (value, periods)})


def last_changes(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, lookback: int, out: str = "change",
) -> DataFrame:
    """First differences of a series, the last ``lookback`` of them."""
    v = F.col(value).cast("double")
    changes = (
        row_lags(df.select(*keys, ts, v.alias(value)), keys, ts, {"_before": (value, 1)})
        .withColumn(out, F.col(value) - F.col("_before"))
        .where(F.col(out).isNotNull()).drop("_before")
    )
    return last_rows(changes, keys, ts, lookback)


def last_rows(df: DataFrame, keys: Sequence[str], ts: str, n: int) -> DataFrame:
    numbered = number_rows(df, keys, ts)
    return numbered.where(F.col("_total") - F.col("_pos") <= n).drop("_pos", "_total")


def holdout_split(df: DataFrame, keys: Sequence[str], ts: str, holdout: int, out: str = "is_test") -> DataFrame:
    """Flag the last ``holdout`` rows of each series; a series must be longer than that."""
    if holdout <= 0:
        raise ValueError("holdout must be positive")
    numbered = number_rows(df, keys, ts)
    short = F.raise_error(F.lit("holdout must be smaller than the series")).cast("boolean")
    test = F.col("_pos") >= F.col("_total") - holdout
    return numbered.withColumn(out, F.when(F.col("_total") > holdout, test).otherwise(short)).drop("_pos", "_total")


def expanding_folds(df: DataFrame, keys: Sequence[str], ts: str, splits: int, out: str = "fold") -> DataFrame:
    """Fold of each row for expanding-window validation; null for the first block.

    Fold ``k`` is predicted by a model trained on all rows before it.
    """
    numbered = number_rows(df, keys, ts)
    size = F.floor(F.col("_total") / (splits + 1))
    first = F.col("_total") - size * splits
    short = F.raise_error(F.lit("too few rows for the folds")).cast("int")
    fold = F.when(F.col("_pos") >= first, F.floor((F.col("_pos") - first) / size).cast("int"))
    return numbered.withColumn(out, F.when(F.col("_total") >= splits + 2, fold).otherwise(short)).drop("_pos", "_total")


def window_contiguity(windows: DataFrame, source: str, start: str, end: str) -> DataFrame:
    """Each window with the start of the next one and whether the two adjoin.

    One row per collection window, so the window count of a source is a calendar figure.
    """
    w = W.partitionBy(source).orderBy(start)
    following = F.lead(start).over(w)
    return windows.withColumns({
        "next_start": following,
        "adjoins": F.when(following.isNotNull(), F.col(end) == following),
    })


def require_contiguous(windows: DataFrame, source: str, start: str, end: str, first=None, last=None) -> DataFrame:
    """Windows of each source must adjoin and span exactly ``[first, last)``."""
    checked = window_contiguity(windows, source, start, end)
    per = checked.groupBy(source).agg(
        F.min(start).alias("a"), F.max(end).alias("z"),
        F.count_if(~F.col("adjoins")).alias("breaks"), F.count_if(F.col(end) <= F.col(start)).alias("empty"),
    )
    fault = (F.col("breaks") > 0) | (F.col("empty") > 0)
    if first is not None:
        fault |= F.col("a") != F.lit(first).cast("date")
    if last is not None:
        fault |= F.col("z") != F.lit(last).cast("date")
    bad = per.where(fault)
    if not bad.isEmpty():
        raise GuardError(f"collection windows are not contiguous: {bad.first().asDict()}")
    return windows


def interpolate_to(
    known: DataFrame, targets: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str],
    block_s: int = GRID_BLOCK,
) -> DataFrame:
    """Time-linear values of ``known`` at the times of ``targets``.

    Before the first known point the result is null; after the last it is carried.
    """
    keys, values = list(keys), list(values)
    points = known.select(*keys, clock.instant(ts).alias(ts), *[F.col(v).cast("double").alias(v) for v in values], F.lit(0).alias("_ask"))
    asks = targets.select(*keys, clock.instant(ts).alias(ts), *[F.lit(None).cast("double").alias(v) for v in values], F.lit(1).alias("_ask"))
    # A point and a target at the same time become one row, so the target reads the point.
    axis = points.unionByName(asks).groupBy(*keys, ts).agg(
        *[F.max(v).alias(v) for v in values], F.max("_ask").alias("_ask")
    )
    pairs = {v: F.when(F.col(v).isNotNull(), F.struct(F.unix_micros(ts).alias("t"), F.col(v).alias("v"))) for v in values}
    near = nearest_known(axis, keys, ts, pairs, block_s=block_s, ahead=True)
    at = F.unix_micros(ts)

    def blend(v: str) -> Column:
        a, b = F.col(f"prev_{v}"), F.col(f"next_{v}")
        share = (at - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0))
        return F.coalesce(a["v"] + (b["v"] - a["v"]) * share, a["v"])

    return near.where("_ask = 1").select(*keys, ts, *[blend(v).alias(v) for v in values])


def carry_to_boundary(df: DataFrame, keys: Sequence[str], ts: str, end: Column) -> DataFrame:
    """Repeat each series' last row at the exclusive end of its window."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_r"))
    edge = last.select(*keys, *[(end if c == ts else F.col(f"_r.{c}")).alias(c) for c in rest])
    return df.unionByName(edge.select(*df.columns))


def to_half_hourly(
    df: DataFrame, value: str, ts: str = "timestamp", resolution: str = "resolution_minutes",
    domains: Sequence[str] = ("in_domain", "out_domain"), order: Sequence[str] = (),
) -> DataFrame:
    """15, 30 or 60 minute rows to half-hours: average, keep, repeat. Other steps fail.

    Quarter-hours are averaged per domain pair. One row per time and domain pair is kept:
    the last under ``order``, by default the row of the coarsest source step.
    """
    domains = list(domains)
    res = F.col(resolution)
    bad = F.raise_error(F.concat(F.lit("cannot convert minutes: "), res.cast("string"))).cast("int")
    step = F.when(res.isin(15, 30, 60), res).otherwise(bad)
    starts = F.when(step == 60, F.array(clock.instant(ts), clock.add_seconds(ts, 1800))).when(
        step == 15, F.array(clock.half_hour(ts))
    ).otherwise(F.array(clock.instant(ts)))
    rest = [c for c in df.columns if c not in {ts, value, resolution, *domains}]
    grid = df.select(*domains, res.alias("_res"), F.col(value), *rest, F.explode(starts).alias(ts))
    # One aggregation holds all steps side by side: the mean of quarter-hours, and the last row of each step as
    # one struct of rank and value; these are alone in their group unless the source repeats them.
    # Columns outside the rank are aggregates of their own, so those that nobody reads are not computed.
    rank = list(order or rest)
    row = [*[F.col(c).alias(f"k{i}") for i, c in enumerate(rank)], F.col(value).alias("v")]
    # Without an order the coarser step comes first in the rank: whole and doubled rows share a struct.
    steps = {m: F.when(F.col("_res") == m, F.struct(*row)) for m in (15, 30, 60)} if order else {
        15: F.when(F.col("_res") == 15, F.struct(*row)), 60: F.when(F.col("_res") != 15, F.struct(F.col("_res").alias("res"), *row))}
    held = [F.avg(F.when(F.col("_res") == 15, F.col(value))).alias("_v15")] + [F.max(r).alias(f"_r{m}") for m, r in steps.items()]
    held += [F.max_by(c, r).alias(f"_{i}_{m}") for i, c in enumerate(rest) if c not in rank for m, r in steps.items()]
    merged = grid.groupBy(ts, *domains).agg(*held)

    def chosen(part):
        if not order:
            return F.when(F.col("_r60").isNotNull(), part(60)).otherwise(part(15))
        return F.when(_wins("_r60", "_r30", "_r15"), part(60)).when(_wins("_r30", "_r15"), part(30)).otherwise(part(15))

    def label(i, c):
        return chosen(lambda m: F.col(f"_r{m}")[f"k{rank.index(c)}"] if c in rank else F.col(f"_{i}_{m}"))

    return merged.select(
        ts, *domains, chosen(lambda m: F.col("_v15") if m == 15 else F.col(f"_r{m}")["v"]).alias(value), F.lit(30).alias(resolution),
        *[label(i, c).alias(c) for i, c in enumerate(rest)],
    )


def _wins(first: str, *others: str) -> Column:
    """Whether the rank is known and not below the others that are; of equal ranks the coarser step wins."""
    out = F.col(first).isNotNull()
    for other in others:
        out = out & (F.col(other).isNull() | (F.col(first) >= F.col(other)))
    return out


# --- battery state of charge ------------------------------------------------------------

def _compose_runs(runs: np.ndarray, shift: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Running composition, within each run, of maps ``x -> min(high, max(low, x + shift))``.

    Such maps compose to maps of the same form. Doubling steps on whole arrays replace a
    loop over rows; ``runs`` numbers the runs in order.
    """
    a, lo, hi = shift.copy(), low.copy(), high.copy()
    longest = int(np.bincount(runs).max()) if len(runs) else 0
    step = 1
    while step < longest:
        at = np.flatnonzero(runs[step:] == runs[:-step]) + step
        na, nlo, nhi = a[at], lo[at], hi[at]
        pa, plo, phi = a[at - step], lo[at - step], hi[at - step]
        a[at] = pa + na
        lo[at] = np.minimum(nhi, np.maximum(nlo, plo + na))
        hi[at] = np.minimum(nhi, np.maximum(nlo, phi + na))
        step *= 2
    return a, lo, hi


def _running_maps(df: DataFrame, run: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Replace the maps ``_a, _lo, _hi`` by their running composition within each run.

    Spark partitions by run and sorts; a task then streams over Arrow batches and carries
    one map from batch to batch, so its memory is one batch whatever the run length.
    """
    maps = ["_a", "_lo", "_hi"]
    placed = df.repartition(*run).sortWithinPartitions(*run, *order)

    def scan(batches):
        open_run, carry = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            # Only run names and maps leave Arrow; the payload passes through as it is.
            names = batch.select(list(run)).to_pandas()
            starts = (names != names.shift()).any(axis=1).to_numpy()
            starts[0] = True
            runs = np.cumsum(starts) - 1
            cols = [np.array(batch.column(m), dtype=float) for m in maps]
            if open_run is not None and tuple(names.iloc[0]) == open_run:
                prior, plo, phi = carry
                na, nlo, nhi = (c[0] for c in cols)
                cols[0][0] = prior + na
                cols[1][0] = min(nhi, max(nlo, plo + na))
                cols[2][0] = min(nhi, max(nlo, phi + na))
            done = _compose_runs(runs, *cols)
            open_run, carry = tuple(names.iloc[-1]), tuple(c[-1] for c in done)
            new = dict(zip(maps, done))
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[n]) if n in new else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return placed.mapInArrow(scan, placed.schema)


def _opening_states(ends: DataFrame, keys: Sequence[str], at: str, start: Column, levels: int, fan: int = FAN) -> DataFrame:
    """The state ``_x0`` at the start of each block, from the maps of whole blocks.

    Maps are composed within groups of ``fan`` consecutive block numbers, groups again within
    groups; the state at the start of a group then passes through the maps before a block in it.
    """
    inside = [*keys, "_up"] if levels > 1 else list(keys)
    grouped = ends.withColumn("_up", F.floor(F.col(at) / fan)) if levels > 1 else ends
    running = _running_maps(grouped, inside, [at])
    if levels > 1:
        running = durable(running)
        tops = running.groupBy(*inside).agg(F.max_by(F.struct("_a", "_lo", "_hi"), at).alias("m")).select(*keys, F.col("_up").alias("_at"), "m.*")
        above = _opening_states(tops, keys, "_at", start, levels - 1, fan).select(*keys, F.col("_at").alias("_up"), F.col("_x0").alias("_start"))
        running, start = running.join(above, inside), F.col("_start")
    closing = F.least(F.col("_hi"), F.greatest(F.col("_lo"), start + F.col("_a")))
    through = W.partitionBy(*inside).orderBy(at)
    return running.select(*keys, at, F.coalesce(F.lag(closing).over(through), start).alias("_x0"))


def state_of_charge(
    df: DataFrame, keys: Sequence[str], ts: str, power: str, initial_mwh: float, capacity_mwh: float,
    charge_efficiency: float = 0.93, discharge_efficiency: float = 0.93,
    tie: Sequence[str] = (), block_s: int | None = None, out: str = "battery_soc_mwh",
) -> DataFrame:
    """Half-hourly battery power integrated into a clamped state of charge.

    Every step is a clamp map, and clamp maps compose. Each block of a unit is scanned once
    and kept in the shared folder; the last map of every block is scanned again per unit,
    which gives the state at each block start; rows finish as a column expression. Power must
    not be null.
    """
    if capacity_mwh <= 0:
        raise ValueError("capacity must be positive")
    keys, cap, order = list(keys), float(capacity_mwh), [ts, *tie]
    width = block_s or fit_block(df, keys, ts)
    p = F.col(power).cast("double")
    shift = F.when(p >= 0, -0.5 * p / discharge_efficiency).otherwise(-0.5 * p * charge_efficiency)
    steps = df.withColumns({"_blk": block_of(ts, width), "_a": shift, "_lo": F.lit(0.0), "_hi": F.lit(cap)})
    scanned = durable(_running_maps(steps, [*keys, "_blk"], order))

    # The map of a whole block is the map of its last row.
    ends = scanned.groupBy(*keys, "_blk").agg(
        F.max_by(F.struct("_a", "_lo", "_hi"), F.struct(*order)).alias("m")
    ).select(*keys, "_blk", "m.*")
    start = F.lit(float(min(max(initial_mwh, 0.0), cap)))
    opening = _opening_states(ends, keys, "_blk", start, levels_of(width))
    soc = F.least(F.col("_hi"), F.greatest(F.col("_lo"), F.col("_x0") + F.col("_a")))
    return scanned.join(opening, [*keys, "_blk"]).withColumn(out, soc).drop("_blk", "_a", "_lo", "_hi", "_x0")


def day_period_numbers(df: DataFrame, ts: str, keys: Sequence[str] = (), out: str = "settlement_period") -> DataFrame:
    """Sequential number of each half-hour that occurs in its local day, from 1, per ``keys``.

    On a complete day this equals the elapsed period number; on one with gaps it does not.
    Half-hours are made distinct before they are numbered, at most 50 per day and key, and
    joined back; rows without a time have no number.
    """
    t = clock.half_hour(ts)
    slots = df.where(t.isNotNull()).select(*keys, t.alias("_slot")).distinct()
    w = W.partitionBy(*keys, clock.delivery_date("_slot")).orderBy("_slot")
    numbered = slots.withColumn(out, F.row_number().over(w)).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_slot", out)
    rows = df.withColumn("_at", t)
    on = rows["_at"] == numbered["_slot"]
    for k in keys:
        on = on & rows[k].eqNullSafe(numbered[f"_k_{k}"])
    return rows.join(numbered, on, "left").drop("_at", "_slot", *[f"_k_{k}" for k in keys])
