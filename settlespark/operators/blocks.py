"""Ordered operators that never put a whole series into one task.

A series may hold a third of all rows, so ``Window.partitionBy(series)`` is not safe.
Each series is cut into time blocks. Work inside a block uses an ordinary window on
``(series, block)``; what crosses a block border (row offsets, last known value) travels
in a summary with one row per block. The summary is scanned in a tree of fixed fan-in, so
that no window spans a series however narrow its blocks are. Keys must not be null; a null
time sorts last.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from settlespark.functions.clock import instant

GRID_BLOCK = 28 * 86400
"""Block of a half-hourly series: at most 1,346 rows per series by the clock itself."""

WIDTHS = [28 * 86400, 7 * 86400, 86400, 6 * 3600, 3600, 600, 60, 10, 1]
LAST_BLOCK = 2**62

FAN = 4096
"""Blocks, or groups of them, that one window of a border scan may hold."""

CALENDAR_S = 200 * 366 * 86400
"""Times of a series lie within two centuries; with wider ones windows only grow in proportion."""


def levels_of(block_s: int, fan: int = FAN) -> int:
    """Levels of a tree of this fan-in over all blocks of the calendar: one for blocks of weeks, three for seconds."""
    return max(1, ceil(log(max(2, CALENDAR_S / block_s)) / log(fan)))


def scan_borders(
    nodes: DataFrame, keys: Sequence[str], at: str, kinds: dict[str, str], levels: int, fan: int = FAN,
) -> DataFrame:
    """What the other blocks of its series hand to each block, under the same column names.

    ``kinds`` says how a column is handed on: ``sum`` of all earlier blocks, ``last`` known value
    of an earlier one, or ``next`` known value of a later one. Groups of ``fan`` consecutive block
    numbers are folded to one, these again, and what reaches a group is passed down to its
    members. A window sees the members of one group.
    """
    keys, up = list(keys), "_up"
    grouped = nodes.withColumn(up, F.floor(F.col(at) / fan)) if levels > 1 else nodes
    inside = [*keys, *([up] if levels > 1 else [])]
    before = W.partitionBy(*inside).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*inside).orderBy(F.col(at).desc()).rowsBetween(W.unboundedPreceding, -1)

    def near(name, kind):
        if kind == "sum":
            return F.coalesce(F.sum(name).over(before), F.lit(0))
        return F.last(name, ignorenulls=True).over(before if kind == "last" else after)

    near_by = grouped.select(*inside, at, *[near(n, k).alias(n) for n, k in kinds.items()])
    if levels == 1:
        return near_by
    known = {n: F.when(F.col(n).isNotNull(), F.col(at)) for n in kinds}
    fold = {"sum": lambda n: F.sum(n), "last": lambda n: F.max_by(n, known[n]), "next": lambda n: F.min_by(n, known[n])}
    upper = grouped.groupBy(*inside).agg(*[fold[k](n).alias(n) for n, k in kinds.items()]).withColumnRenamed(up, "_at")
    handed = scan_borders(upper, keys, "_at", kinds, levels - 1, fan).select(
        *keys, F.col("_at").alias(up), *[F.col(n).alias(f"_far_{n}") for n in kinds])
    both = {n: F.col(n) + F.col(f"_far_{n}") if k == "sum" else F.coalesce(n, f"_far_{n}") for n, k in kinds.items()}
    return near_by.join(handed, inside).select(*keys, at, *[c.alias(n) for n, c in both.items()])


def block_of(ts: str | Column, width_s: int) -> Column:
    return F.coalesce(F.floor(F.unix_seconds(instant(ts)) / F.lit(width_s)), F.lit(LAST_BLOCK))


def fit_block(df: DataFrame, keys: Sequence[str], ts: str, max_rows: int = 1_000_000) -> int:
    """Widest block that keeps every ``(series, block)`` within ``max_rows`` rows.

    Use it for raw tables whose density is not bounded by the clock. One map-side
    combined count per width tried; it stops at the first width that fits, which for
    evenly spread data is the first guess after the opening count.
    """
    i = 0
    while True:
        width = WIDTHS[i]
        counts = df.groupBy(*keys, block_of(ts, width).alias("_b")).count()
        top = counts.agg(F.max("count")).first()[0] or 0
        if top <= max_rows or i == len(WIDTHS) - 1:
            return width
        fitting = [j for j in range(i + 1, len(WIDTHS)) if top * WIDTHS[j] / width <= max_rows]
        i = fitting[0] if fitting else len(WIDTHS) - 1


def number_rows(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (),
    block_s: int = GRID_BLOCK, position: str = "_pos", total: str = "_total",
) -> DataFrame:
    """Zero-based position of each row in its series, and the series length."""
    keys = list(keys)
    rows = df.withColumn("_blk", block_of(ts, block_s))
    counted = rows.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_size"))
    levels = levels_of(block_s)
    if levels == 1:
        earlier = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
        sizes = counted.select(*keys, "_blk", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"), F.sum("_size").over(W.partitionBy(*keys)).alias(total))
    else:
        whole = counted.groupBy(*keys).agg(F.sum("_size").alias(total))
        sizes = scan_borders(counted, keys, "_blk", {"_size": "sum"}, levels).withColumnRenamed("_size", "_before")
        sizes = sizes.join(whole, keys) if keys else sizes.crossJoin(whole)
    inside = W.partitionBy(*keys, "_blk").orderBy(F.col(ts).asc_nulls_last(), *tie)
    return (
        rows.withColumn("_in", F.row_number().over(inside))
        .join(sizes, [*keys, "_blk"])
        .withColumn(position, F.col("_before") + F.col("_in") - 1)
        .drop("_blk", "_in", "_before")
    )


def row_lags(
    df: DataFrame, keys: Sequence[str], ts: str, new: dict[str, tuple[str | Column, int]],
    tie: Sequence[str] = (), block_s: int = GRID_BLOCK, rows_per_task: int = 4096,
) -> DataFrame:
    """Add ``name -> (column, n)``: the column's value ``n`` rows earlier in the series.

    Rows are numbered, cut into runs of equal length, and each run receives the last
    rows of the run before it, so every window sees a bounded number of rows.
    """
    keys, reach = list(keys), max(n for _, n in new.values())
    run = max(rows_per_task, reach)
    numbered = number_rows(df, keys, ts, tie, block_s)
    own = F.floor(F.col("_pos") / run)
    spill = F.pmod(F.col("_pos"), F.lit(run)) >= run - reach
    copies = F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_own", own).withColumn("_run", F.explode(copies))
    w = W.partitionBy(*keys, "_run").orderBy("_pos")
    lagged = spread.withColumns({
        name: F.lag(F.col(c) if isinstance(c, str) else c, n).over(w) for name, (c, n) in new.items()
    })
    return lagged.where(F.col("_run") == F.col("_own")).drop("_own", "_run", "_pos", "_total")


def nearest_known(
    df: DataFrame, keys: Sequence[str], ts: str, values: dict[str, Column],
    tie: Sequence[str] = (), block_s: int = GRID_BLOCK, ahead: bool = False,
) -> DataFrame:
    """Last non-null value at or before each row, as ``prev_<name>``.

    With ``ahead=True`` also the next one at or after it, as ``next_<name>``.
    """
    keys = list(keys)
    rows = df.withColumns({"_blk": block_of(ts, block_s), **{f"_v_{n}": v for n, v in values.items()}})
    order = [F.col(ts).asc_nulls_last(), *tie]
    back = W.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rank = F.struct(instant(ts).alias("t"), *[F.col(t) for t in tie])
    # Reading forward as a reversed backward frame keeps the window linear.
    reverse = [F.col(ts).desc_nulls_first(), *[F.col(t).desc() for t in tie]]
    fore = W.partitionBy(*keys, "_blk").orderBy(*reverse).rowsBetween(W.unboundedPreceding, 0)

    summary, found, kinds = [], {}, {}
    for n in values:
        v = F.col(f"_v_{n}")
        known = F.when(v.isNotNull(), rank)
        summary.append(F.max_by(v, known).alias(f"_cp_{n}"))
        found[f"prev_{n}"] = F.last(v, ignorenulls=True).over(back)
        kinds[f"_cp_{n}"] = "last"
        if ahead:
            summary.append(F.min_by(v, known).alias(f"_cn_{n}"))
            found[f"next_{n}"] = F.last(v, ignorenulls=True).over(fore)
            kinds[f"_cn_{n}"] = "next"
    borders = scan_borders(rows.groupBy(*keys, "_blk").agg(*summary), keys, "_blk", kinds, levels_of(block_s))
    joined = rows.withColumns(found).join(borders, [*keys, "_blk"])
    filled = {f"prev_{n}": F.coalesce(f"prev_{n}", f"_cp_{n}") for n in values}
    if ahead:
        filled |= {f"next_{n}": F.coalesce(f"next_{n}", f"_cn_{n}") for n in values}
    scratch = ["_blk"] + [f"{p}{n}" for n in values for p in ("_v_", "_cp_", "_cn_")]
    return joined.withColumns(filled).drop(*scratch)
