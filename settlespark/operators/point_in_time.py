"""Revision-safe selection and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from settlespark.errors import GuardError, need_columns
from settlespark.functions import clock
from settlespark.operators.blocks import fit_block, nearest_known


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the last row per key under ``order``.

    ``max_by`` combines on the map side, so a hot key shuffles one row per task.
    """
    keys = list(keys)
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return top.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def latest_revision(
    df: DataFrame, keys: Sequence[str], published: str = "published_at_utc",
    issue: str | Column | None = None, tie: Sequence[str] = (),
) -> DataFrame:
    """Latest publication per delivery key that was known at ``issue`` (inclusive).

    ``issue`` is an instant, or a column expression when every delivery has its own issue
    time; the selection is then still a single aggregation, with no loop over issue times.
    """
    need_columns(df, [published, *keys], "revisions")
    pub = clock.instant(published)
    known = df.where(pub.isNotNull())
    if issue is not None:
        limit = issue if isinstance(issue, Column) else F.lit(issue).cast("timestamp")
        known = known.where(pub <= limit)
    return last_by(known, keys, [pub, *tie])


def asof_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[str],
    suffix: str = "_right", tie: Sequence[str] = (), block_s: int | None = None,
) -> DataFrame:
    """Backward, inclusive as-of join that keeps every left row.

    Both sides are laid on one time axis, cut into blocks that fit a task, and the last
    right row is carried forward, so neither a hot key nor a long history is gathered.
    ``tie`` orders right rows with equal times.
    """
    by = list(by)
    carried = [c for c in right.columns if c not in by]
    renamed = {c: f"{c}{suffix}" if c in left.columns else c for c in carried}
    revisions = last_by(
        right.where(F.col(right_time).isNotNull()).withColumn("_t", clock.instant(right_time)),
        [*by, "_t"], list(tie) or [right_time],
    )
    a = left.where(F.col(left_time).isNotNull()).select(
        *by, clock.instant(left_time).alias("_t"), F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
        F.lit(None).alias("_right"),
    )
    b = revisions.select(
        *by, "_t", F.lit(0).alias("_side"), F.lit(None).alias("_left"),
        F.struct(*[F.col(c) for c in carried]).alias("_right"),
    )
    axis = a.unionByName(b)
    width = block_s or fit_block(axis.select(*by, "_t"), by, "_t")
    matched = nearest_known(axis, by, "_t", {"r": F.col("_right")}, tie=["_side"], block_s=width)
    joined = matched.where("_side = 1").select(
        "_left.*", *[F.col(f"prev_r.{c}").alias(renamed[c]) for c in carried]
    )
    # Rows without a time match nothing and stay out of the time blocks.
    kinds = dict(right.dtypes)
    untimed = left.where(F.col(left_time).isNull()).select(
        *left.columns, *[F.lit(None).cast(kinds[c]).alias(renamed[c]) for c in carried]
    )
    return joined.unionByName(untimed)


def future_information(
    df: DataFrame, issue: str = "issue_time_utc", published: Sequence[str] | None = None,
) -> DataFrame:
    """Count, per publication column, the rows published after the issue time."""
    columns = list(published or [c for c in df.columns if c.endswith("published_at_utc")])
    late = [
        F.count_if(clock.instant(c) > clock.instant(issue)).alias(c) for c in columns
    ]
    return df.agg(*late).unpivot([], columns, "publication_column", "late_rows")


def require_no_future_information(df: DataFrame, issue="issue_time_utc", published=None) -> DataFrame:
    late = future_information(df, issue, published).where("late_rows > 0").collect()
    if late:
        raise GuardError(f"published after issue: { {r[0]: r[1] for r in late} }")
    return df


def timestamp_lags(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, lags: dict[str, int],
) -> DataFrame:
    """Value observed exactly ``lags[name]`` seconds earlier; absent stays null.

    Each row is sent to its own time and to each later time that needs it, and one
    aggregation brings them together: one scan and one shuffle instead of a self-join per
    lag. A repeated ``(keys, ts)`` is an error. Rows without a time are kept and have no lags.
    """
    untimed = df.where(clock.instant(ts).isNull()).select("*", *[F.lit(None).cast("double").alias(n) for n in lags])
    df = df.where(clock.instant(ts).isNotNull())
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    home = F.struct(
        clock.instant(ts).alias("t"), F.lit(True).alias("home"), row.alias("row"),
        *[F.lit(None).cast("double").alias(n) for n in lags],
    )
    visits = [
        F.struct(
            clock.add_seconds(ts, s).alias("t"), F.lit(False).alias("home"), F.when(F.lit(False), row).alias("row"),
            *[(F.col(value) if m == n else F.lit(None)).cast("double").alias(m) for m in lags],
        )
        for n, s in lags.items()
    ]
    spread = df.select(*keys, F.explode(F.array(home, *visits)).alias("_x"))
    # Column by column, so that numeric rows are aggregated by hash and need no sort.
    folded = spread.groupBy(*keys, F.col("_x.t").alias("_t")).agg(
        F.count_if("_x.home").alias("_home"),
        *[F.any_value(F.col(f"_x.row.{c}"), True).alias(c) for c in rest],
        *[F.max(F.col(f"_x.{n}")).alias(n) for n in lags],
    )
    repeated = F.raise_error(F.concat(F.lit(f"repeated {ts}: "), F.col("_t").cast("string"))).cast("boolean")
    once = F.when(F.col("_home") > 1, repeated).otherwise(F.col("_home") == 1)
    return folded.where(once).select(*df.columns, *lags).unionByName(untimed)
