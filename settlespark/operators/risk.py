"""Value at risk, expected shortfall, price distributions and joint error scenarios."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from settlespark import constants as K
from settlespark.functions import clock
from settlespark.functions.values import non_negative
from settlespark.operators.blocks import number_rows
from settlespark.operators.series import last_changes


def tail_losses(
    losses: DataFrame, keys: Sequence[str], loss: str, confidence: float,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact loss quantile and the mean loss at or beyond it, in one aggregation.

    The losses of a group are kept as an array. Its length is a parameter of the method
    (lookback or scenario count), never a property of the data.
    """
    level = losses.groupBy(*keys).agg(
        F.percentile(loss, F.lit(float(confidence))).alias("var"), F.collect_list(loss).alias("_all"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    tail = F.filter("_all", lambda x: x >= F.col("var"))
    mean = F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x) / F.size(tail)
    return level.withColumn("expected_shortfall", mean).drop("_all")


def parametric_var(
    prices: DataFrame, keys: Sequence[str], ts: str, price: str, position_mwh: float,
    z: float = K.Z_95, lookback: int = K.LOOKBACK,
) -> DataFrame:
    """|position| x sample deviation of the last absolute price changes x z."""
    changes = last_changes(prices, keys, ts, price, lookback)
    return changes.groupBy(*keys).agg(
        (F.lit(abs(position_mwh)) * F.stddev_samp("change") * F.lit(z)).alias("parametric_var"),
        F.count("change").alias("changes"),
    )


def historical_var(
    prices: DataFrame, keys: Sequence[str], ts: str, price: str, position_mwh: float,
    confidence: float = 0.95, lookback: int = K.LOOKBACK,
) -> DataFrame:
    """Historical-simulation VaR and expected shortfall of the last price changes."""
    changes = last_changes(prices, keys, ts, price, lookback)
    losses = changes.select(*keys, (F.col("change") * F.lit(-float(position_mwh))).alias("loss"))
    return tail_losses(losses, keys, "loss", confidence)


def scenario_risk(
    paths: DataFrame, keys: Sequence[str], price: str, reference: str, position_mwh: float,
    confidence: float = 0.95, scenario: str = "scenario",
) -> DataFrame:
    """Whole-horizon VaR, shortfall, worst loss and best profit over scenarios.

    Losses are rounded to a millionth, so that of equal losses at the VaR none leaves the tail by
    the order of its sum.
    """
    leg = (F.col(price) - F.col(reference)) * F.lit(position_mwh * 0.5)
    losses = paths.groupBy(*keys, scenario).agg(F.round(-F.sum(leg), 6).alias("loss"))
    extra = {"worst_loss": F.max("loss"), "best_profit": F.max(-F.col("loss"))}
    return tail_losses(losses, keys, "loss", confidence, extra).withColumnRenamed("var", "scenario_var")


def price_quantiles(paths: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    """P10, P50, P90 and the chance of a negative price per period."""
    q = F.percentile(price, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = paths.groupBy(*keys).agg(q.alias("_q"), F.avg((F.col(price) < 0).cast("double")).alias("negative_probability"))
    return out.select(
        *keys, F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p90"), "negative_probability"
    )


def daily_distribution(
    paths: DataFrame, quantiles: DataFrame, keys: Sequence[str], price: str, scenario: str = "scenario",
) -> DataFrame:
    """Daily summary of the paths: extremes per scenario, then their quantiles."""
    per_path = paths.groupBy(*keys, scenario).agg(
        F.min(price).alias("_min"), F.max(price).alias("_max")
    )
    marks = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
    spread = per_path.groupBy(*keys).agg(
        F.avg((F.col("_min") < 0).cast("double")).alias("probability_any_negative_period"),
        F.percentile("_min", marks).alias("_lo"), F.percentile("_max", marks).alias("_hi"),
    )
    centre = quantiles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("period_count"),
        F.min("p50").alias("p50_daily_min_gbp_mwh"), F.max("p50").alias("p50_daily_max_gbp_mwh"),
        F.avg(F.col("p50").cast("decimal(38,12)")).cast("double").alias("p50_daily_mean_gbp_mwh"),
        F.max("negative_probability").alias("maximum_period_negative_probability"),
    )
    named = {
        f"distribution_daily_{side}_p{p}": F.col(c)[i]
        for side, c in (("min", "_lo"), ("max", "_hi")) for i, p in enumerate((10, 50, 90))
    }
    return centre.join(spread, list(keys)).withColumns(named).drop("_lo", "_hi")


def hashed_draw(seed: int) -> Callable[[Column, Column, Column], Column]:
    """Reproducible error draw: the same under any partitioning or retry."""
    return lambda scenario, ts, n: F.pmod(F.xxhash64(F.lit(seed), scenario, ts), n)


def error_scenarios(
    points: DataFrame, errors: DataFrame, components: Sequence[str], scenarios: int = 1000, seed: int = 42,
    ts: str = "timestamp", error_ts: str = "timestamp", draw: Callable[[Column, Column, Column], Column] | None = None,
    signed=frozenset(K.SIGNED_COMPONENTS),
) -> DataFrame:
    """Joint bootstrap: point plus one whole error row per (scenario, period).

    The scenario table stays long. Complete error rows get a dense index and are joined by
    the drawn index; draws are uniform, so that join has no hot key. Components that cannot
    be negative are clipped at zero.
    """
    if scenarios <= 0:
        raise ValueError("scenarios must be positive")
    complete = errors.dropna(subset=list(components)).select(
        F.col(error_ts).alias("_et"), *[F.col(c).cast("double").alias(f"_e_{c}") for c in components]
    )
    pool = number_rows(complete.withColumn("_all", F.lit(0)), ["_all"], "_et", position="_idx").drop("_all", "_et", "_total")
    size = complete.select(F.count(F.lit(1))).scalar()
    pick = (draw or hashed_draw(seed))(F.col("scenario"), F.col(ts), F.col("_n"))
    long = (
        points.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))))
        .withColumn("_n", size)
        .withColumn("_idx", F.when(F.col("_n") > 0, pick))
    )
    # Every draw has an error row unless there is none at all, so the left join only serves
    # to report that case.
    none = F.raise_error(F.lit("no complete error rows")).cast("double")

    def moved(c):
        value = F.col(c) + F.coalesce(F.col(f"_e_{c}"), none)
        return value if c in signed else non_negative(value)

    return long.join(pool, "_idx", "left").withColumns({c: moved(c) for c in components}).drop("_idx", "_n", *[f"_e_{c}" for c in components])


def daily_error_scenarios(
    points: DataFrame, errors: DataFrame, components: Sequence[str], scenarios: int = 1000, seed: int = 42,
    ts: str = "timestamp", error_ts: str = "timestamp", draw: Callable[[Column, Column, Column], Column] | None = None,
    signed=frozenset(K.SIGNED_COMPONENTS), day: str = "error_date",
) -> DataFrame:
    """Block bootstrap by day: each path takes all its errors of a local day from one observed day.

    Errors of neighbouring periods stay together, which single draws lose. Only days whose
    periods are all complete are drawn from. A day of 46, 48 or 50 periods is laid over one of
    another length in proportion, so every period has an error and their order is kept. ``day``
    names the drawn date of each row. The day is drawn by hash of scenario and date, so the paths
    do not depend on partitions or retries.
    """
    if scenarios <= 0:
        raise ValueError("scenarios must be positive")
    known = errors.dropna(subset=list(components)).select(
        clock.delivery_date(error_ts).alias("_ed"), clock.settlement_period(error_ts).alias("_ep"),
        *[F.col(c).cast("double").alias(f"_e_{c}") for c in components])
    whole = known.groupBy("_ed").agg(F.count_distinct("_ep").alias("_have"), F.count(F.lit(1)).alias("_rows")).where(
        (F.col("_have") == clock.periods_in_day("_ed")) & (F.col("_rows") == F.col("_have")))
    days = number_rows(whole.select("_ed", F.col("_have").cast("int").alias("_en"), F.lit(0).alias("_all")), ["_all"], "_ed", position="_idx").select("_ed", "_en", "_idx")
    size = whole.select(F.count(F.lit(1))).scalar()
    dated = points.withColumns({"_d": clock.delivery_date(ts), "_p": clock.settlement_period(ts)})
    # The draw is made once for each path and date, on a table of dates.
    wanted = dated.select("_d").distinct().withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1)))).withColumn("_n", size)
    pick = (draw or hashed_draw(seed))(F.col("scenario"), F.col("_d"), F.col("_n"))
    drawn = wanted.withColumn("_idx", F.when(F.col("_n") > 0, pick)).join(days, "_idx", "left").select("_d", "scenario", "_ed", "_en")
    place = F.floor((F.col("_p") - 1) * F.col("_en") / clock.periods_in_day("_d")).cast("int") + 1
    long = dated.join(drawn, "_d").withColumn("_ep", place)
    none = F.raise_error(F.lit("no complete error days")).cast("double")

    def moved(c):
        value = F.col(c) + F.coalesce(F.col(f"_e_{c}"), none)
        return value if c in signed else non_negative(value)

    return long.join(known, ["_ed", "_ep"], "left").withColumns({c: moved(c) for c in components}).withColumnRenamed("_ed", day).drop(
        "_d", "_p", "_en", "_ep", *[f"_e_{c}" for c in components])


def energy_and_peaks(
    df: DataFrame, keys: Sequence[str], ts: str, energy: Sequence[str] = (), highs: Sequence[str] = (), lows: Sequence[str] = (),
) -> DataFrame:
    """Daily energy (half-hour power) and extremes with the first time they occur."""
    first = -F.unix_micros(clock.instant(ts))
    out = [(F.sum(c) * 0.5).alias(f"{c}_energy_mwh") for c in energy]
    for c in highs:
        out += [F.max(c).alias(f"peak_{c}"), F.max_by(clock.instant(ts), F.when(F.col(c).isNotNull(), F.struct(F.col(c), first))).alias(f"peak_{c}_at")]
    for c in lows:
        out += [F.min(c).alias(f"minimum_{c}"), F.min_by(clock.instant(ts), F.when(F.col(c).isNotNull(), F.struct(F.col(c), -first))).alias(f"minimum_{c}_at")]
    return df.groupBy(*keys).agg(*out)


def single_sources(df: DataFrame, keys: Sequence[str], components: Sequence[str], name: str = "component_source_{}") -> DataFrame:
    """The one source used for each component, or ``mixed``."""
    long = df.select(*keys, *[F.col(name.format(c)).cast("string").alias(c) for c in components]).unpivot(
        list(keys), list(components), "component", "source"
    )
    low, high = F.min("source"), F.max("source")
    return long.where("source is not null").groupBy(*keys, "component").agg(
        F.when(low == high, low).otherwise("mixed").alias("source")
    )
