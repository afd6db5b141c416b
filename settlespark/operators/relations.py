"""Joins with stated cardinality, key guards, pivots and row alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from settlespark.errors import GuardError, need_columns
from settlespark.functions.values import row_sum


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def duplicate_flags(df: DataFrame, keys: Sequence[str], flag: str = "is_duplicate") -> DataFrame:
    """Mark every member of a duplicated key.

    Counts are aggregated first and joined back, so no key is gathered into a window.
    """
    repeated = duplicate_keys(df, keys).select(*keys, F.lit(True).alias(flag))
    return df.join(repeated, list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def require_unique(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    repeated = duplicate_keys(df, keys)
    if not repeated.isEmpty():
        raise GuardError(f"{label} repeats key {repeated.first().asDict()}")
    return df


def conflicting_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated keys whose other columns differ.

    Equal smallest and largest row means equal rows; both combine on the map side.
    """
    rest = F.struct(*[F.col(c) for c in df.columns if c not in set(keys)])
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("row_count"), F.min(rest).alias("_lo"), F.max(rest).alias("_hi"))
        .where((F.col("row_count") > 1) & ~F.col("_lo").eqNullSafe(F.col("_hi")))
        .select(*keys, "row_count")
    )


def require_no_conflicts(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    bad = conflicting_rows(df, keys)
    if not bad.isEmpty():
        raise GuardError(f"{label} has conflicting rows at {bad.first().asDict()}")
    return df


def join_one_to_one(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", check: bool = True,
) -> DataFrame:
    """Equi-join that refuses repeated keys on either side."""
    if check:
        require_unique(left, on, "left side")
        require_unique(right, on, "right side")
    return left.join(right, list(on), how)


def join_many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], check: bool = True) -> DataFrame:
    """Left join that refuses repeated keys on the right side."""
    return left.join(require_unique(right, on, "right side") if check else right, list(on), "left")


def outer_merge(frames: Sequence[DataFrame], on: Sequence[str], check: bool = True) -> DataFrame:
    """Full outer merge of many tables with one shuffle.

    The tables are stacked and folded by key, which replaces a chain of full joins.
    """
    on = list(on)
    if check:
        for f in frames:
            require_unique(f, on, "outer merge input")
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    rest = [c for c in stacked.columns if c not in on]
    return stacked.groupBy(*on).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest])


def sum_by_category(
    df: DataFrame, keys: Sequence[str], category: str, value: str, categories: Sequence[str],
    name: str = "{}", fill: float | None = None,
) -> DataFrame:
    """One summed column per category, with the categories stated up front.

    A stated list keeps the schema stable and spares the job that would look them up. A row
    of a category that is not listed is an error that names it; rows without one are left out.
    """
    sums = [
        listed_only(category, categories, F.sum(F.when(F.col(category) == c, F.col(value)))).alias(name.format(c)) for c in categories
    ]
    wide = df.groupBy(*keys).agg(*sums)
    return wide if fill is None else wide.fillna(fill, [name.format(c) for c in categories])


def listed_only(category: str, categories: Sequence[str], aggregate: Column) -> Column:
    """``aggregate``, or an error if the group holds a category that is not listed."""
    known = F.col(category).isin(list(categories)) if categories else F.lit(False)
    other = F.max(F.when(~known, F.col(category).cast("string")))
    message = F.concat(F.lit(f"{category} not among the listed ones: "), other)
    # Cast as the aggregate: null of its type where the error is, never reached otherwise.
    return F.when(other.isNull(), aggregate).otherwise(F.when(F.raise_error(message).cast("boolean"), aggregate))


def distinct_categories(df: DataFrame, category: str) -> list[str]:
    """Category values for a pivot. Each becomes a column, so their number is the table's width."""
    return sorted(r[0] for r in df.select(category).where(F.col(category).isNotNull()).distinct().toLocalIterator())


def signed_by_technology(
    generation: DataFrame, mapping: DataFrame, technologies: Sequence[str],
    keys: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """Signed output per technology and period from reviewed unit mappings.

    The mapping is summed per unit and time by map-side aggregation; Spark broadcasts it
    only when its size allows.
    """
    need_columns(generation, [*keys, "bm_unit", "generation_mw"], "unit generation")
    need_columns(mapping, ["bm_unit", "technology", "sign"], "unit mapping")
    if "battery" not in technologies:
        raise GuardError("the mapping must name battery units")
    signed = generation.select(*keys, "bm_unit", "generation_mw").join(
        mapping.select("bm_unit", "technology", F.col("sign").cast("double").alias("sign")), "bm_unit"
    ).withColumn("signed_mw", F.col("generation_mw") * F.col("sign"))
    return sum_by_category(signed, keys, "technology", "signed_mw", technologies, "{}_net_mw", 0.0)


def require_reviewed_mapping(mapping: DataFrame) -> DataFrame:
    """Refuse a mapping that still has placeholder units or no battery."""
    facts = mapping.agg(
        F.count_if(F.col("bm_unit").startswith("REPLACE_")).alias("placeholders"),
        F.count_if(F.col("technology") == "battery").alias("batteries"),
    ).first()
    if facts.placeholders:
        raise GuardError("unit mapping still has placeholder units")
    if not facts.batteries:
        raise GuardError("unit mapping names no battery")
    return mapping


def technology_output(
    generation: DataFrame, mapping: DataFrame, technology: str, sign: float = 1.0,
    keys: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """Summed output of the units mapped to one technology."""
    need_columns(mapping, ["bm_unit", "technology"], "unit mapping")
    units = mapping.where(F.lower("technology") == technology.lower()).select("bm_unit")
    return (
        generation.join(units, "bm_unit").groupBy(*keys)
        .agg((F.sum("generation_mw") * F.lit(float(sign))).alias("generation_mw"))
    )


def directional_flows(
    inbound: DataFrame, outbound: DataFrame, prefix: str, value: str = "flow_mw",
    keys: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """Import, export and net flow per time; a missing direction counts as zero."""
    both = outer_merge(
        [inbound.select(*keys, F.col(value).alias(f"{prefix}_import_mw")),
         outbound.select(*keys, F.col(value).alias(f"{prefix}_export_mw"))],
        keys, check=False,
    ).fillna(0.0, [f"{prefix}_import_mw", f"{prefix}_export_mw"])
    net = F.col(f"{prefix}_import_mw") - F.col(f"{prefix}_export_mw")
    return both.withColumn(f"{prefix}_net_import_mw", net)


def total_net_import(frames: Sequence[DataFrame], on: Sequence[str] = ("timestamp",), out="net_import_mw") -> DataFrame:
    """Outer merge of borders and the sum of their net imports, gaps as zero."""
    merged = outer_merge(frames, on, check=False)
    nets = [c for c in merged.columns if c.endswith("_net_import_mw")]
    return merged.fillna(0.0, nets).withColumn(out, row_sum(nets, null_as_zero=True))


def alignment_faults(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys whose row counts differ between two tables."""
    sides = left.select(*on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*on, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return (
        sides.groupBy(*on).agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
        .where("left_rows <> right_rows")
    )


def require_aligned(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    bad = alignment_faults(left, right, on)
    if not bad.isEmpty():
        raise GuardError(f"tables do not align at {bad.first().asDict()}")


def column_from_first(tables: dict[str, DataFrame], column: str, key: str = "timestamp") -> DataFrame:
    """``key`` and ``column`` from the first table that has both; schema lookup only."""
    for table in tables.values():
        if {key, column} <= set(table.columns):
            return table.select(key, column)
    raise KeyError(f"no table has column {column}")
