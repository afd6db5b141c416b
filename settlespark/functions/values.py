"""Coercion, null-aware arithmetic, comparison and text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from settlespark.functions.clock import col, utc_text


def number(c) -> Column:
    """Numeric value of a column; unreadable text and NaN become null."""
    v = col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def boolean(c) -> Column:
    """``true/false/1/0`` in any case; anything else is null."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def non_negative(c) -> Column:
    """Clip at zero, keeping nulls."""
    return F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(0.0)))


def row_sum(columns, null_as_zero: bool = False) -> Column:
    """Sum across columns. By default null only when every part is null."""
    parts = [col(c) for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return total if null_as_zero else F.when(F.coalesce(*parts).isNotNull(), total)


def improvement_percent(model_mae, base_mae) -> Column:
    """Gain over a baseline; null when the baseline is null or zero."""
    base = F.nullif(col(base_mae), F.lit(0.0))
    return F.lit(100.0) * (base - col(model_mae)) / base


def close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Tolerant double equality; two nulls are equal."""
    x, y = col(a), col(b)
    near = (x == y) | (F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y))
    return (x.isNull() & y.isNull()) | F.coalesce(near, F.lit(False))


def same_value(a, b, dtype: str) -> Column:
    """Equality used for change detection: tolerant on floats, null-safe otherwise."""
    return close(a, b) if dtype in ("double", "float") else col(a).eqNullSafe(col(b))


def forecast_id(model="model_version", issue="issue_time_utc", delivery="delivery_time_utc") -> Column:
    return F.concat_ws("|", col(model).cast("string"), utc_text(issue), utc_text(delivery))


def masked_secrets(message) -> Column:
    """Hide what follows a name ending in token and a colon or equals sign, up to white space or the next parameter."""
    return F.regexp_replace(col(message), r"(?i)(\w*token\s*[=:]\s*)[^&\s]+", "$1***")


def redacted(message, max_chars: int = 500) -> Column:
    """Mask secrets in the whole text, squeeze white space, cut to report length."""
    squeezed = F.trim(F.regexp_replace(masked_secrets(message), r"\s+", " "))
    return F.substring(squeezed, 1, max_chars)


def figure(c, decimals: int = 2, suffix: str = "") -> Column:
    """Number with thousands separators, or a dash for null; ``nan``, ``inf`` and ``-inf`` as such."""
    number = col(c).cast("double")
    odd = F.isnan(number) | (F.abs(number) == float("inf"))
    text = F.when(odd, F.lower(F.replace(number.cast("string"), F.lit("Infinity"), F.lit("inf")))).otherwise(F.format_number(number, decimals))
    return F.coalesce(F.concat(text, F.lit(suffix)), F.lit("—"))


def sorted_map_json(c) -> Column:
    """JSON text of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(c)))))


def json_row(*columns) -> Column:
    """JSON text of columns with explicit nulls."""
    return F.to_json(F.struct(*[col(c) for c in columns]), {"ignoreNullFields": "false"})


def plain_names(df: DataFrame) -> DataFrame:
    """Lower-case column names with underscores for blanks and hyphens."""
    return df.toDF(*[c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns])


def prefixed(df: DataFrame, prefix: str, keep) -> DataFrame:
    """Prefix every value column with its group."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in set(keep)})


def resolve_column(df: DataFrame, aliases, label: str) -> str:
    """The table's spelling of the first alias it has, ignoring case."""
    wanted = [a.lower() for a in aliases]
    found = sorted((wanted.index(c.lower()), c) for c in df.columns if c.lower() in wanted)
    if not found:
        raise KeyError(f"no column for {label}; looked for {list(aliases)}")
    return found[0][1]
