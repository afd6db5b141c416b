"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from settlespark.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(taken, name: str) -> str:
    """``name``, or a longer one that is not among the ``taken`` column names."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """A broadcast hint for a table of narrow rows that has been counted, or none beyond the limit."""
    return F.broadcast(df) if rows <= limit else df


def column_texts(column) -> list[str]:
    """Values of an Arrow text column; a null counts as an empty text."""
    return [v or "" for v in column.to_pylist()]


def batches_of(texts: list[str], chars: int = 4_000_000):
    """Index ranges of ``texts`` with about so many characters each, at least one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether the checksum of the id as text falls in the fold; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(text, label)`` of rows that ``keep`` and that have a label; of repeated labels the largest counts."""
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("int").alias("label"))
    rows = docs.where(keep).select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return durable(rows.join(broadcast_if_small(marks, labels.count(), 500_000), "__id").select("text", "label"))
