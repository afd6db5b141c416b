"""An index of landed payload files by the delivery dates they hold, so that a reader opens only files it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from settlespark.sources import records as src
from settlespark.sources.tables import read_if_present

LANDED = "payload string, source string, landed_date date"


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file)`` of a landing; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("file"))


def delivery_day():
    """Delivery date of a record under any of its spellings; null if it is no date."""
    return F.coalesce(src.field("date"), F.col("rec")["date"]).try_cast("date")


def index_landing(spark: SparkSession, path: str, index: str) -> int:
    """Add files of a landing that the index does not know yet, with first and last delivery date and record counts; how many.

    Landed files never change, so a file is parsed once for the index. A file without readable
    records has no dates, and one that holds records without a date is read for any window.
    """
    known, files = read_if_present(spark, index), listed_files(spark, path)
    fresh = files if known is None else files.join(known.select("file"), "file", "left_anti")
    names = [r.file for r in fresh.collect()]  # a listing, as the reader itself keeps one
    if names:
        payloads = spark.read.schema("payload string").json(names).select(F.col("_metadata.file_path").alias("file"), "payload")
        recs = src.records(payloads, keep=["file"], strict=False).withColumn("_day", delivery_day())
        facts = recs.groupBy("file").agg(
            F.min("_day").alias("first_delivery"), F.max("_day").alias("last_delivery"),
            F.count(F.lit(1)).alias("records"), F.count_if(F.col("_day").isNull()).alias("undated_records"))
        every = spark.createDataFrame([(n,) for n in names], "file string").join(facts, "file", "left").fillna(0, ["records", "undated_records"])
        every.write.mode("append").parquet(index)
    return len(names)


def read_window(spark: SparkSession, path: str, index: str, first: str, end: str) -> DataFrame:
    """Landed payloads of the files that may hold deliveries in ``[first, end)``: indexed ones whose dates meet the window, and new ones.

    Files whose dates lie outside are not opened. Records still have to be filtered, see
    ``records.in_date_window``.
    """
    files, known = listed_files(spark, path), read_if_present(spark, index)
    if known is not None:
        a, z = F.lit(first).cast("date"), F.lit(end).cast("date")
        meets = (F.col("last_delivery") >= a) & (F.col("first_delivery") < z) | (F.col("undated_records") > 0)
        useless = known.where(~F.coalesce(meets, F.lit(False))).select("file")
        files = files.join(useless, "file", "left_anti")
    names = [r.file for r in files.collect()]
    if not names:
        return spark.createDataFrame([], LANDED)
    return spark.read.schema(LANDED).option("basePath", path).json(names)
