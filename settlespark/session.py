"""Session settings the library relies on, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def utc_session(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC: instants are stored and compared in UTC only."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: str | int = "*", app: str = "settlespark", memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark. Clusters bring their own settings.

    HotSpot never compiles a method above 8,000 bytecodes. Wide parsing projections exceed
    that as one generated stage and then run interpreted, several times slower; with the
    limit Spark generates such stages operator by operator instead.
    """
    parallelism = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return utc_session(spark)


def shared_root(spark: SparkSession) -> str:
    """The shared folder for durable intermediates (``spark.checkpoint.dir``).

    Only a local master may fall back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="settlespark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so that later jobs do not recompute it.

    The table lies in the shared folder and outlives lost executors.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, jobs: dict[str, Callable[[], object]], parallelism: int = 4) -> dict:
    """Run independent Spark jobs together: small ones do not wait for each other's last task. Results by name."""
    with ThreadPool(parallelism) as pool:
        run = inheritable_thread_target(spark)(lambda job: job())
        return dict(zip(jobs, pool.map(run, jobs.values())))
