"""Queries on tables that hold more events a period, or odder values, than the shared test tables."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from check_queries import compare  # noqa: E402
from settlespark.functions import values  # noqa: E402


def held_against_its_sql(spark, name, folder, **tables):
    db = duckdb.connect()
    for table, df in tables.items():
        df.to_parquet(folder / f"{table}.parquet", coerce_timestamps="us")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder / table}.parquet'")
    found = entry.queries()[name](spark, str(folder)).toPandas()
    assert len(found)
    verdict = compare(name, found, db.execute(entry.oracle_sql()[name]).df())
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


@pytest.fixture
def dense():
    """Sixty events in each half-hour of four days, the kinds in turn: every period has much of each."""
    n = 4 * 48 * 60
    i = np.arange(n)
    return pd.DataFrame({
        "event_id": i, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(i * 30 + 7, unit="s"), "user_id": i % 50,
        "event_type": np.array(["click", "view", "purchase", "signup", "error"])[i % 5],
        "value": np.round(40 + 30 * np.sin(i / 900) + i * 7919 % 1000 / 100, 2), "props": "{}",
    })


def test_curtailment_has_both_kinds_in_dense_tables(spark, tmp_path, dense):
    held_against_its_sql(spark, "curtailment_forecast", tmp_path, events=dense)


def test_marginal_technology_in_dense_tables(spark, tmp_path, dense):
    held_against_its_sql(spark, "marginal_technology", tmp_path, events=dense)


def test_marginal_technology_of_one_class(spark, tmp_path, dense):
    """Periods that are all alike have one class; the others have no chance."""
    held_against_its_sql(spark, "marginal_technology", tmp_path, events=dense.assign(value=50.0))


def test_collected_core_with_several_rows_of_one_time_in_a_chunk(spark, tmp_path, dense):
    held_against_its_sql(spark, "collected_core", tmp_path, events=dense)


def test_figures_of_odd_balances(spark, tmp_path):
    odd = pd.Series([-0.0, 0.0, -0.004, 0.25, 2.675, 1234567.891, None, np.inf, -np.inf], dtype="float64")
    customers = pd.DataFrame({"c_custkey": np.arange(9), "c_acctbal": odd})
    held_against_its_sql(spark, "number_figures", tmp_path, customer=customers)
    not_a_number = spark.sql("SELECT double('NaN') AS x")
    assert not_a_number.select(values.figure("x", 0, "%")).first()[0] == "nan%"


def test_modelling_table_keeps_periods_without_a_forecast(spark, tmp_path, dense):
    held_against_its_sql(spark, "modelling_table", tmp_path, events=dense)
    rows = entry.queries()["modelling_table"](spark, str(tmp_path)).toPandas()
    assert len(rows) == 4 * 48 and rows.embedded_wind_mw.isna().sum() == 2 * 48


def test_documents_are_parsed_by_all_cores_and_not_joined(spark, tmp_path, dense):
    from settlespark.workload import ingest_queries
    from settlespark.workload.registry import Tables
    dense.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    docs = ingest_queries.xml_documents(Tables(spark, str(tmp_path)))
    assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for name in ("xml_prices", "xml_flows", "xml_schedules", "border_prices"):
        plan = entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "max_by" not in plan and plan.count("from_xml") <= 1
