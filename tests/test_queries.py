"""Every query with an SQL twin must match it on the smallest tables; the rest must run."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, compare

PATH = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"platform_forecast"}))
def test_matches_sql(spark, db, name):
    verdict = compare(name, QUERIES[name](spark, PATH).toPandas(), db.execute(ORACLES[name]).df())
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"platform_forecast"}))
def test_runs_without_sql_twin(spark, name):
    assert QUERIES[name](spark, PATH).count() > 0


def test_platform_forecast_end_to_end(spark, db):
    # The query folds worst loss >= shortfall >= VaR, and the order of quantiles, to facts of each day.
    rows = QUERIES["platform_forecast"](spark, PATH).toPandas()
    assert compare("platform_forecast", rows, db.execute(ORACLES["platform_forecast"]).df()).startswith("ok")
    assert len(rows) and (rows.extremes_in_order & rows.tail_beyond_var & (rows.ordered_quantiles == rows.periods)).all()


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "model_mae_gbp_mwh" in df.columns
