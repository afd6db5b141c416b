"""Registered corpus queries: SQL twins, fit on the smallest tables, and the pipeline's stages."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from check_queries import TABLES, compare  # noqa: E402
import corpus_pipeline  # noqa: E402
from settlespark.llm.queries import ORACLES, QUERIES  # noqa: E402

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    ours = QUERIES[name](spark, PATH).toPandas()
    if name in ORACLES:
        assert compare(name, ours, db.execute(ORACLES[name]).df()).startswith("ok")
    table = {"op7": "pages", "op9": "pages", "op12": "(SELECT DISTINCT conv_id FROM conversations)"}.get(name.split("_")[0], "documents")
    if not name.startswith("op11"):  # a row for each word
        assert len(ours) == db.execute(f"SELECT count(*) FROM {table}").fetchone()[0]


def test_pipeline_keeps_columns_and_takes_out_what_each_stage_finds(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, PATH)
        assert name == "sharding" or out.columns == columns
        docs, before, count = out.cache(), count, out.count()
        assert 0 < count <= before and (name != "sharding" or count == before)
    assert docs.select("shard").distinct().count() <= 8
    empty = spark.read.parquet(f"{PATH}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, PATH).count() == 0
