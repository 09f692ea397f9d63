"""Every query of the library against its SQL on DuckDB, plans, and the entry point."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from chunkspark.functions import layout
from chunkspark.functions.layout import spread
from chunkspark.operators import CharacterSplitter, ParagraphSplitter, RecursiveCharacterSplitter, WordSplitter
from chunkspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame, columns):
    return sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, views, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), views.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_query_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("splitter", [CharacterSplitter(500, 50), WordSplitter(50, 10), ParagraphSplitter(3), RecursiveCharacterSplitter(800, 80)])
def test_splitters_do_not_shuffle(spark, splitter):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("CAST(doc_id AS STRING) AS document_id", "text")
    assert "Exchange" not in splitter.transform(docs)._jdf.queryExecution().executedPlan().toString()


def test_only_small_inputs_are_dealt_out(spark, monkeypatch):
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan(spread(small, "doc_id"))
    monkeypatch.setattr(layout, "SMALL", 1000)
    assert "Exchange" not in plan(spread(small, "doc_id"))


@pytest.mark.parametrize("name", ["word_overlap", "recursive_split", "semantic_split"])
def test_chunks_are_computed_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(" if name == "word_overlap" else "ArrowEvalPython") == 1


def test_only_needed_columns_are_read(spark):
    plan = catalog.QUERIES["character_overlap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
