"""Steps whose tasks and shuffles are bounded by rows, and queries on tables that leave nothing to fit."""

import datetime

import pytest

from fathomgraph.plans import catalog
from fathomgraph.plans import inputs as i


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(1993, 5, 1)
    spark.createDataFrame([(k, f"Brand#{1 + k % 5}", 1 + k) for k in range(6)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(k, day) for k in range(20)], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    lines = [(k, p) for k in range(20) for p in range(6)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    docs = [(k, "one two one\nthree", "en", "a") for k in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    return d


def test_tasks_follow_the_rows(spark, tables, monkeypatch):
    monkeypatch.setattr(i, "MENTION_ROWS", 5)
    assert i.mentions(spark, tables).rdd.getNumPartitions() == 24 and i.mentions(spark, tables).count() == 120
    assert i.edges(spark, tables).rdd.getNumPartitions() == 24
    monkeypatch.setattr(i, "DOCUMENT_ROWS", 2)
    assert i.document_tasks(spark, tables) == 15


def test_an_index_shuffles_texts_once(spark, tables):
    df = catalog.QUERIES["b2_abstract_from_index"](spark, tables)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and {r.abstract for r in df.collect()} == {"one two one\nthree"}


def test_nothing_to_fit_gives_no_scores(spark, tables):
    """All pairs are known early, so no pair is open."""
    assert catalog.QUERIES["j9_impact_scores"](spark, tables).isEmpty() and catalog.QUERIES["j9_impact_auc"](spark, tables).isEmpty()
    rows = catalog.QUERIES["j9_impact_optimality"](spark, tables).collect()
    assert len(rows) == 142 and {(r.coefficient, r.gradient, r.flat) for r in rows} == {(None, None, None)}
