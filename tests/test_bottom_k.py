"""Samples and splits by cells of a random key, against those that sort the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from fathomgraph.operators import bottom_k, evaluate


def table(spark, n):
    return spark.range(n).select((F.col("id") * 7).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("label"))


@pytest.mark.parametrize("n", [0, 1, 777, 4999, 5000, 9000])
def test_takes_the_rows_of_the_sorted_sample(spark, n):
    df = table(spark, 5000)
    got = sorted(map(tuple, bottom_k.bottom_k(df, n, 3, ["k"]).collect()))
    assert got == sorted(map(tuple, evaluate.exact_sample(df, n, 3, ["k"]).collect())) and len(got) == min(n, 5000)


@pytest.mark.parametrize("share", [0.0, 0.37, 0.85, 1.0])
def test_split_is_that_of_the_sorted_table(spark, share):
    df = table(spark, 3001)
    got = sorted(map(tuple, bottom_k.split_per_class(df, "label", 5, ["k"], share).collect()))
    assert got == sorted(map(tuple, evaluate.split_per_class(df, "label", 5, ["k"], share).select("k", "label", "part").collect()))


def test_few_cells_mean_larger_edges_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(bottom_k, "DIGITS", 1)
    df = table(spark, 2000)
    got = sorted(map(tuple, bottom_k.bottom_k(df, 555, 9, ["k"]).collect()))
    assert got == sorted(map(tuple, evaluate.exact_sample(df, 555, 9, ["k"]).collect()))


def test_subsets_keep_all_positives(spark):
    df = table(spark, 900)
    all_rows = bottom_k.two_class_subsets(df, "label", 1, ["k"])
    assert all_rows.count() == 900
    cut = bottom_k.two_class_subsets(df, "label", 1, ["k"], limit=100)
    assert {r["label"]: r["count"] for r in cut.groupBy("label").count().collect()} == {0: 300, 1: 300}


def test_the_table_is_not_shuffled_and_only_edge_cells_are_ranked(spark, monkeypatch, tmp_path):
    table(spark, 50_000).write.parquet(f"{tmp_path}/t")
    ranked = []
    with_rank = bottom_k.with_rank

    def spy(df, *args, **kw):
        ranked.append(df.count())
        return with_rank(df, *args, **kw)

    monkeypatch.setattr(bottom_k, "with_rank", spy)
    out = bottom_k.split_per_class(spark.read.parquet(f"{tmp_path}/t"), "label", 2, ["k"])
    assert out.count() == 50_000 and 2 <= ranked[0] <= 30  # two classes, one cell each
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_nulls_repeats_and_an_empty_table(spark):
    rows = [(k, label) for k in (1, 2, None) for label in (0, 1, None)] + [(4, 1)] * 40
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, label int")
    assert bottom_k.bottom_k(df, 17, 1, ["k"]).count() == 17
    out = bottom_k.split_per_class(df, "label", 1, ["k"], 0.5).collect()
    assert len(out) == len(rows)
    for label, n in ((0, 3), (1, 43), (None, 3)):
        assert sum(r["label"] == label and r["part"] == "train" for r in out) == n // 2
    none = df.limit(0)
    assert bottom_k.bottom_k(none, 5, 1, ["k"]).count() == 0 and bottom_k.split_per_class(none, "label", 1, ["k"]).count() == 0
