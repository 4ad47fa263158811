"""Positions of texts become rows only where a gram of the dictionary can begin, and none of those is lost."""

import pytest
from fathomgraph.operators import anchors, grams, match
from pyspark.sql import functions as F

TEXTS = [(1, "deep nets of deep graphs"), (2, "日本 and ünï, 日本"), (3, None), (4, ""), (5, "😀graph😀 " * 40), (None, "a net"), (7, "gra"), (1, "graph")]


@pytest.mark.parametrize("piece,lead", [(32, 0), (5, 0), (7, 2)])
def test_held_places_are_those_of_plain_loops(spark, monkeypatch, piece, lead):
    monkeypatch.setattr(grams, "BATCH_ROWS", 3)
    wanted = ["deep", "graph", "日本", "net"]
    texts = spark.createDataFrame(TEXTS, "doc long, text string")
    bits = grams.gram_map(spark.createDataFrame([(w,) for w in [*wanted, None, ""]], "_gram string"))
    got = grams.held_places(texts, "doc", F.col("text"), [2, 3, 4, 5], bits, piece, 20, lead).collect()
    assert sum(r["_gram"] not in wanted for r in got) < 3  # bits that another gram has set
    want = [
        (d, p // piece, t[p // piece * piece :][:20], p % piece, w)
        for d, t in TEXTS if t for w in wanted for p in range(len(t) - lead) if t.startswith(w, p + lead)
    ]
    assert sorted((tuple(r) for r in got if r["_gram"] in wanted), key=str) == sorted(want, key=str)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("occurrences", [match.occurrences, anchors.anchored_occurrences])
def test_positions_are_not_exploded_before_they_are_held(spark, occurrences):
    texts = spark.createDataFrame(TEXTS, "doc long, text string")
    words = spark.createDataFrame([(0, "deep graph"), (1, "graph"), (2, "日本 and")], "concept_id int, concept string")
    df = occurrences(texts, words, "doc", "text")
    assert "explode" not in plan(df)
    got = sorted((r["concept_id"], r["doc"], r["start"]) for r in df.collect())
    assert got == sorted([(0, 1, 13), (1, 1, 18), (2, 2, 0), (1, 1, 0)] + [(1, 5, 1 + 8 * k) for k in range(40)])
