"""Rare anchors give the hits of the prefix join, and a long concept costs nothing but itself."""

import random

import pytest
from fathomgraph.operators import anchors, match
from pyspark.sql import functions as F


def places(df):
    return sorted((r["doc"], r["concept_id"], r["start"]) for r in df.collect())


def plain(texts, concepts, whole_words):
    out = []
    for doc, text in texts:
        for k, c in concepts:
            at = (text or "").find(c) if text else -1
            while at >= 0:
                before, after = text[:at][-1:], text[at + len(c) :][:1]
                edge = lambda x: x == "" or x in " .,()"
                if not whole_words or edge(before) and edge(after):
                    out.append((doc, k, at))
                at = text.find(c, at + 1)
    return sorted(out)


def sample(seed, n=40):
    rng = random.Random(seed)
    words = ["graph", "graphs", "net", "neural", "of", "deep", "ab", "ünï", "日本", "x"]
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 80))) + rng.choice(["", ".", " (graph)"])) for k in range(n)]
    texts += [(n, None), (n + 1, ""), (n + 2, "graph"), (n + 3, "x" * 200)]
    concepts = ["graph", "neural net", "net of deep", "ab", "日本", "deep", "x x", "of graph net", texts[5][1][3:60], texts[7][1][:120], "xxxx", "graph never there " * 9]
    return texts, [(k, c.strip()) for k, c in enumerate(concepts) if c.strip()]


@pytest.mark.parametrize("seed,whole_words,bound,share", [(1, False, 500_000, 1.0), (2, True, 500_000, 0.0), (3, False, 0, 0.3), (4, True, 0, 0.1)])
def test_equals_search_by_loops(spark, seed, whole_words, bound, share):
    texts, concepts = sample(seed)
    t, d = spark.createDataFrame(texts, "doc int, text string"), spark.createDataFrame(concepts, "concept_id int, concept string")
    got = anchors.anchored_occurrences(t, d, "doc", "text", whole_words=whole_words, broadcast_rows=bound, share=share)
    assert places(got) == plain(texts, concepts, whole_words)
    long_enough = [(k, c) for k, c in concepts if len(c) >= 4]
    d = spark.createDataFrame(long_enough, "concept_id int, concept string")
    assert places(anchors.anchored_occurrences(t, d, "doc", "text", whole_words=whole_words)) == places(match.occurrences(t, d, "doc", "text", whole_words=whole_words))


def test_a_long_concept_widens_no_piece(spark):
    texts, concepts = sample(5)
    long = " ".join(f"word{k}" for k in range(800))[:5000]
    texts.append((99, f"before {long} after"))
    t = spark.createDataFrame(texts, "doc int, text string")
    figures = []
    for extra in ([], [(50, long)]):
        d = spark.createDataFrame([(k, c) for k, c in concepts if len(c) >= 4] + extra, "concept_id int, concept string")
        got = places(anchors.anchored_occurrences(t, d, "doc", "text"))
        assert [g for g in got if g[1] == 50] == ([(99, 50, 7)] if extra else [])
        keys = anchors.anchored(d, anchors.gram_frequencies(t, "doc", "text", 4, 1.0), 4)
        probes = anchors.probe_rows(t, "doc", "text", [4])
        held = anchors.passing(probes, anchors.anchor_map(keys))
        figures.append((*probes.agg(F.count("*"), F.sum(F.length("_piece"))).first(), held.count()))
    assert figures[0][:2] == figures[1][:2] and figures[1][2] <= figures[0][2] + 40
    assert figures[0][2] * 3 < figures[0][0]  # the map drops most positions before the join


def test_the_rarest_gram_is_the_anchor(spark):
    texts = spark.createDataFrame([(k, "common prefix everywhere") for k in range(50)] + [(60, "common prefix zebra")], "doc int, text string")
    d = spark.createDataFrame([(1, "common prefix zebra")], "concept_id int, concept string")
    row = anchors.anchored(d, anchors.gram_frequencies(texts, "doc", "text", 5, 1.0), 5).first()
    assert row["_offset"] >= 10 and row["_gram"] == "common prefix zebra"[row["_offset"] : row["_offset"] + 5]
