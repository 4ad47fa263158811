"""The best open pairs against all pairs by loops, and how few of them are looked at."""

import random

import pytest
from fathomgraph.functions.dates import day_offset
from fathomgraph.operators import best_pairs, graph
from pyspark.sql import functions as F


def adjacency(spark, edges):
    days = spark.createDataFrame([(a, b, "1996-01-01") for a, b in edges] + [(-5, -6, "1999-01-01")], "v1 int, v2 int, d string")
    return graph.adjacency(days.select("v1", "v2", day_offset(F.to_date("d")).alias("first_day")))


def plain(edges, k):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for a in near:
        for b in near:
            if a < b and b not in near[a] and near[a] & near[b]:
                out.append((-len(near[a] & near[b]) / len(near[a] | near[b]), a, b))
    return [(a, b, -s) for s, a, b in sorted(out)[:k]], len(out)


def got(df):
    return [(r["v1"], r["v2"], r["score"]) for r in df.collect()]


def communities(seed, groups=60, size=8, outer=40):
    rng = random.Random(seed)
    edges = set()
    for g in range(groups):
        hubs = [1000 + g * 3 + j for j in range(3)]
        for v in range(g * size, (g + 1) * size):
            edges |= {(v, h) for h in hubs if rng.random() < 0.9}
            edges |= {(v, 5000 + rng.randrange(outer)) for _ in range(rng.randrange(4))}
    return sorted(edges)


GRAPHS = {
    "star": [(0, v) for v in range(1, 60)],
    "path": [(v, v + 1) for v in range(40)],
    "loops": [(1, 1), (1, 2), (2, 2), (3, 3), (3, 4), (5, 4), (5, 5), (2, 6), (6, 7)],
    "complete": [(a, b) for a in range(12) for b in range(a + 1, 12)],
    "two_parts": [(a, b) for a in range(6) for b in range(10, 17)],
    "one_edge": [(1, 2)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_small_graphs(spark, name):
    edges = sorted(set(GRAPHS[name]))
    want, _ = plain(edges, 10)
    assert got(best_pairs.best_open_pairs(adjacency(spark, edges), 1997, 10)) == want


@pytest.mark.parametrize("seed,k,start", [(1, 1, 0.9), (2, 25, 0.3), (3, 2000, 0.8)])
def test_random_graphs(spark, seed, k, start):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(70), 2))) for _ in range(220)})
    want, _ = plain(edges, k)
    assert got(best_pairs.best_open_pairs(adjacency(spark, edges), 1997, k, start)) == want


def test_prune_looks_at_few_pairs(spark):
    edges = communities(4)
    want, open_ = plain(edges, 20)
    report = []
    assert got(best_pairs.best_open_pairs(adjacency(spark, edges), 1997, 20, report=report)) == want
    assert open_ > 5000 and sum(n for _, n in report) * 5 < open_, (report, open_)


def test_candidates_hold_every_pair_above_the_threshold(spark):
    edges = communities(5, groups=20)
    adj = adjacency(spark, edges)
    classes, _ = best_pairs.neighbour_classes(adj, 1997)
    postings = best_pairs.posted_neighbours(adj, 1997, classes)
    reps = {r["rep"] for r in classes.collect()}
    pairs, _ = plain(edges, 10**9)
    for t in (0.9, 0.6, 0.35):
        found = {tuple(r) for r in best_pairs.candidates(postings, t, block=3).collect()}
        assert {(a, b) for a, b, s in pairs if s >= t and a in reps and b in reps} <= found


def test_packed_open_pairs_equal_listed_ones(spark):
    edges = communities(6, groups=12) + [(200, 200), (63, 64), (127, 128), (-3, 70)]
    adj = adjacency(spark, edges)
    seen = adj.select(F.least("src", "dst").alias("v1"), F.greatest("src", "dst").alias("v2"), "first_day").distinct()
    listed = graph.unconnected_pairs(graph.sharing_pairs(adj, 1997), graph.connected_pairs(seen, 1997))
    for block in (2, 4096):
        packed = graph.open_sharing_pairs(adj, 1997, block=block)
        assert packed.schema["v2"].dataType == adj.schema["dst"].dataType
        assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, listed.collect()))
    assert graph.open_sharing_pairs(adj, 1997, 2000).count() == graph.unconnected_pairs(graph.sharing_pairs(adj, 1997), graph.connected_pairs(seen, 2000)).count()
