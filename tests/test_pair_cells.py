"""The best pairs counted in cells against all pairs by loops, and that a sparse graph without likeness lists no pairs."""

import glob
import os
import random

import pytest
from fathomgraph.operators import best_pairs, pair_cells
from fathomgraph.session import durable
from pyspark.sql import functions as F
from test_best_pairs import GRAPHS, adjacency, communities, got, plain


def sparse(seed, n=400, degree=12):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(n * degree // 2)})


@pytest.mark.parametrize("edges,k,step", [(sparse(1), 50, 500), (sparse(2), 3000, 7), (communities(3, 20), 40, 2_000_000), (GRAPHS["two_parts"], 10, 3), (GRAPHS["loops"], 10, 1)])
def test_cells_equal_loops(spark, monkeypatch, edges, k, step):
    monkeypatch.setattr(pair_cells, "STEP", step)
    monkeypatch.setattr(best_pairs, "LISTED", 0)
    report = []
    want, _ = plain(edges, k)
    assert got(best_pairs.best_open_pairs(adjacency(spark, edges), 1997, k, report=report)) == want
    assert [n for _, n in report] == [0]


def test_no_pairs_are_listed_where_prefixes_prune_nothing(spark):
    edges = sparse(4, 300, 40)
    want, open_ = plain(edges, 20)
    report = []
    assert got(best_pairs.best_open_pairs(adjacency(spark, edges), 1997, 20, report=report)) == want
    assert open_ > 30_000 and sum(n for _, n in report) < 1000, (report, open_)


def blown_up(edges):
    """Vertices in twins with equal neighbours, numbers that need eight bytes, and two hubs."""
    far = 1 << 40
    more = [(a, far + b) for a, b in edges if a % 3] + [(a, b) for a, b in edges if a % 2] + [(far, v) for v in range(90)]
    return sorted({(min(e), max(e)) for e in more + [(-7, v) for v in range(0, 60, 2)]})


@pytest.mark.parametrize("edges,k", [(sparse(5, 150, 10), 60), (communities(7, 12), 30), (blown_up(sparse(6, 120, 8)), 80), (blown_up(sparse(7, 60, 6)), 5000), (GRAPHS["loops"], 10), (GRAPHS["star"], 10)])
def test_any_number_of_blocks_equals_loops(spark, monkeypatch, edges, k):
    monkeypatch.setattr(pair_cells, "STEP", 300)
    monkeypatch.setattr(pair_cells, "PACKED", 64)
    adj = long_adjacency(spark, edges)
    want, _ = plain(edges, k)
    for items in (10**6, 400):
        monkeypatch.setattr(pair_cells, "BLOCK_ITEMS", items)
        assert got(best_pairs.best_open_pairs(adj, 1997, k)) == want


def long_adjacency(spark, edges):
    rows = [(a, b, 0) for a, b in edges] + [(b, a, 0) for a, b in edges if a != b]
    return spark.createDataFrame(rows, "src long, dst long, first_day int")


def test_sets_are_written_once_whatever_the_blocks(spark):
    """A round reads the sets and shuffles only the best pairs of its tasks."""
    edges = sparse(8, 200, 10)
    sets = pair_cells.packed_sets(long_adjacency(spark, edges).select("src", "dst"), block_items=100)
    assert sets.count() == len({v for e in edges for v in e}) and sets.select("_block").distinct().count() > 5
    assert sets.agg({"size": "sum"}).first()[0] == 2 * len(edges)
    plan = sets.filter("_block >= 3").mapInArrow(lambda batches: batches, sets.schema)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_prefixes_are_posted_where_neighbours_are_many(spark, monkeypatch):
    monkeypatch.setattr(best_pairs, "MET", 0)
    for edges in (communities(4), GRAPHS["loops"], GRAPHS["two_parts"], GRAPHS["star"]):
        want, open_ = plain(edges, 20)
        report = []
        assert got(best_pairs.best_open_pairs(adjacency(spark, edges), 1997, 20, report=report)) == want
        assert open_ < 5000 or 0 < sum(n for _, n in report) * 5 < open_, (report, open_)


def test_written_tables_leave_no_shuffle_files(spark):
    """Shuffles of finished steps once filled the disk until the driver collected garbage."""
    def shuffled():
        # the folder of the block manager, where shuffle files are
        top = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
        return {f for d in top for f in glob.glob(f"{d}/*/shuffle_*.data")}

    before = shuffled()
    out = durable(spark.range(20_000).withColumn("k", F.xxhash64("id")).repartition(7, "k"))
    assert sum(os.path.getsize(f) for f in shuffled() - before) == 0
    assert out.count() == 20_000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
