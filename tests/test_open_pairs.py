"""Scored pairs that stay open, with and without a shared neighbour."""

from fathomgraph.functions.dates import day_offset
from fathomgraph.operators import graph
from pyspark.sql import functions as F


def test_open_pairs_need_no_shared_neighbour(spark):
    rows = [(1, 2, "1996-01-01"), (2, 3, "1996-01-01"), (4, 5, "1996-01-01"), (1, 4, "2001-03-01"), (3, 5, "1999-01-01"), (5, 6, "2001-03-01")]
    seen = spark.createDataFrame(rows, "v1 int, v2 int, d string").select("v1", "v2", day_offset(F.to_date("d")).alias("first_day"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (3, 5), (5, 6)], "v1 int, v2 int")
    got = {tuple(r) for r in graph.still_open(pairs, seen, 1997, 2000).collect()}
    assert got == {(1, 3), (1, 4)}  # 1-4 shares no neighbour; 1-2 and 3-5 are edges, 6 is not active
