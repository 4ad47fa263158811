"""Stored pair tables: look-ups keep the stored side in place."""

from fathomgraph.session import shared_path
from fathomgraph.sources import stored
from pyspark.sql import functions as F

ROWS = [(k % 40, 100 + k // 40, float(k), k % 7, f"t{k}") for k in range(800)]
SCHEMA = "v1 int, v2 int, score double, n int, tag string"


def stored_side(plan: str) -> list[str]:
    """Plan lines between the join and the bucketed scan."""
    lines = plan.split("\n")
    scan = next(k for k, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    join = max(k for k in range(scan) if "Join" in lines[k])
    depth = len(lines[join]) - len(lines[join].lstrip(" :+-"))
    start = next(k for k in range(scan, join, -1) if len(lines[k]) - len(lines[k].lstrip(" :+-")) <= depth + 3)
    return lines[start:scan]


def test_look_up_equals_join_and_moves_only_the_pairs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    kept = stored.store_pairs(rows, buckets=4)
    asked = spark.createDataFrame([(101, 3), (3, 101), (5, 119), (39, 100), (7, 7), (None, 3)], "v1 int, v2 int")
    out = stored.look_up(asked, kept)
    by_pair = {(a, b): (s, n, t) for a, b, s, n, t in ROWS}
    want = []
    for a, b in [(3, 101), (3, 101), (5, 119), (39, 100), (7, 7), (3, 3)]:
        want.append((a, b, *by_pair.get((a, b), (None, None, None)), (a, b) in by_pair))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    side = stored_side(out._jdf.queryExecution().executedPlan().toString())
    assert side and not any("Exchange" in line for line in side), side


def test_maxima_and_reading_again(spark):
    path = shared_path(spark, "kept")
    kept = stored.store_pairs(spark.createDataFrame(ROWS, SCHEMA), path=path, buckets=3)
    assert kept.maxima(spark) == {"score": 799.0, "n": 6.0}
    again = stored.open_stored(spark, path)
    asked = spark.createDataFrame([(3, 101)], "v1 int, v2 int")
    row = stored.look_up(asked, again, ["score", "tag"], scaled=True).first()
    assert row["found"] and abs(row["score"] - 43 / 799) < 1e-12 and row["tag"] == "t43"
    assert again.rows(spark).count() == len(ROWS)
    spark.sql(f"DROP TABLE {again.name}")
    stored.drop_stored(spark, kept)


def test_empty_and_keys_only(spark):
    empty = stored.store_pairs(spark.createDataFrame([], "v1 int, v2 int, score double"), buckets=2)
    asked = spark.createDataFrame([(2, 1)], "v1 int, v2 int")
    assert [tuple(r) for r in stored.look_up(asked, empty).collect()] == [(1, 2, None, False)] and empty.maxima(spark) == {"score": 1.0}
    keys = stored.store_pairs(spark.createDataFrame([(2, 1)], "v1 int, v2 int"))
    assert stored.look_up(asked, keys).select(F.count_if("found")).first()[0] == 1
