"""Hot keys: results stay whole when one paper, hub, concept or score holds much of the data."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fathomgraph.operators import evaluate, graph, match, ordered, ranking
from fathomgraph.operators.cooccur import cooccurrence, cooccurrence_occurrences
from fathomgraph.session import shared_path
from fathomgraph.streaming.ingest import file_report, ingest_new_files


def test_large_paper_is_paired_block_by_block(spark):
    random.seed(5)
    rows = [(0, v) for v in range(90)] * 2 + [(p, random.randrange(40)) for p in range(1, 20) for _ in range(5)]
    df = spark.createDataFrame(rows, "paper int, v int").withColumn("time", F.col("paper") * 10)
    got = [tuple(r) for r in cooccurrence(df, "paper", "v", carry=["time"], block=16).collect()]
    expected = set()
    for p in {r[0] for r in rows}:
        vs = sorted({v for q, v in rows if q == p})
        expected |= {(p, a, b, p * 10) for a, b in itertools.combinations(vs, 2)}
    assert len(got) == len(expected) and set(got) == expected


def test_occurrence_pairs_of_a_large_paper(spark):
    random.seed(6)
    rows = [(0, random.randrange(9), k) for k in range(70)] + [(1, 4, 0), (1, 4, 1), (1, 2, 2)]
    df = spark.createDataFrame(rows, "paper int, v int, at int")
    got = sorted(tuple(r) for r in cooccurrence_occurrences(df, "paper", "v", ["at"], block=8).collect())
    assert got == sorted((p, v, w) for p, v, a in rows for q, w, b in rows if p == q and a < b)


def brute(texts, words, whole):
    bounds = " ,.;:!?()[]{}\"'-\n\t\r"
    out = set()
    for doc, body in texts:
        for no, w in words:
            for s in range(len(body) - len(w) + 1):
                if body[s : s + len(w)] == w:
                    left = s == 0 or body[s - 1] in bounds
                    right = s + len(w) == len(body) or body[s + len(w)] in bounds
                    if not whole or (left and right):
                        out.add((doc, no, w, s))
    return out


def check_matching(spark, texts, words, **options):
    t = spark.createDataFrame(texts, "doc int, body string")
    d = spark.createDataFrame(words, "concept_id int, concept string")
    for whole in (False, True):
        got = [tuple(r) for r in match.occurrences(t, d, "doc", "body", whole_words=whole, **options).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(texts, words, whole)


def test_matching_against_brute_force(spark):
    random.seed(11)
    texts = [(k, "".join(random.choice("ab .-\n\U0001f600é") for _ in range(random.randrange(0, 300)))) for k in range(12)] + [(99, "")]
    strings = {"".join(random.choice("ab é") for _ in range(n)).strip() for n in (1, 2, 3, 4, 5, 6, 8, 9, 12, 17) for _ in range(4)} - {""}
    words = list(enumerate(sorted(strings)))
    check_matching(spark, texts, words)
    check_matching(spark, texts, words, piece=7)
    check_matching(spark, texts, words, broadcast_rows=0)


def test_matching_with_shared_prefixes(spark):
    words = list(enumerate(["aaaa" + "".join(p) for p in itertools.product("ab", repeat=5)] + ["aaaa", "aaaaaaaaaaaaaaaaab", "b"]))
    d = spark.createDataFrame(words, "concept_id int, concept string")
    assert len(match._anchor_lengths(d.filter("length(concept) > 3"), "concept")) > 1
    random.seed(2)
    texts = [(k, "".join(random.choice("aaab ") for _ in range(200))) for k in range(6)]
    check_matching(spark, texts, words)


def test_whole_word_examples(spark):
    t = spark.createDataFrame([(1, "(graph) x"), (2, "graphs")], "doc int, body string")
    d = spark.createDataFrame([(1, "graph")], "concept_id int, concept string")
    assert match.document_frequency(t, d, "doc", "body").first()["df"] == 1
    assert match.mentions(t, d, "doc", "body").count() == 2


def test_hub_shared_neighbours(spark):
    random.seed(7)
    pairs = {(0, v) for v in range(1, 80)} | {(1, v) for v in range(2, 80)} | {tuple(sorted(random.sample(range(80), 2))) for _ in range(100)}
    seen = spark.createDataFrame([(a, b, random.choice([0, 400])) for a, b in sorted(pairs)], "v1 int, v2 int, first_day int")
    rows = seen.collect()
    adj = graph.adjacency(seen)
    vertices = spark.createDataFrame([(v,) for v in range(82)], "v1 int")
    wanted = [(0, 1), (0, 5), (3, 9), (0, 81), (80, 81)] + [tuple(sorted(random.sample(range(80), 2))) for _ in range(20)]
    wanted = sorted(set(wanted))
    deg = graph.degrees(adj, vertices, [1991, 1990])
    got = {
        (r["v1"], r["v2"]): (r["n1990"], r["n1991"])
        for r in graph.shared_neighbours(spark.createDataFrame(wanted, "v1 int, v2 int"), adj, deg, [1990, 1991], salt_rows=8).collect()
    }
    nbrs = {lim: {v: set() for v in range(82)} for lim in (364, 729)}
    for lim, table in nbrs.items():
        for r in rows:
            if r["first_day"] <= lim:
                table[r["v1"]].add(r["v2"])
                table[r["v2"]].add(r["v1"])
    assert got == {(a, b): tuple(len(nbrs[lim][a] & nbrs[lim][b]) for lim in (364, 729)) for a, b in wanted}


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rank_and_running_totals_with_a_hot_value(spark, many_partitions):
    random.seed(9)
    rows = [(v, 1.0 if v % 3 == 0 else random.random(), v % 2) for v in range(3000)]
    df = spark.createDataFrame(rows, "v int, s double, g int").repartition(6)
    ranked = {r["v"]: r["rank"] for r in ordered.with_rank(df, ["s", "v"], "rank").collect()}
    assert ranked == {v: k for k, (_, v) in enumerate(sorted((s, v) for v, s, _ in rows), 1)}
    parts = ordered.order_rows(df, ["s", "v"]).groupBy("_part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 1500
    grouped = {r["v"]: r["rank"] for r in ordered.with_rank(df, ["s", "v"], "rank", group=["g"]).collect()}
    for g in (0, 1):
        assert [grouped[v] for _, v in sorted((s, v) for v, s, h in rows if h == g)] == list(range(1, 1501))
    running = {r["v"]: r["one_before"] for r in ordered.with_running(df.withColumn("one", F.lit(1)), ["s", "v"], ["one"]).collect()}
    assert running == {v: k - 1 for v, k in ranked.items()}


def test_stream_takes_each_file_once(spark):
    root = shared_path(spark, "stream-test")
    source = spark.range(20).select(F.col("id").alias("doc"), (F.col("id") % 2).alias("part"))

    def run():
        ingest_new_files(spark, f"{root}/in", "doc bigint", f"{root}/out", f"{root}/log", lambda b: b.filter("doc > 3"), files_per_batch=1)

    source.filter("part = 0").coalesce(2).write.json(f"{root}/in")
    run()
    run()
    source.filter("part = 1").write.mode("append").json(f"{root}/in")
    run()
    got = sorted(r["doc"] for r in spark.read.parquet(f"{root}/out").collect())
    assert got == list(range(4, 20))
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "file string, doc int")
    report = {r["file"]: tuple(r)[1:] for r in file_report(rows, rows.filter("doc = 2"), "doc").collect()}
    assert report == {"x": (2, 1, 1), "y": (1, 0, 0)}


def test_ranked_figures_over_many_partitions(spark, many_partitions):
    random.seed(4)
    rows = [(v, v + 1, random.choice([0.1, 0.2, 0.3, 0.4, 0.5])) for v in range(500)]
    df = spark.createDataFrame(rows, "v1 int, v2 int, score double")
    shares = {r["v1"]: r["cum_share"] for r in ranking.cumulative_share(df).collect()}
    total, so_far = sum(s for *_, s in rows), 0.0
    for a, _, s in sorted(rows, key=lambda r: (-r[2], r[0])):
        so_far += s
        assert abs(shares[a] - so_far / total) < 1e-9
    summary = ranking.score_summary(df).first()
    values = sorted(s for *_, s in rows)
    assert summary["median_score"] == (values[249] + values[250]) / 2
    checked = ranking.rank_and_quantile(df)
    assert ranking.descending_check(checked, ["rank"]).first()[0] is True
    assert evaluate.auc(df, "score", df.v1 % 2 == 0).first()["auc"] is not None
    assert evaluate.exact_sample(df, 123, 42, ["v1"]).count() == 123


def test_hub_edges_are_dealt_over_buckets(spark):
    """A star of a million edges: no bucket of the laid out edges has twice the median, and ranks equal the closed form."""
    n = 1_000_000
    seen = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("v1"), F.col("id").alias("v2"), F.lit(0).alias("first_day"))
    adj = graph.adjacency(seen)
    edges, cells, drop = graph.write_cells(adj, buckets=8)
    sizes = sorted(r["count"] for r in edges.groupBy(F.input_file_name()).count().collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[4] and edges.count() == 2 * n
    assert cells.filter("src = 0").first()["cells"] > 50 and cells.agg(F.max(F.when(F.col("src") > 0, F.col("cells")))).first()[0] == 1
    drop()
    vertices = spark.range(0, n + 1).select(F.col("id").alias("v1"))
    ranks = graph.pagerank(adj, vertices, [1997], tolerance=0, max_iterations=3)
    hub, leaf, d, m = 1 / (n + 1), 1 / (n + 1), 0.85, n + 1
    for _ in range(3):
        hub, leaf = d * n * leaf + (1 - d) / m, d * hub / n + (1 - d) / m
    got = ranks.groupBy((F.col("v1") == 0).alias("hub")).agg(F.min("pr1997").alias("low"), F.max("pr1997").alias("high")).collect()
    for r in got:
        want = hub if r["hub"] else leaf
        assert abs(r["low"] - want) < 1e-9 * max(1, want) and abs(r["high"] - want) < 1e-9 * max(1, want)


def test_rank_steps_do_not_move_edges(spark):
    adj = graph.adjacency(spark.createDataFrame([(1, 2, 0), (2, 3, 0), (1, 3, 0)], "v1 int, v2 int, first_day int"))
    edges, cells, drop = graph.write_cells(adj, cell_edges=1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shares = cells.select("src", "cells", F.lit(0.5).alias("s1997"))
        inflow = graph.rank_inflow(edges, shares, [1997], "v1")
        plan = inflow._jdf.queryExecution().executedPlan().toString()
        assert {r["v1"]: r["in1997"] for r in inflow.collect()} == {1: 1.0, 2: 1.0, 3: 1.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    scan = next(k for k, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    join = next(k for k, line in enumerate(lines) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in lines[join:scan])
    drop()
