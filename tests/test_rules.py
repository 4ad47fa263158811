"""Small hand-made cases for the edge rules."""

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fathomgraph.functions import dates, text
from fathomgraph.functions.similarity import pair_citations, pair_indices
from fathomgraph.operators import citations, entities, evaluate, features, graph, labels, match, ordered, ranking, spans
from fathomgraph.operators.cooccur import cited_only
from fathomgraph.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# -- dates, texts --------------------------------------------------------------------------------------------------


def test_cutoff_day_is_inclusive(spark):
    df = spark.createDataFrame([(dates.cutoff_day(2000),), (dates.cutoff_day(2000) + 1,)], "time int")
    assert [r["time"] for r in citations.as_of(df, 2000).collect()] == [dates.cutoff_day(2000)]
    assert dates.cutoff_day(1990) == 364


def test_preprint_date_needs_no_weekday(spark):
    assert str(one(spark, dates.preprint_date(F.lit("Mon, 2 Apr 2007 19:18:42 GMT")))) == "2007-04-02"
    assert one(spark, dates.preprint_date(F.lit("nonsense"))) is None
    assert one(spark, dates.iso_date(F.lit("1997-02-30"))) is None


def replaced(s, pairs):
    for a, b in pairs:
        s = s.replace(a, b)
    return s


@pytest.mark.parametrize("pairs", [text.REPLACE_FULL, text.REPLACE_SHORT, text.REPLACE_THREE])
def test_replacements_run_in_order_and_blanks_twice(spark, pairs):
    for s in ['a     b', 'x "a "o', " ' e it's", "one-two\nthree", 'na" ave " u']:
        assert one(spark, text.replace_in_order(F.lit(s), pairs)) == replaced(s, pairs)
    assert "  " in one(spark, text.replace_in_order(F.lit("a" + " " * 9 + "b"), pairs))


def test_abstract_from_index_sorts_by_position_then_word(spark):
    df = spark.sql("select map('world', array(1), 'hello', array(0, 2), 'b', array(3), 'a', array(3), 'none', cast(null as array<int>)) as m, cast(null as string) as t")
    assert df.select(text.paper_abstract(F.col("m"), F.col("t"))).first()[0] == "hello world hello a b"
    empty = spark.sql("select cast(null as map<string, array<int>>) as m, 'plain' as t")
    assert empty.select(text.paper_abstract(F.col("m"), F.col("t"))).first()[0] == "plain"


def test_paper_text_of_missing_parts(spark):
    assert one(spark, text.paper_text(F.lit(None).cast("string"), F.lit("B"), [])) == " b"
    assert one(spark, text.paper_text(F.lit(None).cast("string"), F.lit(" B "), [], strip=True)) == "b"


PLURALS = {
    "CNNs": (True, "CNN"), "studies": (True, "study"), "boxes": (True, "box"), "databases": (True, "databas"),
    "process": (False, "process"), "GPT2s": (True, "GPT2"), "word2vecs": (False, "word2vecs"), "s": (True, ""), "model": (False, "model"),
}


@pytest.mark.parametrize("name", PLURALS)
def test_plural_and_singular(spark, name):
    assert (one(spark, text.is_plural(F.lit(name))), one(spark, text.singular(F.lit(name)))) == PLURALS[name]


def test_parentheses_are_not_nested_and_noise_goes(spark):
    assert one(spark, text.strip_parentheses(F.lit("a (b (c)) d"))) == "a) d"
    assert one(spark, text.strip_noise(F.lit(' ~"a$  %b\\/ '))) == "a b"


# -- citations -----------------------------------------------------------------------------------------------------


def test_repeated_year_last_wins(spark):
    schema = "counts array<struct<year:int,cited_by_count:bigint>>"
    df = spark.createDataFrame([([(2020, 3), (2020, 5)],), ([],), (None,)], schema)
    assert [tuple(r) for r in citations.pivot_list(df, "counts", [2020, 2019]).collect()] == [(5, 0), (0, 0), (0, 0)]


def test_pivot_of_maps_with_bad_values(spark):
    df = spark.createDataFrame([({2020: "4", 2019: "x"},), (None,)], "counts map<int,string>")
    assert [tuple(r) for r in citations.pivot_map(df, "counts", [2020, 2019]).collect()] == [(4, 0), (0, 0)]


def test_yearly_table_subtracts_later_years_and_uses_available_columns(spark):
    df = spark.createDataFrame([(1, 0, 10, 1, 2, 3), (1, dates.cutoff_day(2001) + 1, 7, 0, 0, 7)], "v1 int, time int, ct bigint, c2000 bigint, c2001 bigint, c2002 bigint")
    rows = {r["year"]: r for r in citations.yearly_table(df, ["v1"], [2000, 2001, 2002]).collect()}
    assert (rows[2000]["c"], rows[2000]["ct_y"], rows[2000]["ct_delta"], rows[2000]["num"]) == (1, 5, 1, 1)
    assert (rows[2001]["ct_y"], rows[2001]["ct_delta"], rows[2001]["num"]) == (7, 3, 1)
    assert (rows[2002]["c"], rows[2002]["ct_y"], rows[2002]["num"], rows[2002]["c_m"]) == (10, 17, 2, 5.0)


def test_node_table_fills_missing_vertices(spark):
    df = spark.createDataFrame([(1, 0, 1, 1)], "v1 int, time int, ct bigint, c2000 bigint")
    rows = citations.node_table(df, spark.createDataFrame([(1,), (2,)], "v1 int"), [2000]).orderBy("v1").collect()
    assert [(r["v1"], r["num"], r["c_m"]) for r in rows] == [(1, 1, 1.0), (2, 0, 0.0)]


def test_zero_or_missing_totals_are_dropped(spark):
    df = spark.createDataFrame([("3",), ("0",), (None,), ("x",)], "ct string")
    assert [r["ct"] for r in cited_only(df).collect()] == ["3"]


# -- pair formulas -------------------------------------------------------------------------------------------------


def indices(spark, n, d1, d2):
    values = pair_indices(F.lit(n), F.lit(d1), F.lit(d2))
    return spark.range(1).select(*[c.alias(k) for k, c in values.items()]).first().asDict()


def test_pair_index_guards(spark):
    assert set(indices(spark, 0, 0, 0).values()) == {0.0}
    half = indices(spark, 0, 0, 4)
    assert half["geometric"] == half["cosine"] == half["simpson"] == half["preferential"] == 0 and half["dice"] == 0 and half["jaccard"] == 0
    full = indices(spark, 2, 4, 2)
    assert (full["geometric"], full["simpson"], full["preferential"], full["jaccard"]) == (0.5, 1.0, 8.0, 0.5)
    assert math.isclose(full["dice"], 4 / 6) and 0 <= full["jaccard"] <= full["dice"] <= 1


def test_pair_citations_without_papers(spark):
    zero = {n: F.lit(0.0) for n in ("c", "ct", "delta", "num", "c_m", "ct_m", "delta_m")}
    values = pair_citations(zero, zero)
    row = spark.range(1).select(*[c.alias(k) for k, c in values.items()]).first()
    assert len(row) == 14 and set(row) == {0.0}


def test_layout_has_141_features():
    assert features.FEATURE_COUNT == 141 and len(features.NODE_NAMES) == 10 and len(features.CITATION_NAMES) == 29


def test_rescale_keeps_negative_maximum_and_zero(spark):
    df = spark.createDataFrame([(-4.0, 0.0), (-2.0, 0.0), (-1.0, 0.0)], "a double, b double")
    scaled = features.rescale(df, features.maxima(df, ["a", "b"])).collect()
    assert [r["a"] for r in scaled] == [4.0, 2.0, 1.0] and {r["b"] for r in scaled} == {0.0}


def test_rank_ties_are_averaged(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (7.0,)], "x double")
    assert {r["x"]: r["r"] for r in ordered.average_rank(df, "x", "r").collect()} == {5.0: 1.5, 7.0: 3.0}


# -- graph ---------------------------------------------------------------------------------------------------------


def test_self_loop_degrees(spark):
    edges = spark.createDataFrame([(1, 1, 0), (1, 1, 5)], "v1 int, v2 int, time int")
    seen = graph.first_seen(edges)
    vertices = spark.createDataFrame([(1,)], "v1 int")
    assert graph.degrees(graph.adjacency(seen), vertices, [1990]).first()["d1990"] == 1
    assert graph.active_vertices(graph.connected_pairs(seen, 1990)).first()["degree"] == 2


def pagerank_by_hand(nbrs, n, damping=0.85, tol=1e-6):
    r = [1 / n] * n
    for _ in range(100):
        loose = sum(r[v] for v in range(n) if not nbrs[v])
        new = [(1 - damping) / n + damping * loose / n for _ in range(n)]
        for v in range(n):
            for w in nbrs[v]:
                new[w] += damping * r[v] / len(nbrs[v])
        drift = sum(abs(a - b) for a, b in zip(r, new))
        r = new
        if drift < n * tol:
            return r
    raise AssertionError


def test_pagerank_stops_per_year_and_spreads_isolated_mass(spark):
    random.seed(3)
    pairs = {tuple(sorted(random.sample(range(12), 2))) for _ in range(20)}
    days = {p: random.choice([0, 400]) for p in pairs} | {(3, 3): 0}
    n = 15
    seen = spark.createDataFrame([(a, b, d) for (a, b), d in days.items()], "v1 int, v2 int, first_day int")
    vertices = spark.createDataFrame([(v,) for v in range(n)], "v1 int")
    got = {r["v1"]: r for r in graph.pagerank(graph.adjacency(seen), vertices, [1990, 1991]).collect()}
    for y, limit in ((1990, 364), (1991, 729)):
        nbrs = [set() for _ in range(n)]
        for (a, b), d in days.items():
            if d <= limit:
                nbrs[a].add(b)
                nbrs[b].add(a)
        expected = pagerank_by_hand(nbrs, n)
        assert all(math.isclose(got[v][f"pr{y}"], expected[v], rel_tol=1e-9) for v in range(n))
        assert math.isclose(sum(expected), 1.0)


def test_sharing_pairs_and_counts(spark):
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)} | {(0, k) for k in range(1, 30)} | {(7, 7)}
    seen = spark.createDataFrame([(a, b, 0) for a, b in edges], "v1 int, v2 int, first_day int")
    nbrs = {v: {a + b - v for a, b in edges if v in (a, b) and a != b} for v in range(40)}
    expected = {(a, b): len(nbrs[a] & nbrs[b]) for a in range(40) for b in range(a + 1, 40) if nbrs[a] & nbrs[b]}
    for block in (4, 256):
        sharing = graph.sharing_pairs(graph.adjacency(seen), 1997, block)
        assert {(r["v1"], r["v2"]): r["shared"] for r in sharing.collect()} == expected
    connected = seen.select("v1", "v2")
    free = {tuple(r) for r in graph.unconnected_pairs(sharing, connected).collect()}
    assert free == set(expected) - edges
    n, joined = len({v for e in edges for v in e}), sum(a != b for a, b in edges)
    row = graph.pair_counts(graph.active_vertices(connected), connected, sharing).first()
    assert tuple(row) == (n, n * (n - 1) // 2, joined, len(free), n * (n - 1) // 2 - joined - len(free))


# -- labels, evaluation --------------------------------------------------------------------------------------------


def test_conditional_classes_and_gap(spark):
    df = spark.createDataFrame([(3,), (50,), (100,)], "c int")
    split = labels.conditional_class(F.col("c"), [(0, 5)], 100, gap=None)
    keep = labels.conditional_class(F.col("c"), [(0, 5)], 100, gap=0)
    assert [tuple(r) for r in df.select(split, keep).collect()] == [(0, 0), (None, 0), (1, 1)]


def test_auc_ties_and_symmetry(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1)], "s double, y int")
    assert evaluate.auc(df, "s", F.col("y") == 1).first()["auc"] == 0.5
    random.seed(1)
    rows = [(random.choice([0.1, 0.2, 0.3, 0.4]), random.randint(0, 1)) for _ in range(60)]
    df = spark.createDataFrame(rows, "s double, y int")
    a = evaluate.auc(df, "s", F.col("y") == 1).first()["auc"]
    b = evaluate.auc(df.withColumn("s", -F.col("s")), "s", F.col("y") == 1).first()["auc"]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert math.isclose(a, brute) and math.isclose(a + b, 1.0)


def test_best_threshold_of_report(spark):
    lines = ["IR=[3]: train=0.9; test=0.8; eval=0.71", "noise", "IR=[7]: train=0.9; test=0.8; eval=0.75", "IR=[9]: train=0.9; test=0.8; eval=0.75"]
    row = evaluate.best_threshold(spark.createDataFrame([(x,) for x in lines], "value string")).first()
    assert (row["best_ir"], row["best_eval"]) == (7, 0.75)


def test_split_sizes_per_class(spark):
    df = spark.createDataFrame([(v, v % 3 == 0) for v in range(40)], "v int, y boolean")
    got = evaluate.split_per_class(df, "y", 1, ["v"]).groupBy("y", "part").count().collect()
    assert {(r["y"], r["part"]): r["count"] for r in got} == {(True, "train"): 11, (True, "test"): 3, (False, "train"): 22, (False, "test"): 4}


# -- spans ---------------------------------------------------------------------------------------------------------


def test_overlap_suppression_rules(spark):
    rows = [(0, 0, 0, 3, "A", 0.9), (0, 0, 2, 4, "A", 0.8), (0, 0, 2, 4, "B", 0.7)]
    df = spark.createDataFrame(rows, "doc int, sent int, s int, e int, label string, score double")
    assert {r["score"] for r in spans.suppress_overlaps(df).collect()} == {0.9, 0.7}
    assert {r["score"] for r in spans.suppress_overlaps(df, same_label=False).collect()} == {0.9}


def test_span_budget_is_clipped(spark):
    df = spark.createDataFrame([(4,), (60,), (11,)], "n int").select(spans.span_budget(F.col("n"), 0.5, 3, 18))
    assert [r[0] for r in df.collect()] == [3, 18, 6]


def test_symmetric_gold_counts_once_in_recall(spark):
    cols = "doc int, sent int, s1 int, e1 int, s2 int, e2 int, label string"
    gold = spark.createDataFrame([(0, 0, 0, 0, 2, 2, "CONJUNCTION")], cols)
    predicted = spark.createDataFrame([(0, 0, 2, 2, 0, 0, "CONJUNCTION")], cols)
    ents = spark.createDataFrame([(0, 0, 0, 0, "Task"), (0, 0, 2, 2, "Task")], "doc int, sent int, s int, e int, label string")
    assert spans.symmetric_gold(gold, ["CONJUNCTION"]).count() == 2
    row = spans.relation_scores(predicted, gold, ents, ents, ["CONJUNCTION"]).first()
    assert (row["precision"], row["recall"], row["f1"], row["typed_f1"]) == (1.0, 1.0, 1.0, 1.0)


def test_typed_documents(spark):
    df = spark.createDataFrame(
        [Row(doc=1, ner=[[["0", "1", "Task"]], []], relations=[[["0", "1", "2", "2", "PART-OF"]], []])],
        "doc int, ner array<array<array<string>>>, relations array<array<array<string>>>",
    )
    typed = spans.typed_documents(df)
    assert [tuple(r) for r in spans.gold_spans(typed).collect()] == [(1, 0, 0, 1, "Task")]
    assert [tuple(r) for r in spans.gold_spans(typed, "relations").collect()] == [(1, 0, 0, 1, 2, 2, "PART-OF")]


def test_scores_without_predictions_are_zero(spark):
    none = spark.createDataFrame([], "doc int, sent int, s int, e int, label string, score double")
    gold = spark.createDataFrame([(0, 0, 0, 0, "A")], "doc int, sent int, s int, e int, label string")
    assert set(spans.entity_scores(none, gold).first()) == {0.0}


# -- refinement, ranking, files ------------------------------------------------------------------------------------


def test_default_word_rules(spark):
    words = ["software design", "open quantum system", "open a b c d", "simple rule", "gate set", "probe beam", "a high fidelity b", "neural network"]
    df = spark.createDataFrame([(w,) for w in words], "concept string")
    assert {r["concept"] for r in match.refine_dictionary(df).collect()} == {"open a b c d", "neural network"}
    assert tuple(match.refinement_report(df).first()) == (8, 2, 6)


def test_dictionary_keeps_smallest_id_of_equal_words(spark):
    df = spark.createDataFrame([(3, "Graph"), (1, " graph "), (2, " ")], "concept_id int, concept string")
    assert [tuple(r) for r in match.clean_dictionary(df).collect()] == [(1, "graph")]


def test_names_fall_back(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (None, 9, 0.4)], "v1 int, v2 int, score double")
    names = spark.createDataFrame([(1, "one"), (2, "two")], "concept_id int, concept string")
    got = {tuple(r) for r in ranking.name_pairs(pairs, names, "Unknown ID").collect()}
    assert got == {(1, "one", 2, "two", 0.5), (-1, "Unknown ID", 9, "Unknown ID", 0.4)}


def test_descending_check(spark):
    df = spark.createDataFrame([(k, -float(k // 2)) for k in range(100)], "rank int, score double")
    assert ranking.descending_check(df, ["rank"]).first()[0] is True
    assert ranking.descending_check(df.withColumn("score", F.when(F.col("rank") == 70, 5.0).otherwise(F.col("score"))), ["rank"]).first()[0] is False


def test_category_pair_seen_once_has_zero_deviation(spark):
    df = spark.createDataFrame([("b", "a", 0.5), ("c", "c", 0.1), ("c", "c", 0.3)], "concept1_category string, concept2_category string, score double")
    got = {(r["category1"], r["category2"]): (r["avg_score"], r["count"], round(r["std"], 6)) for r in ranking.category_matrix(df).collect()}
    assert got[("a", "b")] == (0.5, 1, 0.0) and got[("c", "c")] == (0.2, 2, 0.141421) and got[("a", "a")] == (None, 0, 0.0) and len(got) == 6


def test_csv_encoding_fallback(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_bytes("name\nf\xfcr\n".encode("latin-1"))
    from pyspark.sql import types as T

    rows = readers.read_csv(spark, str(tmp_path / "x"), T.StructType([T.StructField("name", T.StringType())]), ["utf-8", "latin-1"])
    assert [r["name"] for r in rows.collect()] == ["f\xfcr"]
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "a.csv").write_bytes("name\n\u56fe\u8c31\n".encode("gbk"))
    rows = readers.read_csv(spark, str(tmp_path / "y"), rows.schema, ["utf-8", "gbk", "gb18030", "latin-1"])
    assert [r["name"] for r in rows.collect()] == ["\u56fe\u8c31"]


def test_dictionary_of_many_splits_keeps_its_line_numbers(spark, tmp_path):
    words = [f"word{k}" if k % 7 else "" for k in range(5000)]
    (tmp_path / "d.txt").write_text("\n".join(words) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows = readers.read_dictionary(spark, str(tmp_path / "d.txt"))
        got = sorted(tuple(r) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept = [(k, w) for k, w in enumerate(words) if w]
    assert got == [(i, k, w) for i, (k, w) in enumerate(kept)]


def test_compaction_keeps_rows(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(f"{tmp_path}/a")
    assert sinks.compact(spark, f"{tmp_path}/a", f"{tmp_path}/b") == 1000


def test_noise_needs_five_fields(spark):
    with pytest.raises(ValueError):
        entities.drop_noise(spark.createDataFrame([("a",)], "n string"), "n")
