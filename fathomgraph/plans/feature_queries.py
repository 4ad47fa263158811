"""Queries I to K: features, evaluation, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import PAIR_CITATION_NAMES, PAIR_NAMES, pair_citations, pair_indices
from ..operators import bottom_k, citations, evaluate, features, graph, labels, optimality, ranking
from ..operators.best_pairs import best_open_pairs
from ..operators.features import CITATION_BASE, CITATION_NAMES, NODE_NAMES, VERTEX_NAMES, YEARLY_NAMES
from ..session import durable, shared_path
from . import inputs as i
from .graph_queries import new_pairs, open_pairs, solution_sets, solutions
from .inputs import FEATURE_YEARS, LATER, YEAR, r9, sql_cutoff
from .registry import ORACLES, cte, query

#: Slopes of the loss below this count as none.
FLAT = 1e-4

# -- vertex features -----------------------------------------------------------------------------------------------


def _rank_sql(column: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE"


_deg = ", ".join(f"d{k}.deg AS deg{k}" for k in range(3))
_pr = ", ".join(f"p{k}.r AS pr{k}" for k in range(3))
cte(
    "vnode_raw",
    f"SELECT d0.v1, {_deg}, d0.deg - d1.deg AS gain1, d0.deg - d2.deg AS gain2, {_pr} FROM deg{YEAR} d0 "
    + " ".join(f"JOIN deg{YEAR - k} d{k} ON d{k}.v1 = d0.v1" for k in (1, 2))
    + " " + " ".join(f"JOIN pr{YEAR - k} p{k} ON p{k}.v1 = d0.v1" for k in range(3)),
    *[f"deg{y}" for y in FEATURE_YEARS], *[f"pr{y}" for y in FEATURE_YEARS],
)
cte("vnode", f"SELECT *, {_rank_sql('gain1')} AS rank_gain1, {_rank_sql('gain2')} AS rank_gain2 FROM vnode_raw", "vnode_raw")
_SOURCE = {"c": "c", "ct": "ct_y", "delta": "ct_delta", "num": "num", "c_m": "c_m", "ct_m": "ct_y_m", "delta_m": "ct_delta_m"}
cte(
    "vcite_raw",
    "SELECT v1, " + ", ".join(f"max({_SOURCE[n]}) FILTER (year = {YEAR - k}) AS {n}_{k}" for n in CITATION_BASE for k in range(3))
    + " FROM node_table GROUP BY v1", "node_table",
)
cte("vcite_gain", "SELECT *, " + ", ".join(f"{n}_0 - {n}_{k} AS {n}_gain{k}" for n in ("ct", "num") for k in (1, 2)) + " FROM vcite_raw", "vcite_raw")
cte("vcite", "SELECT *, " + ", ".join(f"{_rank_sql(f'{n}_gain{k}')} AS {n}_rank_gain{k}" for n in ("ct", "num") for k in (1, 2)) + " FROM vcite_gain", "vcite_gain")
cte("vertex", "SELECT n.v1, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in VERTEX_NAMES) + " FROM vnode n JOIN vcite c ON n.v1 = c.v1", "vnode", "vcite")
cte("vmax", "SELECT " + ", ".join(f"CASE WHEN max({c}) = 0 THEN 1 ELSE max({c}) END AS {c}" for c in VERTEX_NAMES) + " FROM vertex", "vertex")


def _vertex_graph(spark, d):
    """(first-seen pairs, adjacency, vertices, vertex features)."""
    seen, fresh = new_pairs(spark, d)
    adj, v = graph.adjacency(seen), i.vertices(spark, d)
    node = features.node_features(adj, v, YEAR)
    cite = features.node_citation_features(citations.node_table(i.mentions(spark, d), v, FEATURE_YEARS), YEAR)
    return seen, fresh, adj, v, durable(features.vertex_features(node, cite), "vertex")


def _round_all(df, names):
    return df.withColumns({n: r9(F.col(n)) for n in names})


@query("i1_node_features", "SELECT v1, " + ", ".join(f"round(CAST({c} AS DOUBLE), 9) AS {c}" for c in NODE_NAMES) + " FROM vnode", "vnode")
def _(spark, d):
    seen, _ = new_pairs(spark, d)
    df = features.node_features(graph.adjacency(seen), i.vertices(spark, d), YEAR)
    return df.select("v1", *[r9(F.col(c).cast("double")).alias(c) for c in NODE_NAMES])


@query(
    "i2_average_rank", f"SELECT v1, num_gain1, {_rank_sql('num_gain1')} AS rank FROM vcite_gain", "vcite_gain",
)
def _(spark, d):
    table = citations.node_table(i.mentions(spark, d), i.vertices(spark, d), FEATURE_YEARS)
    return features.node_citation_features(table, YEAR).select("v1", "num_gain1", F.col("num_rank_gain1").alias("rank"))


@query("i3_node_citation_features", "SELECT v1, " + ", ".join(f"round(CAST({c} AS DOUBLE), 9) AS {c}" for c in CITATION_NAMES) + " FROM vcite", "vcite")
def _(spark, d):
    table = citations.node_table(i.mentions(spark, d), i.vertices(spark, d), FEATURE_YEARS)
    df = features.node_citation_features(table, YEAR)
    return df.select("v1", *[r9(F.col(c).cast("double")).alias(c) for c in CITATION_NAMES])


# -- pair features -------------------------------------------------------------------------------------------------


def pair_ctes(name: str, pairs: str, *needs: str) -> None:
    """Fragments <name>_raw (unscaled yearly features) and <name>_max for a set of pairs."""
    cuts = {y: sql_cutoff(y) for y in FEATURE_YEARS}
    cte(
        f"{name}_common",
        "SELECT f.v1, f.v2, " + ", ".join(f"count(*) FILTER (a.first_day <= {cuts[y]} AND b.first_day <= {cuts[y]})::DOUBLE AS n{k}" for k, y in enumerate(FEATURE_YEARS))
        + f" FROM ({pairs}) f LEFT JOIN adj a ON a.src = f.v1 LEFT JOIN adj b ON b.src = f.v2 AND b.dst = a.dst GROUP BY f.v1, f.v2", *needs, "adj",
    )
    cols = []
    for k in range(3):
        n, d1, d2 = f"n{k}", f"a.deg{k}", f"b.deg{k}"
        geo = f"CASE WHEN {d1} = 0 OR {d2} = 0 THEN 0 ELSE {n} * {n} / ({d1} * {d2}) END"
        cols += [
            f"{n} AS shared_{k}", f"{geo} AS geometric_{k}", f"sqrt({geo}) AS cosine_{k}",
            f"CASE WHEN {d1} = 0 OR {d2} = 0 THEN 0 ELSE {n} / least({d1}, {d2}) END AS simpson_{k}",
            f"CASE WHEN {d1} = 0 OR {d2} = 0 THEN 0 ELSE {d1} * {d2} END AS preferential_{k}",
            f"CASE WHEN {d1} = 0 AND {d2} = 0 THEN 0 ELSE 2 * {n} / ({d1} + {d2}) END AS dice_{k}",
            f"CASE WHEN {d1} + {d2} - {n} > 0 THEN {n} / ({d1} + {d2} - {n}) ELSE 0 END AS jaccard_{k}",
        ]
        papers = f"(a.num_{k} + b.num_{k})"
        cols += [
            f"CASE WHEN {papers} = 0 THEN 0 ELSE (a.c_{k} + b.c_{k}) / {papers} END AS sum_c_per_paper_{k}",
            f"CASE WHEN {papers} = 0 THEN 0 ELSE a.c_{k} * b.c_{k} / {papers} END AS prod_c_per_paper_{k}",
            f"a.c_m_{k} + b.c_m_{k} AS sum_c_m_{k}", f"a.ct_m_{k} + b.ct_m_{k} AS sum_ct_m_{k}",
            f"a.delta_{k} + b.delta_{k} AS sum_delta_{k}", f"a.delta_m_{k} + b.delta_m_{k} AS sum_delta_m_{k}",
        ]
        cols += [f"{fn}(a.{c}_{k}, b.{c}_{k}) AS {word}_{c}_{k}" for c in ("c", "ct", "delta", "num") for fn, word in (("least", "min"), ("greatest", "max"))]
    cte(f"{name}_raw", "SELECT m.v1, m.v2, " + ", ".join(cols) + f" FROM {name}_common m JOIN vertex a ON a.v1 = m.v1 JOIN vertex b ON b.v1 = m.v2", f"{name}_common", "vertex")
    cte(f"{name}_max", "SELECT " + ", ".join(f"CASE WHEN max({c}) = 0 THEN 1 ELSE max({c}) END AS {c}" for c in YEARLY_NAMES) + f" FROM {name}_raw", f"{name}_raw")


def matrix_sql(name: str, maxima: str) -> str:
    cols = [f"round({side}.{c} / vmax.{c}, 9)" for c in VERTEX_NAMES for side in ("a", "b")]
    cols += [f"round(r.{c} / {maxima}.{c}, 9)" for c in YEARLY_NAMES]
    return (
        "SELECT r.v1, r.v2, " + ", ".join(f"{c} AS f{k}" for k, c in enumerate(cols))
        + f" FROM {name}_raw r JOIN vertex a ON a.v1 = r.v1 JOIN vertex b ON b.v1 = r.v2 JOIN vmax ON true JOIN {maxima} ON true"
    )


pair_ctes("fresh", "SELECT * FROM fresh", "fresh")
cte("known_now", f"SELECT v1, v2 FROM seen WHERE first_day <= {sql_cutoff(YEAR)}", "seen")
pair_ctes("now", "SELECT * FROM known_now", "known_now")
FEATURES = [f"f{k}" for k in range(features.FEATURE_COUNT)]


@query("i4_pair_indices", "SELECT v1, v2, " + ", ".join(f"round({n}_0, 9) AS {n}" for n in PAIR_NAMES) + " FROM fresh_raw", "fresh_raw")
def _(spark, d):
    seen, fresh = new_pairs(spark, d)
    adj = graph.adjacency(seen)
    deg = graph.degrees(adj, i.vertices(spark, d), [YEAR])
    counted = graph.shared_neighbours(fresh, adj, deg, [YEAR]).join(deg.withColumnRenamed(f"d{YEAR}", "_a"), "v1").join(
        deg.select(F.col("v1").alias("v2"), F.col(f"d{YEAR}").alias("_b")), "v2"
    )
    values = pair_indices(F.col(f"n{YEAR}"), F.col("_a"), F.col("_b"))
    return counted.select("v1", "v2", *[r9(values[n]).alias(n) for n in PAIR_NAMES])


@query("i5_pair_citations", "SELECT v1, v2, " + ", ".join(f"round({n}_0, 9) AS {n}" for n in PAIR_CITATION_NAMES) + " FROM fresh_raw", "fresh_raw")
def _(spark, d):
    _, fresh = new_pairs(spark, d)
    table = citations.node_table(i.mentions(spark, d), i.vertices(spark, d), [YEAR])
    names = {"c": "c", "ct": "ct_y", "delta": "ct_delta", "num": "num", "c_m": "c_m", "ct_m": "ct_y_m", "delta_m": "ct_delta_m"}
    a = table.select("v1", *[F.col(c).alias(f"a_{n}") for n, c in names.items()])
    b = table.select(F.col("v1").alias("v2"), *[F.col(c).alias(f"b_{n}") for n, c in names.items()])
    values = pair_citations({n: F.col(f"a_{n}") for n in names}, {n: F.col(f"b_{n}") for n in names})
    return fresh.join(a, "v1").join(b, "v2").select("v1", "v2", *[r9(values[n]).alias(n) for n in PAIR_CITATION_NAMES])


@query("i6_three_year_features", "SELECT v1, v2, " + ", ".join(f"round({n}, 9) AS {n}" for n in YEARLY_NAMES) + " FROM fresh_raw", "fresh_raw")
def _(spark, d):
    _, fresh, adj, v, vertex = _vertex_graph(spark, d)
    return _round_all(features.raw_pair_features(fresh, adj, v, vertex, YEAR).select("v1", "v2", *YEARLY_NAMES), YEARLY_NAMES)


@query("i7_scaled_vertex_features", "SELECT v1, " + ", ".join(f"round(vertex.{c} / vmax.{c}, 9) AS {c}" for c in VERTEX_NAMES) + " FROM vertex JOIN vmax ON true", "vertex", "vmax")
def _(spark, d):
    *_, vertex = _vertex_graph(spark, d)
    return _round_all(features.rescale(vertex, features.maxima(vertex, VERTEX_NAMES)), VERTEX_NAMES)


@query(
    "i8_scaled_by_set", "SELECT r.v1, r.v2, " + ", ".join(f"round(r.{c} / m.{c}, 9) AS {c}" for c in YEARLY_NAMES) + " FROM fresh_raw r JOIN fresh_max m ON true",
    "fresh_raw", "fresh_max",
)
def _(spark, d):
    _, fresh, adj, v, vertex = _vertex_graph(spark, d)
    raw = durable(features.raw_pair_features(fresh, adj, v, vertex, YEAR).select("v1", "v2", *YEARLY_NAMES), "pairs")
    return _round_all(features.rescale(raw, features.maxima(raw, YEARLY_NAMES)), YEARLY_NAMES)


@query(
    "i9_scaled_by_stored_maxima", "SELECT r.v1, r.v2, " + ", ".join(f"round(r.{c} / m.{c}, 9) AS {c}" for c in YEARLY_NAMES) + " FROM fresh_raw r JOIN now_max m ON true",
    "fresh_raw", "now_max",
)
def _(spark, d):
    seen, fresh, adj, v, vertex = _vertex_graph(spark, d)
    past = features.raw_pair_features(graph.connected_pairs(seen, YEAR), adj, v, vertex, YEAR)
    path = shared_path(spark, "maxima")
    features.save_maxima(features.maxima(past, YEARLY_NAMES), spark, path)
    raw = features.raw_pair_features(fresh, adj, v, vertex, YEAR).select("v1", "v2", *YEARLY_NAMES)
    return _round_all(features.rescale(raw, features.load_maxima(spark, path)), YEARLY_NAMES)


@query("i10_feature_matrix", matrix_sql("fresh", "fresh_max"), "fresh_raw", "fresh_max", "vmax")
def _(spark, d):
    seen, fresh = new_pairs(spark, d)
    v = i.vertices(spark, d)
    table = citations.node_table(i.mentions(spark, d), v, FEATURE_YEARS)
    matrix, _ = features.pair_feature_matrix(fresh, graph.adjacency(seen), v, table, YEAR)
    return _round_all(matrix, FEATURES)


# -- samples, splits, evaluation -----------------------------------------------------------------------------------


def _labelled(spark, d):
    return solutions(spark, d).select("v1", "v2", "citation", labels.binary_class(F.col("citation"), 10).alias("class"))


cte("labelled", "SELECT v1, v2, citation, CASE WHEN citation >= 10 THEN 1 ELSE 0 END AS class FROM solutions", "solutions")


@query(
    "j1_two_class_subsets",
    "SELECT * FROM labelled WHERE class = 1 UNION ALL (SELECT * FROM labelled WHERE class = 0 ORDER BY md5('7|' || v1 || '|' || v2), v1, v2 "
    "LIMIT (SELECT CASE WHEN count(*) FILTER (class = 0) > 1000 THEN least(count(*) FILTER (class = 0), count(*) FILTER (class = 1)) ELSE count(*) END FROM labelled))", "labelled",
)
def _(spark, d):
    return evaluate.two_class_subsets(durable(_labelled(spark, d), "labelled"), "class", 7, ["v1", "v2"], limit=1000)


@query(
    "j2_split_per_class",
    "SELECT v1, v2, class, citation, CASE WHEN row_number() OVER (PARTITION BY class ORDER BY md5('7|' || v1 || '|' || v2), v1, v2) <= "
    "floor(count(*) OVER (PARTITION BY class) * 0.85::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM labelled", "labelled",
)
def _(spark, d):
    return evaluate.split_per_class(durable(_labelled(spark, d), "labelled"), "class", 7, ["v1", "v2"])


@query("j1_bottom_k_subsets", ORACLES["j1_two_class_subsets"])
def _(spark, d):
    return bottom_k.two_class_subsets(durable(_labelled(spark, d), "labelled"), "class", 7, ["v1", "v2"], limit=1000)


@query("j2_split_by_cells", ORACLES["j2_split_per_class"])
def _(spark, d):
    return bottom_k.split_per_class(durable(_labelled(spark, d), "labelled"), "class", 7, ["v1", "v2"])


@query(
    "j3_shuffled_solutions",
    "SELECT v1, v2, citation, num, round(citation_m, 9) AS citation_m, row_number() OVER (ORDER BY md5('42|' || v1 || '|' || v2), v1, v2) AS place FROM solutions", "solutions",
)
def _(spark, d):
    rows = durable(solutions(spark, d).withColumn("citation_m", r9(F.col("citation_m"))), "solutions")
    return evaluate.shuffled(rows, 42, ["v1", "v2"])


cte("evalset", "SELECT v1, v2, citation FROM solutions", "solutions")
pair_ctes("evalset", "SELECT v1, v2 FROM evalset", "evalset")


@query("j4_evaluation_features", f"SELECT m.*, e.citation FROM ({matrix_sql('evalset', 'evalset_max')}) m JOIN evalset e USING (v1, v2)", "evalset", "evalset_raw", "evalset_max", "vmax")
def _(spark, d):
    matrix, sample = _evaluation_features(spark, d)
    return matrix.join(sample, ["v1", "v2"])


def _evaluation_features(spark, d):
    """(features of the evaluation pairs, the pairs with their citations)."""
    edges, solved, rest = solution_sets(spark, d)
    sample = durable(labels.all_solutions(solved, rest).select("v1", "v2", "citation"), "evalset")
    v = i.vertices(spark, d)
    table = citations.node_table(i.mentions(spark, d), v, FEATURE_YEARS)
    matrix, _ = features.pair_feature_matrix(sample, graph.adjacency(graph.first_seen(edges)), v, table, YEAR)
    return _round_all(matrix, FEATURES), sample


@query(
    "j4_feature_digest",
    "SELECT CASE WHEN citation > 0 THEN 1 ELSE 0 END AS class, count(*) AS pairs, " + ", ".join(f"CAST(sum(CAST({f} AS DECIMAL(38, 9))) AS DOUBLE) AS {f}" for f in FEATURES)
    + f" FROM ({matrix_sql('evalset', 'evalset_max')}) m JOIN evalset e USING (v1, v2) GROUP BY 1",
    "evalset", "evalset_raw", "evalset_max", "vmax",
)
def _(spark, d):
    """The exact sum of each of the 141 features over all pairs of both classes."""
    matrix, sample = _evaluation_features(spark, d)
    both = matrix.join(sample, ["v1", "v2"]).withColumn("class", labels.binary_class(F.col("citation"), 1))
    return both.groupBy("class").agg(F.count(F.lit(1)).alias("pairs"), *[F.sum(F.col(f).cast("decimal(24,9)")).cast("double").alias(f) for f in FEATURES])


@query(
    "j5_full_train_set",
    f"SELECT v1, v2, citation, time, ct, c{LATER} FROM (SELECT v1, v2, CAST(sum(c{LATER} + c{LATER - 1} + c{LATER - 2}) AS BIGINT) AS citation, max(time) AS time, "
    f"CAST(sum(ct) AS BIGINT) AS ct, CAST(sum(c{LATER}) AS BIGINT) AS c{LATER} FROM edges SEMI JOIN turned USING (v1, v2) WHERE time <= {sql_cutoff(LATER)} GROUP BY v1, v2) "
    "UNION ALL SELECT v1, v2, 0, 0, 0, 0 FROM still", "edges", "turned", "still",
)
def _(spark, d):
    edges, solved, rest = solution_sets(spark, d)
    details = citations.as_of(edges, LATER).groupBy("v1", "v2").agg(
        F.max("time").alias("time"), F.sum("ct").alias("ct"), F.sum(f"c{LATER}").alias(f"c{LATER}")
    )
    connected = solved.select("v1", "v2", "citation").join(details, ["v1", "v2"])
    return labels.all_solutions(connected, rest)


cte("quality", "SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)")


def _quality(spark, d):
    docs = i.table(spark, d, "documents").select("doc_id", "n_chars")
    return i.table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")


@query(
    "j6_auc",
    "SELECT round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0::DOUBLE) "
    "/ (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 9) AS auc FROM (SELECT quality, rank() OVER (ORDER BY n_chars) "
    "+ (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM quality)", "quality",
)
def _(spark, d):
    return evaluate.auc(_quality(spark, d), "n_chars", F.col("quality") == 1).withColumn("auc", r9(F.col("auc")))


@query(
    "j6_roc_points",
    "SELECT t.n_chars AS threshold, round(count(*) FILTER (quality = 0) / (SELECT count(*) FILTER (quality = 0) FROM quality)::DOUBLE, 9) AS fpr, "
    "round(count(*) FILTER (quality = 1) / (SELECT count(*) FILTER (quality = 1) FROM quality)::DOUBLE, 9) AS tpr "
    "FROM (SELECT DISTINCT n_chars FROM quality) t JOIN quality q ON q.n_chars >= t.n_chars GROUP BY t.n_chars", "quality",
)
def _(spark, d):
    return _round_all(evaluate.roc_points(_quality(spark, d), "n_chars", F.col("quality") == 1), ["fpr", "tpr"])


cte(
    "sweep_rows",
    "SELECT ['train', 'test', 'eval'][(l.v1 + l.v2) % 3 + 1] AS part, citation, coalesce(score, 0) AS score FROM labelled l LEFT JOIN scored s USING (v1, v2)",
    "labelled", "scored",
)
cte(
    "sweep",
    "SELECT part, ir, (ranks - p * (p + 1) / 2.0::DOUBLE) / nullif(p * (n - p), 0) AS auc FROM (SELECT part, ir, count(*) AS n, count(*) FILTER (citation >= ir) AS p, "
    "coalesce(sum(r) FILTER (citation >= ir), 0) AS ranks FROM (SELECT *, rank() OVER (PARTITION BY part ORDER BY score) + (count(*) OVER (PARTITION BY part, score) - 1) / 2.0::DOUBLE AS r FROM sweep_rows) "
    "JOIN (SELECT CAST(unnest(range(1, 41)) AS INTEGER) AS ir) ON true GROUP BY part, ir)", "sweep_rows",
)


def _sweep(spark, d):
    rows = _labelled(spark, d).join(i.scored_pairs(spark, d), ["v1", "v2"], "left")
    part = F.element_at(F.array(F.lit("train"), F.lit("test"), F.lit("eval")), (F.col("v1") + F.col("v2")) % 3 + 1)
    rows = rows.select(part.alias("part"), "citation", F.coalesce("score", F.lit(0.0)).alias("score"))
    return evaluate.threshold_sweep(rows, "score", "citation", "part")


@query("j7_threshold_sweep", "SELECT part, ir, round(auc, 9) AS auc FROM sweep", "sweep")
def _(spark, d):
    return _round_all(_sweep(spark, d), ["auc"])


@query(
    "j8_best_threshold",
    "SELECT ir AS best_ir, eval AS best_eval FROM (SELECT ir, round(max(auc) FILTER (part = 'eval'), 6) AS eval FROM sweep GROUP BY ir HAVING count(auc) = 3) ORDER BY eval DESC, ir LIMIT 1",
    "sweep",
)
def _(spark, d):
    lines = evaluate.report_lines(_sweep(spark, d).withColumn("auc", F.round("auc", 6)))
    path = shared_path(spark, "report")
    lines.filter("value is not null").write.text(path)
    return evaluate.best_threshold(spark.read.text(path))


cte(
    "impact_split",
    "SELECT v1, v2, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('7|' || v1 || '|' || v2), v1, v2) <= floor(count(*) OVER (PARTITION BY label) * 0.85::DOUBLE) "
    "THEN 'train' ELSE 'test' END AS part FROM (SELECT v1, v2, CASE WHEN citation >= 1 THEN 1 ELSE 0 END AS label FROM solutions)", "solutions",
)


def _impact_rows(spark, d):
    """Labelled pairs with their part and their features."""
    edges, solved, rest = solution_sets(spark, d)
    pairs = durable(labels.all_solutions(solved, rest).select("v1", "v2", labels.binary_class(F.col("citation"), 1).alias("label")), "labelled")
    parts = durable(evaluate.split_per_class(pairs, "label", 7, ["v1", "v2"]), "impact-parts")
    v = i.vertices(spark, d)
    table = citations.node_table(i.mentions(spark, d), v, FEATURE_YEARS)
    matrix, _ = features.pair_feature_matrix(parts, graph.adjacency(graph.first_seen(edges)), v, table, YEAR)
    return durable(matrix.join(parts, ["v1", "v2"]), "impact-rows")


def _impact(spark, d):
    """Labelled pairs with their part and the score of a model that was fitted on the train part."""
    rows = _impact_rows(spark, d)
    _, score = evaluate.fit_impact(rows.filter("part = 'train'"), FEATURES, maxIter=20, regParam=0.01)
    return score(rows).select("v1", "v2", "label", "part", "score")


@query("j9_impact_scores", "SELECT v1, v2, label, part, true AS in_range FROM impact_split", "impact_split")
def _(spark, d):
    return _impact(spark, d).select("v1", "v2", "label", "part", F.col("score").between(0, 1).alias("in_range"))


@query("j9_impact_auc", "SELECT part, count(*) AS pairs, count(*) FILTER (label = 1) AS positives, true AS above_half FROM impact_split GROUP BY part", "impact_split")
def _(spark, d):
    scored = durable(_impact(spark, d), "impact-scores")
    counts = scored.groupBy("part").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("label") == 1).alias("positives"))
    area = evaluate.auc(scored, "score", F.col("label") == 1, ["part"]).select("part", (F.col("auc") > 0.5).alias("above_half"))
    return counts.join(area, "part")


@query("j9_impact_optimality")
def _(spark, d):
    """The slope of the regularised loss of the train part in all 141 features and the intercept, at the fitted coefficients."""
    rows = _impact_rows(spark, d).filter("part = 'train'")
    model, _ = evaluate.fit_impact(rows, FEATURES, maxIter=300, tol=1e-9, regParam=0.01)
    coefficients, intercept = (model.coefficients, model.intercept) if model else ([None] * len(FEATURES), None)
    slopes = optimality.impact_gradient(rows, FEATURES, "label", coefficients, intercept, 0.01)
    return slopes.withColumn("flat", F.abs("gradient") <= FLAT)


# -- ranking and score analysis ------------------------------------------------------------------------------------


@query("k1_sorted_predictions", "SELECT v1, v2, round(score, 9) AS score FROM scored", "scored")
def _(spark, d):
    return ranking.sort_predictions(i.scored_pairs(spark, d).withColumn("score", r9(F.col("score"))))


cte(
    "open_scored",
    f"SELECT o.v1, o.v2, CASE WHEN a.deg + b.deg - coalesce(n, 0) > 0 THEN coalesce(n, 0)::DOUBLE / (a.deg + b.deg - coalesce(n, 0)) ELSE 0 END AS score FROM open_pairs o "
    f"JOIN deg{YEAR} a ON a.v1 = o.v1 JOIN deg{YEAR} b ON b.v1 = o.v2 LEFT JOIN (SELECT x.src AS v1, y.src AS v2, count(*) AS n FROM g{YEAR} x JOIN g{YEAR} y "
    "ON x.dst = y.dst AND x.src < y.src GROUP BY x.src, y.src) s ON s.v1 = o.v1 AND s.v2 = o.v2", "open_pairs", f"deg{YEAR}", f"g{YEAR}",
)


@query(
    "k2_top_pairs",
    "SELECT t.v1 AS concept1_id, a.concept AS concept1_keyword, t.v2 AS concept2_id, b.concept AS concept2_keyword, round(score, 9) AS score FROM "
    "(SELECT * FROM open_scored ORDER BY score DESC, v1, v2 LIMIT 10) t JOIN concepts a ON a.concept_id = v1 JOIN concepts b ON b.concept_id = v2", "open_scored", "concepts",
)
def _(spark, d):
    best = best_open_pairs(graph.adjacency(graph.first_seen(i.dated_pairs(spark, d))), YEAR, 10)
    return ranking.name_pairs(best.withColumn("score", r9(F.col("score"))), i.concepts(spark, d))


cte("part_near", f"SELECT v1 AS src, v2 AS dst FROM part_seen WHERE first_day <= {sql_cutoff(YEAR)} UNION ALL SELECT v2, v1 FROM part_seen WHERE first_day <= {sql_cutoff(YEAR)}", "part_seen")
cte("part_degree", "SELECT src, count(*) AS deg FROM part_near GROUP BY src", "part_near")
cte("part_shared", "SELECT x.dst AS v1, y.dst AS v2, count(*) AS n FROM part_near x JOIN part_near y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2", "part_near")


@query(
    "k2_top_part_pairs",
    "SELECT s.v1, s.v2, round(n::DOUBLE / (a.deg + b.deg - n), 9) AS score FROM part_shared s JOIN part_degree a ON a.src = s.v1 JOIN part_degree b ON b.src = s.v2 "
    "WHERE NOT EXISTS (SELECT 1 FROM part_near e WHERE e.src = s.v1 AND e.dst = s.v2) ORDER BY n::DOUBLE / (a.deg + b.deg - n) DESC, s.v1, s.v2 LIMIT 100",
    "part_shared", "part_degree", "part_near",
)
def _(spark, d):
    """The best hundred open pairs of the graph of single parts; later pairs, which add nothing to the year, are not shuffled."""
    pairs = i.dated_part_pairs(spark, d).filter(graph.known_in(YEAR, "time"))
    best = best_open_pairs(graph.adjacency(graph.first_seen(pairs)), YEAR, 100)
    return best.withColumn("score", r9(F.col("score")))


cte("early", f"SELECT c.* FROM concepts c SEMI JOIN (SELECT v1 AS concept_id FROM mentions WHERE time <= {sql_cutoff(1995)}) USING (concept_id)", "concepts", "mentions")


@query(
    "k3_named_pairs",
    "SELECT v1 AS concept1_id, coalesce(a.concept, 'Unknown ID') AS concept1_keyword, v2 AS concept2_id, coalesce(b.concept, 'Unknown ID') AS concept2_keyword, round(score, 9) AS score "
    "FROM scored LEFT JOIN early a ON a.concept_id = v1 LEFT JOIN early b ON b.concept_id = v2", "scored", "early",
)
def _(spark, d):
    early = citations.as_of(i.mentions(spark, d), 1995).select(F.col("v1").alias("concept_id"))
    names = i.concepts(spark, d).join(early, "concept_id", "left_semi")
    return ranking.name_pairs(i.scored_pairs(spark, d).withColumn("score", r9(F.col("score"))), names, "Unknown ID")


def _discount_score(spark, d):
    return i.table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("score"))


@query(
    "k4_score_bands",
    "SELECT CASE WHEN s > 0.9::DOUBLE THEN '>0.9' WHEN s > 0.8::DOUBLE THEN '0.8-0.9' WHEN s > 0.7::DOUBLE THEN '0.7-0.8' WHEN s > 0.6::DOUBLE THEN '0.6-0.7' ELSE '<=0.6' END AS band, count(*) AS pairs "
    "FROM (SELECT l_discount * 10 AS s FROM lineitem) GROUP BY 1",
)
def _(spark, d):
    return ranking.score_bands(_discount_score(spark, d))


@query(
    "k5_score_summary",
    "SELECT min(s) AS min_score, max(s) AS max_score, round(avg(s), 9) AS mean_score, median(s) AS median_score, round(stddev_samp(s), 9) AS std_score FROM (SELECT l_discount * 10 AS s FROM lineitem)",
)
def _(spark, d):
    return _round_all(ranking.score_summary(_discount_score(spark, d)), ["mean_score", "std_score"])


@query(
    "k6_rank_and_quantile",
    "SELECT v1, v2, round(score, 9) AS score, rank, round(rank / n::DOUBLE, 9) AS quantile FROM (SELECT *, row_number() OVER (ORDER BY score DESC, v1, v2) AS rank, count(*) OVER () AS n FROM scored)", "scored",
)
def _(spark, d):
    return _round_all(ranking.rank_and_quantile(i.scored_pairs(spark, d)), ["score", "quantile"])


@query(
    "k6_descending_check",
    "SELECT 'rank' AS place, coalesce(bool_and(later), true) AS non_increasing FROM (SELECT score <= lag(score) OVER (ORDER BY score DESC, v1, v2) AS later FROM scored) "
    "UNION ALL SELECT 'pair', coalesce(bool_and(later), true) FROM (SELECT score <= lag(score) OVER (ORDER BY v1, v2) AS later FROM scored)", "scored",
)
def _(spark, d):
    """In the order of ranks, where it holds, and in the order of pairs, where it need not."""
    rows = durable(i.scored_pairs(spark, d), "scored")
    ranked = ranking.descending_check(ranking.rank_and_quantile(rows), ["rank"]).select(F.lit("rank").alias("place"), "non_increasing")
    return ranked.unionByName(ranking.descending_check(rows, ["v1", "v2"]).select(F.lit("pair").alias("place"), "non_increasing"))


@query(
    "k7_cumulative_share",
    "SELECT v1, v2, round(score, 9) AS score, round(sum(score) OVER (ORDER BY score DESC, v1, v2 ROWS UNBOUNDED PRECEDING) / sum(score) OVER (), 6) AS cum_share FROM scored", "scored",
)
def _(spark, d):
    shares = ranking.cumulative_share(i.scored_pairs(spark, d))
    return shares.select("v1", "v2", r9(F.col("score")).alias("score"), F.round("cum_share", 6).alias("cum_share"))


cte(
    "categorised",
    "SELECT v1, v2, score, a.category AS concept1_category, b.category AS concept2_category FROM scored JOIN concepts a ON a.concept_id = v1 JOIN concepts b ON b.concept_id = v2",
    "scored", "concepts",
)


def _categorised(spark, d):
    names = i.concepts(spark, d)
    return ranking.attach_categories(ranking.name_pairs(i.scored_pairs(spark, d), names), names, "concept", "category")


@query("k8_entity_categories", "SELECT v1 AS concept1_id, v2 AS concept2_id, concept1_category, concept2_category FROM categorised", "categorised")
def _(spark, d):
    return _categorised(spark, d).select("concept1_id", "concept2_id", "concept1_category", "concept2_category")


@query("k8_last_category", "SELECT entity_name, arg_max(entity_type, start_pos) AS entity_type FROM entities GROUP BY entity_name", "entities")
def _(spark, d):
    return ranking.entity_categories(i.entities(spark, d), "entity_name", "entity_type", "start_pos")


@query("k9_category_counts", "SELECT p_type AS category, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 2) AS percentage FROM part GROUP BY p_type")
def _(spark, d):
    return ranking.category_counts(i.table(spark, d, "part").select(F.col("p_type").alias("category")))


cte(
    "matrix",
    "SELECT a.category AS category1, b.category AS category2, m.avg_score, coalesce(m.count, 0) AS count, coalesce(m.std, 0) AS std "
    "FROM (SELECT DISTINCT category FROM concepts) a JOIN (SELECT DISTINCT category FROM concepts) b ON a.category <= b.category LEFT JOIN "
    "(SELECT least(concept1_category, concept2_category) AS c1, greatest(concept1_category, concept2_category) AS c2, avg(score) AS avg_score, count(*) AS count, stddev_samp(score) AS std "
    "FROM categorised GROUP BY 1, 2) m ON m.c1 = a.category AND m.c2 = b.category", "concepts", "categorised",
)


@query("k10_category_matrix", "SELECT category1, category2, round(avg_score, 9) AS avg_score, count, round(std, 9) AS std FROM matrix", "matrix")
def _(spark, d):
    return _round_all(ranking.category_matrix(_categorised(spark, d)), ["avg_score", "std"])


@query(
    "k10_category_matrix_wide",
    "SELECT category1, " + ", ".join(f"round(max(avg_score) FILTER (category2 = 'Brand#{k}'), 9) AS \"Brand#{k}\"" for k in range(1, 26))
    + " FROM (SELECT category1, category2, avg_score FROM matrix UNION SELECT category2, category1, avg_score FROM matrix) GROUP BY category1", "matrix",
)
def _(spark, d):
    wide = ranking.category_matrix_wide(ranking.category_matrix(_categorised(spark, d)))
    return wide.select("category1", *[r9(F.col(f"`{c}`")).alias(c) for c in wide.columns if c != "category1"])


@query("k11_count_score_correlation", "SELECT round(corr(count, avg_score), 6) AS pearson FROM matrix WHERE count > 0", "matrix")
def _(spark, d):
    return ranking.count_score_correlation(ranking.category_matrix(_categorised(spark, d))).withColumn("pearson", F.round("pearson", 6))


@query(
    "k12_padded_range",
    "SELECT round(l, 9) AS low, round(h, 9) AS high, round(l - (h - l) * 0.05::DOUBLE, 9) AS padded_low, round(h + (h - l) * 0.05::DOUBLE, 9) AS padded_high FROM (SELECT min(avg_score) AS l, max(avg_score) AS h FROM matrix)", "matrix",
)
def _(spark, d):
    df = ranking.padded_range(ranking.category_matrix(_categorised(spark, d)))
    return _round_all(df, df.columns)
