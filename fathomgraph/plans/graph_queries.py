"""Queries E to H: year pivots, citation tables, graphs and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations, cooccur, graph, labels
from ..session import durable
from ..sources import stored
from . import inputs as i
from .inputs import C_COLUMNS, FEATURE_YEARS, LATER, YEAR, YEARS, r9, sql_cutoff
from .registry import cte, query

CUT = sql_cutoff(YEAR)
CUT_LATER = sql_cutoff(LATER)

# -- co-occurrence -------------------------------------------------------------------------------------------------


@query("c4_mention_table", f"SELECT paper_id, v1, time, ct, {', '.join(C_COLUMNS)} FROM mentions", "mentions")
def _(spark, d):
    return i.mentions(spark, d)


@query("c6_cooccurrence", "SELECT paper_id, v1, v2, time, ct FROM edges", "edges")
def _(spark, d):
    return i.edges(spark, d).select("paper_id", "v1", "v2", "time", "ct")


_OCC = "SELECT l_orderkey AS paper_id, v1, l_linenumber AS line, l_partkey AS part FROM lineitem JOIN concept_of ON l_partkey = p_partkey"


@query(
    "c7_cooccurrence_occurrences",
    f"SELECT v1, v2, count(*) AS n FROM (SELECT a.v1, b.v1 AS v2 FROM ({_OCC}) a JOIN ({_OCC}) b "
    "ON a.paper_id = b.paper_id AND (a.line < b.line OR (a.line = b.line AND a.part < b.part))) GROUP BY v1, v2", "concept_of",
)
def _(spark, d):
    part = i.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), i._concept())
    rows = i.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(part, "l_partkey")
    pairs = cooccur.cooccurrence_occurrences(rows, "l_orderkey", "v1", ["l_linenumber", "l_partkey"])
    return pairs.groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c8_pair_volume",
    "SELECT count(*) FILTER (n <= 5) AS papers_within, count(*) FILTER (n > 5) AS papers_above, "
    "CAST(sum(CASE WHEN n <= 5 THEN n * (n - 1) // 2 ELSE 0 END) AS BIGINT) AS pairs_within, "
    "CAST(sum(CASE WHEN n > 5 THEN n * (n - 1) // 2 ELSE 0 END) AS BIGINT) AS pairs_above FROM (SELECT count(*) AS n FROM bare GROUP BY paper_id)", "bare",
)
def _(spark, d):
    return cooccur.pair_volume(i.bare_mentions(spark, d), "paper_id", "v1", 5)


@query("c9_cited_only", "SELECT paper_id, v1, ct FROM mentions WHERE ct <> 0", "mentions")
def _(spark, d):
    return cooccur.cited_only(i.mentions(spark, d)).select("paper_id", "v1", "ct")


@query("c9_cited_report", "SELECT count(*) AS before, count(*) FILTER (ct <> 0) AS after FROM mentions", "mentions")
def _(spark, d):
    return cooccur.cited_report(i.mentions(spark, d))


# -- year pivots ---------------------------------------------------------------------------------------------------


@query("e1_pivot_mentions", f"SELECT paper_id, time, ct, {', '.join(C_COLUMNS)} FROM papers", "papers")
def _(spark, d):
    return citations.pivot_list(i.papers_with_counts(spark, d), "counts_by_year", YEARS).select("paper_id", "time", "ct", *C_COLUMNS)


@query("e2_pivot_edges", f"SELECT paper_id, v1, v2, time, ct, {', '.join(C_COLUMNS)} FROM edges", "edges")
def _(spark, d):
    counted = i.papers_with_counts(spark, d).withColumn(
        "counts_by_year", F.map_from_entries(F.slice(F.col("counts_by_year"), 2, len(YEARS)))
    )
    pairs = cooccur.cooccurrence(i.bare_mentions(spark, d).join(counted, "paper_id"), "paper_id", "v1", carry=["time", "ct", "counts_by_year"])
    return citations.pivot_map(pairs, "counts_by_year", YEARS).select("paper_id", "v1", "v2", "time", "ct", *C_COLUMNS)


@query(
    "e2_mixed_records",
    f"SELECT paper_id, time, ct, {', '.join(f'CASE WHEN paper_id % 4 < 2 THEN {c} ELSE 0 END AS {c}' for c in C_COLUMNS)} FROM papers WHERE paper_id % 4 <> 3", "papers",
)
def _(spark, d):
    """By paper: counts as a list, as an object, none, and records that are too short."""
    counted, kind = i.papers_with_counts(spark, d), F.col("paper_id") % 4
    listed, mapped = F.to_json("counts_by_year"), F.to_json(F.map_from_entries(F.slice("counts_by_year", 2, len(YEARS))))
    head = F.concat_ws(",", F.col("paper_id"), F.lit(0), F.col("time"), F.col("ct"))
    text = F.when(kind == 0, F.concat_ws(",", head, listed)).when(kind == 1, F.concat_ws(",", head, mapped)).when(kind == 2, head).otherwise(F.lit("1,2,3"))
    records = counted.select("paper_id", F.parse_json(F.concat(F.lit("["), text, F.lit("]"))).alias("record"))
    return citations.pivot_records(records, "record", YEARS).select("paper_id", "time", "ct", *C_COLUMNS)


@query(
    "e2_length_report",
    "SELECT CAST(CASE WHEN k = 0 THEN 0 ELSE k + 1 END AS INTEGER) AS entries, count(*) AS rows FROM (SELECT "
    + " + ".join(f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END" for c in C_COLUMNS) + " AS k FROM papers) GROUP BY 1", "papers",
)
def _(spark, d):
    return citations.length_report(i.papers_with_counts(spark, d), "counts_by_year")


@query(
    "e3_bare_pairs",
    "SELECT v1, v2, 0 AS time, CAST(0 AS BIGINT) AS ct, " + ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in C_COLUMNS) + " FROM seen", "seen",
)
def _(spark, d):
    return citations.zero_years(graph.first_seen(i.dated_pairs(spark, d)).select("v1", "v2"), YEARS)


@query(
    "e4_unpivot", " UNION ALL ".join(f"SELECT paper_id, {y} AS year, c{y} AS c FROM papers" for y in YEARS), "papers",
)
def _(spark, d):
    return citations.unpivot_years(i.papers(spark, d), ["paper_id"])


# -- yearly citation tables ----------------------------------------------------------------------------------------


def _known(y: int) -> str:
    return "ct" + "".join(f" - c{k}" for k in YEARS if k > y)


def _recent(y: int) -> str:
    return " + ".join(f"c{k}" for k in range(y, y - 3, -1) if k in YEARS)


def _yearly_sql(source: str, keys: str, years, round_: bool = True) -> str:
    def mean(c: str) -> str:
        return f"round(CAST({c} AS DOUBLE) / num, 9) AS {c}_m" if round_ else f"CAST({c} AS DOUBLE) / num AS {c}_m"

    inner = " UNION ALL ".join(
        f"SELECT {y} AS year, {keys}, CAST(sum(c{y}) AS BIGINT) AS c, CAST(sum({_known(y)}) AS BIGINT) AS ct_y, "
        f"CAST(sum({_recent(y)}) AS BIGINT) AS ct_delta, count(*) AS num FROM {source} WHERE time <= {sql_cutoff(y)} GROUP BY {keys}"
        for y in years
    )
    return f"SELECT *, {mean('c')}, {mean('ct_y')}, {mean('ct_delta')} FROM ({inner})"


def _rounded(df):
    return df.withColumns({c: r9(F.col(c)) for c in ("c_m", "ct_y_m", "ct_delta_m")})


cte("node_raw", _yearly_sql("mentions", "v1", YEARS, round_=False), "mentions")
cte(
    "node_table",
    "SELECT y.year, v.v1, coalesce(c, 0) AS c, coalesce(ct_y, 0) AS ct_y, coalesce(ct_delta, 0) AS ct_delta, coalesce(num, 0) AS num, "
    "coalesce(c_m, 0) AS c_m, coalesce(ct_y_m, 0) AS ct_y_m, coalesce(ct_delta_m, 0) AS ct_delta_m "
    "FROM vertices v JOIN (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS year) y ON true LEFT JOIN node_raw n ON n.v1 = v.v1 AND n.year = y.year",
    "vertices", "node_raw",
)


@query(
    "f1_as_of", " UNION ALL ".join(f"SELECT {y} AS year, paper_id, v1 FROM mentions WHERE time <= {sql_cutoff(y)}" for y in FEATURE_YEARS), "mentions",
)
def _(spark, d):
    return graph.by_year(i.mentions(spark, d).select("paper_id", "v1", "time"), FEATURE_YEARS, "time")


@query("f2_known_total", f"SELECT paper_id, {YEAR} AS year, {_known(YEAR)} AS ct_y FROM papers WHERE time <= {CUT}", "papers")
def _(spark, d):
    p = citations.as_of(i.papers(spark, d), YEAR)
    return p.select("paper_id", F.lit(YEAR).alias("year"), citations.known_total(YEAR, YEARS).alias("ct_y"))


@query("f3_recent_total", f"SELECT paper_id, {_recent(YEAR)} AS ct_delta, {_recent(1996)} AS ct_delta_1996 FROM papers WHERE time <= {CUT}", "papers")
def _(spark, d):
    p = citations.as_of(i.papers(spark, d), YEAR)
    return p.select(
        "paper_id", citations.recent_total(YEAR, YEARS).alias("ct_delta"), citations.recent_total(1996, YEARS).alias("ct_delta_1996")
    )


@query(
    "f4_node_sums", f"SELECT year, v1, c, ct_y, ct_delta, num FROM ({_yearly_sql('mentions', 'v1', YEARS)})", "mentions",
)
def _(spark, d):
    return citations.yearly_table(i.mentions(spark, d), ["v1"], YEARS).select("year", "v1", "c", "ct_y", "ct_delta", "num")


@query(
    "f5_node_means", f"SELECT year, v1, c_m, ct_y_m, ct_delta_m FROM ({_yearly_sql('mentions', 'v1', YEARS)})", "mentions",
)
def _(spark, d):
    return _rounded(citations.yearly_table(i.mentions(spark, d), ["v1"], YEARS)).select("year", "v1", "c_m", "ct_y_m", "ct_delta_m")


@query(
    "f6_node_table",
    "SELECT year, v1, c, ct_y, ct_delta, num, round(c_m, 9) AS c_m, round(ct_y_m, 9) AS ct_y_m, round(ct_delta_m, 9) AS ct_delta_m FROM node_table",
    "node_table",
)
def _(spark, d):
    return _rounded(citations.node_table(i.mentions(spark, d), i.vertices(spark, d), YEARS))


@query("f7_pair_table", _yearly_sql("edges", "v1, v2", FEATURE_YEARS), "edges")
def _(spark, d):
    return _rounded(citations.yearly_table(i.edges(spark, d), ["v1", "v2"], FEATURE_YEARS))


# -- graphs --------------------------------------------------------------------------------------------------------


def _adj(spark, d):
    return graph.adjacency(graph.first_seen(i.dated_pairs(spark, d)))


@query("g1_adjacency", " UNION ALL ".join(f"SELECT {y} AS year, src, dst FROM adj WHERE first_day <= {sql_cutoff(y)}" for y in FEATURE_YEARS), "adj")
def _(spark, d):
    return graph.by_year(_adj(spark, d), FEATURE_YEARS)


@query(
    "g2_graph_size",
    " UNION ALL ".join(
        f"SELECT {y} AS year, (SELECT count(*) FROM vertices) AS nodes, (SELECT count(*) FROM adj WHERE first_day <= {sql_cutoff(y)}) / 2.0::DOUBLE AS edges"
        for y in YEARS
    ), "adj", "vertices",
)
def _(spark, d):
    return graph.graph_size(_adj(spark, d), i.vertices(spark, d), YEARS)


@query(
    "g3_neighbour_lists",
    f"SELECT {YEAR} AS year, src, CAST(0 AS INTEGER) AS span_no, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM adj WHERE first_day <= {CUT} GROUP BY src",
    "adj",
)
def _(spark, d):
    lists = graph.neighbour_lists(_adj(spark, d), [YEAR])
    return lists.withColumn("neighbours", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ","))


@query(
    "g4_degree",
    "SELECT v.v1, " + ", ".join(f"count(*) FILTER (first_day <= {sql_cutoff(y)}) AS d{y}" for y in FEATURE_YEARS)
    + " FROM vertices v LEFT JOIN adj ON src = v.v1 GROUP BY v.v1", "adj", "vertices",
)
def _(spark, d):
    return graph.degrees(_adj(spark, d), i.vertices(spark, d), FEATURE_YEARS)


def pagerank_ctes(y: int, steps: int) -> list[str]:
    """Unrolled power iteration of one year: names pr{y}_0 .. pr{y}_{steps}."""
    cte(f"g{y}", f"SELECT src, dst FROM adj WHERE first_day <= {sql_cutoff(y)}", "adj")
    cte(f"deg{y}", f"SELECT v.v1, count(src) AS deg FROM vertices v LEFT JOIN g{y} ON src = v.v1 GROUP BY v.v1", f"g{y}", "vertices")
    cte(f"pr{y}_0", "SELECT v1, 1.0::DOUBLE / (SELECT count(*) FROM vertices) AS r FROM vertices", "vertices")
    for k in range(1, steps + 1):
        cte(
            f"pr{y}_{k}",
            f"SELECT d.v1, 0.85::DOUBLE * (coalesce(s.r, 0) + (SELECT coalesce(sum(p.r), 0) FROM pr{y}_{k-1} p JOIN deg{y} z ON z.v1 = p.v1 AND z.deg = 0) "
            f"/ (SELECT count(*) FROM vertices)) + 0.15::DOUBLE / (SELECT count(*) FROM vertices) AS r FROM deg{y} d LEFT JOIN "
            f"(SELECT dst, sum(p.r / z.deg) AS r FROM g{y} JOIN pr{y}_{k-1} p ON p.v1 = src JOIN deg{y} z ON z.v1 = src GROUP BY dst) s ON s.dst = d.v1",
            f"pr{y}_{k-1}", f"deg{y}",
        )
    return [f"pr{y}_{k}" for k in range(steps + 1)]


STEPS = 20
for _y in FEATURE_YEARS:
    pagerank_ctes(_y, STEPS)


def _converged_sql(y: int, steps: int) -> str:
    """The ranks of the first step whose total change is below vertices x 1e-6."""
    steps_sql = " UNION ALL ".join(f"SELECT {k} AS k, a.v1, a.r, abs(a.r - b.r) AS e FROM pr{y}_{k} a JOIN pr{y}_{k-1} b ON a.v1 = b.v1" for k in range(1, steps + 1))
    return (
        f"SELECT v1, r FROM (SELECT *, sum(e) OVER (PARTITION BY k) AS drift FROM ({steps_sql})) "
        "WHERE k = (SELECT min(k) FROM (SELECT k, sum(e) AS drift FROM (" + steps_sql + ") GROUP BY k) WHERE drift < (SELECT count(*) FROM vertices) * 1e-6)"
    )


for _y in FEATURE_YEARS:
    cte(f"pr{_y}", _converged_sql(_y, STEPS), f"pr{_y}_{STEPS}")


@query("g5_pagerank", f"SELECT v1, round(r, 9) AS pagerank FROM pr{YEAR}", f"pr{YEAR}")
def _(spark, d):
    adj = durable(_adj(spark, d), "adjacency")
    ranks = graph.pagerank(adj, i.vertices(spark, d), [YEAR])
    return ranks.select("v1", r9(F.col(f"pr{YEAR}")).alias("pagerank"))


def new_pairs(spark, d):
    """Pairs that are not yet an edge in YEAR but are one in LATER."""
    seen = durable(graph.first_seen(i.dated_pairs(spark, d)), "seen")
    fresh = seen.filter(~graph.known_in(YEAR) & graph.known_in(LATER)).select("v1", "v2")
    return seen, fresh


cte("fresh", f"SELECT v1, v2 FROM seen WHERE first_day > {CUT} AND first_day <= {CUT_LATER}", "seen")
cte(
    "common",
    "SELECT f.v1, f.v2, " + ", ".join(f"count(*) FILTER (a.first_day <= {sql_cutoff(y)} AND b.first_day <= {sql_cutoff(y)}) AS n{y}" for y in FEATURE_YEARS)
    + " FROM fresh f LEFT JOIN adj a ON a.src = f.v1 LEFT JOIN adj b ON b.src = f.v2 AND b.dst = a.dst GROUP BY f.v1, f.v2", "fresh", "adj",
)


@query("g6_shared_neighbours", "SELECT * FROM common", "common")
def _(spark, d):
    seen, fresh = new_pairs(spark, d)
    adj = graph.adjacency(seen)
    return graph.shared_neighbours(fresh, adj, graph.degrees(adj, i.vertices(spark, d), FEATURE_YEARS), FEATURE_YEARS)


@query("g7_distinct_pairs", f"SELECT v1, v2 FROM seen WHERE first_day <= {CUT}", "seen")
def _(spark, d):
    return graph.connected_pairs(graph.first_seen(i.dated_pairs(spark, d)), YEAR)


@query(
    "g8_ordering_check",
    "SELECT 'edges' AS pairs, coalesce(bool_and(v1 < v2), true) AS all_ordered FROM edges UNION ALL SELECT 'neighbours', coalesce(bool_and(src < dst), true) FROM adj", "edges", "adj",
)
def _(spark, d):
    pairs = i.dated_pairs(spark, d)
    both = graph.adjacency(graph.first_seen(pairs)).select(F.col("src").alias("v1"), F.col("dst").alias("v2"))
    reports = [graph.ordering_report(p).select(F.lit(n).alias("pairs"), "all_ordered") for n, p in (("edges", pairs), ("neighbours", both))]
    return reports[0].unionByName(reports[1])


@query(
    "g9_active_vertices",
    f"SELECT v, count(*) AS degree FROM (SELECT unnest([v1, v2]) AS v FROM seen WHERE first_day <= {CUT}) GROUP BY v HAVING count(*) >= 1", "seen",
)
def _(spark, d):
    return graph.active_vertices(graph.connected_pairs(graph.first_seen(i.dated_pairs(spark, d)), YEAR), 1)


cte("active", f"SELECT DISTINCT unnest([v1, v2]) AS v FROM seen WHERE first_day <= {CUT}", "seen")
cte(
    "sharing",
    f"SELECT a.dst AS v1, b.dst AS v2, count(*) AS shared FROM adj a JOIN adj b ON a.src = b.src AND a.dst < b.dst WHERE a.first_day <= {CUT} AND b.first_day <= {CUT} "
    "AND a.src <> a.dst AND b.src <> b.dst GROUP BY 1, 2", "adj",
)
cte("open_pairs", f"SELECT v1, v2 FROM sharing ANTI JOIN (SELECT v1, v2 FROM seen WHERE first_day <= {CUT}) USING (v1, v2)", "sharing", "seen")


def open_pairs(spark, d):
    """(dated pairs, pairs that share a neighbour in YEAR and are not an edge in YEAR)."""
    seen = durable(graph.first_seen(i.dated_pairs(spark, d)), "seen")
    return seen, graph.open_sharing_pairs(graph.adjacency(seen), YEAR)


@query("g10_sharing_pairs", "SELECT * FROM sharing", "sharing")
def _(spark, d):
    return graph.sharing_pairs(graph.adjacency(graph.first_seen(i.dated_pairs(spark, d))), YEAR)


@query(
    "g10_pair_counts",
    "SELECT n AS vertices, n * (n - 1) // 2 AS pairs, e AS connected, o AS sharing, n * (n - 1) // 2 - e - o AS other FROM (SELECT (SELECT count(*) FROM active) AS n, "
    f"(SELECT count(*) FROM seen WHERE first_day <= {CUT} AND v1 <> v2) AS e, (SELECT count(*) FROM open_pairs) AS o)", "active", "seen", "open_pairs",
)
def _(spark, d):
    seen = durable(graph.first_seen(i.dated_pairs(spark, d)), "seen")
    now = graph.connected_pairs(seen, YEAR)
    return graph.pair_counts(graph.active_vertices(now), now, graph.sharing_pairs(graph.adjacency(seen), YEAR))


@query("g11_unconnected_pairs", "SELECT * FROM open_pairs", "open_pairs")
def _(spark, d):
    return open_pairs(spark, d)[1]


@query(
    "g12_transition",
    f"SELECT o.v1, o.v2, s.v1 IS NOT NULL AS connected FROM open_pairs o LEFT JOIN (SELECT v1, v2 FROM seen WHERE first_day <= {CUT_LATER}) s USING (v1, v2)",
    "open_pairs", "seen",
)
def _(spark, d):
    seen, free = open_pairs(spark, d)
    return graph.transition(free, graph.connected_pairs(seen, LATER))


# -- future citations ----------------------------------------------------------------------------------------------

_RECENT_LATER = _recent(LATER)
cte("turned", f"SELECT v1, v2 FROM seen WHERE first_day > {CUT} AND first_day <= {CUT_LATER} AND v1 IN (SELECT v FROM active) AND v2 IN (SELECT v FROM active)", "active", "seen")
cte("still", f"SELECT v1, v2 FROM open_pairs ANTI JOIN (SELECT v1, v2 FROM seen WHERE first_day <= {CUT_LATER}) USING (v1, v2)", "open_pairs", "seen")
cte(
    "solved",
    f"SELECT v1, v2, CAST(sum({_RECENT_LATER}) AS BIGINT) AS citation, count(*) AS num, CAST(sum({_RECENT_LATER}) AS DOUBLE) / count(*) AS citation_m "
    f"FROM edges SEMI JOIN turned USING (v1, v2) WHERE time <= {CUT_LATER} GROUP BY v1, v2", "edges", "turned",
)
cte("solutions", "SELECT v1, v2, citation, num, citation_m FROM solved UNION ALL SELECT v1, v2, 0, 0, 0 FROM still", "solved", "still")


def solution_sets(spark, d):
    """(edges, connected solutions, unconnected solutions) as seen in LATER: the pairs open in YEAR that became edges, and
    those that share a neighbour in YEAR and did not."""
    edges = durable(i.edges(spark, d), "edges")
    seen = durable(graph.first_seen(edges), "seen")
    solved = labels.connected_solutions(graph.newly_connected(seen, YEAR, LATER), edges, LATER)
    return edges, solved, labels.unconnected_solutions(graph.open_sharing_pairs(graph.adjacency(seen), YEAR, LATER))


def solutions(spark, d):
    _, solved, rest = solution_sets(spark, d)
    return labels.all_solutions(solved, rest)


@query("h1_connected_solutions", "SELECT v1, v2, citation, num, round(citation_m, 9) AS citation_m FROM solved", "solved")
def _(spark, d):
    edges = durable(i.edges(spark, d), "edges")
    fresh = graph.newly_connected(graph.first_seen(edges), YEAR, LATER)
    return labels.connected_solutions(fresh, edges, LATER).withColumn("citation_m", r9(F.col("citation_m")))


@query("h2_all_solutions", "SELECT v1, v2, citation, num, round(citation_m, 9) AS citation_m FROM solutions", "solutions")
def _(spark, d):
    return solutions(spark, d).withColumn("citation_m", r9(F.col("citation_m")))


@query(
    "h2_ungrouped_records",
    f"SELECT v1, v2, paper_id, {_RECENT_LATER} AS citation FROM edges SEMI JOIN turned USING (v1, v2) WHERE time <= {CUT_LATER}", "edges", "turned",
)
def _(spark, d):
    edges = durable(i.edges(spark, d), "edges")
    return labels.connected_records(graph.newly_connected(graph.first_seen(edges), YEAR, LATER), edges, LATER)


@query("h3_binary_class", "SELECT v1, v2, CASE WHEN citation >= 10 THEN 1 ELSE 0 END AS class FROM solutions", "solutions")
def _(spark, d):
    return solutions(spark, d).select("v1", "v2", labels.binary_class(F.col("citation"), 10).alias("class"))


@query(
    "h4_conditional_split",
    "SELECT v1, v2, class FROM (SELECT v1, v2, CASE WHEN citation BETWEEN 0 AND 5 THEN 0 WHEN citation >= 20 THEN 1 END AS class FROM solutions) WHERE class IS NOT NULL",
    "solutions",
)
def _(spark, d):
    return solutions(spark, d).select(
        "v1", "v2", labels.conditional_class(F.col("citation"), [(0, 5)], 20, gap=None).alias("class")
    ).filter("class is not null")


@query(
    "h4_conditional_classify",
    "SELECT v1, v2, CASE WHEN citation >= 20 THEN 1 ELSE 0 END AS class FROM solutions", "solutions",
)
def _(spark, d):
    return solutions(spark, d).select("v1", "v2", labels.conditional_class(F.col("citation"), [(0, 5)], 20, gap=0).alias("class"))


@query(
    "h5_label_single_year",
    f"SELECT f.v1, f.v2, CAST(coalesce(sum(c{LATER}), 0) AS BIGINT) AS label FROM fresh f LEFT JOIN (SELECT * FROM edges WHERE time <= {CUT_LATER}) e USING (v1, v2) GROUP BY 1, 2",
    "fresh", "edges",
)
def _(spark, d):
    edges = durable(i.edges(spark, d), "edges")
    seen = graph.first_seen(edges)
    fresh = seen.filter(~graph.known_in(YEAR) & graph.known_in(LATER)).select(F.col("v2").alias("v1"), F.col("v1").alias("v2"))
    return labels.label_single_year(fresh, edges, LATER)


cte("ended", "SELECT f.v1, f.v2, CAST(coalesce(sum(c2001), 0) AS BIGINT) AS y2024, CAST(coalesce(sum(c1999), 0) AS BIGINT) AS y1999, CAST(coalesce(sum(ct), 0) AS BIGINT) AS y1990 FROM fresh f LEFT JOIN edges e USING (v1, v2) GROUP BY 1, 2", "fresh", "edges")


@query(
    "h6_label_latest_year",
    "SELECT v1, v2, last_year, label, CASE WHEN label >= 10 THEN 1 ELSE 0 END AS class FROM (SELECT v1, v2, 2024 AS last_year, y2024 AS label FROM ended "
    "UNION ALL SELECT v1, v2, 1999, y1999 FROM ended UNION ALL SELECT v1, v2, 1990, y1990 FROM ended)", "ended",
)
def _(spark, d):
    """Beyond the data, inside it, and before it, where the total stands in."""
    edges = durable(i.edges(spark, d), "edges")
    fresh = graph.first_seen(edges).filter(~graph.known_in(YEAR) & graph.known_in(LATER))
    out = [labels.label_latest_year(fresh, edges, y).select("v1", "v2", F.lit(y).alias("last_year"), "label") for y in (2024, 1999, 1990)]
    rows = out[0].unionByName(out[1]).unionByName(out[2])
    return rows.withColumn("class", labels.binary_class(F.col("label"), 10))


@query(
    "h7_label_from_solutions",
    "SELECT s.v1, s.v2, round(score, 9) AS score, label FROM scored s JOIN (SELECT v1, v2, 1 AS label FROM turned UNION ALL SELECT v1, v2, 0 FROM still) USING (v1, v2)",
    "scored", "turned", "still",
)
def _(spark, d):
    _, solved, rest = solution_sets(spark, d)
    return labels.label_from_solutions(i.scored_pairs(spark, d).withColumn("score", r9(F.col("score"))), solved, rest)


@query("h7_label_from_solutions_all_open")
def _(spark, d):
    """Label 0 for every scored pair that stays open; h7_label_from_solutions and its twin ask for a shared neighbour."""
    seen = durable(graph.first_seen(i.edges(spark, d)), "seen")
    scored = durable(i.scored_pairs(spark, d), "scored")
    rest = graph.still_open(scored, seen, YEAR, LATER)
    return labels.label_from_solutions(scored.withColumn("score", r9(F.col("score"))), graph.newly_connected(seen, YEAR, LATER), rest)


@query(
    "h8_feature_lookup",
    "SELECT o.v1, o.v2, round(score, 9) AS score, s.v1 IS NOT NULL AS found FROM open_pairs o LEFT JOIN scored s USING (v1, v2)", "open_pairs", "scored",
)
def _(spark, d):
    _, free = open_pairs(spark, d)
    return labels.lookup_features(free, i.scored_pairs(spark, d).withColumn("score", r9(F.col("score"))))


@query(
    "h8_lookup_misses",
    "SELECT count(*) AS pairs, count(*) FILTER (s.v1 IS NULL) AS misses FROM open_pairs o LEFT JOIN scored s USING (v1, v2)", "open_pairs", "scored",
)
def _(spark, d):
    _, free = open_pairs(spark, d)
    return labels.lookup_report(labels.lookup_features(free, i.scored_pairs(spark, d)))


@query(
    "h8_stored_lookup",
    "SELECT o.v1, o.v2, round(score / top, 9) AS score, s.v1 IS NOT NULL AS found FROM open_pairs o LEFT JOIN scored s USING (v1, v2), (SELECT max(score) AS top FROM scored)",
    "open_pairs", "scored",
)
def _(spark, d):
    """Look-ups in a stored, bucketed table, scaled by the maxima stored with it."""
    _, free = open_pairs(spark, d)
    kept = stored.store_pairs(i.scored_pairs(spark, d).select("v1", "v2", "score"))
    return stored.look_up(free, kept, scaled=True).withColumn("score", r9(F.col("score")))
