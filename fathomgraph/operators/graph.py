"""Yearly co-occurrence graphs from one table: each undirected edge with the first day it was seen.

The graph of year y is the rows whose first day is not after 31 December of y, so several years are read in one pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import cutoff_day
from ..session import broadcast_if_small, discard, discard_path, durable, shared_path


def first_seen(edges: DataFrame) -> DataFrame:
    """One row (v1 <= v2, first_day) per undirected edge of the multigraph; combined before the shuffle."""
    return edges.groupBy(F.least("v1", "v2").alias("v1"), F.greatest("v1", "v2").alias("v2")).agg(
        F.min("time").alias("first_day")
    )


def adjacency(seen: DataFrame) -> DataFrame:
    """Both directions (src, dst, first_day); a self-loop stays one row."""
    ends = F.when(
        F.col("v1") == F.col("v2"), F.array(F.struct(F.col("v1").alias("src"), F.col("v2").alias("dst")))
    ).otherwise(
        F.array(
            F.struct(F.col("v1").alias("src"), F.col("v2").alias("dst")),
            F.struct(F.col("v2").alias("src"), F.col("v1").alias("dst")),
        )
    )
    return seen.select(F.inline(ends), "first_day")


def known_in(year: int, day: str = "first_day") -> Column:
    return F.col(day) <= cutoff_day(year)


def by_year(rows: DataFrame, years: Sequence[int], day: str = "first_day") -> DataFrame:
    """One copy of each row per listed year in which it is known."""
    known = F.filter(F.array(*[F.when(known_in(y, day), F.lit(y)) for y in years]), lambda y: y.isNotNull())
    return rows.select(F.explode(known).alias("year"), *[c for c in rows.columns if c != day])


def graph_size(adj: DataFrame, vertices: DataFrame, years: Sequence[int]) -> DataFrame:
    """(year, nodes, edges); edges = half of the 0/1 entries, so a self-loop counts one half."""
    counts = adj.agg(*[F.count_if(known_in(y)).alias(f"n{y}") for y in years]).first()
    nodes = vertices.count()
    return adj.sparkSession.createDataFrame(
        [(y, nodes, counts[f"n{y}"] / 2) for y in years], "year int, nodes bigint, edges double"
    )


def neighbour_lists(adj: DataFrame, years: Sequence[int], span: int = 4096) -> DataFrame:
    """(year, src, span_no, neighbours): sorted neighbour lists, cut by vertex-id span so that no list is unbounded."""
    return (
        by_year(adj, years)
        .groupBy("year", "src", F.floor(F.col("dst") / span).cast("int").alias("span_no"))
        .agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))
    )


def degrees(adj: DataFrame, vertices: DataFrame, years: Sequence[int], v: str = "v1") -> DataFrame:
    """(v, d<year> ...): number of distinct neighbours in each year, 0 for isolated vertices."""
    counted = adj.groupBy(F.col("src").alias(v)).agg(*[F.count_if(known_in(y)).alias(f"d{y}") for y in years])
    return vertices.select(v).join(counted, v, "left").select(
        v, *[F.coalesce(f"d{y}", F.lit(0).cast("bigint")).alias(f"d{y}") for y in years]
    )


#: Edges of a vertex that stay together: a vertex with more has them dealt by target into cells.
CELL_EDGES = 16_384


def write_cells(adj: DataFrame, cell_edges: int = CELL_EDGES, buckets: int | None = None) -> tuple[DataFrame, DataFrame, Callable[[], None]]:
    """The edges laid out once by (source, cell of targets), the cells of each source, and what deletes the layout.

    A vertex cut: a source's edges are dealt by a hash of the target into cells of about ``cell_edges``, so that a hub is
    spread over many buckets, while a small vertex has one cell. The table is bucketed and sorted by its key, so joins on
    (src, cell) move only the other side; it is written in the shared folder and held by no executor.
    """
    spark = adj.sparkSession
    cells = durable(adj.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / cell_edges).cast("int").alias("cells")), "cells")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = adj.join(cells, "src").withColumn("cell", F.pmod(F.xxhash64("dst"), F.col("cells")).cast("int")).drop("cells")
    name = f"edge_cells_{uuid.uuid4().hex}"
    path = shared_path(spark, "edge-cells")
    out = rows.repartition(buckets, "src", "cell").write.format("parquet").bucketBy(buckets, "src", "cell").sortBy("src", "cell")
    out.option("path", path).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(cells)
        discard_path(spark, path)

    return spark.table(name), cells, drop


def rank_inflow(edges: DataFrame, shares: DataFrame, years: Sequence[int], v: str) -> DataFrame:
    """(v, in<year> ...): what each vertex gets of the shares (src, cells, s<year> ...) along the laid out edges.

    A share goes once to each cell of its vertex; sums are combined in each bucket before the only shuffle of inflows.
    """
    sent = shares.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    return edges.join(sent, ["src", "cell"]).groupBy(F.col("dst").alias(v)).agg(
        *[F.sum(F.when(known_in(y), F.col(f"s{y}"))).alias(f"in{y}") for y in years]
    )


def pagerank(
    adj: DataFrame, vertices: DataFrame, years: Sequence[int], *, damping: float = 0.85, tolerance: float = 1e-6,
    max_iterations: int = 100, v: str = "v1",
) -> DataFrame:
    """(v, pr<year> ...): power iteration for all years in one job per step.

    A year stops at the first step whose ranks move by less than vertices x tolerance in total; the mass of vertices
    without neighbours is spread evenly. ``tolerance=0`` runs exactly ``max_iterations`` steps. The ranks of every step
    are written to the shared folder, and the driver reads one row with the movement of each year.
    """
    n = vertices.count()
    if n == 0:
        return vertices.select(v, *[F.lit(0.0).alias(f"pr{y}") for y in years])
    deg = degrees(adj, vertices, years, v)
    lonely = deg.agg(*[F.count_if(F.col(f"d{y}") == 0).alias(f"k{y}") for y in years]).first()

    def spread(y: int, rank: Column) -> Column:
        """Share that each vertex gets of the mass of the vertices without neighbours, which all have the same rank."""
        return F.lit(lonely[f"k{y}"] / n) * rank

    # lr<year>, the rank of a vertex without neighbours, travels with the rows: the steps then differ in no constant
    # and share their compiled code.
    edges, cells, drop = write_cells(adj)  # a step moves ranks, never edges
    at = cells.select(F.col("src").alias(v), "cells")
    state = durable(
        deg.join(at, v, "left").withColumn("cells", F.coalesce("cells", F.lit(0))).select("*", *[F.lit(1.0 / n).alias(c) for y in years for c in (f"pr{y}", f"lr{y}")]), "rank"
    )
    running = list(years)
    for _ in range(max_iterations):
        shares = state.filter("cells > 0").select(
            F.col(v).alias("src"), "cells", *[F.when(F.col(f"d{y}") > 0, F.col(f"pr{y}") / F.col(f"d{y}")).alias(f"s{y}") for y in running]
        )
        inflow = rank_inflow(edges, shares, running, v)
        base = (1 - damping) / n
        moved = state.join(inflow, v, "left")
        following = durable(
            moved.select(
                v, "cells", *[f"d{y}" for y in years], *[f"{c}{y}" for y in years if y not in running for c in ("pr", "lr")],
                *[
                    (damping * (F.coalesce(f"in{y}", F.lit(0.0)) + spread(y, F.col(f"lr{y}"))) + base).alias(f"pr{y}")
                    for y in running
                ],
                *[(damping * spread(y, F.col(f"lr{y}")) + base).alias(f"lr{y}") for y in running],
                *[F.col(f"pr{y}").alias(f"old{y}") for y in running],
            ),
            "rank",
        )
        discard(state)
        state = following
        if tolerance > 0:
            drift = state.agg(*[F.sum(F.abs(F.col(f"pr{y}") - F.col(f"old{y}"))).alias(f"e{y}") for y in running]).first()
            running = [y for y in running if not drift[f"e{y}"] < n * tolerance]
            if not running:
                break
    drop()
    if running and tolerance > 0:
        raise RuntimeError(f"no convergence in {max_iterations} steps for the years {running}")
    return state.select(v, *[f"pr{y}" for y in years])


def neighbour_words(adj: DataFrame, years: Sequence[int]) -> DataFrame:
    """(src, word, b<year> ...): 64 neighbour ids packed into the bits of one number, so dense lists shrink up to 64-fold."""
    bit = F.expr("shiftleft(1L, cast(pmod(dst, 64) as int))")
    return adj.groupBy("src", F.shiftright("dst", 6).alias("word")).agg(
        *[F.coalesce(F.bit_or(F.when(known_in(y), bit)), F.lit(0).cast("bigint")).alias(f"b{y}") for y in years]
    )


def shared_neighbours(pairs: DataFrame, adj: DataFrame, degree: DataFrame, years: Sequence[int], salt_rows: int = 4096) -> DataFrame:
    """(v1, v2, n<year> ...): neighbours that both ends have in each year."""
    words = durable(neighbour_words(adj.filter(known_in(max(years))), years), "words")
    return shared_of_words(pairs, words, degree, years, salt_rows)


def shared_of_words(pairs: DataFrame, words: DataFrame, degree: DataFrame, years: Sequence[int], salt_rows: int = 4096) -> DataFrame:
    """(v1, v2, n<year> ...) from the packed neighbours of the ends.

    Each pair walks the packed neighbours of its end of smaller degree and probes those of the other end, so a hub never
    lists its whole neighbourhood against a small vertex. Neighbours of large vertices are split by salt.
    """
    last = max(years)
    d = broadcast_if_small(durable(degree.select("v1", F.col(f"d{last}").alias("_d")), "degree"))
    sized = pairs.select("v1", "v2").join(d, "v1").join(
        d.select(F.col("v1").alias("v2"), F.col("_d").alias("_e")), "v2"
    )
    small_first = F.col("_d") <= F.col("_e")
    ends = sized.filter(F.least("_d", "_e") > 0).select(
        "v1", "v2", F.when(small_first, F.col("v1")).otherwise(F.col("v2")).alias("src"),
        F.when(small_first, F.col("v2")).otherwise(F.col("v1")).alias("_far"),
        F.explode(F.sequence(F.lit(0), F.expr(f"cast(least(_d, _e) div {salt_rows} as int)"))).alias("_salt"),
    )
    near = words.join(d.withColumnRenamed("v1", "src"), "src").select(
        "src", "word", *[F.col(f"b{y}").alias(f"_n{y}") for y in years],
        F.pmod(F.xxhash64("word"), F.expr(f"_d div {salt_rows} + 1")).cast("int").alias("_salt"),
    )
    far = words.withColumnRenamed("src", "_far")
    common = ends.join(near, ["src", "_salt"]).join(far, ["_far", "word"])
    counts = common.groupBy("v1", "v2").agg(
        *[F.sum(F.bit_count(F.col(f"_n{y}").bitwiseAND(F.col(f"b{y}")))).alias(f"n{y}") for y in years]
    )
    zero = F.lit(0).cast("bigint")
    return pairs.select("v1", "v2").join(counts, ["v1", "v2"], "left").select(
        "v1", "v2", *[F.coalesce(f"n{y}", zero).alias(f"n{y}") for y in years]
    )


def connected_pairs(seen: DataFrame, year: int) -> DataFrame:
    """Distinct pairs known at the end of the year."""
    return seen.filter(known_in(year)).select("v1", "v2")


def ordering_report(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.coalesce(F.bool_and(F.col("v1") < F.col("v2")), F.lit(True)).alias("all_ordered"))


def canonical(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"v1": F.least("v1", "v2"), "v2": F.greatest("v1", "v2")})


def active_vertices(pairs: DataFrame, cutoff: int = 1) -> DataFrame:
    """(v, degree): vertices that appear at least ``cutoff`` times in the distinct pairs, both ends counted."""
    return (
        pairs.select(F.explode(F.array("v1", "v2")).alias("v")).groupBy("v")
        .agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") >= cutoff)
    )


def sharing_pairs(adj: DataFrame, year: int, block: int = 256) -> DataFrame:
    """(v1, v2, shared), v1 < v2: pairs with a neighbour in common in the year, and how many they share.

    The neighbours of a hub are dealt into blocks of about ``block`` by hash, and each pair of blocks is a row of its own
    to the join, so that no task lists all pairs around a hub. Counts are combined before the shuffle.
    """
    near = adj.filter(known_in(year) & (F.col("src") != F.col("dst"))).select("src", "dst")
    sizes = near.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    near = near.join(sizes, "src").withColumn("_own", F.pmod(F.xxhash64("dst"), F.col("_blocks")).cast("int"))
    others = near.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    left = others.select("src", F.col("_own").alias("_x"), F.col("_other").alias("_y"), F.col("dst").alias("v1"))
    right = others.select("src", F.col("_other").alias("_x"), F.col("_own").alias("_y"), F.col("dst").alias("v2"))
    return left.join(right, ["src", "_x", "_y"]).filter("v1 < v2").groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("shared"))


def open_sharing_pairs(adj: DataFrame, year: int, until: int | None = None, block: int = 4096) -> DataFrame:
    """(v1, v2), v1 < v2: pairs with a neighbour in common in ``year`` that are no edge by ``until`` (``year`` itself by default).

    All steps work on packed neighbours: each neighbour of a vertex meets the words of the vertex's other neighbours, 64 of
    them at a time; words are combined by ``bit_or``, known edges are cleared by a mask, and pairs are listed only at the
    end. Neighbours of hubs are dealt into blocks of about ``block``, so that no task has all of a hub.
    """
    near = adj.filter(known_in(year) & (F.col("src") != F.col("dst"))).select("src", "dst")
    bit = F.expr("shiftleft(1L, cast(pmod(dst, 64) as int))")
    words = near.groupBy("src", F.shiftright("dst", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    sizes = durable(near.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")), "blocks")
    left = near.join(sizes, "src").select("src", F.col("dst").alias("v1"), F.pmod(F.xxhash64("dst"), F.col("_blocks")).cast("int").alias("_block"))
    right = words.join(sizes, "src").select("src", "word", "bits", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    met = left.join(right, ["src", "_block"]).filter(F.col("word") >= F.shiftright("v1", 6)).groupBy("v1", "word").agg(F.bit_or("bits").alias("bits"))
    gone = adj.filter(known_in(until or year)).groupBy(F.col("src").alias("v1"), F.shiftright("dst", 6).alias("word")).agg(F.bit_or(bit).alias("_edges"))
    later = F.expr("if(word > shiftright(v1, 6), -1L, shiftleft(shiftleft(-1L, cast(pmod(v1, 64) as int)), 1))")
    kept = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_edges", F.lit(0).cast("bigint")))).bitwiseAND(later)
    free = met.join(gone, ["v1", "word"], "left").select("v1", "word", kept.alias("bits")).filter("bits <> 0")
    listed = free.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter("(shiftright(bits, _at) & 1) = 1")
    return listed.select("v1", (F.col("word") * 64 + F.col("_at")).cast(adj.schema["dst"].dataType).alias("v2"))


def pair_counts(active: DataFrame, connected: DataFrame, sharing: DataFrame) -> DataFrame:
    """One row: vertices, all pairs of them (by arithmetic), and of those the edges, the open pairs that share a
    neighbour, and the other open pairs, which are counted and never listed."""
    n, edges = active.count(), canonical(connected.filter("v1 <> v2")).distinct()
    open_ = unconnected_pairs(sharing, connected).count()
    joined = edges.count()
    row = (n, n * (n - 1) // 2, joined, open_, n * (n - 1) // 2 - joined - open_)
    return active.sparkSession.createDataFrame([row], "vertices bigint, pairs bigint, connected bigint, sharing bigint, other bigint")


def unconnected_pairs(candidates: DataFrame, connected: DataFrame) -> DataFrame:
    """Candidates that are not edges, whatever the orientation of the edge."""
    return canonical(candidates.select("v1", "v2")).join(canonical(connected.select("v1", "v2")), ["v1", "v2"], "left_anti")


def newly_connected(seen: DataFrame, year: int, later: int) -> DataFrame:
    """Pairs first seen after ``year`` and by ``later``, with both ends active in ``year``: the open pairs of that year
    that became edges, read off the edges without listing open pairs."""
    active = active_vertices(connected_pairs(seen, year)).select("v")
    fresh = seen.filter(~known_in(year) & known_in(later)).select("v1", "v2")
    return fresh.join(active.withColumnRenamed("v", "v1"), "v1", "left_semi").join(active.withColumnRenamed("v", "v2"), "v2", "left_semi").select("v1", "v2")


def still_open(pairs: DataFrame, seen: DataFrame, year: int, later: int) -> DataFrame:
    """Of the given pairs, those with both ends active in ``year`` that are no edge by ``later``; a shared neighbour is
    not asked for."""
    active = active_vertices(connected_pairs(seen, year)).select("v")
    free = unconnected_pairs(pairs, connected_pairs(seen, later))
    return free.join(active.withColumnRenamed("v", "v1"), "v1", "left_semi").join(active.withColumnRenamed("v", "v2"), "v2", "left_semi").select("v1", "v2")


def transition(unconnected: DataFrame, later: DataFrame) -> DataFrame:
    """Unconnected pairs with ``connected``: are they an edge at the later date?"""
    edge = canonical(later.select("v1", "v2")).distinct().withColumn("_edge", F.lit(True))
    return unconnected.join(edge, ["v1", "v2"], "left").select("v1", "v2", F.coalesce("_edge", F.lit(False)).alias("connected"))
