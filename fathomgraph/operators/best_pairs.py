"""The best open pairs by Jaccard index of their neighbours, found without listing the open pairs.

A top-k similarity join by thresholds. Vertices with the same neighbours are one class, as they score alike with every other
vertex. Each class posts a prefix of its neighbours, the rarest first: two classes of index at least t have a common
neighbour among the first ``d - ceil(t d) + 1`` of both. Sizes, and how many neighbours come before the common one, bound the
index of a candidate before its neighbours are counted exactly. A round that finds fewer than k pairs lowers t by ``STEP``;
once k pairs are known, t becomes the score of the k-th best and the last round closes the bound: every pair it does not
meet scores less. Where neighbours are so few that all meetings of two vertices in one are ``MET`` per edge at most, or the prefixes
so dense that joining them costs more than ``LISTED`` rows per edge, no pairs are listed: all pairs of classes are counted against
blocks (``pair_cells.py``) that give their best k pairs, and nothing is left to close.

Neighbours are ordered by levels of a logarithm of their degree, so that no vertex's neighbours are sorted in one task; a
prefix is rounded up to whole levels. Postings of a frequent neighbour are dealt into blocks, and pairs of blocks are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import cutoff_day
from ..session import broadcast_if_small, discard, durable
from .graph import known_in, neighbour_words, shared_of_words
from .pair_cells import best_open_in_cells, packed_sets

START, STEP = 0.8, 0.5
#: Rows of a join of prefixes per row of the adjacency, above which pairs are counted in cells.
LISTED = 8
#: Meetings of two vertices in a neighbour per row of the adjacency, up to which all are counted and no prefix is posted.
MET = 256
#: Levels per doubling of the degree.
FINENESS = 4
BLOCK = 256


def neighbour_classes(adj: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """(rep, size, members) of vertices with equal neighbours, and (v, rep); ``adj`` has both directions of each edge.

    Equal means equal number and equal 128 bits of combined hashes. Adjacent vertices are in one class only by self-loops.
    """
    return _classes_of(packed_sets(adj.filter(known_in(year))))


def _classes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = ["size", "_h1", "_h2"]
    sets = sets.select("v", *key)
    classes = durable(sets.groupBy(*key).agg(F.min("v").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    return classes.select("rep", "size", "members"), sets.join(classes.select("rep", *key), key).select("v", "rep")


def _of_reps(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of one vertex of each class."""
    others = durable(sets.select("v").join(classes.select(F.col("rep").alias("v")), "v", "left_anti"), "others")
    return sets if others.isEmpty() else durable(sets.join(broadcast_if_small(others), "v", "left_anti"), "rep-sets", by=["_block"], codec="zstd")


def posted_neighbours(adj: DataFrame, year: int, classes: DataFrame) -> DataFrame:
    """(rep, size, item, level, before): neighbours of each class; ``before`` are those of lower levels."""
    near = adj.filter(known_in(year)).select("src", "dst")
    level = F.floor(F.log2(F.count(F.lit(1))) * FINENESS).cast("int").alias("level")
    levels = near.groupBy("dst").agg(level)
    rows = near.join(classes.select(F.col("rep").alias("src"), "size"), "src").join(levels, "dst")
    rows = durable(rows.select(F.col("src").alias("rep"), "size", F.col("dst").alias("item"), "level"), "leveled")
    # One row per class and level, some hundred a class at most.
    per_level = rows.groupBy("rep", "level").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("rep").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    per_level = per_level.select("rep", "level", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"))
    postings = durable(rows.join(per_level, ["rep", "level"]), "postings")
    discard(rows)
    return postings


def least_shared(one: Column, two: Column, t: float) -> Column:
    """Neighbours that sets of these sizes must share for an index of at least ``t``."""
    return F.ceil(F.lit(t / (1 + t)) * (one + two) - 1e-9)


def in_prefix(t: float) -> Column:
    return F.col("before") < F.col("size") - F.ceil(F.lit(t) * F.col("size") - 1e-9) + 1


def candidates(postings: DataFrame, t: float, block: int = BLOCK) -> DataFrame:
    """Distinct (v1, v2) of classes that can have an index of at least ``t``."""
    prefix = postings.filter(in_prefix(t))
    blocks = prefix.groupBy("item").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows = prefix.join(blocks.drop("_n"), "item").withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    side = lambda v, n, own, other: rows.select(
        "item", F.col(own).alias("_x"), F.col(other).alias("_y"), F.col("rep").alias(v), F.col("size").alias(f"size_{n}"), F.col("before").alias(f"before_{n}")
    )
    pairs = side("v1", 1, "_own", "_other").join(side("v2", 2, "_other", "_own"), ["item", "_x", "_y"])
    rest = F.least(F.col("size_1") - F.col("before_1"), F.col("size_2") - F.col("before_2"))
    # One task may meet a pair by several neighbours: rows are combined before the shuffle.
    return pairs.filter((F.col("v1") < F.col("v2")) & (rest >= least_shared(F.col("size_1"), F.col("size_2"), t))).select("v1", "v2").distinct()


def _kth_score(scored: DataFrame, weights: DataFrame, k: int) -> float | None:
    """The score of the k-th best pair of vertices, None if there are fewer; k rows of classes at most are read."""
    one, two = (weights.select(F.col("rep").alias(v), F.col("members").alias(m)) for v, m in (("v1", "_m"), ("v2", "_o")))
    pairs = F.when(F.col("v1") == F.col("v2"), F.expr("_m * (_m - 1) div 2")).otherwise(F.col("_m") * F.col("_o"))
    total = 0
    for row in scored.join(one, "v1").join(two, "v2").select("score", pairs.alias("n")).orderBy(F.desc("score")).limit(k).collect():
        total += row["n"]
        if total >= k:
            return row["score"]
    return None


def best_open_pairs(adj: DataFrame, year: int, k: int, start: float = START, report: list | None = None) -> DataFrame:
    """(v1, v2, score), v1 < v2: the k open pairs of the year with a neighbour in common and the highest Jaccard index, ties by v1, v2.

    Fewer than k rows come back only if there are fewer such pairs. ``report`` gets (t, counted candidates) of each round.
    """
    # Of the edges of the year only their ends are written.
    near = durable(adj.filter(known_in(year)).select("src", "dst"), "adjacency", codec="zstd")
    sets = packed_sets(near)
    classes, member_of = _classes_of(sets)
    # Two vertices of a class score 1 with each other; each class is listed by its k + 1 smallest members, as no pair of
    # a larger one can be among the best k of the class or of two classes.
    smallest = Window.partitionBy("rep").orderBy("v")
    members = durable(member_of.withColumn("_place", F.row_number().over(smallest)).filter(F.col("_place") <= k + 1).select("v", "rep"), "members")
    alike = classes.filter("members > 1").select(F.col("rep").alias("v1"), F.col("rep").alias("v2"), F.lit(1.0).alias("score"))
    loops = sets.filter("loop").select(F.col("v").alias("v1"))
    alike_open = alike.join(loops, "v1", "left_anti").select("v1", "v2", "score")  # a class with self-loops is all edges
    # A vertex is an item of as many sets as it has neighbours.
    met, rows, largest = sets.agg(F.sum(F.col("size").cast("double") * F.col("size") / 2), F.sum("size"), F.max("size")).first()
    if largest is None or met <= MET * rows:
        known = _counted_pairs(sets, classes, alike_open, k)
        if report is not None:
            report.append((start, 0))
    else:
        known = _listed_pairs(near.withColumn("first_day", F.lit(cutoff_day(year))), year, k, start, report, sets, classes, alike_open, int(largest))
    discard(sets)
    floor = _kth_score(known, classes.select("rep", "members"), k)  # bounds what is expanded into pairs of vertices
    best = known.filter(F.col("score") >= floor) if floor is not None else known
    one = members.select(F.col("rep").alias("v1"), F.col("v").alias("_v1"))
    two = members.select(F.col("rep").alias("v2"), F.col("v").alias("_v2"))
    # An edge between two classes joins all their members, so all of these pairs are open as those of the classes are.
    listed = best.join(one, "v1").join(two, "v2").filter((F.col("v1") != F.col("v2")) | (F.col("_v1") < F.col("_v2")))
    listed = listed.select(F.least("_v1", "_v2").alias("v1"), F.greatest("_v1", "_v2").alias("v2"), "score")
    discard(near)
    return listed.orderBy(F.desc("score"), "v1", "v2").limit(k)


def _counted_pairs(sets: DataFrame, classes: DataFrame, alike_open: DataFrame, k: int) -> DataFrame:
    """(v1, v2, score) of classes; the best k pairs of classes hold the best k of vertices: each has a pair of vertices before
    those of later ones."""
    of_reps = _of_reps(sets, classes)
    best = durable(alike_open.unionByName(best_open_in_cells(of_reps, k)), "scored")
    discard(of_reps)
    return best


def _listed_pairs(
    adj: DataFrame, year: int, k: int, start: float, report: list | None, sets: DataFrame, classes: DataFrame, alike_open: DataFrame, largest: int
) -> DataFrame:
    """(v1, v2, score) of classes, by rounds of falling thresholds."""
    postings = posted_neighbours(adj, year, classes)
    near = adj.filter(known_in(year)).join(classes.select(F.col("rep").alias("src")), "src", "left_semi")
    words = None  # written for the first round that lists pairs
    size = durable(classes.select(F.col("rep").alias("v1"), F.col("size").alias(f"d{year}")), "sizes")
    edges = adj.filter(known_in(year)).select(F.least("src", "dst").alias("v1"), F.greatest("src", "dst").alias("v2"))
    known = durable(alike_open, "scored")
    weights = classes.select("rep", "members")
    most = LISTED * postings.count()
    t, closing = start, False
    while True:
        per_item = postings.filter(in_prefix(t)).groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("n"))
        if (per_item.agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0) > most:
            if report is not None:
                report.append((t, 0))
            discard(known)
            known = _counted_pairs(sets, classes, alike_open, k)
            break
        if words is None:
            words = durable(neighbour_words(near, [year]), "words")
        found = candidates(postings, t).join(edges, ["v1", "v2"], "left_anti")
        fresh = found.join(known.select("v1", "v2"), ["v1", "v2"], "left_anti")
        fresh = durable(fresh, "candidates")
        if report is not None:
            report.append((t, fresh.count()))
        counted = shared_of_words(fresh, words, size, [year])
        one, two = size.select("v1", F.col(f"d{year}").alias("_a")), size.select(F.col("v1").alias("v2"), F.col(f"d{year}").alias("_b"))
        score = F.col(f"n{year}") / (F.col("_a") + F.col("_b") - F.col(f"n{year}"))
        scored = counted.join(one, "v1").join(two, "v2").filter(F.col(f"n{year}") > 0).select("v1", "v2", score.alias("score"))
        following = durable(known.unionByName(scored), "scored")
        discard(known, fresh)
        known = following
        if closing or t <= 1 / (2 * largest):  # all sharing pairs have been met
            break
        kth = _kth_score(known, weights, k)
        if kth is not None and kth >= t:
            break
        t, closing = (kth, True) if kth is not None else (max(t * STEP, 1 / (2 * largest)), False)
    discard(postings, size, *([words] if words is not None else []))
    return known
