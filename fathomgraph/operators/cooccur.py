"""Concept pairs that occur in the same paper."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, shuffles_freed

#: Most concepts of a paper that one task pairs with each other; papers above it are split into blocks.
BLOCK = 256


def cooccurrence(mentions: DataFrame, paper: str, concept: str, carry: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """One row (paper, v1, v2, carried columns) per paper and pair of distinct concepts, v1 < v2.

    ``carry`` names columns that depend on the paper only. A first look finds the papers with more than ``block``
    mentions; usually there are none, and one grouping by paper does it. Large papers are cut into hash blocks, and the
    pairs of two blocks are made by a task of their own, so no task ever holds a whole large paper.
    """
    large = mentions.groupBy(paper).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block)
    rest = mentions
    parts = []
    with shuffles_freed(mentions.sparkSession):
        usual = large.isEmpty()
    if not usual:
        large = durable(large.select(paper, (F.floor(F.col("_n") / block) + 1).cast("int").alias("_blocks")), "large")
        parts = _large_papers(mentions.join(large, paper), paper, concept, carry)
        rest = mentions.join(large, paper, "left_anti")
    grouped = rest.groupBy(paper).agg(
        F.array_sort(F.collect_set(concept)).alias("_vs"), *[F.first(c).alias(c) for c in carry]
    )
    return reduce(DataFrame.unionByName, parts, _pairs_inside(grouped, paper, carry))


def _pairs_inside(grouped: DataFrame, paper: str, carry: Sequence[str]) -> DataFrame:
    """All i < j pairs of the sorted concept arrays."""
    first = grouped.select(paper, *carry, "_vs", F.posexplode("_vs").alias("_i", "v1"))
    return first.select(paper, "v1", F.explode(F.slice("_vs", F.col("_i") + 2, F.size("_vs"))).alias("v2"), *carry)


def _large_papers(mentions: DataFrame, paper: str, concept: str, carry: Sequence[str]) -> list[DataFrame]:
    blocks = durable(
        mentions.withColumn("_block", F.pmod(F.xxhash64(concept), F.col("_blocks")).cast("int")).groupBy(paper, "_block").agg(
            F.array_sort(F.collect_set(concept)).alias("_vs"), *[F.first(c).alias(c) for c in carry]
        ),
        "blocks",
    )
    a = blocks.select(paper, F.col("_block").alias("_a"), F.col("_vs").alias("_va"), *carry)
    b = blocks.select(paper, F.col("_block").alias("_b"), F.col("_vs").alias("_vb"))
    tasks = a.join(b, paper).filter(F.col("_a") < F.col("_b")).repartition(F.col(paper), F.col("_a"), F.col("_b"))
    one = tasks.select(paper, *carry, "_vb", F.explode("_va").alias("_x"))
    between = one.select(paper, *carry, "_x", F.explode("_vb").alias("_y")).select(
        paper, F.least("_x", "_y").alias("v1"), F.greatest("_x", "_y").alias("v2"), *carry
    )
    return [_pairs_inside(blocks, paper, carry), between]


def cooccurrence_occurrences(
    occurrences: DataFrame, paper: str, concept: str, position: Sequence[str], block: int = BLOCK
) -> DataFrame:
    """Pairs of occurrences in text order: repeated and equal concepts stay, v1 < v2 is not ensured.

    The first occurrences of a large paper are spread over salts, each of which meets a copy of all its occurrences.
    """
    large = occurrences.groupBy(paper).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block)
    large = large.select(paper, (F.floor(F.col("_n") / block) + 1).cast("int").alias("_salts"))
    placed = occurrences.join(large, paper, "left").select(
        paper, concept, F.struct(*position).alias("_at"), F.coalesce("_salts", F.lit(1)).alias("_salts")
    )
    a = placed.select(
        paper, F.col(concept).alias("v1"), F.col("_at").alias("_a"),
        F.pmod(F.xxhash64(concept, "_at"), F.col("_salts")).cast("int").alias("_salt"),
    )
    b = placed.select(
        paper, F.col(concept).alias("v2"), F.col("_at").alias("_b"),
        F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"),
    )
    return a.join(b, [paper, "_salt"]).filter(F.col("_a") < F.col("_b")).select(paper, "v1", "v2")


def pair_volume(mentions: DataFrame, paper: str, concept: str, bound: int) -> DataFrame:
    """How many papers, and pairs, a bound on the concepts of a paper would cut off; nothing is dropped."""
    sizes = mentions.groupBy(paper).agg(F.count_distinct(concept).alias("n"))
    pairs = F.expr("n * (n - 1) div 2")
    return sizes.agg(
        F.count_if(F.col("n") <= bound).alias("papers_within"), F.count_if(F.col("n") > bound).alias("papers_above"),
        F.sum(F.when(F.col("n") <= bound, pairs).otherwise(0)).alias("pairs_within"),
        F.sum(F.when(F.col("n") > bound, pairs).otherwise(0)).alias("pairs_above"),
    )


def cited_only(records: DataFrame, total: str = "ct") -> DataFrame:
    """Drop records whose citation total is missing, not a number, or zero."""
    return records.filter(F.coalesce(F.col(total).try_cast("bigint"), F.lit(0)) != 0)


def cited_report(records: DataFrame, total: str = "ct") -> DataFrame:
    value = F.coalesce(F.col(total).try_cast("bigint"), F.lit(0))
    return records.agg(F.count(F.lit(1)).alias("before"), F.count_if(value != 0).alias("after"))
