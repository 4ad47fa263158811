"""Future citations of pairs, and the classes made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .citations import HORIZON, as_of, recent_total, year_columns
from .graph import canonical


def connected_solutions(pairs: DataFrame, edges: DataFrame, year: int, horizon: int = HORIZON) -> DataFrame:
    """(v1, v2, citation, num, citation_m) of the pairs that are edges at ``year``: recent citations of their papers.

    The edges are summed per pair before the join.
    """
    known = as_of(edges, year)
    available = year_columns(edges)
    summed = canonical(known).groupBy("v1", "v2").agg(
        F.sum(recent_total(year, available, horizon)).cast("bigint").alias("citation"), F.count(F.lit(1)).alias("num")
    )
    return pairs.select("v1", "v2").join(summed, ["v1", "v2"]).withColumn("citation_m", F.col("citation") / F.col("num"))


def connected_records(pairs: DataFrame, edges: DataFrame, year: int, horizon: int = HORIZON) -> DataFrame:
    """The same join without grouping: one row per pair and paper."""
    known = canonical(as_of(edges, year))
    available = year_columns(edges)
    return known.join(pairs.select("v1", "v2"), ["v1", "v2"], "left_semi").select(
        "v1", "v2", "paper_id", recent_total(year, available, horizon).cast("bigint").alias("citation")
    )


def unconnected_solutions(pairs: DataFrame) -> DataFrame:
    return pairs.select("v1", "v2", F.lit(0).cast("bigint").alias("citation"))


def all_solutions(connected: DataFrame, unconnected: DataFrame) -> DataFrame:
    """Connected rows and unconnected rows in one table; columns that one side lacks are 0."""
    return connected.unionByName(unconnected, allowMissingColumns=True).fillna(0)


def binary_class(citation: Column, threshold: int) -> Column:
    return F.when(citation >= threshold, 1).otherwise(0)


def conditional_class(citation: Column, ranges: Sequence[tuple[int, int]], threshold: int, gap: int | None) -> Column:
    """Class i for range i (both ends included), the last class from ``threshold`` on.

    ``gap`` is the class of values in none of them: None when splitting (filter them out), 0 when classifying.
    """
    out = F.when(citation >= threshold, len(ranges))
    for i in reversed(range(len(ranges))):
        low, high = ranges[i]
        out = out.when((citation >= low) & (citation <= high), i)
    return out.otherwise(F.lit(gap).cast("int"))


def label_single_year(pairs: DataFrame, edges: DataFrame, year: int) -> DataFrame:
    """Citations of one year over the papers of the pair, either orientation; 0 without papers."""
    return _label(pairs, as_of(edges, year), F.col(f"c{year}"))


def label_latest_year(pairs: DataFrame, edges: DataFrame, end: int) -> DataFrame:
    """Citations of the latest year column not after ``end``, or of the total when there is none."""
    usable = [y for y in year_columns(edges) if y <= end]
    return _label(pairs, edges, F.col(f"c{max(usable)}") if usable else F.col("ct"))


def _label(pairs: DataFrame, edges: DataFrame, value: Column) -> DataFrame:
    summed = canonical(edges).groupBy("v1", "v2").agg(F.sum(value).cast("bigint").alias("label"))
    return canonical(pairs.select("v1", "v2")).join(summed, ["v1", "v2"], "left").fillna(0, ["label"])


def label_from_solutions(features: DataFrame, connected: DataFrame, unconnected: DataFrame) -> DataFrame:
    """Feature rows with label 1 (connected) or 0 (unconnected); rows in neither set are dropped."""
    sets = connected.select("v1", "v2", F.lit(1).alias("label")).unionByName(
        unconnected.select("v1", "v2", F.lit(0).alias("label"))
    )
    return features.join(sets, ["v1", "v2"])


def lookup_features(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Features of each pair in either orientation; ``found`` tells misses apart."""
    table = canonical(features).withColumn("_hit", F.lit(True))
    joined = canonical(pairs.select("v1", "v2")).join(table, ["v1", "v2"], "left")
    return joined.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def lookup_report(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(~F.col("found")).alias("misses"))
