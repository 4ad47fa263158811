"""Random samples and splits of exact size that do not sort the table.

Every row has a random key, the md5 of a seed and the row's own key, and the rows of the smallest keys are taken. A count of
rows per cell (the first ``DIGITS`` hex digits of the key) tells which cell holds the last row to take: rows of earlier cells
are taken by a filter, rows of later ones left, and only the rows of that one cell, about one in 16 ** ``DIGITS``, are sorted.
The counts stay in Spark; no row of the table is shuffled but those of the edge cells.

Cases: ``keys`` should identify a row; rows equal in all of them share a cell, and which of them are taken first is not
fixed, their number is. Nulls in keys or groups are values like others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable
from .evaluate import shuffle_key
from .ordered import with_rank

#: A group has at most 16 ** DIGITS cells, whatever its rows; a window over the counts of one group holds no more.
DIGITS = 4


def mark_bottom(df: DataFrame, wanted: Column, seed: int, keys: Sequence[str], group: Sequence[str] = (), name: str = "taken") -> DataFrame:
    """Add ``name``: is the row among the ``wanted`` first of its group in random order?

    ``wanted`` may use ``_n``, the rows of the group (few groups, any size). ``df`` is read three times, so it should be a
    stored table or a scan.
    """
    group_key = F.to_json(F.struct(*group)) if group else F.lit("")
    keyed = df.withColumns({"_key": shuffle_key(seed, *keys), "_group": group_key})
    keyed = keyed.withColumn("_cell", F.substring("_key", 1, DIGITS))
    edge = broadcast_if_small(durable(_edges(keyed, wanted), "sample-edges"))
    rows = keyed.join(edge, keyed["_group"] == edge["_edge_group"], "left")
    at_edge = F.coalesce(F.col("_cell") == F.col("_edge"), F.lit(False))
    clear = rows.filter(~at_edge).withColumn(name, F.coalesce(F.col("_cell") < F.col("_edge"), F.lit(False)))
    ranked = with_rank(rows.filter(at_edge), ["_key", *keys], "_rank", group=["_group"])
    close = durable(ranked.select(*df.columns, (F.col("_rank") <= F.col("_need")).alias(name)), "sample-edge-rows")
    return clear.select(*df.columns, name).unionByName(close)


def _edges(keyed: DataFrame, wanted: Column) -> DataFrame:
    """(_edge_group, _edge, _need): the cell with the last row to take, and how many of its rows are taken."""
    cells = keyed.groupBy("_group", "_cell").agg(F.count(F.lit(1)).alias("_in_cell"))
    whole = Window.partitionBy("_group")
    placed = cells.withColumn("_through", F.sum("_in_cell").over(whole.orderBy("_cell"))).withColumn("_n", F.sum("_in_cell").over(whole))
    placed = placed.withColumn("_want", F.least(wanted.cast("bigint"), F.col("_n"))).withColumn("_before", F.col("_through") - F.col("_in_cell"))
    edge = placed.filter((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_through")))
    return edge.select(F.col("_group").alias("_edge_group"), F.col("_cell").alias("_edge"), (F.col("_want") - F.col("_before")).alias("_need"))


def bottom_k(df: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """Exactly min(n, rows) rows; the rows that ``evaluate.exact_sample`` picks."""
    return mark_bottom(df, F.lit(n), seed, keys, name="_taken").filter("_taken").drop("_taken")


def two_class_subsets(labelled: DataFrame, label: str, seed: int, keys: Sequence[str], limit: int = 30_000_000) -> DataFrame:
    """All positives, and all negatives unless they are more than ``limit``: then as many as there are positives.

    ``limit`` bounds the labelled rows that a classifier is fitted on.
    """
    counts = labelled.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    negatives, positives = labelled.filter(F.col(label) == 0), labelled.filter(F.col(label) == 1)
    if counts["neg"] > limit:
        negatives = bottom_k(negatives, min(counts["neg"], counts["pos"]), seed, keys)
    return negatives.unionByName(positives)


def split_per_class(df: DataFrame, label: str, seed: int, keys: Sequence[str], share: float = 0.85) -> DataFrame:
    """Add ``part``: 'train' for int(n * share) random rows of each class (null is a class), else 'test'."""
    marked = mark_bottom(df, F.floor(F.col("_n") * F.lit(share)), seed, keys, group=[label], name="_taken")
    return marked.withColumn("part", F.when(F.col("_taken"), "train").otherwise("test")).drop("_taken")
