"""Ranks and running totals over a whole table, without a window over all rows.

The rows are range-partitioned and sorted, and the numbered result is written to the shared folder, which fixes the
layout. The driver then sees one row per partition (its totals), turns these into offsets and sends them back. A value
that fills a third of the table is split over partitions by the tie-break columns of the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

_MASK = (1 << 33) - 1


def order_rows(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Add ``_part`` and ``_pos``: place of each row in the total order (the order must have no ties)."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return durable(
        placed.select(
            *df.columns,
            F.shiftright("_id", 33).cast("int").alias("_part"),
            F.col("_id").bitwiseAND(F.lit(_MASK)).alias("_pos"),
        ),
        "ordered",
    )


def _with_offsets(rows: DataFrame, sums: dict[str, Column], type_: str) -> DataFrame:
    """Join the totals of all earlier partitions, as ``_off_<name>``; one driver row per partition."""
    totals = rows.groupBy("_part").agg(*[s.cast(type_).alias(n) for n, s in sums.items()]).orderBy("_part").collect()
    before = {n: [0, *accumulate(r[n] for r in totals)][:-1] for n in sums}
    table = [(r["_part"], *(before[n][i] for n in sums)) for i, r in enumerate(totals)]
    if type_ == "double":
        table = [(p, *map(float, rest)) for p, *rest in table]
    schema = "_part int, " + ", ".join(f"`_off_{n}` {type_}" for n in sums)
    offsets = rows.sparkSession.createDataFrame(table, schema)
    return rows.join(F.broadcast(offsets), "_part")  # one row per partition


def _rebase(df: DataFrame, group: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """Subtract the smallest value of each group, so that counting restarts in every group."""
    if not group:
        return df
    base = df.groupBy(*group).agg(*[F.min(c).alias(f"_base_{n}") for n, c in columns.items()])
    keyed = df.join(F.broadcast(base), list(group))  # one row per group; callers have few groups
    return keyed.withColumns({n: F.col(n) - F.col(f"_base_{n}") for n in columns}).drop(*[f"_base_{n}" for n in columns])


def with_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank", group: Sequence[str] = ()) -> DataFrame:
    """Rank 1..n in the given total order, restarting in each ``group`` (few groups, any size)."""
    rows = order_rows(df, [*group, *order])
    ranked = _with_offsets(rows, {"n": F.count(F.lit(1))}, "bigint")
    ranked = ranked.withColumn(name, F.col("_off_n") + F.col("_pos"))
    ranked = _rebase(ranked, group, {name: F.col(name)})
    return ranked.withColumn(name, F.col(name) + 1).drop("_part", "_pos", "_off_n")


def with_running(
    df: DataFrame, order: Sequence[Column | str], sums: Sequence[str], group: Sequence[str] = (), type_: str = "bigint"
) -> DataFrame:
    """Add ``<name>_before`` for each of ``sums``: the total over all earlier rows (of the group).

    The values must not be negative. The window is bounded by the size of one range partition.
    """
    rows = order_rows(df, [*group, *order])
    rows = _with_offsets(rows, {n: F.sum(n) for n in sums}, type_)
    earlier = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select(
        *df.columns,
        *[
            (F.col(f"_off_{n}") + F.coalesce(F.sum(F.col(n).cast(type_)).over(earlier), F.lit(0).cast(type_))).alias(f"{n}_before")
            for n in sums
        ],
    )
    return _rebase(out, group, {f"{n}_before": F.col(f"{n}_before") for n in sums})


def is_monotonic(df: DataFrame, order: Sequence[Column | str], value: str) -> DataFrame:
    """One row: does ``value`` never rise along the order? Compared inside and across range partitions."""
    rows = order_rows(df, order)
    last = Window.partitionBy("_part").orderBy("_pos")
    inside = rows.select(
        "_part", value, (F.lag(value).over(last) < F.col(value)).alias("rises")
    ).groupBy("_part").agg(
        F.coalesce(F.bool_or("rises"), F.lit(False)).alias("rises"), F.min(value).alias("low"), F.max(value).alias("high")
    ).orderBy("_part").collect()  # one row per range partition
    rises = any(r["rises"] for r in inside) or any(b["high"] > a["low"] for a, b in zip(inside, inside[1:]))
    return df.sparkSession.createDataFrame([(not rises,)], "non_increasing boolean")


def average_rank(df: DataFrame, value: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Per distinct ``value`` (of each group): the rank of its rows, ties sharing the average rank."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = with_running(counts, [value], ["_n"], group=group)
    return ranked.select(*group, value, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name))
