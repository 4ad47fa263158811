"""Year pivots and the yearly citation table of nodes and pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import cutoff_day

HORIZON = 3


def year_columns(df: DataFrame) -> list[int]:
    """Years of the ``cYYYY`` columns, ascending."""
    return sorted(int(c[1:]) for c in df.columns if len(c) == 5 and c[0] == "c" and c[1:].isdigit())


def _year(y: int, available: Sequence[int]) -> Column:
    return F.col(f"c{y}") if y in available else F.lit(0)


def pivot_list(df: DataFrame, counts: str, years: Sequence[int]) -> DataFrame:
    """Array of (year, cited_by_count) -> one column per year; missing is 0, of a repeated year the last entry counts."""

    def last(y: int) -> Column:
        return F.try_element_at(F.filter(counts, lambda e: e["year"] == y), F.lit(-1))["cited_by_count"]

    return df.withColumns({f"c{y}": F.coalesce(last(y), F.lit(0)).cast("bigint") for y in years}).drop(counts)


def pivot_map(df: DataFrame, counts: str, years: Sequence[int]) -> DataFrame:
    """The same for a year -> count map; unreadable values count as missing."""
    return df.withColumns(
        {f"c{y}": F.coalesce(F.try_element_at(counts, F.lit(y)).try_cast("bigint"), F.lit(0)) for y in years}
    ).drop(counts)


def pivot_records(df: DataFrame, record: str, years: Sequence[int]) -> DataFrame:
    """Records of mixed shape, a VARIANT list each: (v1, v2, time, ct, counts), to one column per year.

    The counts are a list of (year, cited_by_count) objects or an object of year -> count; of a repeated year the last entry
    counts. Records of fewer than four fields are skipped, those of four, or with counts of any other shape, have zero
    years. ``fields`` is the number of fields.
    """
    sized = df.withColumn("fields", F.size(F.try_variant_get(record, "$", "array<variant>")))
    kept = sized.filter(F.col("fields") >= 4)
    entries = F.try_variant_get(record, "$[4]", "array<variant>")

    def count(y: int) -> Column:
        listed = F.filter(entries, lambda e: F.try_variant_get(e, "$.year", "bigint") == y)
        last = F.try_variant_get(F.try_element_at(listed, F.lit(-1)), "$.cited_by_count", "bigint")
        return F.coalesce(last, F.try_variant_get(record, f"$[4]['{y}']", "bigint"), F.lit(0)).cast("bigint")

    ends = {"v1": ("$[0]", "int"), "v2": ("$[1]", "int"), "time": ("$[2]", "int"), "ct": ("$[3]", "bigint")}
    return kept.withColumns({**{c: F.try_variant_get(record, at, kind) for c, (at, kind) in ends.items()}, **{f"c{y}": count(y) for y in years}}).drop(record)


def zero_years(pairs: DataFrame, years: Sequence[int]) -> DataFrame:
    """Bare pairs get a zero time, total and yearly counts."""
    return pairs.withColumns({"time": F.lit(0), "ct": F.lit(0).cast("bigint"), **{f"c{y}": F.lit(0).cast("bigint") for y in years}})


def length_report(df: DataFrame, counts: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.size(counts), F.lit(-1)).alias("entries")).agg(F.count(F.lit(1)).alias("rows"))


def unpivot_years(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wide -> long: (keys, year, c)."""
    years = year_columns(df)
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"c{y}").alias("c")) for y in years])))


def as_of(df: DataFrame, year: int) -> DataFrame:
    """Rows known at the end of the year (31 December included)."""
    return df.filter(F.col("time") <= cutoff_day(year))


def known_total(y: int, available: Sequence[int]) -> Column:
    """Citations known at year y: the total without the counts of all later years in the data."""
    total = F.col("ct")
    for later in available:
        if later > y:
            total = total - F.col(f"c{later}")
    return total


def recent_total(y: int, available: Sequence[int], horizon: int = HORIZON) -> Column:
    parts = [F.col(f"c{k}") for k in range(y, y - horizon, -1) if k in available]
    total = F.lit(0)
    for p in parts:
        total = total + p
    return total


def yearly_wide(records: DataFrame, keys: Sequence[str], years: Sequence[int], horizon: int = HORIZON) -> DataFrame:
    """One pass and one shuffle for all years: keys plus a struct ``y<year>`` of (c, ct_y, ct_delta, num)."""
    available = year_columns(records)
    aggregates = []
    for y in years:
        known = F.col("time") <= cutoff_day(y)

        def total(value: Column) -> Column:
            return F.coalesce(F.sum(F.when(known, value)), F.lit(0)).cast("bigint")

        aggregates.append(
            F.struct(
                total(_year(y, available)).alias("c"), total(known_total(y, available)).alias("ct_y"),
                total(recent_total(y, available, horizon)).alias("ct_delta"), F.count_if(known).alias("num"),
            ).alias(f"y{y}")
        )
    return records.groupBy(*keys).agg(*aggregates)


def _long(wide: DataFrame, keys: Sequence[str], years: Sequence[int]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"y{y}").alias("s")) for y in years])
    flat = wide.select(*keys, F.inline(rows)).select("year", *keys, "s.*")

    def mean(name: str) -> Column:
        return F.when(F.col("num") > 0, F.col(name) / F.col("num")).otherwise(F.lit(0.0))

    return flat.withColumns({"c_m": mean("c"), "ct_y_m": mean("ct_y"), "ct_delta_m": mean("ct_delta")})


def yearly_table(records: DataFrame, keys: Sequence[str], years: Sequence[int], horizon: int = HORIZON) -> DataFrame:
    """(year, keys, c, ct_y, ct_delta, num and the means), only keys with a record known in that year."""
    return _long(yearly_wide(records, keys, years, horizon), keys, years).filter(F.col("num") > 0)


def node_table(mentions: DataFrame, vertices: DataFrame, years: Sequence[int], v: str = "v1", horizon: int = HORIZON) -> DataFrame:
    """The yearly table of every vertex of the dimension; vertices without a record have zeros."""
    wide = yearly_wide(mentions, [v], years, horizon)
    zero = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in ("c", "ct_y", "ct_delta", "num")])
    full = vertices.select(v).join(wide, v, "left").select(v, *[F.coalesce(f"y{y}", zero).alias(f"y{y}") for y in years])
    return _long(full, [v], years)
