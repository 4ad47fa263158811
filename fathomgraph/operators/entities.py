"""Cleaning of entity tables and the document-frequency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_plural, singular, strip_noise, strip_parentheses
from .ordered import with_running


def first_per_name(entities: DataFrame, name: str, order: str) -> DataFrame:
    """Case-insensitive de-duplication, the row of smallest ``order`` stays; combined before the shuffle."""
    row = F.struct(*[F.col(c) for c in entities.columns])
    return entities.groupBy(F.lower(name).alias("_key")).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def drop_parentheses(entities: DataFrame, name: str) -> DataFrame:
    return entities.withColumn(name, strip_parentheses(F.col(name))).filter(F.length(name) > 0)


def plural_report(entities: DataFrame, name: str) -> DataFrame:
    return entities.select("*", is_plural(F.col(name)).alias("plural"), singular(F.col(name)).alias("singular"))


def drop_plurals(entities: DataFrame, name: str) -> DataFrame:
    """Drop plural rows whose singular is a name of the table too."""
    names = entities.select(F.col(name).alias("_name")).distinct()
    plural = is_plural(F.col(name))
    keyed = entities.withColumn("_singular", F.when(plural, singular(F.col(name))))
    return keyed.join(names, F.col("_singular") == F.col("_name"), "left_anti").drop("_singular")


def drop_noise(entities: DataFrame, name: str) -> DataFrame:
    """Remove noise characters and empty names; all five entity columns must be there."""
    if len(entities.columns) < 5:
        raise ValueError("entity rows need at least five fields")
    return entities.withColumn(name, strip_noise(F.col(name))).filter(F.length(name) > 0)


def frequency_table(frequencies: DataFrame, name: str = "concept", df: str = "df") -> DataFrame:
    """Names by falling document frequency with their share and running share in percent (four decimals)."""
    kept = frequencies.filter(F.col(df) >= 1)
    running = with_running(kept, [F.col(df).desc(), F.col(name)], [df])
    total = running.agg(F.sum(df)).first()[0] or 0

    def percent(value: Column) -> Column:
        return F.round(value * 100.0 / F.lit(total or 1), 4)

    return running.select(
        name, df, percent(F.col(df)).alias("percentage"), percent(F.col(f"{df}_before") + F.col(df)).alias("cumulative")
    )
