"""Checks of a fitted impact model from its coefficients: scores as a column, and the gradient of its loss as one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(intercept)"


def score_column(columns: Sequence[str], coefficients: Sequence[float], intercept: float) -> Column:
    """The score (0..1) of a logistic model, as an expression over its feature columns."""
    terms = [F.col(c).cast("double") * _number(b) for c, b in zip(columns, coefficients, strict=True)]
    return 1 / (1 + F.exp(-sum(terms, _number(intercept))))


def _number(value: float | None) -> Column:
    return F.lit(None if value is None else float(value)).cast("double")


def impact_gradient(
    rows: DataFrame, columns: Sequence[str], label: str, coefficients: Sequence[float | None], intercept: float | None, reg: float = 0.0
) -> DataFrame:
    """(feature, coefficient, gradient): slope of the regularised loss in each standardised column, and in the intercept.

    The loss is the mean logistic loss plus ``reg`` / 2 times the squares of the coefficients of columns brought to standard
    deviation 1; its slopes are all 0 exactly at the best model of these rows. One pass adds up every slope; rows are
    neither shuffled nor repeated by column.

    Cases: features and labels hold no nulls, as fitting demands; a column that is constant has slope 0; without rows
    all slopes are null, and so are the coefficients of a model that could not be fitted (None); names of the columns may be anything, further columns are not read.
    """
    named = {f"x{k}": F.col(c).cast("double") for k, c in enumerate(columns)}
    residual = (score_column(columns, coefficients, intercept) - F.col(label).cast("double")).alias("r")
    narrow = rows.select(*[x.alias(n) for n, x in named.items()], residual)
    sums = narrow.agg(
        F.avg("r").alias("r"),
        *[F.avg(F.col("r") * F.col(x)).alias(f"g_{x}") for x in named],
        *[F.stddev_pop(x).alias(f"s_{x}") for x in named], *[F.avg(x).alias(f"m_{x}") for x in named], F.count(F.lit(1)).alias("n"),
    )

    def slope(x: str, b: float | None) -> Column:
        deviation = F.col(f"s_{x}") * F.sqrt(F.col("n") / F.nullif(F.col("n") - 1, F.lit(0)))
        varies = F.col(f"s_{x}") > 1e-9 * F.abs(F.col(f"m_{x}"))
        return F.when(varies, F.col(f"g_{x}") / deviation + reg * deviation * _number(b)).when(F.col("n") > 0, 0.0)

    def entry(name: str, b: float | None, gradient: Column) -> Column:
        return F.struct(F.lit(name).alias("feature"), _number(b).alias("coefficient"), gradient.alias("gradient"))

    entries = [entry(INTERCEPT, intercept, F.col("r")), *[entry(c, b, slope(x, b)) for c, b, x in zip(columns, coefficients, named)]]
    return sums.select(F.inline(F.array(*entries)))
