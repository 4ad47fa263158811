"""Ranked and named predictions, and the distribution of their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .ordered import is_monotonic, with_rank, with_running

KEYS = ("v1", "v2")


def by_score(df: DataFrame, score: str = "score", keys: Sequence[str] = KEYS) -> list[Column]:
    return [F.col(score).desc(), *[F.col(k) for k in keys]]


def sort_predictions(df: DataFrame, score: str = "score", keys: Sequence[str] = KEYS) -> DataFrame:
    return df.orderBy(*by_score(df, score, keys))


def top_k(df: DataFrame, k: int = 10, score: str = "score", keys: Sequence[str] = KEYS) -> DataFrame:
    return sort_predictions(df, score, keys).limit(k)


def name_pairs(pairs: DataFrame, dictionary: DataFrame, missing: str = "Keyword Not Found") -> DataFrame:
    """(concept1_id, concept1_keyword, concept2_id, concept2_keyword, other columns) by two dimension lookups."""
    names = broadcast_if_small(dictionary.select("concept_id", "concept"))
    rest = [c for c in pairs.columns if c not in KEYS]
    one = names.select(F.col("concept_id").alias("v1"), F.col("concept").alias("_k1"))
    two = names.select(F.col("concept_id").alias("v2"), F.col("concept").alias("_k2"))
    return pairs.join(one, "v1", "left").join(two, "v2", "left").select(
        F.coalesce("v1", F.lit(-1)).alias("concept1_id"), F.coalesce("_k1", F.lit(missing)).alias("concept1_keyword"),
        F.coalesce("v2", F.lit(-1)).alias("concept2_id"), F.coalesce("_k2", F.lit(missing)).alias("concept2_keyword"), *rest,
    )


def score_band(score: Column) -> Column:
    return (
        F.when(score > 0.9, ">0.9").when(score > 0.8, "0.8-0.9").when(score > 0.7, "0.7-0.8")
        .when(score > 0.6, "0.6-0.7").otherwise("<=0.6")
    )


def score_bands(df: DataFrame, score: str = "score") -> DataFrame:
    return df.groupBy(score_band(F.col(score)).alias("band")).agg(F.count(F.lit(1)).alias("pairs"))


def score_summary(df: DataFrame, score: str = "score") -> DataFrame:
    """min, max, mean, exact median and sample deviation.

    The median is read off the running counts of distinct scores, so no task collects all values.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    running = with_running(counts, [score], ["n"])
    total = F.lit(running.agg(F.sum("n")).first()[0] or 0)
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n")), F.col(score)))

    median = running.agg(((at(low) + at(high)) / 2).alias("median")).first()["median"]
    return df.agg(
        F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score"),
        F.lit(median).cast("double").alias("median_score"), F.stddev_samp(score).alias("std_score"),
    )


def rank_and_quantile(df: DataFrame, score: str = "score", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rank 1..n by falling score and quantile = rank / n."""
    ranked = with_rank(df, by_score(df, score, keys), "rank")
    return ranked.withColumn("quantile", F.col("rank") / F.lit(float(ranked.count() or 1)))


def descending_check(df: DataFrame, place: Sequence[Column | str], score: str = "score") -> DataFrame:
    return is_monotonic(df, place, score)


def cumulative_share(df: DataFrame, score: str = "score", keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of the total score held by each pair and all better ones."""
    running = with_running(df, by_score(df, score, keys), [score], type_="double")
    total = running.agg(F.sum(score)).first()[0] or 0.0
    return running.withColumn(
        "cum_share", (F.col(f"{score}_before") + F.col(score)) / F.nullif(F.lit(float(total)), F.lit(0.0))
    ).drop(f"{score}_before")


def entity_categories(entities: DataFrame, name: str, category: str, order: str) -> DataFrame:
    """(name, category), of a repeated name the last row counts."""
    return entities.groupBy(name).agg(F.max_by(category, order).alias(category))


def attach_categories(predictions: DataFrame, categories: DataFrame, name: str = "name", category: str = "category") -> DataFrame:
    table = broadcast_if_small(categories.select(F.col(name).alias("_n"), F.col(category).alias("_c")))
    out = predictions
    for side in ("concept1", "concept2"):
        out = out.join(table.withColumnsRenamed({"_n": f"{side}_keyword", "_c": f"{side}_category"}), f"{side}_keyword", "left")
    return out


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    total = df.filter(F.col(category).isNotNull()).count()
    counts = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("percentage", F.round(F.col("count") * 100.0 / F.lit(total or 1), 2))


def category_matrix(df: DataFrame, score: str = "score") -> DataFrame:
    """Per unordered category pair: mean score, count, sample deviation; pairs never seen get null, 0 and 0.

    The complete list comes from the categories present, each one row, made by an array and not by a join.
    """
    seen = df.groupBy(
        F.least("concept1_category", "concept2_category").alias("category1"),
        F.greatest("concept1_category", "concept2_category").alias("category2"),
    ).agg(F.avg(score).alias("avg_score"), F.count(F.lit(1)).alias("count"), F.stddev_samp(score).alias("std"))
    names = sorted(
        {r[0] for r in seen.select(F.explode(F.array("category1", "category2"))).distinct().collect() if r[0] is not None}
    )  # category names: a fixed, short label set
    grid = df.sparkSession.createDataFrame([(n,) for n in names], "category1 string").select(
        "category1", F.explode(F.array(*[F.lit(n) for n in names])).alias("category2")
    ).filter(F.col("category1") <= F.col("category2"))
    return grid.join(seen, ["category1", "category2"], "left").select(
        "category1", "category2", "avg_score", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
        F.coalesce(F.col("std"), F.lit(0.0)).alias("std"),
    )


def category_matrix_wide(matrix: DataFrame, value: str = "avg_score") -> DataFrame:
    """Symmetric wide form, one row and one column per category."""
    other = matrix.filter(F.col("category1") != F.col("category2"))
    both = matrix.select("category1", "category2", value).unionByName(
        other.select(F.col("category2").alias("category1"), F.col("category1").alias("category2"), value)
    )
    return both.groupBy("category1").pivot("category2").agg(F.first(value))


def count_score_correlation(matrix: DataFrame) -> DataFrame:
    """Pearson correlation of count and mean score over the category pairs that occur."""
    return matrix.filter(F.col("count") > 0).agg(F.corr("count", "avg_score").alias("pearson"))


def padded_range(matrix: DataFrame, padding: float = 0.05) -> DataFrame:
    low, high = F.min("avg_score"), F.max("avg_score")
    return matrix.agg(
        low.alias("low"), high.alias("high"),
        (low - (high - low) * padding).alias("padded_low"), (high + (high - low) * padding).alias("padded_high"),
    )
