"""Samples, splits, ROC figures, the threshold sweep and the impact classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .ordered import with_rank, with_running


def shuffle_key(seed: int, *keys: str) -> Column:
    """A reproducible random order: md5 of the seed and the row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def shuffled(df: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """All rows with ``place``, their rank in a random order that can be repeated."""
    return with_rank(df.withColumn("_key", shuffle_key(seed, *keys)), ["_key", *keys], "place").drop("_key")


def exact_sample(df: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """Exactly min(n, rows) rows, picked by random order; no task or driver holds the sample."""
    ranked = with_rank(df.withColumn("_key", shuffle_key(seed, *keys)), ["_key", *keys], "_rank")
    return ranked.filter(F.col("_rank") <= n).drop("_key", "_rank")


def two_class_subsets(labelled: DataFrame, label: str, seed: int, keys: Sequence[str], limit: int = 30_000_000) -> DataFrame:
    """All positives, and all negatives unless they are more than ``limit``: then as many as there are positives.

    ``limit`` bounds the labelled rows that a classifier is fitted on.
    """
    counts = labelled.agg(
        F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")
    ).first()
    negatives, positives = labelled.filter(F.col(label) == 0), labelled.filter(F.col(label) == 1)
    if counts["neg"] > limit:
        negatives = exact_sample(negatives, min(counts["neg"], counts["pos"]), seed, keys)
    return negatives.unionByName(positives)


def split_per_class(df: DataFrame, label: str, seed: int, keys: Sequence[str], share: float = 0.85) -> DataFrame:
    """Add ``part``: 'train' for int(n * share) random rows of each class, else 'test'."""
    sizes = df.groupBy(label).agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("_train"))
    ranked = with_rank(df.withColumn("_key", shuffle_key(seed, *keys)), ["_key", *keys], "_rank", group=[label])
    return (
        ranked.join(F.broadcast(sizes), label)  # one row per class
        .withColumn("part", F.when(F.col("_rank") <= F.col("_train"), "train").otherwise("test"))
        .drop("_key", "_rank", "_train")
    )


def _counts(df: DataFrame, score: str, positive: dict[str, Column], group: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, with the totals of all lower scores."""
    per_score = df.groupBy(*group, score).agg(
        *[F.count_if(c).alias(f"pos_{n}") for n, c in positive.items()],
        *[F.count_if(~c).alias(f"neg_{n}") for n, c in positive.items()],
    )
    sums = [f"{kind}_{n}" for n in positive for kind in ("pos", "neg")]
    return with_running(per_score, [score], sums, group=group)


def _auc(n: str) -> Column:
    pos, neg, below = F.col(f"pos_{n}").cast("double"), F.col(f"neg_{n}").cast("double"), F.col(f"neg_{n}_before").cast("double")
    return F.sum(pos * (below + neg / 2)) / F.nullif(F.sum(pos) * F.sum(neg), F.lit(0.0))


def auc(df: DataFrame, score: str, positive: Column, group: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null when a class is empty."""
    counted = _counts(df, score, {"x": positive}, group)
    return counted.groupBy(*group).agg(_auc("x").alias("auc"))


def roc_points(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score: share of the rows at or above it."""
    counted = _counts(df, score, {"x": positive}, ())
    totals = counted.agg(F.sum("pos_x").alias("p"), F.sum("neg_x").alias("n")).first()
    return counted.select(
        F.col(score).alias("threshold"),
        ((totals["n"] - F.col("neg_x_before")) / F.nullif(F.lit(float(totals["n"])), F.lit(0.0))).alias("fpr"),
        ((totals["p"] - F.col("pos_x_before")) / F.nullif(F.lit(float(totals["p"])), F.lit(0.0))).alias("tpr"),
    )


def threshold_sweep(df: DataFrame, score: str, citation: str, part: str, thresholds: Sequence[int] = range(1, 41)) -> DataFrame:
    """(part, ir, auc) for every threshold, from one average rank per (part, score).

    The rank of a score does not depend on the threshold: with R the sum of the ranks of the p rows at or above it, of n,
    the area is (R - p (p + 1) / 2) / (p (n - p)).
    """
    rows = durable(df.select(part, score, citation), "sweep")
    above = {t: F.count_if(F.col(citation) >= t) for t in thresholds}
    per_score = rows.groupBy(part, score).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"_p{t}") for t, c in above.items()])
    ranked = with_running(durable(per_score, "sweep-scores"), [score], ["_n"], group=[part])
    rank = F.col("_n_before") + (F.col("_n") + 1) / 2
    sums = ranked.groupBy(part).agg(F.sum("_n").alias("n"), *[x for t in above for x in (F.sum(f"_p{t}").alias(f"p{t}"), F.sum(F.col(f"_p{t}") * rank).alias(f"r{t}"))])

    def area(t: int) -> Column:
        p = F.col(f"p{t}").cast("double")
        return F.struct(F.lit(int(t)).alias("ir"), ((F.col(f"r{t}") - p * (p + 1) / 2) / F.nullif(p * (F.col("n") - p), F.lit(0.0))).alias("auc"))

    return sums.select(part, F.inline(F.array(*[area(t) for t in above])))


def report_lines(sweep: DataFrame, part: str = "part") -> DataFrame:
    """Text lines ``IR=[n]: train=x; test=y; eval=z``."""
    wide = sweep.groupBy("ir").pivot(part, ["train", "test", "eval"]).agg(F.first("auc"))
    return wide.select(F.concat(
        F.lit("IR=["), F.col("ir"), F.lit("]: train="), F.col("train"), F.lit("; test="), F.col("test"), F.lit("; eval="), F.col("eval")
    ).alias("value"))


_REPORT = r"IR=\[(\d+)\]: train=([\d.]+); test=([\d.]+); eval=([\d.]+)"


def best_threshold(lines: DataFrame, text: str = "value") -> DataFrame:
    """(best_ir, best_eval): the threshold of the highest eval AUC in the report, the first one on a tie."""
    parsed = lines.filter(F.col(text).rlike(_REPORT)).select(
        F.regexp_extract(text, _REPORT, 1).cast("int").alias("ir"), F.regexp_extract(text, _REPORT, 4).cast("double").alias("eval")
    )
    return parsed.agg(F.min_by("ir", F.struct(-F.col("eval"), F.col("ir"))).alias("best_ir"), F.max("eval").alias("best_eval"))


def fit_impact(features: DataFrame, columns: Sequence[str], label: str = "label", **options):
    """Logistic impact model on the feature columns; returns it and a function that adds ``score`` (0..1).

    Without rows there is nothing to fit: the model is None and the scores are null.
    """
    if features.isEmpty():
        return None, lambda rows: rows.withColumn("score", F.lit(None).cast("double"))
    assemble = VectorAssembler(inputCols=list(columns), outputCol="_x")
    model = LogisticRegression(featuresCol="_x", labelCol=label, **options).fit(assemble.transform(features))

    def score(rows: DataFrame) -> DataFrame:
        scored = model.transform(assemble.transform(rows))
        return scored.withColumn("score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")

    return model, score
