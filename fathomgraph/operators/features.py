"""The 141 features of a vertex pair.

Layout: 10 node features for (v1, v2), 29 node citation features for (v1, v2), 7 pair features for (y, y-1, y-2), 14
pair citation features for (y, y-1, y-2). Ids travel with the row as v1 and v2; features are f0 .. f140.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import PAIR_CITATION_NAMES, PAIR_NAMES, pair_citations, pair_indices
from ..session import broadcast_if_small, durable
from .graph import degrees, pagerank, shared_neighbours
from .ordered import average_rank

NODE_NAMES = ["deg0", "deg1", "deg2", "gain1", "gain2", "rank_gain1", "rank_gain2", "pr0", "pr1", "pr2"]
CITATION_BASE = ["c", "ct", "delta", "num", "c_m", "ct_m", "delta_m"]
CITATION_NAMES = [f"{name}_{lag}" for name in CITATION_BASE for lag in range(3)] + [
    f"{name}_{kind}" for name in ("ct", "num") for kind in ("gain1", "gain2", "rank_gain1", "rank_gain2")
]
VERTEX_NAMES = NODE_NAMES + CITATION_NAMES
YEARLY_NAMES = [f"{name}_{lag}" for name in PAIR_NAMES + PAIR_CITATION_NAMES for lag in range(3)]
FEATURE_COUNT = 2 * len(VERTEX_NAMES) + len(YEARLY_NAMES)


def _add_ranks(df: DataFrame, columns: dict[str, str], key: str) -> DataFrame:
    """Average rank over all vertices of several columns, ranked together in one ordered pass."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_which"), F.col(c).cast("double").alias("_value"))
                                        for i, c in enumerate(columns)])))
    ranks = broadcast_if_small(average_rank(rows, "_value", "_rank", group=["_which"]))
    out = df
    for i, (column, name) in enumerate(columns.items()):
        one = ranks.filter(F.col("_which") == i).select(F.col("_value").alias(f"_v{i}"), F.col("_rank").alias(name))
        out = out.join(one, out[column].cast("double") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    return out


def node_features(adj: DataFrame, vertices: DataFrame, year: int, **rank_options) -> DataFrame:
    """(v1, the 10 node features) of every vertex."""
    years = [year, year - 1, year - 2]
    deg = degrees(adj, vertices, years)
    pr = pagerank(adj, vertices, years, **rank_options)
    out = deg.join(pr, "v1").select(
        "v1",
        *[F.col(f"d{y}").alias(f"deg{i}") for i, y in enumerate(years)],
        (F.col(f"d{year}") - F.col(f"d{year - 1}")).alias("gain1"),
        (F.col(f"d{year}") - F.col(f"d{year - 2}")).alias("gain2"),
        *[F.col(f"pr{y}").alias(f"pr{i}") for i, y in enumerate(years)],
    )
    return _add_ranks(out, {"gain1": "rank_gain1", "gain2": "rank_gain2"}, "v1").select("v1", *NODE_NAMES)


def node_citation_features(table: DataFrame, year: int) -> DataFrame:
    """(v1, the 29 node citation features) from the yearly node table."""
    source = {"c": "c", "ct": "ct_y", "delta": "ct_delta", "num": "num", "c_m": "c_m", "ct_m": "ct_y_m", "delta_m": "ct_delta_m"}
    lags = {year - lag: lag for lag in range(3)}
    wide = table.filter(F.col("year").isin(*lags)).groupBy("v1").agg(
        *[
            F.coalesce(F.max(F.when(F.col("year") == y, F.col(column))), F.lit(0)).alias(f"{name}_{lag}")
            for name, column in source.items() for y, lag in lags.items()
        ]
    )
    gains = wide.withColumns({
        f"{name}_gain{lag}": F.col(f"{name}_0") - F.col(f"{name}_{lag}") for name in ("ct", "num") for lag in (1, 2)
    })
    ranked = _add_ranks(gains, {f"{n}_gain{lag}": f"{n}_rank_gain{lag}" for n in ("ct", "num") for lag in (1, 2)}, "v1")
    return ranked.select("v1", *CITATION_NAMES)


def vertex_features(node: DataFrame, citation: DataFrame) -> DataFrame:
    """All 39 features of a vertex, as doubles."""
    return node.join(citation, "v1").select("v1", *[F.col(n).cast("double").alias(n) for n in VERTEX_NAMES])


def maxima(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """The largest value of each column, 0 (and no rows) replaced by 1: one driver row of fixed width."""
    row = df.agg(*[F.max(n).alias(n) for n in names]).first()
    return {n: 1.0 if not row[n] else float(row[n]) for n in names}


def save_maxima(values: dict[str, float], spark, path: str) -> None:
    spark.createDataFrame(list(values.items()), "feature string, max double").coalesce(1).write.mode("overwrite").parquet(path)


def load_maxima(spark, path: str) -> dict[str, float]:
    return {r["feature"]: r["max"] for r in spark.read.parquet(path).collect()}


def rescale(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Divide by the given maxima; a negative maximum flips signs."""
    return df.withColumns({n: F.col(n) / F.lit(m) for n, m in values.items()})


def raw_pair_features(pairs: DataFrame, adj: DataFrame, vertices: DataFrame, vertex: DataFrame, year: int) -> DataFrame:
    """(v1, v2, v1's and v2's vertex features as a_*/b_*, the 21 + 42 unscaled yearly pair features).

    ``vertex`` is the unscaled vertex table; it already holds the degrees and citation counts of the three years.
    """
    years = [year, year - 1, year - 2]
    return _with_features(shared_neighbours(pairs, adj, degrees(adj, vertices, years), years), vertex, years)


def _with_features(counted: DataFrame, vertex: DataFrame, years: Sequence[int]) -> DataFrame:
    """The wide rows of pairs with their shared neighbours (v1, v2, n<year>)."""
    side = broadcast_if_small(vertex)
    a = side.select(F.col("v1"), *[F.col(n).alias(f"a_{n}") for n in VERTEX_NAMES])
    b = side.select(F.col("v1").alias("v2"), *[F.col(n).alias(f"b_{n}") for n in VERTEX_NAMES])
    joined = counted.join(a, "v1").join(b, "v2")
    columns: dict[str, Column] = {}
    for lag, y in enumerate(years):
        values = pair_indices(F.col(f"n{y}"), F.col(f"a_deg{lag}"), F.col(f"b_deg{lag}"))
        values |= pair_citations(
            {n: F.col(f"a_{n}_{lag}") for n in CITATION_BASE}, {n: F.col(f"b_{n}_{lag}") for n in CITATION_BASE}
        )
        columns |= {f"{n}_{lag}": value for n, value in values.items()}
    return joined.select(
        "v1", "v2", *[f"a_{n}" for n in VERTEX_NAMES], *[f"b_{n}" for n in VERTEX_NAMES],
        *[columns[n].alias(n) for n in YEARLY_NAMES],
    )


def feature_matrix(raw: DataFrame, vertex_max: dict[str, float], pair_max: dict[str, float]) -> DataFrame:
    """(v1, v2, f0 .. f140): scaled and in the fixed order."""
    ordered: list[Column] = []
    for n in VERTEX_NAMES:
        ordered += [F.col(f"{side}_{n}") / F.lit(vertex_max[n]) for side in ("a", "b")]
    ordered += [F.col(n) / F.lit(pair_max[n]) for n in YEARLY_NAMES]
    return raw.select("v1", "v2", *[c.alias(f"f{i}") for i, c in enumerate(ordered)])


def pair_feature_matrix(
    pairs: DataFrame, adj: DataFrame, vertices: DataFrame, node_table: DataFrame, year: int,
    pair_max: dict[str, float] | None = None, **rank_options,
) -> tuple[DataFrame, dict[str, float]]:
    """The 141 features of ``pairs`` and the pair maxima used.

    Without ``pair_max`` the maxima over the given pairs are taken; for scoring, pass those of the training run.
    """
    vertex = durable(
        vertex_features(node_features(adj, vertices, year, **rank_options), node_citation_features(node_table, year)), "vertex"
    )
    vertex_max = maxima(vertex, VERTEX_NAMES)
    # only the shared neighbours are written; the wide rows are joined again, for the maxima and for the result
    years = [year, year - 1, year - 2]
    counted = durable(shared_neighbours(pairs, adj, degrees(adj, vertices, years), years), "pairs")
    raw = _with_features(counted, vertex, years)
    used = pair_max if pair_max is not None else maxima(raw, YEARLY_NAMES)
    return feature_matrix(raw, vertex_max, used), used
