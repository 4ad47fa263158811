"""Operator 4: near-duplicate vectors by a pivot-permutation index.

Pivots are a bounded sample of the vectors (``pivot_count`` says how many), by hash of the id. Each vector is described by
its ``nearest`` nearest pivots in order of cosine, and enters the inverted list of each of them, by label. Vectors are
compared if they share at least ``least_shared`` pivots; the list of the smallest shared pivot compares them, so each pair
is met once. Pairs found are verified by cosine in double precision.

Equal vectors are one class first. Lists are cut into blocks, and a task compares two blocks, however long the list; it
returns counts of links and the local component of each vector, never the pairs.

Cases: a vector that is null, empty, zero, or has null or non-finite components, or has a null label or id, links with
nothing: no links, component its own id, kept (a null id is not kept); vectors of other lengths are never compared; equal
vectors link; rows with one id are one node; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import public_columns
from .components import components

BLOCK = 1024
MOST_PIVOTS = 1024


def pivot_count(n: int) -> int:
    """Pivots for ``n`` vectors: about the square root, from 32 to ``MOST_PIVOTS``."""
    return min(MOST_PIVOTS, max(32, math.isqrt(n)))


def _describe(pivots: dict[int, np.ndarray], nearest: int):
    """The ordered nearest pivots of each vector, as rows of the inverted lists."""

    def run(batches):
        for batch in batches:
            ids, dims, values = (batch.column(c).to_pylist() for c in ("rep", "dim", "vector"))
            out_row, out_pivot, out_shared = [], [], []
            for k, (dim, vector) in enumerate(zip(dims, values)):
                found = np.zeros(1, dtype=np.int32)
                if dim in pivots:
                    x = np.array(vector)
                    found = np.argsort(-(pivots[dim] @ (x / np.sqrt(x @ x))), kind="stable")[:nearest].astype(np.int32)
                out_row += [k] * len(found)
                out_pivot += found.tolist()
                out_shared += [found.tolist()] * len(found)
            rows = batch.take(pa.array(out_row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("label", "dim", "rep", "copies", "vector")), pa.array(out_pivot, pa.int32()), pa.array(out_shared, pa.list_(pa.int32()))],
                names=["label", "dim", "rep", "copies", "vector", "pivot", "nearest"],
            )

    return run


LISTED = "label int, dim int, rep bigint, copies bigint, vector array<double>, pivot int, nearest array<int>"


def _compare(least: float, least_shared: int):
    def run(group: pa.Table) -> pa.Table:
        pivot = group.column("pivot")[0].as_py()
        x = np.array(group.column("vector").to_pylist(), dtype=np.float64)
        ids, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        own = group.column("own").to_numpy()
        near = group.column("nearest").to_pylist()
        member = np.zeros((len(ids), 1 + max(map(max, near))), dtype=np.float32)
        for k, some in enumerate(near):
            member[k, some] = 1
        low, high = np.flatnonzero(group.column("bi").to_numpy() == own), np.flatnonzero(group.column("bj").to_numpy() == own)
        norms = np.sqrt((x * x).sum(axis=1))
        cosine = (x[low] @ x[high].T) / (norms[low][:, None] * norms[high][None, :])
        linked = (cosine >= least) & (ids[low][:, None] != ids[high][None, :])
        linked &= member[low] @ member[high].T >= np.minimum(least_shared, np.minimum.outer(member[low].sum(1), member[high].sum(1)))
        linked &= member[low, :pivot] @ member[high, :pivot].T == 0
        full = np.zeros((len(ids), len(ids)), dtype=bool)
        full[np.ix_(low, high)] = linked
        full |= full.T
        links = full @ copies
        root = ids.copy()
        while True:
            best = np.where(full, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            best = np.minimum(root, best)
            if (best == root).all():
                break
            root = best
        some = links > 0
        return pa.table({"rep": ids[some], "links": links[some].astype(np.int64), "root": root[some]})

    return run


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, nearest: int = 8, least_shared: int = 2, pivots: int | None = None,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    rows = public_columns(vectors, vec_id=vec_id, label=label, embedding=embedding).withColumn("vector", F.col("embedding").cast("array<double>"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda v: v != 0)
    rows = rows.select("vec_id", F.col("label").cast("int").alias("label"), F.when(valid, F.col("vector")).alias("vector"), F.size("vector").alias("dim"))
    classes = rows.filter("vector is not null").groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = durable(classes, "vector-classes")
    wanted = pivots or pivot_count(classes.count())
    sample = classes.select("dim", "vector", F.xxhash64("rep", "vector").alias("place")).orderBy("place", "vector").limit(wanted).collect()
    chosen: dict[int, list] = {}
    for row in sample:
        chosen.setdefault(row["dim"], []).append(np.array(row["vector"]))
    matrices = {dim: np.stack([v / np.sqrt(v @ v) for v in some]) for dim, some in chosen.items()}

    listed = classes.select("label", "dim", "rep", "copies", "vector").mapInArrow(_describe(matrices, nearest), LISTED)
    listed = durable(listed, "pivot-lists")
    sizes = listed.groupBy("label", "dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    listed = listed.join(sizes, ["label", "dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = listed.select("*", others.alias("other")).withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")})
    found = dealt.groupBy("label", "dim", "pivot", "bi", "bj").applyInArrow(_compare(least, least_shared), "rep bigint, links bigint, root bigint")
    found = durable(found, "vector-links")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    result = classes.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "dim", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")
    )
    hashed = lambda df: df.withColumn("key", F.xxhash64("label", "vector"))
    known = hashed(rows.filter("vector is not null")).join(hashed(result), ["key", "label", "dim", "vector"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = known.unionByName(rest)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
