"""Operator 4 against brute force, with recall."""

import numpy as np
import pytest

from fathomgraph.llm import pivots

SCHEMA = "vec_id bigint, embedding array<float>, label int, dim string, rep int, root string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "d", 1, "r") for i, v, label in rows], SCHEMA)


def brute(rows, least=0.98):
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64), label) for i, v, label in rows if v is not None and label is not None and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, x, p in good:
        for b, y, q in good:
            if a != b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a].add(b)
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += links[k]
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


def cloud(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 4, dim))
    rows = []
    for k in range(n):
        spread = rng.choice([0.0, 0.05, 0.12, 0.2])
        v = centres[rng.integers(len(centres) // 2 if k % 3 else len(centres))] + spread * rng.normal(size=dim)
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_no_false_links(spark, seed, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 20)
    rows = cloud(seed)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_duplicates(table(spark, rows)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k][0] for k in want) >= 0.97 * sum(want[k][0] for k in want)


def test_all_pivots_shared_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rows = cloud(3, 200)
    found = pivots.near_duplicates(table(spark, rows), nearest=4, least_shared=1, pivots=4)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()} == brute(rows)


def test_awkward_vectors(spark):
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [2.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 2), (5, [1.0, 0.0, 0.0], None), (6, None, 1),
        (7, [0.0, 0.0, 0.0], 1), (8, [float("nan"), 1.0, 0.0], 1), (9, [float("inf"), 1.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.0], 1), (12, [3.0, 0.0], 1),
        (13, [-1.0, 0.0, 0.0], 1), (14, [-0.0, 1.0, 0.0], 1), (15, [0.0, 1.0, 0.0], 1),
    ]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_duplicates(table(spark, rows)).collect()}
    assert got == brute([(i, v, label) if v is None or len(v) else (i, None, label) for i, v, label in rows])
    with_nulls = table(spark, [(1, [1.0, None], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)])
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in pivots.near_duplicates(with_nulls).collect())
    assert got == [(-1, 0, -1, False), (1, 0, 1, True), (2, 1, 2, True), (2, 1, 2, True)]
    assert pivots.near_duplicates(table(spark, [])).count() == 0


def test_pivot_count_is_bounded():
    assert pivots.pivot_count(0) == 32 and pivots.pivot_count(10_000) == 100 and pivots.pivot_count(10**12) == pivots.MOST_PIVOTS
