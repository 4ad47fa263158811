"""The gradient of the impact model against plain numpy, and scores that DuckDB computes from written coefficients."""

import duckdb
import numpy as np
import pytest

from fathomgraph.operators import evaluate, optimality

COLUMNS = ["a", "r", "x1", "still"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.c_[rng.normal(size=600), rng.exponential(3, size=600), rng.integers(0, 4, size=600), np.full(600, 0.1)]
    y = rng.random(600) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.4 * x[:, 1] + 0.3)))
    table = [(*map(float, r), int(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(table, "a double, r double, x1 double, still double, label int").cache(), x, y.astype(float)


def plain(x, y, b, intercept, reg):
    p = 1 / (1 + np.exp(-(x @ b + intercept)))
    s = x.std(axis=0, ddof=1)
    g = [((p - y) * x[:, k]).mean() / s[k] + reg * s[k] * b[k] if s[k] > 1e-9 else 0.0 for k in range(x.shape[1])]
    return [(p - y).mean(), *g]


@pytest.mark.parametrize("reg", [0.0, 0.05])
def test_equals_numpy_at_any_coefficients(rows, reg):
    df, x, y = rows
    b = [0.7, -0.2, 0.1, 0.0]
    got = optimality.impact_gradient(df, COLUMNS, "label", b, 0.4, reg).collect()
    assert [r["feature"] for r in got] == [optimality.INTERCEPT, *COLUMNS] and [r["coefficient"] for r in got] == [0.4, *b]
    assert [r["gradient"] for r in got] == pytest.approx(plain(x, y, np.array(b), 0.4, reg), abs=1e-10)


@pytest.mark.parametrize("reg", [0.0, 0.05])
def test_a_fitted_model_is_flat_and_a_moved_one_is_not(rows, reg):
    df, _, _ = rows
    model, _ = evaluate.fit_impact(df, COLUMNS, maxIter=200, tol=1e-10, regParam=reg)
    got = optimality.impact_gradient(df, COLUMNS, "label", model.coefficients, model.intercept, reg).collect()
    assert max(abs(r["gradient"]) for r in got) < 1e-5
    moved = [model.coefficients[0] + 0.1, *model.coefficients[1:]]
    assert max(abs(r["gradient"]) for r in optimality.impact_gradient(df, COLUMNS, "label", moved, model.intercept, reg).collect()) > 1e-3


def test_scores_are_those_of_sql_from_written_coefficients(rows, tmp_path):
    df, _, _ = rows
    model, score = evaluate.fit_impact(df, COLUMNS, maxIter=50, regParam=0.01)
    gradient = optimality.impact_gradient(df, COLUMNS, "label", model.coefficients, model.intercept, 0.01)
    gradient.write.parquet(f"{tmp_path}/model")
    scored = score(df).withColumn("again", optimality.score_column(COLUMNS, model.coefficients, model.intercept))
    scored.write.parquet(f"{tmp_path}/scored")
    off = duckdb.sql(
        f"WITH b AS (SELECT feature, coefficient FROM '{tmp_path}/model/*.parquet'), "
        f"s AS (SELECT row_number() OVER () AS id, * FROM '{tmp_path}/scored/*.parquet'), "
        "long AS (UNPIVOT (SELECT id, a, r, x1, still FROM s) ON a, r, x1, still INTO NAME feature VALUE v), "
        "m AS (SELECT id, sum(v * coefficient) + (SELECT coefficient FROM b WHERE feature = '(intercept)') AS margin FROM long JOIN b USING (feature) GROUP BY id) "
        "SELECT count(*), max(abs(1 / (1 + exp(-margin)) - score)), max(abs(again - score)) FROM s JOIN m USING (id)"
    ).fetchall()[0]
    assert off[0] == 600 and off[1] < 1e-9 and off[2] < 1e-9


def test_no_rows_and_one_row(rows):
    df, _, _ = rows
    b = [0.1, 0.2, 0.3, 0.0]
    assert {r["gradient"] for r in optimality.impact_gradient(df.limit(0), COLUMNS, "label", b, 0.0).collect()} == {None}
    one = optimality.impact_gradient(df.limit(1), COLUMNS, "label", b, 0.0).collect()
    assert [r["gradient"] for r in one[1:]] == [0.0] * 4
