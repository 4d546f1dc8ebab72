import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldscope.operators import gram, linear, screening, split

ALPHAS = 10.0 ** np.linspace(-0.7, 0.3, 12)


def wide(spark, n, p, seed=1, parts=4):
    """Correlated columns, a target on five of them, a constant column; made on the executors."""
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                draw = np.random.default_rng(seed * 1_000_003 + i)
                common = draw.normal(size=8)
                x = draw.normal(size=p) + common[np.arange(p) % 8]
                x[7] = 2.0
                y = 3 * x[3] - 2 * x[50] + x[100] - x[101] + 0.5 * x[p - 1] + 0.5 * draw.normal()
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([x], pa.list_(pa.float64())), pa.array([y])],
                                                 names=["row_id", "features", "y"])

    df = spark.range(n, numPartitions=parts).mapInArrow(rows, "row_id bigint, features array<double>, y double")
    return df.select("row_id", "features", "y")


@pytest.mark.parametrize("unit", [False, True])
def test_equal_to_the_whole_table(spark, unit):
    df = wide(spark, 400, 1500).persist()
    try:
        side = split.in_test(0.3, 42).cast("int")
        whole = gram.grams(df, side)
        norms = np.sqrt(np.diag(gram.total(whole).xx)) if unit else np.ones(1500)
        alphas = ALPHAS / (400 ** 0.5 if unit else 1)
        want = linear.lasso_grid(whole[0].unit_columns(norms), whole[1].unit_columns(norms), alphas)
        got, held = screening.lasso_grid(df, side, alphas, unit=unit)
        assert len(held.columns) < 600 and held.passes < 40
        for a, b in zip(want, got):
            assert np.allclose(list(a.values()), list(b.values()), atol=1e-6)
    finally:
        df.unpersist()


def test_cross_validation_and_single_fit(spark):
    df = wide(spark, 240, 400).persist()
    try:
        fold = split.hash_fold(4)
        whole = gram.grams(df, fold)
        want = linear.lasso_cv(whole, ALPHAS)
        got = screening.lasso_cv(df, fold, ALPHAS)
        assert got["alpha"] == want["alpha"] and np.allclose(got["mse"], want["mse"], atol=1e-6)
        dense = np.zeros(400)
        dense[list(got["coefs"])] = list(got["coefs"].values())
        assert np.allclose(dense, want["coefs"], atol=1e-6)
        one, all_of = screening.lasso(df, 0.2), linear.lasso(gram.total(whole), 0.2)
        dense = np.zeros(400)
        dense[list(one["coefs"])] = list(one["coefs"].values())
        assert np.allclose(dense, all_of["coefs"], atol=1e-7) and np.isclose(one["r2"], all_of["r2"])
    finally:
        df.unpersist()


def test_twenty_thousand_columns(spark):
    df = wide(spark, 150, 20_000, parts=8).persist()
    try:
        fit = screening.lasso_cv(df, split.hash_fold(3), 10.0 ** np.linspace(0, 0.3, 4))
        assert {3, 50} <= set(fit["coefs"]) and len(fit["coefs"]) < 150
    finally:
        df.unpersist()


def test_dense_models_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(screening, "MAX_WIDTH", 20)
    with pytest.raises(ValueError, match="hold more than"):
        screening.lasso(wide(spark, 60, 120), 1e-3)
