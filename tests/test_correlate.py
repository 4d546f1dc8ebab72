import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from yieldscope.operators import correlate, gram, split
from yieldscope.operators import sums as sums_of


def matrix(pairs, names):
    table = pairs.toPandas().pivot(index="a", columns="b", values="r")
    return table.loc[names, names].to_numpy()


def test_spearman_equals_spark_ml(planted):
    obs, x, y = planted
    got = matrix(correlate.spearman(obs, 400), ["target", *obs.names])
    vectors = obs.df.select(array_to_vector(F.concat(F.array("y"), "features")).alias("v"))
    want = Correlation.corr(vectors, "v", "spearman").first()[0].toArray()
    assert np.allclose(got, want, atol=1e-9)


def test_target_spearman_equals_pair_form_and_ignores_scale(planted, build):
    obs, x, y = planted
    whole = matrix(correlate.spearman(obs, 400), ["target", *obs.names])[0, 1:]
    one = correlate.target_spearman(obs, 400).toPandas().set_index("feature")["rho"]
    stretched = build(np.exp(x), y ** 3)
    other = correlate.target_spearman(stretched, 400, range_rows=37).toPandas().set_index("feature")
    assert np.allclose(one[list(obs.names)], whole)
    assert np.allclose(other["rho"][list(obs.names)], whole)


def test_pearson(planted):
    obs, x, _ = planted
    assert np.allclose(matrix(correlate.pearson(obs), list(obs.names)), np.corrcoef(x.T))


def test_p_values_of_known_points(spark):
    # two-sided tails of Student's t from published tables
    rows = [(2.228138852, 10.0, 0.05), (3.169272673, 10.0, 0.01), (1.959963985, 1e9, 0.05),
            (12.7062047, 1.0, 0.05), (0.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "t double, dof double, p double")
    got = df.select(correlate.t_two_sided("t", "dof").alias("got"), "p").toPandas()
    assert np.allclose(got["got"], got["p"], atol=1e-6)


def test_strongest_orders_by_absolute_value(planted):
    obs, _, _ = planted
    for method in ("spearman", "pearson"):
        top = [r["feature"] for r in correlate.strongest(obs, 400, 2, method).collect()]
        assert top == ["s.f1", "s.f3"]


def test_blocks_of_columns_give_the_same_pairs(planted, monkeypatch):
    obs, x, y = planted
    whole = matrix(correlate.pearson(obs), list(obs.names))
    ranks = matrix(correlate.spearman(obs, 400), ["target", *obs.names])
    for size in (2, 3, 4):
        monkeypatch.setattr(gram, "BLOCK", size)
        monkeypatch.setattr(correlate, "BLOCK", size)
        monkeypatch.setattr(gram, "HELD", 8 * size * size * 2)  # two block pairs in a pass
        assert np.allclose(matrix(correlate.pearson(obs), list(obs.names)), whole)
        assert np.allclose(matrix(correlate.spearman(obs, 400), ["target", *obs.names]), ranks)
        some = correlate.spearman(obs, 400, heads=["target", "s.f4"])
        assert {r["a"] for r in some.collect()} == {"target", "s.f4"} and some.count() == 14
        z = np.column_stack([np.ones(len(x)), x, y])
        assert np.allclose(gram.total(gram.grams(obs.df, split.hash_fold(3))).table, z.T @ z)
        sums = gram.product_sums(obs.df, F.col("features")).toPandas()
        assert len(sums) == 21 and np.allclose(sums["s"], (x.T @ x)[sums["i"], sums["j"]])


def test_a_constant_column_has_no_correlation(build):
    x = np.column_stack([np.full(50, 0.1), np.arange(50.0), np.arange(50.0) ** 2])
    got = correlate.pearson(build(x, np.arange(50.0))).toPandas().set_index(["a", "b"])["r"]
    assert np.isnan(got["s.f0", "s.f0"]) and np.isnan(got["s.f0", "s.f1"])
    assert np.isclose(got["s.f1", "s.f2"], np.corrcoef(x[:, 1], x[:, 2])[0, 1])


def test_arrays_of_many_partitions_are_added(spark):
    rows = [(i % 3, [float(i), 1.0]) for i in range(200)]
    parts = spark.createDataFrame(rows, "k int, v array<double>").repartition(40)
    want = {k: [float(sum(range(k, 200, 3))), float(len(range(k, 200, 3)))] for k in range(3)}
    assert {r["k"]: r["v"] for r in sums_of.merged(parts, ["k"]).collect()} == want
    assert {k[0]: v.tolist() for k, v in sums_of.collected(parts, ["k"]).items()} == want
