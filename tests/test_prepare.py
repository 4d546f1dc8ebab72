import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldscope.functions import scalars, size_rules
from yieldscope.operators import components, prepare, profile, scale
from yieldscope.sources.observations import (
    REGRESSION_EXCLUDED, from_wide, input_path, load_matrix, load_observations, numeric_columns,
    preview)


@pytest.fixture(scope="module")
def gappy(build):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(60, 5))
    x[::7, 0] = np.nan
    x[:, 1] = 4.0                        # constant
    x[:, 2] = np.nan                     # empty
    x[:, 3] = 1.6e9 + x[:, 3]            # epoch seconds
    y = draw.normal(size=60)
    y[:5] = np.nan
    return build(x, [None if v != v else v for v in y]), x, y


def test_clean_keeps_usable_features_and_fills_means(gappy):
    obs, x, y = gappy
    c = prepare.clean(obs, drop_epoch=True)
    assert c.rows == 55 and c.obs.names == ("s.f0", "s.f4")
    got = np.array(c.obs.df.orderBy("row_id").toPandas()["features"].tolist())
    col = x[5:, 0].copy()
    col[np.isnan(col)] = np.nanmean(col)
    assert np.allclose(got[:, 0], col)
    assert c.stats["std_pop"][0] == pytest.approx(col.std())
    assert prepare.clean(obs).obs.names == ("s.f0", "s.f3", "s.f4")


def test_adding_a_constant_column_changes_nothing(build):
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(30, 2)), draw.normal(size=30)
    plain = prepare.clean(build(x, y))
    wider = prepare.clean(build(np.column_stack([x, np.ones(30)]), y))
    assert plain.obs.names == wider.obs.names


def test_scalers_match_their_definitions(planted):
    obs, x, _ = planted

    def values(o):
        return np.array(o.df.orderBy("row_id").toPandas()["features"].tolist())

    assert np.allclose(values(scale.standardize(obs)), (x - x.mean(0)) / x.std(0))
    assert np.allclose(values(scale.unit_columns(obs)), x / np.linalg.norm(x, axis=0))
    assert np.allclose(values(scale.min_max(obs)), (x - x.min(0)) / (x.max(0) - x.min(0)))


def test_constant_feature_scales_to_zero(build):
    obs = scale.standardize(build(np.array([[1.0, 2.0]] * 12), [float(i) for i in range(12)]))
    assert obs.df.first()["features"] == [0.0, 0.0]


@pytest.mark.parametrize("rows,std,usable,needed,code", [
    (0, None, 0, 1, "-1"), (9, 1.0, 3, 1, "-4"), (10, 0.0, 3, 1, "-2"), (10, 1.0, 0, 1, "-3"),
    (10, 1.0, 1, 2, "-3"), (10, 1.0, 2, 2, "0")])
def test_gate(spark, rows, std, usable, needed, code):
    got = spark.range(1).select(prepare.gate(
        F.lit(rows), F.lit(std).cast("double"), F.lit(usable), needed)).first()[0]
    assert got == code


def test_epoch_rule_counts_characters(spark):
    rows = [(1.6e9, True), (-123456789.0, True), (999999999.5, True), (123456789.0, False),
            (12.0, False), (1e11, False)]
    df = spark.createDataFrame(rows, "m double, want boolean")
    assert df.filter(scalars.epoch_like(F.col("m")) != F.col("want")).count() == 0


def test_wide_input_with_dots_text_and_nan(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 2.0, float("nan"), "x", 3, "2024-01-01 00:00:00"), (2, 3.0, 1.0, "y", 4, "2024-01-01 00:05:00")],
        "WF_ID int, `a.target` double, `a.t` double, note string, `b.u` int, END_TIME string")
    obs = from_wide(df, "a.target")
    # a feature whose name is part of the target's name stays a feature
    assert obs.names == ("a.t", "b.u")
    assert numeric_columns(df, REGRESSION_EXCLUDED) == ["a.target", "a.t", "b.u"]
    rows = obs.df.orderBy("y").collect()
    assert rows[0]["features"] == [None, 3.0] and rows[1]["ts"].minute == 5
    path = str(tmp_path / "in.csv")
    df.write.option("header", True).csv(path)
    assert load_observations(spark, path).columns == df.columns
    assert preview(df)["rows"] == 2
    assert input_path(str(tmp_path), "in.csv", "file:/elsewhere", spark).startswith(str(tmp_path))
    assert input_path(str(tmp_path), "no.csv", "file:/elsewhere", spark) == "file:/elsewhere/no.csv"


def test_matrix_and_pca(spark, tmp_path):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(50, 4)) @ draw.normal(size=(4, 4))
    spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)]).write.csv(str(tmp_path / "m"))
    scores, ratios = components.pca_scores(load_matrix(spark, str(tmp_path / "m")))
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    assert np.allclose(ratios, values[::-1][:2] / values.sum())
    got = scores.orderBy(F.col("id").cast("int")).toPandas()
    assert np.allclose(np.abs(got["pc1"]), np.abs(z @ vectors[:, -1]))
    table = components.scree(spark, [0.5, 0.2, 0.2, 0.1])
    assert components.component_count(table).first()[0] == 3
    assert components.component_count(components.scree(spark, [0.4, 0.3])).first()[0] == 4


def test_kernel_components_separate_rings(spark):
    draw = np.random.default_rng(8)
    angle = draw.uniform(0, 2 * np.pi, 200)
    radius = np.where(np.arange(200) < 100, 0.3, 3.0)
    df = spark.createDataFrame([(i, float(r * np.cos(a)), float(r * np.sin(a)))
                                for i, (r, a) in enumerate(zip(radius, angle))], "row_id int, a double, b double")
    scores, _ = components.kernel_scores(df, F.array("a", "b"), 2, k=2, gamma=0.5, directions=150)
    pc = np.array(scores.orderBy("row_id").toPandas()["pc"].tolist())
    inner, outer = pc[:100], pc[100:]
    assert max(abs(inner[:, j].mean() - outer[:, j].mean()) / (inner[:, j].std() + 1e-9)
               for j in range(2)) > 3


def test_reconstruction_error_vanishes_with_all_components(spark):
    draw = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(v) for v in draw.normal(size=3)]) for i in range(40)],
                               "row_id int, x array<double>")
    full = components.reconstruction_error(df, F.col("x"), 3).agg(F.max("error")).first()[0]
    part = components.reconstruction_error(df, F.col("x"), 1).agg(F.min("error")).first()[0]
    assert full < 1e-6 and part > 0


@pytest.mark.parametrize("n,p,want", [
    (60, 8, (2, 10, 5, 20, 100, None, 5, 1e-4)), (299, 10, (5, 20, 10, 10, 100, None, 10, 5e-4)),
    (1500, 10, (1, 30, 5, 5, 150, 75, 5, 1e-3)), (20000, 900, (20, 30, 5, 3, 200, 100, 5, 1e-3)),
    (45, 3, (2, 10, 5, 20, 100, None, 3, 1e-4)), (300, 3, (3, 20, 10, 10, 100, None, 10, 5e-4))])
def test_size_rules(spark, n, p, want):
    assert tuple(size_rules.for_counts(spark, n, p).values()) == want


def test_dataset_shape_and_groups(spark, build):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("a", 4)], "GROUP_ID string, v int")
    row = profile.dataset_shape(df).first()
    assert (row["has_group"], row["group_size"], row["ratio"]) == (True, 2, 0.5)
    x = np.ones((12, 1))
    assert profile.single_group(build(x, [1.0] * 12))
    assert not profile.single_group(build(x, [1.0] * 12, groups=["A", "B"] * 6))


def test_rounding_noise_is_no_spread(spark):
    stats = spark.createDataFrame([(0, 9, 0, 7.0, 1e-16, 7.0, 7.0), (1, 9, 0, 7.0, 0.5, 6.0, 8.0), (2, 0, 9, None, None, None, None)],
                                  "idx int, n bigint, nulls bigint, mean double, std double, lo double, hi double")
    flags = prepare.feature_flags(stats).orderBy("idx").collect()
    assert [r["constant"] for r in flags] == [True, False, True] and [r["usable"] for r in flags] == [False, True, False]
