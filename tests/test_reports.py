import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldscope.operators import trees
from yieldscope.plans.driver_report import combine, driver_report
from yieldscope.plans.prescreen import preset, prescreen
from yieldscope.plans.reports import Report, clustering_report, regression_report
from yieldscope.sources import results


@pytest.fixture()
def database(spark, tmp_path):
    name = "t" + uuid.uuid4().hex[:10]
    results.create_tables(spark, name, str(tmp_path / name))
    return name


SMALL = dict(forest_trees=10, depth=5, information="equi")


@pytest.mark.parametrize("folds,mode", [("hash", "out_of_fold"), ("contiguous", "in_block")])
def test_regression_report_finds_and_stores_the_drivers(spark, planted, database, folds, mode):
    obs, _, _ = planted
    report = regression_report(obs, rounds=2, folds=folds, fold_mode=mode, **SMALL)
    assert report.code == "0"
    top = [r["feature"] for r in report.importance.limit(2).collect()]
    assert top == ["s.f1", "s.f3"]
    names = [r["feature"] for r in report.coefficients.limit(2).collect()]
    assert names == ["s.f1", "s.f3"]
    signs = {r["feature"]: np.sign(r["score"]) for r in report.coefficients.collect()}
    assert signs["s.f1"] == 1 and signs["s.f3"] == -1
    final = report.final.toPandas()
    # strictly above the median target correlation; each suggestion once, itself its best partner
    assert set(final["suggestion"]) >= {"s.f1", "s.f3"} and final["suggestion"].is_unique
    assert (final.loc[final["suggestion"].isin(names), "abs_corr_final_suggestion"] > 0.999).all()
    report.save(database, "20240105-job", spark)
    stored = results.read_results(spark, database, "final_report", "20240105-job")
    assert stored.count() == len(final)
    row = stored.filter("suggestion = 's.f1'").first()
    mine = final[final["suggestion"] == "s.f1"].iloc[0]
    assert row["maximum_info_coeff"] == pytest.approx(mine["maximum_info_coeff"], abs=1e-4)
    assert row["mean_of_corr"] == pytest.approx(mine["mean_of_corr"], abs=1e-4)
    assert results.read_results(spark, database, "importance", dt="20240105").count() == 6


def test_status_codes(spark, build, database):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(30, 2))
    cases = {
        "-1": build(x[:1], [1.0]).with_df(build(x[:1], [1.0]).df.limit(0)),
        "-4": build(x[:9], x[:9, 0]),
        "-2": build(x, [5.0] * 30),
        "-3": build(np.ones((30, 2)), x[:, 0]),
    }
    for code, obs in cases.items():
        for report in (regression_report(obs), clustering_report(obs)):
            assert report.code == code and report.importance is None
    Report("-2").save(database, "20240106-bad", spark)
    row = results.read_results(spark, database, "importance", "20240106-bad").first()
    assert (row["result"], row["xparam"], row["dt"]) == ("-2", "error", "20240106")


def test_single_feature_is_too_few_for_clustering(build):
    x = np.random.default_rng(1).normal(size=(30, 1))
    assert clustering_report(build(x, x[:, 0])).code == "-3"


def test_clustering_report_single_group(spark, build, database):
    draw = np.random.default_rng(12)
    level = np.repeat([0.0, 10.0, 20.0], 40)
    order = draw.permutation(120)
    x = draw.normal(size=(120, 4))
    x[:, 2] += level[order] / 3
    report = clustering_report(build(x, level[order] + 0.1 * draw.normal(size=120)), starts=3,
                               overrides={"iterations": 2, "max_cluster": 6, "rf_iterations": 2},
                               **SMALL)
    assert report.code == "0" and report.facts["classes"] >= 3
    assert report.importance.first()["feature"] == "s.f2"
    assert report.history.first()["included"] == ["s.f2"]
    report.save(database, "20240107-c", spark)
    assert results.read_results(spark, database, "coefficients", "20240107-c").count() >= 1


def test_clustering_report_several_groups_takes_the_response_as_class(build):
    draw = np.random.default_rng(13)
    x = draw.normal(size=(90, 3))
    y = np.array(["low", "mid", "top"])[np.digitize(x[:, 1], [-0.4, 0.4])]
    report = clustering_report(build(x, list(y), groups=["A", "B", "C"] * 30),
                               overrides={"rf_iterations": 2}, **SMALL)
    assert report.facts["classes"] == 3 and report.history.first()["included"] == ["s.f1"]


def test_report_blocks_and_ties(planted, spark):
    obs, _, _ = planted
    from yieldscope.operators.ranks import rank_spots
    from yieldscope.plans.driver_report import pair_scores
    spots = rank_spots(obs, 400)
    whole = pair_scores(obs, 400, ["s.f1"], obs.names, spots).orderBy("suggestion").toPandas()
    cut = pair_scores(obs, 400, ["s.f1"], obs.names, spots, block=2).orderBy("suggestion").toPandas()
    assert whole.equals(cut) or np.allclose(whole.iloc[:, 2:], cut.iloc[:, 2:])
    pairs = spark.createDataFrame([("b", "x", 0.5, 0.2), ("a", "x", 0.5, 0.2)],
                                  "final string, suggestion string, abs_corr_final_suggestion double, "
                                  "abs_corr_target_suggestion double")
    info = spark.createDataFrame([("x", 0.3)], "feature string, mic double")
    assert combine(pairs, info).first()["final"] == "a"
    assert driver_report(obs, 400, ["s.f1"], ["s.f1"], information="equi").isEmpty()


def test_prescreen_recovers_planted_features(build):
    draw = np.random.default_rng(21)
    x = draw.normal(size=(200, 20))
    y = x[:, :5] @ np.array([5.0, 4.0, 3.0, 3.5, 1.5]) + 0.3 * draw.normal(size=200)
    names = [f"feature_{i}" for i in range(20)]
    funnel = prescreen(build(x, y, names=names), 200, rounds=2, forest_trees=20, depth=6)
    assert set(funnel.stages["final"]) == set(names[:5])
    assert funnel.r2 > 0.98 and len(funnel.stages["lasso"]) <= 10
    scores = [h["kfold_score"] for h in funnel.history]
    assert scores == sorted(scores) and scores[-1] > 0.98


def test_presets():
    assert preset(20)["forest_top_n"] == 15 and not preset(99)["variance"]
    assert preset(100)["lasso_top_n"] == 20 and preset(5000)["max_features"] == 15
    assert preset(50000)["correlated_top_n"] == 5000 and preset(50000)["folds"] == 10


def test_prescreen_drops_flat_features_first(build):
    draw = np.random.default_rng(22)
    x = draw.normal(size=(80, 104))
    x[:, 50:] *= 0.01
    funnel = prescreen(build(x, x[:, 3] * 2), 80, rounds=1, forest_trees=10, depth=4,
                       correlated_top_n=102)
    assert len(funnel.stages["correlation"]) == 102 and len(funnel.stages["variance"]) <= 50
    assert funnel.stages["final"][0] == "s.f3"


def test_forest_tables(spark, planted):
    obs, x, y = planted
    rounds = trees.bootstrap_importance(obs, rounds=2, trees=10, depth=5).toPandas()
    assert len(rounds) == 12 and np.allclose(rounds.groupby("iteration")["importance"].sum(), 1)
    assert (rounds.groupby("iteration")["i_rank"].sum() == 21).all()
    wide = obs.df.select((F.col("y") > 0).cast("int").alias("Label"), *[
        F.col("features")[i].alias(n) for i, n in enumerate(obs.names)])
    model, table = trees.forest_importance(wide, trees=10, depth=5)
    assert table.orderBy(F.desc("value")).first()["param"] == "s.f1"
    assert len(model.stages) == 5
    share = trees.cumulative_share(table).orderBy("place").toPandas()["share"]
    assert share.is_monotonic_increasing and share.iloc[-1] == pytest.approx(1)
    same = table.select(F.col("param").alias("feature"), F.col("value").alias("importance"))
    row = trees.ranking_agreement(same, same, 3).first()
    assert (row["overlap"], row["spearman"]) == (3, pytest.approx(1))
    chunks = spark.createDataFrame([("a", 0.2, 10), ("a", 0.5, 30)], "feature string, importance double, n int")
    assert trees.merge_chunks(chunks).first()["importance"] == pytest.approx(0.425)


def test_partitions_can_be_added_and_listed(spark, database):
    table = f"{database}.forest"
    results.add_partition(spark, table, "20240101")
    row = spark.createDataFrame([("p", 0.5)], "param string, value double")
    results.append(results.forest_rows(row, "20240202-x"), table)
    assert {r[0] for r in results.list_partitions(spark, table).collect()} == {
        "dt=20240101", "dt=20240202"}


@pytest.mark.parametrize("n", [10, 12, 20, 30, 40])
def test_no_row_is_lost_between_folds(build, n):
    """Every fold counts, whichever sides its rows fell on."""
    from pyspark.sql import functions as F

    from yieldscope.operators.gram import grams
    from yieldscope.operators.split import hash_fold, in_test
    from yieldscope.plans.reports import FOLD_SEED, SPLIT_SEED, fold_tables, split_sides

    draw = np.random.default_rng(n)
    x = draw.normal(size=(n, 3))
    obs = build(x, x[:, 0])
    parts = grams(obs.df, hash_fold(5, FOLD_SEED + 42) * 2 + in_test(0.3, SPLIT_SEED).cast("int"))
    folds = fold_tables(parts, n, [0, 2])
    assert sum(g.n for g in folds.values()) == n
    train, held = split_sides(parts)
    assert train.n + held.n == n and min(train.n, held.n) > 0
    one_sided = {p: g for p, g in parts.items() if p % 2 == 0}
    train, held = split_sides(one_sided)
    assert train.n + held.n == sum(g.n for g in one_sided.values()) and held.n > 0


def test_a_measured_response_of_several_groups_is_no_class(spark, build, database):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(150, 3))
    report = clustering_report(build(x, x[:, 0] + draw.normal(size=150), groups=["A", "B"] * 75))
    assert report.code == "-5" and report.importance is None
    report.save(database, "20240109-many", spark)
    assert [r["result"] for r in spark.table(f"{database}.importance").where("jobid = '20240109-many'").collect()] == ["-5"]


def test_forests_keep_the_node_that_a_row_has_reached(spark, planted, monkeypatch):
    obs, _, _ = planted
    wide = obs.df.select((F.col("y") > 0).cast("int").alias("Label"), F.col("features")[1].alias("a.b"),
                         F.col("features")[2].alias("c.d"))
    model, _ = trees.forest_importance(wide, trees=3, depth=3)
    assert model.stages[3].getOrDefault("cacheNodeIds")
    made = []

    class Recorded(trees.RandomForestRegressor):
        def __init__(self, **options):
            made.append(options)
            super().__init__(**options)

    monkeypatch.setattr(trees, "RandomForestRegressor", Recorded)
    trees.bootstrap_importance(obs, rounds=1, trees=3, depth=3).count()
    assert made[0]["cacheNodeIds"]
