"""Registered queries: linear models, forests, components, clusters, logistic, reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from yieldscope.catalog import solvers, views as v
from yieldscope.catalog.preparing import DIMS, _database, embedded, r6
from yieldscope.catalog.registry import query
from yieldscope.operators import cluster, components, gram, linear, logistic, scale, split, trees
from yieldscope.operators.profile import quantiles
from yieldscope.plans import reports
from yieldscope.plans.prescreen import prescreen
from yieldscope.session import scratch_path
from yieldscope.sources import results
from yieldscope.sources.observations import Observations, load_matrix

FOLDS = 5


def _folded_grams(spark, sf):
    """Product sums per hash fold of z-scored features and centred target."""
    obs = v.scaled(spark, sf)
    return gram.grams(scale.standardize_column(obs.df, "y"), split.hash_fold(FOLDS)), obs.names


def _embedding_target(spark, sf):
    """64 embedding dimensions with a target planted on five of them."""
    e = v.table(spark, sf, "embeddings")
    x = F.col("embedding").cast("array<double>")
    target = 3 * x[0] - 2 * x[1] + 1.5 * x[2] + x[3] - x[4]
    return Observations(e.select(F.col("vec_id").alias("row_id"), F.lit(None).cast("timestamp").alias("ts"),
                                 F.lit(None).cast("string").alias("group_id"), target.alias("y"),
                                 x.alias("features")),
                        tuple(f"dim.e{i}" for i in range(64)))


# ---- linear --------------------------------------------------------------------

@query("m1_product_sums", f"""WITH {v.CLEAN_SQL},
f AS (SELECT row_id, idx, value, CAST(('0x' || substr(md5('0:' || row_id), 1, 8)) AS BIGINT) % 5 AS part FROM lng),
s AS (SELECT a.part, a.idx AS i, b.idx AS j, sum(a.value * b.value) AS s
  FROM f a JOIN f b ON a.row_id = b.row_id AND a.idx <= b.idx GROUP BY ALL)
SELECT s.part, s.i, s.j, round(s.s / sqrt(p.s * q.s), 6) AS s, round(ln(p.s), 6) AS size
FROM s JOIN s p ON p.part = s.part AND p.i = s.i AND p.j = s.i JOIN s q ON q.part = s.part AND q.i = s.j AND q.j = s.j""")
def m1(spark, sf):
    sums = gram.product_sums(v.cleaned(spark, sf).obs.df, F.col("features"), split.hash_fold(FOLDS))
    own = sums.where("i = j").select("part", F.col("i").alias("at"), F.col("s").alias("own"))
    left, right = own.toDF("part", "i", "p"), own.toDF("part", "j", "q")
    return sums.join(left, ["part", "i"]).join(right, ["part", "j"]).select(
        "part", "i", "j", F.round(F.col("s") / F.sqrt(F.col("p") * F.col("q")), 6).alias("s"),
        F.round(F.log("p"), 6).alias("size"))


@query("m4_lasso_grid", solvers.LASSO_GRID_SQL)
def m4(spark, sf):
    obs = v.scaled(spark, sf)
    df = scale.standardize_column(obs.df, "y")
    parts = gram.grams(df, split.in_test(0.3, 42).cast("int"))
    norms = np.sqrt(np.diag(gram.total(parts).xx))
    grid = linear.lasso_grid(parts[0].unit_columns(norms), parts[1].unit_columns(norms),
                             reports._alphas())
    table = spark.createDataFrame(
        [tuple(g.values()) for g in grid],
        "alpha double, train_score double, test_score double")
    return table.select("alpha", r6("train_score"), r6("test_score"))


@query("m5_lasso", f"""WITH RECURSIVE {v.SCALED_SQL},
t AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM known),
c AS MATERIALIZED (SELECT list(c ORDER BY idx) AS c, list(feature ORDER BY idx) AS names
  FROM (SELECT idx, feature, avg(value * (y - m) / s) AS c FROM z, t GROUP BY ALL)),
q AS MATERIALIZED (SELECT list(q ORDER BY i) AS q FROM (
  SELECT i, list(q ORDER BY j) AS q FROM (
    SELECT a.idx AS i, b.idx AS j, avg(a.value * b.value) AS q FROM z a JOIN z b USING (row_id) GROUP BY ALL) GROUP BY i)),
step AS (  -- proximal gradient steps; the trace bounds the largest eigenvalue
  SELECT 0 AS n, list_transform(c, lambda x: 0.0::DOUBLE) AS b FROM c
  UNION ALL
  SELECT n + 1, list_transform(list_transform(range(1, len(c) + 1), lambda j: b[j] + (c[j] - list_dot_product(q[j], b)) / len(c)),
    lambda u: sign(u) * greatest(abs(u) - 0.05 / len(c), 0)) FROM step, c, q WHERE n < 800)
SELECT feature, round(coef, 6) AS coef FROM (SELECT unnest(names) AS feature, unnest(b) AS coef FROM step, c WHERE n = 800)
WHERE coef <> 0""")
def m5(spark, sf):
    parts, names = _folded_grams(spark, sf)
    fit = linear.lasso(gram.total(parts), 0.05)
    return spark.createDataFrame([(n, float(c)) for n, c in zip(names, fit["coefs"]) if c != 0],
                                 "feature string, coef double").select("feature", r6("coef"))


@query("m5_lasso_single_feature", f"""WITH {v.SCALED_SQL},
t AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM known),
c AS (SELECT feature, avg(value * (y - m) / s) AS c, avg(value * value) AS q FROM z, t GROUP BY feature)
SELECT feature, round(sign(c) * greatest(abs(c) - 0.005, 0) / q, 6) + 0 AS coef FROM c""")
def m5_single(spark, sf):
    parts, names = _folded_grams(spark, sf)
    every = gram.total(parts)
    rows = [(n, float(linear.lasso(every.keep([i]), 0.005)["coefs"][0]))
            for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, coef double").select(
        "feature", (F.round("coef", 6) + 0.0).alias("coef"))


@query("m6_lasso_cv", solvers.LASSO_CV_SQL)
def m6(spark, sf):
    parts, names = _folded_grams(spark, sf)
    fit = linear.lasso_cv(parts, 10.0 ** np.linspace(-8, -1, 50))
    return spark.createDataFrame(
        [(n, fit["alpha"], float(c)) for n, c in zip(names, fit["coefs"])],
        "feature string, alpha double, coef double").select("feature", "alpha", r6("coef"))


SINGLE_SQL = f"""{v.SCALED_SQL},
t AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM known),
zz AS (SELECT feature, value, (y - m) / s AS y FROM z, t),
fit AS (SELECT feature, count(*) AS n, sum(value * y) / sum(value * value) AS w FROM zz GROUP BY feature),
res AS (SELECT feature, max(n) AS n, 1 - sum(pow(y - w * value, 2)) / sum(y * y) AS r2
  FROM zz JOIN fit USING (feature) GROUP BY feature)"""
SINGLE_SQL = SINGLE_SQL.replace("fit AS (SELECT feature, count", "one AS (SELECT feature, count").replace(
    "JOIN fit USING (feature)", "JOIN one USING (feature)")


@query("m7_least_squares_score", f"""WITH {SINGLE_SQL}
SELECT feature, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adjusted_r2 FROM res""")
def m7(spark, sf):
    parts, names = _folded_grams(spark, sf)
    every = gram.total(parts)
    rows = [(n, *map(float, linear.ols_score(every, [i]))) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, r2 double, adjusted_r2 double").select(
        "feature", r6("r2"), r6("adjusted_r2"))


@query("m8_step_forward_first", f"""WITH {SINGLE_SQL}
SELECT feature, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS score FROM res
ORDER BY r2 DESC, feature LIMIT 1""")
def m8_first(spark, sf):
    parts, names = _folded_grams(spark, sf)
    first = linear.step_forward(parts, names)[0]
    return spark.createDataFrame([(first["included"][0], first["score"])],
                                 "feature string, score double").select("feature", r6("score"))


def _history(spark, history, frame):
    return frame(spark, history).select(
        "step", "n_vars", F.concat_ws(",", "included").alias("included"), r6("score"),
        r6("kfold_score"))


@query("m8_step_forward", solvers.STEP_FORWARD_SQL)
def m8(spark, sf):
    parts, names = _folded_grams(spark, sf)
    return _history(spark, linear.step_forward(parts, names), linear.history_frame)


@query("m9_step_forward_cv", solvers.STEP_FORWARD_CV_SQL)
def m9(spark, sf):
    obs = _embedding_target(spark, sf)
    parts = gram.grams(scale.standardize_column(scale.standardize(obs).df, "y"),
                       split.hash_fold(FOLDS))
    return _history(spark, linear.step_forward_cv(parts, obs.names, 5), linear.history_frame)


# ---- forests -------------------------------------------------------------------

@query("m10_bootstrap_importance")
def m10(spark, sf):
    out = trees.bootstrap_importance(v.cleaned(spark, sf).obs, rounds=3, trees=20, depth=6)
    return out.select("iteration", "feature", r6("importance"), r6("std"), r6("s"), "s_rank",
                      "i_rank")


@query("m10_first_feature", f"""WITH {v.CLEAN_SQL}
SELECT feature FROM lng GROUP BY feature ORDER BY abs(corr(value, y)) DESC LIMIT 1""")
def m10_first(spark, sf):
    rounds = trees.bootstrap_importance(v.cleaned(spark, sf).obs, rounds=2, trees=20, depth=5)
    return trees.importance_statistics(rounds).filter(
        "standard_importance_rank = 1").select("feature")


def _shares(df, rows: int, **shares: float):
    """Exact quantiles of the target, without a group of all rows."""
    return quantiles(df.select(F.lit(0).alias("idx"), F.col("y").alias("value")), "idx", rows, shares)


def labelled(spark, sf):
    """Label first, then the features: above or below the median of the target."""
    obs = v.cleaned(spark, sf).obs
    middle = _shares(obs.df, v.cleaned(spark, sf).rows, half=0.5).first()["half"]
    return obs.df.select((F.col("y") > middle).cast("int").alias("Label"), *[
        F.col("features")[i].alias(n) for i, n in enumerate(obs.names)])


@query("m26_forest_importance")
def m26(spark, sf):
    _, table = trees.forest_importance(labelled(spark, sf), trees=50, depth=8)
    return table.select("param", r6("value"))


# ---- components ----------------------------------------------------------------

@query("m27_pca_scores", solvers.PCA_SQL)
def m27(spark, sf):
    scores, _ = components.pca_scores(embedded(spark, sf))
    return scores.select("id", F.round(F.abs("pc1"), 4).alias("pc1"),
                         F.round(F.abs("pc2"), 4).alias("pc2"))


@query("t10_explained_variance", solvers.EIGEN_SQL + """
SELECT component, round(ratio, 6) AS ratio FROM eigen""")
def t10(spark, sf):
    obs = v.cleaned(spark, sf).obs
    _, ratios = components.project(obs.df, F.col("features"), len(obs.names))
    return components.scree(spark, ratios).select("component", r6("ratio"))


@query("t11_component_count", solvers.EIGEN_SQL + """
SELECT coalesce(min(component), 4) AS n_components
FROM (SELECT component, sum(ratio) OVER (ORDER BY component) AS so_far FROM eigen) WHERE component >= 2 AND so_far > 0.8""")
def t11(spark, sf):
    obs = v.cleaned(spark, sf).obs
    _, ratios = components.project(obs.df, F.col("features"), len(obs.names))
    return components.component_count(components.scree(spark, ratios))


@query("t12_kernel_components")
def t12(spark, sf):
    points = v.user_days(spark, sf)
    scores, _ = components.kernel_scores(
        points, F.array(F.col("x0") / 10, (F.col("x1") - 4000) / 4000), 2, directions=100)
    return scores.select("row_id", F.round(F.abs(F.col("pc")[0]), 4).alias("pc1"))


@query("m30_reconstruction_error")
def m30(spark, sf):
    errors = components.reconstruction_error(
        embedded(spark, sf), F.array(*[F.col(f"_c{i}") for i in range(1, DIMS + 1)]), 2, keep=("_c0",))
    return errors.select(F.col("_c0").alias("id"), F.round("error", 4).alias("error"))


# ---- clusters ------------------------------------------------------------------

def points(spark, sf):
    return v.user_days(spark, sf).select("row_id", F.array("x0", "x1").alias("x"))


@query("m16_kmeans_sizes", f"""WITH {v.USER_DAYS_SQL}
SELECT count(*) AS n FROM user_days GROUP BY row_id // 100000 % 3""")
def m16(spark, sf):
    p = points(spark, sf).persist()
    fit = cluster.kmeans(p, 3, starts=5)
    sizes = cluster.assign(p, fit.centers).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("n")


@query("m16_kmeans_wide_sizes", f"""WITH {v.USER_DAYS_SQL}
SELECT count(*) AS n FROM user_days GROUP BY row_id // 100000 % 3""")
def m16_wide(spark, sf):
    model = cluster.kmeans_wide(points(spark, sf), 3, starts=2)
    return spark.createDataFrame([(int(n),) for n in model.summary.clusterSizes], "n bigint")


SILHOUETTE_SQL = v.USER_DAYS_SQL + """,
lab AS (SELECT row_id, x0, x1, row_id // 100000 % 3 AS c FROM user_days),
pair AS (SELECT a.row_id, a.c AS own, b.c, count(*) AS n, sum({d}) AS s FROM lab a, lab b GROUP BY ALL),
ab AS (SELECT row_id, max(CASE WHEN own = c THEN s / (n - 1) END) AS a,
  min(CASE WHEN own <> c THEN s / n END) AS b FROM pair GROUP BY row_id)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab"""
D2 = "pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2)"


def _by_user(spark, sf):
    return points(spark, sf).withColumn(
        "prediction", (F.floor(F.col("row_id") / 100000) % 3).cast("int"))


@query("m17_silhouette_squared", "WITH " + SILHOUETTE_SQL.format(d=D2))
def m17(spark, sf):
    return cluster.silhouette_squared(_by_user(spark, sf)).select(r6("silhouette"))


@query("m17_silhouette_euclidean", "WITH " + SILHOUETTE_SQL.format(d=f"sqrt({D2})"))
def m17_euclidean(spark, sf):
    labelled_points = _by_user(spark, sf).persist()
    return cluster.silhouette_euclidean(labelled_points, labelled_points.count()).select(
        r6("silhouette"))


@query("m18_best_k", f"""WITH {v.USER_DAYS_SQL}
SELECT CAST(count(DISTINCT row_id // 100000 % 3) AS INTEGER) AS k FROM user_days""")
def m18(spark, sf):
    p = points(spark, sf).persist()
    return cluster.best_k(cluster.search_k(p, p.count(), rounds=3, max_cluster=8))


@query("m18_best_k_euclidean", f"""WITH {v.USER_DAYS_SQL}
SELECT CAST(count(DISTINCT row_id // 100000 % 3) AS INTEGER) AS k FROM user_days""")
def m18_euclidean(spark, sf):
    p = points(spark, sf).persist()
    try:
        rows = p.count()
        found = cluster.search_k(p, rows, rounds=3, max_cluster=8, metric="euclidean").collect()
        # the bounds by the quadtree hold the exact value where the rows are few enough to have it
        fit = cluster.kmeans(p, 3, starts=3)
        (low, high), = cluster.silhouette_bounds(p, [fit])
        if rows <= cluster.EXACT_ROWS and not low - 1e-9 <= cluster.silhouettes(p, [fit], rows, "euclidean")[0] <= high + 1e-9:
            raise AssertionError("the bounds do not hold the silhouette")
        return cluster.best_k(spark.createDataFrame(found, "iteration int, k int, silhouette double"))
    finally:
        p.unpersist()


@query("m23_cluster_target")
def m23(spark, sf):
    obs = v.cleaned(spark, sf).obs
    df, _ = reports.cluster_target(
        obs, v.cleaned(spark, sf).rows, {"n_components": 2, "iterations": 1, "max_cluster": 6},
        metric="squared", starts=3)
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 4).alias("y"))


# ---- class targets -------------------------------------------------------------

CLASSES = 3


def classed(spark, sf):
    """Min-max features, with thirds of the target as class and stratified folds."""
    c = v.cleaned(spark, sf)
    cuts = _shares(c.obs.df, c.rows, low=1 / 3, high=2 / 3).first()
    label = F.when(F.col("y") > cuts["high"], 2).when(F.col("y") > cuts["low"], 1).otherwise(0)
    boxed = scale.min_max(c.obs, c.stats)
    df = boxed.df.withColumn("label", label)
    return boxed.with_df(split.stratified_fold(df, 5, c.rows))


@query("m20_logistic_scores", solvers.LOGISTIC_SQL)
def m20(spark, sf):
    obs = scale.unit_columns(classed(spark, sf))
    rows = v.cleaned(spark, sf).rows
    table = logistic.coefficient_table(spark, logistic.logistic(obs, rows, CLASSES),
                                       obs.names, exponent=True)
    return logistic.feature_scores(table, True, CLASSES).select(
        "feature", F.round(F.log("score"), 4).alias("log_score"), F.round(F.col("signed") / F.col("score"), 4).alias("signed_share"))


@query("m21_accuracy", f"""WITH {v.CLEAN_SQL}
SELECT round(avg(CASE WHEN (quantity > 25) = (y > 25) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM known""")
def m21(spark, sf):
    df = v.cleaned(spark, sf).obs.df.select(
        (F.col("features")[0] > 25).cast("int").alias("prediction"),
        (F.col("y") > 25).cast("int").alias("label"))
    return logistic.accuracy(df).select(r6("accuracy"))


@query("m30_class_metrics", f"""WITH {v.CLEAN_SQL},
c AS (SELECT CAST(floor(y / 40) AS INTEGER) AS label, CAST(floor(quantity / 40) AS INTEGER) AS prediction FROM known),
a AS (SELECT label, count(*) AS support, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS hits FROM c GROUP BY label),
b AS (SELECT prediction AS label, count(*) AS claimed FROM c GROUP BY prediction),
m AS (SELECT label, support, coalesce(hits / claimed, 0) AS p, hits / support AS r FROM a LEFT JOIN b USING (label))
SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")
def m30_metrics(spark, sf):
    df = v.cleaned(spark, sf).obs.df.select(
        F.floor(F.col("y") / 40).cast("int").alias("label"),
        F.floor(F.col("features")[0] / 40).cast("int").alias("prediction"))
    return logistic.class_metrics(df).select("label", "support", r6("precision"), r6("recall"),
                                             r6("f1"))


@query("m27_all_components", """WITH e AS (
  SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
z AS (SELECT vec_id, (x - avg(x) OVER (PARTITION BY dim)) / stddev_samp(x) OVER (PARTITION BY dim) AS z FROM e)
SELECT vec_id AS id, round(sum(z * z), 5) AS length2 FROM z GROUP BY vec_id""")
def m27_all(spark, sf):
    """All components together keep the length of every row."""
    scores, _ = components.pca_scores(embedded(spark, sf), k=DIMS)
    return scores.select("id", F.round(sum(F.col(f"pc{i}") * F.col(f"pc{i}") for i in range(1, DIMS + 1)), 5).alias("length2"))


@query("m30_reconstruction_full", "SELECT vec_id AS id, 0.0::DOUBLE AS error FROM embeddings")
def m30_full(spark, sf):
    """Nothing is lost with as many components as columns."""
    errors = components.reconstruction_error(
        embedded(spark, sf), F.array(*[F.col(f"_c{i}") for i in range(1, DIMS + 1)]), DIMS, keep=("_c0",))
    return errors.select(F.col("_c0").alias("id"), F.round("error", 4).alias("error"))


@query("m30_component_clusters")
def m30_clusters(spark, sf):
    scores, _ = components.pca_scores(embedded(spark, sf))
    p = scores.select(F.col("id").alias("row_id"), F.array("pc1", "pc2").alias("x")).persist()
    fit = cluster.kmeans(p, 3, starts=3)
    return cluster.assign(p, fit.centers).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("m22_step_forward_logistic")
def m22(spark, sf):
    history = logistic.step_forward_logistic(classed(spark, sf), "fold", CLASSES, tol=1e-3)
    return _history(spark, history, logistic.history_frame)


# ---- complete analyses ---------------------------------------------------------

@query("m15_prescreen")
def m15(spark, sf):
    obs = _embedding_target(spark, sf)
    obs = obs.with_df(obs.df.persist())
    funnel = prescreen(obs, obs.df.count(), rounds=2, forest_trees=20, depth=6,
                       forest_top_n=15, lasso_top_n=10, max_features=5, variance=False)
    rows = [(s, i, n) for s, names in funnel.stages.items() for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "stage string, place int, feature string")


LIGHT = dict(forest_trees=20, depth=6)


@query("m29_regression_report")
def m29_regression(spark, sf):
    report = reports.regression_report(v.observations(spark, sf), rounds=3, **LIGHT)
    return report.final.select("final", "suggestion", r6("abs_corr_final_suggestion"),
                               r6("abs_corr_target_suggestion"), r6("maximum_info_coeff"))


@query("m29_report_pairs", solvers.REPORT_PAIRS_SQL)
def m29_pairs(spark, sf):
    """The pairs of a report whose forest is deep enough to use every feature."""
    report = reports.regression_report(v.observations(spark, sf), rounds=2, forest_trees=40, depth=8, information="equi", parallel=1)
    if report.final.where("maximum_info_coeff is null or not maximum_info_coeff between 0 and 1").count():
        raise AssertionError("a pair has no information coefficient")
    return report.final.select("final", "suggestion", r6("abs_corr_final_suggestion"),
                               r6("abs_corr_target_suggestion"))


@query("m29_saved_coefficients", solvers.REPORT_COEFFICIENTS_SQL)
def m29_coefficients(spark, sf):
    """A report's coefficients through their table and back."""
    db, job = _database(spark), "20240107-report"
    reports.regression_report(v.observations(spark, sf), rounds=1, **LIGHT).save(db, job, spark)
    stored = results.read_results(spark, db, "coefficients", job, digits=9)
    return stored.select("variable", F.round(F.col("score").cast("double"), 5).alias("score"),
                         F.round(F.col("abs_score").cast("double"), 5).alias("abs_score"))


@query("m29_saved_importance", f"""WITH {v.RAW_SQL}
SELECT '0' AS result, split_part(feature, '.', 1) AS step_id, split_part(feature, '.', 2) AS xparam,
  '20240105-report' AS jobid, '20240105' AS dt FROM lng
GROUP BY feature HAVING var_samp(value) > 0""")
def m29_saved(spark, sf):
    """A report through its three tables and back: the importance table has every feature once."""
    db, job = _database(spark), "20240105-report"
    report = reports.regression_report(v.observations(spark, sf), rounds=1, **LIGHT)
    report.save(db, job, spark)
    for kind, rows in (("coefficients", report.coefficients), ("final_report", report.final)):
        if results.read_results(spark, db, kind, job).count() != rows.count():
            raise AssertionError(f"{kind} was not stored whole")
    return results.read_results(spark, db, "importance", job).select("result", "step_id", "xparam", "jobid", "dt")


@query("m26_saved_forest", f"""WITH {v.CLEAN_SQL}
SELECT DISTINCT '20240106-forest' AS job_id, feature AS param, '20240106' AS dt FROM lng""")
def m26_saved(spark, sf):
    """A fitted forest through the forest table and back; importances add up to 1."""
    db, job = _database(spark), "20240106-forest"
    _, importances = trees.forest_importance(labelled(spark, sf), trees=50, depth=8)
    results.append(results.forest_rows(importances, job), f"{db}.forest")
    stored = results.read_results(spark, db, "forest", job, digits=9)
    if abs(stored.agg(F.sum("value")).first()[0] - 1) > 1e-6:
        raise AssertionError("importances do not add up")
    return stored.select("job_id", "param", "dt")


@query("m27_saved_scores", """WITH e AS (
  SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
z AS (SELECT vec_id, (x - avg(x) OVER (PARTITION BY dim)) / stddev_samp(x) OVER (PARTITION BY dim) AS z FROM e)
SELECT vec_id AS id, round(sum(z * z), 5) AS length2 FROM z GROUP BY vec_id""")
def m27_saved(spark, sf):
    """From a matrix file without header to scores in a file with one, read back."""
    path = scratch_path(spark, "scores")
    embedded(spark, sf).write.csv(f"{path}/in")
    scores, _ = components.pca_scores(load_matrix(spark, f"{path}/in"), k=DIMS)
    results.write_single_csv(scores, f"{path}/out", single=False)
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/out")
    return back.select(F.col("id").cast("bigint").alias("id"),
                       F.round(sum(F.col(f"pc{i}") * F.col(f"pc{i}") for i in range(1, DIMS + 1)), 5).alias("length2"))


@query("m29_clustering_report")
def m29_clustering(spark, sf):
    obs = v.observations(spark, sf)
    one = obs.with_df(obs.df.withColumn("group_id", F.lit("all")))
    report = reports.clustering_report(one)     # whole: searches, starts and forests at their defaults
    return report.final.select("final", "suggestion", r6("abs_corr_final_suggestion"),
                               r6("abs_corr_target_suggestion"), r6("maximum_info_coeff"))


def _grouped(spark, sf):
    """Observations of several groups whose response is one of three classes."""
    obs = v.observations(spark, sf)
    level = F.when(F.col("y") > 40, 2.0).when(F.col("y") > 0, 1.0).when(F.col("y").isNotNull(), 0.0)
    return obs.with_df(obs.df.withColumn("y", level))


@query("m29_clustering_groups", f"""WITH {v.WIDE_SQL},
known AS (SELECT * REPLACE (coalesce(acctbal, avg(acctbal) OVER ()) AS acctbal, CASE WHEN y > 40 THEN 2.0 WHEN y > 0 THEN 1.0 ELSE 0.0 END AS y)
  FROM wide WHERE y IS NOT NULL),
lng AS ({v.long_sql("known", v.VARYING)}),
rx AS (SELECT row_id, feature, rank() OVER (PARTITION BY idx ORDER BY value) + (count(*) OVER (PARTITION BY idx, value) - 1) / 2.0 AS r FROM lng),
ry AS (SELECT row_id, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS r FROM known),
tgt AS (SELECT feature AS suggestion, abs(corr(rx.r, ry.r)) AS ts FROM rx JOIN ry USING (row_id) GROUP BY feature)
SELECT '0' AS result, suggestion, round(ts, 4) AS abs_corr_target_suggestion, '20240108-groups' AS jobid, '20240108' AS dt
FROM tgt WHERE ts > (SELECT median(ts) FROM tgt)""")
def m29_groups(spark, sf):
    """The report of several groups through its three tables and back: suggestions and their correlation."""
    db, job = _database(spark), "20240108-groups"
    report = reports.clustering_report(_grouped(spark, sf), forest_trees=20, depth=6, information="equi")
    report.save(db, job, spark)
    for kind, rows in (("importance", report.importance), ("coefficients", report.coefficients)):
        if results.read_results(spark, db, kind, job).count() != rows.count():
            raise AssertionError(f"{kind} was not stored whole")
    return results.read_results(spark, db, "final_report", job).select(
        "result", "suggestion", "abs_corr_target_suggestion", "jobid", "dt")
