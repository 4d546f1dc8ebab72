"""Registered queries: statistics, ranking, correlation and information."""

from __future__ import annotations

from pyspark.sql import functions as F

from yieldscope.catalog import views as v
from yieldscope.catalog.preparing import EQUI_ALPHA, RHO_SQL, _equi_sql, r6, rho
from yieldscope.catalog.registry import query
from yieldscope.functions import scalars as fn
from yieldscope.functions import size_rules
from yieldscope.operators import cluster, correlate, profile, ranks, split, trees
from yieldscope.operators.mic import mic, mic_equi
from yieldscope.session import settled

QUARTILES = "quantile_cont({0}, 0.25) AS q25, quantile_cont({0}, 0.5) AS q50, quantile_cont({0}, 0.75) AS q75"


def _rounded(df, *columns, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


# ---- aggregations --------------------------------------------------------------

@query("a1_describe", f"""WITH {v.RAW_SQL}, s AS (SELECT feature, count(value) AS count, avg(value) AS mean,
  stddev_samp(value) AS std, min(value) AS min, {QUARTILES.format("value")}, max(value) AS max
FROM lng GROUP BY feature)
SELECT feature, count, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 6) AS min,
  round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, round(max, 6) AS max FROM s""")
def a1(spark, sf):
    from yieldscope.operators.prepare import drop_null_response
    obs = drop_null_response(v.observations(spark, sf))
    rows = v.cleaned(spark, sf).rows
    stats = _rounded(profile.describe(obs, rows), "mean", "std")
    return _rounded(stats, "min", "q25", "q50", "q75", "max", digits=6)


ROUNDS_SQL = v.CLEAN_SQL + """,
rounds AS (""" + " UNION ALL ".join(
    f"""SELECT {i} AS iteration, feature, avg(value) AS importance FROM lng
WHERE NOT substr(md5('{40 + i}:' || row_id), 1, 8) < '{int(0.3 * 2**32):08x}' GROUP BY feature"""
    for i in range(4)) + ")"


def _rounds(spark, sf):
    """Feature means of four random training shares, laid under each other."""
    obs = v.cleaned(spark, sf).obs
    out = None
    for i in range(4):
        train, _ = split.split(obs.df, 0.3, 40 + i)
        part = (obs.with_df(train).long().groupBy("idx").agg(F.avg("value").alias("importance"))
                .withColumn("iteration", F.lit(i)))
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(obs.dictionary()), "idx").select(
        "iteration", "feature", "importance")


@query("a2_j4_importance_statistics", f"""WITH {ROUNDS_SQL}, s AS (SELECT feature, count(*) AS count,
  avg(importance) AS mean, stddev_samp(importance) AS std, min(importance) AS min,
  {QUARTILES.format("importance")}, max(importance) AS max FROM rounds GROUP BY feature)
SELECT feature, count, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min,
  round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, round(max, 4) AS max,
  CAST(rank() OVER (ORDER BY mean DESC) AS DOUBLE) AS standard_importance_rank FROM s""")
def a2(spark, sf):
    return _rounded(trees.importance_statistics(_rounds(spark, sf)),
                    "mean", "std", "min", "q25", "q50", "q75", "max")


@query("a3_dataset_shape", f"""WITH {v.WIDE_SQL}
SELECT true AS has_group, count(DISTINCT group_id) AS group_size,
  round(15 / count(*), 8) AS ratio FROM wide""")
def a3(spark, sf):
    return _rounded(profile.dataset_shape(v.wide(spark, sf)), "ratio", digits=8)


@query("a4_single_group", """SELECT count(DISTINCT o_orderstatus) <= 1 AS single FROM orders""")
def a4(spark, sf):
    single = profile.single_group(v.cleaned(spark, sf).obs)
    return spark.createDataFrame([(single,)], "single boolean")


@query("a5_target_variance", f"""WITH {v.WIDE_SQL}
SELECT group_id, round(stddev_samp(y), 6) AS std, stddev_samp(y) = 0 AS constant
FROM wide GROUP BY group_id""")
def a5(spark, sf):
    return v.observations(spark, sf).df.groupBy("group_id").agg(
        F.round(F.stddev_samp("y"), 6).alias("std"), (F.stddev_samp("y") == 0).alias("constant"))


SCORES_SQL = """scores AS (SELECT CAST(ts AS DATE) AS iteration, extract('hour' FROM ts) + 3 AS k,
  sum(CAST(round(value * 100) AS BIGINT)) / count(*) AS silhouette FROM events GROUP BY 1, 2)"""


def _scores(spark, sf):
    return v.table(spark, sf, "events").groupBy(
        F.to_date("ts").alias("iteration"), (F.hour("ts") + 3).alias("k")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")) / F.count(F.lit(1)))
        .alias("silhouette"))


@query("a6_median_of_best", f"""WITH {SCORES_SQL}
SELECT CAST(round_even(median(k), 0) AS INTEGER) AS k FROM
(SELECT k FROM scores QUALIFY row_number() OVER (PARTITION BY iteration ORDER BY silhouette DESC, k) = 1)""")
def a6(spark, sf):
    return cluster.best_k(_scores(spark, sf))


R2_SQL = v.SCALED_SQL + """,
mid AS (SELECT avg(y) AS ym, stddev_pop(y) AS ys FROM known),
r AS (SELECT feature, count(*) AS n, pow(corr(value, y), 2) AS r2 FROM z GROUP BY feature)"""


@query("a7_adjusted_r2", f"""WITH {R2_SQL}
SELECT feature, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adjusted_r2 FROM r""")
def a7(spark, sf):
    obs = v.cleaned(spark, sf).obs
    fit = obs.long("y").groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"), F.pow(F.corr("value", "y"), 2).alias("r2"))
    return fit.join(F.broadcast(obs.dictionary()), "idx").select(
        "feature", r6(fn.adjusted_r2(F.col("r2"), F.col("n"), F.lit(1)), "adjusted_r2"))


FOLDED_SQL = v.CLEAN_SQL + """,
placed AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n FROM known),
folded AS (SELECT row_id, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
  ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM placed)"""


@query("a8_mean_fold_score", f"""WITH {FOLDED_SQL}
SELECT feature, round(avg(r2), 6) AS score FROM (
  SELECT feature, fold, regr_r2(y, value) AS r2 FROM lng JOIN folded USING (row_id) GROUP BY ALL) GROUP BY feature""")
def a8(spark, sf):
    c = v.cleaned(spark, sf)
    folded = split.contiguous_fold(c.obs.df, 5, c.rows)
    each = folded.select("fold", "y", F.posexplode("features").alias("idx", "value"))
    scores = each.groupBy("idx", "fold").agg(F.regr_r2("y", "value").alias("r2"))
    return (scores.groupBy("idx").agg(F.round(F.avg("r2"), 6).alias("score"))
            .join(F.broadcast(c.obs.dictionary()), "idx").select("feature", "score"))


@query("a9_weighted_chunks", f"""WITH {v.CLEAN_SQL},
chunk AS (SELECT group_id, feature, count(*) AS n, abs(corr(value, lng.y)) AS importance
  FROM lng JOIN wide USING (row_id) GROUP BY ALL)
SELECT feature, round(sum(importance * n) / sum(n), 6) AS importance FROM chunk GROUP BY feature""")
def a9(spark, sf):
    obs = v.cleaned(spark, sf).obs
    chunks = (obs.long("group_id", "y").groupBy("group_id", "idx")
              .agg(F.count(F.lit(1)).alias("n"), F.abs(F.corr("value", "y")).alias("importance"))
              .join(F.broadcast(obs.dictionary()), "idx"))
    return trees.merge_chunks(chunks).select("feature", r6("importance"))


@query("a10_pearson_matrix", f"""WITH {v.CLEAN_SQL}
SELECT a.feature AS a, b.feature AS b, round(corr(a.value, b.value), 6) + 0 AS r
FROM lng a JOIN lng b USING (row_id) GROUP BY ALL""")
def a10(spark, sf):
    pairs = correlate.pearson(v.cleaned(spark, sf).obs)
    return pairs.select("a", "b", (F.round("r", 6) + 0.0).alias("r"))


@query("a11_cumulative_share", """WITH s AS (SELECT p_brand AS param, round(sum(l_quantity), 2) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
SELECT param, value, row_number() OVER w AS place,
  round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING) / sum(value) OVER (), 8) AS share
FROM s WINDOW w AS (ORDER BY value DESC, param)""")
def a11(spark, sf):
    brands = (v.table(spark, sf, "lineitem")
              .join(v.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
              .groupBy(F.col("p_brand").alias("param"))
              .agg(F.round(F.sum("l_quantity"), 2).alias("value")))
    return _rounded(trees.cumulative_share(brands), "share", digits=8)


LINEAR_SQL = RHO_SQL + """,
lin AS (SELECT feature, corr(value, y) AS r FROM lng GROUP BY feature)"""


@query("a12_ranking_agreement", f"""WITH {LINEAR_SQL},
both_ AS (SELECT feature, rank() OVER (ORDER BY abs(r)) AS a, rank() OVER (ORDER BY abs(rho)) AS b
  FROM lin JOIN rho USING (feature))
SELECT (SELECT count(*) FROM both_ WHERE a > 6 AND b > 6) AS overlap,
  round(corr(a, b), 6) AS spearman FROM both_""")
def a12(spark, sf):
    c = v.cleaned(spark, sf)
    linear = settled(correlate.strongest(c.obs, c.rows, method="pearson"))
    monotone = settled(correlate.strongest(c.obs, c.rows))
    agreement = trees.ranking_agreement(linear.withColumnRenamed("score", "importance"),
                                        monotone.withColumnRenamed("score", "importance"), 3)
    return agreement.select("overlap", r6("spearman"))


# ---- ranking -------------------------------------------------------------------

@query("w1_average_rank", """SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size)
  + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank FROM part""")
def w1(spark, sf):
    parts = v.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return ranks.average_ranks(parts, "p_size", by=["p_brand"]).drop("p_size")


@query("w2_average_rank_descending", """WITH s AS (SELECT c_mktsegment, c_nationkey, count(*) AS n
  FROM customer GROUP BY ALL)
SELECT c_mktsegment, c_nationkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY n DESC)
  + (count(*) OVER (PARTITION BY c_mktsegment, n) - 1) / 2.0 AS rank FROM s""")
def w2(spark, sf):
    n = v.table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.count(F.lit(1)).alias("n"))
    return ranks.ranked(n, "n", by=["c_mktsegment"], descending=True).drop("n")


@query("w3_w4_top_by_mean", f"""WITH {ROUNDS_SQL}, s AS (
  SELECT feature, avg(importance) AS mean FROM rounds GROUP BY feature)
SELECT feature, round(mean, 4) AS mean FROM s WHERE mean > 0 ORDER BY mean DESC, feature LIMIT 4""")
def w4(spark, sf):
    top = trees.top_features(trees.importance_statistics(_rounds(spark, sf)), 4)
    return top.select("feature", F.round("mean", 4).alias("mean"))


@query("w5_top_by_absolute_value", f"""WITH {LINEAR_SQL}
SELECT feature, round(abs(r), 6) AS score FROM lin ORDER BY abs(r) DESC, feature LIMIT 5""")
def w5(spark, sf):
    c = v.cleaned(spark, sf)
    return correlate.strongest(c.obs, c.rows, 5, "pearson").select("feature", r6("score"))


@query("w6_first_per_group", f"""WITH {v.RANK_SQL}
SELECT suggestion, final, round(score, 6) AS score FROM (
  SELECT b.feature AS suggestion, a.feature AS final, abs(corr(a.r, b.r)) AS score
  FROM rx a JOIN rx b USING (row_id) WHERE a.feature <> b.feature GROUP BY b.feature, a.feature)
QUALIFY row_number() OVER (PARTITION BY suggestion ORDER BY score DESC, final) = 1""")
def w6(spark, sf):
    c = v.cleaned(spark, sf)
    pairs = correlate.spearman(c.obs, c.rows).filter("a <> b AND a <> 'target' AND b <> 'target'")
    score = F.abs("r")
    # of equal scores the first name wins
    best = F.min(F.struct((-score).alias("low"), "a", score.alias("score")))
    return pairs.groupBy(F.col("b").alias("suggestion")).agg(best.alias("t")).select(
        "suggestion", F.col("t.a").alias("final"), r6(F.col("t.score"), "score"))


@query("w7_w8_first_maximum", f"""WITH {SCORES_SQL}
SELECT iteration, k FROM scores
QUALIFY row_number() OVER (PARTITION BY iteration ORDER BY silhouette DESC, k) = 1""")
def w7(spark, sf):
    return _scores(spark, sf).groupBy("iteration").agg(
        F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))


# ---- scalar functions ----------------------------------------------------------

@query("f1_f2_f4_f5_f6_f10_scalars", """SELECT s_suppkey, abs(s_acctbal) AS absolute,
  round(sign(s_acctbal) * exp(s_acctbal / 10000), 6) AS signed,
  round(s_acctbal / nullif(s_nationkey, 0), 6) AS scaled,
  round((s_acctbal + s_nationkey) / 2, 6) AS pair_mean,
  s_acctbal / nullif(s_nationkey, 0) IS NULL AS missing, round(s_acctbal / 7, 4) AS report
FROM supplier""")
def f1(spark, sf):
    acct, nation = F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    return v.table(spark, sf, "supplier").select(
        "s_suppkey", F.abs(acct).alias("absolute"),
        r6(F.signum(acct) * F.exp(acct / 10000), "signed"),
        r6(fn.scaled_importance(acct, nation), "scaled"),
        r6(fn.pair_mean(acct, nation), "pair_mean"),
        fn.is_missing(fn.scaled_importance(acct, nation)).alias("missing"),
        fn.report_round(acct / 7).alias("report"))


@query("f2_signed_exponential", """SELECT l_discount, count(*) AS n,
  round(sign(l_discount - 0.05) * exp(l_discount - 0.05), 6) AS value FROM lineitem GROUP BY l_discount""")
def f2(spark, sf):
    shifted = F.col("l_discount") - 0.05
    return v.table(spark, sf, "lineitem").groupBy("l_discount").agg(
        F.count(F.lit(1)).alias("n")).select(
        "l_discount", "n", r6(fn.signed_exp(shifted), "value"))


@query("f3_log_grid", """WITH g AS (SELECT c_custkey % 100 AS id, sum(c_acctbal) AS total FROM customer GROUP BY 1)
SELECT id, round(log10(pow(CAST(10 AS DOUBLE), -10 + id * CAST(7 AS DOUBLE) / 99)), 6) AS exponent,
  round(total, 2) AS total FROM g""")
def f3(spark, sf):
    totals = v.table(spark, sf, "customer").groupBy((F.col("c_custkey") % 100).alias("id")).agg(
        F.sum("c_acctbal").alias("total"))
    return totals.join(F.broadcast(fn.log_grid(spark, -10, -3, 100)), "id").select(
        "id", r6(F.log10("alpha"), "exponent"), F.round("total", 2).alias("total"))


@query("f7_silhouette_bands", """WITH s AS (SELECT CAST(l_linenumber AS DOUBLE) / 8 - l_tax AS s FROM lineitem)
SELECT CASE WHEN s > 0.7 THEN 'strong' WHEN s > 0.5 THEN 'reasonable' WHEN s > 0.25 THEN 'weak'
  WHEN s > 0 THEN 'overlapping' ELSE 'wrong' END AS band, count(*) AS n FROM s GROUP BY 1""")
def f7(spark, sf):
    score = F.col("l_linenumber").cast("double") / 8 - F.col("l_tax")
    return v.table(spark, sf, "lineitem").groupBy(fn.silhouette_band(score).alias("band")).agg(
        F.count(F.lit(1)).alias("n"))


@query("f8_accuracy_loss", """WITH s AS (SELECT l_suppkey, avg(l_quantity) AS a, avg(l_quantity + l_linenumber - 4) AS b
  FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, round((a - b) / a * 100, 6) AS loss, CASE WHEN (a - b) / a * 100 < 2 THEN 'acceptable'
  WHEN (a - b) / a * 100 < 5 THEN 'caution' ELSE 'not advised' END AS verdict FROM s""")
def f8(spark, sf):
    pairs = v.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("a"), F.avg(F.col("l_quantity") + F.col("l_linenumber") - 4)
        .alias("b"))
    loss = fn.accuracy_loss(F.col("a"), F.col("b"))
    return pairs.select("l_suppkey", r6(loss, "loss"), fn.loss_verdict(loss).alias("verdict"))


# ---- correlation and information -----------------------------------------------

@query("m11_target_spearman", f"""WITH {RHO_SQL}
SELECT feature, round(rho, 6) AS rho FROM rho""")
def m11(spark, sf):
    return rho(spark, sf).select("feature", r6("rho"))


@query("m11_spearman_pairs", f"""WITH {v.RANK_SQL}, every AS (SELECT * FROM rx UNION ALL SELECT row_id, 'target', r FROM ry)
SELECT a.feature AS a, b.feature AS b, round(corr(a.r, b.r), 6) + 0 AS r
FROM every a JOIN every b USING (row_id) GROUP BY ALL""")
def m11_pairs(spark, sf):
    c = v.cleaned(spark, sf)
    return correlate.spearman(c.obs, c.rows).select("a", "b", (F.round("r", 6) + 0.0).alias("r"))


@query("m12_spearman_statistic", f"""WITH {RHO_SQL}, n AS (SELECT count(*) AS n FROM known)
SELECT feature, round(rho * sqrt((n - 2) / (1 - rho * rho)), 5) AS t, CAST(n - 2 AS DOUBLE) AS dof
FROM rho, n""")
def m12(spark, sf):
    return correlate.with_p_value(rho(spark, sf)).select("feature", F.round("t", 5).alias("t"), "dof")


@query("m12_spearman_p_values", f"""WITH {RHO_SQL}, n AS (SELECT count(*) AS n FROM known),
t AS (SELECT feature, rho, abs(rho * sqrt((n - 2) / (1 - rho * rho))) AS t, CAST(n - 2 AS DOUBLE) AS d FROM rho, n),
steps AS (SELECT *, unnest(range(0, 4001)) AS i FROM t),
density AS (SELECT feature, rho, t, exp(lgamma((d + 1) / 2) - lgamma(d / 2)) / sqrt(pi() * d)
    * pow(1 + pow(t * i / 4000, 2) / d, -(d + 1) / 2) * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS f FROM steps)
SELECT feature, round(rho, 6) AS rho, round(greatest(1 - 2 * sum(f) * t / 12000, 0), 6) + 0 AS p_value
FROM density GROUP BY feature, rho, t""")
def m12_p(spark, sf):
    return correlate.with_p_value(rho(spark, sf)).select("feature", r6("rho"), r6("p_value"))


@query("m13_mic_equi", f"""WITH {v.RANK_SQL}, features AS (SELECT DISTINCT feature FROM lng),{_equi_sql()}
SELECT feature, round(mic, 6) AS mic FROM equi""")
def m13_equi(spark, sf):
    c = v.cleaned(spark, sf)
    return mic_equi(c.obs, c.rows, EQUI_ALPHA).select("feature", r6("mic"))


@query("m13_mic")
def m13(spark, sf):
    c = v.cleaned(spark, sf)
    return mic(c.obs, c.rows).select("feature", r6("mic"), "grid")


@query("m14_strongest_features", f"""WITH {RHO_SQL}
SELECT feature, round(abs(rho), 6) AS score FROM rho ORDER BY abs(rho) DESC, feature LIMIT 5""")
def m14(spark, sf):
    c = v.cleaned(spark, sf)
    return correlate.strongest(c.obs, c.rows, 5).select("feature", r6("score"))


# ---- splits and size rules -----------------------------------------------------

@query("m2_split", f"""WITH {v.WIDE_SQL}
SELECT row_id, substr(md5('42:' || row_id), 1, 8) < '{int(0.3 * 2**32):08x}' AS test
FROM wide WHERE y IS NOT NULL""")
def m2(spark, sf):
    train, test = split.split(v.cleaned(spark, sf).obs.df, 0.3, 42)
    return train.select("row_id", F.lit(False).alias("test")).unionByName(
        test.select("row_id", F.lit(True).alias("test")))


@query("m3_contiguous_folds", f"WITH {FOLDED_SQL} SELECT row_id, fold FROM folded")
def m3(spark, sf):
    c = v.cleaned(spark, sf)
    return split.contiguous_fold(c.obs.df.select("row_id"), 5, c.rows)


@query("m3_stratified_folds", """WITH c AS (SELECT o_orderpriority, o_orderkey,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i,
    count(*) OVER (PARTITION BY o_orderpriority) AS size,
    min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS first FROM orders),
laid AS (SELECT *, row_number() OVER (ORDER BY first, o_orderkey) - 1 AS p FROM c),
share AS (SELECT o_orderpriority, p % 5 AS fold, count(*) AS m FROM laid GROUP BY ALL),
ends AS (SELECT o_orderpriority, fold, sum(m) OVER (PARTITION BY o_orderpriority ORDER BY fold) AS e FROM share)
SELECT o_orderkey, (SELECT count(*) FROM ends WHERE ends.o_orderpriority = c.o_orderpriority AND e <= i) AS fold
FROM c""")
def m3_stratified(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.stratified_fold(orders, 5, orders.count(), "o_orderpriority", "o_orderkey").select(
        "o_orderkey", "fold")


SIZES_SQL = """sizes AS (SELECT p_brand, sum(m) AS n, count(DISTINCT l_suppkey) AS p FROM (
  SELECT p_brand, l_suppkey, count(*) AS m FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY ALL) GROUP BY p_brand UNION ALL
  SELECT 'customer ' || o_custkey, count(*) * 12, count(DISTINCT o_orderpriority) * 20 FROM orders GROUP BY o_custkey)"""


def _sizes(spark, sf):
    lines = v.table(spark, sf, "lineitem").join(
        v.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    brands = lines.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"),
                                          F.count_distinct("l_suppkey").alias("p"))
    customers = v.table(spark, sf, "orders").groupBy(
        F.concat(F.lit("customer "), F.col("o_custkey")).alias("p_brand")).agg(
        (F.count(F.lit(1)) * 12).alias("n"), (F.count_distinct("o_orderpriority") * 20).alias("p"))
    return brands.unionByName(customers)


@query("m24_size_parameters", f"""WITH {SIZES_SQL}
SELECT p_brand, greatest(1, CASE WHEN n < 100 THEN 2 WHEN n < 1000 THEN least(5, p)
    WHEN n < 10000 THEN least(10, p // 10) ELSE least(20, p // 20) END) AS n_components,
  CASE WHEN n < 100 THEN least(10, n // 2) WHEN n < 500 THEN least(20, n // 10)
    WHEN n < 2000 THEN least(30, n // 20) ELSE 30 END AS max_cluster,
  CASE WHEN n >= 100 AND n < 500 THEN 10 ELSE 5 END AS iterations,
  CASE WHEN n < 100 THEN 20 WHEN n < 500 THEN 10 WHEN n < 5000 THEN 5 ELSE 3 END AS rf_iterations,
  CASE WHEN n < 1000 THEN 100 WHEN n < 5000 THEN 150 ELSE 200 END AS rf_top_n,
  CASE WHEN n < 1000 THEN NULL WHEN n < 5000 THEN 75 ELSE 100 END AS post_logistic_top_n,
  CASE WHEN n < 50 THEN 3 WHEN n < 200 THEN 5 WHEN n < 1000 THEN 10 ELSE 5 END AS k,
  CASE WHEN n < 200 THEN 0.0001 WHEN n < 1000 THEN 0.0005 ELSE 0.001 END AS tol FROM sizes""")
def m24(spark, sf):
    return _sizes(spark, sf).select("p_brand", *size_rules.size_parameters(F.col("n"), F.col("p")))


@query("m19_m25_search_rules", f"""WITH {SIZES_SQL}
SELECT p_brand, CASE WHEN p < 80 THEN greatest(3, p - 2) ELSE 3 END AS low,
  CASE WHEN p < 80 THEN p + 3 ELSE least(30, CAST(floor(sqrt(n // 2)) AS INTEGER)) END AS high,
  CASE WHEN n < 60 THEN 5 WHEN n < 180 THEN 10 ELSE 20 END AS rounds,
  CAST(floor(1000 * greatest(1, p / 100)) AS INTEGER) AS max_iter,
  CASE WHEN n < 100 THEN 0.001 WHEN n > 1000 THEN 0.0001 ELSE 0.0005 END AS tol FROM sizes""")
def m19(spark, sf):
    n, p = F.col("n"), F.col("p")
    low, high = size_rules.cluster_range(n, F.when(p < 80, p))
    variability = F.when(n < 60, "low").when(n < 180, "medium").otherwise("high")
    limit, tol = size_rules.logistic_limits(n, p)
    return _sizes(spark, sf).select(
        "p_brand", low.alias("low"), high.alias("high"),
        size_rules.cluster_search_rounds(variability).alias("rounds"), limit.alias("max_iter"),
        tol.alias("tol"))
