"""Registered queries: sources, sinks, preparation, joins and scaling."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import (
    IndexToString, StandardScaler, StringIndexer, VectorAssembler, VectorIndexer)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from yieldscope.catalog import views as v
from yieldscope.catalog.registry import query
from yieldscope.functions import scalars as fn
from yieldscope.operators import prepare, scale
from yieldscope.operators.correlate import target_spearman
from yieldscope.operators.profile import moments
from yieldscope.plans.driver_report import driver_report, feature_pairs
from yieldscope.session import scratch_path, settled
from yieldscope.sources import results
from yieldscope.sources.observations import (
    CLUSTERING_EXCLUDED, col, input_path, load_matrix, load_observations, numeric_columns, preview)

DIMS = 64


def r6(c, name=None):
    value = F.col(c) if isinstance(c, str) else c
    return F.round(value, 6).alias(name or c)


def embedded(spark, sf):
    """``_c0`` id and all embedding dimensions as ``_c1 … _c64``."""
    return v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("_c0"),
        *[F.col("embedding")[i].cast("double").alias(f"_c{i + 1}") for i in range(DIMS)])


def _database(spark) -> str:
    name = "d" + uuid.uuid4().hex[:12]
    results.create_tables(spark, name, scratch_path(spark, name))
    return name


def _means(spark, sf):
    """``(feature, mean, std)`` of the cleaned features."""
    c = v.cleaned(spark, sf)
    return moments(c.obs).join(F.broadcast(c.obs.dictionary()), "idx")


# ---- sources and sinks ---------------------------------------------------------

@query("s1_load_observations", f"""WITH {v.WIDE_SQL}
SELECT row_id, group_id, round(sqrt(abs(y)), 6) AS y_root, round(quantity, 6) AS quantity,
  round(acctbal, 6) AS acctbal, lines FROM wide""")
def s1(spark, sf):
    path = scratch_path(spark, "observations")
    v.wide(spark, sf).write.option("header", True).csv(path)
    read = load_observations(spark, path)
    return read.select("row_id", F.col("GROUP_ID").alias("group_id"),
                       r6(F.sqrt(F.abs("y")), "y_root"), r6(col("step1.quantity"), "quantity"), r6(col("step3.acctbal"), "acctbal"),
                       col("step4.lines").alias("lines"))


@query("s2_load_matrix", f"""SELECT CAST(vec_id AS BIGINT) AS id, {", ".join(
    f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS c{i + 1}" for i in range(DIMS))}
FROM embeddings""")
def s2(spark, sf):
    path = scratch_path(spark, "matrix")
    embedded(spark, sf).write.csv(path)
    read = load_matrix(spark, path)
    return read.select(F.col("_c0").cast("bigint").alias("id"),
                       *[r6(f"_c{i + 1}", f"c{i + 1}") for i in range(DIMS)])


@query("s3_input_path", """SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1""")
def s3(spark, sf):
    path = input_path(f"{sf}/absent", "orders.parquet", fallback=sf, spark=spark)
    return load_observations(spark, path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"))


@query("s4_importance_sink", f"""WITH {v.CLEAN_SQL}
SELECT '0' AS result, split_part(feature, '.', 2) AS xparam, split_part(feature, '.', 1) AS step_id,
  round(avg(value), 4) AS importance_value, '20240101-means' AS jobid, '20240101' AS dt
FROM lng GROUP BY feature""")
def s4(spark, sf):
    db, job = _database(spark), "20240101-means"
    results.append(results.importance_rows(_means(spark, sf), "0", job), f"{db}.importance")
    return results.read_results(spark, db, "importance", job)


@query("s5_coefficient_sink", f"""WITH {v.CLEAN_SQL}
SELECT '0' AS result, feature AS variable, round(-avg(value), 4) AS score,
  round(abs(avg(value)), 4) AS abs_score, '20240102-coefs' AS jobid, '20240102' AS dt
FROM lng GROUP BY feature""")
def s5(spark, sf):
    db, job = _database(spark), "20240102-coefs"
    rows = _means(spark, sf).select("feature", (-F.col("mean")).alias("score"),
                                    F.abs("mean").alias("abs_score"))
    results.append(results.coefficient_rows(rows, "0", job), f"{db}.coefficients")
    return results.read_results(spark, db, "coefficients", job)


FINALS = ("step1.quantity", "step2.size")
EQUI_ALPHA = 0.6


def _equi_sql(features: str = "features") -> str:
    """Equal-frequency information of each listed feature with the target."""
    return f"""
size AS (SELECT count(*) AS n, floor(pow(count(*), {EQUI_ALPHA})) AS b FROM known),
axis AS (SELECT unnest(range(2, 2000)) AS g),
grid AS (SELECT x.g AS gx, y.g AS gy FROM axis x, axis y, size
  WHERE x.g <= b / 2 AND y.g <= b / 2 AND x.g * y.g <= b),
spot AS (SELECT row_id, feature, CAST(2 * rx.r - 1 AS BIGINT) AS sx, CAST(2 * ry.r - 1 AS BIGINT) AS sy
  FROM rx JOIN ry USING (row_id) JOIN {features} USING (feature)),
cell AS (SELECT feature, gx, gy, sx * gx // (2 * n) AS bx, sy * gy // (2 * n) AS by_, count(*) AS m
  FROM spot, grid, size GROUP BY ALL),
hj AS (SELECT feature, gx, gy, sum(m * ln(m)) AS h FROM cell GROUP BY ALL),
hx AS (SELECT feature, gx, gy, sum(m * ln(m)) AS h FROM
  (SELECT feature, gx, gy, bx, sum(m) AS m FROM cell GROUP BY ALL) GROUP BY ALL),
hy AS (SELECT feature, gx, gy, sum(m * ln(m)) AS h FROM
  (SELECT feature, gx, gy, by_, sum(m) AS m FROM cell GROUP BY ALL) GROUP BY ALL),
equi AS (SELECT feature, greatest(0, least(1, max(
    ((hj.h - hx.h - hy.h) / n + ln(n)) / ln(least(gx, gy))))) AS mic
  FROM hj JOIN hx USING (feature, gx, gy) JOIN hy USING (feature, gx, gy), size GROUP BY feature)"""


REPORT_SQL = f"""{v.RANK_SQL},
features AS (SELECT DISTINCT feature FROM lng),
rho AS (SELECT a.feature AS final, b.feature AS suggestion, abs(corr(a.r, b.r)) AS fs
  FROM rx a JOIN rx b USING (row_id) WHERE a.feature IN {FINALS} GROUP BY ALL),
tgt AS (SELECT feature AS suggestion, abs(corr(rx.r, ry.r)) AS ts
  FROM rx JOIN ry USING (row_id) GROUP BY feature),
pairs AS (SELECT final, suggestion, fs, ts FROM rho JOIN tgt USING (suggestion)),
kept AS (SELECT * FROM pairs WHERE ts > (SELECT median(ts) FROM pairs)),{_equi_sql()},
scored AS (SELECT final, suggestion, fs, ts, mic, (fs + ts) / 2 AS m, (fs + mic) / 2 AS mm
  FROM kept LEFT JOIN equi ON feature = suggestion),
report AS (SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY suggestion ORDER BY mm DESC, final) = 1)"""


def _report(spark, sf):
    c = v.cleaned(spark, sf)
    return driver_report(c.obs, c.rows, FINALS, c.obs.names, information="equi", alpha=EQUI_ALPHA)


@query("m28_driver_report", f"""WITH {REPORT_SQL}
SELECT final, suggestion, round(fs, 6) AS abs_corr_final_suggestion,
  round(ts, 6) AS abs_corr_target_suggestion, round(mic, 6) AS maximum_info_coeff,
  round(m, 6) AS mean_of_corr, round(mm, 6) AS mean_of_corr_mic FROM report""")
def m28(spark, sf):
    return _report(spark, sf).select("final", "suggestion", *[r6(c) for c in (
        "abs_corr_final_suggestion", "abs_corr_target_suggestion", "maximum_info_coeff",
        "mean_of_corr", "mean_of_corr_mic")])


@query("s6_final_sink", f"""WITH {REPORT_SQL}
SELECT '0' AS result, final, suggestion, round(fs, 4) AS abs_corr_final_suggestion,
  round(ts, 4) AS abs_corr_target_suggestion, round(m, 4) AS mean_of_corr,
  round(mic, 4) AS maximum_info_coeff, round(mm, 4) AS mean_of_corr_mic,
  '20240103-report' AS jobid, '20240103' AS dt FROM report""")
def s6(spark, sf):
    db, job = _database(spark), "20240103-report"
    results.append(results.final_rows(_report(spark, sf), "0", job), f"{db}.final_report")
    return results.read_results(spark, db, "final_report", job)


MONTHLY = """SELECT strftime(o_orderdate, '%Y%m') || '01-orders' AS job_id,
  o_orderpriority AS param, CAST(count(*) AS DOUBLE) AS value,
  strftime(o_orderdate, '%Y%m') || '01' AS dt FROM orders GROUP BY ALL"""


def _monthly(spark, sf) -> str:
    """A forest table with one job, and so one partition, per order month."""
    db = _database(spark)
    job = F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit("01-orders"))
    rows = v.table(spark, sf, "orders").groupBy(job.alias("job_id"),
                                                F.col("o_orderpriority").alias("param")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    dated = rows.withColumn("dt", fn.partition_value(F.col("job_id"))).repartition("dt")
    results.append(dated, f"{db}.forest")
    return db


@query("s7_forest_sink", MONTHLY)
def s7(spark, sf):
    return results.read_results(spark, _monthly(spark, sf), "forest")


@query("s8_status_sink", f"""WITH {v.WIDE_SQL}
SELECT CASE WHEN count(*) = 0 THEN '-1' WHEN count(*) < 10 THEN '-4'
  WHEN stddev_samp(CASE WHEN y IS NOT NULL THEN constant END) = 0 THEN '-2' ELSE '0' END AS result,
  'error' AS xparam, 'error' AS step_id, CAST(NULL AS DOUBLE) AS importance_value,
  '20240104-constant' AS jobid, '20240104' AS dt FROM wide""")
def s8(spark, sf):
    db, job = _database(spark), "20240104-constant"
    code = v.wide(spark, sf).agg(prepare.gate(
        F.count(F.lit(1)), F.stddev_samp(col("step5.constant")), F.lit(9)).alias("c")).first()["c"]
    results.append(results.status_row(spark, code, job), f"{db}.importance")
    return results.read_results(spark, db, "importance", job)


@query("s9_single_file_csv", f"""WITH {v.CLEAN_SQL}
SELECT feature, round(avg(value), 6) AS mean, count(*) AS n FROM lng GROUP BY feature""")
def s9(spark, sf):
    path = scratch_path(spark, "means")
    results.write_single_csv(_means(spark, sf).select("feature", "mean", "n"), path)
    return load_observations(spark, path, "feature string, mean double, n bigint").select(
        "feature", r6("mean"), "n")


@query("s10_create_tables", """SELECT dt, count(*) AS params, sum(value) AS orders FROM (
""" + MONTHLY + ") GROUP BY dt")
def s10(spark, sf):
    return spark.table(f"{_monthly(spark, sf)}.forest").groupBy("dt").agg(
        F.count(F.lit(1)).alias("params"), F.sum("value").alias("orders"))


@query("s11_list_partitions", f"SELECT DISTINCT 'dt=' || dt AS partition FROM ({MONTHLY})")
def s11(spark, sf):
    table = f"{_monthly(spark, sf)}.forest"
    results.repair_partitions(spark, table)
    return results.list_partitions(spark, table)


@query("s12_read_results", f"""SELECT job_id, param, value, dt FROM ({MONTHLY})
WHERE job_id = '19970101-orders' ORDER BY value DESC, job_id, param LIMIT 3""")
def s12(spark, sf):
    return results.read_results(spark, _monthly(spark, sf), "forest", "19970101-orders", limit=3)


@query("s13_preview", f"""WITH {v.WIDE_SQL}
SELECT count(*) AS n_rows, CAST(15 AS BIGINT) AS n_columns FROM wide""")
def s13(spark, sf):
    seen = preview(v.wide(spark, sf))
    return spark.createDataFrame([(seen["rows"], seen["columns"])],
                                 "n_rows bigint, n_columns bigint")


# ---- preparation ---------------------------------------------------------------

@query("p1_p2_feature_columns", f"""WITH {v.WIDE_SQL}, lng AS ({v.long_sql("wide", v.FEATURES)})
SELECT feature, count(value) AS n FROM lng GROUP BY feature""")
def p1(spark, sf):
    wide = v.wide(spark, sf)
    names = numeric_columns(wide, {*CLUSTERING_EXCLUDED, "row_id", "y"})
    counts = wide.agg(*[F.count(col(n)).alias(n) for n in names])
    return counts.unpivot([], [col(n) for n in names], "feature", "n")


@query("p3_drop_null_response", f"""WITH {v.WIDE_SQL}
SELECT count(*) AS n, round(sum(y), 3) AS total FROM wide WHERE y IS NOT NULL""")
def p3(spark, sf):
    return prepare.drop_null_response(v.observations(spark, sf)).df.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 3).alias("total"))


@query("p4_drop_incomplete_rows", f"""WITH {v.WIDE_SQL}
SELECT group_id, count(*) AS n FROM wide WHERE y IS NOT NULL AND acctbal IS NOT NULL
GROUP BY group_id""")
def p4(spark, sf):
    return prepare.drop_incomplete_rows(v.wide(spark, sf)).groupBy(
        F.col("GROUP_ID").alias("group_id")).agg(F.count(F.lit(1)).alias("n"))


@query("p5_mean_imputation", f"""WITH {v.CLEAN_SQL}
SELECT row_id, feature, round(value, 6) AS value FROM lng WHERE feature = 'step3.acctbal'""")
def p5(spark, sf):
    c = v.cleaned(spark, sf)
    return c.obs.select(["step3.acctbal"]).long().select(
        "row_id", F.lit("step3.acctbal").alias("feature"), r6("value"))


@query("p6_p7_p8_feature_flags", f"""WITH {v.RAW_SQL}
SELECT feature, coalesce(stddev_samp(value), 0) = 0 AS constant, count(value) = 0 AS empty,
  length(CAST(CAST(round_even(avg(value), 0) AS BIGINT) AS VARCHAR)) = 10 AS epoch,
  coalesce(stddev_samp(value), 0) <> 0 AND count(value) > 0
    AND length(CAST(CAST(round_even(avg(value), 0) AS BIGINT) AS VARCHAR)) <> 10 AS usable
FROM lng GROUP BY feature""")
def p6(spark, sf):
    known = prepare.drop_null_response(v.observations(spark, sf))
    flags = prepare.feature_flags(moments(known), drop_epoch=True)
    return flags.join(F.broadcast(known.dictionary()), "idx").select(
        "feature", "constant", "empty", "epoch", "usable")


@query("p9_all_double", """SELECT count(try_cast(o_orderpriority AS DOUBLE)) AS priority,
  count(try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE)) AS level,
  sum(try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE)) AS levels,
  CAST(sum(o_custkey) AS DOUBLE) AS customers FROM orders""")
def p9(spark, sf):
    cast = prepare.all_double(v.table(spark, sf, "orders").select(
        "o_orderpriority", F.substring("o_orderpriority", 1, 1).alias("level"), "o_custkey"))
    return cast.agg(F.count("o_orderpriority").alias("priority"), F.count("level").alias("level"),
                    F.sum("level").alias("levels"), F.sum("o_custkey").alias("customers"))


RHO_SQL = f"""{v.RANK_SQL},
rho AS (SELECT feature, corr(rx.r, ry.r) AS rho FROM rx JOIN ry USING (row_id) GROUP BY feature)"""


def rho(spark, sf):
    c = v.cleaned(spark, sf)
    return settled(target_spearman(c.obs, c.rows))


@query("p10_positive_scores", f"""WITH {RHO_SQL}
SELECT feature, round(rho, 6) AS mean FROM rho WHERE rho > 0""")
def p10(spark, sf):
    from yieldscope.operators.trees import top_features
    scores = rho(spark, sf).select("feature", F.col("rho").alias("mean"))
    return top_features(scores, None).select("feature", r6("mean"))


@query("p11_non_zero_coefficients", f"""WITH {v.SCALED_SQL},
slope AS (SELECT feature, avg(z.value * y) AS c FROM z GROUP BY feature)
SELECT feature, round(sign(c) * greatest(abs(c) - 1, 0), 6) AS coef FROM slope
WHERE sign(c) * greatest(abs(c) - 1, 0) <> 0""")
def p11(spark, sf):
    slope = v.scaled(spark, sf).long("y").groupBy("idx").agg(
        F.avg(F.col("value") * F.col("y")).alias("c"))
    shrunk = F.signum("c") * F.greatest(F.abs("c") - 1, F.lit(0.0))
    return (slope.select("idx", shrunk.alias("coef")).filter("coef <> 0")
            .join(F.broadcast(v.cleaned(spark, sf).obs.dictionary()), "idx")
            .select("feature", r6("coef")))


@query("p12_above_median", f"""WITH {RHO_SQL}
SELECT feature, round(abs(rho), 6) AS score FROM rho
WHERE abs(rho) > (SELECT median(abs(rho)) FROM rho)""")
def p12(spark, sf):
    scores = rho(spark, sf).select("feature", F.abs("rho").alias("score"))
    return prepare.above_median(scores, "score").select("feature", r6("score"))


@query("p13_input_gate", """SELECT o_custkey, CASE WHEN count(*) = 0 THEN '-1'
  WHEN count(*) < 10 THEN '-4' WHEN stddev_samp(o_totalprice) = 0 THEN '-2'
  WHEN count(DISTINCT o_orderpriority) - 1 < 4 THEN '-3' ELSE '0' END AS code
FROM orders GROUP BY o_custkey""")
def p13(spark, sf):
    return v.table(spark, sf, "orders").groupBy("o_custkey").agg(prepare.gate(
        F.count(F.lit(1)), F.stddev_samp("o_totalprice"),
        F.count_distinct("o_orderpriority") - 1, needed=4).alias("code"))


@query("p14_all_constant", f"""WITH {v.SCALED_SQL}
SELECT bool_and(s = 0) AS all_constant, CAST(count(*) AS BIGINT) AS features FROM
(SELECT idx, stddev_samp(value) AS s FROM z GROUP BY idx)""")
def p14(spark, sf):
    return moments(v.scaled(spark, sf)).agg(
        F.bool_and(F.col("std") == 0).alias("all_constant"),
        F.count(F.lit(1)).alias("features"))


@query("p15_time_number", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def p15(spark, sf):
    return v.table(spark, sf, "events").select(
        "event_id", fn.time_number(F.col("ts")).cast("bigint").alias("micros"))


@query("p16_p17_name_parts", """SELECT CASE WHEN instr(name, '.') > 0 THEN split_part(name, '.', 1) END AS step,
  CASE WHEN instr(name, '.') > 0 THEN split_part(name, '.', 2) ELSE name END AS param,
  substr(name, 1, 8) AS dt, count(*) AS n
FROM (SELECT CASE WHEN p_size < 25 THEN p_type || '.' || p_brand ELSE p_brand END AS name FROM part)
GROUP BY ALL""")
def p16(spark, sf):
    name = F.when(F.col("p_size") < 25, F.concat_ws(".", "p_type", "p_brand")).otherwise(
        F.col("p_brand"))
    named = v.table(spark, sf, "part").select(name.alias("name"))
    return named.groupBy(fn.step_part(F.col("name")).alias("step"),
                         fn.param_part(F.col("name")).alias("param"),
                         fn.partition_value(F.col("name")).alias("dt")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p18_skip_invalid_vectors", f"""WITH {v.WIDE_SQL}
SELECT count(*) AS n, round(sum(acctbal), 2) AS total FROM wide WHERE acctbal IS NOT NULL""")
def p18(spark, sf):
    plain = v.wide(spark, sf).select(col("step1.tax").alias("tax"),
                                     col("step3.acctbal").alias("acctbal"))
    kept = VectorAssembler(inputCols=["tax", "acctbal"], outputCol="features",
                           handleInvalid="skip").transform(plain)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("acctbal"), 2).alias("total"))


@query("p19_vector_elements", """SELECT vec_id, unnest(range(len(embedding))) AS at,
  round(CAST(unnest(embedding) AS DOUBLE), 6) AS e FROM embeddings""")
def p19(spark, sf):
    vectors = v.table(spark, sf, "embeddings").select(
        "vec_id", vector_to_array(array_to_vector("embedding")).alias("e"))
    return vectors.select("vec_id", F.posexplode("e").alias("at", "e")).select(
        "vec_id", F.col("at").cast("bigint").alias("at"), r6("e"))


@query("p20_high_variance", f"""WITH {v.RAW_SQL}
SELECT feature, round(ln(var_samp(value)), 6) AS log_variance FROM lng
GROUP BY feature HAVING var_samp(value) > 0.01""")
def p20(spark, sf):
    obs = prepare.drop_null_response(v.observations(spark, sf))
    return (prepare.high_variance(moments(obs)).join(F.broadcast(obs.dictionary()), "idx")
            .select("feature", F.round(F.log(F.col("std") * F.col("std")), 6).alias("log_variance")))


@query("p21_feature_subset", f"""WITH {v.CLEAN_SQL}
SELECT row_id, round(load, 6) AS load, round(tax, 6) AS tax FROM known""")
def p21(spark, sf):
    part = v.cleaned(spark, sf).obs.select(["step4.load", "step1.tax"])
    return part.df.select("row_id", F.round(F.col("features")[0], 6).alias("load"),
                          F.round(F.col("features")[1], 6).alias("tax"))


# ---- joins and reshapes --------------------------------------------------------

@query("j1_join_by_row", f"""WITH {v.SCALED_SQL}
SELECT z.row_id, feature, round(z.value, 6) + 0 AS value, epoch_us(end_time) AS micros, round(sqrt(abs(wide.y)), 6) AS y_root
FROM z JOIN wide ON z.row_id = wide.row_id""")
def j1(spark, sf):
    features = _named(v.scaled(spark, sf))
    response = v.cleaned(spark, sf).obs.df.select("row_id", "ts", "y")
    return features.join(response, "row_id").select(
        "row_id", "feature", (F.col("value") + 0.0).alias("value"),
        fn.time_number(F.col("ts")).cast("bigint").alias("micros"), r6(F.sqrt(F.abs("y")), "y_root"))


@query("j2_feature_pairs", f"""WITH {RHO_SQL}
SELECT a.feature AS final, b.feature AS suggestion FROM rho a, rho b
WHERE abs(a.rho) > 0.3 AND b.rho > 0""")
def j2(spark, sf):
    scores = rho(spark, sf)
    return feature_pairs(scores.filter(F.abs("rho") > 0.3), scores.filter("rho > 0"))


@query("j3_lookup", f"""WITH {RHO_SQL},
m AS (SELECT feature, avg(value) AS mean FROM lng WHERE value > 10 GROUP BY feature)
SELECT feature, round(rho, 6) AS rho, round(mean, 4) AS mean FROM rho LEFT JOIN m USING (feature)""")
def j3(spark, sf):
    c = v.cleaned(spark, sf)
    large = (c.obs.long().filter("value > 10").groupBy("idx").agg(F.avg("value").alias("mean"))
             .join(F.broadcast(c.obs.dictionary()), "idx").select("feature", "mean"))
    return rho(spark, sf).join(F.broadcast(large), "feature", "left").select(
        "feature", r6("rho"), F.round("mean", 4).alias("mean"))


@query("j5_j6_long_form", f"""WITH {v.CLEAN_SQL}
SELECT feature, count(*) AS n, round(sum(value), 3) AS total FROM lng GROUP BY feature""")
def j5(spark, sf):
    obs = v.cleaned(spark, sf).obs
    return (obs.long().groupBy("idx").agg(F.count(F.lit(1)).alias("n"),
                                          F.round(F.sum("value"), 3).alias("total"))
            .join(F.broadcast(obs.dictionary()), "idx").select("feature", "n", "total"))


# ---- scaling and encoding ------------------------------------------------------

def _named(obs):
    return obs.long().join(F.broadcast(obs.dictionary()), "idx").select(
        "row_id", "feature", F.round(F.col("value"), 6).alias("value"))


@query("t1_standardize", f"""WITH {v.SCALED_SQL}
SELECT row_id, feature, round(value, 6) + 0 AS value FROM z""")
def t1(spark, sf):
    return _named(v.scaled(spark, sf)).withColumn("value", F.col("value") + 0.0)


@query("t2_standard_scaler", """WITH e AS (
  SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT vec_id, dim, round((x - avg(x) OVER (PARTITION BY dim)) / stddev_samp(x) OVER (PARTITION BY dim), 5) + 0 AS z FROM e""")
def t2(spark, sf):
    vectors = v.table(spark, sf, "embeddings").select(
        "vec_id", array_to_vector("embedding").alias("features"))
    model = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True)
    scaled = model.fit(vectors).transform(vectors).select(
        "vec_id", F.posexplode(vector_to_array("z")).alias("dim", "z"))
    return scaled.select("vec_id", F.col("dim").cast("bigint").alias("dim"), (F.round("z", 5) + 0.0).alias("z"))


@query("t3_unit_columns", f"""WITH {v.CLEAN_SQL},
n AS (SELECT idx, sqrt(sum(value * value)) AS l FROM lng GROUP BY idx)
SELECT row_id, feature, round(value / l, 8) AS value FROM lng JOIN n USING (idx)""")
def t3(spark, sf):
    obs = scale.unit_columns(v.cleaned(spark, sf).obs)
    return obs.long().join(F.broadcast(obs.dictionary()), "idx").select(
        "row_id", "feature", F.round(F.col("value"), 8).alias("value"))


@query("t4_min_max", f"""WITH {v.CLEAN_SQL},
n AS (SELECT idx, min(value) AS a, max(value) AS b FROM lng GROUP BY idx)
SELECT row_id, feature, round((value - a) / (b - a), 6) AS value FROM lng JOIN n USING (idx)""")
def t4(spark, sf):
    return _named(scale.min_max(v.cleaned(spark, sf).obs))


@query("t5_label_encoding", """SELECT o_orderkey, o_orderpriority,
  dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label FROM orders""")
def t5(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return scale.label_encode(orders, "o_orderpriority")


@query("t6_t7_frequency_index", """SELECT o_orderkey, CAST(i AS DOUBLE) AS idx, o_orderpriority AS back
FROM orders JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i
  FROM orders GROUP BY o_orderpriority) USING (o_orderpriority)""")
def t6(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    model = StringIndexer(inputCol="o_orderpriority", outputCol="idx").fit(orders)
    back = IndexToString(inputCol="idx", outputCol="back", labels=model.labels)
    return back.transform(model.transform(orders)).select("o_orderkey", "idx", "back")


@query("t8_t9_categorical_positions", """SELECT CAST(0 AS BIGINT) AS position, count(DISTINCT l_linestatus) <= 4 AS categorical FROM lineitem
UNION ALL SELECT 1, count(DISTINCT l_returnflag) <= 4 FROM lineitem
UNION ALL SELECT 2, count(DISTINCT l_linenumber) <= 4 FROM lineitem
UNION ALL SELECT 3, count(DISTINCT l_quantity) <= 4 FROM lineitem""")
def t8(spark, sf):
    lines = v.table(spark, sf, "lineitem").select(
        F.ascii("l_linestatus").cast("double").alias("a"),
        F.ascii("l_returnflag").cast("double").alias("b"),
        F.col("l_linenumber").cast("double").alias("c"), F.col("l_quantity").alias("d"))
    vectors = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="v").transform(lines)
    found = VectorIndexer(inputCol="v", outputCol="i", maxCategories=4).fit(vectors).categoryMaps
    return spark.createDataFrame([(i, i in found) for i in range(4)],
                                 "position bigint, categorical boolean")
