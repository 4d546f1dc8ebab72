"""Observation tables derived from the given tables, in Spark and as SQL text.

One observation is one order: its line items, parts and suppliers are the
measured steps, the order date is the time, the order status the group.
Averages of decimal columns go through integer hundredths, so that both engines
hold bit-equal values and ties are ties in both.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldscope.operators.prepare import Cleaned, clean
from yieldscope.operators.scale import standardize
from yieldscope.sources.observations import Observations, from_wide

FEATURES = ("step1.quantity", "step1.discount", "step1.tax", "step1.price", "step2.size",
            "step2.retailprice", "step3.acctbal", "step4.lines", "step4.load",
            "step5.constant", "step5.due")
VARYING = FEATURES[:9]          # neither constant nor epoch-like
DUE_AFTER = 631_152_000         # seconds; moves the dates to ten-digit epochs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide input table: ``row_id, END_TIME, GROUP_ID, y, step.param …``."""
    def hundredths(c: str):
        return F.sum(F.round(F.col(c) * 100).cast("bigint")).cast("double")

    n = F.count(F.lit(1))
    lines = (table(spark, sf_dir, "lineitem")
             .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
             .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")))
    per_order = lines.groupBy("l_orderkey").agg(
        (F.sum("l_quantity") / n).alias("quantity"),
        (hundredths("l_discount") / n / 100).alias("discount"),
        (hundredths("l_tax") / n / 100).alias("tax"),
        (hundredths("l_extendedprice") / n / 100).alias("price"),
        (F.sum("p_size").cast("double") / n).alias("size"),
        (hundredths("p_retailprice") / n / 100).alias("retailprice"),
        (hundredths("s_acctbal") / n / 100).alias("acctbal"),
        n.cast("double").alias("lines"),
        F.sum("l_quantity").alias("load"))
    joined = table(spark, sf_dir, "orders").join(
        per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    target = 3.0 * F.col("quantity") - 2.0 * F.col("size") + F.col("o_totalprice") / 100000.0
    due = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + DUE_AFTER
    return joined.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderdate").cast("timestamp").alias("END_TIME"),
        F.col("o_orderstatus").alias("GROUP_ID"),
        F.when(F.col("tax") > 0, target).alias("y"),
        F.col("quantity").alias("step1.quantity"),
        F.col("discount").alias("step1.discount"),
        F.col("tax").alias("step1.tax"),
        F.col("price").alias("step1.price"),
        F.col("size").alias("step2.size"),
        F.col("retailprice").alias("step2.retailprice"),
        F.when(F.col("acctbal") >= 0, F.col("acctbal")).alias("step3.acctbal"),
        F.col("lines").alias("step4.lines"),
        F.col("load").alias("step4.load"),
        F.lit(7.0).alias("step5.constant"),
        due.cast("double").alias("step5.due"))


def observations(spark: SparkSession, sf_dir: str) -> Observations:
    return from_wide(wide(spark, sf_dir), "y", row_id="row_id")


_CLEANED: dict = {}


def cleaned(spark: SparkSession, sf_dir: str) -> Cleaned:
    """Imputed observations with the nine varying features, kept for later queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CLEANED:
        found = clean(observations(spark, sf_dir), drop_epoch=True)
        _CLEANED[key] = replace(found, obs=found.obs.with_df(found.obs.df.persist()))
    return _CLEANED[key]


def scaled(spark: SparkSession, sf_dir: str) -> Observations:
    """The cleaned observations as z-scores."""
    found = cleaned(spark, sf_dir)
    return standardize(found.obs, found.stats)


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, x0, x1)``: activity of a user on a day, with three planted groups.

    The groups lie 4000 units apart in the mean value, by user.
    """
    day = F.to_date("ts")
    grouped = table(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double") / 100
         / F.count(F.lit(1))).alias("v"))
    return grouped.select(
        (F.col("user_id") * 100000 + F.date_diff(F.col("day"), F.lit("2020-01-01").cast("date")))
        .alias("row_id"),
        (F.col("n") / 4).alias("x0"),
        (F.col("user_id") % 3 * 4000 + F.col("v")).alias("x1"))


# ---- SQL text of the same views ------------------------------------------------

WIDE_SQL = f"""
per_order AS (
  SELECT l_orderkey,
    sum(l_quantity) / count(*) AS quantity,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS discount,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS tax,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS price,
    CAST(sum(p_size) AS DOUBLE) / count(*) AS size,
    CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS retailprice,
    CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS acctbal,
    CAST(count(*) AS DOUBLE) AS lines,
    sum(l_quantity) AS load
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY l_orderkey),
wide AS (
  SELECT o_orderkey AS row_id, o_orderdate AS end_time, o_orderstatus AS group_id,
    CASE WHEN tax > 0 THEN CAST(3.0 AS DOUBLE) * quantity - CAST(2.0 AS DOUBLE) * size
      + o_totalprice / CAST(100000.0 AS DOUBLE) END AS y,
    quantity, discount, tax, price, size, retailprice,
    CASE WHEN acctbal >= 0 THEN acctbal END AS acctbal, lines, load,
    CAST(7.0 AS DOUBLE) AS constant,
    CAST(epoch(o_orderdate) + {DUE_AFTER} AS DOUBLE) AS due
  FROM orders JOIN per_order ON o_orderkey = l_orderkey)"""


def long_sql(source: str, features) -> str:
    return " UNION ALL ".join(
        f"SELECT row_id, y, {i} AS idx, '{f}' AS feature, {f.split('.')[1]} AS value FROM {source}"
        for i, f in enumerate(features))


# every feature of every row with a response
RAW_SQL = WIDE_SQL + f""",
known AS (SELECT * FROM wide WHERE y IS NOT NULL),
lng AS ({long_sql("known", FEATURES)})"""

# imputed, varying features only
CLEAN_SQL = WIDE_SQL + f""",
known AS (SELECT * REPLACE (coalesce(acctbal, avg(acctbal) OVER ()) AS acctbal)
  FROM wide WHERE y IS NOT NULL),
lng AS ({long_sql("known", VARYING)})"""

# z-scores with the population deviation
SCALED_SQL = CLEAN_SQL + """,
fit AS (SELECT idx, avg(value) AS m, stddev_pop(value) AS s FROM lng GROUP BY idx),
z AS (SELECT row_id, y, idx, feature, (value - m) / s AS value FROM lng JOIN fit USING (idx))"""

# average-tie ranks of features and target
RANK_SQL = CLEAN_SQL + """,
rx AS (SELECT row_id, feature, rank() OVER (PARTITION BY idx ORDER BY value)
  + (count(*) OVER (PARTITION BY idx, value) - 1) / 2.0 AS r FROM lng),
ry AS (SELECT row_id, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS r
  FROM known)"""

USER_DAYS_SQL = """
user_days AS (
  SELECT user_id * 100000 + date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS row_id,
    count(*) / CAST(4 AS DOUBLE) AS x0,
    user_id % 3 * 4000 + CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS x1
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""
