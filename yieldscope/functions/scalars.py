"""Scalar expressions used across reports. All are built-in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def array_of(values) -> Column:
    """Constant ``array<double>`` column from numbers, through one parser call."""
    return F.expr("array(" + ",".join(
        f"{float(v)!r}D" if abs(float(v)) < float("inf") else f"double('{float(v)}')"
        for v in values) + ")")


def adjusted_r2(r2: Column, n: Column, p: Column) -> Column:
    """R² corrected for p regressors; null when no degree of freedom is left."""
    spare = n - p - 1
    return F.when(spare != 0, 1 - (1 - r2) * (n - 1) / spare)


def signed_exp(c: Column) -> Column:
    return F.signum(c) * F.exp(c)


def log_grid(spark: SparkSession, low: float, high: float, points: int) -> DataFrame:
    """``(id, alpha)``: ``points`` values from 10^low to 10^high, evenly spaced in the exponent."""
    step = (high - low) / (points - 1)
    return spark.range(points).withColumn("alpha", F.pow(F.lit(10.0), low + F.col("id") * step))


def scaled_importance(importance: Column, std: Column) -> Column:
    return F.try_divide(importance, std)


def pair_mean(a: Column, b: Column) -> Column:
    return (a + b) / 2


def is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


# The bounds of the two verdicts below.

def silhouette_band(score: Column) -> Column:
    """Quality of a clustering in words, by the customary bounds."""
    return (F.when(score > 0.7, "strong").when(score > 0.5, "reasonable")
            .when(score > 0.25, "weak").when(score > 0, "overlapping").otherwise("wrong"))


def accuracy_loss(before: Column, after: Column) -> Column:
    """Loss of silhouette in percent of the first value."""
    return F.try_divide(before - after, before) * 100


def loss_verdict(loss: Column) -> Column:
    return F.when(loss < 2, "acceptable").when(loss < 5, "caution").otherwise("not advised")


def step_part(feature: Column) -> Column:
    """``step`` of ``step.param``; null for a name without a dot."""
    return F.when(F.instr(feature, ".") > 0, F.split_part(feature, F.lit("."), F.lit(1)))


def param_part(feature: Column) -> Column:
    """``param`` of ``step.param``; the whole name when it has no dot."""
    return (F.when(F.instr(feature, ".") > 0, F.split_part(feature, F.lit("."), F.lit(2)))
            .otherwise(feature))


def partition_value(job_id: Column) -> Column:
    return F.substring(job_id, 1, 8)


def report_round(c: Column, digits: int = 4) -> Column:
    return F.round(c, digits)


def epoch_like(mean: Column) -> Column:
    """True when the rounded mean prints with ten characters, as epoch seconds do."""
    digits = F.bround(mean, 0).cast("decimal(38,0)").cast("string")
    return F.coalesce(F.length(digits) == 10, F.lit(False))


def time_number(ts: Column) -> Column:
    """Microseconds since the epoch as a double."""
    return F.unix_micros(ts.cast("timestamp")).cast("double")
