"""Scaling and encoding. Statistics come from one aggregate; applying them is a projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldscope.functions.scalars import array_of
from yieldscope.operators.profile import moments
from yieldscope.operators.ranks import attach_by_value, row_positions
from yieldscope.sources.observations import Observations

CLASS_LIMIT = 1_000_000   # label tables above this size are joined by shuffle, hot classes apart


def affine(obs: Observations, shift, scale) -> Observations:
    """``(x − shift) · scale`` per feature."""
    centred = F.zip_with("features", array_of(shift), lambda x, m: x - m)
    return obs.with_df(obs.df.withColumn(
        "features", F.zip_with(centred, array_of(scale), lambda x, s: x * s)))


def _inverse(spread) -> np.ndarray:
    spread = np.asarray(spread, dtype=float)
    return np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)


def standardize(obs: Observations, stats=None) -> Observations:
    """Zero mean and unit *population* deviation; constant features become 0."""
    stats = _stats(obs) if stats is None else stats
    return affine(obs, stats["mean"], _inverse(stats["std_pop"]))


def min_max(obs: Observations, stats=None) -> Observations:
    """Each feature mapped to [0, 1]; constant features become 0."""
    stats = _stats(obs) if stats is None else stats
    return affine(obs, stats["lo"], _inverse(stats["hi"] - stats["lo"]))


def unit_columns(obs: Observations) -> Observations:
    """Each feature (column) divided by its Euclidean norm."""
    sums = (obs.long().groupBy("idx").agg(F.sum(F.col("value") * F.col("value")).alias("ss"))
            .orderBy("idx").toPandas())
    return affine(obs, np.zeros(len(sums)), _inverse(np.sqrt(sums["ss"])))


def _stats(obs: Observations):
    return moments(obs).orderBy("idx").toPandas()


def standardize_column(df: DataFrame, name: str, alias: str | None = None) -> DataFrame:
    """Z-score of one plain column, population deviation."""
    m = df.agg(F.avg(name).alias("m"), F.stddev_pop(name).alias("s")).first()
    value = (F.col(name) - m["m"]) / m["s"] if m["s"] else F.lit(0.0)
    return df.withColumn(alias or name, value)


def label_classes(df: DataFrame, name: str) -> DataFrame:
    """``(name, label)``: 0-based position of each class in sorted order."""
    classes = df.select(name).filter(F.col(name).isNotNull()).distinct()
    count = classes.count()
    return row_positions(classes, name, count).withColumnRenamed("position", "label")


def label_encode(df: DataFrame, name: str) -> DataFrame:
    """Add ``label``, the sorted-order code of a text or numeric column; rows without class go."""
    classes = label_classes(df, name)
    if classes.limit(CLASS_LIMIT + 1).count() <= CLASS_LIMIT:
        return df.join(F.broadcast(classes), name)
    known = df.filter(F.col(name).isNotNull())
    sizes = known.groupBy(name).agg(F.count(F.lit(1)).alias("cnt"))
    rows = known.count()
    return attach_by_value(known, classes.join(sizes, name), [name], rows, rows).drop("cnt")
