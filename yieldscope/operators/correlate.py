"""Rank and linear correlation between features and with the target."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldscope.operators.gram import BLOCK, product_blocks
from yieldscope.operators.ranks import (
    attach_by_value, average_rank, centred_ranks, counts_before, rank_spots)
from yieldscope.operators.sums import merged
from yieldscope.session import scratch_path
from yieldscope.sources.observations import Observations


def target_spearman(obs: Observations, rows: int, range_rows: int | None = None) -> DataFrame:
    """``(feature, rho, n)``: rank correlation of every feature with the target.

    The rank of a feature value and the summed target ranks of the rows holding
    it give ``Σ R_x R_y`` directly, so the rows are shuffled once, pre-aggregated
    by value, and no rank is joined back to them. Needs complete values.
    """
    target = obs.df.select("row_id", F.col("y").alias("value"), "features")
    y_rank = counts_before(target.select("value"), [], "value", rows, range_rows=range_rows)
    y_rank = y_rank.select("value", "cnt", ((average_rank() - (rows + 1) / 2) / rows).alias("ry"))
    with_rank = attach_by_value(target, y_rank, ["value"], rows, rows)
    cells = with_rank.select("ry", F.posexplode("features").alias("idx", "value"))
    per_value = counts_before(cells, ["idx"], "value", rows,
                              extra=[F.sum("ry").alias("sy"),
                                     F.sum(F.col("ry") * F.col("ry")).alias("syy")],
                              range_rows=range_rows, n_keys=len(obs.names),
                              plain=target.select(F.posexplode("features").alias("idx", "value")))
    rx = (average_rank() - (rows + 1) / 2) / rows
    sums = per_value.groupBy("idx").agg(
        F.sum("cnt").alias("n"), F.sum(rx * F.col("sy")).alias("sxy"),
        F.sum(rx * rx * F.col("cnt")).alias("sxx"), F.sum("syy").alias("syy"))
    rho = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    return sums.join(F.broadcast(obs.dictionary()), "idx").select("feature", rho.alias("rho"), "n")


def _correlations(df: DataFrame, vector: Column, names: list[str], centred: bool,
                  heads: list[str] | None = None) -> DataFrame:
    """Ordered pairs ``(a, b, r)`` with a among ``heads`` (default all) of the numbers in ``vector``.

    Correlations are worked out where the blocks of products lie; the driver holds the
    means and deviations, one of each for a column. The first number of the vector is a 1
    unless the columns are centred already.
    """
    spark, first = df.sparkSession, 0 if centred else 1
    width = len(names) + first
    blocks = merged(product_blocks(df, vector, width), ["part", "bi", "bj"])
    path = scratch_path(spark, "products")  # read for the diagonals, then for the correlations
    blocks.write.parquet(path)
    blocks = spark.read.parquet(path)
    own, sums = np.zeros(width), np.zeros(width)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the diagonal, and the row of sums, which the constant at position 0 gives
        for batch in batches:
            for i, j, v in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), batch.column("v")):
                columns = min(BLOCK, width - j * BLOCK)
                block = v.values.to_numpy(zero_copy_only=False).reshape(-1, columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([j], pa.int32()), pa.array([np.diag(block) if i == j else None], pa.list_(pa.float64())),
                     pa.array([block[0]], pa.list_(pa.float64()))], names=["bj", "own", "sums"])

    for row in blocks.where("bi = bj or bi = 0").mapInArrow(edges, "bj int, own array<double>, sums array<double>").collect():
        at = slice(row["bj"] * BLOCK, row["bj"] * BLOCK + len(row["sums"]))
        if row["own"] is not None:
            own[at] = row["own"]
        if row["own"] is None or row["bj"] == 0:
            sums[at] = row["sums"]
    n = 1.0 if centred else own[0]
    means = np.zeros(width) if centred else sums / max(n, 1.0)
    spread = np.sqrt(np.maximum(own - n * means ** 2, 0.0))
    # a column whose deviation is rounding noise has no correlation
    known = spread > 1e-7 * np.sqrt(np.maximum(own, 1e-300)) if not centred else spread > 0
    wanted = np.ones(width, bool) if heads is None else np.isin(np.array(["", *names][1 - first:]), heads)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, v in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), batch.column("v")):
                columns = min(BLOCK, width - j * BLOCK)
                block = v.values.to_numpy(zero_copy_only=False).reshape(-1, columns)
                a, b = i * BLOCK + np.arange(len(block)), j * BLOCK + np.arange(columns)
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = np.clip((block - n * np.outer(means[a], means[b])) / np.outer(spread[a], spread[b]), -1.0, 1.0)
                r[~known[a], :] = np.nan
                r[:, ~known[b]] = np.nan
                for x, y, value in ((a, b, r), (b, a, r.T)) if i != j else ((a, b, np.triu(r) + np.triu(r, 1).T),):
                    keep = np.flatnonzero(wanted[x] & (x >= first))
                    for s in range(0, len(keep), 64):  # 64 rows of the table at a time
                        rows = keep[s:s + 64]
                        right = np.flatnonzero(y >= first)
                        flat = value[np.ix_(rows, right)].ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(x[rows] - first, len(right)), pa.int32()),
                             pa.array(np.tile(y[right] - first, len(rows)), pa.int32()),
                             pa.array(flat, mask=np.isnan(flat))], names=["i", "j", "r"])

    cells = blocks.mapInArrow(pairs, "i int, j int, r double")
    table = spark.createDataFrame(list(enumerate(names)), "at int, name string")
    left, right = table.toDF("i", "a"), table.toDF("j", "b")
    return cells.join(F.broadcast(left), "i").join(F.broadcast(right), "j").select("a", "b", "r")


def pearson(obs: Observations) -> DataFrame:
    """``(a, b, r)`` for every ordered pair of features, from one pass."""
    z = F.concat(F.array(F.lit(1.0)), F.col("features"))
    return _correlations(obs.df, z, list(obs.names), centred=False)


def spearman(obs: Observations, rows: int, target: str = "target",
             spots: DataFrame | None = None, range_rows: int | None = None,
             heads: list[str] | None = None) -> DataFrame:
    """``(a, b, r)`` for every ordered pair of features and the target.

    Each column is ranked once, however many pairs it takes part in; ``spots``
    may hand in ranks that exist already, ``heads`` restricts the first of a pair.
    """
    spots = rank_spots(obs, rows, range_rows) if spots is None else spots
    ranks = centred_ranks(spots, rows)
    return _correlations(ranks, F.col("ranks"), [target, *obs.names], True, heads)


def t_statistic(r: Column, n: Column) -> Column:
    """``r·√((n−2)/(1−r²))``; null where |r| = 1."""
    return F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r)))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta."""

    value, nu = t.to_numpy(float, na_value=np.nan), dof.to_numpy(float, na_value=np.nan)
    known = np.isfinite(value) & (nu > 0)
    value, nu = np.where(known, value, 0.0), np.where(known, nu, 1.0)
    x, a, b = nu / (nu + value * value), nu / 2, np.full(len(nu), 0.5)
    mirrored = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(mirrored, 1 - x, x), np.where(mirrored, b, a), np.where(mirrored, a, b)
    gammas = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b)])
    with np.errstate(divide="ignore"):
        front = np.exp(gammas + a * np.log(x) + b * np.log1p(-x)) / a
    # modified Lentz evaluation of all rows at once
    tiny, c = 1e-300, np.ones(len(x))
    d = 1 / np.maximum(1 - (a + b) * x / (a + 1), tiny)
    fraction = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / np.where(np.abs(d) > tiny, d, tiny)
            c = np.where(np.abs(c) > tiny, c, tiny)
            fraction = fraction * c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    part = front * fraction
    return pd.Series(np.where(known, np.where(mirrored, 1 - part, part), np.nan), dtype="float64")


def with_p_value(pairs: DataFrame, r: str = "rho", n: str = "n") -> DataFrame:
    """Add ``t``, ``dof`` and the two-sided ``p_value`` to a table of correlations."""
    out = (pairs.withColumn("t", t_statistic(F.col(r), F.col(n)))
           .withColumn("dof", (F.col(n) - 2).cast("double")))
    p = t_two_sided(F.col("t"), F.col("dof"))
    return out.withColumn("p_value", F.when(F.abs(F.col(r)) >= 1, 0.0)
                          .when(F.col("t").isNotNull(), p))


def strongest(obs: Observations, rows: int, top_n: int = 5000,
              method: str = "spearman") -> DataFrame:
    """``(feature, score)``: the ``top_n`` features most correlated with the target."""
    if method == "spearman":
        scored = target_spearman(obs, rows).select("feature", F.abs("rho").alias("score"))
    else:
        scored = (obs.long("y").groupBy("idx").agg(F.corr("value", "y").alias("r"))
                  .join(F.broadcast(obs.dictionary()), "idx")
                  .select("feature", F.abs("r").alias("score")))
    return scored.orderBy(F.desc_nulls_last("score"), "feature").limit(top_n)
