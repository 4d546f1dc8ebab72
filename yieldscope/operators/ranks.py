"""Exact ranks and positions of very large columns, without a global sort task.

Everything here works on the *distinct* values with their counts, so a value
that fills a third of a column is one row. When a column may hold more distinct
values than one task should sort, it is cut into value ranges first, and each
range is sorted on its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldscope.session import scratch_path
from yieldscope.sources.observations import Observations

RANGE_ROWS = 4_000_000        # distinct values one sorting task is meant to take
BOUND_CELLS = 2_000_000       # range bounds kept on the driver, all columns together
BROADCAST_CELLS = 1_000_000   # largest value table sent to every executor
HOT_SHARE = 1_000             # a value with more than 1/1000 of the rows is hot
WIDE_SHARE = 32               # the same where hot values are too many to broadcast
SALTS = 32                    # tasks that share the rows of such a value


def _value_ranges(df: DataFrame, keys: list[str], value: str, ranges: int) -> DataFrame:
    """``(*keys, bounds)``: values that cut each key's rows into equal shares.

    Only quantile sketches are shuffled. The bounds are collected (at most
    BOUND_CELLS numbers), so that every use of them, recomputed or not, agrees.
    """
    cuts = [i / ranges for i in range(1, ranges)]
    sketch = F.percentile_approx(value, cuts, max(10000, 10 * ranges))
    return df.groupBy(*keys).agg(F.array_sort(F.array_distinct(sketch)).alias("bounds"))


def _place(bounds: list[np.ndarray], df: DataFrame):
    """Column function giving the number of the range a value of a key lies in."""
    shared = df.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf(T.IntegerType())
    def place(key: pd.Series, value: pd.Series) -> pd.Series:
        out = np.zeros(len(key), dtype=np.int32)
        for k, rows in key.groupby(key).indices.items():
            out[rows] = np.searchsorted(shared.value[k], value.to_numpy()[rows])
        return pd.Series(out)

    return place


def counts_before(df: DataFrame, keys: Sequence[str], value: str, rows_per_key: int,
                  extra: Sequence[Column] = (), range_rows: int | None = None,
                  n_keys: int | None = None, plain: DataFrame | None = None) -> DataFrame:
    """``(*keys, value, cnt, *extra, before)``: ``before`` counts smaller values of the key.

    ``rows_per_key`` bounds the rows any key can have; ``extra`` are further
    aggregates per distinct value. ``plain`` has the same keys and values, where ``df``
    is dear to read: ranges are found and counted from it.
    """
    keys = list(keys)
    tallies = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"), *extra)
    range_rows = range_rows or RANGE_ROWS
    ranges = math.ceil(rows_per_key / range_rows)
    if ranges > 1 and not isinstance(df.schema[value].dataType, T.NumericType):
        return _before_by_partitions(tallies, keys, value, range_rows)
    if ranges <= 1:
        earlier = (W.partitionBy(*(keys or [F.lit(0)])).orderBy(value)
                   .rowsBetween(W.unboundedPreceding, -1))
        return tallies.withColumn("before", F.coalesce(F.sum("cnt").over(earlier), F.lit(0)))

    if keys and n_keys is None:
        n_keys = df.select(*keys).distinct().count()
    ranges = max(2, min(ranges, BOUND_CELLS // max(1, n_keys or 1)))
    plain = df.select(*keys, value) if plain is None else plain
    cut = _value_ranges(plain, keys, value, ranges).collect()
    place = _place([np.array(r["bounds"]) for r in cut], df)
    if keys:
        fields = [df.schema[k] for k in keys]
        numbers = F.broadcast(df.sparkSession.createDataFrame(
            [(*r[:-1], i) for i, r in enumerate(cut)],
            T.StructType([*fields, T.StructField("__key", T.IntegerType())])))
        tallies, plain = tallies.join(numbers, keys), plain.join(numbers, keys)
    else:
        tallies, plain = tallies.withColumn("__key", F.lit(0)), plain.withColumn("__key", F.lit(0))
    at = place(F.col("__key"), F.col(value)).alias("__range")
    within = tallies.select("*", at)
    # the rows of a range are counted as they are read, not from a second table of values
    sizes = plain.select("__key", at).groupBy("__key", "__range").agg(F.count(F.lit(1)).alias("__size"))
    earlier_ranges = (W.partitionBy("__key").orderBy("__range")
                      .rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("__key", "__range", F.coalesce(
        F.sum("__size").over(earlier_ranges), F.lit(0)).alias("__offset"))
    earlier = (W.partitionBy("__key", "__range").orderBy(value)
               .rowsBetween(W.unboundedPreceding, -1))
    return (within.withColumn("before", F.coalesce(F.sum("cnt").over(earlier), F.lit(0)))
            .join(F.broadcast(offsets), ["__key", "__range"])
            .withColumn("before", F.col("before") + F.col("__offset"))
            .drop("__range", "__offset", "__key"))


def _before_by_partitions(tallies: DataFrame, keys: list[str], value: str, range_rows: int) -> DataFrame:
    """``tallies`` with ``before``, for values of any type that sorts, in range partitions.

    Partitions run along (keys, value), so a key that holds most of the values is cut
    as well; what a key has in earlier partitions is one number for each of them. They
    are written, so that a recomputed sample cannot move their bounds.
    """
    spark, path = tallies.sparkSession, scratch_path(tallies.sparkSession, "ranges")
    tallies.write.parquet(f"{path}/tallies")
    tallies = spark.read.parquet(f"{path}/tallies")
    parts = max(1, math.ceil(tallies.count() / range_rows))
    tallies.repartitionByRange(parts, *keys, value).withColumn(
        "__range", F.spark_partition_id()).write.parquet(f"{path}/ranged")
    within = spark.read.parquet(f"{path}/ranged")
    earlier_ranges = (W.partitionBy(*(keys or [F.lit(0)])).orderBy("__range")
                      .rowsBetween(W.unboundedPreceding, -1))
    offsets = within.groupBy(*keys, "__range").agg(F.sum("cnt").alias("__size")).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__at"),
        F.coalesce(F.sum("__size").over(earlier_ranges), F.lit(0)).alias("__offset"))
    earlier = (W.partitionBy(*keys, "__range").orderBy(value)
               .rowsBetween(W.unboundedPreceding, -1))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys],
                  F.col("__range") == F.col("__at"))
    return (within.withColumn("before", F.coalesce(F.sum("cnt").over(earlier), F.lit(0)))
            .join(offsets, same).withColumn("before", F.col("before") + F.col("__offset"))
            .select(*tallies.columns, "before"))


def average_rank() -> Column:
    """Rank with ties averaged, from ``before`` and ``cnt``."""
    return F.col("before") + (F.col("cnt") + 1) / 2


def ranked(df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False,
           alias: str = "rank") -> DataFrame:
    """Average-tie rank column for small tables (features, importances)."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    keys = list(by) or [F.lit(0)]
    peers = W.partitionBy(*keys, value)
    rank = F.rank().over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn(alias, rank + (F.count(F.lit(1)).over(peers) - 1) / 2)


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), alias: str = "rank",
                  range_rows: int | None = None) -> DataFrame:
    """``ranked``, ascending, for tables of any size, with no group or value held by one task.

    Rows whose value or group is null have no rank.
    """
    on = [*by, value]
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
    rows = df.filter(known).count()
    table = counts_before(df.filter(known).select(*on), by, value, rows, range_rows=range_rows)
    placed = attach_by_value(df.filter(known), table.select(*on, "cnt", average_rank().alias(alias)),
                             on, rows, rows)
    return placed.drop("cnt").unionByName(
        df.filter(~known).withColumn(alias, F.lit(None).cast("double")))


def salted(df: DataFrame) -> DataFrame:
    """Rows dealt to ``__salt`` 0 to SALTS - 1 by their content, the same when recomputed."""
    return df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))


def repeated(table: DataFrame) -> DataFrame:
    """Each row once for every ``__salt``."""
    return table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def attach_by_value(long: DataFrame, table: DataFrame, keys: Sequence[str], rows: int,
                    cells: int) -> DataFrame:
    """Join the per-value ``table`` back to the rows it was computed from.

    ``rows`` per key and ``cells`` in all bound the table. A small table is
    broadcast. Otherwise the values holding more than 1/1000 of the rows (at most
    1000 per key) are broadcast and the rest is a shuffle join without hot keys. With
    too many keys for that, values of more than 1/32 of the rows are looked up salted.
    The table is then written, since hot and other values are read from it apart.
    """
    on = list(keys)
    if cells <= BROADCAST_CELLS:
        return long.join(F.broadcast(table), on)
    spark, path = table.sparkSession, scratch_path(table.sparkSession, "values")
    table.write.parquet(path)
    table = spark.read.parquet(path)
    wide = cells // max(1, rows) * HOT_SHARE > BROADCAST_CELLS
    cut = max(1, rows // (WIDE_SHARE if wide else HOT_SHARE))
    hot, cold = table.filter(F.col("cnt") > cut), table.filter(F.col("cnt") <= cut)
    if wide:
        met, dealt, by = salted(long), repeated(hot), [*on, "__salt"]
    else:
        met, dealt, by = long, F.broadcast(hot), on
    cold_part = met.join(dealt.select(*by), by, "left_anti").drop("__salt").join(cold, on)
    hot_part = met.join(dealt, by).drop("__salt")
    return cold_part.unionByName(hot_part)


def rank_spots(obs: Observations, rows: int, range_rows: int | None = None) -> DataFrame:
    """``(row_id, spots)``: for the target (position 0) and each feature the integer
    ``2·before + cnt``, which is twice the average rank less one.

    Kept as integers so that bins cut from it fall alike everywhere. Fails if a key
    stands for several rows, or a value has found no place.
    """
    width = len(obs.names) + 1
    joined = obs.df.select("row_id", F.posexplode(
        F.concat(F.array(F.col("y").cast("double")), F.col("features"))).alias("idx", "value"))
    cells = rows * (len(obs.names) + 1)
    places = counts_before(joined, ["idx"], "value", rows, range_rows=range_rows,
                           n_keys=len(obs.names) + 1)
    table = places.select("idx", "value", "cnt",
                          (F.col("before") * 2 + F.col("cnt")).cast("bigint").alias("spot"))
    return (attach_by_value(joined, table, ["idx", "value"], rows, cells)
            .groupBy("row_id")
            .agg(F.array_sort(F.collect_list(F.struct("idx", "spot"))).alias("cells"))
            .withColumn("cells", F.when(F.size("cells") == width, F.col("cells")).otherwise(
                F.raise_error(F.concat(F.lit("row_id is not unique or a rank is missing: "), F.col("row_id").cast("string")))))
            .select("row_id", F.transform("cells", lambda c: c["spot"]).alias("spots")))


def centred_ranks(spots: DataFrame, rows: int) -> DataFrame:
    """``(row_id, ranks)``: average ranks about their mean, divided by n."""
    return spots.select("row_id", F.transform(
        "spots", lambda s: (s - rows) / (2.0 * rows)).alias("ranks"))


def row_positions(df: DataFrame, order: str, rows: int, by: Sequence[str] = (),
                  range_rows: int | None = None) -> DataFrame:
    """``(*by, order, position)``: 0-based position of each unique ``order`` value."""
    placed = counts_before(df.select(*by, order), by, order, rows, range_rows=range_rows)
    return placed.select(*by, order, F.col("before").cast("bigint").alias("position"))
