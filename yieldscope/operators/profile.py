"""Per-feature statistics in long form: one row per feature, never per-column plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yieldscope.sources.observations import Observations

ACCURACY = 2_000   # of the sketches that bracket quantiles; a bracket holds about 4/ACCURACY of a key's rows
FEW_ROWS = 10      # keys of fewer rows than this times ACCURACY need no bracket


def moments(obs: Observations) -> DataFrame:
    """``(idx, n, nulls, mean, std, std_pop, lo, hi)`` in one pass with map-side combine."""
    v = F.col("value")
    return obs.long().groupBy("idx").agg(
        F.count(v).alias("n"),
        (F.count(F.lit(1)) - F.count(v)).alias("nulls"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.stddev_pop(v).alias("std_pop"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
    )


def quartiles(long: DataFrame, key: str, rows_per_key: int) -> DataFrame:
    """``(key, q25, q50, q75)``, linearly interpolated and exact."""
    return quantiles(long, key, rows_per_key, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def _bracketed(known: DataFrame, key: str, rows_per_key: int, shares: list[float]):
    """``(key, gap, kept, cnt)`` and ``(key, total)``: values in a bracket of a share with their counts.

    The rest is counted by gap with a null for the value, which comes first in its gap.
    """
    total, value = F.count(F.lit(1)).alias("total"), F.col("value")
    if rows_per_key < FEW_ROWS * ACCURACY:
        totals = known.groupBy(key).agg(total)
        marked = known.select(key, F.lit(0).alias("gap"), value.alias("kept"))
    else:
        slack = 2 / ACCURACY
        probes = [min(1.0, max(0.0, p + side)) for p in shares for side in (-slack, slack)]
        totals = known.groupBy(key).agg(total, F.percentile_approx("value", probes, ACCURACY).alias("edge"))
        few = F.col("total") < FEW_ROWS * ACCURACY
        low = [F.when(few | F.lit(p <= slack), F.lit(float("-inf"))).otherwise(F.col("edge")[2 * i])
               for i, p in enumerate(shares)]
        high = [F.when(few | F.lit(p >= 1 - slack), F.lit(float("nan"))).otherwise(F.col("edge")[2 * i + 1])
                for i, p in enumerate(shares)]                       # NaN is above all numbers
        inside = reduce(Column.__or__, [value.between(a, b) for a, b in zip(low, high)])
        gap = reduce(Column.__add__, [(b < value).cast("int") for b in high])
        marked = known.join(F.broadcast(totals), key).select(key, gap.alias("gap"), F.when(inside, value).alias("kept"))
    return marked.groupBy(key, "gap", "kept").agg(F.count(F.lit(1)).alias("cnt")), totals.select(key, "total")


def quantiles(long: DataFrame, key: str, rows_per_key: int, shares: dict[str, float]) -> DataFrame:
    """``key`` and one column for each named share, linearly interpolated and exact.

    A sketch of each key brackets the wanted positions, with twice the error it may have.
    Only values inside a bracket are then shuffled, the others as one count for each gap
    between brackets. The value at an ordered position is the one whose run of positions
    covers it. Keys of few rows are one bracket. No group is held in memory, unlike the
    built-in exact percentile. ``rows_per_key`` bounds the rows any key can have.
    """
    named = sorted(shares.items(), key=lambda item: item[1])
    cells, totals = _bracketed(long.filter("value IS NOT NULL").select(key, "value"), key,
                               rows_per_key, [p for _, p in named])
    earlier = W.partitionBy(key).orderBy("gap", "kept").rowsBetween(W.unboundedPreceding, -1)
    runs = (cells.withColumn("before", F.coalesce(F.sum("cnt").over(earlier), F.lit(0)))
            .join(F.broadcast(totals), key))
    out = []
    for label, share in named:
        spot = (F.col("total") - 1) * share
        for edge, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            covers = (F.col("before") <= at) & (at < F.col("before") + F.col("cnt"))
            out.append(F.max(F.when(covers, F.col("kept"))).alias(f"{label}_{edge}"))
        out.append(F.max(spot - F.floor(spot)).alias(f"{label}_w"))
    edges = runs.groupBy(key).agg(*out)
    there = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("a bracket has missed its position")).cast("double"))
    return edges.select(key, *[
        (there(f"{q}_lo") + (there(f"{q}_hi") - F.col(f"{q}_lo")) * F.col(f"{q}_w")).alias(q)
        for q in shares])


def describe(obs: Observations, rows: int, approximate: bool = False) -> DataFrame:
    """``(feature, count, mean, std, min, q25, q50, q75, max)`` for every feature."""
    if approximate:
        cut = F.percentile_approx("value", [0.25, 0.5, 0.75], 10000)
        quarts = obs.long().groupBy("idx").agg(cut.alias("q")).select(
            "idx", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))])
    else:
        quarts = quartiles(obs.long(), "idx", rows)
    return (moments(obs).join(quarts, "idx", "left").join(F.broadcast(obs.dictionary()), "idx")
            .select("feature", F.col("n").alias("count"), "mean", "std",
                    F.col("lo").alias("min"), "q25", "q50", "q75", F.col("hi").alias("max")))


def describe_groups(df: DataFrame, key: str, value: str) -> DataFrame:
    """The same eight statistics of one value column per group (importance per feature).

    For small groups such as the rounds of a bootstrap; ``describe`` is the
    operator for observations.
    """
    return df.groupBy(key).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.percentile(value, F.lit(0.25)).alias("q25"),
        F.percentile(value, F.lit(0.5)).alias("q50"),
        F.percentile(value, F.lit(0.75)).alias("q75"),
        F.max(value).alias("max"))


def dataset_shape(df: DataFrame, group_col: str = "GROUP_ID") -> DataFrame:
    """``(has_group, group_size, ratio)``: groups present, distinct groups, columns per row."""
    has_group = group_col in df.columns
    groups = F.count_distinct(F.col(group_col)) if has_group else F.lit(0).cast("bigint")
    return df.agg(F.lit(has_group).alias("has_group"), groups.alias("group_size"),
                  (F.lit(len(df.columns)) / F.count(F.lit(1))).alias("ratio"))


def single_group(obs: Observations) -> bool:
    """True when every row carries the same group. Stops at the second distinct value."""
    return obs.df.select("group_id").distinct().limit(2).count() <= 1
