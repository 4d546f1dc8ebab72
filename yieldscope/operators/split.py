"""Train/test splits and folds that do not depend on partitioning or run order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yieldscope.operators.ranks import row_positions


def _digest(seed: int, key: str) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8)


def in_test(frac: float = 0.3, seed: int = 0, key: str = "row_id") -> Column:
    """True for the share ``frac`` of rows, decided by a hash of the key alone."""
    bound = format(int(frac * 2**32), "08x")
    return _digest(seed, key) < bound


def split(df: DataFrame, frac: float = 0.3, seed: int = 0,
          key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """``(train, test)``."""
    test = in_test(frac, seed, key)
    return df.filter(~test), df.filter(test)


def hash_fold(k: int, seed: int = 0, key: str = "row_id") -> Column:
    """Fold 0 … k−1 from a hash of the key: no shuffle, equal shares on average."""
    return (F.conv(_digest(seed, key), 16, 10).cast("bigint") % k).cast("int")


def _block(position: Column, rows: Column, k: int) -> Column:
    """Contiguous block of a position; the first ``rows % k`` blocks are one longer."""
    short = F.floor(rows / k)
    longer = rows % k
    edge = longer * (short + 1)
    return F.when(position < edge, F.floor(position / (short + 1))).otherwise(
        longer + F.floor((position - edge) / F.greatest(short, F.lit(1)))).cast("int")


def contiguous_fold(df: DataFrame, k: int, rows: int, key: str = "row_id",
                    range_rows: int | None = None) -> DataFrame:
    """Add ``fold``: k unshuffled blocks in the order of the unique key."""
    placed = row_positions(df, key, rows, range_rows=range_rows)
    fold = placed.select(key, _block(F.col("position"), F.lit(rows), k).alias("fold"))
    return df.join(fold, key)


def stratified_fold(df: DataFrame, k: int, rows: int, label: str = "label", key: str = "row_id",
                    range_rows: int | None = None) -> DataFrame:
    """Add ``fold``: unshuffled blocks that keep the class shares.

    Classes are laid end to end, in order of first appearance; dealing the
    positions of that sequence to the folds in turn fixes how many rows of each
    class every fold takes. The rows then fill those shares in key order.
    """
    placed = row_positions(df, key, rows, by=[label], range_rows=range_rows)
    classes = placed.groupBy(label).agg(F.count(F.lit(1)).alias("size"), F.min(key).alias("first"))
    earlier = W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)   # one row per class
    start = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    shares = classes.select(label, "size", start.alias("start")).select(label, F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda f: (F.floor((F.col("start") + F.col("size") - 1 - f + k) / k)
                   - F.floor((F.col("start") - 1 - f + k) / k))).alias("shares"))
    # last position (exclusive) of every fold within the class
    ends = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.aggregate(
        F.slice("shares", 1, j), F.lit(0).cast("bigint"), lambda acc, s: acc + s))
    table = shares.select(label, ends.alias("ends"))
    fold = (placed.join(F.broadcast(table) if _few(table) else table, label)
            .select(key, F.size(F.filter("ends", lambda e: e <= F.col("position"))).alias("fold")))
    return df.join(fold, key)


def _few(table: DataFrame, limit: int = 100_000) -> bool:
    return table.limit(limit + 1).count() <= limit
