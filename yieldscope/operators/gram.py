"""Sums of products of all feature pairs: the one data pass behind every linear model.

The p × p table is a block matrix: a partition adds up its block products, whole blocks
are merged in two levels, and consumers read them where they lie. Only models on up to
``MAX_WIDTH`` columns put a table together on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldscope.operators.sums import collected, merged

MAX_WIDTH = 2_000   # columns of a table that the driver puts together
BLOCK = 512         # columns of a block
HELD = 128 << 20    # bytes of block sums that a task holds


def _block_pairs(width: int) -> list[tuple[int, int]]:
    blocks = range(-(-width // BLOCK))
    return [(i, j) for i in blocks for j in blocks if i <= j]


def product_blocks(df: DataFrame, vector: Column, width: int, part: Column | None = None, parts: int = 1) -> DataFrame:
    """``(part, bi, bj, v)`` for bi ≤ bj, a row for each block that one partition has summed.

    ``v`` is the product of two column blocks of ``vector`` (of ``width`` numbers), row by
    row. Where the blocks of all ``parts`` are more than a task should hold, the rows are
    read once for each share of the block pairs.
    """
    source = df.select((F.lit(0) if part is None else part).cast("int").alias("part"), vector.alias("z"))
    pairs = _block_pairs(width)
    share = max(1, HELD // (8 * BLOCK * BLOCK * parts))

    def some(mine: list[tuple[int, int]]) -> DataFrame:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int, int], np.ndarray] = {}
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                group = batch.column("part").to_numpy(zero_copy_only=False)
                z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for p in np.unique(group).tolist():
                    rows = z[group == p]
                    for i, j in mine:
                        made = rows[:, i * BLOCK:(i + 1) * BLOCK].T @ rows[:, j * BLOCK:(j + 1) * BLOCK]
                        held = sums.get((p, i, j))
                        if held is None:
                            sums[p, i, j] = made
                        else:
                            held += made
            for (p, i, j), block in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()),
                     pa.array([block.ravel()], pa.list_(pa.float64()))], names=["part", "bi", "bj", "v"])

        return source.mapInArrow(partial, "part int, bi int, bj int, v array<double>")

    return reduce(DataFrame.unionByName, (some(pairs[at:at + share]) for at in range(0, len(pairs), share)))


def vector_width(df: DataFrame, vector: Column) -> int:
    """Numbers in the vectors of ``df``; 0 without rows."""
    one = df.select(F.size(vector).alias("n")).first()
    return one["n"] if one is not None else 0


def product_sums(df: DataFrame, vector: Column, part: Column | None = None, parts: int = 1) -> DataFrame:
    """``(part, i, j, s)`` with ``s = Σ z_i z_j`` for i ≤ j, where z is ``vector``."""
    width = vector_width(df, vector)
    blocks = merged(product_blocks(df, vector, width, part, parts), ["part", "bi", "bj"])
    columns = F.least(F.lit(BLOCK), F.lit(width) - F.col("bj") * BLOCK)
    cells = blocks.select("part", "bi", "bj", columns.alias("columns"), F.posexplode("v").alias("at", "s"))
    return cells.select("part", (F.col("bi") * BLOCK + F.floor(F.col("at") / F.col("columns"))).cast("int").alias("i"),
                        (F.col("bj") * BLOCK + F.col("at") % F.col("columns")).cast("int").alias("j"), "s").where("i <= j")


@dataclass(frozen=True)
class Gram:
    """Product sums of ``[1, x_1 … x_p, y]`` for one set of rows."""

    table: np.ndarray

    @property
    def n(self) -> float:
        return self.table[0, 0]

    @property
    def width(self) -> int:
        return len(self.table) - 2

    @property
    def xx(self) -> np.ndarray:
        return self.table[1:-1, 1:-1]

    @property
    def xy(self) -> np.ndarray:
        return self.table[1:-1, -1]

    @property
    def yy(self) -> float:
        return self.table[-1, -1]

    @property
    def sst(self) -> float:
        """Total sum of squares of the target about its mean."""
        return self.yy - self.table[0, -1] ** 2 / self.n

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.table + other.table)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.table - other.table)

    def keep(self, features) -> Gram:
        at = [0, *[1 + int(f) for f in features], len(self.table) - 1]
        return Gram(self.table[np.ix_(at, at)])

    def unit_columns(self, norms: np.ndarray) -> Gram:
        """The table after dividing feature j by ``norms[j]``."""
        scale = np.concatenate([[1.0], 1.0 / norms, [1.0]])
        return Gram(self.table * np.outer(scale, scale))

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """``XᵀX`` and ``Xᵀy`` about the means."""
        sums = self.table[0, 1:-1]
        return (self.xx - np.outer(sums, sums) / self.n,
                self.xy - sums * self.table[0, -1] / self.n)


def grams(df: DataFrame, part: Column | None = None) -> dict[int, Gram]:
    """Product sums per part, from rows with ``features`` and ``y``."""
    z = F.concat(F.array(F.lit(1.0)), F.col("features"), F.array(F.col("y").cast("double")))
    width = vector_width(df, z)
    if width > MAX_WIDTH:
        raise ValueError(f"{width} columns exceed the product table's bound; prescreen or screen first")
    out: dict[int, np.ndarray] = {}
    for (p, i, j), v in collected(product_blocks(df, z, width, part), ["part", "bi", "bj"]).items():
        table = out.setdefault(p, np.zeros((width, width)))
        columns = min(BLOCK, width - j * BLOCK)
        block = v.reshape(-1, columns)
        table[i * BLOCK:(i + 1) * BLOCK, j * BLOCK:(j + 1) * BLOCK] = block
        table[j * BLOCK:(j + 1) * BLOCK, i * BLOCK:(i + 1) * BLOCK] = block.T
    return {p: Gram(out[p]) for p in sorted(out)}


def total(tables: dict[int, Gram]) -> Gram:
    return Gram(sum(g.table for g in tables.values()))
