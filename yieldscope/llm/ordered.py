"""Positions and running sums along sorted groups, however large a group is.

Rows are sorted over range partitions ("slices"), so a group may lie in several of them.
Each slice runs along its own rows; what the slices before it hold of its first group is
one small record for each slice, which alone comes to the driver and is added on reading.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Run:
    """State of the group at hand: rows so far, and the sums of value * base^row of its rows."""

    def __init__(self, width: int, base: int):
        self.group, self.count, self.sums, self.base = None, 0, [0] * width, base

    def add(self, groups: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(row number in its group from 0, sums up to and with each row) of sorted rows."""
        n = len(groups)
        fresh = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        going = self.count if groups[0] == self.group else 0
        first = np.repeat(fresh, np.diff(np.append(fresh, n)))
        rank = np.arange(n) - first
        rank[first == 0] += going
        scale = _powers(self.base, int(rank.max()) + 1)[rank] if self.base != 1 else np.uint64(1)
        out = []
        for i, v in enumerate(values):
            total = np.cumsum(v.astype(np.uint64) * scale, dtype=np.uint64)
            before = np.where(first > 0, total[first - 1], np.uint64(0))
            total = total - before
            if going:
                total[first == 0] += np.uint64(self.sums[i])
            out.append(total)
        self.group, self.count, self.sums = groups[-1], int(rank[-1]) + 1, [int(t[-1]) for t in out]
        return rank, out


def running(rows: DataFrame, group: str, order: list, path: str, values: tuple[str, ...] = (), base: int = 1,
            cut: list | None = None) -> DataFrame:
    """``rows`` with ``rank__`` (from 0) and ``sum_<value>`` along ``order`` in each group.

    Sums are those of value * base^rank with 64-bit wrap-around, the row itself included.
    ``group`` is a bigint column without nulls and the first of the order; ``cut`` may name
    coarser columns to deal rows out by (their order must agree with ``order``). The table
    is written to ``path``; ``slice__`` tells the slices apart.
    """
    spark = rows.sparkSession
    columns = rows.columns
    at, places = columns.index(group), [columns.index(v) for v in values]
    made = ["slice__", "lead__", "rank__", *(f"sum_{v}" for v in values)]

    def run(batches):
        from pyspark import TaskContext

        state, number, lead = _Run(len(places), base), TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(at).to_numpy()
            lead = groups[0] if lead is None else lead
            rank, sums = state.add(groups, [batch.column(p).to_numpy() for p in places])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(groups), number, np.int32)), pa.array(groups == lead),
                 pa.array(rank.astype(np.int64)), *[pa.array(s.view(np.int64)) for s in sums]], names=[*columns, *made])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    kind += ", slice__ int, lead__ boolean, rank__ bigint" + "".join(f", sum_{v} bigint" for v in values)
    (rows.repartitionByRange(*(cut or order)).sortWithinPartitions(*order).mapInArrow(run, kind).write.parquet(path))
    written = spark.read.parquet(path)
    last = F.struct(F.col(f"`{group}`").alias("group"), F.col("rank__").alias("rank"),
                    *[F.col(f"sum_{v}").alias(f"sum_{v}") for v in values])
    ends = written.groupBy("slice__").agg(F.min(f"`{group}`").alias("first"), F.max(last).alias("last")).orderBy("slice__")
    carried, held, count, sums = [], None, 0, [0] * len(values)
    for row in ends.collect():  # one record for each slice
        same = row["first"] == held
        if same:
            carried.append((row["slice__"], count, [s - (1 << 64) if s >> 63 else s for s in sums]))
        if not same or row["last"]["group"] != held:
            count, sums = 0, [0] * len(values)
        factor = pow(base, count, 1 << 64)
        sums = [(s + factor * (row["last"][f"sum_{v}"] & _MASK)) & _MASK for s, v in zip(sums, values)]
        held, count = row["last"]["group"], count + row["last"]["rank"] + 1
    if not carried:
        return written
    known = {s: (c, np.array(t, np.int64).view(np.uint64)) for s, c, t in carried}
    names = written.columns
    where = [names.index(c) for c in made]

    def add(batches):
        for batch in batches:
            slices, lead = batch.column(where[0]).to_numpy(), batch.column(where[1]).to_numpy(zero_copy_only=False)
            out = list(batch.columns)
            rank = batch.column(where[2]).to_numpy().copy()
            sums = [batch.column(w).to_numpy().copy().view(np.uint64) for w in where[3:]]
            for s in np.unique(slices[lead]):
                if int(s) in known:
                    count, before = known[int(s)]
                    here = lead & (slices == s)
                    rank[here] += count
                    factor = np.uint64(pow(base, count, 1 << 64))
                    for total, b in zip(sums, before):
                        total[here] = total[here] * factor + b
            out[where[2]] = pa.array(rank)
            for w, total in zip(where[3:], sums):
                out[w] = pa.array(total.view(np.int64))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return written.mapInArrow(add, written.schema)
