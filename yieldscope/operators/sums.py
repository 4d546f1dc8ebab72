"""Sums of whole arrays that partitions hand in: two levels of merging, one record an array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES = 16      # merges of the first level, which each take a share of the partitions


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key; arrays are added as they come, only one sum is held."""
    names = [*keys, "v"]
    kinds = parts.schema
    fields = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, types = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], t) for k, t in zip((*key, total), types)], names=names)

        for batch in batches:
            types = batch.schema.types
            if batch.num_rows == 0:
                continue
            heads = list(zip(*(c.to_pylist() for c in batch.columns[:-1])))
            arrays = batch.column(len(keys))
            for i, head in enumerate(heads):
                value = arrays[i].values.to_numpy(zero_copy_only=False)
                if head == key:
                    total += value
                else:
                    if key is not None:
                        yield out()
                    key, total = head, value.copy()
        if key is not None:
            yield out()

    return parts.select(*names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, fields)


def merged(parts: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """``(*keys, v)``: the sum of the arrays ``v`` of each key, whatever the number of partitions.

    Where the caller knows that there are few ``partitions``, one level does.
    """
    if partitions is not None and partitions <= 4 * LANES:
        return _added(parts, keys)
    lane = F.pmod(F.spark_partition_id(), F.lit(LANES))
    return _added(_added(parts.withColumn("lane", lane), [*keys, "lane"]), keys)


def collected(parts: DataFrame, keys: list[str]) -> dict[tuple, np.ndarray]:
    """The same on the driver, for few keys and arrays that it can hold ``LANES`` times."""
    lane = F.pmod(F.spark_partition_id(), F.lit(LANES))
    table = _added(parts.withColumn("lane", lane), [*keys, "lane"]).toArrow()
    out: dict[tuple, np.ndarray] = {}
    for i, key in enumerate(zip(*(table.column(k).to_pylist() for k in keys))):
        value = table.column("v")[i].values.to_numpy(zero_copy_only=False)
        out[key] = out[key] + value if key in out else value
    return out
