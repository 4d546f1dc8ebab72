"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns several points of a ring; a row stands at the hash of its id and goes
to the next point clockwise. A shard that is full passes rows on to the next shard
clockwise that has room. Capacities are the row count shared out evenly, so in the end
every shard is exactly full: counts differ by one at most (the law ``rows``).

Who is passed on depends only on how many rows each arc (the stretch before a point)
holds: arcs are filled in ring order, the rows of an arc by hash and id. So the driver
plans with one count per arc, and the rows learn their place from their rank in the arc.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldscope.session import scratch_path

POINTS = 64


def _place(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def ring(shards: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Points of the ring in order, and the shard each belongs to."""
    found = sorted((_place(f"shard {s} point {p}"), s) for s in range(shards) for p in range(points))
    return np.array([x for x, _ in found], np.int64), np.array([s for _, s in found], np.int32)


def fill(counts: list[int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) of all rows, from the rows of each arc.

    Hop by hop: each arc offers the rows it still has to its next shard clockwise,
    which takes as many as it has room for.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, taken, out = [0] * shards, [0] * len(counts), []
    order = []
    for a in range(len(counts)):
        seen: list[int] = []
        for s in owner[a:] + owner[:a]:
            if s not in seen:
                seen.append(s)
                if len(seen) == shards:
                    break
        order.append(seen)
    for hop in range(shards):
        for a, n in enumerate(counts):
            s = order[a][hop] if hop < len(order[a]) else None
            if s is None or taken[a] == n:
                continue
            k = min(n - taken[a], room[s] - used[s])
            if k > 0:
                out.append((a, taken[a], taken[a] + k, s, used[s]))
                taken[a] += k
                used[s] += k
    return out


def shard(documents: DataFrame, *, shards: int = 16, points: int = POINTS, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text and 1), text_crc32, shard and slot of every row.

    The same table and number of shards give the same shards, however it is partitioned.
    A null text counts as empty; a null id hashes as such. Rows with equal ids, or a hot
    group of equal texts, are split like any others. An empty table gives no rows.
    """
    spark = documents.sparkSession
    spots, owner = ring(shards, points)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))
    rows = documents.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(whole) + 1).cast("bigint").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint").alias("spot"))
    placed = rows.repartitionByRange("spot", "doc_id", "text_crc32", "size").sortWithinPartitions(
        "spot", "doc_id", "text_crc32", "size")

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(len(spots), np.int64)
        for batch in batches:
            at = np.searchsorted(spots, batch.column(3).to_numpy()) % len(spots)
            order, found = np.argsort(at, kind="stable"), np.bincount(at, minlength=len(spots))
            rank = np.empty(len(at), np.int64)
            rank[order] = np.arange(len(at)) - np.repeat(np.cumsum(found) - found, found)
            rank += seen[at]
            seen += found
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(at, pa.int32()), pa.array(np.full(len(at), part), pa.int32()),
                 pa.array(rank, pa.int64())], names=["doc_id", "size", "text_crc32", "arc", "part", "rank"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    path = scratch_path(spark, "ring")
    placed.mapInArrow(number, f"doc_id {kind}, size bigint, text_crc32 bigint, arc int, part int, rank bigint"
                      ).write.parquet(path)
    known = spark.read.parquet(path)
    # rows of a partition are one stretch of the ring, so this has a row per partition and arc at most
    stretches = sorted(tuple(r) for r in known.groupBy("arc", "part").count().collect())
    counts, before = [0] * len(spots), []
    # arc 0 also has the rows behind the last point; they come in the last partitions
    for arc, part, n in stretches:
        before.append((arc, part, counts[arc]))
        counts[arc] += n
    plan = fill(counts, owner.tolist(), shards)
    offsets = spark.createDataFrame(before or [(-1, -1, 0)], "arc int, part int, before bigint")
    pieces = spark.createDataFrame(plan or [(-1, 0, 0, 0, 0)], "arc int, low bigint, high bigint, shard int, base bigint")
    ranked = known.join(F.broadcast(offsets), ["arc", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    return (ranked.join(F.broadcast(pieces), "arc").where("rank >= low and rank < high")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot")))
