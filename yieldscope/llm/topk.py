"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers. A block of rows is kept as bit slices: slice i of a
dimension is a bitmap over the block's rows. With every dimension shifted to be
non-negative (and complemented where a digit of the query is negative, so that nothing
is ever subtracted), a query's score is a sum of slices times powers of two: the slices of equal
weight are added up by carry-save adders on bitmaps, which leaves the bit slices of the
score. From the most significant slice downward the k best rows are selected; rows equal
in all slices are the boundary, and ties there go to the smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldscope.session import scratch_path

#: Rows of a block of the index, queries packed together, and such packs that meet all blocks at once.
ROWS, QUERIES, PACKS = 8192, 512, 16


def quantise(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null unless all are finite numbers."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                    & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, whole)


def slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest value, number of slices of each dimension, all slices as rows of 64-bit words)."""
    low = values.min(axis=0)
    shifted = (values - low).astype(np.uint64)
    depth = np.array([int(m).bit_length() for m in shifted.max(axis=0)], np.int64)
    words = -(-len(values) // 64)
    out = np.zeros((int(depth.sum()), words * 8), np.uint8)
    at = 0
    for d, n in enumerate(depth):
        for i in range(n):
            bits = np.packbits(((shifted[:, d] >> np.uint64(i)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            out[at, : len(bits)] = bits
            at += 1
    return low, depth, out.view(np.uint64)


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(power of two, 1 if subtracted) of the sparsest sum of signed powers that gives the value."""
    out, at = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((at, int(digit < 0)))
            value -= digit
        value >>= 1
        at += 1
    return out


def add_slices(query: np.ndarray, depth: np.ndarray, bitmaps: np.ndarray, full: np.ndarray) -> list[np.ndarray]:
    """Bit slices, from the least, of the sum over the block of 2^j * (v or, for a digit that is
    subtracted, the complement of v) for all signed digits j of the query."""
    first = np.cumsum(depth) - depth
    pending: dict[int, list[np.ndarray]] = {}
    for d in np.flatnonzero(query):
        for j, negative in signed_digits(int(query[d])):
            for i in range(int(depth[d])):
                pending.setdefault(i + j, []).append((int(first[d]) + i) * 2 + negative)
    stacks: dict[int, np.ndarray] = {}
    for w, picks in pending.items():
        picks = np.array(picks)
        stack = bitmaps[picks >> 1]
        stack[(picks & 1) == 1] ^= full
        stacks[w] = stack
    out, w = [], 0
    while stacks:
        stack = stacks.pop(w, None)
        if stack is None:
            out.append(np.zeros_like(full))
            w += 1
            continue
        carried = [stacks[w + 1]] if w + 1 in stacks else []
        while len(stack) > 1:
            n = max(1, len(stack) // 3)
            a, b = stack[:n], stack[n:2 * n]
            if len(stack) == 2:
                carried.append(a & b)
                stack = a ^ b
                continue
            c, half = stack[2 * n:3 * n], a ^ b
            carried.append((a & b) | (half & c))
            stack = np.concatenate([half ^ c, stack[3 * n:]])
        if carried:
            stacks[w + 1] = np.concatenate(carried)
        out.append(stack[0])
        w += 1
    return out


def select(score: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Rows (by place) that hold the k highest scores among the allowed; boundary ties by place."""
    sure, equal = np.zeros_like(allowed), allowed.copy()
    count = lambda x: int(np.bitwise_count(x).sum())
    have = 0
    for s in reversed(score):
        higher = equal & s
        n = count(higher)
        if have + n > k:
            equal = higher
        else:
            sure |= higher
            have += n
            equal &= ~s
            if have == k:
                equal = np.zeros_like(equal)
                break
    places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    return np.concatenate([places(sure), places(equal)[: k - have]])


def _sorted_rows(pdf) -> tuple:
    """(ids, vectors as integers, how often each row stands in the table), by id and vector."""
    values = np.stack([np.asarray(v, np.int64) for v in pdf["v"]])
    ids = pdf["vec_id"].to_numpy(np.int64)
    order = np.lexsort((*values.T[::-1], ids))
    return ids[order], values[order], pdf["times"].to_numpy(np.int64)[order]


def _index(pdf):
    import pandas as pd

    ids, values, times = _sorted_rows(pdf)
    low, depth, bitmaps = slices(values)
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "dims": [values.shape[1]], "n": [len(values)],
                         "ids": [ids.tobytes()], "times": [times.tobytes()], "low": [low.tobytes()],
                         "depth": [depth.tobytes()], "slices": [bitmaps.tobytes()]})


def _pack(pdf):
    import pandas as pd

    ids, values, times = _sorted_rows(pdf)
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "dims": [values.shape[1]], "q_ids": [ids.tobytes()],
                         "q_times": [times.tobytes()], "q": [values.tobytes()]})


def top_of_block(query_id: int, q: np.ndarray, ids: np.ndarray, low: np.ndarray, depth: np.ndarray,
                 bitmaps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row places, scores) of the block's k best rows for a query, rows with its own id left out."""
    full = np.frombuffer(np.packbits(np.arange(bitmaps.shape[1] * 64) < len(ids), bitorder="little").tobytes(), np.uint64)
    score = add_slices(q, depth, bitmaps, full)
    allowed = full.copy()
    for own in range(int(np.searchsorted(ids, query_id)), int(np.searchsorted(ids, query_id, side="right"))):
        allowed[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
    rows = select(score, allowed, k)
    bits = np.array([(s[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1) for s in score], np.int64)
    total = (bits << np.arange(len(score))[:, None]).sum(axis=0) if len(score) else np.zeros(len(rows), np.int64)
    # -v = (2^depth - 1 - v) - (2^depth - 1), for every subtracted digit
    taken = np.array([sum(1 << j for j, negative in signed_digits(int(x)) if negative) for x in q], np.int64)
    shift = int((q * low).sum() - (taken * ((1 << depth) - 1)).sum())
    return rows, total + shift


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, vec_id: str = "vec_id",
          vector: str = "embedding", scale: int = 1024, rows: int = ROWS, batch: int = QUERIES, packs: int = PACKS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows but its own.

    The index is written to the shared folder, block by block, and read once for every
    ``packs`` packs of queries, which are broadcast to it (``packs`` * ``batch`` vectors at
    most); no block is shuffled again. Every row is indexed, whatever its id: rows that
    share an id are rows of their own, and all rows with the query's id are its own. Rows
    that repeat id and vector are held once, with their number, and ranked that often.
    Vectors that are null or hold anything but finite numbers take no part, and neither do
    rows without id. Vectors meet those of their own length only. Scores are 64-bit
    integers; components must leave their sums room there.
    """
    from pyspark.sql import Window

    spark = vectors.sparkSession

    def clean(df, name):
        (df.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), quantise(F.col(f"`{vector}`"), scale).alias("v"))
         .where("vec_id is not null and v is not null").groupBy("vec_id", "v").agg(F.count("*").alias("times"))
         .write.parquet(f"{path}/{name}"))
        return spark.read.parquet(f"{path}/{name}")

    path = scratch_path(spark, "slices")
    found = clean(vectors, "rows")
    blocks = max(1, -(-found.count() // rows))
    (found.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
     .groupBy("block", F.size("v").alias("size")).applyInPandas(
        _index, "block bigint, dims int, n int, ids binary, times binary, low binary, depth binary, slices binary")
     .write.parquet(f"{path}/index"))
    asked = clean(queries, "asked")
    parts = max(1, -(-asked.count() // batch))
    (asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "v", F.lit(7)), F.lit(parts)))
     .groupBy("part", F.size("v").alias("size")).applyInPandas(
        _pack, "part bigint, dims int, q_ids binary, q_times binary, q binary").write.parquet(f"{path}/packs"))
    index, asks = spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/packs")

    def answer(batches):
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples():
                ids, times, low, depth = (np.frombuffer(x, np.int64) for x in (row.ids, row.times, row.low, row.depth))
                bitmaps = np.frombuffer(row.slices, np.uint64).reshape(int(depth.sum()), -(-len(ids) // 64))
                asked, twice = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_times, np.int64)
                out = []
                for i, n, q in zip(asked.tolist(), twice.tolist(), np.frombuffer(row.q, np.int64).reshape(-1, row.dims)):
                    at, score = top_of_block(i, q, ids, low, depth, bitmaps, k)
                    out.append(pd.DataFrame({"query_id": i, "vec_id": ids[at], "score": score, "times": n * times[at]}))
                if out:
                    yield pd.concat(out)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(df):
        # the k first of those that stand several times are found among their k first copies
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    for first in range(0, parts, packs):
        some = F.broadcast(asks.where((F.col("part") >= first) & (F.col("part") < first + packs)))
        met = index.join(some, "dims").mapInPandas(answer, "query_id bigint, vec_id bigint, score bigint, times bigint")
        copies = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("times", F.lit(k).cast("bigint")))))
        best(copies.select("query_id", "vec_id", "score")).write.parquet(f"{path}/best/{first}")
    told = spark.read.schema("query_id bigint, vec_id bigint, score bigint, rank int").parquet(
        *[f"{path}/best/{first}" for first in range(0, parts, packs)])
    # a query's rows may be in several packs, when its id stands in several rows
    return best(told.drop("rank")).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
