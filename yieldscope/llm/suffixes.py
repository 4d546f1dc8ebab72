"""Removal of byte strings that also start elsewhere, by suffix arrays of content-made shards.

1. Every window of ``length`` bytes has an anchor: the place in it with the least hash of
   ``GRAM`` bytes (the last of equals). Equal windows have anchors with equal bytes, so
   windows need to meet only under the same anchor hash. Windows of one anchor stand side
   by side; their bytes are a segment. Anchors whose hash occurs once are done.
2. Segments with equal bytes are one, which keeps thousands of copies out of the shards.
   The different segments of an anchor make a shard's text. Its suffix array is made by
   induced sorting (``suffix_array``) and its permuted common prefixes by the irreducible
   ones (``common_prefixes``); a window is repeated if it shares ``length`` bytes with a
   neighbour in the array.
3. An anchor with too many different segments is split exactly: its windows are grouped
   by their distance from the anchor and by the bytes that all windows of that distance
   have in common, at last each distance on its own.
4. Repeated windows are put together to spans of their documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldscope.llm import texts
from yieldscope.session import scratch_path

GRAM = 64
#: Different segments that a shard takes of one anchor; beyond, the anchor is split.
SHARD_SEGMENTS = 300
#: Distances from the anchor that one group spans, step by step as anchors are split.
SPLITS = (32, 1)
SHARD_BYTES, TILE = 1 << 20, 4 << 20


# ---- suffix arrays -------------------------------------------------------------------

def classify(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one behind them; the last is larger (the end is least)."""
    n = len(text)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    rise[-1] = -1
    change = np.where(rise != 0, np.arange(n), n)
    next_change = np.minimum.accumulate(change[::-1])[::-1]
    return rise[next_change] > 0


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes sorted as far as the leftmost-smaller ``seeds`` (in order) are.

    Left to right, each bucket passes its suffixes' larger predecessors to the front of
    their buckets; right to left, the smaller ones to the back. A whole bucket is passed
    on at once, and what it passes to itself in further turns.
    """
    n, size = len(text), int(text.max()) + 1
    count = np.bincount(text, minlength=size)
    first = np.cumsum(count) - count
    out = np.full(n, -1, np.int64)
    head = first.copy()
    by = np.argsort(text[seeds], kind="stable")
    starts = np.searchsorted(text[seeds][by], np.arange(size + 1))
    seeded = [seeds[by[starts[c]:starts[c + 1]]] for c in range(size)]

    def pass_on(found: np.ndarray, here: int, places: np.ndarray, step: int) -> np.ndarray:
        """Append found suffixes to their buckets; returns those of the bucket ``here``."""
        symbols = text[found]
        order = np.argsort(symbols, kind="stable")
        found, symbols = found[order], symbols[order]
        kinds, begin, many = np.unique(symbols, return_index=True, return_counts=True)
        rank = np.arange(len(found)) - np.repeat(begin, many)
        out[places[symbols] + step * rank] = found
        places[kinds] += step * many
        return found[symbols == here]

    # the end of the text comes before everything and passes on the last suffix
    pass_on(np.array([n - 1]), -1, head, 1)
    for c in range(size):
        at = first[c]
        while at < head[c]:
            group, at = out[at:head[c]], head[c]
            before = group[group > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                pass_on(before, c, head, 1)
        group = seeded[c]
        before = group[group > 0] - 1
        if len(before):
            pass_on(before, c, head, 1)
    tail = first + count - 1
    for c in range(size - 1, -1, -1):
        at = first[c] + count[c] - 1
        while True:
            # smaller suffixes of the bucket, from its end, as far as they are known
            low = tail[c]
            if at > low:
                group, at = out[low + 1:at + 1][::-1], low
                before = group[group > 0] - 1
                before = before[smaller[before]]
                if len(before):
                    pass_on(before, c, tail, -1)
                continue
            break
        group = out[first[c]:head[c]][::-1]
        before = group[group > 0] - 1
        before = before[smaller[before]]
        if len(before):
            pass_on(before, c, tail, -1)
    return out


def leftmost(smaller: np.ndarray) -> np.ndarray:
    """Places of smaller suffixes behind larger ones."""
    mark = smaller.copy()
    mark[1:] &= ~smaller[:-1]
    mark[:1] = False
    return np.flatnonzero(mark)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text of small non-negative integers, in order.

    Leftmost-smaller substrings are sorted by one induction, named by rank, and the
    string of names is sorted in turn; its order seeds the second induction. A string
    of many different names, whose buckets would be tiny, is sorted by doubling ranks.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    smaller = classify(text)
    marks = leftmost(smaller)
    if len(marks) > 1:
        rough = induce(text, smaller, marks)
        is_mark = np.zeros(n, bool)
        is_mark[marks] = True
        order = rough[is_mark[rough]]
        ends = np.append(marks[1:], n - 1) + 1
        length = np.zeros(n, np.int64)
        length[marks] = ends - marks
        names = np.zeros(n, np.int64)
        new = np.append(True, ~_same(text, smaller, order[1:], order[:-1], length))
        names[order] = np.cumsum(new) - 1
        reduced = names[marks]
        if new.all():
            ranks = reduced
        elif reduced.max() < 256:
            ranks = np.empty(len(marks), np.int64)
            ranks[suffix_array(reduced)] = np.arange(len(marks))
        else:
            ranks = doubled(reduced)
        seeds = np.empty(len(marks), np.int64)
        seeds[ranks] = marks
    else:
        seeds = marks
    return induce(text, smaller, seeds)


def _same(text, smaller, a, b, length) -> np.ndarray:
    """Whether the substrings at a and b have equal lengths and bytes."""
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        x, y = a[live] + step, b[live] + step
        ok = text[x] == text[y]
        same[live[~ok]] = False
        step += 1
        live = live[ok & (step < length[a[live]])]
    return same


def doubled(names: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of a string of names, by doubling the length they are sorted by."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[:max(0, n - step)] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.append(False, key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
        if rank[order[-1]] == n - 1 or step >= 2 * n:
            return rank


def common_prefixes(text: np.ndarray, order: np.ndarray, stop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(suffix before in order or -1, common prefix with it up to a ``stop``) of every suffix.

    Only where the bytes before the two suffixes differ the prefix is compared; elsewhere
    it is one less than that of the place before.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    own = before < 1
    own[0] = True
    rest = np.flatnonzero(~own)
    left = text[rest - 1]
    own[rest] = (left != text[before[rest] - 1]) | (left == stop)
    prefix = np.zeros(n, np.int64)
    live = np.flatnonzero(own & (before >= 0))
    other = before[live]
    step = 0
    padded = np.append(text, stop)
    while len(live):
        x = padded[live + step]
        ok = (x == padded[np.minimum(other + step, n)]) & (x != stop)
        prefix[live[~ok]] = step
        live, other = live[ok], other[ok]
        step += 1
    last = np.maximum.accumulate(np.where(own, place, 0))
    return before, np.maximum(prefix[last] - (place - last), 0)


def repeated_starts(segments: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each segment the starts of strings of ``length`` that also start elsewhere in any of them."""
    sizes = np.array([len(s) for s in segments], np.int64)
    bounds = np.append(0, np.cumsum(sizes + 1))
    text = np.zeros(int(bounds[-1]), np.int32)
    for s, at in zip(segments, bounds):
        text[at:at + len(s)] = s.astype(np.int32) + 1
    used, small = np.unique(text, return_inverse=True)
    small = small.astype(np.uint8 if len(used) <= 256 else np.int32)
    if used[0] != 0:  # no segments
        return [np.zeros(0, np.int64) for _ in segments]
    before, prefix = common_prefixes(small, suffix_array(small))
    hit = np.zeros(len(text), bool)
    far = np.flatnonzero(prefix >= length)
    hit[far] = True
    hit[before[far]] = True
    return [np.flatnonzero(hit[a:a + n]) for a, n in zip(bounds, sizes)]


# ---- anchors and segments ------------------------------------------------------------

def anchors(offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """(text, anchor hash, place, first start, last start) of every run of windows with one anchor."""
    width = length - gram + 1
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    found = [[np.zeros(0, np.int64)] * 5]
    low = np.uint64((1 << 24) - 1)
    for base in range(0, len(data) if len(long) else 0, TILE):
        part = data[base:base + TILE + length - 1]
        n = len(part) - gram + 1
        count = n - width + 1
        if count < 1:
            break
        sums = texts.prefix_sums(part, texts.byte_values())
        hashes = texts.mix((sums[gram:] - sums[:-gram]) * texts.powers(n)[1][:n])
        keys = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
        keys[:n] = (hashes & ~low) | np.arange(int(low), int(low) - n, -1, dtype=np.uint64)
        rows = keys.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:count], ahead[width - 1:width - 1 + count])
        inside = np.zeros(count + 2, bool)  # windows that lie in one text, a gap between any two texts
        for begin, end in zip((offsets[long] - base).tolist(), (offsets[long + 1] - length + 1 - base).tolist()):
            inside[max(begin, 0) + 1:max(end, 0) + 1] = True
        inside[-1] = False
        change = np.append(True, least[1:] != least[:-1])
        first = np.flatnonzero(inside[1:-1] & (change | ~inside[:-2]))
        last = np.flatnonzero(inside[1:-1] & (np.append(change[1:], True) | ~inside[2:]))
        anchor = (low - (least[first] & low)).astype(np.int64)
        text = np.searchsorted(offsets, first + base, side="right") - 1
        here = offsets[text] - base
        found.append([text, hashes[anchor].view(np.int64), anchor - here, first - here, last - here])
    return [np.concatenate(x) for x in zip(*found)]


def _anchor_rows(source: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, tid, place, low, high) of all texts; equal texts of a task once."""
    names = ["anchor", "tid", "place", "low", "high"]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            tids = batch.column(0).to_numpy()
            offsets, data = texts.raw(batch.column(1))
            if len(seen) > 1_000_000:
                seen.clear()
            fresh = np.zeros(len(tids), bool)
            for i, t in enumerate(tids.tolist()):
                if t not in seen:
                    seen.add(t)
                    fresh[i] = True
            for base, o, d in texts.chunks(offsets, data):
                text, anchor, place, low, high = anchors(o, d, length, gram)
                keep = fresh[base + text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[keep]), pa.array(tids[base + text[keep]])]
                    + [pa.array(x[keep].astype(np.int32)) for x in (place, low, high)], names=names)

    return (source.where(F.octet_length("text") >= length).select("tid", "text")
            .mapInArrow(run, "anchor bigint, tid bigint, place int, low int, high int"))


_SEGMENTS = "key bigint, name bigint, bytes binary, s1 bigint, s2 bigint, low int, high int, rel int"


def _segment_rows(held: DataFrame, length: int) -> DataFrame:
    """Segments of texts with their candidate anchors; bytes once for equal ones of a text."""

    def run(batches):
        for batch in batches:
            for tid, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = text.as_buffer()
                data = np.frombuffer(raw, np.uint8)
                runs = runs.values
                anchor, place, low, high = (runs.field(i).to_numpy() for i in range(4))
                ends = high.astype(np.int64) + length
                names = texts.span_hashes(texts.prefix_sums(data, texts.byte_values()), low.astype(np.int64), ends)
                _, one = np.unique(names, return_index=True)
                whole = np.full(len(low), False)
                whole[one] = True
                blob = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(names.view(np.int64)),
                     pa.array([blob[a:b] if w else None for a, b, w in zip(low.tolist(), ends.tolist(), whole.tolist())], pa.binary()),
                     pa.array(np.full(len(low), tid)), pa.array(np.zeros(len(low), np.int64)),
                     pa.array(low), pa.array(high), pa.array(low - place)],
                    names=["key", "name", "bytes", "s1", "s2", "low", "high", "rel"])

    return held.mapInArrow(run, _SEGMENTS)


def _split_rows(big: DataFrame, span: int, length: int) -> DataFrame:
    """Segments cut at multiples of ``span`` (distance from the anchor), keyed by what is common."""

    def run(batches):
        for batch in batches:
            out = []
            for key, name, raw, rel in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = np.frombuffer(raw, np.uint8)
                sums = texts.prefix_sums(data, texts.byte_values())
                starts = len(raw) - length + 1
                cut = np.unique(np.append(0, np.arange((-rel) % span, starts, span)))
                last = np.append(cut[1:], starts) - 1
                grid = (rel + cut) // span
                # bytes from the last to the end of the first window that the whole group could have
                inner = grid * span + span - 1 - rel
                outer = grid * span - rel + length
                keys = texts.mix(texts.span_hashes(sums, inner, outer)
                                 ^ texts.mix(grid.astype(np.int64).view(np.uint64) + np.uint64(key & (2**64 - 1))))
                names = texts.span_hashes(sums, cut, last + length)
                for k, n, a, b in zip(keys.view(np.int64).tolist(), names.view(np.int64).tolist(), cut.tolist(), last.tolist()):
                    out.append((k, n, raw[a:b + length], key, name, a, b, rel + a))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
                                                                pa.int32(), pa.int32(), pa.int32()))],
                    names=["key", "name", "bytes", "s1", "s2", "low", "high", "rel"])

    return big.select("key", "name", "bytes", "rel").mapInArrow(run, _SEGMENTS)


def _shard_ranges(rows: DataFrame, length: int) -> DataFrame:
    """(key, name, a, b): runs of repeated starts in the different segments of each key."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def work(done):
            found = repeated_starts([np.frombuffer(r[2], np.uint8) for r in done], length)
            out = []
            for (key, name, _), at in zip(done, found):
                if len(at):
                    cut = np.flatnonzero(np.diff(at) > 1)
                    for a, b in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist()):
                        out.append((key, name, a, b))
            columns = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "name", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size > SHARD_BYTES and row[0] != held[-1][0]:
                    yield work(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield work(held)

    # by an expression of its own: dealt by the key that rows were joined by, the exchange would be left out,
    # and an adaptive broadcast or skew join reads its input in other pieces, so that equal keys would not meet
    return rows.repartition(F.expr("key ^ 1L")).sortWithinPartitions("key", "name").mapInArrow(
        run, "key bigint, name bigint, a int, b int")


def _repeated(rows: DataFrame, path: str, level: int, length: int, most: int) -> DataFrame:
    """(s1, s2, first, last): runs of repeated starts in the sources of segment rows."""
    spark = rows.sparkSession
    rows.write.parquet(f"{path}/rows{level}")
    rows = spark.read.parquet(f"{path}/rows{level}")
    several = lambda c: F.min(c) < F.max(c)
    (rows.groupBy("key", "name").agg(
        F.first("bytes", ignorenulls=True).alias("bytes"), F.first("rel").alias("rel"),
        (several("s1") | several("s2") | several("low")).alias("again"))).write.parquet(f"{path}/names{level}")
    names = spark.read.parquet(f"{path}/names{level}")
    sizes = names.groupBy("key").agg(F.count("*").alias("c"))
    busy = sizes.where("c > 1")
    whole = names.where("again").select("key", "name", F.lit(0).alias("a"), (F.octet_length("bytes") - length).cast("int").alias("b"))
    small = names.join(busy.where(F.col("c") <= most) if level < len(SPLITS) else busy, "key").select("key", "name", "bytes")
    found = _shard_ranges(small, length)
    if level < len(SPLITS) and busy.where(F.col("c") > most).limit(1).count():
        big = names.join(busy.where(F.col("c") > most), "key").select("key", "name", "bytes", "rel")
        inner = _repeated(_split_rows(big, SPLITS[level], length), path, level + 1, length, most)
        found = found.unionByName(inner.select(F.col("s1").alias("key"), F.col("s2").alias("name"),
                                               F.col("first").alias("a"), F.col("last").alias("b")))
    ranges = whole.unionByName(found)
    places = rows.select("key", "name", "s1", "s2", "low")
    return (places.join(ranges, ["key", "name"])
            .select("s1", "s2", (F.col("low") + F.col("a")).alias("first"), (F.col("low") + F.col("b")).alias("last")))


def remove_repeats(documents: DataFrame, *, length: int = 400, doc_id: str = "doc_id", text: str = "text",
                   gram: int = GRAM, most: int = SHARD_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, spans (removed: first, end), kept (the remaining bytes' sha256) of every row.

    A byte is removed if it is covered by a string of ``length`` bytes that also starts
    anywhere else, in the same row or another. Null texts are empty. Repeated rows remove
    each other when long enough; a null id is an id like others. An empty table gives no rows.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, "suffixes")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), whole.alias("text")).withColumn(
        "tid", F.xxhash64("text"))
    source.select("doc_id", "tid", F.crc32("text").alias("crc"), F.octet_length("text").alias("n"),
                  F.sha2("text", 256).alias("sha")).write.parquet(f"{path}/described")
    described = spark.read.parquet(f"{path}/described")

    rows = _anchor_rows(source, length, gram)
    several = lambda c: F.min(c) < F.max(c)
    # the exclusive or keeps the counted side an exchange of its own, so that a hot anchor can be split
    known = (rows.groupBy("anchor").agg(several("tid").alias("x"), several("place").alias("y")).where("x or y")
             .select(F.expr("anchor ^ 1L").alias("other")))
    per_text = (rows.join(known, F.col("anchor") == F.expr("other ^ 1L")).select("tid", F.struct("anchor", "place", "low", "high").alias("run"))
                .groupBy("tid").agg(F.array_sort(F.collect_set("run")).alias("runs")))
    per_text.write.parquet(f"{path}/runs")
    runs = spark.read.parquet(f"{path}/runs")
    one = described.groupBy("tid").agg(F.min(F.struct(F.isnull("doc_id").alias("x"), "doc_id", "crc", "n")).alias("one"))
    wanted = one.join(runs.select("tid"), "tid").select("tid", F.col("one.doc_id").alias("wanted"))
    (source.join(wanted, "tid").where(F.col("doc_id").eqNullSafe(F.col("wanted"))).select("tid", "text")
     .dropDuplicates(["tid"]).write.parquet(f"{path}/texts"))
    held = spark.read.parquet(f"{path}/texts")
    segments = _segment_rows(held.join(runs, "tid").select("tid", "text", "runs"), length)
    starts = _repeated(segments, path, 0, length, most)
    spans = (starts.groupBy(F.col("s1").alias("tid"))
             .agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("ranges")))

    def cut(batches):
        for batch in batches:
            kept, out = [], []
            for raw, ranges in zip(batch.column(1), batch.column(2).to_pylist()):
                data, merged = raw.as_buffer().to_pybytes(), []
                for r in ranges:
                    a, b = r["first"], r["last"] + length
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                kept.append(digest.hexdigest())
                out.append([{"first": a, "end": b} for a, b in merged])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind), pa.array(kept, pa.string())],
                                             names=["tid", "spans", "kept"])

    removed = held.join(spans, "tid").select("tid", "text", "ranges").mapInArrow(
        cut, "tid bigint, spans array<struct<first:bigint,end:bigint>>, kept string")
    # texts that occur twice are removed whole; the checksum and size guard the 64-bit names
    copies = described.groupBy("tid", "crc", "n").agg((F.count("*") > 1).alias("copied"))
    facts = copies.join(removed, "tid", "left")
    none = F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)")
    full = F.array(F.struct(F.lit(0).cast("bigint").alias("first"), F.col("n").cast("bigint").alias("end")))
    gone = F.col("copied") & (F.col("n") >= length)
    return (described.join(facts, ["tid", "crc", "n"]).select(
        "doc_id", F.col("n").cast("bigint").alias("n_bytes"),
        F.when(gone, full).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept")))
