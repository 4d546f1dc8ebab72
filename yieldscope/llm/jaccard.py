"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

The join works on distinct sets, so exact copies are one from the start.

1. Shingles are ordered by how many documents hold them (frequent ones last), and the
   prefix of a set is so long that two linked sets share a prefix shingle.
2. The inverted list of each prefix shingle is led by its smallest set (by name), and
   every set of the list joins the leader's group. Lists of one group of copies have the
   same few leaders, so a set is sent to a few groups only, and two linked sets meet in
   one. Leaders of frequent shingles are found by counting alone, so no long list is ever
   brought together.
3. Sets that no other set of their group can be linked with, by bitmaps of their
   shingles, leave it. What is left of a group is worked off by T-occurrence search (``search``), large groups in parts that
   each hold the leader. Sets linked with the leader are in one component already, and
   need no comparison with each other. Sets that are not (``outsiders``) meet the other
   parts in blocks. By the triangle inequality of the Jaccard distance an outsider can be
   linked with a set linked with the leader only if it is within twice the distance.
4. Links between different sets, one spanning forest for each part, make components.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldscope.llm import components, texts
from yieldscope.session import scratch_path

#: Sets, and shingles in them, that one part of a group holds on average.
PART_SETS, PART_SHINGLES = 200, 400_000
#: Powers of two of the bits of the bitmap that stands for a set while groups are pruned.
BITS = (11, 16)
#: Sets of a part that are compared directly.
FEW = 6
#: Frequent shingles that are told to all tasks, the most frequent first. More or fewer change
#: how fast the join is, never what it finds.
FREQUENT = 1 << 18
#: A shingle is reported as frequent by a task if it finds it in so many documents.
SEEN = 4
#: Bytes of text that are cut into sets at once; a batch holds many times as much.
CHUNK = 1 << 19


def sets_of(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one after another; and the bounds of the texts."""
    space = texts.byte_class((0x20, 0x20), (0x09, 0x0D))
    flat, bounds = [], [np.zeros(1, np.int64)]
    for _, o, d in texts.chunks(offsets, data, CHUNK):
        words = texts.Words(texts.lower_table()[d], o, ~space)
        at = np.flatnonzero(words.room() >= size)
        shingles, text = texts.window_hashes(words.hashes, at, size), words.text[at]
        for t in np.flatnonzero((words.counts > 0) & (words.counts < size)):
            whole = texts.window_hashes(words.hashes, words.bounds[t:t + 1], int(words.counts[t]))
            shingles, text = np.append(shingles, whole), np.append(text, t)
        order = np.lexsort((shingles, text))
        shingles, text = shingles[order], text[order]
        new = np.ones(len(text), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
        flat.append(shingles[new])
        bounds.append(bounds[-1][-1] + np.cumsum(np.bincount(text[new], minlength=len(o) - 1)))
    return np.concatenate([np.zeros(0, np.uint64), *flat]), np.concatenate(bounds)


def set_ids(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.append(np.zeros(1, np.uint64), np.cumsum(texts.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    sizes = np.diff(bounds).astype(np.uint64)
    return texts.mix(total[bounds[1:]] - total[bounds[:-1]] + sizes * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def bitmaps(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A bitmap of each set, one hashed bit for each shingle; long sets have longer ones."""
    sizes = np.diff(bounds)
    log = np.clip(np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64), *BITS)
    starts = np.append(0, np.cumsum(1 << (log - 3)))
    text = np.repeat(np.arange(len(sizes)), sizes)
    bit = (flat >> (64 - log[text]).astype(np.uint64)).astype(np.int64)
    held = np.zeros(int(starts[-1]), np.uint8)
    np.bitwise_or.at(held, starts[text] + (bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(held)]).cast(pa.binary())


def _halved(bits: np.ndarray) -> np.ndarray:
    """The bitmap of half the length for the same shingles."""
    pairs = np.unpackbits(bits, bitorder="little").reshape(-1, 2)
    return np.packbits(pairs[:, 0] | pairs[:, 1], bitorder="little")


def may_link(sizes: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which sets of a group may be linked with another of it.

    A bit of one set that another lacks stands for at least one shingle that it lacks,
    which bounds the overlap from above. Nothing that is linked is left out: bitmaps of
    linked sets have the same length or one is twice as long (the threshold is above
    50 %), and then it is halved.
    """
    length, out = np.array([len(b) for b in bits]), np.zeros(len(sizes), bool)
    for short in np.unique(length):
        some = np.flatnonzero((length == short) | (length == 2 * short))
        own = length[some] == short
        rows = np.stack([x if o else _halved(x) for x, o in
                         ((np.frombuffer(bits[i], np.uint8), o) for i, o in zip(some, own))]).view(np.uint64)
        n, count = sizes[some], np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
        for i in range(len(some) - 1):
            both = np.bitwise_count(rows[i + 1:] & rows[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[i] - count[i] + both, n[i + 1:] - count[i + 1:] + both)
            ok = (100 * most >= percent * (n[i] + n[i + 1:] - most)) & (own[i] | own[i + 1:])
            out[some[i]] |= ok.any()
            out[some[i + 1:]] |= ok
    return out


def _pruned(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (leader, sid, n, bits) of small groups without the sets that nothing there can be linked with."""

    def run(batches):
        def work(leader, sid, n, bits):
            cut = np.flatnonzero(np.append(True, leader[1:] != leader[:-1]))[:len(leader)]
            keep = np.concatenate([np.zeros(0, bool), *(may_link(n[a:b], bits[a:b], percent)
                                                        for a, b in zip(cut, np.append(cut[1:], len(leader))))])
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (leader, sid, n)], names=["leader", "sid", "n"])

        held, bits = [np.zeros(0, np.int64)] * 3, []
        for batch in batches:
            held = [np.append(k, batch.column(i).to_numpy()) for i, k in enumerate(held)]
            bits += batch.column(3).to_pylist()
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield work(*(c[:done] for c in held), bits[:done])
            held, bits = [c[done:] for c in held], bits[done:]
        yield work(*held, bits)
        del held, bits
        texts.release()

    return (rows.select("leader", "sid", "n", "bits").repartition("leader").sortWithinPartitions("leader")
            .mapInArrow(run, "leader bigint, sid bigint, n bigint"))


def needed(size, percent: int):
    """The overlap that a set of this size needs with any set it is linked with."""
    return -(-percent * size // 100)


class Links:
    """Components within one part (union by smallest place)."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


class Lists:
    """Inverted lists of sets, which are added one by one under rising places."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}
        self.sizes: dict[int, int] = {}

    def add(self, place: int, shingles: list[int]) -> None:
        self.sizes[place] = len(shingles)
        for s in shingles:
            held = self.lists.get(s)
            if held is None:
                self.lists[s] = [place]
            else:
                held.append(place)

    def at_least(self, shingles: list[int], overlap: int) -> list[tuple[int, int]]:
        """(place, overlap) of all sets that share so many shingles: DivideSkip.

        The longest lists are set aside, fewer than the overlap asked for, so every
        answer occurs in the short lists at least ``overlap`` less their number of
        times. The short lists are merged and counted, the long ones probed by binary
        search for the places that can still reach the overlap.
        """
        lists = [x for s in shingles if (x := self.lists.get(s)) is not None]
        if len(lists) < overlap:
            return []
        lists.sort(key=len)
        longest = len(lists[-1])
        aside = min(overlap - 1, int(overlap / (0.1 * np.log2(longest + 1) + 1))) if longest > 8 else 0
        short, long = lists[:len(lists) - aside], lists[len(lists) - aside:]
        if longest == 1 or len(self.sizes) < 64:
            count: dict[int, int] = {}
            for held in short:
                for place in held:
                    count[place] = count.get(place, 0) + 1
            found = [(p, n) for p, n in count.items() if n >= overlap - aside]
        else:
            places, times = np.unique(np.fromiter((p for x in short for p in x), np.int64), return_counts=True)
            enough = times >= overlap - aside
            found = list(zip(places[enough].tolist(), times[enough].tolist()))
        if not long:
            return found
        out = []
        for place, n in found:
            for i, held in enumerate(long):
                if n + len(long) - i < overlap:
                    break
                k = bisect_left(held, place)
                n += k < len(held) and held[k] == place
            if n >= overlap:
                out.append((place, n))
        return out


def linked(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


def search(sets: list[np.ndarray], percent: int) -> tuple[Links, list[float]]:
    """Components of the sets of a part, and each set's similarity with the first.

    Only sets that are linked with none before them are indexed (heads); the others
    are kept with the head they are linked with. A set is looked up among the heads at
    twice the distance. Linked heads join it; of a head beyond that, those of its sets
    are compared that the triangle inequality leaves.
    """
    links, lists, far = Links(len(sets)), Lists(), 2 * percent - 100
    if len(sets) <= FEW:
        share = [1.0]
        for i, a in enumerate(sets):
            for j in range(i):
                small, large = sorted((len(a), len(sets[j])))
                if 100 * small >= (percent if j else far) * large and (not j or links.root(i) != links.root(j)):
                    n = len(np.intersect1d(a, sets[j], assume_unique=True))
                    if linked(n, small, large, percent):
                        links.join(i, j)
                    if not j:
                        share.append(n / (small + large - n))
                elif not j:
                    share.append(0.0)
        return links, share
    kept: dict[int, list[tuple[int, float]]] = {}
    first = []
    for y, shingles in enumerate(sets):
        held = shingles.tolist()
        near, close = None, 0.0
        beyond = []
        for head, n in lists.at_least(held, max(1, needed(len(held), far))):
            share = n / (len(held) + lists.sizes[head] - n)
            if linked(n, len(held), lists.sizes[head], percent):
                links.join(y, head)
                if share > close:
                    near, close = head, share
            else:
                beyond.append((head, share))
            if head == 0:
                first.append(share)
        if len(first) <= y:
            first.append(1.0 if y == 0 else 0.0)
        for head, share in beyond:
            if links.root(head) == links.root(y):
                continue
            for other, its in kept[head]:
                # distances: d(y, other) >= d(y, head) - d(other, head)
                if its - share <= 1 - percent / 100 + 1e-9 and links.root(other) != links.root(y):
                    n = len(np.intersect1d(shingles, sets[other], assume_unique=True))
                    if linked(n, len(held), len(sets[other]), percent):
                        links.join(y, other)
        if near is None:
            lists.add(y, held)
            kept[y] = []
        else:
            kept[near].append((y, close))
    return links, first


def cross(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between two blocks, enough to connect what they connect."""
    lists, links, out = Lists(), Links(len(left) + len(right)), []
    for i, s in enumerate(left):
        lists.add(i, s.tolist())
    for j, s in enumerate(right):
        held = s.tolist()
        for i, n in lists.at_least(held, max(1, needed(len(held), percent))):
            if linked(n, len(held), lists.sizes[i], percent) and links.root(i) != links.root(len(left) + j):
                links.join(i, len(left) + j)
                out.append((i, j))
    return out


def _by_key(batches, keys: int):
    """(key, rows) of sorted batches, whose last column is a text; rows: tuples with the set last."""
    key, rows = None, []
    for batch in batches:
        flat, bounds = batch  # columns of Python values, sets
        for i in range(len(bounds) - 1):
            now = tuple(c[i] for c in flat[:keys])
            if now != key:
                if rows:
                    yield key, rows
                key, rows = now, []
            rows.append((*[c[i] for c in flat[keys:-1]], flat[-1][bounds[i]:bounds[i + 1]]))
    if rows:
        yield key, rows


def _grouped(rows: DataFrame, keys: int, size: int, answer, schema: str) -> DataFrame:
    """``answer`` for each group of rows with equal first columns; the last column is a text
    that becomes its set of shingles."""
    names = rows.columns
    # a fixed number of partitions: few bytes can mean much work here, so none are put together
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *names[:keys]).sortWithinPartitions(*names[:-1])

    def run(batches):
        def read():
            for batch in batches:
                for first, o, d in texts.chunks(*texts.raw(batch.column(batch.num_columns - 1)), CHUNK):
                    flat, bounds = sets_of(o, d, size)
                    yield [*(c.to_pylist() for c in batch.slice(first, len(o) - 1).columns[:-1]), flat], bounds

        out: list[tuple] = []
        kinds = [x.split()[0] for x in schema.split(", ")]
        for key, held in _by_key(read(), keys):
            out.extend(answer(key, held))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=kinds)
        texts.release()

    return dealt.mapInArrow(run, schema)


def _described(source: DataFrame, size: int) -> DataFrame:
    """Of every document doc_id, mark of the text, number of shingles and name of the set; and
    rows (null, shingle, times, null) of the shingles a task has seen in several documents."""
    rows = source.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark bigint, n bigint, sid bigint, bits binary"
    names = ["doc_id", "mark", "n", "sid", "bits"]

    def run(batches):
        def report(parts, kind):
            values = np.concatenate(parts)
            parts.clear()
            values.sort()
            starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])[:len(values)])
            times = np.diff(np.append(starts, len(values)))
            some = times >= SEEN
            none = pa.nulls(int(some.sum()), kind)
            return pa.RecordBatch.from_arrays([none, pa.array(values[starts[some]].view(np.int64)), pa.array(times[some]),
                                               pa.nulls(len(none), pa.int64()), pa.nulls(len(none), pa.binary())], names=names)

        parts, held, kind = [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for first, o, d in texts.chunks(*texts.raw(batch.column(2)), CHUNK):
                flat, bounds = sets_of(o, d, size)
                some = batch.slice(first, len(o) - 1)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(np.diff(bounds)),
                                                  pa.array(set_ids(flat, bounds)), bitmaps(flat, bounds)], names=names)
                parts.append(flat)
                held += len(flat)
                if held > 4_000_000:
                    yield report(parts, kind)
                    held = 0
        if parts:
            yield report(parts, kind)
        del parts
        texts.release()

    return rows.mapInArrow(run, schema)


def _frequent(described: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles in many documents, and in how many their tasks have seen them."""
    rows = (described.where("sid is null").groupBy("mark").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "mark").limit(most).collect())
    values = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.array([r[1] for r in rows], np.int64)[order]


def _prefix_of(offsets, data, size: int, percent: int, common: texts.Lookup, times: np.ndarray):
    """(shingle, place among the frequent or -1, text) of the prefixes, and names and sizes of the sets."""
    flat, bounds = sets_of(offsets, data, size)
    sids, sizes = set_ids(flat, bounds), np.diff(bounds)
    text = np.repeat(np.arange(len(sids)), sizes)
    known = np.full(len(flat), -1, np.int64)
    at, place = common.find(flat)
    known[at] = place
    if len(at):
        order = np.lexsort((flat, np.where(known >= 0, times[known], 0), text))
        flat, known = flat[order], known[order]
    length = sizes - needed(sizes, percent) + 1
    take = np.arange(len(flat)) - np.repeat(bounds[:-1], sizes) < length[text]
    return flat[take], known[take], text[take], sids, sizes


def _frequent_leaders(source: DataFrame, size: int, percent: int, frequent) -> np.ndarray:
    """The smallest set of the list of each frequent shingle."""
    values, times = frequent

    def run(batches):
        common, least = texts.Lookup(values), np.full(len(values), np.iinfo(np.int64).max)
        for batch in batches:
            for _, o, d in texts.chunks(*texts.raw(batch.column(0)), CHUNK):
                _, known, text, sids, _ = _prefix_of(o, d, size, percent, common, times)
                some = known >= 0
                np.minimum.at(least, known[some], sids[text[some]])
        seen = np.flatnonzero(least < np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(least[seen])], names=["k", "sid"])
        texts.release()

    out = np.zeros(len(values), np.int64)
    if len(values):
        rows = source.select(F.coalesce("text", F.lit(""))).mapInArrow(run, "k bigint, sid bigint")
        for k, sid in rows.groupBy("k").agg(F.min("sid")).collect():
            out[k] = sid
    return out


def _members(source: DataFrame, size: int, percent: int, frequent, leaders: np.ndarray) -> DataFrame:
    """(leader, sid): the groups that each set joins.

    Lists of frequent shingles, whose leaders are known, are never brought together. The
    others are, ordered by the sizes of their sets and cut where neighbours differ too much
    in size to be linked; each run of more than one set has its own leader.
    """
    values, times = frequent

    def emit(batches):
        common, seen = texts.Lookup(values), set()
        for batch in batches:
            for _, o, d in texts.chunks(*texts.raw(batch.column(0)), CHUNK):
                shingle, known, text, sids, sizes = _prefix_of(o, d, size, percent, common, times)
                if len(seen) > 1_000_000:
                    seen.clear()
                fresh = np.zeros(len(sids), bool)
                for i, s in enumerate(sids.tolist()):
                    if sizes[i] and s not in seen:
                        seen.add(s)
                        fresh[i] = True
                led = (known >= 0) & fresh[text]
                pairs = np.unique(np.stack([text[led], leaders[known[led]]]), axis=1)
                rest = (known < 0) & fresh[text]
                names = np.append(shingle[rest], texts.mix(pairs[1].view(np.uint64) ^ sids[pairs[0]].view(np.uint64)))
                who = np.append(text[rest], pairs[0])
                led = pa.concat_arrays([pa.nulls(int(rest.sum()), pa.int64()), pa.array(pairs[1])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(sizes[who].astype(np.int32)), pa.array(sids[who]), led],
                    names=["shingle", "n", "sid", "leader"])
        del seen
        texts.release()

    def lead(batches):
        kept = [np.zeros(0, np.int64)] * 3

        def runs(shingle, n, sid):
            if not len(sid):
                return sid, sid
            cut = np.flatnonzero((shingle[1:] != shingle[:-1]) | (100 * n[:-1] < percent * n[1:])) + 1
            starts = np.append(0, cut)
            many = np.diff(np.append(starts, len(sid)))
            first = np.repeat(np.minimum.reduceat(sid, starts), many)
            some = np.repeat(many, many) > 1
            return first[some], sid[some]

        for batch in batches:
            led = batch.column(3)
            direct = led.is_valid().to_numpy(zero_copy_only=False)
            shingle, n, sid = (np.append(k, c.to_numpy()[~direct]) for k, c in zip(kept, batch.columns[:3]))
            done = np.searchsorted(shingle, shingle[-1]) if len(shingle) else 0
            a, b = runs(shingle[:done], n[:done], sid[:done])
            kept = [shingle[done:], n[done:], sid[done:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(a, led.filter(led.is_valid()).to_numpy())),
                 pa.array(np.append(b, batch.column(2).to_numpy()[direct]))], names=["leader", "sid"])
        a, b = runs(*kept)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["leader", "sid"])
        texts.release()

    entries = source.select(F.coalesce("text", F.lit(""))).mapInArrow(emit, "shingle bigint, n int, sid bigint, leader bigint")
    return (entries.repartition("shingle").sortWithinPartitions("shingle", "n")
            .mapInArrow(lead, "leader bigint, sid bigint").distinct())


def near_duplicates(documents: DataFrame, *, size: int = 5, percent: int = 80, doc_id: str = "doc_id",
                    text: str = "text", part_sets: int = PART_SETS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    Sets with 100 * overlap >= percent * union are linked. A text of fewer words than a
    shingle is one shingle; null texts and texts without words have no shingles and are
    linked with nothing (component_id is their own id). Rows with a null id take part and
    name no component unless they are all there is. Repeated rows are linked. An empty
    table gives no rows.
    """
    if percent <= 50:
        raise ValueError("the triangle inequality needs a threshold above 50 %")
    spark = documents.sparkSession
    path = scratch_path(spark, "jaccard")
    source = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    _described(source, size).write.parquet(f"{path}/described")
    written = spark.read.parquet(f"{path}/described")
    described = written.where("sid is not null")

    frequent = _frequent(written, FREQUENT)
    members = _members(source, size, percent, frequent, _frequent_leaders(source, size, percent, frequent))
    one = described.where("n > 0").groupBy("sid").agg(F.min(F.struct(F.isnull("doc_id").alias("x"), "doc_id", "mark")).alias("one"),
                                                      F.first("n").alias("n"), F.first("bits").alias("bits"))
    # a frequent shingle that one set alone holds leads nothing
    several = members.groupBy("leader").agg(F.count("*").alias("c")).where("c > 1")
    members.join(several, "leader").join(one.select("sid", "n", "bits"), "sid").write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    pruned = _pruned(groups.where(F.col("c") <= part_sets), percent)
    pruned.unionByName(groups.where(F.col("c") > part_sets).select("leader", "sid", "n")).write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")

    wanted = one.join(members.select("sid").distinct(), "sid").select(
        "sid", F.col("one.doc_id").alias("wanted"), F.col("one.mark").alias("mark"))
    held = (source.withColumn("mark", F.xxhash64("text")).join(wanted, "mark")
            .where(F.col("doc_id").eqNullSafe(F.col("wanted"))).select("sid", "text"))
    held.dropDuplicates(["sid"]).write.parquet(f"{path}/texts")
    held = spark.read.parquet(f"{path}/texts")

    # a leader that has been pruned is followed by the smallest set that is left
    parts = members.groupBy("leader").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.min("sid").alias("head")).select(
        "leader", "head", F.greatest(F.ceil(F.col("c") / part_sets), F.ceil(F.col("w") / PART_SHINGLES)).alias("parts"))
    dealt = members.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")))
    # the leader stands first in every part of its group
    rows = dealt.where("sid <> head").select("leader", "part", F.lit(1).alias("order"), "sid", "parts")
    heads = dealt.where("sid = head").select(
        "leader", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("order"), "sid", "parts")
    full = rows.unionByName(heads).join(held, "sid").select("leader", "part", "order", "sid", "parts", "text")

    def answer(key, got):
        names, sets = [r[1] for r in got], [r[3] for r in got]
        links, first = search(sets, percent)
        out = []
        for i, name in enumerate(names):
            if (root := links.root(i)) != i:
                out.append((0, key[0], key[1], names[root], name))
        if got[0][2] > 1:
            for name, share, s in zip(names, first, sets):
                if name != names[0] and share * 100 < percent - 1e-9:
                    near = share * 100 >= 2 * percent - 100 - 1e-9
                    out.append((1 if near else 2, key[0], key[1], name, name))
        return out

    _grouped(full, 2, size, answer, "kind bigint, leader bigint, part bigint, a bigint, b bigint"
             ).write.parquet(f"{path}/found")
    found = spark.read.parquet(f"{path}/found")
    outside = found.where("kind > 0").select("leader", F.col("a").alias("sid"), "kind", "part")
    blocks = outside.groupBy("leader").agg(F.ceil(F.count("*") / part_sets).alias("blocks"), F.min("kind").alias("nearest"))
    outsiders = (outside.join(blocks, "leader").withColumn("block", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("blocks"))))
    others = (dealt.join(blocks, "leader").where("sid <> head")
              .join(outside.select("leader", "sid", "kind"), ["leader", "sid"], "left")
              .where("kind is not null or nearest = 1"))
    asked = outsiders.join(parts.drop("head"), "leader").select(
        "leader", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("side"), "sid")
    offered = others.select("leader", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
                            "part", F.lit(1).alias("side"), "sid")
    met = asked.unionByName(offered).join(held, "sid").select("leader", "block", "part", "side", "sid", "text")

    def meet(key, got):
        left, right = [r for r in got if r[0] == 0], [r for r in got if r[0] == 1]
        return [(left[i][1], right[j][1]) for i, j in cross([r[2] for r in left], [r[2] for r in right], percent)
                if left[i][1] != right[j][1]]

    between = _grouped(met, 3, size, meet, "a bigint, b bigint")
    links = found.where("kind = 0").select("a", "b").unionByName(between)
    labels = components.connected(links)
    named = (described.join(labels, described["sid"] == labels["node"], "left")
             .select("doc_id", "n", F.coalesce("label", "sid").alias("key")))
    # the exclusive or gives the counted side an exchange of its own, so that a hot component can be split
    lowest = named.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low")).select(F.expr("key ^ 1L").alias("other"), "low")
    out = named.where("n > 0").join(lowest, F.col("key") == F.expr("other ^ 1L")).select("doc_id", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"))
    return out.unionByName(named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
