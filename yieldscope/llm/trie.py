"""The prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. It is known by its depth and a 128-bit sum
over its turns' digests (each times a power for its place), so nodes are found by running
sums along the conversations and one grouping, whatever their depth.

Every node is owned by the smallest conversation through it. Neighbours on a path with one
owner and one number of conversations have no branch and no end between them: such a run is
one vertex of the forest that is rolled up, and a long conversation is a few vertices.

The forest of parent edges is decomposed by centroids. A component's centroid is its
deepest vertex that more than half of the component's conversations pass. Cutting below it
leaves the components of its children and the one above it; the totals of what hangs from
the centroid are added to all vertices from it up to the component's top. Components of
many vertices are split by joins, all at once, and halve their conversations in each round;
smaller ones are decomposed further inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldscope.llm.ordered import running
from yieldscope.session import scratch_path

#: Vertices of a component that one task decomposes.
SOLVED = 20_000
#: Rows of a key, as a share of all, from which the key counts as hot.
HOT = 1000
#: Characters of a hashed list that travel as one row.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def ordered_turns(turns: DataFrame, path: str, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, pos, high, low, chars): turns numbered from 1 in each conversation, by their digests.

    Turns come by number, nulls first, equal numbers by the digest of role and text. A null
    role or text is empty. Rows without conversation take no part.
    """
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    mark = F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t))
    rows = turns.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
        mark.alias("mark"), F.length(t).cast("bigint").alias("chars"))
    placed = running(rows, "conv_id", ["conv_id", F.col("turn").asc_nulls_first(), "mark"], path)
    # fifteen hexadecimal digits are a positive 64-bit integer
    digits = lambda at: F.conv(F.substring("mark", at, 15), 16, 10).cast("bigint")
    return placed.select("conv_id", (F.col("rank__") + 1).alias("pos"), digits(1).alias("high"), digits(17).alias("low"), "chars")


def share_openings(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, part, pos, high, low, chars): the first h turns of the first conversation of each hundred, then a
    conversation's own turns after its first h, where h is the CRC of its number modulo ``most``."""
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % most
    own = turns.where(F.col("pos") > h("conv_id")).select("conv_id", F.lit(1).alias("part"), "pos", "high", "low", "chars")
    opening = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("base")).agg(
        F.collect_list(F.struct("pos", "high", "low", "chars")).alias("opening"))
    given = (turns.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
             .join(opening, "base").select("conv_id", F.explode("opening").alias("o")).where(F.col("o.pos") <= h("conv_id"))
             .select("conv_id", F.lit(0).alias("part"), "o.*"))
    return own.unionByName(given)


def _prefixes(turns: DataFrame, conversations: DataFrame, path: str) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, chars): every conversation's prefixes, the empty one first."""
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("pos", "high", "low", "chars")]
    roots = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.lit(-1).alias("part"), *zero)
    rows = roots.unionByName(turns.select("conv_id", "part", "pos", "high", "low", "chars"))
    run = running(rows, "conv_id", ["conv_id", "part", "pos"], path, ("high", "low"), _BASE)
    names = ["conv_id", "depth", "a", "b", "pa", "pb", "chars"]
    at = [run.columns.index(c) for c in ("conv_id", "rank__", "sum_high", "sum_low", "high", "low", "chars")]

    def parents(batches):
        for batch in batches:
            conv, depth, a, b, high, low, chars = (batch.column(i).to_numpy() for i in at)
            if not len(depth):
                continue
            scale = np.array([pow(_BASE, int(d), 1 << 64) for d in np.unique(depth)], np.uint64)[
                np.unique(depth, return_inverse=True)[1]]
            up = [(s.view(np.uint64) - v.astype(np.uint64) * scale).view(np.int64) for s, v in ((a, high), (b, low))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (conv, depth, a, b, *up, chars)], names=names)

    return run.mapInArrow(parents, ", ".join(f"{n} bigint" for n in names))


def _join_hot(many: DataFrame, few: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """Left join of many rows to unique rows; keys in ``hot`` (a bounded table) are broadcast instead of shuffled."""
    flag = F.broadcast(hot.select(*on).distinct().withColumn("hot__", F.lit(True)))
    tagged = many.join(flag, on, "left")
    heads = F.broadcast(few.join(F.broadcast(hot.select(*on).distinct()), on, "left_semi"))
    cold = tagged.where("hot__ is null").drop("hot__").join(few, on, "left")
    return cold.unionByName(tagged.where("hot__").drop("hot__").join(heads, on, "left"))


def _hashed_ends(ends: DataFrame, path: str) -> DataFrame:
    """(depth, a, b, ends_sha256): hashes of the ascending, comma-joined conversations that end at a node.

    Ids are sorted over range partitions and leave them as pieces of text. A hash is taken of
    a node's pieces one after another; nothing but the piece at hand is held.
    """
    spark, key = ends.sparkSession, ["depth", "a", "b"]

    def join(batches):
        from pyspark import TaskContext

        number, node, held, size, count = TaskContext.get().partitionId(), None, [], 0, 0
        rows: list = []

        def flush():
            nonlocal held, size, count
            if held:
                rows.append((*node, number, count, ",".join(held)))
                held, size, count = [], 0, count + 1

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*key, "slice", "piece", "ids"])
                rows.clear()

        for batch in batches:
            for *at, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != node:
                    flush()
                    node = at
                held.append(str(c))
                size += len(held[-1]) + 1
                if size > PIECE:
                    flush()
            yield from out()
        flush()
        yield from out()

    (ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
     .mapInArrow(join, "depth bigint, a bigint, b bigint, slice bigint, piece bigint, ids string").write.parquet(path))

    def digest(batches):
        import hashlib

        node, state = None, None
        for batch in batches:
            rows = []
            for *at, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5))):
                if at != node:
                    if node is not None:
                        rows.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*key, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=[*key, "ends_sha256"])

    return (spark.read.parquet(path).repartition(*key).sortWithinPartitions(*key, "slice", "piece")
            .mapInArrow(digest, "depth bigint, a bigint, b bigint, ends_sha256 string"))


def decompose(parent: list[int], values: np.ndarray) -> np.ndarray:
    """Subtree sums of a forest by centroid decomposition.

    Vertices are numbered so that parents come first; a top has a negative parent.
    ``values`` has a row for each vertex.
    """
    n = len(parent)
    sums = np.zeros_like(values)
    component, tops = [0] * n, {}
    for v in range(n):  # the trees of the forest are the first components
        component[v] = v if parent[v] < 0 else component[parent[v]]
        tops.setdefault(component[v], []).append(v)
    work = list(tops.values())
    label, size = [0] * n, [0] * n
    while work:
        part = work.pop()
        top = part[0]
        if len(part) == 1:
            sums[top] += values[top]
            continue
        for v in part:
            size[v] = 1
        for v in reversed(part[1:]):
            size[parent[v]] += size[v]
        half = len(part) / 2
        centre = max(v for v in part if size[v] > half)
        # what hangs from the centroid, by child of the centroid
        pieces: dict[int, list[int]] = {}
        rest = []
        for v in part:
            up = parent[v] if v != top else -1
            if v == centre:
                label[v] = -2
            elif up == centre:
                label[v] = v
            else:
                label[v] = label[up] if up >= 0 else -1
            if label[v] >= 0:
                pieces.setdefault(label[v], []).append(v)
            elif label[v] == -1:
                rest.append(v)
        total = values[centre] + values[[v for p in pieces.values() for v in p]].sum(axis=0)
        v = centre
        while True:  # from the centroid to the top of its component
            sums[v] += total
            if v == top:
                break
            v = parent[v]
        work.extend(pieces.values())
        if rest:
            work.append(rest)
    return sums


def _solve(state: DataFrame) -> DataFrame:
    """(owner, n, leaves, saved) of components that fit a task."""
    names = ["comp", "owner", "n", "top", "parent_owner", "parent_n", "leaves", "saved", "more_leaves", "more_saved"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def solved(table: pa.Table) -> pa.RecordBatch:
            comp, owner, n, _, up_owner, up_n, *v = (table.column(i).to_numpy() for i in range(len(names)))
            place = {k: i for i, k in enumerate(zip(comp.tolist(), owner.tolist(), n.tolist()))}
            parent = [place.get(k, -1) for k in zip(comp.tolist(), up_owner.tolist(), up_n.tolist())]
            sums = decompose(parent, np.stack(v[:2], axis=1)) + np.stack(v[2:], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(n), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())],
                                              names=["owner", "n", "leaves", "saved"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= SOLVED:  # all whole components read so far
                table = pa.Table.from_batches(held).combine_chunks()
                comp = table.column(0).to_numpy()
                cut = int(np.flatnonzero(comp != comp[-1])[-1]) + 1 if comp[0] != comp[-1] else 0
                if cut:
                    yield solved(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows = sum(b.num_rows for b in held)
        if rows:
            yield solved(pa.Table.from_batches(held))

    return (state.select(*names).repartition("comp").sortWithinPartitions("comp", "top")
            .mapInArrow(run, "owner bigint, n bigint, leaves bigint, saved bigint"))


def _rolled_up(forest: DataFrame, prefixes: DataFrame, path: str, solved: int) -> DataFrame:
    """(owner, n, leaves, saved): subtree sums of all vertices (see the module's head)."""
    spark = forest.sparkSession
    state = forest.withColumn("comp", F.lit(0).cast("bigint")).withColumn("m", F.col("n")).withColumn(
        "more_leaves", F.lit(0).cast("bigint")).withColumn("more_saved", F.lit(0).cast("bigint"))
    state.write.parquet(f"{path}/0")
    small, done, turn = [], [], 0
    while True:
        state = spark.read.parquet(f"{path}/{turn}")
        sizes = state.groupBy("comp").agg(F.count("*").alias("size"), F.max("m").alias("all"), F.min("top").alias("comp_top"))
        sizes.where(F.col("size") > solved).write.parquet(f"{path}/large{turn}")
        large = spark.read.parquet(f"{path}/large{turn}")  # at most vertices / solved rows
        small.append(state.join(F.broadcast(large.select("comp")), "comp", "left_anti"))
        if not large.limit(1).count():
            break
        state = state.join(F.broadcast(large), "comp")
        # without any conversation left, the top itself
        heavy = state.where((2 * F.col("m") > F.col("all")) | (F.col("top") == F.col("comp_top")))
        pick = F.max_by(F.struct("owner", "n", "top", "bottom", "m", "comp_top", F.col("bottom_a").alias("za"), F.col("bottom_b").alias("zb")), "top")
        heavy.groupBy("comp").agg(pick.alias("z")).write.parquet(f"{path}/centres{turn}")
        centres = F.broadcast(spark.read.parquet(f"{path}/centres{turn}"))
        keep = spark.read.parquet(f"{path}/{turn}").columns
        # which child of the centroid a vertex hangs from: its owner's prefix one turn below the centroid
        below = prefixes.select(F.col("conv_id").alias("owner"), F.col("depth").alias("at"), F.col("a").alias("child"),
                                F.col("b").alias("child_b"), "pa", "pb")
        under = F.col("top") > F.col("z.bottom")
        met = (state.select(*keep).join(centres, "comp").withColumn("at", F.when(under, F.col("z.bottom") + 1))
               .join(below, ["owner", "at"], "left"))
        inside = under & (F.col("pa") == F.col("z.za")) & (F.col("pb") == F.col("z.zb"))
        is_centre = (F.col("owner") == F.col("z.owner")) & (F.col("n") == F.col("z.n"))
        met.select(*keep, "z", "child", "child_b", F.when(is_centre, 2).when(inside, 1).otherwise(0).alias("role")).write.parquet(f"{path}/met{turn}")
        met = spark.read.parquet(f"{path}/met{turn}")
        totals = F.broadcast(met.where("role > 0").groupBy("comp").agg(F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved")))
        # the vertices above the centroid begin with prefixes of its owner
        way = (prefixes.join(centres, F.col("conv_id") == F.col("z.owner"))
               .where((F.col("depth") < F.col("z.top")) & (F.col("depth") >= F.col("z.comp_top")))
               .select("comp", F.col("depth").alias("top"), F.col("a").alias("top_a"), F.col("b").alias("top_b"), F.lit(True).alias("above")))
        rest = met.where("role = 0").join(way, ["comp", "top", "top_a", "top_b"], "left").join(totals, "comp")
        gain = lambda c: F.when(F.col("above"), F.col(c)).otherwise(0)
        new = {"m": F.col("m") - gain("z.m"), "more_leaves": F.col("more_leaves") + gain("t_leaves"),
               "more_saved": F.col("more_saved") + gain("t_saved")}
        upper = rest.select(*[new.get(c, F.col(c)).alias(c) for c in keep])
        # a component is named by the hash of its top's key and the round
        label = F.xxhash64(F.lit(turn), "child", "child_b", F.col("z.bottom"))
        lower = met.where("role = 1").select(*[(label if c == "comp" else F.col(c)).alias(c) for c in keep])
        done.append(met.where("role = 2").join(totals, "comp").select(
            "owner", "n", (F.col("t_leaves") + F.col("more_leaves")).alias("leaves"), (F.col("t_saved") + F.col("more_saved")).alias("saved")))
        turn += 1
        upper.unionByName(lower).write.parquet(f"{path}/{turn}")
    out = None
    for part in small:
        out = part if out is None else out.unionByName(part)
    alone = out.select("owner", "n", "comp", "top", "parent_owner", "parent_n", "leaves", "saved", "more_leaves", "more_saved")
    found = _solve(alone)
    for part in done:
        found = found.unionByName(part)
    return found


def prefix_trie(turns: DataFrame, conversations: DataFrame, *, solved: int = SOLVED) -> DataFrame:
    """All nodes of the trie: conv_id (the smallest conversation through it), depth, parent_conv_id, n_convs, n_children,
    n_leaves (childless nodes below or at it), saved_tokens (sum below and at it of (n_convs - 1) * chars), ends_sha256
    (of the conversations that end there).

    ``turns`` has conv_id, part, pos (their order), high and low (a turn's digest) and chars;
    ``conversations`` every conv_id, with or without turns, once or more often. Rows without
    conv_id take no part. No conversation gives no node, not even the root. The table of
    prefixes and each round are written to the shared folder.
    """
    spark = turns.sparkSession
    path = scratch_path(spark, "trie")
    known = conversations.select("conv_id").where("conv_id is not null").distinct()
    _prefixes(turns, known, f"{path}/runs").write.parquet(f"{path}/prefixes")
    prefixes, key = spark.read.parquet(f"{path}/prefixes"), ["depth", "a", "b"]
    (prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "a", "b")).alias("end")).select("conv_id", "end.*")
     .write.parquet(f"{path}/ends"))
    ends = _hashed_ends(spark.read.parquet(f"{path}/ends"), f"{path}/pieces")
    met = prefixes.groupBy(*key).agg(F.count("*").alias("n"), F.min("conv_id").alias("owner"), F.min("pa").alias("pa"),
                                     F.min("pb").alias("pb"), F.max("chars").alias("chars"))
    met.withColumn("w", (F.col("n") - 1) * F.col("chars")).write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("n_children"))
    nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))).write.parquet(f"{path}/counted")
    nodes = spark.read.parquet(f"{path}/counted")
    rows = nodes.count()
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                      F.col("owner").alias("parent_owner"), F.col("n").alias("parent_n"))
    hot = nodes.where(F.col("n_children") * HOT > rows).select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    linked = _join_hot(nodes, up, ["depth", "pa", "pb"], hot)  # at most HOT keys have so many children
    linked = linked.withColumn("parent_owner", F.when(F.col("depth") > 0, F.col("parent_owner")))
    along = running(linked, "owner", ["owner", "depth"], f"{path}/along", ("w",))
    first = lambda c: F.min_by(F.col(c) if isinstance(c, str) else c, "depth")
    last = lambda c: F.max_by(F.col(c), "depth")
    along.groupBy("owner", "n").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("w").alias("saved"),
        F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaves"), first("a").alias("top_a"), first("b").alias("top_b"),
        last("a").alias("bottom_a"), last("b").alias("bottom_b"), first(F.coalesce("parent_owner", F.lit(-1))).alias("parent_owner"),
        first(F.coalesce("parent_n", F.lit(-1))).alias("parent_n"), first(F.col("sum_w") - F.col("w")).alias("before")).write.parquet(f"{path}/forest")
    forest = spark.read.parquet(f"{path}/forest")
    sums = _rolled_up(forest.drop("before"), prefixes, f"{path}/rounds", solved)
    totals = sums.join(forest.select("owner", "n", "before", "top", "bottom"), ["owner", "n"])
    hot = forest.where((F.col("bottom") - F.col("top") + 1) * HOT > rows).select("owner", "n")
    totals.drop("top", "bottom").write.parquet(f"{path}/totals")
    full = _join_hot(along, spark.read.parquet(f"{path}/totals"), ["owner", "n"], hot)
    return full.join(ends, key, "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), (F.col("saved") - (F.col("sum_w") - F.col("w") - F.col("before"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
