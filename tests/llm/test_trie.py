import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from yieldscope.llm import ordered, trie
from yieldscope.session import scratch_path

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth bigint, n bigint, owner string, a double"


def brute(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            mark = hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
            talks[c].append(((turn is not None, turn or 0, mark), (r, t)))
    talks = {c: [x for _, x in sorted(v)] for c, v in talks.items()}
    rebuilt = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -((-c) % 100))
        rebuilt[c] = talks.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, w in rebuilt.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    def below(node):
        yield node
        for k in children[node]:
            yield from below(k)

    for node, conv in members.items():
        all_below = list(below(node))
        ends = ",".join(str(c) for c in sorted(c for c in conv if len(rebuilt[c]) == len(node)))
        out.append((min(conv), len(node), min(members[node[:-1]]) if node else None, len(conv), len(children[node]),
                    sum(not children[k] for k in all_below),
                    sum((len(members[k]) - 1) * len(k[-1][1]) for k in all_below if k),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=5, **more):
    df = spark.createDataFrame([(*r, 7, 8, "x", 0.5) for r in rows], SCHEMA).repartition(parts)
    turns = trie.ordered_turns(df, scratch_path(spark, "turns"))
    found = trie.prefix_trie(trie.share_openings(turns), df, **more)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def messy():
    draw = random.Random(4)
    rows = []
    for c in [*range(90), *range(300, 330), -7, -100]:
        for turn in range(draw.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(["a", "bb", "ünï 😀", ""])))
    rows += [(5, 1, "user", "twice"), (5, 1, "user", "twice"), (5, None, None, None), (6, None, "user", None), (None, 1, "user", "x"),
             (1000, 0, "system", "x" * 5000), (1001, 0, None, "only")]
    return rows


def test_whole_query_against_brute_force(spark):
    rows = messy()
    assert run(spark, rows) == brute(rows)


def test_components_split_by_joins(spark):
    rows = messy()
    assert run(spark, rows, solved=6) == brute(rows)


def test_hot_opening_long_conversation_and_copies(spark):
    rows = [(c, t, "user", f"{t if t < 2 else (c % 7 if t < 4 else c)}") for c in range(100, 400) for t in range(6)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1100) for t in range(3)]
    rows += [(5000, t, "user", str(t % 3)) for t in range(800)]
    expected = brute(rows)
    assert run(spark, rows) == expected
    assert run(spark, rows, solved=50) == expected


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


def test_decomposition_equals_plain_sums():
    draw = random.Random(1)
    for n in (1, 2, 3, 40, 400):
        for kind in ("any", "path", "star", "forest"):
            parent = [-1] + [{"any": draw.randrange(v), "path": v - 1, "star": 0, "forest": draw.randrange(-1, v)}[kind] for v in range(1, n)]
            values = np.array([[draw.randrange(9), draw.randrange(9)] for _ in range(n)], np.int64)
            plain = values.copy()
            for v in range(n - 1, 0, -1):
                if parent[v] >= 0:
                    plain[parent[v]] += plain[v]
            assert (trie.decompose(parent, values) == plain).all()


def test_running_over_many_slices(spark):
    draw = random.Random(2)
    rows = [(draw.choice([1, 1, 1, 2, 3, 4]), i, draw.randrange(1 << 60)) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for base in (1, 12345677):
            df = spark.createDataFrame(rows, "g bigint, at bigint, v bigint")
            got = ordered.running(df, "g", ["g", "at"], scratch_path(spark, "run"), ("v",), base)
            assert got.select("slice__").distinct().count() > 4
            sums, seen = defaultdict(int), defaultdict(int)
            for r in sorted(got.collect()):
                assert r["rank__"] == seen[r["g"]]
                sums[r["g"]] = (sums[r["g"]] + r["v"] * pow(base, seen[r["g"]], 1 << 64)) % (1 << 64)
                seen[r["g"]] += 1
                assert r["sum_v"] % (1 << 64) == sums[r["g"]]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
