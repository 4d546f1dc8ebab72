import random
import zlib

from yieldscope.llm import ring


def one_by_one(counts, owner, shards):
    """Rows placed singly: every arc's rows in order, hop by hop."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    left = [[(a, r) for r in range(n)] for a, n in enumerate(counts)]
    place, used = {}, [0] * shards
    for hop in range(shards):
        for a in range(len(counts)):
            order = list(dict.fromkeys(owner[a:] + owner[:a]))
            if hop < len(order):
                s = order[hop]
                while left[a] and used[s] < room[s]:
                    place[left[a].pop(0)] = (s, used[s])
                    used[s] += 1
    return place


def test_arcs_are_filled_as_rows_one_by_one_would_be():
    draw = random.Random(4)
    for _ in range(50):
        shards = draw.randint(1, 6)
        owner = [draw.randrange(shards) for _ in range(20)] + list(range(shards))
        counts = [draw.choice([0, 1, 5, 40]) for _ in owner]
        got = {(a, r): (s, base + r - low) for a, low, high, s, base in ring.fill(counts, owner, shards) for r in range(low, high)}
        assert got == one_by_one(counts, owner, shards)


def test_counts_slots_and_independence_of_partitions(docs, messy):
    rows = messy + [(i, f"text {i}") for i in range(100, 700)] + [(9, "copy")] * 300
    first = sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in ring.shard(docs(rows, 2), shards=7).collect())
    other = sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in ring.shard(docs(rows, 5), shards=7).collect())
    assert first == other and len(first) == len(rows)
    sizes = [sum(r[3] == s for r in first) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r[4] for r in first if r[3] == s) == list(range(sizes[s]))
    expected = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(r[:3] for r in first) == expected


def test_an_empty_table(docs):
    assert ring.shard(docs([])).count() == 0
