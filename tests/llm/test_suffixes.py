import hashlib
import random
from collections import Counter

import numpy as np

from yieldscope.llm import suffixes


def test_suffix_arrays_and_common_prefixes():
    draw = random.Random(3)
    for _ in range(400):
        text = np.array([draw.randint(0, draw.choice([1, 2, 5])) for _ in range(draw.randint(1, 60))])
        order = suffixes.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    big = np.array([draw.randint(0, 300) for _ in range(3000)] * 2)
    assert suffixes.suffix_array(big).tolist() == sorted(range(6000), key=lambda i: big[i:].tolist())


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for at in range(len(t) - length + 1):
            if count[t[at:at + length]] > 1:
                gone[at:at + length] = True
        starts = np.flatnonzero(gone[:-1] & ~np.append(False, gone[:-2])) if len(t) else []
        out.append((str(i), len(t), int(gone.sum()), len(starts), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_bytes, sum(x.end - x.first for x in r.spans), len(r.spans), r.kept) for r in df.collect())


def test_against_brute_force(docs, messy):
    draw = random.Random(6)
    shared = "".join(draw.choice("abcdefgh ") for _ in range(300))
    rows = [r for r in messy if len(r[1] or "") < 10_000]
    for i in range(60):
        own = "".join(draw.choice("abcdefgh é") for _ in range(draw.randint(0, 150)))
        a = draw.randrange(200)
        piece = shared[a:a + draw.randint(0, 100)]
        if piece and draw.random() < 0.5:  # a near copy of the piece
            k = draw.randrange(len(piece))
            piece = piece[:k] + "#" + piece[k + 1:]
        rows.append((100 + i, own[:50] + piece + own[50:]))
    rows += [(500, rows[-1][1]), (501, "ab" * 200), (502, "ab" * 150 + "c"), (503, "a" * 90)]
    expected = brute(rows, 40)
    assert sum(r[2] for r in expected) > 3000
    for most in (300, 2, 1):
        assert result(suffixes.remove_repeats(docs(rows), length=40, gram=8, most=most)) == expected


def test_an_empty_table(docs):
    assert suffixes.remove_repeats(docs([])).count() == 0


def test_passages_are_found_from_the_length_on(docs):
    """Passages of 300 to 900 bytes that stand in two documents each: all of 400 bytes or more go, no shorter one."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(3, 10)))
    text = lambda n: " ".join(word() for _ in range(n))
    sizes = [*range(300, 400, 9), 398, 399, 400, 401, *range(402, 900, 31)]
    passages = [text(300)[:n - 2] for n in sizes]
    rows = []
    for i, p in enumerate(passages):
        for copy in (0, 1):  # marks beside the passage that differ, so that it ends where it ends
            rows.append((2 * i + copy, f"{text(60)} {'#$'[copy]}<{p}>{'%&'[copy]} {text(60)}"))
    rows += [(1000 + i, text(200)) for i in range(20)]
    found = {r.doc_id: sum(s["end"] - s["first"] for s in r.spans) for r in suffixes.remove_repeats(docs(rows), length=400).collect()}
    for i, n in enumerate(sizes):
        assert found[2 * i] == found[2 * i + 1] == (n if n >= 400 else 0), n
    assert not any(found[1000 + i] for i in range(20))


def test_segments_of_an_anchor_meet_whatever_join_they_come_from(spark):
    """A join that is planned by sorting and turns into a broadcast reads its other side file by file."""
    draw = random.Random(21)
    text = lambda n: bytes(draw.choice(b"abcdefghijklmnop ") for _ in range(n))
    rows, expected = [], []
    for key in range(200):  # a passage in two segments of each key
        passage = text(draw.randint(400, 500))
        for name in (0, 1):
            front = text(draw.randint(1, 50)) + b"<>"[name:name + 1]
            rows.append((key, name, front + passage + b"()"[name:name + 1]))
            expected.append((key, name, len(front), len(front) + len(passage) - 400))
    draw.shuffle(rows)
    set_to = {"spark.sql.autoBroadcastJoinThreshold": "30k",  # more than the keys have, less than the segments
              "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in set_to}
    try:
        for k, v in set_to.items():
            spark.conf.set(k, v)
        segments = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "key bigint, name bigint, bytes binary")
        keys = spark.createDataFrame(spark.sparkContext.parallelize([(k,) for k in range(200)], 2), "key bigint")
        assert sorted(tuple(r) for r in suffixes._shard_ranges(segments.join(keys, "key"), 400).collect()) == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
