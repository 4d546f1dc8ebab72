import math

import numpy as np

from yieldscope.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, score double, rank int"


def brute(rows, k):
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = {}
    for i, q in fine:
        if i % 10 == 0:
            found.setdefault(i, []).extend((-sum(a * b for a, b in zip(q, w)), j) for j, w in fine if j != i and len(w) == len(q))
    return [(i, r + 1, j, -s) for i in sorted(found) for r, (s, j) in enumerate(sorted(found[i])[:k])]


def run(spark, vectors, k=5, **more):
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in vectors], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 10 = 0"), k, **more).collect())


def test_against_brute_force_with_ties_nulls_and_repeats(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.choice([-0.5, -0.25, 0.0, 0.25, 1.0], 6)]) for i in range(150)]
    rows += [(3, [9.0] * 6), (200, None), (210, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (220, [math.nan] * 6), (230, [math.inf] * 6),
             (None, [1.0] * 6), (240, [1.0, 2.0]), (241, [3.0, -1.0]), (10, rows[10][1])]
    assert run(spark, rows, 5) == brute(rows, 5)
    assert run(spark, rows, 5, rows=16, batch=4) == brute(rows, 5)
    assert run(spark, rows, 5, rows=16, batch=2, packs=3) == brute(rows, 5)


def test_every_row_of_an_id_is_ranked(spark):
    rows = [(100, [1.0]), (1, [0.5]), (1, [0.75]), (2, [0.625]), (2, [0.625]), (7, [0.25])]
    assert [r[2:] for r in run(spark, rows)] == [(1, 768 * 1024), (2, 640 * 1024), (2, 640 * 1024), (1, 512 * 1024), (7, 256 * 1024)]
    # an id in several rows asks with all of them, and none of them is an answer
    rows += [(100, [-1.0]), (100, [1.0])]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_fewer_rows_than_asked_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [0.5])]) == [(0, 1, 1, 1024 * 512)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_signed_digits_and_real_vectors():
    for x in range(-300, 300):
        assert sum((-1 if minus else 1) << j for j, minus in topk.signed_digits(x)) == x
    draw = np.random.default_rng(1)
    values = np.floor(1024 * draw.normal(size=(500, 64)) / 8).astype(np.int64)
    ids = np.arange(500)
    index = topk.slices(values)
    for q in range(0, 500, 50):
        at, score = topk.top_of_block(q, values[q], ids, *index, 10)
        all_scores = values @ values[q]
        best = [i for i in np.lexsort((ids, -all_scores)) if i != q][:10]
        assert sorted(zip(-score, ids[at])) == [(-all_scores[i], i) for i in best]
