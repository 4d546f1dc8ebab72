import math
import random

import numpy as np
from pyspark.sql import functions as F

from yieldscope.llm import toxicity


def corpus(n):
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{draw.randrange(400)}" for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                words.insert(draw.randrange(30), draw.choice(["vile", "awful"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_rows_are_told_apart(spark, docs, messy):
    rows, labels = corpus(800)
    known = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id bigint, toxic int")
    model = toxicity.train(docs(rows), known)
    got = {r.doc_id: r.score for r in toxicity.score(docs(rows), [F.col("doc_id")], model).collect()}
    held = [i for i in got if i % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert len(model.places) < 2000
    scores = [r.score for r in toxicity.score(docs(messy), [F.col("doc_id")], model).collect()]
    assert len(scores) == len(messy) and all(0 <= s <= 1 for s in scores)


def test_without_evidence_scores_are_under_a_half(spark, docs, messy):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs(messy), none)
    assert max(r.score for r in toxicity.score(docs(messy), [F.col("doc_id")], model).collect()) < 1e-9
    assert toxicity.score(docs([]), [F.col("doc_id")], model).count() == 0
    some = spark.createDataFrame([(3, 1), (4, 0), (5, 0), (7, 0)], "doc_id bigint, toxic int")
    scores = [r.score for r in toxicity.score(docs(messy), [F.col("doc_id")], toxicity.train(docs(messy), some)).collect()]
    assert 0 < max(scores) < 0.5  # a few labels give their share, even if all are 1
    all_bad = toxicity.train(docs(messy), some.withColumn("toxic", F.lit(1)))
    assert max(r.score for r in toxicity.score(docs(messy), [F.col("doc_id")], all_bad).collect()) < 0.5


def test_learning_equals_a_plain_loop():
    draw = random.Random(6)
    rows = [(np.array(sorted(draw.sample(range(50), draw.randrange(0, 9))), np.int64), draw.randrange(2)) for _ in range(120)]
    s = toxicity.Ftrl(alpha=0.3, l1=0.7, l2=0.2, epochs=3)
    z, n = [0.0] * 51, [0.0] * 51
    for _ in range(s.epochs):
        for places, label in rows:
            features = [*places.tolist(), 50]  # the last one is the constant
            w = {}
            for i in features:
                w[i] = 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in features:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
                n[i] += g * g
    got_z, got_n = toxicity.learn(rows, s)
    at = [*range(50), 1 << toxicity.BITS]
    assert np.allclose(got_z[at], z) and np.allclose(got_n[at], n) and np.count_nonzero(got_n) == np.count_nonzero(n)


def test_a_score_of_exactly_a_half(docs):
    """Weights that cancel: the score is even, while a text without any of them has the prior."""
    data = np.frombuffer(b"vile nice", np.uint8)
    places = next(toxicity._grams(np.array([0, 9]), data))[1]
    model = toxicity.Model(places, np.array([2.0, -2.0]), 0.125)
    got = {r.doc_id: r.score for r in toxicity.score(docs([(1, "vile nice"), (2, "Nice, vile"), (3, "else"), (4, None)]), [F.col("doc_id")], model).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.125, 4: 0.125}


def test_weights_follow_the_closed_form():
    s = toxicity.Ftrl(alpha=0.5, beta=1, l1=1, l2=0.25)
    assert toxicity.weights(np.array([0.5, 3.0]), np.array([1.0, 4.0]), s).tolist() == [0, -(3 - 1) / ((1 + 2) / 0.5 + 0.25)]


def test_a_rare_word_weighs_the_same_on_both_sides_of_eight_thousand_rows(spark, docs):
    def rare(n):
        rows, labels = [], []
        for i in range(n):
            bad = i % 9 == 0
            word = "zorb" if bad and i % 500 == 0 else "vile" if bad else f"w{i % 7}"
            rows.append((i, word))
            labels.append((i, int(bad)))
        model = toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        return toxicity.score(docs([(1, "zorb")]), [F.col("doc_id")], model).first().score

    few, many = rare(7_990), rare(8_100)
    assert abs(few - many) < 0.1
