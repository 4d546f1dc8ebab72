import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from yieldscope.llm import secret_scan

DICTIONARY = public_tokenizers.path("word_bpe_49k.json")


def corpus():
    draw = random.Random(3)
    hexes = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    keys = lambda: "AKIA" + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    rows = []
    for i in range(300):
        kind = i % 6
        middle = [f'token = "{hexes(40)}"', f"password={hexes(18)}", keys(), str(draw.randrange(10**15, 10**16)),
                  "INTERNATIONALLYKNOWNORGANISATION", "plain words only"][kind]
        rows.append((i, f"some wörds before {middle} and words behind"))
    return rows


def test_labelled_findings_train_a_forest_that_finds_the_rest(docs, messy):
    rows = corpus()
    source = docs(rows + messy)
    bits, forest = secret_scan.fitted(source, DICTIONARY)
    found = secret_scan.scan(source, [F.col("doc_id"), F.col("text")], bits, forest, DICTIONARY).collect()
    assert len(found) == len(rows) + len(messy)
    for r in found:
        if r.text is not None and "some w" in r.text:
            assert len(r.secrets) == (r.doc_id % 6 < 3)
            for s in r.secrets:
                assert len(r.text[s.start:s.end]) in (40, 18, 20) and r.clean == r.text[:s.start] + "[SECRET]" + r.text[s.end:]
        else:
            assert not r.secrets and r.clean == (r.text or "")


def test_trees_give_what_the_model_gives(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, len(secret_scan.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 1] > 0).astype(float)
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "f array<double>, label double").select(
        array_to_vector("f").alias("features"), "label").cache()
    model = RandomForestClassifier(numTrees=7, maxDepth=5, seed=1).fit(rows)
    forest = secret_scan.Forest(tuple(secret_scan._tree(t) for t in model.trees), 0.0)
    expected = [r.probability[1] for r in model.transform(rows).collect()]
    assert np.allclose(forest.score(x), expected)
    rows.unpersist()


def test_no_findings_and_an_empty_table(spark, docs):
    forest = secret_scan.train(spark.createDataFrame([], "features array<double>, label int"))
    assert forest.score(np.zeros((2, 16))).tolist() == [0, 0]
    bits, forest = secret_scan.fitted(docs([]), DICTIONARY)
    assert secret_scan.scan(docs([]), [F.col("doc_id")], bits, forest, DICTIONARY).count() == 0


def test_rare_secrets_train_the_forest_and_copies_count_once(spark):
    draw = np.random.default_rng(7)
    rows = [(draw.normal(size=16).tolist(), 0) for _ in range(4000)] + [((draw.normal(size=16) + 6).tolist(), 1) for _ in range(3)]
    hot = [(draw.normal(size=16).tolist(), 0)] * 4000
    for seed in (1, 2):
        forest = secret_scan.train(spark.createDataFrame(rows + hot, "features array<double>, label int"), sample=1000, seed=seed)
        score = forest.score(np.array([r[0] for r in rows]))
        assert (score[4000:] >= 0.5).all() and (score[:4000] >= 0.5).mean() < 0.01


def test_whole_values_behind_key_words_are_candidates():
    cases = {"password=hunter2x, then": "hunter2x", "my password: p@ss#word...": "p@ss#word", "api_key='hUnTerXyz'": "hUnTerXyz",
             '{"secret": "two words 7", "b": 1}': "two words 7", "/x?token=ab1&user=bob": "ab1", "passwd = a'b<c": "a'b<c",
             'token = "0123456789abcdef0123"': "0123456789abcdef0123", "auth: http://a.b/c?d": "http://a.b/c?d",
             "auth http://a.b/c": None, "the password": None, "= x": None, "password=": None, "plain: value1": None}
    raw = [c.encode() for c in cases]
    offsets, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
    found = list(zip(*(x.tolist() for x in secret_scan.candidates(offsets, data))))
    got = {t: [b"".join(raw)[a:b].decode() for u, a, b in found if u == t] for t in range(len(raw))}
    assert got == {i: [v] if v else [] for i, v in enumerate(cases.values())}


def test_short_and_odd_values_are_found_and_words_are_not(docs):
    draw = random.Random(9)
    small = lambda n: "".join(draw.choice("abcdefghkmnpqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(400):
        middle = [f"password={small(5)}{draw.randrange(10, 99)}x", f"password={small(3)}@{small(2)}#{draw.randrange(10, 99)}",
                  "password: required", "token: information", f"number {draw.randrange(10**14, 10**15)}"][i % 5]
        rows.append((i, f"some words before {middle} and words behind"))
    rows += [(1000, "a password=hunter2x here"), (1001, "a password=p@ss#word9 here")]
    source = docs(rows)
    found = secret_scan.scan(source, [F.col("doc_id"), F.col("text")], *secret_scan.fitted(source, DICTIONARY), DICTIONARY).collect()
    for r in found:
        assert len(r.secrets) == (r.doc_id >= 1000 or r.doc_id % 5 < 2), r
    clean = {r.doc_id: r.clean for r in found}
    assert clean[1000] == clean[1001] == "a password=[SECRET] here"
