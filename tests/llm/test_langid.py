import random

import numpy as np

from yieldscope.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, lang_pred string, score double, mark__x int"
ALPHABETS = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "äöüßéèêç"}


def corpus(n=240, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang = draw.choice(list(ALPHABETS))
        words = ["".join(draw.choice(ALPHABETS[lang]) for _ in range(draw.randrange(2, 8))) for _ in range(draw.choice([1, 5, 60, 400]))]
        rows.append((i, " ".join(words), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 2.0, 1) for r in rows], SCHEMA).repartition(3)


def test_learns_held_out_texts(spark):
    rows = corpus()
    df = frame(spark, rows)
    net = langid.train(df.where("doc_id % 3 <> 1"), settings=langid.Settings(filters=8, steps=200))
    found = {r["doc_id"]: r for r in langid.predict(df, [df["doc_id"]], net).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 3 == 1]
    assert sum(found[i]["lang_pred"] == lang for i, lang in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    again = langid.train(df.repartition(5).where("doc_id % 3 <> 1"), settings=langid.Settings(filters=8, steps=200))
    assert all((a == b).all() for a, b in zip(net.tables, again.tables))  # the same whatever the partitions


def test_messy_texts_and_no_model(spark, messy):
    net = langid.Network(("p", "q"), (np.ones((2, 256, 1), np.float32),), (np.zeros(1, np.float32),),
                         np.array([[1.0, 1.0]], np.float32), np.zeros(2, np.float32))
    rows = [(i, t, None) for i, t in messy] + [(8, "123 !", "p"), (9, "x", "p"), (9, "x", "p")]
    df = frame(spark, rows)
    found = [tuple(r) for r in langid.predict(df, [df["doc_id"]], net).collect()]
    assert len(found) == len(rows)
    by_id = {}
    for i, lang, score in found:
        by_id.setdefault(i, []).append((lang, round(score, 6)))
    for i in (1, 2, 6, 8):
        assert by_id[i] == [("und", 0.0)]
    assert by_id[9] == [("p", 0.5)] * 2  # a tie goes to the language that sorts first
    assert langid.train(df.where("false")) is None
    assert langid.train(frame(spark, [(1, "abc", None), (2, None, "p"), (3, "12", "p")])) is None
    assert {tuple(r)[1:] for r in langid.predict(df, [df["doc_id"]], None).collect()} == {("und", 0.0)}
    assert langid.predict(df.where("false"), [df["doc_id"]], net).collect() == []


def test_probabilities_of_whole_texts_are_those_of_their_windows():
    draw = np.random.default_rng(0)
    net = langid.Network(("p", "q", "r"), tuple(draw.normal(size=(w, 256, 5)).astype(np.float32) for w in (2, 3)),
                         tuple(draw.normal(size=5).astype(np.float32) for _ in range(2)), draw.normal(size=(10, 3)).astype(np.float32),
                         draw.normal(size=3).astype(np.float32))
    data = draw.integers(0, 256, 700).astype(np.uint8)
    windows, text, lengths = langid._cut(np.array([0, 0, 3, 700]), data)
    assert text.tolist() == [1, 2, 2, 2] and lengths.tolist() == [3, 256, 256, 185]
    for row, (a, n) in zip(net.chances(windows), ((0, 3), (3, 256), (259, 256), (515, 185))):
        window = np.zeros(langid.WINDOW, np.uint8)
        window[:n] = data[a:a + n]
        pooled = []
        for table, bias in zip(net.tables, net.biases):  # one place and filter after another
            for f in range(table.shape[2]):
                best = max(sum(float(table[k][window[i + k], f]) for k in range(len(table))) for i in range(langid.WINDOW - len(table) + 1))
                pooled.append(max(0.0, best + float(bias[f])))
        z = np.array(pooled) @ net.dense + net.shift
        assert np.allclose(row, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-4)


def test_gradients_by_differences():
    draw = np.random.default_rng(2)
    parts = [draw.normal(size=(2, 256, 3)), draw.normal(size=(3, 256, 3)), draw.normal(size=3) + 1, draw.normal(size=3) + 1,
             draw.normal(size=(6, 2)), draw.normal(size=2)]
    windows, labels = draw.integers(97, 100, (9, 20)).astype(np.uint8), draw.integers(0, 2, 9)

    def network():
        return langid.Network(("p", "q"), tuple(parts[:2]), tuple(parts[2:4]), parts[4], parts[5])

    def loss():
        pooled, _ = network().pooled(windows)
        p = langid._softmax(pooled @ parts[4] + parts[5])
        return -np.log(p[np.arange(9), labels]).mean()

    for x, g in zip(parts, langid.gradients(network(), windows, labels)):
        for at in [tuple(draw.integers(0, s) if s != 256 else draw.integers(97, 100) for s in x.shape) for _ in range(6)]:
            kept = x[at]
            x[at] = kept + 1e-6
            up = loss()
            x[at] = kept - 1e-6
            down = loss()
            x[at] = kept
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4
