import random
import re

from pyspark.sql import functions as F

from yieldscope.llm.decontaminate import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    found = {}
    for i, (_, text) in enumerate(docs):
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(window, len(v))
            for k in range(len(v) - n + 1 if n and name is not None else 0):
                for at in range(len(w) - n + 1):
                    if w[at:at + n] == v[k:k + n]:
                        hit |= set(range(at, at + n))
                        names.add(str(name))
        found[i] = (len(w), len(hit), sorted(names))
    return sorted(found.values())


def result(df):
    return sorted((r.n_words, sum(x.end - x.first for x in r.runs), r.items) for r in df.collect())


def case(messy):
    draw = random.Random(2)
    word = lambda: draw.choice("abcde")
    docs = [(i, " ".join(word() for _ in range(draw.randint(0, 60)))) for i in range(60)] + [r for r in messy if len(r[1] or "") < 4000]
    items = [(i, " ".join(word() for _ in range(draw.randint(0, 7)))) for i in range(12)] + [(3, "a b c d"), (None, "a"), (90, None), (91, "...")]
    return docs, items


def test_against_brute_force_in_one_block_and_in_several(spark, docs, messy):
    rows, items = case(messy)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute(rows, items, 4)
    for size in (1 << 20, 40):
        assert result(decontaminate(docs(rows), bench, [F.col("doc_id")], window=4, block_bytes=size)) == expected


def test_long_text_and_empty_tables(spark, docs, messy):
    bench = spark.createDataFrame([(1, " ".join(messy[6][1].split()[9000:9012]))], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate(docs(messy), bench, [F.col("doc_id")]).collect()}
    assert got[5].n_words == 20_000 and [(x.first, x.end) for x in got[5].runs] == [(9000, 9012)]
    assert decontaminate(docs([]), bench, [F.col("doc_id")]).count() == 0
    none = decontaminate(docs(messy), bench.limit(0), [F.col("doc_id")])
    assert none.count() == len(messy) and none.where("size(items) > 0 or size(runs) > 0").count() == 0
