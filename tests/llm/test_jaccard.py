import random
import re

import numpy as np
import pytest

from yieldscope.llm import jaccard


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    out = []
    for i, (name, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((str(name), len(sets[i]), min(same) if same and sets[i] else name))
    return sorted(out, key=str)


def result(df):
    return sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows(messy):
    draw = random.Random(9)
    out = [r for r in messy if len(r[1] or "") < 10_000]
    passage = [f"p{i}" for i in range(30)]
    for g in range(6):
        base = [f"g{g}w{draw.randrange(500)}" for _ in range(draw.choice([40, 80]))] + passage
        for _ in range(draw.choice([2, 25, 50])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2, 3, 4])):
                copy[draw.randrange(len(copy))] = f"e{draw.randrange(10**6)}"
            out.append((1000 + len(out), " ".join(copy).capitalize()))
    out += [(100 + i, " ".join([f"u{i}_{k}" for k in range(10)] + passage)) for i in range(40)]
    return out + [(50, "a b"), (51, "A  b"), (52, "b a"), (None, "a b"), (53, None)]


@pytest.mark.parametrize("size, percent, part", [(4, 85, 200), (4, 85, 4), (5, 80, 3), (3, 60, 5)])
def test_against_brute_force(docs, rows, size, percent, part):
    assert result(jaccard.near_duplicates(docs(rows), size=size, percent=percent, part_sets=part)) == brute(rows, size, percent)


def test_empty_table_and_thresholds_too_low(docs):
    assert jaccard.near_duplicates(docs([])).count() == 0
    with pytest.raises(ValueError):
        jaccard.near_duplicates(docs([]), percent=50)


def test_search_by_occurrences():
    draw = random.Random(1)
    lists, sets = jaccard.Lists(), []
    for i in range(300):
        held = draw.sample(range(60), draw.randint(1, 30)) + ([99] if i % 2 else [])
        lists.add(i, held)
        sets.append(set(held))
    for _ in range(100):
        asked = draw.sample(range(60), draw.randint(1, 30)) + [99]
        least = draw.randint(1, len(asked))
        found = {i: n for i, n in lists.at_least(asked, least)}
        assert found == {i: len(s & set(asked)) for i, s in enumerate(sets) if len(s & set(asked)) >= least}


def test_long_lists_are_set_aside_without_loss():
    sets = [np.sort(np.random.default_rng(i).choice(80, 40, replace=False)).astype(np.uint64) for i in range(200)]
    links, _ = jaccard.search(sets, 60)
    for i in range(200):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 60 * (80 - n):
                assert links.root(i) == links.root(j)


def test_a_batch_is_cut_into_sets_bit_by_bit(monkeypatch, docs, rows):
    """No task holds the sets of a whole batch at once; what is found does not change."""
    monkeypatch.setattr(jaccard, "CHUNK", 2_000)
    sizes, sets_of = [], jaccard.sets_of
    monkeypatch.setattr(jaccard, "sets_of", lambda o, d, size: sizes.append((len(d), len(o) - 1)) or sets_of(o, d, size))
    source = docs(rows)
    got = {}

    class Here:
        """The function that tasks run, on all rows as one batch."""

        def __init__(self, df):
            self.df, self.sparkSession, self.columns, self.schema = df, df.sparkSession, df.columns, df.schema

        def select(self, *some):
            return Here(self.df.select(*some))

        def mapInArrow(self, run, schema):
            table = self.df.toArrow().combine_chunks()
            got["rows"] = [r for b in run(iter(table.to_batches())) for r in b.to_pylist()]
            return got["rows"]

    jaccard._described(Here(source), 4)
    assert max(n for n, texts in sizes if texts > 1) <= 2_000 and len(sizes) > 10
    found = sorted((str(r["doc_id"]), r["n"]) for r in got["rows"] if r["sid"] is not None)
    assert found == sorted((str(i), len(shingles(t, 4))) for i, t in rows)
