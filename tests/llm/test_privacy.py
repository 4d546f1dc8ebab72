import math
import random
import re

from pyspark.sql import functions as F

from yieldscope.llm import privacy


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(x):
    return re.sub("[^0-9]", "", x)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15)]


def brute(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m[0])]


def spans(row):
    return [(b.kind, b.start, b.end) for b in row.base]


def test_base_spans_against_plain_patterns(docs, messy):
    draw = random.Random(4)
    parts = ["a", "Z", "9", "0", ".", "@", "-", "+", " ", "(", ")", "é", "😀", "4111 1111 1111 1111", "4111111111111112",
             "x.y@mail.example.com", "10.0.0.255", "1.2.3.256", "+49 (30) 123-4567", "00.01.02.0003", "_", "%"]
    rows = messy + [(10 + i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))) for i in range(800)]
    got = privacy.disclosures(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert spans(r) == brute(r.text), r.text


def test_many_matches_and_long_runs(docs):
    many = "1.1.1.1 " * 2000
    run = "a" * 300_000
    got = {r.doc_id: r for r in privacy.disclosures(docs([(1, many), (2, run), (3, "1" * 200_000), (4, "a@b" + ".c" * 50_000)])).collect()}
    assert spans(got[1]) == brute(many) and got[2].base == [] and got[3].base == []
    assert spans(got[4]) == [("email", 0, 100_003)]


def test_terms_that_only_stand_with_an_entity_become_spans(docs):
    rows = [(i, f"Call the zorblat of ann@x.org, number {i} of the list, today") for i in range(6)]
    rows += [(100 + i, "the list of the number and today is open, call us") for i in range(80)]
    got = {r.doc_id: r for r in privacy.disclosures(docs(rows)).select("doc_id", "base", "terms", privacy.sanitised().alias("clean")).collect()}
    assert {t.term for t in got[2].terms} == {"zorblat"}
    assert got[2].clean == "Call the  of [EMAIL], number 2 of the list, today"
    assert all(not got[i].terms and got[i].clean == rows[i - 94][1] for i in range(100, 180))


def test_few_mentions_prove_nothing_and_an_empty_table(docs):
    few = privacy.disclosures(docs([(1, "ann@x.org zorblat"), (2, "nothing here")]))
    assert few.where(F.size("terms") > 0).count() == 0
    assert privacy.disclosures(docs([])).count() == 0


def degrees(rows, entity, near=120, prior=0.5):
    """Term to degree for one e-mail address, counted document by document."""
    words = lambda x: {w.lower() for w in re.findall(r"[^\W\d_][^\W_'-]*(?:['-]*[^\W_]*)*", x) if len(w) > 2}
    holders = [t for _, t in rows if entity in t]
    p = len(holders) / len(rows)
    out = {}
    for term in set().union(*map(words, holders)) - words(entity):
        n_t = sum(term in words(t) for _, t in rows)
        out[term] = math.log(((len([t for t in holders if term in words(t)]) + prior * p) / (n_t + prior)) / p) / math.log(1 / p)
    return out


def test_terms_against_plain_counts_at_every_count(docs):
    """Rare terms beside an entity of one, two or five documents become spans, common words do not."""
    draw = random.Random(9)
    common = ["morning", "river", "walked", "house", "yellow", "letter", "window", "market"]
    phrase = lambda: " ".join(draw.sample(common, 4))
    rows = [(1, f"{phrase()} quillon ann@x.org {phrase()}"), (2, f"{phrase()} vortane bob@y.org {phrase()}"),
            (3, f"{phrase()} vortane bob@y.org {phrase()}")]
    rows += [(4 + i, f"{phrase()} meldrin {phrase()} cat@z.org") for i in range(5)]
    rows += [(9 + i, f"{phrase()} {'meldrin' if i % 2 else 'quillon'} {phrase()}") for i in range(2)]
    rows += [(100 + i, f"{phrase()} {phrase()}") for i in range(400)]
    got = {r.doc_id: r for r in privacy.disclosures(docs(rows)).collect()}
    for i, entity in ((1, "ann@x.org"), (2, "bob@y.org"), (5, "cat@z.org")):
        want = {t: d for t, d in degrees(rows, entity).items() if d >= 0.75}
        assert {t.term: t.removed for t in got[i].terms} == {t: d >= 0.95 for t, d in want.items()}
        assert set(want) <= {"quillon", "vortane", "meldrin"}
    assert {t.term for t in got[1].terms} == {"quillon"} and {t.term for t in got[3].terms} == {"vortane"}
    assert {t.term for t in got[6].terms} == {"meldrin"}
    assert all(not got[i].terms for i, _ in rows if i >= 9)
