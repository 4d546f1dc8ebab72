import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from yieldscope.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, slice int, idx bigint, cost string, audit int"
INITIAL = {1: "u", 2: "u", 3: "a"}


def cheapest(rows):
    """(cost, audit) of rows (initial, must go, truncated) by trying all edits."""

    @lru_cache(None)
    def go(i, state, inserts):
        due, expected = (2 if state != 2 else 3), ("a" if state == 2 else "u")
        choices = []
        if i == len(rows):
            if state in (0, 3):
                choices.append((0, ""))
        else:
            initial, must, cut = rows[i]
            options = [(3, "D", state)]
            if not must:
                if initial == expected:
                    options.append((cut, "K", due))
                if initial == "s" and state == 0:
                    options.append((cut, "K", 1))
                options.append((2 + cut, "R", due))
            for cost, letter, to in options:
                rest = go(i + 1, to, 0)
                choices.append((cost + rest[0], letter + rest[1]))
        if inserts < 3:
            rest = go(i, due, inserts + 1)
            choices.append((2 + rest[0], "I" + rest[1]))
        return min(choices, default=(10 ** 9, ""))

    return go(0, 0, 0)


def brute(rows, damage=False):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is None:
            continue
        talks[c]
        times = 1
        if damage:
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
            times = {0: 0, 3: 2}.get(k, 1)
            text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
            role = "user" if k == 4 else role
        talks[c] += [(turn, role or "", text or "")] * times
    out = []
    for c, all_rows in talks.items():
        all_rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marks, faults = set(), [], [0, 0, 0]
        for _, role, text in all_rows:
            core = text.strip(" \t\n\x0b\x0c\r")
            kind = 0 if not core else 1 if (role, text) in seen else 2 if core[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                faults[kind] += 1
            marks.append((role[:1], kind in (0, 1), int(kind == 2)))
        cost, audit = cheapest(tuple(marks))
        lines, state, at = [], 0, 0
        for letter in audit:
            name = "assistant" if state == 2 else "user"
            if letter == "I":
                lines.append(name + ":")
                state = 3 if state == 2 else 2
                continue
            _, role, text = all_rows[at]
            at += 1
            if letter == "K":
                lines.append(f"{role}:{text}")
                state = 1 if role[:1] == "s" else 3 if state == 2 else 2
            elif letter == "R":
                lines.append(f"{name}:{text}")
                state = 3 if state == 2 else 2
        known = {r[0] for r in all_rows if r[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        initials = [m[0] for m in marks]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((c, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(parts)


def run(spark, rows, damage=False):
    df = frame(spark, rows)
    found = repair.repair(repair.damaged(df) if damage else df, df)
    assert found.columns == ["conv_id", *repair.RESULTS]
    return sorted(tuple(r) for r in found.collect())


def messy(seed=1):
    draw = random.Random(seed)
    texts = ["Yes.", "no", " ", "", "What?", "so\n", "Ünï 😀!", "\t\x0b.", "x" * 3000, None]
    roles = ["user", "assistant", "system", "tool", "", None, "uncle"]
    rows = [(c, draw.choice([None, *range(9)]), draw.choice(roles[:2] if draw.random() < 0.7 else roles), draw.choice(texts))
            for c in [*range(60), -3, -100] for _ in range(draw.choice([1, 2, 3, 4, 7, 12]))]
    return rows + [(None, 1, "user", "x."), (700, None, None, None), (701, 0, "system", "Only."), (702, None, "user", "a."), (702, None, "user", "a.")]


@pytest.mark.parametrize("damage", [False, True])
def test_against_brute_force(spark, damage):
    rows = messy()
    assert run(spark, rows, damage) == brute(rows, damage)


def test_one_conversation_over_many_slices_and_parts(spark, monkeypatch):
    monkeypatch.setattr(repair, "PART", 7)
    draw = random.Random(8)
    rows = [(5, i if i % 9 else None, draw.choice(["user", "assistant", "system", "user", "x"]), draw.choice(["a.", "b", f"{i}.", f"{i}", ""]))
            for i in range(600)]
    rows += messy(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_conversation_longer_than_a_slice_holds(spark):
    rows = [(1, 0, "user", "a."), (2, 0, "user", "b."), (9, 0, "user", "z."), (10, 1, "assistant", "c.")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"{i} " + "y" * (1 << 20)) for i in range(10)]
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
    df = frame(spark, [(4, 1, "user", "x"), (None, 1, "user", "x")])
    assert [tuple(r) for r in repair.repair(df.where("false"), df).collect()] == [
        (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_block_tables_equal_single_steps():
    table = repair.Tables()
    draw = random.Random(5)
    assert len(table.vectors) < 100
    for _ in range(300):
        symbols = [draw.randrange(repair.SYMBOLS) for _ in range(draw.randrange(0, 14))]
        rows = tuple(("suax"[(s - 1) // 2] if s else "x", s == 0, int(s > 0 and s % 2 == 0)) for s in symbols)
        before, cost, marks = table.back(symbols)
        letters, state = "", 0
        for edit, _, state in table.trace(symbols, marks, 0):
            letters += edit
        assert (cost + table.vectors[before][0], letters + table.tail[state]) == cheapest(rows)
