"""Repair of conversation structure: the cheapest edits that give ``(s?(ua)+)?``, by block tables.

A row is one of nine symbols: one that must go (blank or a copy), or one of the role initials
s, u, a and other, truncated or not. The grammar has four states (nothing yet, after the system
turn, after a user turn, after an assistant turn). The costs to go from the four states differ
by a few units at most, so with their minimum taken off only some vectors ever occur. A table
made once in a worker holds, for each vector and each block of ``BLOCK`` symbols, the vector
before the block and what it adds. Conversations are worked off from their ends, block by
block; the way through is then traced forward, each block expanded backward into the vectors
between its rows, and of equally cheap edits the one with the smallest letter is taken.

Conversations that lie inside one sorted slice are repaired where they lie. The others, the
first and last of each slice and very long ones, are cut into parts; a part is a map from
the vector behind it to the vector before it, and then from state to state, so only one short
record for each part meets those of the same conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldscope.llm.texts import worker_state
from yieldscope.session import scratch_path

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1  # fixed values: costs of the edits
SPACE = " \t\n\x0b\x0c\r"
BLOCK, SYMBOLS = 4, 9
#: Bytes of a conversation that a slice holds at once, and rows of a part of a longer one.
HELD, PART = 8 << 20, 1 << 16
#: For each state, the one that a turn of the role due next leads to, and that role.
_DUE, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_FAR = 1 << 20


def _kept(state: int, initial: int) -> int | None:
    """The state after keeping a row with the initial (0 s, 1 u, 2 a, 3 other), if it may stand there."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row itself."""
    out = [("D", DELETE, state)]
    if symbol:
        initial, cut = divmod(symbol - 1, 2)
        to = _kept(state, initial)
        if to is not None:
            out.append(("K", TRUNCATED * cut, to))
        out.append(("R", REROLE + TRUNCATED * cut, _DUE[state]))
    return out


def _with_inserts(costs: list[int]) -> list[int]:
    two, three = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return [min(costs[0], INSERT + two), min(costs[1], INSERT + two), two, three]


class Tables:
    """Normalised cost vectors and what symbols and blocks of symbols do to them, from the end backward."""

    def __init__(self):
        end = tuple(_with_inserts([0, _FAR, _FAR, 0]))
        self.vectors, place, steps = [end], {end: 0}, []
        for vector in self.vectors:  # grows while vectors are found
            for symbol in range(SYMBOLS):
                costs = _with_inserts([min(c + vector[to] for _, c, to in _edits(symbol, q)) for q in range(4)])
                low = min(costs)
                fresh = tuple(c - low for c in costs)
                if fresh not in place:
                    place[fresh] = len(self.vectors)
                    self.vectors.append(fresh)
                steps.append((place[fresh], low))
        n = len(self.vectors)
        step = np.array(steps, np.int64).reshape(n, SYMBOLS, 2)
        self.step_to, self.step_cost = step[:, :, 0], step[:, :, 1]
        # a block's code has its first symbol as the highest digit; the last symbol acts first
        to, cost = np.arange(n)[:, None], np.zeros((n, 1), np.int64)
        for _ in range(BLOCK):
            to, cost = (self.step_to[to].transpose(0, 2, 1).reshape(n, -1),
                        (cost[:, :, None] + self.step_cost[to]).transpose(0, 2, 1).reshape(n, -1))
        self.block_to, self.block_cost = to, cost
        self._to, self._cost = self.block_to.tolist(), self.block_cost.tolist()
        self._one, self._one_cost = self.step_to.tolist(), self.step_cost.tolist()
        self.way = {(v, s, q): self._way(v, s, q) for v in range(n) for s in range(SYMBOLS) for q in range(4)}
        self.tail = {q: "I" * (self.vectors[0][q] // INSERT) for q in range(4)}

    def _way(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """(letters, next state) of the cheapest edits at a row, ties by the smaller letter."""
        behind = self.vectors[after]
        own = [min(c + behind[to] for _, c, to in _edits(symbol, q)) for q in range(4)]
        best, letters = _with_inserts(own), ""
        while True:
            choices = [(letter, to) for letter, c, to in _edits(symbol, state) if c + behind[to] == best[state]]
            if INSERT + best[_DUE[state]] == best[state]:
                choices.append(("I", _DUE[state]))
            letter, to = min(choices)
            letters, state = letters + letter, to
            if letter != "I":
                return letters, state

    def code(self, symbols, at: int) -> int:
        out = 0
        for s in symbols[at:at + BLOCK]:
            out = out * SYMBOLS + s
        return out

    def back(self, symbols, after: int = 0) -> tuple[int, int, list[int]]:
        """(vector before all symbols, cost taken off, vector behind each block from the last to the first)."""
        at, cost, marks = len(symbols), 0, []
        while at >= BLOCK:
            at -= BLOCK
            marks.append(after)
            code = self.code(symbols, at)
            cost += self._cost[after][code]
            after = self._to[after][code]
        marks.append(after)
        for i in range(at - 1, -1, -1):
            cost += self._one_cost[after][symbols[i]]
            after = self._one[after][symbols[i]]
        return after, cost, marks

    def trace(self, symbols, marks: list[int], state: int) -> Iterator[tuple[str, int, int]]:
        """(letters, state before them, state after) of each row, blocks expanded backward one at a time."""
        at, size = 0, len(symbols) % BLOCK
        for after in reversed(marks):
            inner = []
            for i in range(at + size - 1, at - 1, -1):
                inner.append(after)
                after = self._one[after][symbols[i]]
            for i in range(at, at + size):
                letters, to = self.way[inner.pop(), symbols[i], state]
                yield letters, state, to
                state = to
            at, size = at + size, BLOCK

    def backs(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector before, cost taken off) for every vector behind the symbols."""
        at, to, cost = len(symbols), np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        listed = symbols.tolist()
        while at >= BLOCK:
            at -= BLOCK
            code = self.code(listed, at)
            cost += self.block_cost[to, code]
            to = self.block_to[to, code]
        for i in range(at - 1, -1, -1):
            cost += self.step_cost[to, listed[i]]
            to = self.step_to[to, listed[i]]
        return to, cost


def tables() -> Tables:
    return worker_state(("repair",), Tables)


def written(letters: str, state: int, role: str | None, text: str | None) -> Iterator[str]:
    """The lines that a row's edits leave: inserted turns, and the row itself unless it goes."""
    for letter in letters:
        if letter == "I":
            yield _ROLE[state] + ":"
            state = _DUE[state]
        elif letter == "K":
            yield f"{role}:{text}"
        elif letter == "R":
            yield f"{_ROLE[state]}:{text}"


#: Role initials that may follow each other.
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _illegal(initials: list[int]) -> int:
    return sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))


def _symbols(codes: list[int], copies: list[bool]) -> tuple[list[int], list[int]]:
    """Symbols of rows, and how many are blank, duplicate and truncated."""
    out, faults = [], [0, 0, 0]
    for code, copy in zip(codes, copies):
        initial, kind = divmod(code, 3)
        fault = 0 if kind == 0 else 1 if copy else 2 if kind == 2 else None
        if fault is not None:
            faults[fault] += 1
        out.append(0 if kind == 0 or copy else 1 + 2 * initial + (kind == 2))
    return out, faults


def _settled(turns: list, roles: list[str], texts: list[str], codes: list[int]) -> tuple:
    """All results of one conversation."""
    table, seen, copies = tables(), set(), []
    for pair in zip(roles, texts):
        copies.append(pair in seen)
        seen.add(pair)
    symbols, faults = _symbols(codes, copies)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    before, cost, marks = table.back(symbols)
    audit, lines, state = [], [], 0
    for i, (letters, at, to) in enumerate(table.trace(symbols, marks, 0)):
        audit.append(letters)
        lines.extend(written(letters, at, roles[i], texts[i]))
        state = to
    audit.append(table.tail[state])
    lines.extend(written(table.tail[state], state, None, None))
    return (gaps, *faults, _illegal([c // 3 for c in codes]), cost + table.vectors[before][0], "".join(audit),
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
RESULTS = [x.split()[0] for x in _RESULT.split(", ")]


def _code(role: Column, text: Column) -> Column:
    """3 * initial + (0 blank, 1 whole, 2 truncated)."""
    core = F.rtrim(text, F.lit(SPACE))
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    kind = F.when(core == "", 0).when(F.substring(core, -1, 1).isin(".", "!", "?"), 1).otherwise(2)
    return (3 * initial + kind).cast("int")


def _in_place(rows: DataFrame) -> DataFrame:
    """Results of the conversations inside a slice, and the rows of all others (slice, idx and further columns)."""
    made = f"conv_id bigint, {_RESULT}, slice int, idx bigint, turn bigint, role string, text string, code int"
    kinds = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
    names = [x.split()[0] for x in made.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        number, group, index, held, size, passed = TaskContext.get().partitionId(), None, 0, [], 0, True
        done: list[tuple] = []
        left: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            rows = [(*d, *[None] * 6) for d in done] + [(r[0], *[None] * 8, number, *r[1:]) for r in left]
            done.clear(), left.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for c, turn, role, text, code in zip(*(column.to_pylist() for column in batch.columns)):
                if c != group:
                    if not passed:
                        done.append((group, *_settled(*(list(x) for x in list(zip(*held))[2:]))))
                    passed, group, held, size = group is None, c, [], 0
                row = (c, index, turn, role, text, code)
                index += 1
                if not passed:
                    held.append(row)
                    size += len(text)
                    if size > HELD:
                        passed = True
                        left.extend(held)
                        held = []
                else:
                    left.append(row)
            if done or left:
                yield batch_of()
        left.extend(held)
        if left:
            yield batch_of()

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64))
    return dealt.sortWithinPartitions(*order).mapInArrow(run, made)


def _mapped(df: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work`` turns the values of a row into rows of the schema; batch by batch."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                made = list(work(*row))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=fields.names)

    return df.select(*columns).mapInArrow(run, schema)


def _cut_part(conv, piece, chunk, rows):
    symbols, faults = _symbols([r["code"] for r in rows], [r["copy"] for r in rows])
    initials = [r["code"] // 3 for r in rows]
    to, cost = tables().backs(np.array(symbols))
    yield (conv, piece, chunk, rows[0]["idx"], bytes(symbols), to.tolist(), cost.tolist(), initials[0], initials[-1],
           _illegal(initials), *faults)


def _walk_back(conv, parts):
    """The vector behind each part; cost and illegal pairs between parts stand with the first."""
    after, cost, out = 0, 0, []
    for p in reversed(parts):
        out.append((conv, p["slice"], p["chunk"], after))
        cost += p["cost"][after]
        after = p["to"][after]
    cost += tables().vectors[after][0]
    between = sum((a["tail"], b["head"]) not in _LEGAL for a, b in zip(parts, parts[1:]))
    for i, row in enumerate(out):
        first = i == len(out) - 1
        yield (*row, cost if first else 0, between if first else 0)


def _walk_on(conv, parts):
    """The state before each part."""
    state = 0
    for i, p in enumerate(parts):
        yield conv, p["slice"], p["chunk"], state, i == len(parts) - 1
        state = p["states"][state]


def _part_states(conv, piece, chunk, symbols, after):
    table, listed, out = tables(), list(symbols), []
    marks = table.back(listed, after)[2]
    for state in range(4):
        for _, _, state in table.trace(listed, marks, state):  # noqa: B007
            pass
        out.append(state)
    yield conv, piece, chunk, out


def _part_edits(conv, piece, chunk, first, symbols, after, state, is_last):
    table, listed = tables(), list(symbols)
    edits = list(table.trace(listed, table.back(listed, after)[2], state))
    if is_last:  # turns inserted behind the last row
        state = edits[-1][2]
        edits.append((table.tail[state], state, state))
    yield (conv, piece, chunk, first, "".join(e[0] for e in edits), [e[0] for e in edits], [e[1] for e in edits])


def _hashed(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): one line after another in a conversation, none held."""
    schema = "conv_id bigint, repaired_sha256 string"

    def run(batches):
        conv, state, begun = None, None, False
        for batch in batches:
            out = []
            for c, _, _, role, text, letters, at in zip(*(column.to_pylist() for column in batch.columns)):
                if c != conv:
                    if conv is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state, begun = c, hashlib.sha256(), False
                for line in written(letters, at, role, text):
                    state.update(("\n" + line if begun else line).encode())
                    begun = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["conv_id", "repaired_sha256"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    names = ["conv_id", "slice", "idx", "role", "text", "letters", "state"]
    return lines.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "slice", "idx").mapInArrow(run, schema)


def _in_parts(rows: DataFrame, path: str) -> DataFrame:
    """Results of conversations whose rows lie in several slices or are very many."""
    spark, key, place = rows.sparkSession, ["conv_id", "slice", "chunk"], ["conv_id", "slice", "idx"]

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    def together(df: DataFrame, *names: str) -> DataFrame:
        # one short record for each part of PART rows
        return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("slice", "chunk", *names))).alias("parts"))

    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    first = (rows.groupBy("conv_id", mark.alias("mark")).agg(F.min(F.struct("slice", "idx")).alias("at"))
             .select("conv_id", "at.*", F.lit(False).alias("copy")))
    flags = kept(rows.select(*place, "turn", "code").join(first, place, "left")
                 .withColumn("copy", F.coalesce("copy", F.lit(True))), "flags")
    cut = (flags.groupBy("conv_id", "slice", F.floor(F.col("idx") / PART).alias("chunk"))
           .agg(F.array_sort(F.collect_list(F.struct("idx", "code", "copy"))).alias("rows")))
    parts = kept(_mapped(cut, [*key, "rows"], _cut_part, "conv_id bigint, slice int, chunk bigint, first bigint, symbols binary, "
                         "to array<int>, cost array<bigint>, head int, tail int, illegal bigint, blank bigint, duplicate bigint, truncated bigint"),
                 "parts")
    back = kept(_mapped(together(parts, "to", "cost", "head", "tail"), ["conv_id", "parts"], _walk_back,
                        "conv_id bigint, slice int, chunk bigint, after int, whole_cost bigint, between bigint"), "back")
    known = parts.join(back, key)
    states = _mapped(known, [*key, "symbols", "after"], _part_states, "conv_id bigint, slice int, chunk bigint, states array<int>")
    on = _mapped(together(states, "states"), ["conv_id", "parts"], _walk_on,
                 "conv_id bigint, slice int, chunk bigint, state int, is_last boolean")
    edits = kept(_mapped(known.join(on, key), [*key, "first", "symbols", "after", "state", "is_last"], _part_edits,
                         "conv_id bigint, slice int, chunk bigint, first bigint, audit string, letters array<string>, states array<int>"), "edits")
    each = edits.select("conv_id", "slice", "first", F.posexplode(F.arrays_zip("letters", "states"))).select(
        "conv_id", "slice", (F.col("first") + F.col("pos")).alias("idx"), "col.letters", F.col("col.states").alias("state"))
    # behind a conversation's last row only inserted turns stand, on a row of their own
    lines = each.join(rows.select(*place, "role", "text"), place, "left")
    audit = together(edits, "audit").select("conv_id", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"))
    turns = flags.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0).cast("bigint")).alias("gaps"))
    counts = known.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.sum("between")).alias("illegal"),
        F.sum("whole_cost").alias("cost"))
    return counts.join(turns, "conv_id").join(audit, "conv_id").join(_hashed(lines), "conv_id").select("conv_id", *RESULTS)


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    ``rows`` has conv_id, turn, role and text; ``conversations`` every conv_id, once or more
    often. Turns come by number, nulls first, then by role and text. Null roles and texts are
    empty (so such rows are blank, or have an initial that must change); rows without conv_id
    take no part. Conversations without rows have zeros and the hash of nothing. Rows that do
    not lie with their conversation in one slice pass through the shared folder.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "repair")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    clean = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"), text.alias("text"), _code(role, text).alias("code"))
    _in_place(clean).write.parquet(f"{path}/slices")
    kept = spark.read.parquet(f"{path}/slices")
    found = kept.where("idx is null").select("conv_id", *RESULTS).unionByName(
        _in_parts(kept.where("idx is not null").select("conv_id", "slice", "idx", "turn", "role", "text", "code"), path))
    known = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).where("conv_id is not null").distinct()
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return known.join(found, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("bigint"))).alias(c) for c in RESULTS])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the CRC of ``conv_id:turn`` modulo 20 (nulls are one space): 0 no row, 1 no text,
    2 no full stops, exclamation and question marks, 3 the row twice, 4 the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("draw__")
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), draw)
    d = F.col("draw__")
    text = F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(d == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where(d != 0).select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
                                     text.alias("text"), F.explode(times).alias("time__")).drop("time__")
