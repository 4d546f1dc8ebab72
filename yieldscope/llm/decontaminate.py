"""Benchmark decontamination: which document words lie inside a benchmark window.

Prefix-filtered set join. A window (ten consecutive words of an item, or all words of
a shorter one) is contained in a document only if all its shingles are, so for exact
containment the necessary prefix is one shingle, the rarest. Shingles are counted over
all documents; each window is indexed under its rarest shingle of up to three words.
A document shingle found there fixes the only possible place of the window (positional
bound), which must lie inside the document (length bound); the window's words are then
compared, byte for byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldscope.llm import texts

SHINGLE = 3
#: Benchmark bytes sent to every task at once; more are worked off in several blocks.
BLOCK_BYTES = 16 << 20


def _is_word() -> np.ndarray:
    return texts.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def _words(data: np.ndarray, offsets: np.ndarray) -> texts.Words:
    return texts.Words(texts.lower_table()[data], offsets, _is_word())


class Windows:
    """Distinct windows of a block of items: length, words, hash, items; shingles they hold."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        found: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        length, hashes, shingles = [], [], []
        for name, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            words = _words(data, np.array([0, len(data)]))
            n = min(window, len(words))
            for at in range(len(words) - n + 1 if n else 0):
                key = words.bytes_of(at, n)
                if key not in found:
                    found[key] = len(found)
                    self.items.append(set())
                    length.append(n)
                    hashes.append(texts.window_hashes(words.hashes, np.array([at]), n)[0])
                    s = min(SHINGLE, n)
                    shingles.append(texts.shingle_hashes(words.hashes[at:at + n], s))
                self.items[found[key]].add(name)
        self.keys = list(found)
        self.length = np.array(length, np.int64)
        self.hashes = np.array(hashes, np.uint64)
        self.shingles = shingles
        self.sizes = sorted({min(SHINGLE, n) for n in length})
        self.known = np.unique(np.concatenate([*shingles, np.zeros(0, np.uint64)]))

    def index(self, count: np.ndarray) -> None:
        """Each window under its rarest shingle (the first of equals); ``count`` by ``known``."""
        rare, offset = [], []
        for hashes in self.shingles:
            at = int(np.argmin(count[np.searchsorted(self.known, hashes)]))
            rare.append(hashes[at])
            offset.append(at)
        rare = np.array(rare, np.uint64)
        self.order = np.argsort(rare, kind="stable")
        self.probe, self.first = np.unique(rare[self.order], return_index=True)
        self.first = np.append(self.first, len(rare))
        self.offset = np.array(offset, np.int64)
        self.shingles = None


def _shingle_counts(documents: DataFrame, text: Column, windows: Windows) -> np.ndarray:
    """How often each shingle of the benchmark block occurs in all documents."""
    known, sizes = windows.known, windows.sizes

    def run(batches):
        lookup, total = texts.Lookup(known), np.zeros(len(known), np.int64)
        for batch in batches:
            for _, offsets, data in texts.chunks(*texts.raw(batch.column(0))):
                words = _words(data, offsets)
                room = words.room()
                for s in sizes:
                    at, place = lookup.find(texts.shingle_hashes(words.hashes, s))
                    total += np.bincount(place[room[at] >= s], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    source = documents.select(F.coalesce(text.cast("string"), F.lit("")).alias("text__"))
    count = np.zeros(len(known), np.int64)
    for k, n in source.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n")).collect():
        count[k] = n
    return count


def _hits(documents: DataFrame, keep: list[Column], text: Column, windows: Windows) -> DataFrame:
    """n_words; hit runs of words (first, end) and names of the items found, for each row."""

    def make():
        lookup = texts.Lookup(windows.probe)

        def chunk(offsets, data):
            words = _words(data, offsets)
            room, seen, name_of = words.room(), set(), [set() for _ in range(words.texts)]
            cover = np.zeros(len(words) + 1, np.int64)
            for s in windows.sizes:
                at, place = lookup.find(texts.shingle_hashes(words.hashes, s))
                fan = windows.first[place + 1] - windows.first[place]
                at = np.repeat(at, fan)
                which = windows.order[np.repeat(windows.first[place], fan)
                                      + np.arange(len(at)) - np.repeat(np.cumsum(fan) - fan, fan)]
                begin, length = at - windows.offset[which], windows.length[which]
                ok = (begin >= 0) & (room[at] >= s)
                at, which, begin, length = at[ok], which[ok], begin[ok], length[ok]
                ok = (words.text[begin] == words.text[at]) & (room[begin] >= length)
                which, begin, length = which[ok], begin[ok], length[ok]
                for n in np.unique(length):
                    some = np.flatnonzero(length == n)
                    some = some[texts.window_hashes(words.hashes, begin[some], int(n))
                                == windows.hashes[which[some]]]
                    for w, b in zip(which[some].tolist(), begin[some].tolist()):
                        if (w, b) not in seen and words.bytes_of(b, int(n)) == windows.keys[w]:
                            seen.add((w, b))
                            cover[b] += 1
                            cover[b + n] -= 1
                            name_of[words.text[b]] |= windows.items[w]
            hit = np.cumsum(cover[:-1]) > 0
            runs = [[] for _ in range(words.texts)]
            if hit.any():
                before = np.append(False, hit[:-1])
                before[words.bounds[:-1][words.bounds[:-1] < len(hit)]] = False
                after = np.append(hit[1:], False)
                ends = words.bounds[1:] - 1
                after[ends[(ends >= 0)]] = False
                for a, b in zip(np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)):
                    t = words.text[a]
                    runs[t].append({"first": int(a - words.bounds[t]), "end": int(b + 1 - words.bounds[t])})
            return words.counts.tolist(), runs, [sorted(x) for x in name_of]

        def work(offsets, data):
            parts = [chunk(o, d) for _, o, d in texts.chunks(offsets, data)]
            return [[x for p in parts for x in p[i]] for i in range(3)]

        return work

    return texts.map_texts(documents, keep, text, make,
                           "n_words bigint, runs array<struct<first:bigint,end:bigint>>, items array<string>")


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int):
    """The items in id order, as lists of about ``limit`` bytes."""
    block, size = [], 0
    rows = (benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
            .where("i is not null and t is not null").distinct().sort("i", "t"))
    for i, t in rows.toLocalIterator():
        if block and size + len(t) > limit:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += 4 * len(t)
    yield block


def decontaminate(documents: DataFrame, benchmark: DataFrame, keep: list[Column], *, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns with n_words, runs (hit words: first, end) and items (their ids, sorted).

    The benchmark is sent to the tasks in blocks of bounded size; several blocks mean
    several passes, whose findings are added up in the rows. Null texts have no words;
    items without id or text take no part; repeated items count once; an empty
    benchmark hits nothing. Rows of documents are independent, repeated ones too.
    """
    column, out, last = F.col(f"`{text}`"), None, None
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        windows = Windows(items, window)
        windows.index(_shingle_counts(documents, column, windows) if len(windows.known) else np.zeros(0))
        if out is None:
            out = _hits(documents, [*keep, column.alias("again__")], column, windows)
            continue
        names = [c for c in out.columns if c not in ("n_words", "runs", "items")]
        last = _hits(out, [F.struct(*[F.col(f"`{c}`") for c in names]).alias("kept__"),
                           F.col("runs").alias("runs__"), F.col("items").alias("items__")],
                     F.col("again__"), windows)
        out = last.select("kept__.*", "n_words", _joined_runs("runs__", "runs").alias("runs"),
                          F.array_sort(F.array_union("items__", "items")).alias("items"))
    return out.drop("again__")


def _joined_runs(a: str, b: str) -> Column:
    """Two lists of runs as one list of disjoint runs that do not touch."""
    return F.expr(f"""aggregate(array_sort(concat({a}, {b})), cast(array() as array<struct<first:bigint,end:bigint>>),
        (done, x) -> if(size(done) > 0 and x.first <= element_at(done, -1).end,
            concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first,
                'end', greatest(x.end, element_at(done, -1).end)))),
            concat(done, array(x))))""")
