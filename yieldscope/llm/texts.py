"""Whole texts as byte arrays inside tasks: words, their hashes, and Arrow plumbing.

Texts come in Arrow batches. A batch is worked on in chunks of about ``CHUNK`` bytes
of neighbouring texts (a longer text is a chunk of its own), so the memory of a task
is a multiple of the larger of the two, whatever the size of the table.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def worker_state(key: tuple, make: Callable[[], object]):
    """What ``make`` builds, kept by the Python worker for all its tasks."""
    held = sys.modules.setdefault("yieldscope_worker_state", types.ModuleType("yieldscope_worker_state"))
    if key not in held.__dict__:
        held.__dict__[key] = make()
    return held.__dict__[key]


def release() -> None:
    """Give memory that a task has freed back to the machine, which workers otherwise keep for their next task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte, the same in every process."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n (a global of this module would travel with every function)."""
    held = worker_state(("powers",), lambda: [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(held[0]) < n:
        size = max(n, min(2 * n, CHUNK + 1))
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        held[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return held[0], held[1]


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the polynomial value of data[i:j] times B^i."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * powers(len(data) + 1)[0][: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the bytes stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


class Words:
    """The words of neighbouring texts: places in ``data``, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, hashed: bool = True):
        self.data, self.texts = data, len(offsets) - 1
        mask = is_word[data]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        before = np.empty(len(data), bool)
        before[:1], before[1:] = False, mask[:-1]
        before[firsts] = False
        after = np.empty(len(data), bool)
        after[:-1], after[-1:] = mask[1:], False
        after[firsts[firsts > 0] - 1] = False
        self.starts = np.flatnonzero(mask & ~before)
        self.ends = np.flatnonzero(mask & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(self.texts), self.counts)
        if hashed:
            self.hashes = span_hashes(prefix_sums(data, byte_values()), self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def room(self) -> np.ndarray:
        """How many words there are from each word to the end of its text."""
        return self.bounds[1:][self.text] - np.arange(len(self))

    def bytes_of(self, first: int, count: int) -> bytes:
        """The words one after another, spaces between them."""
        return b" ".join(self.data[s:e].tobytes() for s, e in
                         zip(self.starts[first:first + count], self.ends[first:first + count]))


def shingle_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Order-sensitive hashes of ``length`` neighbouring word hashes, at each first word."""
    count = max(0, len(hashes) - length + 1)
    total = np.zeros(count, np.uint64)
    for i in range(length):
        total = total * np.uint64(_BASE) + hashes[i:i + count]
    return mix(total)


def window_hashes(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """``shingle_hashes`` at some first words only."""
    total = np.zeros(len(at), np.uint64)
    for i in range(length):
        total = total * np.uint64(_BASE) + hashes[at + i]
    return mix(total)


class Lookup:
    """Places of sorted 64-bit keys: a bitmap turns most misses away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - 20)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes, places in keys) of all that are found."""
        at = np.flatnonzero(self.maybe[(hashes >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[place] == hashes[at]
        return at[hit], place[hit]


def lower_table() -> np.ndarray:
    """A-Z to a-z, every other byte to itself."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for bytes in any of the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    if places is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(places, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def chunks(offsets: np.ndarray, data: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, offsets, bytes) of neighbouring texts of about ``size`` bytes together."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, offsets[first:last + 1] - offsets[first], data[offsets[first]:offsets[last]]
        first = last


def map_texts(df: DataFrame, keep: list[Column], text: Column,
              make: Callable[[], Callable[[np.ndarray, np.ndarray], list]], fields: str) -> DataFrame:
    """Columns made from the texts, behind the columns to keep; one row for each row.

    ``make`` builds, once in each task, a function of (offsets, bytes) of a batch of
    texts that returns one Arrow array or list for each field. A null text is empty.
    """
    source = df.select(*keep, F.coalesce(text.cast("string"), F.lit("")).alias("text__"))
    added = StructType.fromDDL(fields)
    schema = StructType([*source.schema.fields[:-1], *added.fields])
    names = schema.names

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        work = make()
        for batch in batches:
            made = work(*raw(batch.column(batch.num_columns - 1)))
            made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)
            del made
        del work
        release()

    return source.mapInArrow(run, schema)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no added column can clash with one of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row__")


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the bounds of its rows."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
