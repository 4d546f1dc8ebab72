"""Ids of many short pieces of text, each different piece encoded once in a task.

A text is cut where no token can span the cut, so its ids are those of its pieces, one
after another. Pieces repeat; a bounded table of pieces seen so far holds their ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from yieldscope.llm import texts
from yieldscope.llm.texts import worker_state  # noqa: F401  (used by those that encode)

#: Bytes of text worked off at once, and pieces kept at most.
GROUP, KEPT = 4 << 20, 300_000


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for one in lists for x in one), np.uint32, int(sizes.sum())), sizes


class Coder:
    """``cut(offsets, data)`` gives (starts, ends, hashes) of pieces; ``encode`` turns a list of
    pieces (bytes) into all their ids and the number of ids of each."""

    def __init__(self, cut: Callable, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.cut, self.encode = cut, encode
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, keys: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, add = len(self.slot), len(ids)
        while len(self.first) < n + len(keys):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while len(self.flat) < self.used + add:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used:self.used + add] = ids
        self.first[n:n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n:n + len(keys)] = sizes
        self.slot.update(zip(keys, range(n, n + len(keys))))
        self.used += add

    def ids(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) of one group."""
        parts, text = [], []
        for first, o, d in texts.chunks(offsets, data):
            starts, ends, hashes = self.cut(o, d)
            parts.append((starts + offsets[first], ends + offsets[first], hashes))
            text.append(first + np.searchsorted(o, starts, side="right") - 1)
        if not parts or not sum(len(p[0]) for p in parts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts, ends, hashes = (np.concatenate([p[i] for p in parts]) for i in range(3))
        text = np.concatenate(text)
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slot) + len(keys) > KEPT:
            self._forget()
        slots = np.fromiter((self.slot.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        new = np.flatnonzero(slots < 0)
        if len(new):
            blob = data.tobytes()
            at = where[new]
            pieces = [blob[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            slots[new] = len(self.slot) + np.arange(len(new))
            self._learn(keys[new].tolist(), *self.encode(pieces))
        slots = slots[back]
        sizes = self.size[slots]
        total = np.cumsum(sizes)
        out = self.flat[np.repeat(self.first[slots] - total + sizes, sizes) + np.arange(total[-1])]
        counts = np.bincount(text, sizes, len(offsets) - 1).astype(np.int64)
        return out, counts

    def groups(self, offsets: np.ndarray, data: np.ndarray):
        """(first text, ids, number of ids of each text) of all groups of a batch."""
        for first, o, d in texts.chunks(offsets, data, GROUP):
            yield (first, *self.ids(o, d))


def cut_pieces(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, apart: np.ndarray):
    """(starts, ends) of runs of bytes in ``inside``, also cut where ``apart`` (a flag for each
    byte: cut before it) and where a text ends."""
    here = inside[data]
    begin = here & apart
    begin[1:] |= here[1:] & ~here[:-1]
    begin[:1] = here[:1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begin[firsts] = here[firsts]
    starts = np.flatnonzero(begin)
    stop = begin.copy()
    stop |= ~here
    stops = np.flatnonzero(stop)
    # the end of a piece is the next place that begins another or is outside
    after = np.searchsorted(stops, starts, side="right")
    ends = np.append(stops, len(data))[after]
    edge = offsets[np.searchsorted(offsets, starts, side="right")]
    return starts, np.minimum(ends, edge)
