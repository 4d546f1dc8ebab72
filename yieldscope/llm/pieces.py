"""SentencePiece encoding and decoding by a streaming Viterbi pass over the piece lattice.

A text is read character by character. At each boundary the lattice keeps the best path
that ends there, as one backpointer to the boundary where its last piece begins. For a
BPE model the best path is the one its merges would give: a path is valid when every two
neighbouring pieces, merged on their own, come out as those two pieces again, and exactly
one path is valid for each prefix. Only pieces up to the longest of the vocabulary can
end at a boundary, so the backpointers of that many boundaries are retained; whenever all
of their paths run through one boundary, the ids before it are committed. Memory is thus
bounded by the longest piece, not by the text.

Where no piece of the vocabulary holds two neighbouring bytes, all paths meet between
them. Texts are cut there first, and each different piece of text is encoded once in a
task (``segments``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldscope.llm import segments, texts

SPACE = "▁"
#: Remembered verdicts on pairs of pieces, at most.
PAIRS = 200_000
#: Bytes of a piece of text that is encoded side by side with others, and how many are at once.
SHORT, ABREAST = 48, 15_000


class Model:
    """Pieces, scores and byte ids of a BPE model file, with white space as plain spaces."""

    def __init__(self, path: str):
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = held.get_piece_size()
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_id = {}
        self.out: list[bytes] = [b""] * self.size
        for i in range(self.size):
            piece = held.id_to_piece(i)
            if held.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes_id[value], self.out[i] = i, bytes([value])
            elif held.is_unknown(i):
                self.unknown, self.out[i] = i, " ⁇ ".encode()
            elif not held.is_control(i):
                piece = piece.replace(SPACE, " ")
                self.ids[piece], self.rank[piece], self.out[i] = i, held.get_score(i), piece.encode()
        self.longest = max(map(len, self.ids), default=1)
        self.inside = np.zeros((256, 256), bool)
        for piece in self.ids:
            raw = np.frombuffer(piece.encode(), np.uint8)
            self.inside[raw[:-1], raw[1:]] = True
        self.names = {i: piece for piece, i in self.ids.items()}
        raw = [piece.encode() for piece in self.ids]
        self.longest_bytes = max(map(len, raw), default=1)
        ends = np.cumsum([len(x) for x in raw])
        hashes = texts.span_hashes(texts.prefix_sums(np.frombuffer(b"".join(raw), np.uint8), texts.byte_values()),
                                   np.append(0, ends[:-1]), ends)
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(list(self.ids.values()), np.int64)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self._whole: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Nothing remembered of the texts so far."""
        self.verdict: dict[int, bool] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.pairs_held = 0

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the best-scored neighbours first, then the leftmost."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def holds(self, piece: str) -> bool:
        """Whether the piece, merged on its own, stays whole."""
        known = self._whole.get(piece)
        if known is None:
            known = self._whole[piece] = len(piece) == 1 or (piece in self.rank and len(self.merged(piece)) == 1)
        return known

    def apart(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces stay as they are (remembered in ``pairs``)."""
        if self.pairs_held >= PAIRS:
            self.pairs.clear()
            self.pairs_held = 0
        self.pairs_held += 1
        known = self.pairs.setdefault(left, {})[right] = self.merged(left + right) == [left, right]
        return known

    def extend(self, text: str, back: list[int], last: list[str]) -> None:
        """The best paths to all boundaries of the text that ``back`` does not have yet."""
        longest, rank, pairs = self.longest, self.rank, self.pairs
        nothing: dict[str, bool] = {}
        for end in range(len(back), len(text) + 1):
            for begin in range(max(0, end - longest), end):
                piece = text[begin:end]
                if piece not in rank and end - begin > 1:
                    continue
                left = last[begin]
                if left:
                    fits = pairs.get(left, nothing).get(piece)
                    if fits is None:
                        fits = self.apart(left, piece)
                else:
                    fits = self.holds(piece)
                if fits:
                    back.append(begin)
                    last.append(piece)
                    break

    def abreast(self, pieces: list[bytes]) -> list[list[int] | None]:
        """The ids of short texts, longest first: the lattice of all of them, boundary by boundary.

        None where a character is no piece, which the stream can tell.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width, rows = int(sizes[0]), len(pieces)
        cells = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        up, down = texts.powers(width + 1)
        sums = np.zeros((width + 1, rows), np.uint64)
        np.cumsum(texts.byte_values()[cells.T] * up[:width, None], axis=0, dtype=np.uint64, out=sums[1:])
        last, back = np.full((width + 1, rows), -1, np.int64), np.zeros((width + 1, rows), np.int8)
        last[0] = self.size
        for end in range(1, width + 1):
            live = int(np.searchsorted(-sizes, -end, side="right"))
            found = []
            for begin in range(max(0, end - self.longest_bytes), end):
                hashes = texts.mix((sums[end, :live] - sums[begin, :live]) * down[begin])
                at = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] & (last[begin, :live] >= 0))
                place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
                hit = self.hashes[place] == hashes[at]
                at, place = at[hit], place[hit]
                found.append((at, self.hash_ids[place], np.full(len(at), begin)))
            at, piece, begin = (np.concatenate(x) for x in zip(*found))
            keys, where = np.unique(last[begin, at] * self.size + piece, return_inverse=True)
            fits = np.fromiter(map(self.fits, keys.tolist()), bool, len(keys))[where]
            last[end, at[fits]], back[end, at[fits]] = piece[fits], begin[fits]
        place, every = sizes.copy(), np.arange(rows)
        done = last[place, every] >= 0
        paths: list = [[] if ok else None for ok in done.tolist()]
        steps = []
        going = every[done & (sizes > 0)]
        while len(going):
            steps.append((going, last[place[going], going]))
            place[going] = back[place[going], going]
            going = going[place[going] > 0]
        for going, ids in reversed(steps):
            for row, i in zip(going.tolist(), ids.tolist()):
                paths[row].append(i)
        return paths

    def fits(self, key: int) -> bool:
        """Whether the path (left piece, piece), or a piece alone behind the start, is valid."""
        known = self.verdict.get(key)
        if known is None:
            if len(self.verdict) >= PAIRS:
                self.verdict.clear()
            left, right = divmod(key, self.size)
            piece = self.names[right]
            known = self.holds(piece) if left == self.size else self.merged(self.names[left] + piece) == [self.names[left], piece]
            self.verdict[key] = known
        return known

    def id_list(self, pieces: list[str]) -> list[int]:
        out = []
        for piece in pieces:
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif len(self.bytes_id) == 256:
                out.extend(self.bytes_id[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return out


class Stream:
    """Pieces of a text that comes in parts; ``feed`` and ``close`` return what has become certain."""

    def __init__(self, model: Model):
        self.model = model
        self.text, self.base = "", 0  # retained characters and the boundary before them
        self.back: list[int] = [-1]  # boundary where the piece that ends here begins
        self.last: list[str] = [""]

    def feed(self, part: str) -> list[str]:
        out, step = [], 4 * self.model.longest
        for at in range(0, len(part), step):
            self.text += part[at:at + step]
            self.model.extend(self.text, self.back, self.last)
            if len(self.text) >= step:
                out += self._commit()
        return out

    def _path(self, end: int) -> list[int]:
        path = [end]
        while path[-1] > 0:
            path.append(self.back[path[-1]])
        return path

    def _commit(self) -> list[str]:
        """The pieces before the last boundary that all surviving paths share."""
        end = len(self.text)
        shared = set(self._path(end))
        for at in range(max(1, end - self.model.longest + 1), end):
            shared &= set(self._path(at))
        meet = max(shared)
        if not meet:
            return []
        out = [self.last[b] for b in reversed(self._path(meet)[:-1])]
        # the piece before the boundary stays known, as the left neighbour of the next
        self.text = self.text[meet:]
        self.back = [max(b - meet, -1) for b in self.back[meet:]]
        self.last = self.last[meet:]
        return out

    def close(self) -> list[str]:
        out = [self.last[b] for b in reversed(self._path(len(self.text))[:-1])]
        self.text, self.back, self.last = "", [-1], [""]
        return out


class Codec:
    """Ids of texts and back. A text that is not empty gets a space in front, which decoding takes away."""

    def __init__(self, path: str):
        # the model stays with the worker, what it remembers of texts does not
        self.model = texts.worker_state(("pieces", path), lambda: Model(path))
        self.model.forget()
        self.coder = segments.Coder(self.cut, self.encode_pieces)
        sizes = np.array([len(x) for x in self.model.out], np.int64)
        self.sizes, self.firsts = sizes, np.cumsum(sizes) - sizes
        self.flat = np.frombuffer(b"".join(self.model.out), np.uint8)

    def cut(self, offsets: np.ndarray, data: np.ndarray):
        apart = np.zeros(len(data), bool)
        apart[1:] = ~self.model.inside[data[:-1], data[1:]]
        apart &= (data & 0xC0) != 0x80  # never inside a character
        starts, ends = segments.cut_pieces(data, offsets, np.ones(256, bool), apart)
        return starts, ends, texts.span_hashes(texts.prefix_sums(data, texts.byte_values()), starts, ends)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Short pieces side by side, the others as streams."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        short = np.flatnonzero(lengths <= SHORT)
        short = short[np.argsort(-lengths[short], kind="stable")]
        out: list = [None] * len(pieces)
        for i in range(0, len(short), ABREAST):
            some = short[i:i + ABREAST]
            for at, ids in zip(some.tolist(), self.model.abreast([pieces[j] for j in some])):
                out[at] = ids
        stream = Stream(self.model)
        for i, ids in enumerate(out):
            if ids is None:
                found = stream.feed(pieces[i].decode("utf-8", "replace"))
                out[i] = self.model.id_list(found + stream.close())
        return segments.flat(out)

    def encode(self, offsets: np.ndarray, data: np.ndarray):
        """(first text, ids, number of ids of each text, their texts with the space in front) by groups."""
        for first, o, d in texts.chunks(offsets, data, segments.GROUP):
            o, d = _spaced(o, d)
            ids, counts = self.coder.ids(o, d)
            yield first, ids, counts, o, d

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, the space in front included."""
        sizes = self.sizes[ids]
        total = np.cumsum(sizes)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.flat[np.repeat(self.firsts[ids] - total + sizes, sizes) + np.arange(total[-1])]


def _spaced(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that is not empty, and the mark for spaces as a space."""
    raw, mark = data.tobytes(), SPACE.encode()
    parts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    parts = [b" " + (p.replace(mark, b" ") if mark in p else p) if p else p for p in parts]
    return np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64), np.frombuffer(b"".join(parts), np.uint8)


def encode(documents: DataFrame, keep: list[Column], vocabulary: str, *, text: str = "text",
           digest: bool = False) -> DataFrame:
    """The kept columns with ids, or with n_tokens, ids_crc32 (of little-endian 32-bit ids) and
    round_trip (whether decoding gives the text again).

    Null and empty texts have no ids. The mark U+2581 in a text counts as a space and is
    decoded as one. A single text is held whole in one task.
    """

    def make():
        codec = Codec(vocabulary)

        def work(offsets, data):
            ids_all, counts_all, crc, same = [], [], [], []
            for _, ids, counts, o, d in codec.encode(offsets, data):
                counts_all.append(counts)
                if not digest:
                    ids_all.append(ids)
                    continue
                ends, held = np.cumsum(counts), ids.astype("<u4")
                crc += [zlib.crc32(held[a:b].tobytes()) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                back, made = codec.decode(ids), np.append(0, np.cumsum(codec.sizes[ids]))
                lengths = made[ends] - made[ends - counts]
                same += _equal(back, lengths, d, np.diff(o))
            counts = np.concatenate([np.zeros(0, np.int64), *counts_all])
            if digest:
                return [counts, crc, same]
            return [texts.lists(np.concatenate([np.zeros(0, np.uint32), *ids_all]).astype(np.int32),
                                np.append(0, np.cumsum(counts)), pa.int32())]

        return work

    fields = "n_tokens bigint, ids_crc32 bigint, round_trip boolean" if digest else "ids array<int>"
    return texts.map_texts(documents, keep, F.col(f"`{text}`"), make, fields)


def _equal(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> list[bool]:
    """Whether the texts of two groups are the same, one by one."""
    if len(a) == len(b) and (a_sizes == b_sizes).all() and (a == b).all():
        return [True] * len(b_sizes)
    x, y = a.tobytes(), b.tobytes()
    p, q = np.append(0, np.cumsum(a_sizes)).tolist(), np.append(0, np.cumsum(b_sizes)).tolist()
    return [x[p[i]:p[i + 1]] == y[q[i]:q[i + 1]] for i in range(len(b_sizes))]


def decode(rows: DataFrame, keep: list[Column], vocabulary: str, *, ids: str = "ids") -> DataFrame:
    """The kept columns with the text of their ids; null ids give a null text."""
    source = rows.select(*keep, F.col(f"`{ids}`").cast("array<int>").alias("ids__"))
    names = [*source.columns[:-1], "text"]
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*source.schema.fields[:-1], StructField("text", StringType())])

    def run(batches):
        codec = Codec(vocabulary)
        for batch in batches:
            made = []
            for one in batch.column(batch.num_columns - 1):
                values = one.values
                made.append(None if values is None else
                            codec.decode(values.to_numpy(zero_copy_only=False)).tobytes().decode("utf-8", "replace").removeprefix(" "))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=names)

    return source.mapInArrow(run, schema)
