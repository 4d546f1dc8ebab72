"""Token ids of documents in patched frame-of-reference blocks.

Documents are encoded in id order and their ids written as pages, one Parquet row each:
the ids of neighbouring documents, an end id behind each, in blocks of ``BLOCK`` ids. A
block holds its minimum, the ids less the minimum packed at the width that fits the
given share of them, and a list of exceptions (places and full values) for the rest.
``block_starts`` says where in the page's bytes each block begins. Shards are numbered
in id order and pages in a shard, and each page knows the ids before it in its shard, so
one number for each shard gives every document's place in the whole.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldscope.llm import segments, texts
from yieldscope.session import scratch_path

BLOCK = 4096
#: Share of a block's ids that the packed width fits.
SHARE = 0.95
_HEAD = "<IIBI"  # ids, minimum, width, exceptions


def pack(ids: np.ndarray, share: float = SHARE) -> bytes:
    """One block."""
    low = int(ids.min()) if len(ids) else 0
    rest = ids - np.uint32(low)
    kth = np.partition(rest, int(share * (len(rest) - 1)))[int(share * (len(rest) - 1))] if len(rest) else 0
    width = int(kth).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = ((rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return b"".join((struct.pack(_HEAD, len(ids), low, width, len(odd)), np.packbits(bits.ravel(), bitorder="little").tobytes(),
                     odd.astype("<u2").tobytes(), rest[odd].astype("<u4").tobytes()))


def unpack(data: bytes, at: int) -> np.ndarray:
    """The ids of the block that begins at ``at``."""
    count, low, width, exceptions = struct.unpack_from(_HEAD, data, at)
    at += struct.calcsize(_HEAD)
    size = -(-count * width // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count * width, bitorder="little")
    out = np.full(count, low, np.uint32)
    planes = bits.reshape(count, width)
    for i in range(width):
        out += planes[:, i].astype(np.uint32) << np.uint32(i)
    at += size
    places = np.frombuffer(data, "<u2", exceptions, at)
    out[places] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions) + np.uint32(low)
    return out


def page(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """Bytes of all blocks, and where each begins."""
    blocks = [pack(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    return b"".join(blocks), (np.cumsum([0, *map(len, blocks)])[:-1]).tolist()


def read_page(data: bytes, starts) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *(unpack(data, int(s)) for s in starts)])


class WordTokens:
    """Pieces of texts for a BPE vocabulary file with word ends (lower case, white space dropped).

    Its pre-tokenizer keeps letters, digits and other marks apart and drops white space,
    so a text may be cut at spaces and line ends, and between ASCII letters, digits and
    marks, but not at apostrophes or beside other characters. Pieces that are plain words
    go straight to the model of the file, all others through the whole tokenizer. Texts
    with ``<|``, where special tokens might begin, are not cut at all.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.whole = Tokenizer.from_str(f.read())
        self.model = self.whole.model
        self.plain = re.compile("[a-zà-öø-ÿ]+").fullmatch
        # the byte-level alphabet: printable bytes as themselves, the others from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
        kind = np.full(256, 3, np.uint8)
        kind[[0x20, 0x0A]] = 0
        kind[65:91] = kind[97:123] = 1
        kind[48:58] = 2
        kind[0x80:] = kind[0x27] = 4
        self.kind, self.inside = kind, kind > 0
        self.lower = texts.lower_table()

    def cut(self, offsets: np.ndarray, data: np.ndarray):
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) else np.zeros(0, int)
        low = self.lower[data]
        kinds = self.kind[data]
        apart = np.zeros(len(data), bool)
        apart[1:] = (kinds[1:] != kinds[:-1]) & (kinds[1:] < 4) & (kinds[:-1] < 4)
        starts, ends = segments.cut_pieces(data, offsets, self.inside, apart)
        if len(special):
            held = np.unique(np.searchsorted(offsets, special, side="right") - 1)
            keep = ~np.isin(np.searchsorted(offsets, starts, side="right") - 1, held)
            low[np.repeat(np.isin(np.arange(len(offsets) - 1), held), np.diff(offsets))] = 0
            low = np.where(low == 0, data, low)
            starts = np.concatenate([starts[keep], offsets[held]])
            ends = np.concatenate([ends[keep], offsets[held + 1]])
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
        return starts, ends, texts.span_hashes(texts.prefix_sums(low, texts.byte_values()), starts, ends)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out: list = [None] * len(pieces)
        odd = []
        tokens = self.model.tokenize
        for i, piece in enumerate(pieces):
            text = piece.decode("utf-8", "replace")
            word = text.lower()
            if self.plain(word):
                if not word.isascii():
                    word = "".join([self.letters[b] for b in word.encode()])
                out[i] = [t.id for t in tokens(word)]
            else:
                odd.append((i, text))
        if odd:
            for (i, _), got in zip(odd, self.whole.encode_batch_fast([t for _, t in odd], add_special_tokens=False)):
                out[i] = got.ids
        return segments.flat(out)


def write(documents: DataFrame, path: str, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text",
          end_id: int = 2) -> None:
    """Write the ids of all documents below ``path``, in ascending order of ids (null first).

    Null and empty texts have the end id alone. Rows with equal ids stand side by side,
    by text. An empty table gives an empty file.
    """
    source = documents.select(F.col(f"`{doc_id}`").alias("doc_id"),
                              F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        # the tokenizer stays with the worker, what is remembered of texts does not
        words = segments.worker_state(("words", vocabulary), lambda: WordTokens(vocabulary))
        coder = segments.Coder(words.cut, words.encode)
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            offsets, data = texts.raw(batch.column(1))
            for first, ids, counts in coder.groups(offsets, data):
                ends = np.cumsum(counts)
                out = np.empty(len(ids) + len(counts), np.uint32)
                last = ends + np.arange(len(counts))
                body = np.ones(len(out), bool)
                body[last] = False
                out[body], out[last] = ids, end_id
                held, places = page(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()),
                     pa.array([len(out)], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), batch.column(0).slice(first, len(counts))),
                     pa.array([(counts + 1).tolist()], pa.list_(pa.int64())),
                     pa.array([places], pa.list_(pa.int64())), pa.array([held], pa.binary())],
                    names=["shard", "page", "first", "n", "doc_ids", "counts", "block_starts", "blocks"])
                number, before = number + 1, before + len(out)
        del coder
        texts.release()

    ordered.mapInArrow(run, f"shard int, page int, first bigint, n bigint, doc_ids array<{kind}>, "
                       "counts array<bigint>, block_starts array<bigint>, blocks binary").write.parquet(path)


def read(spark, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before) and ids of every document, end id included.

    ``digest`` gives n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers)
    in place of the ids.
    """
    pages = spark.read.parquet(path)
    element = pages.schema["doc_ids"].dataType.elementType
    offsets, before = [], 0
    for shard, n in sorted(tuple(r) for r in pages.groupBy("shard").agg(F.sum("n")).collect()):
        offsets.append((shard, before))
        before += n
    known = spark.createDataFrame(offsets or [(-1, 0)], "shard int, before bigint")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, counts, places, blocks, first = (batch.column(c)[i] for c in range(5))
                ids = read_page(blocks.as_py(), places.values.to_numpy())
                counts = counts.values.to_numpy()
                ends = np.cumsum(counts)
                starts = first.as_py() + ends - counts
                if digest:
                    held = ids.astype("<u4")
                    crc = [zlib.crc32(held[a:b].tobytes()) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                    made = [pa.array(counts), pa.array(crc, pa.int64())]
                else:
                    made = [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()),
                                                     pa.array(ids.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(starts), *made], names=names)

    rest = "n_tokens bigint, ids_crc32 bigint" if digest else "ids array<bigint>"
    names = ["doc_id", "start", *(x.split()[0] for x in rest.split(", "))]
    return (pages.join(F.broadcast(known), "shard")
            .select("doc_ids", "counts", "block_starts", "blocks", (F.col("before") + F.col("first")).alias("first"))
            .mapInArrow(run, f"doc_id {element.simpleString()}, start bigint, {rest}"))


def scratch_file(spark) -> str:
    return scratch_path(spark, "tokens")
