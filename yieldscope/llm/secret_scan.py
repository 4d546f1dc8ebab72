"""Secrets in texts: candidates by shape, false ones removed by a random forest.

A candidate is a run of at least ``LEAST`` characters of the alphabets that keys are
written in, with a digit or in capitals, or the whole value behind a key word and = or :,
whatever its length and signs. Its features are its length, how its characters
follow one another (against the transitions of the whole corpus), how much of it
dictionary words cover, whether it is part of a path or address, and the words beside
it. A forest (Spark ML) is trained from labelled findings, by default those that known
formats label; its trees then run inside the tasks that read the texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldscope.llm import segments, texts
from yieldscope.session import scratch_path

LEAST = 12
#: Distinct labelled findings to train on at most, half of them for each label, chosen by a hash of their features.
SAMPLE = 20_000
#: Rows that the findings of a rarer label are repeated to, so that each tree sees them.
_SEEN = 100
FEATURES = ("length", "transitions", "surprise", "entropy", "digits", "capitals", "smalls", "hex", "coverage",
            "in_path", "in_address", "assigned", "quoted", "key_before", "key_after", "word_before")

# Formats in use for keys, words beside them, and shapes that are none.
KNOWN = re.compile(rb"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"
                   rb"|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20}")
KEY_WORDS = re.compile(rb"token|passw|pwd|secret|api[_-]?key|auth|bearer|credential|private[_-]?key", re.I)
NO_SECRET = re.compile(rb"[0-9]+|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[A-Za-z]+|[0-9]+(?:[-/][0-9]+)+")

#: A value behind = or :, in quotes or up to a blank, a tag or the next name with = or :, and signs that end no bare one.
_VALUE = re.compile(rb"""[ \t]{0,8}(?:"([^"\r\n]+)"|'([^'\r\n]+)'|["']?((?=[^=:\\])(?:(?![&;,]["']?[A-Za-z_-]+["']?[=:]|<[/!]?[A-Za-z][^<>\r\n]{0,200}>)[^\s"])+))""")
_NAMED = re.compile(rb"(?:" + KEY_WORDS.pattern + rb")[^=:&;,\r\n]*\Z", re.I)
_TAIL = b"'`,;.:)]}>"
_NAMES = re.compile(rb"author(?!i[sz])|secretar", re.I)

_ALPHABET = texts.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x5F, 0x5F))


def _symbols() -> np.ndarray:
    """Bytes as 38 symbols: letters without case, a digit, all others."""
    table = np.full(256, 37, np.int64)
    table[0x30:0x3A] = 36
    table[0x41:0x5B] = table[0x61:0x7B] = np.arange(26)
    return table


def transitions(documents: DataFrame, *, text: str = "text") -> np.ndarray:
    """Bits of surprise of each symbol after each other, counted over all texts."""

    def run(batches):
        table, count = _symbols(), np.zeros(38 * 38, np.int64)
        for batch in batches:
            for _, _, data in texts.chunks(*texts.raw(batch.column(0))):
                s = table[data]
                count += np.bincount(s[:-1] * 38 + s[1:], minlength=38 * 38)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(38 * 38)), pa.array(count)], names=["k", "n"])

    rows = documents.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).mapInArrow(run, "k bigint, n bigint")
    count = np.ones(38 * 38)
    for k, n in rows.groupBy("k").agg(F.sum("n")).collect():
        count[k] += n
    count = count.reshape(38, 38)
    return -np.log2(count / count.sum(axis=1, keepdims=True))


class Dictionary:
    """Whole words of a vocabulary file, of four letters and more."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        self.words = {w[:-4].encode() for w in entries if w.endswith("</w>") and len(w) >= 8 and w[:-4].isascii() and w[:-4].isalpha()}
        self.longest = max(map(len, self.words), default=0)

    def coverage(self, piece: bytes) -> float:
        """Share of the bytes that words cover, the longest first from the left."""
        piece, at, covered = piece.lower(), 0, 0
        while at < len(piece):
            for size in range(min(self.longest, len(piece) - at), 3, -1):
                if piece[at:at + size] in self.words:
                    covered += size
                    at += size
                    break
            else:
                at += 1
        return covered / max(1, len(piece))


def _assigned(offsets: np.ndarray, data: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the values behind a key word and = or :."""
    at = np.flatnonzero((data == 0x3D) | (data == 0x3A))
    text = np.searchsorted(offsets, at, side="right") - 1
    blob, out, done = data.tobytes(), [], 0
    for p, t, first, last in zip(at.tolist(), text.tolist(), offsets[text].tolist(), offsets[text + 1].tolist()):
        # the colon of an address assigns nothing
        if p < done or blob[p + 1:min(p + 3, last)] == b"//" or not _NAMED.search(blob, max(first, p - 24), p):
            continue
        if m := _VALUE.match(blob, p + 1, last):
            start, end = m.span(m.lastindex)
            if m.lastindex == 3:
                end = start + len(m[3].rstrip(_TAIL))
            if start < end:
                out.append((t, start, end))
                done = end
    return out


def candidates(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all candidates of a chunk, as places in it, in order and apart."""
    runs = texts.Words(data, offsets, _ALPHABET, hashed=False)
    size = runs.ends - runs.starts
    digit = np.append(0, np.cumsum((data >= 0x30) & (data <= 0x39)))
    small = np.append(0, np.cumsum((data >= 0x61) & (data <= 0x7A)))
    digits, smalls = digit[runs.ends] - digit[runs.starts], small[runs.ends] - small[runs.starts]
    keep = (size >= LEAST) & ((digits > 0) | ((smalls == 0) & (size >= 16)))
    found = runs.text[keep], runs.starts[keep], runs.ends[keep]
    whole = np.array(_assigned(offsets, data), np.int64).reshape(-1, 3).T
    if not whole.shape[1]:
        return found
    # a run in a value is part of it
    apart = np.searchsorted(whole[2], found[1], side="right") == np.searchsorted(whole[1], found[2], side="left")
    both = [np.concatenate([x[apart], w]) for x, w in zip(found, whole)]
    order = np.argsort(both[1], kind="stable")
    return both[0][order], both[1][order], both[2][order]


def describe(piece: bytes, before: bytes, after: bytes, bits: np.ndarray, words: Dictionary) -> list[float]:
    """The features of a candidate with the bytes before and behind it."""
    data = np.frombuffer(piece, np.uint8)
    kind = np.select([data < 0x30, data < 0x3A, data < 0x41, data < 0x5B, data < 0x60], [3, 0, 3, 1, 3], 2)
    kind = np.where((data == 0x5F) | (data > 0x7A), 3, kind)
    s = _TABLE[data]
    shares = np.bincount(data, minlength=256) / len(data)
    shares = shares[shares > 0]
    near, behind = before[-24:], after[:24]
    word = re.search(rb"([A-Za-z]+)[^A-Za-z]*$", near)
    return [float(len(piece)), float((kind[1:] != kind[:-1]).mean()) if len(data) > 1 else 0.0,
            float(bits[s[:-1], s[1:]].mean()) if len(data) > 1 else 0.0, float(-(shares * np.log2(shares)).sum()),
            float((kind == 0).mean()), float((kind == 1).mean()), float((kind == 2).mean()),
            float(all(c in b"0123456789abcdefABCDEF" for c in piece)), words.coverage(piece),
            float(near[-1:] in (b".", b"\\") or b"://" in near or behind[:1] in (b".", b"\\") and behind[1:2].isalnum()),
            float(near[-1:] == b"@" or behind[:1] == b"@"), float(bool(re.search(rb"[=:]\s*[\"']?$", near))),
            float(near[-1:] in (b'"', b"'") and behind[:1] == near[-1:]), float(bool(KEY_WORDS.search(near))),
            float(bool(KEY_WORDS.search(behind))), float(len(word[1])) if word else 0.0]


_TABLE = _symbols()


def known_label(piece: bytes, before: bytes, after: bytes) -> int | None:
    """1 for a known format or a value given to a key word, 0 for shapes that are no secret, else None.

    Values of a key word that are not long runs count as secrets with letters and digits
    only; addresses, phrases, signs and letters in mixed case are left to the forest.
    """
    if KNOWN.fullmatch(piece):
        return 1
    given = KEY_WORDS.search(before[-24:]) and re.search(rb"[=:]\s*[\"']?$", before[-24:])
    if given and re.fullmatch(rb"[A-Za-z]*[a-z][A-Z][A-Za-z]*", piece):
        return None
    if NO_SECRET.fullmatch(piece) or after[:1] == b"@" or before[-1:] == b"@":
        return 0
    if not given:
        return None
    if re.fullmatch(rb"(?=[^0-9]*[0-9])[A-Za-z0-9+/_-]{12,}|[A-Z0-9+/_-]{16,}", piece):
        return 1
    mixed = re.search(rb"[0-9]", piece) and re.search(rb"[A-Za-z]", piece)
    return 1 if mixed and not re.search(rb"\s|://", piece) and not _NAMES.search(before[-24:]) else None


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: the feature of each node (-1: a leaf), its threshold, children and share of ones."""

    trees: tuple
    constant: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.full(len(x), self.constant)
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                down = np.where(x[np.arange(len(x)), f] <= threshold[at], left[at], right[at])
                at = np.where(inner, down, at)
            total += share[at]
        return total / len(self.trees)


def _tree(model) -> tuple:
    rows: list[list] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, 0.0])
        if node.subtreeDepth() == 0:
            counts = node.impurityStats().stats()
            counts = [counts[i] for i in range(len(counts))]
            rows[at][4] = counts[1] / max(sum(counts), 1e-300) if len(counts) > 1 else 0.0
        else:
            split = node.split()
            rows[at][0], rows[at][1] = split.featureIndex(), split.threshold()
            rows[at][2], rows[at][3] = walk(node.leftChild()), walk(node.rightChild())
        return at

    walk(model._call_java("rootNode"))
    f, t, a, b, s = zip(*rows)
    return np.array(f), np.array(t), np.array(a), np.array(b), np.array(s)


def findings(documents: DataFrame, keep: list[Column], bits: np.ndarray, dictionary: str, *, text: str = "text") -> DataFrame:
    """The kept columns with all candidates: start and end (bytes), features, and the label of known formats."""

    def make():
        words = segments.worker_state(("dictionary", dictionary), lambda: Dictionary(dictionary))

        def work(offsets, data):
            out = [[] for _ in range(len(offsets) - 1)]
            for base, o, d in texts.chunks(offsets, data):
                for t, a, b in zip(*(x.tolist() for x in candidates(o, d))):
                    piece, before, after = _around(d, o, t, a, b)
                    out[base + t].append({"start": a - int(o[t]), "end": b - int(o[t]), "label": known_label(piece, before, after),
                                          "features": describe(piece, before, after, bits, words)})
            return [out]

        return work

    return texts.map_texts(documents, keep, F.col(f"`{text}`"), make,
                           "found array<struct<start:int,end:int,label:int,features:array<double>>>")


def _around(data, offsets, t, a, b) -> tuple[bytes, bytes, bytes]:
    return (data[a:b].tobytes(), data[max(int(offsets[t]), a - 32):a].tobytes(), data[b:min(int(offsets[t + 1]), b + 32)].tobytes())


def train(labelled: DataFrame, *, trees: int = 20, depth: int = 8, sample: int = SAMPLE, seed: int = 17) -> Forest:
    """A forest from rows of (features, label), label 0 or 1. Others take no part; with rows of
    one label only, or none, every candidate gets the share of ones (or 0). Equal rows count
    once, up to half of ``sample`` of each label is drawn, and both labels weigh the same."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    spark = labelled.sparkSession
    path = scratch_path(spark, "findings")
    (labelled.where("label in (0, 1)").select("features", F.col("label").cast("double").alias("label"))
     .distinct().write.parquet(f"{path}/distinct"))
    distinct = spark.read.parquet(f"{path}/distinct")
    zeros, ones = (distinct.where(F.col("label") == v).orderBy(F.xxhash64("features"), "features").limit(sample // 2) for v in (0, 1))
    zeros.unionByName(ones).write.parquet(f"{path}/drawn")
    rows = spark.read.parquet(f"{path}/drawn")
    ones, every = rows.agg(F.sum("label"), F.count("*")).first()
    if not every or ones in (0, every):
        return Forest((), float(ones or 0) / max(every, 1))
    of = lambda one, zero: F.when(F.col("label") == 1, F.lit(one)).otherwise(F.lit(zero))
    times = [-(-_SEEN // int(n)) for n in (ones, every - ones)]
    rows = rows.withColumn("weight", of(*[every / (2.0 * n * t) for n, t in zip((ones, every - ones), times)])).withColumn(
        "again", F.explode(F.sequence(F.lit(1), of(*times))))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", weightCol="weight").fit(
        rows.select(array_to_vector("features").alias("features"), "label", "weight"))
    return Forest(tuple(_tree(t) for t in model.trees), 0.0)


def fitted(documents: DataFrame, dictionary: str, *, text: str = "text") -> tuple[np.ndarray, Forest]:
    """Transitions of the corpus, and a forest of the findings that known formats label."""
    bits = transitions(documents, text=text)
    found = findings(documents, [F.lit(0).alias("x")], bits, dictionary, text=text).where(F.size("found") > 0)
    rows = found.select(F.explode("found").alias("f")).select("f.features", "f.label")
    return bits, train(rows)


def scan(documents: DataFrame, keep: list[Column], bits: np.ndarray, forest: Forest, dictionary: str, *,
         text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The kept columns with n_candidates, secrets (start, end in code points, score) and the
    text without them (``clean``, each replaced by [SECRET]).

    Null texts are empty and have none. Rows are independent of each other.
    """

    def make():
        words = segments.worker_state(("dictionary", dictionary), lambda: Dictionary(dictionary))

        def work(offsets, data):
            n = len(offsets) - 1
            count, secrets, clean = np.zeros(n, np.int64), [[] for _ in range(n)], [None] * n
            for base, o, d in texts.chunks(offsets, data):
                places = list(zip(*(x.tolist() for x in candidates(o, d))))
                score = forest.score(np.array([describe(*_around(d, o, t, a, b), bits, words) for t, a, b in places])
                                     .reshape(len(places), len(FEATURES)))
                hits: dict[int, list] = {}
                for (t, a, b), p in zip(places, score.tolist()):
                    count[base + t] += 1
                    if p >= threshold:
                        hits.setdefault(t, []).append((a - int(o[t]), b - int(o[t]), p))
                for t in range(len(o) - 1):
                    raw = d[o[t]:o[t + 1]]
                    if t not in hits:
                        clean[base + t] = raw.tobytes()
                        continue
                    point = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                    parts, at, blob = [], 0, raw.tobytes()
                    for a, b, p in hits[t]:
                        secrets[base + t].append({"start": int(point[a]), "end": int(point[b]), "score": p})
                        parts += [blob[at:a], b"[SECRET]"]
                        at = b
                    clean[base + t] = b"".join([*parts, blob[at:]])
            return [count, secrets, pa.array(clean, pa.binary()).cast(pa.string())]

        return work

    return texts.map_texts(documents, keep, F.col(f"`{text}`"), make,
                           "n_candidates bigint, secrets array<struct<start:bigint,end:bigint,score:double>>, clean string")
