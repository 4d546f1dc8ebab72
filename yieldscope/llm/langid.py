"""Language of texts by a byte convolutional network, trained and applied in numpy.

A text is read as windows of ``WINDOW`` bytes, all of them, the last one padded. Filters of
several widths slide over the bytes of a window; since a filter sees one byte value at each
of its places, a place is a table of 256 rows and a response is a sum of looked-up rows. The
largest response of each filter, after ReLU, is what softmax weights turn into
probabilities. A text's are those of its windows, weighted by their bytes.

Training takes a bounded sample of different labelled texts, the same number for each
language, and meets it in one task; max pooling sends each filter's gradient to one place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldscope.llm import texts

WINDOW = 256
#: Labelled texts to train on at most, over all languages; two windows are taken of each.
SAMPLE = 8_000
UNKNOWN = "und"
_BATCH = 64


@dataclass(frozen=True)
class Settings:
    """Filters of each width, and how long and fast to learn."""

    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 24
    steps: int = 800
    rate: float = 0.004
    seed: int = 1


@dataclass(frozen=True)
class Network:
    """Languages in order, tables (width x 256 x filters) and biases of each width, softmax weights."""

    languages: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    dense: np.ndarray
    shift: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(largest responses, their places for each width) of windows of bytes."""
        found, places = [], []
        for table, bias in zip(self.tables, self.biases):
            width = len(table)
            room = windows.shape[1] - width + 1
            total = table[0][windows[:, :room]]
            for k in range(1, width):
                total += table[k][windows[:, k:k + room]]
            at = total.argmax(axis=1)
            places.append(at)
            found.append(np.maximum(np.take_along_axis(total, at[:, None], 1)[:, 0] + bias, 0))
        return np.concatenate(found, axis=1), places

    def largest(self, windows: np.ndarray) -> np.ndarray:
        """The largest responses alone."""
        found = []
        for table, bias in zip(self.tables, self.biases):
            room = windows.shape[1] - len(table) + 1
            total = table[0][windows[:, :room]]
            for k in range(1, len(table)):
                total += table[k][windows[:, k:k + room]]
            found.append(np.maximum(total.max(axis=1) + bias, 0))
        return np.concatenate(found, axis=1)

    def chances(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each window, ``_BATCH`` windows at a time."""
        parts = [_softmax(self.largest(windows[i:i + _BATCH]) @ self.dense + self.shift)
                 for i in range(0, len(windows), _BATCH)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy, in the order tables, biases, dense, shift."""
    n = len(windows)
    pooled, places = net.pooled(windows)
    error = _softmax(pooled @ net.dense + net.shift)
    error[np.arange(n), labels] -= 1
    error /= n
    back = (error @ net.dense.T) * (pooled > 0)
    tables, biases, first = [], [], 0
    for table, at in zip(net.tables, places):
        count = table.shape[2]
        g = back[:, first:first + count]
        first += count
        out = np.zeros_like(table)
        for k in range(len(table)):
            seen = windows[np.arange(n)[:, None], at + k]
            np.add.at(out[k], (seen, np.arange(count)[None, :]), g)
        tables.append(out)
        biases.append(g.sum(axis=0))
    return [*tables, *biases, pooled.T @ error, error.sum(axis=0)]


def learn(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], settings: Settings) -> Network:
    """A network of labelled windows. Half of the windows are cut to a drawn length in each step,
    so that short texts are known as well; the number of steps (Adam's) is the same at every size."""
    draw = np.random.default_rng(settings.seed)
    small = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
    w = len(settings.widths)
    held = [*(small(width, 256, settings.filters) for width in settings.widths),
            *(np.zeros(settings.filters, np.float32) for _ in settings.widths),
            small(w * settings.filters, len(languages)), np.zeros(len(languages), np.float32)]
    net = Network(languages, tuple(held[:w]), tuple(held[w:2 * w]), held[-2], held[-1])
    mean, spread = [np.zeros_like(x) for x in held], [np.zeros_like(x) for x in held]
    order = np.zeros(0, np.int64)
    for turn in range(1, settings.steps + 1):
        while len(order) < _BATCH:
            order = np.concatenate([order, draw.permutation(len(windows))])
        some, order = order[:_BATCH], order[_BATCH:]
        batch, size = windows[some].copy(), lengths[some]
        short = np.where(draw.random(_BATCH) < 0.5, draw.integers(6, WINDOW + 1, _BATCH), WINDOW)
        batch[np.arange(WINDOW)[None, :] >= np.minimum(size, short)[:, None]] = 0
        rate = settings.rate * (1 - turn / (settings.steps + 1))
        for x, g, m, v in zip(held, gradients(net, batch, labels[some]), mean, spread):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= (rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.999 ** turn)) + 1e-8)).astype(np.float32)
    return net


def _cut(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes in each) of all texts; an empty text has none."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][text] + number * WINDOW
    lengths = np.minimum(offsets[1:][text] - starts, WINDOW)
    padded = np.append(data, np.zeros(WINDOW, np.uint8))
    at = starts[:, None] + np.arange(WINDOW)[None, :]
    windows = padded[np.minimum(at, len(padded) - 1)]
    windows[np.arange(WINDOW)[None, :] >= lengths[:, None]] = 0
    return windows, text, lengths


def _drawn() -> object:
    """Two windows of each text, a third and two thirds of the way (one, if it has no more)."""

    def work(offsets, data):
        out = []
        for _, o, d in texts.chunks(offsets, data):
            sizes = np.diff(o)
            counts = -(-sizes // WINDOW)
            for i, n in enumerate(counts.tolist()):
                picks = sorted({n // 3, 2 * n // 3}) if n else []
                out.append([d[o[i] + p * WINDOW:min(o[i + 1], o[i] + (p + 1) * WINDOW)].tobytes() for p in picks])
        return [out]

    return work


def train(documents: DataFrame, *, text: str = "text", language: str = "lang", sample: int = SAMPLE,
          settings: Settings = Settings()) -> Network | None:
    """A network of the rows with a language and a text that holds a letter; None without any.

    Different texts of a language are counted, then drawn by a hash, ``sample`` over the
    number of languages of each; copies count once. Of more languages than ``sample`` the
    most frequent ones are learned.
    """
    value = F.col(f"`{text}`").cast("string")
    known = documents.select(F.col(f"`{language}`").cast("string").alias("lang__"), F.xxhash64(value).alias("mark__"), value.alias("text__")).where(
        F.col("lang__").isNotNull() & value.rlike(r"\p{L}"))
    marks = known.groupBy("lang__", "mark__").agg(F.lit(1).alias("one"))
    counts = marks.groupBy("lang__").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang__").limit(sample).collect()
    if not counts:
        return None
    share = max(1, sample // len(counts))
    # a hash below this value: somewhat more rows than the share, which is then taken exactly
    below = [(r["lang__"], min(1.0, (share + 6 * share ** 0.5 + 10) / r["n"])) for r in counts]
    bound = F.broadcast(documents.sparkSession.createDataFrame(below, "lang__ string, below double"))
    place = F.pmod(F.xxhash64("mark__", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = marks.join(bound, "lang__").where(place < F.col("below")).select("lang__", "mark__", place.alias("place"))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("lang__").orderBy("place", "mark__"))
    chosen = drawn.withColumn("number", number).where(F.col("number") <= share).select("lang__", "mark__")
    windows = texts.map_texts(known.join(F.broadcast(chosen), ["lang__", "mark__"]), [F.col("lang__"), F.col("mark__")], F.col("text__"),
                              _drawn, "windows array<binary>")
    languages = tuple(sorted(r["lang__"] for r in counts))
    # of copies one is enough
    once = windows.groupBy("lang__", "mark__").agg(F.first("windows").alias("windows"))

    def fit(batches):
        rows = sorted((m, lang, w) for b in batches for lang, m, ws in zip(*(c.to_pylist() for c in b.columns)) for w in ws)
        if not rows:
            return
        place = {lang: i for i, lang in enumerate(languages)}
        cut = np.stack([np.frombuffer(w.ljust(WINDOW, b"\0"), np.uint8) for _, _, w in rows])
        net = learn(cut, np.array([len(w) for *_, w in rows]), np.array([place[lang] for _, lang, _ in rows]), languages, settings)
        held = [*net.tables, *net.biases, net.dense, net.shift]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(held))), pa.array([list(x.shape) for x in held], pa.list_(pa.int32())),
                                          pa.array([x.tobytes() for x in held])], names=["number", "shape", "data"])

    got = once.repartition(1).mapInArrow(fit, "number bigint, shape array<int>, data binary").orderBy("number").collect()
    held = [np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in got]
    w = len(settings.widths)
    return Network(languages, tuple(held[:w]), tuple(held[w:2 * w]), held[-2], held[-1])


def predict(documents: DataFrame, keep: list[Column], net: Network | None, *, text: str = "text") -> DataFrame:
    """The kept columns with lang_pred and score (the text's probability of it, 0 to 1).

    ``und`` and 0 for a text that is null or has no letter, and for all texts without a
    network. Equal probabilities go to the language that sorts first.
    """
    value = F.col(f"`{text}`").cast("string")
    fields = "lang_pred string, score double"
    letters = F.when(value.rlike(r"\p{L}"), value)
    if net is None:
        return documents.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def make():
        names = [*net.languages, UNKNOWN]

        def work(offsets, data):
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, o, d in texts.chunks(offsets, data):
                # a long text is met in runs of windows
                total = np.zeros((len(o) - 1, len(net.languages)))
                for first, part, piece in _runs(o, d):
                    windows, text_of, lengths = _cut(part, piece)
                    np.add.at(total, first + text_of, net.chances(windows) * lengths[:, None])
                sizes = np.diff(o)
                total /= np.maximum(sizes, 1)[:, None]
                at = total.argmax(axis=1)
                best.append(np.where(sizes > 0, at, len(net.languages)))
                score.append(np.where(sizes > 0, np.minimum(total[np.arange(len(at)), at], 1.0), 0.0))
            return [pa.array([names[i] for i in np.concatenate(best)], pa.string()), np.concatenate(score)]

        return work

    return texts.map_texts(documents, keep, letters, make, fields)


def _runs(offsets: np.ndarray, data: np.ndarray, size: int = 1 << 18):
    """(first text, offsets, bytes) of pieces of about ``size`` bytes; a longer text is cut between windows."""
    for first, o, d in texts.chunks(offsets, data, size):
        if len(o) == 2 and len(d) > size:
            for at in range(0, len(d), size):
                piece = d[at:at + size]
                yield first, np.array([0, len(piece)]), piece
        else:
            yield first, o, d
