"""Language identification by a convolutional network over bytes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import prepare

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 128
#: Labelled documents that training sees at most, whole; every language has an equal part of them, or all that it has.
TRAINING_ROWS = 3000
#: Steps of training, and windows of each, drawn from all windows of these documents.
STEPS, BATCH = 1700, 64

_WORDLIKE = re.compile(r"[^\W\d_]+")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def windows_of(texts: list[bytes], size: int = WINDOW, overlap: int = max(WIDTHS) - 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``size`` folded bytes that cover each text, zero at the end, and the text each is from.

    Neighbours share ``overlap`` bytes, so every filter position of a text is in some window.
    """
    step = size - overlap
    counts = np.array([max(1, -(-(len(t) - overlap) // step)) for t in texts], np.int64)
    out = np.zeros((int(counts.sum()), size), np.uint8)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        flat = np.zeros(n * step + overlap, np.uint8)
        flat[: len(text)] = np.frombuffer(text, np.uint8)
        out[at : at + n] = np.lib.stride_tricks.sliding_window_view(flat, size)[::step]
        at += n
    return _FOLD[out], np.repeat(np.arange(len(texts)), counts)


@dataclass
class ByteConvNet:
    """Multi-width one-hot byte filters, max pooling over a window, a softmax layer.

    ``filters[w][o]`` has a row of filter weights for each byte at offset ``o`` of a filter of width ``w``.
    """

    labels: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], widths: tuple[int, ...] = WIDTHS, filters: int = FILTERS, seed: int = 1) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        n = filters * len(widths)
        own = {w: rng.normal(0, 0.5 / w**0.5, (w, 256, filters)).astype(np.float32) for w in widths}
        return cls(labels, own, np.zeros(n, np.float32), rng.normal(0, n**-0.5, (n, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest response of each filter in each window, and its position if asked."""
        values, places = [], []
        for w, f in self.filters.items():
            n = x.shape[1] - w + 1
            s = f[0][x[:, :n]]
            for o in range(1, w):
                s += f[o][x[:, o : o + n]]
            values.append(s.max(1))
            if where:
                places.append(s.argmax(1))
        return np.concatenate(values, 1), np.concatenate(places, 1) if where else None

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, document: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 2) -> ByteConvNet:
        """Adam on the cross entropy of windows ``x`` of documents; documents are drawn alike whatever their length, classes weigh alike whatever their share."""
        rng = np.random.default_rng(seed)
        params = [*self.filters.values(), self.bias, self.dense, self.offset]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        start = np.flatnonzero(np.concatenate(([True], document[1:] != document[:-1])))
        size, of = np.diff(np.append(start, len(document))), y[start]
        weight = (len(of) / len(self.labels) / np.maximum(1, np.bincount(of, minlength=len(self.labels)))).astype(np.float32)
        k = next(iter(self.filters.values())).shape[2]
        for turn in range(steps):
            d = rng.integers(0, len(start), batch)
            b = start[d] + rng.integers(0, size[d])
            pooled, where = self.pooled(x[b], True)
            hidden = np.maximum(pooled + self.bias, 0)
            error = self.probabilities(pooled)
            error[np.arange(len(b)), y[b]] -= 1
            error *= (weight[y[b]] / len(b))[:, None]
            back = (error @ self.dense.T) * (hidden > 0)
            grads = []
            for j, (w, f) in enumerate(self.filters.items()):
                g, mine, at = np.zeros_like(f), back[:, j * k : j * k + k], where[:, j * k : j * k + k]
                for o in range(w):
                    np.add.at(g[o], (np.take_along_axis(x[b], at + o, 1), np.arange(k)[None, :]), mine)
                grads.append(g)
            grads += [back.sum(0), hidden.T @ error, error.sum(0)]
            t += 1
            step = rate * (1 - turn / steps)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        return self

    def compiled(self) -> Compiled:
        return Compiled(self)


class Compiled:
    """The same network with filters looked up by byte pairs, two positions at a time."""

    def __init__(self, net: ByteConvNet):
        self.net, pair = net, np.arange(65536)
        first, second = pair & 255, pair >> 8  # of a little-endian pair
        self.parts = {}
        for w, f in net.filters.items():
            steps = [(o, (f[o][first] + f[o + 1][second]).astype(np.float32)) for o in range(0, w - 1, 2)]
            self.parts[w] = steps, f[w - 1] if w % 2 else None

    def pooled(self, x: np.ndarray) -> np.ndarray:
        pairs = x[:, :-1].astype(np.uint16) | (x[:, 1:].astype(np.uint16) << 8)
        out = []
        for w, (steps, tail) in self.parts.items():
            n = x.shape[1] - w + 1
            s = np.take(steps[0][1], pairs[:, :n], 0)
            for o, table in steps[1:]:
                s += np.take(table, pairs[:, o : o + n], 0)
            if tail is not None:
                s += np.take(tail, x[:, w - 1 : w - 1 + n], 0)
            out.append(s.max(1))
        return np.concatenate(out, 1)

    def texts(self, texts: list[bytes], chunk: int = 256) -> np.ndarray:
        """The mean of the windows' probabilities for each text; each text is read whole, a chunk of windows at a time."""
        out = np.zeros((len(texts), len(self.net.labels)))
        x, owner = windows_of(texts)
        for i in range(0, len(x), chunk):
            np.add.at(out, owner[i : i + chunk], self.net.probabilities(self.pooled(x[i : i + chunk])))
        return out / np.bincount(owner, minlength=len(texts))[:, None]


def training_sample(docs: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang") -> list[tuple[bytes, str]]:
    """Whole texts and labels of at most ``rows`` rows, as many of each language or all that it has, picked by a hash of id and text.

    A row at least is kept of every language, so the bound is the number of languages if that is more.
    """
    light = docs.where(F.col(lang).isNotNull() & F.col(text_col).isNotNull())
    counts = dict(light.groupBy(lang).count().toLocalIterator())  # a row for each class of the network
    if not counts:
        return []
    each, scale = max(1, rows // len(counts)), 1 << 40
    chance = F.lit(0)
    for name, n in counts.items():  # twice as many as needed; the first of them stay
        chance = F.when(F.col(lang) == name, F.lit(min(scale, int((2 * each + 50) / n * scale) + 1))).otherwise(chance)
    key = F.xxhash64(F.lit(11), F.col(id_col).cast("string"), F.col(text_col))
    some = light.where(F.pmod(key, F.lit(scale)) < chance).select(key.alias("key"), F.col(text_col).alias("text"), F.col(lang).alias("lang"))
    first = Window.partitionBy("lang").orderBy("key", "text")
    found = some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).orderBy("key", "text", "lang").collect()
    return [(r.text.encode(), r.lang) for r in found]


def train(sample: list[tuple[bytes, str]]) -> Compiled | None:
    labels = sorted({lang for _, lang in sample})
    if not labels:
        return None
    x, owner = windows_of([t for t, _ in sample])
    y = np.array([labels.index(lang) for _, lang in sample])
    return ByteConvNet.fresh(labels).train(x, y[owner], owner).compiled()


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's category L is in a text; ``\\w`` alone takes some numbers and marks too."""
    return any(c.isalpha() for m in _WORDLIKE.finditer(text) for c in m[0])


def identify(docs: DataFrame, training: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", lang: str = "lang") -> DataFrame:
    """The columns ``keep`` of every row, whatever their names, and last ``lang_pred`` and ``score``.

    A network is trained on a bounded sample of the labelled rows of ``training`` and applied to fixed-length
    windows that cover all of every text; a text's score is the mean probability of the language predicted.
    Only the text's bytes are read. Null texts, texts without a letter, and all texts if nothing is
    labelled get ``und`` and 0. An empty table gives no row.
    """
    spark = prepare(docs.sparkSession)
    net = train(training_sample(training, id_col=id_col, text_col=text_col, lang=lang))
    sent = spark.sparkContext.broadcast(net.net if net else None)
    own = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value.compiled() if sent.value else None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = part.column(len(keep)).to_pylist()
                said = [k for k, t in enumerate(texts) if mine and t and has_letter(t)]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if said:
                    p = mine.texts([texts[k].encode() for k in said])
                    for k, best, score in zip(said, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                        langs[k], scores[k] = mine.net.labels[best], min(1.0, score)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(langs), pa.array(scores, pa.float64())], [*own, "lang_pred", "score"])

    rows = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(o) for c, o in zip(keep, own, strict=True)], F.col(text_col).alias("text"))
    fields = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, fields).toDF(*keep, "lang_pred", "score")


def drop_unidentified(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that get a language, with all their columns, whatever their names."""
    names = docs.columns
    return identify(docs, training, names, id_col, text_col, lang).toDF(*[f"c{i}" for i in range(len(names))], "lang_pred", "score").where("lang_pred <> 'und'").drop("lang_pred", "score").toDF(*names)


def fold(doc_id: Column) -> Column:
    """The remainder by 4 of the id's CRC-32."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
