"""Language identification by a byte convolutional network (operator 8).

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's maximum
is kept, and a softmax gives the language.  The network is trained in numpy on a bounded sample of
labelled rows (``PER_LANG`` documents a language, two windows each) and applied to all windows of a text;
a text's probabilities are the means of its windows'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharetide.llm.common import op_query, table
from sharetide.llm.textmath import pieces, ragged, text_bytes

PER_LANG = 800  # bound of the training sample: documents of each language, the first by hash
WINDOW, WIDTHS, FILTERS, EMBED = 200, (2, 3, 4), 16, 8
EPOCHS, STEPS, BATCH, RATE = 3, 300, 64, 0.01  # passes over the sample, and steps, at least
CHUNK = 2048  # windows scored at a time

_FOLD = np.full(256, 32, np.uint8)  # all that is no letter becomes a space
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin letters; everything else in ASCII a space."""
    out = _FOLD[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def cut(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, padded with zeros, and the row of each."""
    data, at = text_bytes(column)
    data = fold(data)
    size = np.diff(at)
    count = np.maximum(-(-size // WINDOW), 1)
    row = np.repeat(np.arange(len(size)), count)
    start = ragged(np.zeros(len(size), np.int64), count) * WINDOW
    length = np.minimum(WINDOW, size[row] - start)
    out = np.zeros((len(row), WINDOW), np.uint8)
    out[np.repeat(np.arange(len(row)), length), ragged(np.zeros(len(row), np.int64), length)] = data
    return out, row


@dataclass
class ByteNet:
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # by width: (width, EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int) -> ByteNet:
        r = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        return cls(
            langs, r.normal(0, 0.5, (256, EMBED)), [r.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS],
            np.zeros(n), r.normal(0, 1 / np.sqrt(n), (n, len(langs))), np.zeros(len(langs)),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of all filters over each window (before the bias), and where they are."""
        best, where = [], []
        for f in self.filters:
            n = x.shape[1] - len(f) + 1
            y = sum((self.embed @ f[k])[x[:, k : k + n]] for k in range(len(f)))
            at = y.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(y, at[:, None], 1)[:, 0])
        return np.concatenate(best, 1), where

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled + self.bias, 0)
        z = hidden @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return hidden, z / z.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        pooled, where = self.pooled(x)
        hidden, p = self.head(pooled)
        p[np.arange(len(x)), label] -= 1
        p /= len(x)
        d_hidden = (p @ self.out.T) * (hidden > 0)
        d_embed, d_filters = np.zeros_like(self.embed), []
        column, rows = np.arange(FILTERS), np.arange(len(x))[:, None]
        for i, f in enumerate(self.filters):
            d, g = d_hidden[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(f)
            for k in range(len(f)):
                by_byte = np.zeros((256, FILTERS))
                np.add.at(by_byte, (x[rows, where[i] + k], column), d)
                g[k] = self.embed.T @ by_byte
                d_embed += by_byte @ f[k].T
            d_filters.append(g)
        return [d_embed, *d_filters, d_hidden.sum(0), hidden.T @ p, p.sum(0)]

    def tables(self) -> list[list[np.ndarray]]:
        """By width, the sums that pairs of bytes (or a last single byte) add to the filters."""
        out = []
        for f in self.filters:
            single = [(self.embed @ w).astype(np.float32) for w in f]
            out.append([(single[k][:, None] + single[k + 1][None]).reshape(65536, FILTERS) if k + 1 < len(f) else single[k] for k in range(0, len(f), 2)])
        return out

    def score(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        best = []
        for parts, w in zip(tables, WIDTHS):
            n = x.shape[1] - w + 1
            y = parts[0][pair[:, :n]]
            for j, t in enumerate(parts[1:], 1):
                y += t[pair[:, 2 * j : 2 * j + n] if len(t) == 65536 else x[:, 2 * j : 2 * j + n]]
            best.append(y.max(1))
        return self.head(np.concatenate(best, 1))[1]


def train(windows: np.ndarray, labels: list[str], seed: int = 1) -> ByteNet:
    """Adam on mini-batches in a fixed order, so the same sample gives the same network."""
    langs = sorted(set(labels))
    net, r = ByteNet.fresh(langs, seed), np.random.default_rng(seed)
    y = np.searchsorted(langs, labels)
    m, v, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    epoch = 0
    while epoch < EPOCHS or step < STEPS:
        epoch, order = epoch + 1, r.permutation(len(y))
        for a in range(0, len(y), BATCH):
            chosen, step = order[a : a + BATCH], step + 1
            for p, g, m_, v_ in zip(net.parameters(), net.gradients(windows[chosen], y[chosen]), m, v):
                m_ += 0.1 * (g - m_)
                v_ += 0.001 * (g * g - v_)
                p -= RATE * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(key: str, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == 2, F.lit(False))


def fit(labelled: DataFrame, key: str = "doc_id", per_lang: int = PER_LANG) -> ByteNet | None:
    """Network learnt from ``key``, ``text``, ``lang``; rows with a null in any of them teach nothing.

    Of each text, two windows at hashed places are taken.  None if there is nothing to learn from.
    """
    ranked = Window.partitionBy("lang").orderBy(F.xxhash64(key, F.lit(1)), key)
    room = F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1
    place = lambda seed: F.substring(F.col("text"), (F.pmod(F.xxhash64(key, F.lit(seed)), room) + 1).cast("int"), F.lit(WINDOW))
    rows = (
        labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col(key).isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", key, place(2).alias("a"), place(3).alias("b"))
        .withColumn("n", F.row_number().over(ranked))
        .where(F.col("n") <= per_lang)
        .orderBy("lang", "n", "a", "b")
        .collect()
    )
    if not rows:
        return None
    texts = [t.encode()[:WINDOW] for r in rows for t in (r["a"], r["b"])]
    windows = np.stack([fold(np.frombuffer(t.ljust(WINDOW, b"\0"), np.uint8)) for t in texts])
    return train(windows, [r["lang"] for r in rows for _ in range(2)])


def predict(docs: DataFrame, net: ByteNet | None, column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: every row, whatever its other columns hold.

    Null texts and texts without a letter, and all texts where nothing was learnt, are ``und`` with score 0.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "_known")]
    plain = docs.select(*[f.name for f in fields], F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False)).alias("_known"))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for b in pieces(batches, column):
            known = b.column("_known").to_numpy(zero_copy_only=False)
            mean = np.zeros((b.num_rows, len(net.langs) if net else 1))
            if net:
                x, row = cut(b.column(column))
                for a in range(0, len(x), CHUNK):
                    np.add.at(mean, row[a : a + CHUNK], net.score(x[a : a + CHUNK], tables))
                mean /= np.bincount(row, minlength=b.num_rows)[:, None]
            top = mean.argmax(1)
            sure = [bool(k) and net is not None for k in known]
            lang = pa.array([net.langs[t] if s else "und" for t, s in zip(top, sure)], pa.string())
            score = pa.array([min(1.0, float(m)) if s else 0.0 for m, s in zip(mean.max(1), sure)], pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], lang, score], [*names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(run, schema)


@op_query("op8_langid")
def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out("doc_id", 4)))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")
