"""Scoring of whole documents by a gated recurrent language model (operator 6).

Word counts of all training documents are gathered first.  The most frequent words have ids of their own in the
network, all others share one; a word's chance is then the network's chance of that id, times the word's
smoothed share of the words that have none.  So every text has a proper probability.

The network learns by truncated backpropagation from every word of every training document, once: each learner gets a share of
the texts, which follow each other with their ends and the state carried on; all start from the same weights, and their
weights are averaged.
Scoring runs over whole texts, with the state carried from window to window.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.llm.common import op_query, table
from sharetide.llm.gru import Gru
from sharetide.llm.op03_substring import keyed
from sharetide.llm.op08_langid import held_out
from sharetide.llm.textmath import mix, pieces, words_of
from sharetide.session import spread, stage

WIDTH, CLASSES = 32, 32  # the network knows WIDTH * CLASSES ids
KNOWN = 1 << 18  # counts of so many words are sent to all tasks (2 MB of hashes); other words are joined
RATE = 0.02
PREFIX = 19  # bits by which words are looked up
SHARE, STRETCH = 1 << 21, 1 << 15  # words of a learner, about; of a text that go to the same one
FINE = 24  # bits of a weight behind the point when weights are averaged
PIECE = 4 << 20  # bytes of text scored together
END = 1  # hash that stands for the end of a text


class Lexicon:
    """The most frequent words: hashes in order, counts, and the network's ids."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, ends: int) -> None:
        ids = WIDTH * CLASSES
        self.total, self.distinct, self.ends = total, distinct, ends
        self.end, self.rare = 0, ids - 1
        own = min(len(words), ids - 2)
        unigram = np.zeros(ids, np.int64)
        unigram[0], unigram[1 : own + 1] = ends, counts[:own]
        self.rare_total = total - int(unigram.sum())
        self.rare_distinct = max(0, distinct - own - 1)
        unigram[self.rare] = self.rare_total
        self.unigram = unigram
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.ids = np.where(order < own, order + 1, self.rare).astype(np.int32)
        # Hashes are spread evenly, so those with equal first bits are few; a search begins at the first of them.
        self.first = np.searchsorted(self.words, np.arange(1 << PREFIX, dtype=np.uint64) << np.uint64(64 - PREFIX)).astype(np.int32)
        self.most = int(np.diff(np.append(self.first, len(words))).max())
        self.padded = np.concatenate((self.words, np.zeros(self.most, np.uint64)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Network id, count, and whether the word is here."""
        if not len(self.words):
            return np.full(len(hashes), self.rare), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = self.first[hashes >> np.uint64(64 - PREFIX)]
        for _ in range(self.most - 1):
            at += self.padded[at] < hashes
        at = np.minimum(at, len(self.words) - 1)
        here = self.words[at] == hashes
        return np.where(here, self.ids[at], self.rare), np.where(here, self.counts[at], 0), here


def count_words(docs: DataFrame, column: str = "text") -> DataFrame:
    """``word`` (hash), ``c`` over all texts; ends are not counted here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, column, PIECE):
            word, n = np.unique(words_of(b.column(column), True).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "c"])

    return docs.select(column).mapInArrow(run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame, ends: int) -> Lexicon:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(KNOWN).toArrow()
    return Lexicon(top["word"].to_numpy().view(np.uint64), top["c"].to_numpy(), total["n"] + ends, total["v"] + (ends > 0), ends)


def train(docs: DataFrame, words: Lexicon, column: str = "text") -> Gru:
    """The network, learnt from every word of ``docs`` (with row_key): learners on equal shares, averaged.

    Which learner gets a text, and in which order, follows from a hash of the row, and weights are summed as whole numbers, so
    the same rows give the same network however they are partitioned.  The number of learners grows with the text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, Gru.fresh(words.unigram, WIDTH, words.end)))
    shares = max(1, -(-words.total // SHARE))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value[0]
        for b in pieces(batches, column):
            w = words_of(b.column(column), True)
            ids = lex.find(w.hash)[0].astype("<u2")
            end = np.array([lex.end], "<u2")
            rows, texts = [], []
            for row, x, y in zip(b.column("row_key").to_pylist(), w.first.tolist(), w.first[1:].tolist()):
                text = np.concatenate((ids[x:y], end))
                for k in range(0, len(text), STRETCH):  # a very long text goes to several learners
                    rows.append((row, k))
                    texts.append(text[k : k + STRETCH].tobytes())
            key = np.array(rows, np.int64).reshape(-1, 2)
            place = mix(key[:, 0].view(np.uint64) + mix(key[:, 1].view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((place % np.uint64(shares)).astype(np.int64)), pa.array(mix(place).view(np.int64)), pa.array(texts, pa.binary())], ["share", "place", "ids"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, steps, held, now = None, 0, [], None

        def take() -> None:
            nonlocal total, steps
            fresh = shared.value[1]
            net = fresh.load(fresh.flat())
            done = net.learn(np.frombuffer(b"".join(held), "<u2").astype(np.int64), RATE)
            mine = np.rint(net.flat().astype(np.float64) * (1 << FINE)).astype(np.int64) * done
            total, steps = (mine if total is None else total + mine), steps + done

        for b in batches:
            for share, text in zip(b.column("share").to_pylist(), b.column("ids").to_pylist()):
                if held and share != now:
                    take()
                    held = []
                now = share
                held.append(text)
        if held:
            take()
        if steps:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64())), pa.array([steps])], ["weights", "steps"])

    texts = docs.select("row_key", column).mapInArrow(cut, "share bigint, place bigint, ids binary")
    learnt = stage(spread(texts, "share").sortWithinPartitions("share", "place", "ids").select("share", "ids").mapInArrow(learn, "weights array<bigint>, steps bigint"), "weights")
    mean = learnt.select("steps", F.posexplode("weights").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("steps").alias("steps")).orderBy("at").toArrow()
    model = shared.value[1]
    return model.load(mean["x"].to_numpy() / mean["steps"].to_numpy() / (1 << FINE)) if mean.num_rows else model


def score(docs: DataFrame, counts: DataFrame, words: Lexicon, model: Gru, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``row_key``, ``n_tokens``, ``n_known``, ``base_score``, ``score`` of the rows of ``docs`` (with row_key)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, model))
    base_n, rare_n = log10(words.total + words.distinct + 1), log10(words.rare_total + words.rare_distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, net = shared.value
        for b in pieces(batches, column, PIECE):
            w = words_of(b.column(column), True)
            n = b.num_rows
            doc = np.repeat(np.arange(n), w.counts)
            ids, c, here = lex.find(w.hash)
            network = net.score([np.append(ids[x:y], lex.end) for x, y in zip(w.first, w.first[1:])]) / np.log(10)
            logs = np.log10(c[here] + 1.0)
            rare = here & (ids == lex.rare)
            base = np.bincount(doc[here], logs, n) + np.log10(lex.ends + 1.0)
            own = network + np.bincount(doc[rare], np.log10(c[rare] + 1.0), n)
            known = np.bincount(doc[here], minlength=n) + (lex.ends > 0)
            rares = np.bincount(doc[ids == lex.rare], minlength=n)
            away = np.flatnonzero(~here)
            order = away[np.lexsort((w.hash[away], doc[away]))]
            fresh = np.flatnonzero((np.diff(w.hash[order], prepend=~w.hash[order[:1]]) != 0) | (np.diff(doc[order], prepend=-1) != 0))
            times, met = np.diff(np.append(fresh, len(order))), order[fresh]
            row = b.column("row_key").to_numpy()
            m = len(met)
            nothing = np.zeros(m)
            columns = {
                "row_key": np.concatenate((row, row[doc[met]])),
                "word": np.concatenate((row, w.hash[met].view(np.int64))),
                "times": np.concatenate((np.zeros(n, np.int64), times)),
                "n_tokens": np.concatenate((w.counts + 1, nothing.astype(np.int64))),
                "n_known": np.concatenate((known, nothing.astype(np.int64))),
                "base": np.concatenate((base - (w.counts + 1) * base_n, nothing)),
                "own": np.concatenate((own - rares * rare_n, nothing)),
            }
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))

    schema = "row_key bigint, word bigint, times bigint, n_tokens bigint, n_known bigint, base double, own double"
    found = docs.select("row_key", column).mapInArrow(run, schema).join(counts, "word", "left")
    more = F.coalesce(F.col("times") * F.log10(F.col("c") + F.lit(1.0)), F.lit(0.0))
    return found.groupBy("row_key").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + more).alias("base_score"),
        F.sum(F.col("own") + more).alias("score"),
    )


def score_documents(docs: DataFrame, key: str = "doc_id", column: str = "text", modulus: int = 7) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``: one row per row.

    Null and empty texts are one end token.  Rows with a null key are trained on.  Rows equal in key and text get
    equal scores.  An empty table gives an empty table; with no training rows every token is unknown.  Other
    columns are left behind.
    """
    rows = keyed(docs.select(key, column), key, column)
    teaching = rows.where(~held_out(key, modulus))
    ends = teaching.count()
    counts = stage(count_words(teaching, column), "counts")
    words = lexicon(counts, ends)
    model = train(teaching, words, column)
    once = rows.groupBy("row_key").agg(F.count("*").alias("copies"))
    scored = score(rows, counts, words, model, key, column).join(once, "row_key")
    plain = rows.select(key, "row_key", held_out(key, modulus).alias("held_out"))
    return plain.join(scored, "row_key").select(
        key, "held_out", (F.col("n_tokens") / F.col("copies")).cast("bigint").alias("n_tokens"), (F.col("n_known") / F.col("copies")).cast("bigint").alias("n_known"),
        F.lit(words.total).cast("bigint").alias("train_tokens"), (F.col("base_score") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
    )


@op_query("op6_gru_lm")
def op6_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
