"""Content-selected seeds shared by the operators on repeated passages.

A seed is the smallest hash among the runs of ``gram`` words in a stretch of ``reach`` such runs (winnowing).  Two
equal passages of gram + reach - 1 words select the same seed, wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharetide.llm.textmath import Words, inner, pieces, slide, windows_of, words_of
from sharetide.session import stage

FILTER_BITS = (1 << 16, 1 << 27)  # least and most bits of a filter: 16 MB at most, however large the corpus
HOT_SEED = 100_000  # occurrences from which a seed's passages are dealt out one by one


@dataclass
class Selected:
    grams: np.ndarray  # hash of the run of ``gram`` words at each word
    least: np.ndarray  # by stretch: its seed
    at: np.ndarray  # by stretch: its first word
    doc: np.ndarray  # by stretch: its document
    chosen: np.ndarray  # words at which a chosen seed starts


def select(w: Words, gram: int, reach: int) -> Selected:
    grams = windows_of(w.hash, gram)
    at, doc = inner(w.first, gram + reach - 1)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Selected(grams, grams[:0], at, doc, none)
    least = slide(grams, reach)[at]
    valid = np.zeros(len(grams) + reach - 1, np.uint64)  # padded in front, so the maximum looks back
    valid[at + reach - 1] = least
    return Selected(grams, least, at, doc, np.flatnonzero(slide(valid, reach, np.maximum) == grams))


def shared_seeds(docs: DataFrame, column: str, gram: int, reach: int) -> DataFrame:
    """Seeds that occur at least twice in the corpus, with their number; counted before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, column):
            s = select(words_of(b.column(column), False), gram, reach)
            seed, n = np.unique(s.grams[s.chosen], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n)], ["seed", "n"])

    counted = docs.select(column).mapInArrow(run, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    return stage(counted.where("n > 1"), "seeds")


def member_filter(seeds: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test that holds for every seed of ``seeds`` and for few others, in a table of bounded size.

    Its size follows the number of seeds up to 16 MB; beyond that more others pass, which costs work
    further on but changes no result.
    """
    spark, n = seeds.sparkSession, seeds.count()
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * n).bit_length()))
    mask = bits - 1
    places = F.explode(F.array(F.col("seed").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(mask))))
    words = (
        seeds.select(places.alias("bit")).select(F.shiftright("bit", 5).alias("word"), F.expr("shiftleft(1L, cast(bit & 31 as int))").alias("set")).groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()
    )
    table = np.zeros(bits >> 5, np.uint32)
    table[words["word"].to_numpy()] = words["set"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(table)

    def test(x: np.ndarray) -> np.ndarray:
        held, hit = shared.value, np.ones(len(x), bool)
        for place in (x & np.uint64(mask), (x >> np.uint64(32)) & np.uint64(mask)):
            hit &= (held[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        return hit

    return test


def first_words(sorted_key: np.ndarray) -> np.ndarray:
    """Positions at which the value of a sorted array changes, the first included."""
    return np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))) if len(sorted_key) else np.zeros(0, np.int64)


def joined_runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and length of runs of consecutive positions of one document; both arrays in order."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1))))
    return cut, np.diff(np.append(cut, len(doc)))
