"""Spelling variants: words one edit apart, grouped around their commonest form (operator 12).

Two words are one edit apart if their common prefix and common suffix together reach the length of the longer word minus one.
Words are laid out as padded matrices of code points, and blocks of words are compared with blocks: a dense tile gives the
prefix and the suffix length of every pair in it at once.

Only blocks that can hold such a pair meet.  The edit lies in the first or in the second half of the longer word, so the
other half is the same in both: a word is dealt out by its length and each of its halves, as the longer and as the shorter
word of a pair.  Words with a half in common that are too many for one tile are dealt into blocks, and each pair of
blocks is a tile of its own.  A tile returns, by word, the number of near words and the commonest of them, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.llm.common import op_query, table
from sharetide.llm.groups import with_group
from sharetide.llm.textmath import mix
from sharetide.session import spread, stage

RUN = "[A-Za-zÀ-ÿ]+"
LOWER = {c: c + 32 for c in range(65, 91)}
BLOCK = 2048  # words of one side of a tile task
CELLS = 1 << 22  # cells of a matrix product held at a time


def spelled(key: object, word: str, modulus: int) -> str:
    """``word``, without one code point where ``modulus`` divides the hash of key and word."""
    h = zlib.crc32(f"{key}:{word}".encode())
    if h % modulus:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, key: str = "doc_id", column: str = "text", modulus: int = 97, least_length: int = 5) -> DataFrame:
    """``word``, ``n``: how often each word of at least ``least_length`` code points occurs over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(RUN).findall
        for b in batches:
            total: Counter = Counter()
            for k, text in zip(b.column(key).to_pylist(), b.column(column)):
                for word, n in Counter(find((text.as_py() or "").translate(LOWER))).items():
                    word = spelled("null" if k is None else k, word, modulus)
                    if len(word) >= least_length:
                        total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return docs.select(key, column).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Matrix:
    """Words as a padded matrix of code points, aligned at their begin and at their end."""

    def __init__(self, words: list[str]) -> None:
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(self.size.max()) if len(words) else 0
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        row = np.repeat(np.arange(len(words)), self.size)
        place = np.arange(len(points)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.head = np.zeros((len(words), width), np.int32)
        self.tail = np.zeros((len(words), width), np.int32)
        self.head[row, place] = points
        self.tail[row, self.size[row] - 1 - place] = points

    def __len__(self) -> int:
        return len(self.size)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of each row of a with each row of b; padding never counts."""
    out = np.zeros((len(a), len(b)), np.int32)
    going = np.ones(out.shape, bool)
    for c in range(min(a.shape[1], b.shape[1])):
        going &= (a[:, c, None] == b[None, :, c]) & (a[:, c] != 0)[:, None]
        if not going.any():
            break
        out += going
    return out


def near(m: Matrix, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words x are one edit away from the words y, none of which is longer; and the common prefixes."""
    prefix, suffix = _common(m.head[x], m.head[y]), _common(m.tail[x], m.tail[y])
    n = m.size[x][:, None]
    return (prefix + suffix >= n - 1) & (prefix < n), prefix


def halves(words: list[str]) -> np.ndarray:
    """Group keys of words, four each: first and last half as the longer of a pair's two words, then as the shorter.

    Of a pair whose longer word has n code points, both words have the first n // 2 or the last n - n // 2 in common.
    """
    keys = []
    for w in words:
        size = len(w)
        h, g = size // 2, (size + 1) // 2
        keys += [f"{size}<{w[:h]}", f"{size}>{w[h:]}", f"{size + 1}<{w[:g]}", f"{size + 1}>{w[g - 1 :]}"]
    return mix(np.fromiter(map(hash_of, keys), np.uint64, len(keys))).view(np.int64)


def hash_of(text: str) -> int:
    data = text.encode()
    return zlib.crc32(data) << 32 | zlib.crc32(data[::-1], 7)


_DEALT = "group bigint, first boolean, longer boolean, word string, n bigint"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_rows
        four = np.repeat(np.arange(n), 4)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(halves(b.column("word").to_pylist())),
                pa.array(np.tile([True, False, True, False], n)),
                pa.array(np.tile([True, True, False, False], n)),
                b.column("word").take(pa.array(four)),
                b.column("n").take(pa.array(four)),
            ],
            ["group", "first", "longer", "word", "n"],
        )


class Best:
    """By word: number of near words, and the one of largest n (ties: the first in code-point order)."""

    def __init__(self, n: np.ndarray, rank: np.ndarray) -> None:
        order = np.lexsort((rank, -n))  # best first
        self.place = np.empty(len(n), np.int64)
        self.place[order] = np.arange(len(n))
        self.order = order
        self.count = np.zeros(len(n), np.int64)
        self.best = np.full(len(n), len(n), np.int64)

    def meet(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        self.count[a] += linked.sum(1)
        self.count[b] += linked.sum(0)
        i, j = np.nonzero(linked)
        np.minimum.at(self.best, a[i], self.place[b[j]])
        np.minimum.at(self.best, b[j], self.place[a[i]])


def compare_tile(words: list[str], n: np.ndarray, longer: np.ndarray, first: bool, side: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near words of a block of a group among themselves or, if ``apart``, of side 0 with side 1.

    Returns the words that have any, their number, and the place of the best.  A pair is told in the group of its first half, or in
    that of the second where the first differs, so no pair is told twice.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    found, m = Best(n, rank), Matrix(words)
    long, short = np.flatnonzero(longer), np.flatnonzero(~longer)
    if apart:
        of = lambda rows, k: rows[side[rows] == k]
        meets = [(of(long, 0), np.concatenate((of(long, 1), of(short, 1))), False), (of(long, 1), of(short, 0), False)]
    else:
        meets = [(long, long, True), (long, short, False)]
    for a, b, once in meets:
        for y in range(0, len(b), BLOCK):
            cols = b[y : y + BLOCK]
            step = CELLS // len(cols)
            for x in range(0, len(a), step):
                rows = a[x : x + step]
                linked, prefix = near(m, rows, cols)
                if not first:
                    linked &= prefix < (m.size[rows] // 2)[:, None]
                if once:
                    linked &= rows[:, None] < cols[None]
                if linked.any():
                    found.meet(rows, cols, linked)
    hit = np.flatnonzero(found.count)
    return hit, found.count[hit], found.order[found.best[hit]]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of tile; per word with near words in its tile: their number and the best of them."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        words, n = t["word"].to_pylist(), t["n"].to_numpy()
        longer, side = t["longer"].to_numpy().astype(bool), t["side"].to_numpy()
        hit, count, best = compare_tile(words, n, longer, t["first"][0].as_py(), side, t["apart"][0].as_py())
        return pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in hit.tolist()], pa.string()), pa.array(count), pa.array([words[i] for i in best.tolist()], pa.string()), pa.array(n[best])],
            ["word", "n_near", "best", "best_n"],
        )

    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        tile = b.column("tile").to_numpy()
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        for x, y in zip(cuts, cuts[1:]):
            if held and tile[x] != now:
                if sum(map(len, held)) > 1:
                    yield solve(held)
                held = []
            if y > x:
                now = tile[x]
                held.append(b.slice(x, y - x))
    if held and sum(map(len, held)) > 1:
        yield solve(held)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word``, ``n_near``, ``best``, ``best_n`` of each word of ``words`` (word, n) that has a near word."""
    dealt = stage(words.mapInArrow(_deal, _DEALT), "halves")
    # A group whose rows are all of shorter words, or that has one row, has no pair.
    sized = with_group(
        dealt, ["group"], F.col("word"), size=(F.count("*"), F.sum), longest=(F.max("longer"), F.max),
    ).where("size > 1 and longest")
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = sized.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("word", F.lit(11)), F.col("blocks")).cast("int"))
    # A word of block k lies in the tiles of all pairs of blocks that have k on either side.
    paired = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("group", F.least("own", "with"), F.greatest("own", "with")).alias("tile")
    tiled = paired.select(tile, (F.col("own") != F.col("with")).alias("apart"), (F.col("own") > F.col("with")).cast("int").alias("side"), "first", "longer", "word", "n")
    met = spread(tiled, "tile").sortWithinPartitions("tile").mapInArrow(_tiles, "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b")["best"].alias("best"), (-F.col("b")["m"]).alias("best_n"))


def variants(docs: DataFrame, key: str = "doc_id", column: str = "text", modulus: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``: a row per distinct word.

    A form is the near word of largest n (ties: first in code-point order), if that n is at least ``ratio`` times the word's
    own; the root is the last of the forms that follow each other.  Null texts have no words, a null key is spelled
    ``null``, repeated rows count again, an empty table gives no rows, other columns are left behind.
    """
    words = stage(count_words(docs, key, column, modulus, least_length).where(F.col("n") >= least_count), "words")
    found = words.join(near_words(words), "word", "left")
    formed = F.col("best_n") >= ratio * F.col("n")
    formed = stage(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    # From the roots outwards: a word takes the root of its form.  A word has few near words, so no join key is hot.
    level = formed.where("form is null").select("word", F.col("word").alias("root"))
    waiting, rooted = formed.where("form is not null").select("word", "form"), level
    while not level.isEmpty():
        above = level.select(F.col("word").alias("form"), "root")
        level = stage(waiting.join(above, "form").select("word", "root"), "roots")
        rooted = rooted.unionByName(level)
    return formed.join(rooted, "word")


@op_query("op12_variants")
def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")
