"""Packing of tokenised documents into training sequences (operator 1).

First-fit decreasing, run independently in randomised groups of documents: documents are dealt out by a
hash of their id, and each task packs its documents in groups of a bounded number of tokens, so
memory does not grow with the data and a group needs nothing from another.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.llm import bpe
from sharetide.llm.bpe import NUMBER, OTHER, SPACE
from sharetide.llm.common import op_query, public_tokenizer, table
from sharetide.llm.textmath import pieces

GROUP_TOKENS = 1 << 21  # tokens packed together: about five hundred sequences
SIMPLE_LIMIT = 0x300  # code points below it are their own normal form


@functools.lru_cache(maxsize=1)
def _lower() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of simple code points, and which code points are simple."""
    simple = np.zeros(0x110000, bool)
    simple[:SIMPLE_LIMIT] = True
    simple[0x2010:0x2028] = True  # dashes, quotation marks, ellipsis
    simple[0x130] = False  # its lower case has two characters
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(SIMPLE_LIMIT):
        if simple[c]:
            lower[c] = ord(chr(c).lower())
    return lower, simple


@functools.lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_pretokens(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contractions, runs of letters, single numbers and runs of other characters; no white space."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = bpe.char_classes()[points]
    fresh = np.zeros(n, bool)
    fresh[at[:-1][at[:-1] < n]] = True
    start = fresh | (kind == NUMBER)
    start[1:] |= kind[1:] != kind[:-1]
    quote = np.flatnonzero(start & (points == 39) & (kind == OTHER))
    if len(quote):
        size = bpe.contractions(points, quote)
        limit = at[np.searchsorted(at, quote, side="right")]
        ok = (size > 0) & (quote + size <= limit)
        quote, size = quote[ok], size[ok]
        start[quote + 1] = False
        after = quote + size
        start[after[after < n]] = True
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    word = kind[begin] != SPACE
    return begin[word], end[word]


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and their number by text.

    Texts with characters that normalisation could change, or with a special token's string, go
    to the library as they are; all others are encoded together, which gives the same ids.
    """
    model, (lower, simple) = bpe.tokenizer(path), _lower()
    texts = [t or "" for t in texts]
    points = bpe.code_points("".join(texts))
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    odd = np.concatenate(([0], np.cumsum(~simple[points])))[at]
    other = [i for i, t in enumerate(texts) if odd[i + 1] > odd[i] or "<|" in t and model.specials and model.specials.search(t)]
    if other:
        plain = list(texts)
        for i in other:
            plain[i] = ""
        points = bpe.code_points("".join(plain))
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))))
    points = lower[points]
    start, end = word_pretokens(points, at)
    ids, sizes = model.encode(points.tobytes().decode("utf-32-le"), points, start, end, bpe.point_hashes(points))
    counts = np.diff(np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(start, at)])
    if other:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in other:
            parts[i] = np.asarray(_library(path).encode(texts[i], add_special_tokens=False).ids, np.int32)
        ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    return ids, counts


def tokenise(df: DataFrame, path: str, end_id: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key``, ``ids`` (binary, two bytes an id) of every row, with ``end_id`` after each text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(bpe.tokenizer(path).text) > 1 << 16:
            raise ValueError("ids of this vocabulary need more than two bytes")
        for b in pieces(batches, column):
            ids, counts = encode_texts(b.column(column).to_pylist(), path)
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u2")
            at = np.concatenate(([0], np.cumsum(counts + 1) * 2)).astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(key), data], [key, "ids"])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, ids binary")


class BinTree:
    """Tournament tree over the free space of bins: finds the first bin with enough of it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        found = node - self.leaves
        best[node] -= size
        while node > 1:
            node //= 2
            better = max(best[2 * node], best[2 * node + 1])
            if best[node] == better:
                break
            best[node] = better
        return found


def pack(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, bin, offset) of one group.

    Whole capacities are cut off long documents.  The rests are packed first-fit decreasing; ties keep
    their order.  The least filled bins, beyond the number that the tokens need, are then cut up into
    the gaps of the others, so only one bin of a group stays underfull.
    """
    full, rests = [], []
    for doc, n in enumerate(lengths):
        cut = n - n % capacity
        full += [(doc, s) for s in range(0, cut, capacity)]
        if n > cut:
            rests.append((n - cut, doc, cut))
    rests.sort(key=lambda r: -r[0])
    tree, bins = BinTree(len(rests), capacity), {}
    for size, doc, start in rests:
        bins.setdefault(tree.take(size), []).append((doc, start, size))
    ranked = sorted(bins.values(), key=lambda b: -sum(p[2] for p in b))
    need = -(-sum(r[0] for r in rests) // capacity)
    kept, spare = ranked[:need], [p for b in ranked[need:] for p in b]
    out = [(doc, s, capacity, i, 0) for i, (doc, s) in enumerate(full)]
    for i, content in enumerate(kept, len(full)):
        used = 0
        for doc, start, size in content:
            out.append((doc, start, size, i, used))
            used += size
        while used < capacity and spare:
            doc, start, size = spare.pop()
            part = min(size, capacity - used)
            out.append((doc, start, part, i, used))
            used += part
            if part < size:
                spare.append((doc, start + part, size - part))
    return out


def pack_documents(tokens: DataFrame, capacity: int = 4096, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """Pieces of packed sequences from rows of ``key`` and ``ids`` (two bytes an id).

    ``key``, ``start``, ``length``, ``ids`` (binary, four bytes an id), ``doc_tokens``, ``sequence_id``, ``offset``.
    Every row is a document of its own, also where keys repeat or are null.  The order within a
    task is fixed by hash, key and ids, so a task run again makes the same sequences.
    """
    kind = tokens.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
        keys, rows, size = [], [], 0
        for b in batches:
            for k, ids in zip(b.column(key).to_pylist(), b.column("ids").to_pylist()):
                keys.append(k)
                rows.append(ids)
                size += len(ids) // 2
                if size >= GROUP_TOKENS:
                    yield keys, rows
                    keys, rows, size = [], [], 0
        if rows:
            yield keys, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for keys, rows in groups(batches):
            lengths = [len(r) // 2 for r in rows]
            packed = pack(lengths, capacity)
            for a in range(0, len(packed), 256):
                part = packed[a : a + 256]
                yield pa.RecordBatch.from_pydict(
                    {
                        key: [keys[p[0]] for p in part],
                        "start": [p[1] for p in part],
                        "length": [p[2] for p in part],
                        "ids": [np.frombuffer(rows[d], "<u2", n, 2 * s).astype("<u4").tobytes() for d, s, n, _, _ in part],
                        "doc_tokens": [lengths[p[0]] for p in part],
                        "sequence_id": [number + p[3] for p in part],
                        "offset": [p[4] for p in part],
                    },
                    schema=pa.schema([(key, batch_type), *((c, pa.int64()) for c in ("start", "length")), ("ids", pa.binary()), *((c, pa.int64()) for c in ("doc_tokens", "sequence_id", "offset"))]),
                )
            number += 1 + max((p[3] for p in packed), default=-1)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(tokens.schema[key].dataType)
    order = F.xxhash64(key, F.lit(seed))
    dealt = tokens.select(key, "ids").repartition(order).sortWithinPartitions(order, key, F.crc32("ids"))
    return dealt.mapInArrow(run, schema)


def pack_corpus(docs: DataFrame, path: str | None = None, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Tokenise and pack; a null text counts as empty and still has its end token."""
    return pack_documents(tokenise(docs, path or public_tokenizer("word_bpe_49k.json"), end_id), capacity)


@op_query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_corpus(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
