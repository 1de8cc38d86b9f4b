"""Byte-level BPE encoding and decoding of whole texts (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.llm import bpe
from sharetide.llm.bpe import OTHER, SPACE
from sharetide.llm.common import op_query, public_tokenizer, table
from sharetide.llm.textmath import pieces


def pretokens(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pieces to encode alone, in texts lying at points[at[i]:at[i+1]].

    The published pattern is: a contraction; or letters, or numbers, or other characters, each with one
    leading space if there is one; or white space, of which the last character is left to a
    following word.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = bpe.char_classes()[points]
    fresh = np.zeros(n, bool)
    fresh[at[:-1][at[:-1] < n]] = True  # a text begins
    change = fresh.copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    run_end = np.append(run[1:], n)
    run_kind = kind[run]
    last_of_text = np.append(fresh[run[1:]], True)
    start = np.zeros(n + 1, bool)
    start[run] = True
    space_before = np.zeros(len(run), bool)
    space_before[1:] = (points[run[1:] - 1] == 32) & ~fresh[run[1:]]
    word = run_kind != SPACE
    joined = word & space_before  # the space belongs to the word
    start[run[joined]] = False
    start[run[joined] - 1] = True
    blank = (run_kind == SPACE) & ~last_of_text & (run_end - run > 1)
    start[run_end[blank] - 1] = True
    lone = run[(run_kind == OTHER) & ~space_before & (run_end - run == 1) & ~last_of_text & (points[run] == 39)]
    if len(lone):
        size = bpe.contractions(points, lone)
        lone, size = lone[size > 0], size[size > 0]
        within = lone + size <= at[np.searchsorted(at, lone, side="right")]  # not over the end of the text
        lone, size = lone[within], size[within]
        start[lone + 1] = False
        after = lone + size
        start[after[(after < n)]] = True
    begin = np.flatnonzero(start[:n])
    return begin, np.append(begin[1:], n)


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and their number by text; a null counts as the empty text."""
    model = bpe.tokenizer(path)
    parts, owner, marks = [], [], []  # strings of special tokens cut a text; marks: (part before it, its id)
    for i, t in enumerate(texts):
        t = t or ""
        here = 0
        if model.specials and "<|" in t:
            for m in model.specials.finditer(t):
                parts.append(t[here : m.start()])
                owner.append(i)
                marks.append((len(parts), model.special[m[0]]))
                here = m.end()
        parts.append(t[here:] if here else t)
        owner.append(i)
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
    text = "".join(parts)
    points = bpe.code_points(text)
    start, end = pretokens(points, at)
    ids, sizes = model.encode(text, points, start, end, bpe.point_hashes(points))
    total = np.concatenate(([0], np.cumsum(sizes)))
    upto = total[np.searchsorted(start, at)]
    by_part = np.diff(upto)
    counts = np.bincount(np.asarray(owner, np.int64), by_part, len(texts)).astype(np.int64) if parts else np.zeros(0, np.int64)
    if marks:
        ids = np.insert(ids, [upto[k] for k, _ in marks], [v for _, v in marks])
        for k, _ in marks:
            counts[owner[k - 1]] += 1
    return ids, counts


def encode(df: DataFrame, path: str, key: str = "doc_id", column: str = "text", decoded: bool = False) -> DataFrame:
    """``key``, ``ids`` array<int> and, if asked for, ``decoded``: the text that the ids stand for.

    Every row of ``df`` gives one row, repeated and null keys included; other columns are left behind.
    A null text counts as empty and has no ids.  An empty table gives an empty table.  A special
    token's string in a text becomes that token, as the tokenizers library does by default.
    """
    kind = df.schema[key].dataType
    schema = f"{key} {kind.simpleString()}, ids array<int>" + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.tokenizer(path)
        for b in pieces(batches, column):
            ids, counts = encode_texts(b.column(column).to_pylist(), path)
            at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            out = [b.column(key), pa.ListArray.from_arrays(pa.array(at), pa.array(ids, pa.int32()))]
            if decoded:
                out.append(pa.array(model.decode(ids, counts), pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["_1", "_2", "_3"][: len(out)]).rename_columns([key, "ids", "decoded"][: len(out)])

    return df.select(key, column).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """``key`` and ``text`` of rows of ids; null ids give the empty text."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.tokenizer(path)
        for b in batches:
            rows = [x or [] for x in b.column(column).to_pylist()]
            flat = np.fromiter((t for r in rows for t in r), np.int64)
            text = model.decode(flat, np.fromiter(map(len, rows), np.int64, len(rows)))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(text, pa.string())], [key, "text"])

    return df.select(key, column).mapInArrow(run, schema)


@op_query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
