"""Deduplication of repeated passages with sparse suffix arrays (operator 10).

Only suffixes that start at content-selected minimisers are kept.  They are dealt out by their seed, so
suffixes with a common beginning meet, sorted there by their words, and each is compared with its
neighbour.  The common lengths of neighbours divide the sorted suffixes into intervals that share r words to
the right of the seed, for every r; within an interval, rows that also agree in the words to the left
make up the copies of a passage of ``min_words`` words.  This finds every repeat of that length.

The first copy, by id and position, stays; the words of all others go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.llm.common import op_query, table
from sharetide.llm.op03_substring import keyed, merged_spans, without
from sharetide.llm.seeds import HOT_SEED, first_words, member_filter, select, shared_seeds
from sharetide.llm.textmath import mix, pieces, windows_of, words_of
from sharetide.session import stage

GRAM = 20
HELD = 40_000  # suffixes compared at a time where seeds end
SUFFIX, WINDOW, DECIDED = 0, 1, 2
_SENT = "route bigint, kind int, suffix binary, before binary, rank bigint, row_key bigint, at int, room int, left_room int"
_COLUMNS = [c.split()[0] for c in _SENT.split(", ")]


def _binary(matrix: np.ndarray) -> pa.Array:
    """One binary value a row; big-endian words, so that binary order is the order of words."""
    width = matrix.shape[1] * 4
    at = (np.arange(len(matrix) + 1) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(at), pa.py_buffer(matrix.astype(">u4").tobytes())])


def _words32(column: pa.Array, width: int) -> np.ndarray:
    data = np.frombuffer(column.buffers()[2] or b"", ">u4").astype(np.uint32) if len(column) else np.zeros(0, np.uint32)
    offset = column.buffers()[1]
    first = np.frombuffer(offset, np.int32)[column.offset] // 4 if len(column) else 0
    return data[first : first + len(column) * width].reshape(len(column), width)


def _copies(key: np.ndarray, rank: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows repeat an earlier one of the same key (by rank, row, position), and the index of the first."""
    order = np.lexsort((at, row, rank, key))
    k = key[order]
    start = first_words(k)
    lead = np.repeat(order[start], np.diff(np.append(start, len(k))))
    first = np.empty(len(key), np.int64)
    first[order] = lead
    return (row != row[first]) | (at != at[first]), first


def passages(docs: DataFrame, min_words: int = 50, column: str = "text", rank: str = "rank") -> DataFrame:
    """``row_key``, ``a``, ``b``, ``first_id``: words a..b-1 repeat a passage of row ``first_id`` or of one before it."""
    reach = min_words - GRAM + 1
    left = reach - 1
    seeds = shared_seeds(docs, column, GRAM, reach)
    shared, hot = member_filter(seeds), member_filter(seeds.where(F.col("n") >= HOT_SEED))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, column):
            w = words_of(b.column(column), False)
            s = select(w, GRAM, reach)
            at = s.chosen[shared(s.grams[s.chosen])]
            if not len(at):
                continue
            doc = np.searchsorted(w.first, at, side="right") - 1
            ranks, rows = b.column(rank).to_numpy(), b.column("row_key").to_numpy()
            seed, frequent = s.grams[at], hot(s.grams[at])
            if (~frequent).any():
                p, d = at[~frequent], doc[~frequent]
                room, left_room = w.first[d + 1] - p, p - w.first[d]
                word = np.concatenate((np.zeros(left, np.uint32), (w.hash & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.zeros(min_words, np.uint32)))
                right_ = word[p[:, None] + left + np.arange(min_words)]
                right_[np.arange(min_words) >= room[:, None]] = 0
                before = word[p[:, None] + left - 1 - np.arange(left)]
                before[np.arange(left) >= left_room[:, None]] = 0
                # A seed met with all its surroundings in this batch is decided here; the first one is sent on.
                full = (room >= min_words) & (left_room >= left)
                around = np.where(full, mix(windows_of(w.hash, min_words)[np.minimum(p, max(len(w.hash) - min_words, 0))] + mix(windows_of(w.hash, min_words)[np.maximum(p - left, 0)])), mix(np.arange(len(p), dtype=np.uint64)))
                again, first = _copies(around, ranks[d], rows[d], p - w.first[d])
                again &= full
                go = ~again
                yield self_rows(seed[~frequent][go], SUFFIX, right_[go], before[go], ranks[d[go]], rows[d[go]], (p - w.first[d])[go], room[go], left_room[go])
                if again.any():
                    yield plain_rows(rows[d[again]], DECIDED, ranks[d[first[again]]], rows[d[again]], (p - w.first[d])[again] - left, np.full(int(again.sum()), left + min_words))
            if frequent.any():
                stretch = np.flatnonzero(hot(s.least))
                p, d = s.at[stretch], s.doc[stretch]
                key = windows_of(w.hash, min_words)[p]
                again, first = _copies(key, ranks[d], rows[d], p - w.first[d])
                yield plain_rows(key[~again].view(np.int64), WINDOW, ranks[d[~again]], rows[d[~again]], (p - w.first[d])[~again], np.full(int((~again).sum()), min_words))
                if again.any():
                    yield plain_rows(rows[d[again]], DECIDED, ranks[d[first[again]]], rows[d[again]], (p - w.first[d])[again], np.full(int(again.sum()), min_words))

    def self_rows(route, kind, right_, before, rank_, row, at, room, left_room) -> pa.RecordBatch:
        n = len(route)
        return pa.RecordBatch.from_arrays(
            [pa.array(route.view(np.int64)), pa.array(np.full(n, kind, np.int32)), _binary(right_), _binary(before), pa.array(rank_), pa.array(row), pa.array(at.astype(np.int32)), pa.array(np.minimum(room, min_words).astype(np.int32)), pa.array(np.minimum(left_room, left).astype(np.int32))], _COLUMNS
        )

    def plain_rows(route, kind, rank_, row, at, room) -> pa.RecordBatch:
        n = len(route)
        return pa.RecordBatch.from_arrays(
            [pa.array(route), pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(rank_), pa.array(row), pa.array(at.astype(np.int32)), pa.array(room.astype(np.int32)), pa.array(np.zeros(n, np.int32))], _COLUMNS
        )

    def whole_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= HELD:
                route = held["route"].to_numpy()
                cut = int(np.searchsorted(route, route[-1]))
                if cut:
                    yield held.slice(0, cut)
                    held = pa.concat_tables([held.slice(cut)]).combine_chunks()
        if held is not None and held.num_rows:
            yield held

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_routes(batches):
            kind = t["kind"].to_numpy()
            found = []
            decided = t.filter(pa.array(kind == DECIDED))
            if decided.num_rows:
                a = decided["at"].to_numpy().astype(np.int64)
                found.append((decided["row_key"].to_numpy(), a, a + decided["room"].to_numpy(), decided["rank"].to_numpy()))
            single = t.filter(pa.array(kind == WINDOW))
            if single.num_rows:
                row, a, r = single["row_key"].to_numpy(), single["at"].to_numpy().astype(np.int64), single["rank"].to_numpy()
                again, first = _copies(single["route"].to_numpy(), r, row, a)
                found.append((row[again], a[again], a[again] + min_words, r[first[again]]))
            suffixes = t.filter(pa.array(kind == SUFFIX)).combine_chunks()
            if suffixes.num_rows > 1:
                found += neighbours(suffixes)
            for row, a, b_, first_id in found:
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(a.astype(np.int32)), pa.array(b_.astype(np.int32)), pa.array(first_id)], ["row_key", "a", "b", "first_id"])

    def neighbours(t: pa.Table) -> list[tuple]:
        route = t["route"].to_numpy()
        right_ = _words32(t["suffix"].combine_chunks() if isinstance(t["suffix"], pa.ChunkedArray) else t["suffix"], min_words)
        before = _words32(t["before"].combine_chunks() if isinstance(t["before"], pa.ChunkedArray) else t["before"], left)
        r, row, at = t["rank"].to_numpy(), t["row_key"].to_numpy(), t["at"].to_numpy().astype(np.int64)
        room, left_room = t["room"].to_numpy(), t["left_room"].to_numpy()
        differ = right_[1:] != right_[:-1]
        common = np.where(differ.any(1), differ.argmax(1), min_words)
        common[route[1:] != route[:-1]] = 0
        behind = np.zeros((len(row), left + 1), np.uint64)  # hash of the o words left of the seed, for each o
        for o in range(left):
            behind[:, o + 1] = mix(behind[:, o] + before[:, o].astype(np.uint64) + np.uint64(o + 1))
        hit, lead = np.zeros((len(row), left + 1), bool), np.zeros((len(row), left + 1), np.int64)
        for o in range(left + 1):
            interval = np.concatenate(([0], np.cumsum(common < min_words - o))).astype(np.uint64)
            fits = np.flatnonzero((left_room >= o) & (room >= min_words - o))
            if len(fits) > 1:
                again, first = _copies(mix(interval[fits]) + behind[fits, o], r[fits], row[fits], at[fits])
                hit[fits, o], lead[fits, o] = again, fits[first]
        # Offsets in a row that are hit one after the other make one stretch of words.
        padded = np.zeros((len(row), left + 3), np.int8)
        padded[:, 1:-1] = hit
        i, on = np.nonzero(np.diff(padded, axis=1) == 1)
        _, off = np.nonzero(np.diff(padded, axis=1) == -1)
        if not len(i):
            return []
        return [(row[i], at[i] - (off - 1), at[i] - on + min_words, r[lead[i, on]])]

    dealt = docs.select("row_key", rank, column).mapInArrow(sample, _SENT).repartition("route").sortWithinPartitions("route", "suffix")
    return dealt.mapInArrow(compare, "row_key bigint, a int, b int, first_id bigint")


def dedup(docs: DataFrame, min_words: int = 50, key: str = "doc_id", column: str = "text", merge: bool = False) -> DataFrame:
    """``docs`` with repeats cut out of its text, and ``n_words``, ``n_removed``, ``spans``, ``first_ids``.

    ``key`` must be an integer; null keys come last in the order of copies.  Null texts stay null.  Rows equal in key
    and text count as one and share their fate.  Texts without a repeat stay as they are, byte for byte; columns
    named like the added ones are replaced.  An empty table gives an empty table.  ``merge`` as in :func:`without`.
    """
    added = ("row_key", "rank", "n_words", "n_removed", "spans", "first_ids")
    rows = keyed(docs.drop(*added), key, column).withColumn("rank", F.coalesce(F.col(key).cast("bigint"), F.lit(2**63 - 1)))
    found = stage(passages(rows, min_words, column), "passages")
    spans = stage(merged_spans(found).join(found.groupBy("row_key").agg(F.sort_array(F.collect_set("first_id")).alias("first_ids")), "row_key"), "spans")
    return without(rows.drop("rank"), spans, column, as_words=False, keep=("spans", "first_ids"), merge=merge).drop("row_key")


@op_query("op10_suffix_array")
def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", "spans", "first_ids", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
