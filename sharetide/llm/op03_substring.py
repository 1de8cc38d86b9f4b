"""Substring deduplication by seed and extend (operator 3).

1. Winnowed seeds are counted over all texts; those that occur once can't lie in a repeat.
2. Around each shared seed the passage is extended both ways, to all windows of ``min_words`` words that selected it.
   Documents are joined on the seed, and equal windows found among those that meet there.
3. Repeated windows that touch or overlap make up the maximal repeats, whose words are removed.

Windows met twice within one batch are decided on the spot, and only one of them is sent on.  Windows of a
very common seed are sent by their own hash, so no seed gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.llm.common import op_query, table
from sharetide.llm.seeds import HOT_SEED, first_words, joined_runs, member_filter, select, shared_seeds
from sharetide.llm.textmath import pieces, ragged, windows_of, words_of
from sharetide.session import stage

GRAM = 12
HELD = 1 << 20  # windows compared at a time where seeds end

_SENT = "route bigint, row_key bigint, start int, length int, hashes array<bigint>"


def _lists(values: np.ndarray, size: np.ndarray, some: np.ndarray) -> pa.Array:
    """List array with the runs of ``values``; null where ``some`` is false."""
    at = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64)), mask=pa.array(~some))


def repeats(docs: DataFrame, min_words: int = 35, column: str = "text", row_key: str = "row_key") -> DataFrame:
    """``row_key``, ``spans``: array of (start, end) in words, disjoint, in order, of repeated words."""
    reach = min_words - GRAM + 1
    seeds = shared_seeds(docs, column, GRAM, reach)
    shared, hot = member_filter(seeds), member_filter(seeds.where(F.col("n") >= HOT_SEED))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, column):
            w = words_of(b.column(column), False)
            s = select(w, GRAM, reach)
            near = np.flatnonzero(shared(s.least))
            if not len(near):
                continue
            seed, doc, at = s.least[near], s.doc[near], s.at[near]
            window = windows_of(w.hash, min_words)[at]
            at = at - w.first[doc]
            key = b.column(row_key).to_numpy()
            order = np.argsort(window, kind="stable")
            group = np.zeros(len(order), np.int64)
            group[first_words(window[order])] = 1
            group = np.cumsum(group) - 1
            twice = np.empty(len(order), bool)
            twice[order] = np.bincount(group)[group] > 1
            later = np.ones(len(order), bool)
            later[order[first_words(window[order])]] = False
            sent = np.flatnonzero(~later)
            route = np.where(hot(seed), window, seed)[sent]
            cut = np.flatnonzero(np.concatenate(([True], (route[1:] != route[:-1]) | (doc[sent][1:] != doc[sent][:-1]) | (at[sent][1:] != at[sent][:-1] + 1))))
            size = np.diff(np.append(cut, len(sent)))
            known = np.flatnonzero(twice)
            known_cut, known_size = joined_runs(doc[known], at[known])
            head = np.concatenate((sent[cut], known[known_cut]))
            some = np.arange(len(head)) < len(cut)
            row = key[doc[head]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((route[cut].view(np.int64), row[len(cut) :]))),
                    pa.array(row),
                    pa.array(at[head].astype(np.int32)),
                    pa.array(np.concatenate((size, known_size)).astype(np.int32)),
                    _lists(window[sent], np.concatenate((size, np.zeros(len(known_cut), np.int64))), some),
                ],
                ["route", "row_key", "start", "length", "hashes"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for route, row, start, length, values, some in _whole_routes(batches):
            size = np.where(some, length, 0)
            owner = np.repeat(np.arange(len(size)), size)
            at = ragged(start, size)
            order = np.argsort(values, kind="stable")
            group = np.zeros(len(order), np.int64)
            group[first_words(values[order])] = 1
            group = np.cumsum(group) - 1
            twice = np.empty(len(order), bool)
            twice[order] = np.bincount(group)[group] > 1 if len(order) else False
            hit = np.flatnonzero(twice)
            cut, n = joined_runs(owner[hit], at[hit])
            done = np.flatnonzero(~some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((row[done], row[owner[hit[cut]]]))),
                    pa.array(np.concatenate((start[done], at[hit[cut]])).astype(np.int32)),
                    pa.array(np.concatenate((start[done] + length[done], at[hit[cut]] + n)).astype(np.int32) + np.int32(min_words - 1)),
                ],
                ["row_key", "a", "b"],
            )

    runs = docs.select(row_key, column).mapInArrow(extend, _SENT)
    met = runs.repartition("route").sortWithinPartitions("route").mapInArrow(meet, "row_key bigint, a int, b int")
    return merged_spans(met)


def _whole_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as arrays, cut only where the route changes, so that all rows of a route come together."""
    held: list[tuple] = []
    size = 0

    def joined() -> tuple:
        return tuple(np.concatenate(x) for x in zip(*held))

    for b in batches:
        hashes = b.column("hashes")
        some = ~np.asarray(hashes.is_null())
        flat = hashes.flatten().to_numpy()
        part = (b.column("route").to_numpy(), b.column("row_key").to_numpy(), b.column("start").to_numpy().astype(np.int64), b.column("length").to_numpy().astype(np.int64), flat, some)
        held.append(part)
        size += len(flat) + len(some)
        if size >= HELD:
            route, row, start, length, values, some = joined()
            cut = int(np.searchsorted(route, route[-1]))  # the last route may go on
            if cut:
                inside = int(np.where(some[:cut], length[:cut], 0).sum())
                yield route[:cut], row[:cut], start[:cut], length[:cut], values[:inside], some[:cut]
                held = [(route[cut:], row[cut:], start[cut:], length[cut:], values[inside:], some[cut:])]
                size = len(held[0][4]) + len(held[0][5])
            else:
                held = [(route, row, start, length, values, some)]
    if held:
        yield joined()


def merged_spans(spans: DataFrame) -> DataFrame:
    """Per ``row_key``, its spans (a, b) united where they touch or overlap."""
    listed = spans.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("s"))
    reach = lambda s: F.element_at(s, -1)
    united = F.aggregate(
        "s",
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(reach(acc)["a"].alias("a"), F.greatest(reach(acc)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return listed.select("row_key", united.alias("spans"))


def keyed(docs: DataFrame, key: str, column: str) -> DataFrame:
    """``docs`` with ``row_key``, a hash of id and text: equal only for rows that are equal in both."""
    return docs.withColumn("row_key", F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(column, F.lit("")), F.lit(3)))


def without(docs: DataFrame, spans: DataFrame, column: str = "text", as_words: bool = True, keep: tuple[str, ...] = (), merge: bool = False) -> DataFrame:
    """``docs`` (with row_key) whose text has lost its ``spans``; with ``n_words`` and ``n_removed``.

    With ``as_words`` the words left are joined by one space; else texts without a span stay as they are
    and others lose the bytes from a span's first word to the word after it.  ``keep`` names columns of ``spans`` to
    carry along.  With ``merge`` texts and spans meet by one shuffle of both, however few spans there are.
    """
    joined = (docs.hint("merge") if merge else docs).join(spans.withColumn("flat", F.flatten(F.transform("spans", lambda s: F.array(s["a"], s["b"])))).select("row_key", "flat", *keep), "row_key", "left")
    fields = [f for f in joined.schema.fields if f.name not in (column, "flat", "n_words", "n_removed")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, column):
            w = words_of(b.column(column), False)
            flat = b.column("flat").to_pylist()
            gone = np.zeros(len(w.hash) + 1, np.int64)
            for i, spans_ in enumerate(flat):
                if spans_:
                    gone[w.first[i] + np.asarray(spans_[0::2])] += 1
                    gone[w.first[i] + np.asarray(spans_[1::2])] -= 1
            keep = np.cumsum(gone[:-1]) == 0
            removed = np.diff(np.concatenate(([0], np.cumsum(~keep)))[w.first])
            texts = b.column(column).to_pylist()
            out = []
            for i in range(b.num_rows):
                a, z = int(w.first[i]), int(w.first[i + 1])
                if not as_words and not removed[i]:
                    out.append(texts[i])
                    continue
                kept = keep[a:z]
                if as_words and kept.all():
                    out.append(b" ".join((w.data[w.start[a] : w.end[z - 1]].tobytes() if z > a else b"").split()).decode("utf-8", "replace"))
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], kept.astype(np.int8), [0]))))
                parts = [w.data[w.start[a + s] : w.end[a + e - 1]].tobytes() for s, e in zip(edge[::2], edge[1::2])]
                out.append(b" ".join(b" ".join(p.split()) if as_words else p for p in parts).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(out, pa.string()), pa.array(w.counts), pa.array(removed)], [*names, column, "n_words", "n_removed"])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, joined.schema[column], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, min_words: int = 35, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key``, ``text`` (the words left, joined by one space), ``n_words``, ``n_removed`` of every row.

    Null and empty texts have no words; rows repeated in full repeat each other; an empty table gives an empty
    table; other columns are left behind.  Every copy of a repeated passage goes, the first included.
    """
    rows = keyed(docs.select(key, column), key, column)
    return without(rows, stage(repeats(rows, min_words, column), "spans"), column, merge=True).drop("row_key")


@op_query("op3_substring")
def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
