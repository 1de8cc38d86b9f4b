"""Alignment of two tokenizers' tokens on the same bytes (operator 13).

Both tokenizers' cumulative ends go into dictionaries from end to index.  The intersection of their keys, sorted, holds the
offsets where both have a token's end; these cut both lists of ids into groups, the least pieces that cover the same bytes.
Within a group every token of one side is linked with every token of the other.

Counts of linked pairs over the corpus are gathered from the stored alignment.  The commonest pairs' counts go to all tasks in a table
of fixed size; what a document links besides is joined.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, count
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.llm import bpe
from sharetide.llm.common import op_query, public_tokenizer, table
from sharetide.llm.op07_bpe import pretokens
from sharetide.llm.textmath import pieces, ragged
from sharetide.session import fresh_path

KNOWN = 1 << 20  # pairs whose counts go to all tasks (17 MB)
LINKS = 1 << 20  # links expanded at a time
ID_BITS = 16  # ids of either side lie below 2**16
PIECE = 1 << 20  # bytes of text aligned at a time
CACHED, SHORT = 1 << 17, 64  # stretches of at most so many characters are kept, those used last; no result depends on it
STRETCH = re.compile(r"(?<=\S) (?=\S)")
TOGETHER = 12  # stretches given to the piece tokenizer as one text; its time grows faster than a text's length
LONG_GAP = re.compile(r"\s{1000}")


def byte_ranks(path: str) -> dict[bytes, int]:
    """Bytes and ids of a byte-level vocabulary whose ids are in order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, special = bpe.byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
    ids = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    made = [ids[b"".join(bytes(alphabet[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("the vocabulary's ids are not in the order of its merges")
    return ids


class Pair:
    """Both tokenizers, and what their alignment makes of a stretch of text.

    A single space between two characters that are no white space begins a token on either side, so texts are cut there and
    each distinct stretch is aligned once.
    """

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.path, ranks = byte_path, byte_ranks(byte_path)
        self.a_model = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_size = {i: len(t) for t, i in ranks.items()}
        self.b_model = model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if max(len(names), 1 + max(ranks.values())) > 1 << ID_BITS:
            raise ValueError("a vocabulary has more than 65,536 ids")
        if any("▁" in p.lstrip("▁") for p in names) or len(model.encode("a b")) != 2 * len(model.encode("a")):
            raise ValueError("a piece reaches over the space before a word")
        self.b_text = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def byte_ids(self, text: str) -> list[int]:
        """Ids of side A; special tokens' strings are plain text."""
        if LONG_GAP.search(text):  # deeper than the library's pattern matching goes
            return _plain_byte_ids(text, self.path)
        return self.a_model.encode_ordinary(text)

    def align(self, stretches: list[str]) -> dict[str, tuple | None]:
        """The ids and the ends of groups of both sides, packed, of each stretch; None if the pieces do not give it back."""
        plain = [x for x in stretches if "▁" not in x and not x[0].isspace() and not x[-1].isspace()]
        found = self._together(plain) if plain else {}
        for x in stretches:
            if x not in found:
                found[x] = self._tokens([x])[0]
        return found

    def _tokens(self, stretches: list[str]) -> tuple[tuple | None, dict[int, int], dict[int, int]]:
        """The alignment of stretches in a row, and their tokens by their ends."""
        text, some = " ".join(stretches), range(0, len(stretches), TOGETHER)
        a = self.byte_ids(" " + text)
        b = list(chain.from_iterable(self.b_model.encode([" ".join(stretches[i : i + TOGETHER]) for i in some], num_threads=1)))
        b_text = list(map(self.b_text.__getitem__, b))
        if b"".join(b_text) != b" " + text.encode():
            return None, {}, {}
        one, two = (dict(zip(accumulate(sizes), count(1))) for sizes in (map(self.a_size.__getitem__, a), map(len, b_text)))
        return (array("H", a).tobytes(), array("H", b).tobytes(), *shared_ends(one, two)), one, two

    def _together(self, stretches: list[str]) -> dict[str, tuple]:
        """Stretches aligned as one text, in which each begins with a token of either side."""
        row, one, two = self._tokens(stretches)
        borders = list(accumulate(len(x.encode()) + 1 for x in stretches))
        if row is None or not (one.keys() >= set(borders) <= two.keys()):
            return {}
        x, y = ([0, *map(side.__getitem__, borders)] for side in (one, two))
        a, b, a_ends, b_ends = row
        return {s: (a[2 * i : 2 * j], b[2 * k : 2 * n], a_ends[i:j], b_ends[k:n]) for s, i, j, k, n in zip(stretches, x, x[1:], y, y[1:])}

    def rows(self, texts: list[str]) -> Iterator[tuple[bytes, ...]]:
        """The aligned ids and ends of whole texts; four empty strings for an empty text and one that is not given back."""
        cut = [STRETCH.split(t) if t else [] for t in texts]
        every = set().union(*cut)
        again = (every & self.older.keys()) - self.known.keys()
        self.known.update((x, self.older[x]) for x in again)
        found = {x: self.known[x] for x in every & self.known.keys()}
        fresh = self.align(list(every - found.keys()))
        self.known.update((k, v) for k, v in fresh.items() if len(k) <= SHORT)
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        found.update(fresh)
        for parts in cut:
            held = list(map(found.__getitem__, parts))
            yield (b"",) * 4 if not held or None in held else tuple(b"".join(map(itemgetter(i), held)) for i in range(4))


@functools.lru_cache(maxsize=1)
def tokenizer_pair(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def _plain_byte_ids(text: str, path: str) -> list[int]:
    points = bpe.code_points(text)
    start, end = pretokens(points, np.array([0, len(text)]))
    return bpe.tokenizer(path).encode(text, points, start, end, bpe.point_hashes(points))[0].tolist()


def shared_ends(one: dict[int, int], two: dict[int, int]) -> tuple[bytes, bytes]:
    """By token, 1 where it ends where one of the other side does; given by side as end and number of each token, from 1."""
    shared = sorted(one.keys() & two.keys())
    marks = []
    for side in (one, two):
        mark = np.zeros(len(side) + 1, np.uint8)
        mark[np.fromiter(map(side.__getitem__, shared), np.int64, len(shared))] = 1
        marks.append(mark[1:].tobytes())
    return marks[0], marks[1]


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key``, ``a_ids`` and ``b_ids`` (little-endian unsigned 16-bit), ``a_ends`` and ``b_ends`` (a byte for each token, 1 where
    its group ends).

    Side A is the byte-level tokenizer on a space and the text, side B the piece tokenizer on the text, which adds the space
    itself; neither may have more than 65,536 ids.  Null and empty texts have no tokens; nor have texts that the tokens of either
    side do not give back byte for byte.  Every row gives one row, other columns are left behind.
    """
    names = ("a_ids", "b_ids", "a_ends", "b_ends")
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} binary" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(byte_path, piece_path)
        for batch in pieces(batches, column, PIECE):
            rows = pair.rows([t or "" for t in batch.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(x, pa.binary()) for x in zip(*rows)]], [key, *names])

    return docs.select(key, column).mapInArrow(run, schema)


class Aligned:
    """A batch of aligned rows as flat arrays: ids, and by group its document and its number of tokens on either side."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.n = batch.num_rows
        (self.a, self.n_a), (self.b, self.n_b) = (_flat(batch.column(c), "<u2") for c in ("a_ids", "b_ids"))
        a_end, b_end = (np.flatnonzero(_flat(batch.column(c), "u1")[0]) for c in ("a_ends", "b_ends"))
        self.p, self.q = np.diff(a_end, prepend=-1), np.diff(b_end, prepend=-1)
        self.doc = np.searchsorted(np.cumsum(self.n_a), a_end, side="right")
        self.n_groups = np.bincount(self.doc, minlength=self.n).astype(np.int64)
        self.a_at, self.b_at = np.cumsum(self.p) - self.p, np.cumsum(self.q) - self.q

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Document and pair (a << ID_BITS | b) of all links, about ``LINKS`` at a time."""
        rows = np.repeat(np.arange(len(self.p)), self.p)  # the group of each token of A, which has q links
        upto = np.cumsum(self.q[rows])
        x = 0
        while x < len(rows):
            y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + LINKS, side="right")))
            group = rows[x:y]
            q = self.q[group]
            b = self.b[ragged(self.b_at[group], q)]
            yield np.repeat(self.doc[group], q), np.repeat(self.a[x:y], q) << ID_BITS | b
            x = y

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, pair), in order, and how many links each has."""
        code, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for doc, pair in self.links():
            found, n = np.unique(doc << 2 * ID_BITS | pair, return_counts=True)
            if not len(code) or code[-1] < found[0]:
                code, times = np.concatenate((code, found)), np.concatenate((times, n))
                continue
            code, back = np.unique(np.concatenate((code, found)), return_inverse=True)
            times = np.bincount(back, np.concatenate((times, n)), len(code)).astype(np.int64)
        return code >> 2 * ID_BITS, code & ((1 << 2 * ID_BITS) - 1), times

    def written(self) -> list[bytes]:
        """The groups of each document: ids joined by commas, the sides by a bar, groups by semicolons."""
        out = np.empty(len(self.a) + len(self.b), np.int64)
        width = self.p + self.q
        at = np.cumsum(width) - width
        out[ragged(at, self.p)] = self.a
        out[ragged(at + self.p, self.q)] = self.b
        out <<= 2
        out[at + self.p - 1] |= 1
        out[at + width - 1] |= 2
        upto = np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))
        out[upto[1:][np.diff(upto) > 0] - 1] |= 3
        letters, size = _written_ids()
        size = size[out]
        text = letters[out][np.arange(letters.shape[1]) < size[:, None]].tobytes()
        upto = np.concatenate(([0], np.cumsum(size)))[upto].tolist()
        return [text[x:y] for x, y in zip(upto, upto[1:])]


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed numbers, and how many each row has."""
    width = np.dtype(kind).itemsize
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind).astype(np.int64), np.diff(at) // width


@functools.lru_cache(maxsize=1)
def _written_ids() -> tuple[np.ndarray, np.ndarray]:
    """Padded bytes and their number of all id << 2 | what follows the id: a comma, a bar, a semicolon, nothing."""
    text = [f"{i}{mark}".encode() for i in range(1 << ID_BITS) for mark in (",", "|", ";", "")]
    size = np.fromiter(map(len, text), np.int64, len(text))
    return np.array(text, "S").view(np.uint8).reshape(len(text), -1), size


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``c``: the number of documents (rows) that have the pair linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, n = np.unique(Aligned(b).pairs()[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "c"])

    return aligned.select("a_ids", "b_ids", "a_ends", "b_ends").mapInArrow(run, "pair bigint, c bigint").groupBy("pair").agg(F.sum("c").alias("c"))


def _stored(df: DataFrame, label: str) -> DataFrame:
    """As ``stage``, with closer compression: ids are most of what this operator stores."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alignment_report(aligned: DataFrame, key: str = "doc_id", known: int = KNOWN) -> DataFrame:
    """Per row of ``aligned`` (stored, with a unique long ``uid``): ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``
    and ``groups_sha256``.

    A pair's count is the number of rows that have it linked; ``n_best`` counts links whose pair has the highest count of all pairs of
    its A id, ties included, ``count_sum`` adds the counts of all links.  Rows without tokens have zeros and an empty hash.
    ``known`` bounds the counts sent to all tasks; others are joined.
    """
    spark = aligned.sparkSession
    counts = _stored(pair_counts(aligned), "pairs")
    a_id = F.shiftright("pair", ID_BITS)
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("c").alias("highest"))
    flagged = counts.withColumn("a", a_id).join(highest, "a").select("pair", "c", (F.col("c") == F.col("highest")).alias("top"))
    flagged = _stored(flagged, "flagged")
    most = flagged.orderBy(F.desc("c"), "pair").limit(known).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast((most["pair"].to_numpy(), most["c"].to_numpy(), most["top"].to_numpy()))
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, c, top = shared.value
        for batch in batches:
            x = Aligned(batch)
            doc, pair, times = x.pairs()
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            here = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            total = lambda rows, w: np.bincount(doc[rows], w, x.n).astype(np.int64)  # noqa: E731 - exact below 2**53
            best = here.copy()
            best[here] = top[at[here]]
            own = (x.n_a, x.n_b, x.n_groups, total(slice(None), times), total(best, times[best]), total(here, times[here] * c[at[here]]))
            hashes = [hashlib.sha256(t).hexdigest() if t else "" for t in x.written()]
            uid, away = batch.column("uid").to_numpy(), np.flatnonzero(~here)
            m = len(away)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((uid, uid[doc[away]]))),
                    pa.concat_arrays([batch.column(key), pa.nulls(m, batch.column(key).type)]),
                    pa.array(np.concatenate((-1 - uid, pair[away]))),
                    pa.array(np.concatenate((np.zeros(x.n, np.int64), times[away]))),
                    *[pa.array(np.concatenate((v, np.zeros(m, np.int64)))) for v in own],
                    pa.array(hashes + [None] * m, pa.string()),
                ],
                ["uid", key, "pair", "times", *numbers, "groups_sha256"],
            )

    kind = aligned.schema[key].dataType.simpleString()
    schema = f"uid bigint, {key} {kind}, pair bigint, times bigint, {', '.join(f'{n} bigint' for n in numbers)}, groups_sha256 string"
    found = aligned.mapInArrow(run, schema).join(flagged, "pair", "left")
    more = {"n_best": F.when(F.col("top"), F.col("times")).otherwise(0), "count_sum": F.coalesce(F.col("c") * F.col("times"), F.lit(0))}
    sums = [F.sum(F.col(n) + more[n] if n in more else F.col(n)).alias(n) for n in numbers]
    return found.groupBy("uid").agg(F.max(key).alias(key), *sums, F.max("groups_sha256").alias("groups_sha256")).drop("uid")


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", column: str = "text", known: int = KNOWN) -> DataFrame:
    """The report on the alignment of all rows of ``docs``: one row per row, repeated and null keys included.

    Rows repeated in full count as rows of their own.  An empty table gives an empty table.
    """
    aligned = align(docs, byte_path, piece_path, key, column).withColumn("uid", F.monotonically_increasing_id())
    return alignment_report(_stored(aligned, "aligned"), key, known)


@op_query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
