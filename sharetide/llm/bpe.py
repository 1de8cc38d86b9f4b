"""Byte-pair encoding of many words at once: speculate, verify, and merge only where that fails.

A greedy longest match proposes the tokens of a word.  A token sequence is the result of the merge
rules exactly if every two neighbours, taken alone, are what the merge rules make of their joined text.
So all neighbouring pairs of all new words are tested together against a table of pairs judged so far;
a pair not met before is judged once, by merging its text.  Only words with a failing pair are merged
step by step.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import regex

from sharetide.llm.textmath import _BASE, _BYTE, _INVERSE, _power, mix, ragged

END = b"\xff"  # marks the end of a word in vocabularies with word ends; never a byte of UTF-8
NONE = 1 << 30
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
CACHED_WORDS, CACHED_PAIRS = 1 << 19, 1 << 20  # both caches start again when full; no result depends on them


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


class Bpe:
    """Vocabulary and merges of one tokenizer file, with bounded caches of words and pairs."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        suffix = model.get("end_of_word_suffix") or ""
        self.ends = bool(suffix)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.specials = regex.compile("|".join(map(regex.escape, special))) if special else None

        def as_bytes(token: str) -> bytes:
            stem = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
            return bytes(alphabet[c] for c in stem) + (END if stem is not token else b"")

        self.vocab = {as_bytes(t): i for t, i in model["vocab"].items() if t not in special}
        self.text = [b""] * (1 + max(*model["vocab"].values(), *special.values()))
        for t, i in self.vocab.items():
            self.text[i] = t
        for t, i in special.items():
            self.text[i] = t.encode()
        self.longest = max(map(len, self.vocab))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a.removesuffix(END) + b])
        rules = sorted((a << 20 | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.rule_key, self.rule_rank, self.rule_new = (np.array(x, np.int64) for x in zip(*rules))
        self.byte_id = np.array([self.vocab.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.byte_end_id = np.array([self.vocab.get(bytes([b]) + END, -1) for b in range(256)], np.int32)
        tokens = [(self._token_key(t), i) for t, i in self.vocab.items()]
        self.token_key, self.token_id = (np.array(x, d) for x, d in zip(zip(*sorted(tokens)), (np.uint64, np.int32)))
        self.token_seen = np.zeros(1 << 20, bool)
        self.token_seen[self.token_key >> np.uint64(44)] = True
        self.bytes_of = np.frombuffer(b"".join(self.text), np.uint8)
        self.bytes_len = np.fromiter(map(len, self.text), np.int64, len(self.text))
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        self._forget_words()
        self._forget_pairs()

    @staticmethod
    def _token_key(token: bytes) -> int:
        data = np.frombuffer(token, np.uint8)
        return int((_BYTE[data] * _power(_BASE, len(data))).sum(dtype=np.uint64))

    def _forget_words(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _forget_pairs(self) -> None:
        self.pairs, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """The merge rules applied to many words side by side, one merge in each word at a time."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 8), (8, 16), (16, 32)):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(chosen):
                for i, ids in zip(chosen.tolist(), self._merge_block([words[i] for i in chosen.tolist()], high)):
                    out[i] = ids
        for i in np.flatnonzero(sizes > 32).tolist():
            out[i] = self.merge_long(words[i])
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; the rank is NONE where no rule applies."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.rule_key, key), len(self.rule_key) - 1)
        hit = (self.rule_key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rule_rank[at], NONE).astype(np.int32), self.rule_new[at]

    def _merge_block(self, words: list[bytes], width: int) -> list[list[int]]:
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, words), np.int64, n)
        ids = np.where(np.arange(width) < size[:, None], self.byte_id[raw], -1).astype(np.int32)
        if self.ends:
            marked = np.flatnonzero(raw[np.arange(n), size - 1] == END[0])
            ids[marked, size[marked] - 2] = self.byte_end_id[raw[marked, size[marked] - 2]]
            ids[marked, size[marked] - 1] = -1
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1], _ = self._rank(ids[:, :-1], ids[:, 1:])
        done: list[list[int]] = [[] for _ in words]
        row, cols = np.arange(n), np.arange(width)
        while len(row):
            col = rank.argmin(1)
            here = np.arange(len(row))
            stop = rank[here, col] == NONE
            if stop.any():
                for r, x in zip(row[stop].tolist(), ids[stop].tolist()):
                    done[r] = [t for t in x if t >= 0]
                row, ids, rank, col = row[~stop], ids[~stop], rank[~stop], col[~stop]
                here = np.arange(len(row))
                if not len(row):
                    break
            _, new = self._rank(ids[here, col], ids[here, col + 1])
            later = cols > col[:, None]
            ids = np.where(later, np.pad(ids[:, 1:], ((0, 0), (0, 1)), constant_values=-1), ids)
            rank = np.where(later, np.pad(rank[:, 1:], ((0, 0), (0, 1)), constant_values=NONE), rank)
            ids[here, col] = new
            left, right = np.maximum(col - 1, 0), np.minimum(col + 1, width - 1)
            rank[here, col], _ = self._rank(new, np.where(col + 1 < width, ids[here, right], -1))
            before, _ = self._rank(np.where(col > 0, ids[here, left], -1), new)
            rank[here, left] = np.where(col > 0, before, rank[here, left])
        return done

    def merge_long(self, word: bytes) -> list[int]:
        """The merge rules applied to one long word: a heap of pairs over a linked list."""
        import heapq

        stop = len(word) - 1 if self.ends and word.endswith(END) else len(word)
        ids = [self.vocab[word[i : i + 1]] for i in range(stop)]
        if stop < len(word):
            ids[-1] = self.vocab[word[stop - 1 :]]
        after, before = list(range(1, len(ids))) + [-1], list(range(-1, len(ids) - 1))
        heap = [(m[0], i, p, m[1]) for i, p in enumerate(zip(ids, ids[1:])) if (m := self.merges.get(p))]
        heapq.heapify(heap)
        while heap:
            _, i, pair, new = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := self.merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, (ids[a], ids[b]), m[1]))
        return [x for x in ids if x >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Longest match from the left; empty if it gets stuck."""
        vocab, longest, n, i, out = self.vocab, self.longest, len(word), 0, []
        barred = n - 1 if self.ends else -1  # the end mark can't stand alone
        while i < n:
            for j in range(min(n, i + longest), i, -1):
                if j != barred and (t := vocab.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return []
        return out

    def propose_all(self, words: list[bytes]) -> list[list[int]]:
        """Longest match from the left for many words side by side."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 8), (8, 16), (16, 32)):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(chosen):
                for i, ids in zip(chosen.tolist(), self._propose_block([words[i] for i in chosen.tolist()], high)):
                    out[i] = ids
        for i in np.flatnonzero(sizes > 32).tolist():
            out[i] = self.propose(words[i])
        return out

    def _propose_block(self, words: list[bytes], width: int) -> list[list[int]]:
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, words), np.int64, n)
        total = np.zeros((n, width + 1), np.uint64)
        np.cumsum(_BYTE[raw] * _power(_BASE, width), axis=1, out=total[:, 1:])
        back = _power(_INVERSE, width + 1)
        ids, row, at, step = np.full((n, width), -1, np.int32), np.arange(n), np.zeros(n, np.int64), 0
        stuck = np.zeros(n, bool)
        while len(row):
            open_, reach = np.arange(len(row)), np.zeros(len(row), np.int64)
            rest = size[row] - at
            for length in range(int(rest.max()), 0, -1):
                try_ = open_[rest[open_] >= length]
                if self.ends and len(try_):  # the end mark can't stand alone
                    try_ = try_[rest[try_] != length + 1]
                if not len(try_):
                    continue
                r, i = row[try_], at[try_]
                key = (total[r, i + length] - total[r, i]) * back[i]
                maybe = self.token_seen[key >> np.uint64(44)]
                try_, key = try_[maybe], key[maybe]
                where = np.minimum(np.searchsorted(self.token_key, key), len(self.token_key) - 1)
                hit = self.token_key[where] == key
                found = try_[hit]
                ids[row[found], step], reach[found] = self.token_id[where[hit]], length
                open_ = open_[reach[open_] == 0]
                if not len(open_):
                    break
            stuck[row[open_]] = True
            at = at + reach
            go = (reach > 0) & (at < size[row])
            row, at, step = row[go], at[go], step + 1
        return [[] if s else [t for t in x if t >= 0] for s, x in zip(stuck.tolist(), ids.tolist())]

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (left id << 20 | right id) is what merging makes of its own text."""
        asked, where = np.unique(pairs, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, asked), max(len(self.pairs) - 1, 0))
        new = asked[self.pairs[at] != asked] if len(self.pairs) else asked
        if len(new):
            alone = [(p >> 20, p & 0xFFFFF) for p in new.tolist()]
            merged_alone = self.merge_all([self.text[a] + self.text[b] for a, b in alone])
            verdict = np.fromiter((m == [a, b] for m, (a, b) in zip(merged_alone, alone)), bool, len(new))
            if len(self.pairs) + len(new) > CACHED_PAIRS:
                self._forget_pairs()
                return self.compatible(pairs)
            order = np.argsort(merged := np.concatenate((self.pairs, new)), kind="stable")
            self.pairs, self.pair_ok = merged[order], np.concatenate((self.pair_ok, verdict))[order]
        return self.pair_ok[np.searchsorted(self.pairs, asked)][where]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and their number by word."""
        found = self.propose_all(words)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        joined = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        bad = counts == 0
        if len(joined):
            bad[owner[joined[~self.compatible(flat[joined] << 20 | flat[joined + 1])]]] = True
        if bad.any():
            failed = np.flatnonzero(bad).tolist()
            for i, ids in zip(failed, self.merge_all([words[i] for i in failed])):
                found[i] = ids
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((t for f in found for t in f), np.int64, int(counts.sum()))
        return flat.astype(np.int32), counts

    def encode(self, text: str, points: np.ndarray, start: np.ndarray, end: np.ndarray, point_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words text[start:end], all in a row, and their number by word."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(point_hash * _power(_BASE, len(points)), out=total[1:])
        keys, first, which = np.unique(mix((total[end] - total[start]) * _power(_INVERSE, len(points))[start]), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(self.keys) + len(new) > CACHED_WORDS and len(self.keys):
            self._forget_words()
            new = np.arange(len(keys))
        if len(new):
            tail = END if self.ends else b""
            a, b = start[first[new]].tolist(), end[first[new]].tolist()
            flat, counts = self.encode_words([text[x:y].encode() + tail for x, y in zip(a, b)])
            self.at = np.concatenate((self.at, len(self.pool) + np.cumsum(counts) - counts))
            self.length, self.pool = np.concatenate((self.length, counts)), np.concatenate((self.pool, flat))
            merged = np.concatenate((self.keys, keys[new]))
            order = np.argsort(merged, kind="stable")
            self.slots = np.concatenate((self.slots, np.arange(len(self.at) - len(new), len(self.at))))[order]
            self.keys = merged[order]
        slot = self.slots[np.searchsorted(self.keys, keys)][which]
        return self.pool[ragged(self.at[slot], self.length[slot])], self.length[slot]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Text of each run of ids: counts[0] of them, then counts[1], ..."""
        size = self.bytes_len[ids]
        data = self.bytes_of[ragged(self.bytes_at[ids], size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(counts)].tolist() if len(counts) else []
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Bpe:
    """One per Python worker."""
    return Bpe(path)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def point_hashes(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(1)) | np.uint64(1)


def contractions(points: np.ndarray, apostrophe: np.ndarray) -> np.ndarray:
    """Length of 's 't 're 've 'm 'll 'd at each given apostrophe, 0 if there is none."""
    padded = np.concatenate((points, np.zeros(2, np.uint32)))
    one, two = padded[apostrophe + 1], padded[apostrophe + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    return np.where(short, 2, np.where(long, 3, 0))
