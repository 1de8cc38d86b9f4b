"""Operator 12 against a plain version."""

import collections
import random
import re
import zlib

import numpy as np
from small import SMALL

from sharetide.llm import op12_variants as op
from sharetide.llm.registry import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def counted(rows, modulus=97):
    out = collections.Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'null' if key is None else key}:{w}".encode())
            if h % modulus == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return out


def edits(w, letters):
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    out = {a + b[1:] for a, b in cuts if b}
    out |= {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
    return out - {w}


def plain(counts, least=3, length=5):
    words = {w: n for w, n in counts.items() if n >= least and len(w) >= length}
    letters, near, form = sorted({c for w in words for c in w}), {}, {}
    for w in words:
        near[w] = [v for v in edits(w, letters) if v in words]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def test_query_equals_the_plain_version(llm, texts):
    assert rows_of(QUERIES["op12_variants"](llm, SMALL)) == plain(counted(texts))


def dense(seed, n=900):
    """Few letters, so that nearly every word has near words, in counts that tie."""
    r = random.Random(seed)
    words = {"".join(r.choice("abÀ") for _ in range(r.randrange(1, 9))) for _ in range(n)} | {"a" * k for k in range(1, 40)} | {"b" + "a" * 3000, "b" + "a" * 3001}
    return [(w, r.randrange(1, 5) * 2 ** r.randrange(6)) for w in sorted(words)]


def test_groups_in_many_blocks_give_the_same(llm, monkeypatch):
    rows = dense(1)
    for block in (op.BLOCK, 7):
        found = {r.word: (r.n_near, r.best, r.best_n) for r in op.near_words(llm.createDataFrame(rows, "word string, n bigint"), block).collect()}
        counts = dict(rows)
        for w, n in counts.items():
            near = [v for v in edits(w, "abÀ") if v in counts]
            best = min(near, key=lambda v: (-counts[v], v), default=None)
            assert found.get(w, (0, None, None)) == (len(near), best, counts.get(best))


def test_tiles_compare_prefix_and_suffix():
    words = ["abcde", "abcdf", "abcdef", "bcde", "xbcde", "abde"]
    m = op.Matrix(words)
    linked, prefix = op.near(m, np.array([0]), np.array([1, 3, 4, 5, 0]))
    assert linked.tolist() == [[True, True, True, True, False]] and prefix.tolist() == [[4, 0, 0, 2, 5]]


def test_nulls_repeats_other_columns_and_empty_tables(llm):
    rows = [(1, "hello hello hallo é×÷ñdé é×÷ñdé É×÷ñdé", "x", 1), (1, "hello hello hallo", "y", 2), (None, "Hello hallo é×÷ñdé", "z", 3), (2, None, "w", 4), (3, "", "v", 5), (4, "hello " * 9, "u", 6)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, word string, n bigint")
    assert rows_of(op.variants(docs)) == plain(counted([(k, t) for k, t, *_ in rows]))
    assert op.variants(docs.where("false")).count() == 0
    assert op.variants(docs.where("doc_id = 2")).count() == 0


def test_long_chains_end_at_the_last_form(llm):
    words = [("a" * k, 2 ** (30 - k)) for k in range(5, 25)]
    counts = llm.createDataFrame(words, "word string, n bigint")
    found = op.near_words(counts)
    assert {r.word: r.best for r in found.collect()} == {"a" * k: "a" * max(5, k - 1) if k > 5 else "a" * 6 for k in range(5, 25)}
    texts = [(1, " ".join(" ".join([w] * 2 ** (8 - i)) for i, (w, _) in enumerate(words[:8])))]
    docs = llm.createDataFrame(texts, "doc_id bigint, text string")
    assert rows_of(op.variants(docs, modulus=1 << 40, least_count=1)) == plain(counted(texts, 1 << 40), 1)
