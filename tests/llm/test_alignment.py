"""Operator 13 against the tokenizers' own libraries and a plain count."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import sentencepiece
from small import SMALL
from tokenizers import Tokenizer

from sharetide.llm import op13_alignment as op
from sharetide.llm.bpe import byte_alphabet
from sharetide.llm.common import public_tokenizer
from sharetide.llm.registry import QUERIES

BYTE, PIECE = public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(rows):
    one, two, back = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE), byte_alphabet()
    one.encode_special_tokens = True
    docs = []
    for key, text in rows:
        text = text or ""
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        a_bytes = [bytes(back[c] for c in one.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            a, b = [], []
        groups, i, j, x, y, gi, gj = [], 0, 0, 0, 0, 0, 0
        while i < len(a):
            if x <= y:
                x, i = x + len(a_bytes[i]), i + 1
            while y < x and j < len(b):
                y, j = y + len(b_bytes[j]), j + 1
            if x == y:
                groups.append((a[gi:i], b[gj:j]))
                gi, gj = i, j
        docs.append((key, a, b, groups))
    counts = collections.Counter(p for _, _, _, g in docs for p in {(m, n) for s, t in g for m in s for n in t})
    best = {}
    for (m, _), c in counts.items():
        best[m] = max(c, best.get(m, 0))
    out = []
    for key, a, b, groups in docs:
        links = [(m, n) for s, t in groups for m in s for n in t]
        text = ";".join(",".join(map(str, s)) + "|" + ",".join(map(str, t)) for s, t in groups)
        out.append((key, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def odd_texts():
    r = random.Random(5)
    bits = ["a", " ", "  ", "\n", "\t", "é", "漢字", "😀", "▁", "<|endoftext|>", "<s>", "<0x41>", "</s>", "don't", "12345", "　", "ﬁ", "‍", "\0", "Zürich", "   x", "ab" * 30, "́"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(1, 30)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " "), (503, "▁"), (None, "no key"), (504, "x" * 5000), (505, "same text"), (505, "same text"), (506, "\n" * 3000), (507, "word " * 30000)]
    return rows


def test_query_equals_the_plain_version(llm, texts):
    assert told(QUERIES["op13_alignment"](llm, SMALL)) == plain(texts)


def test_odd_texts_with_and_without_known_pairs(llm):
    rows = odd_texts()
    docs = llm.createDataFrame([(k, t, 1, "z") for k, t in rows], "doc_id bigint, text string, pair int, uid string").repartition(3)
    expected = plain(rows)
    for known in (op.KNOWN, 7, 0):
        assert told(op.align_tokenizers(docs, BYTE, PIECE, known=known)) == expected
    assert op.align_tokenizers(docs.where("false"), BYTE, PIECE).count() == 0


def test_groups_are_cut_where_both_sides_end():
    assert op.shared_ends({2: 1, 3: 2, 5: 3, 6: 4}, {1: 1, 3: 2, 4: 3, 5: 4, 6: 5}) == (b"\0\1\1\1", b"\0\1\0\1\1")


def test_stretches_aligned_alone_give_the_tokens_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(op, "CACHED", 40)
    one, two = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    one.encode_special_tokens = True
    texts = [t or "" for _, t in odd_texts()] + ["a" + " " * 200000 + "b", "\n" * 150000, "x" * 200000]
    pair = op.Pair(BYTE, PIECE)
    for _ in range(2):
        for k in range(0, len(texts), 7):
            for t, row in zip(texts[k : k + 7], pair.rows(texts[k : k + 7])):
                if row[0]:
                    assert np.frombuffer(row[0], "<u2").tolist() == one.encode(" " + t, add_special_tokens=False).ids
                    assert np.frombuffer(row[1], "<u2").tolist() == two.encode(t)
                else:
                    assert not t or "▁" in t


def test_links_expanded_in_steps_give_the_same_pairs(monkeypatch):
    r = random.Random(2)
    rows = {"a_ids": [], "b_ids": [], "a_ends": [], "b_ends": []}
    for _ in range(40):
        groups = [(r.randrange(1, 9), r.randrange(1, 9)) for _ in range(r.randrange(12))]
        for side, k in (("a", 0), ("b", 1)):
            rows[f"{side}_ends"].append(b"".join(b"\0" * (g[k] - 1) + b"\1" for g in groups))
            rows[f"{side}_ids"].append(bytes(x for g in groups for _ in range(g[k]) for x in (r.randrange(6), 0)))
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary()) for k, v in rows.items()})
    whole = [x.tolist() for x in op.Aligned(batch).pairs()]
    assert whole[0] == sorted(whole[0]) and sum(whole[2]) == sum(op.Aligned(batch).p * op.Aligned(batch).q)
    monkeypatch.setattr(op, "LINKS", 10)
    assert [x.tolist() for x in op.Aligned(batch).pairs()] == whole
