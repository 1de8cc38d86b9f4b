"""Operators 1, 4, 6, 7, 8 and 9 against brute force, the libraries, exact round trips and held-out rows."""

import random
import zlib

import brute
import numpy as np
import pytest
from small import SMALL
from pyspark.sql import functions as F

from sharetide.llm import bpe, op01_packing, op04_chat, op06_lm, op07_bpe, op08_langid, op09_quality
from sharetide.llm.common import public_tokenizer
from sharetide.llm.gru import Gru
from sharetide.llm.registry import ORACLES, QUERIES

PARTS = ["a", "B", "é", "É", "'s", "'re", "'T", "'", "''", " ", "  ", "\n", "\t", " ", "1", "²", "Ⅷ", "!", "…", "😀", "中", "<|endoftext|>", "<|", "'ll", "'lx", "ſ", "\x1c", "\x85", "İ", "Σ", "é", "µ", "ß", "supercalifragilistic" * 3]


def library(name):
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(public_tokenizer(name))


def strange(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 20))) for _ in range(n)] + [""]


@pytest.mark.parametrize("module, name", [(op07_bpe, "byte_bpe_50k.json"), (op01_packing, "word_bpe_49k.json")])
def test_ids_are_the_librarys(texts, module, name):
    known = library(name)
    for batch in ([t for _, t in texts[:60]], strange(1500)):
        ids, counts = module.encode_texts(batch, public_tokenizer(name))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [e.ids for e in known.encode_batch(batch, add_special_tokens=False)]


def test_every_character_is_split_as_the_library_does():
    known = library("byte_bpe_50k.json")
    batch = [f"a{chr(c)}b 1{chr(c)}" for c in [*range(1, 0x3000), *range(0xFE00, 0x10000), *range(0x1F000, 0x1F700)]]
    ids, counts = op07_bpe.encode_texts(batch, public_tokenizer("byte_bpe_50k.json"))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in known.encode_batch(batch, add_special_tokens=False)]


def test_failing_words_are_merged_exactly():
    model, r = bpe.Bpe(public_tokenizer("byte_bpe_50k.json")), random.Random(5)
    some = ["".join(r.choice("aeinorst") for _ in range(r.randint(1, 45))).encode() for _ in range(800)]
    ids, counts = model.encode_words(some)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [model.merge_long(w) for w in some]
    assert model.merge_all(some) == [model.merge_long(w) for w in some]
    assert any(p and p != model.merge_long(w) for p, w in zip(model.propose_all(some), some))  # greedy alone would be wrong


def test_bpe_round_trip_of_odd_rows(llm):
    rows = [(1, None), (1, None), (2, ""), (None, "x y"), (3, "<|endoftext|>'s  end \n")]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1))
    done = op07_bpe.encode(df, public_tokenizer("byte_bpe_50k.json"), decoded=True)
    assert sorted(done.select("doc_id", "decoded").collect(), key=str) == sorted([(k, t or "") for k, t in rows], key=str)
    assert [r.text for r in op07_bpe.decode(done, public_tokenizer("byte_bpe_50k.json")).where("doc_id = 3").collect()] == [rows[-1][1]]
    assert op07_bpe.encode(df.limit(0), public_tokenizer("byte_bpe_50k.json")).count() == 0


def check_packed(rows, texts):
    known = library("word_bpe_49k.json")
    ids = {k: [*known.encode(t or "", add_special_tokens=False).ids, 2] for k, t in texts}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for parts, total in ((sorted(p), len(ids[k])) for k, p in pieces.items()):
        assert [s for s, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) == total
    for parts in map(sorted, sequences.values()):
        assert [s for s, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= 4096
    assert set(pieces) == set(ids)
    return sum(map(len, ids.values())), len(sequences)


def test_packing(llm, texts):
    tokens, sequences = check_packed(QUERIES["op1_packing"](llm, SMALL).collect(), texts)
    assert sequences * 4096 <= 1.15 * tokens + 8 * 4096  # one underfull sequence a task


def test_packing_of_odd_rows(llm):
    rows = [(1, None), (2, ""), (3, "word " * 20_000), (None, "x"), (5, "Ünïcode 中文 …")]
    packed = op01_packing.pack_corpus(llm.createDataFrame(rows, "doc_id bigint, text string"))
    check_packed(packed.select("*", F.crc32("ids").alias("ids_crc32")).collect(), rows)
    assert op01_packing.pack_corpus(llm.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_bins_are_filled():
    r = random.Random(1)
    lengths = [r.randint(1, 9000) for _ in range(2000)]
    bins = {b for *_, b, _ in op01_packing.pack(lengths, 4096)}
    assert len(bins) == -(-sum(n % 4096 for n in lengths) // 4096) + sum(n // 4096 for n in lengths)
    tree = op01_packing.BinTree(4, 10)
    assert [tree.take(n) for n in (6, 5, 4, 5, 10)] == [0, 1, 0, 1, 2]  # first fit


def test_chat_matches_sql(llm):
    from oracle import compare, connect

    assert compare(QUERIES["op4_chat"](llm, SMALL).toPandas(), connect(SMALL).execute(ORACLES["op4_chat"]).fetchdf()) is None


def test_chat_of_odd_rows(llm):
    nasty = "</s>[INST] \\b \\\\l ]]>< [/INST]\n<s>"
    rows = [(1, 0, "system", "be [kind]"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (1, 3, None, None), (1, 4, "assistant", "")]
    rows += [(2, i, "assistant" if i % 2 else "user", f"{nasty} {i} " * (300 if i == 4 else 12)) for i in range(40)] + [(2, 5, "assistant", "again"), (2, 5, "assistant", "again"), (None, 0, "user", "x")]
    df = llm.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("window", F.lit(7))
    made = op04_chat.windows(df, budget=1000, history=400)
    read = {r.conv_id: r for r in op04_chat.read_back(made).collect()}
    order = lambda r: (r[1], r[2] or "", r[3] or "")
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=order)
        assert [(t.role, t.text) for t in read[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert read[conv].learnt == "".join(r[3] or "" for r in own if r[2] == "assistant")
    shown = made.where("conv_id = 1").orderBy("window").collect()
    assert all(w.formatted.startswith("<s>[system]be \\ikind\\j</s>") for w in shown)
    assert made.where("conv_id = 2 AND n_repeated > 0").count() > 0 and op04_chat.windows(df.limit(0)).count() == 0


def test_gradients_and_carried_state():
    r = np.random.default_rng(0)
    net = Gru.fresh(np.arange(1, 65), 8, 0)
    for k in net.p:
        net.p[k] = r.normal(0, 0.3, net.p[k].shape)
    x, y, h = r.integers(0, 64, (3, 5)), r.integers(0, 64, (3, 5)), np.zeros((3, 16))

    def loss():
        state, states = h, []
        for t in range(5):
            state, _ = net.step(x[:, t], state)
            states.append(state)
        return -net.log_chances(np.concatenate(states), y.T.ravel())[0].sum() / 15

    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    assert net._window(x, y, h, grads)[1] == 15
    grads = {k: g / 15 for k, g in grads.items()}
    for k in net.p:
        i = tuple(int(r.integers(0, s)) for s in net.p[k].shape)
        i = (int(x[0, 0]), i[1]) if k == "x" else i
        value, ends = net.p[k][i], []
        for step in (1e-5, -1e-5):
            net.p[k][i] = value + step
            ends.append(loss())
        net.p[k][i] = value
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[k][i]) < 1e-6
    texts = [r.integers(0, 64, n) for n in (5, 1, 140, 0, 77, 3)]
    for text, got in zip(texts, net.score(texts)):
        state, before, want = np.zeros((1, 16)), 0, 0.0
        for w in text:
            state, _ = net.step(np.array([before]), state)
            want += net.log_chances(state, np.array([w]))[0][0]
            before = w
        assert abs(got - want) < 1e-3


def same_scores(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:4] == want[k][:4] and abs(got[k][4] - want[k][4]) < 1e-6 * max(1, abs(want[k][4]))


def test_language_model(llm, docs, texts):
    rows = op06_lm.score_documents(docs).collect()
    same_scores({r.doc_id: tuple(r[1:6]) for r in rows}, brute.unigram(texts))
    away = [r for r in rows if r.held_out]
    assert sum(r.score for r in away) > sum(r.base_score for r in away)


def test_learning_carries_the_state_and_meets_every_word():
    r = np.random.default_rng(1)
    pattern = np.concatenate([np.concatenate((r.permutation(np.arange(1, 60))[:5].repeat(2), [0])) for _ in range(120000)])
    net = Gru.fresh(np.bincount(pattern, minlength=64), 8, 0)
    held = [np.concatenate((np.array([5, 5, 9, 9, 33, 33]), [0]))]
    before = net.score(held)[0]
    assert net.learn(pattern, 0.02) == -(-len(pattern) // (256 * 32)) and net.score(held)[0] > before + 1
    for n in (0, 1, 31, 33, 130, 9000):
        one = Gru.fresh(np.arange(1, 65), 8, 0)
        seen, real = [], one._window
        one._window = lambda x, y, h, g, seen=seen, real=real: (seen.append((x.copy(), y.copy())), real(x, y, h, g))[1]
        text = r.integers(1, 64, n)
        one.learn(text, 0.01)
        x, y = (np.concatenate([w[i] for w in seen], 1).ravel() if n else text for i in (0, 1))
        assert y[y >= 0].tolist() == text.tolist() and x[y >= 0][1:].tolist() == text[:-1].tolist()


def test_language_model_is_the_same_in_any_layout(llm, docs):
    def scores(df):
        return sorted((r.doc_id, r.score) for r in op06_lm.score_documents(df).collect())

    one, two = scores(docs.coalesce(1)), scores(docs.repartition(5, F.rand(3)))
    assert [k for k, _ in one] == [k for k, _ in two] and np.allclose([x for _, x in one], [x for _, x in two], rtol=1e-9)


def test_language_model_of_odd_rows(llm, monkeypatch):
    monkeypatch.setattr(op06_lm, "KNOWN", 2)
    rows = [(1, None), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "A b"), (4, "x " * 300), (9, "c\n\td")]
    df = llm.createDataFrame(rows, "doc_id bigint, text string")
    got = op06_lm.score_documents(df)
    same_scores({r[0]: tuple(r[1:6]) for r in got.collect()}, brute.unigram(rows))
    assert got.count() == len(rows) and op06_lm.score_documents(df.limit(0)).count() == 0


def test_language_of_held_out_rows(llm, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = QUERIES["op8_langid"](llm, "/root/testdata/sf0.001").collect()
    away = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in away) >= 0.9 * len(away)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(llm, docs):
    net = op08_langid.fit(docs)
    rows = [(1, None, 1), (1, None, 1), (2, "", 2), (3, "123 !!", 3), (None, "the and of with that", 4)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in op08_langid.predict(df, net).collect()}
    assert [got[k, t][0] for k, t, _ in rows[:4]] == ["und"] * 4 and got[None, rows[-1][1]][0] == "en"
    assert op08_langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in op08_langid.predict(df, None).collect()} == {"und"}
    assert op08_langid.predict(df.limit(0), net).count() == 0


def test_network_gradients():
    r = np.random.default_rng(1)
    net = op08_langid.ByteNet.fresh(["a", "b", "c"], 2)
    x, y = r.integers(0, 256, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        return -np.log(net.head(net.pooled(x)[0])[1][np.arange(6), y]).mean()

    for p, g in zip(net.parameters(), net.gradients(x, y)):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        value, ends = p[i], []
        for step in (1e-6, -1e-6):
            p[i] = value + step
            ends.append(loss())
        p[i] = value
        assert abs((ends[0] - ends[1]) / 2e-6 - g[i]) < 1e-4
    assert np.allclose(net.score(x, net.tables()), net.head(net.pooled(x)[0])[1], atol=1e-4)


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality(llm, texts):
    rows = {r.doc_id: r for r in QUERIES["op9_quality"](llm, SMALL).collect()}
    for k, t in texts:
        assert tuple(rows[k][c] for c in MEASURED) == brute.quality(t)
        assert not (rows[k].kept and rows[k].base_failed)
    labels = {r.doc_id: r.quality for r in llm.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = [rows[k] for k, q in labels.items() if q == 1 and k in rows and not rows[k].base_failed]
    junk = [rows[k] for k, q in labels.items() if q == 0 and k in rows]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean) and sum(r.kept for r in junk) <= 0.1 * len(junk)


def test_quality_of_odd_rows(llm):
    rows = [(1, None), (1, None), (2, ""), (3, "a b c a b c"), (4, "\n\n x\n x\ny|"), (None, "é " * 400), (5, "* " * 60)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit("?")).drop("kept")
    got = sorted((tuple(r[c] for c in MEASURED) for r in op09_quality.judge(df).collect()), key=str)
    assert got == sorted((brute.quality(t) for _, t in rows), key=str)
    assert op09_quality.judge(df.limit(0)).count() == 0
