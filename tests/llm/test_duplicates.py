"""Operators 2, 3, 5 and 10 against brute force."""

import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sharetide.llm import graph, op02_jaccard, op03_substring, op05_embeddings, op10_suffix

P = " ".join(f"w{i}" for i in range(120))
Q = " ".join(f"z{i}" for i in range(52))
ODD = [
    (1, None), (1, None), (2, ""), (3, P), (3, P), (13, P.upper()), (4, "a " * 200), (9, "a a a a"), (None, "x " + P + " y"),
    (5, "b c"), (6, "B  C"), (7, "b"), (8, "\n \t"), (10, "é " + P + "\n\n" + P[:100]), (11, " ".join(f"q{i % 40}" for i in range(300))),
    (20, "l " + Q + " m"), (21, "k " + Q), (22, Q + " o o o"), (23, P.replace("w119", "u") + " " + Q),
]


def odd(llm):
    return llm.createDataFrame(ODD, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("n_words", "row_key", "class", "spans")})


def plain(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


def similar(df, **how):
    return plain(map(tuple, op02_jaccard.join_similar(df, **how).select("doc_id", "n_shingles", "component_id").collect()))


@pytest.mark.parametrize("words, percent, limit", [(4, 85, 6000), (5, 80, 3)])
def test_similarity_join(docs, texts, words, percent, limit):
    assert similar(docs, words=words, percent=percent, limit=limit) == plain(brute.jaccard(texts, words, percent))


def test_similarity_join_of_odd_rows(llm):
    assert similar(odd(llm), words=4, percent=85) == plain(brute.jaccard(ODD, 4, 85))
    assert op02_jaccard.join_similar(odd(llm).limit(0)).count() == 0


def test_dense_chain_is_dealt_out_and_joined(llm):
    """Each text differs a little from the one before, so all are linked and no window divides them."""
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(60):
        base[(7 * i) % 200] = f"n{i}"
        rows.append((i, " ".join(base)))
    df = llm.createDataFrame(rows, "doc_id bigint, text string")
    assert similar(df, words=4, percent=85, limit=10) == plain(brute.jaccard(rows, 4, 85))


def test_number_of_links(llm):
    rows = [(1, P), (2, P + " e1"), (3, P + " e2"), (4, P), (5, "other words are here now")]
    df = llm.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.n_links for r in op02_jaccard.join_similar(df, 4, 85).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 0}  # links of a class to other classes; 1 and 4 are one class


def test_components(llm):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.v: r.root for r in graph.components(llm.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert graph.components(llm.createDataFrame([], "a bigint, b bigint")).count() == 0


def removed(df, key="doc_id"):
    return plain(map(tuple, op03_substring.remove_repeats(df).select(key, "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256)).collect()))


def test_substrings(docs, texts, llm):
    assert removed(docs) == plain(brute.all_copies_removed(texts, 35))
    assert removed(odd(llm)) == plain(brute.all_copies_removed(ODD, 35))
    assert op03_substring.remove_repeats(odd(llm).limit(0)).count() == 0


def test_substrings_of_common_seeds(docs, texts, monkeypatch):
    monkeypatch.setattr(op03_substring, "HOT_SEED", 2)
    assert removed(docs) == plain(brute.all_copies_removed(texts, 35))


def first_kept(df):
    last = F.coalesce("doc_id", F.lit(2**63 - 1))
    return sorted(map(tuple, op10_suffix.dedup(df).select(last, "n_words", "n_removed").collect()))


def expected_first_kept(rows):
    return sorted((2**63 - 1 if k in (None, math.inf) else k, n, m) for k, n, m in brute.later_copies_removed(rows, 50))


@pytest.mark.parametrize("hot", [100_000, 2])
def test_passages(docs, texts, llm, monkeypatch, hot):
    monkeypatch.setattr(op10_suffix, "HOT_SEED", hot)
    assert first_kept(docs) == expected_first_kept(texts)
    assert first_kept(odd(llm)) == expected_first_kept(ODD)


def test_passages_keep_the_rest_byte_for_byte(llm):
    rows = [(1, "head\n\n" + Q + "\ttail  end"), (2, "other\nstart " + Q + "\nand  rest"), (3, None), (4, "  untouched \n")]
    out = {r.doc_id: r for r in op10_suffix.dedup(llm.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1].text == rows[0][1] and out[4].text == "  untouched \n" and out[3].text is None
    assert out[2].text == "other\nstart and  rest" and out[2].first_ids == [1]
    assert op10_suffix.dedup(llm.createDataFrame([], "doc_id bigint, text string")).count() == 0


def near(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in op05_embeddings.near_duplicates(df).collect()}


def test_embeddings(llm):
    import numpy as np

    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 24))
    rows = [(i, [float(x) for x in centres[i % 12] + r.normal(size=24) * 0.25 * (i % 3)]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(30)]
    got, want = near(llm.createDataFrame(rows, "vec_id bigint, embedding array<float>")), brute.cosine([(k, np.float32(e).tolist()) for k, e in rows], 0.9)
    links = sum(n for n, _ in want.values())
    assert sum(min(got[k][0], want[k][0]) for k in want) >= 0.95 * links > 0
    assert all(got[k][0] <= want[k][0] for k in want)


def test_embeddings_of_two_tight_clusters_that_are_linked(llm):
    import numpy as np

    r = np.random.default_rng(8)
    x, y = np.eye(24)[0], 0.93 * np.eye(24)[0] + np.sqrt(1 - 0.93**2) * np.eye(24)[1]
    rows = [(i, [float(v) for v in (x if i % 2 else y) + r.normal(size=24) * 0.004]) for i in range(60)]
    assert near(llm.createDataFrame(rows, "vec_id bigint, embedding array<double>")) == brute.cosine(rows, 0.9)


def test_embeddings_audit_sees_small_groups_beside_a_large_one(llm, monkeypatch):
    import numpy as np

    r = np.random.default_rng(9)
    centres = r.normal(size=(21, 24))
    rows = [(i, [float(v) for v in centres[max(0, i // 2 - 59)] + r.normal(size=24) * 0.001]) for i in range(160)]
    df, enlarge = llm.createDataFrame(rows, "vec_id bigint, embedding array<double>"), op05_embeddings.enlarge
    monkeypatch.setattr(op05_embeddings, "ROUNDS", 1)
    assert near(df) == brute.cosine(rows, 0.9)
    monkeypatch.setattr(op05_embeddings, "enlarge", lambda *a: enlarge(*a).where("n_near > 1"))  # all pairs are lost
    with pytest.raises(RuntimeError, match="linked nodes"):
        near(df)


def test_embeddings_of_odd_rows(llm):
    rows = [
        (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0]),
        (8, [1.0, 0.1]), (9, [0.0, 1.0]), (10, []), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.05]), (12, [float("inf"), 1.0]),
    ]
    df = llm.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("c", F.lit(1))
    assert near(df) == brute.cosine(rows, 0.9)
    assert op05_embeddings.near_duplicates(df.limit(0)).count() == 0


def test_chance_shingles_are_no_keys_and_linked_sets_share_one():
    rng = np.random.default_rng(7)
    fresh = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64)

    def keys_in_common(a, b):
        sets = [np.unique(a), np.unique(b)]
        key, owner = op02_jaccard.keys_of(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), 80)
        return set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())

    chance = linked = 0
    for _ in range(60):
        some = fresh(300)
        chance += bool(keys_in_common(np.concatenate((some[:20], fresh(280))), some))  # unrelated but for some shingles
        for size in (6, 12, 45, 300):  # as far apart as linked sets can be
            own = fresh(size)
            away = size // 9 * 2
            near = np.concatenate((own[: size - away // 2], fresh(away // 2)))
            both = len(np.intersect1d(own, near))
            linked += 100 * both >= 80 * (len(own) + len(near) - both) and not keys_in_common(own, near)
    assert chance <= 3 and not linked


def test_key_edges_hang_classes_on_the_least_across_batches(llm):
    keys = llm.range(9000).selectExpr("CASE WHEN id < 5000 THEN 1 ELSE id DIV 3 END AS seed", "id AS class")
    found = {(r.a, r.b) for r in op02_jaccard._key_edges(keys).collect()}
    least = {}
    for i in range(9000):
        least.setdefault(1 if i < 5000 else i // 3, i)
    assert found == {(i, low) for i in range(9000) if (low := least[1 if i < 5000 else i // 3]) != i}
