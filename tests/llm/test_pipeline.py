"""The corpus pipeline, stage by stage."""

import brute
import corpus_pipeline as pipeline
from small import SMALL
from pyspark.sql import functions as F

from sharetide.session import path_exists, stage


def test_stages_on_the_smallest_tables(llm, docs):
    rows, kept = docs, {}
    for name, step in pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in rows.collect()}
        rows = stage(step(llm, rows, SMALL), name)
        kept[name] = {r.doc_id: r for r in rows.collect()}
        assert rows.columns == docs.columns and set(kept[name]) <= set(before)
        texts = [(k, r.text) for k, r in before.items()]
        if name == "near_duplicates":
            leads = {lead for _, _, lead in brute.jaccard(texts, 5, 80)}
            assert set(kept[name]) == leads
        if name == "repeated_passages":
            left = {k: (n, m) for k, n, m in brute.later_copies_removed(texts, 50)}
            assert set(kept[name]) == {k for k, (n, m) in left.items() if m < n or not m}
            for k, r in kept[name].items():
                assert len(brute.words(r.text)) == left[k][0] - left[k][1] and (r.text == before[k].text) == (left[k][1] == 0)
    labels = {r.doc_id: r.quality for r in llm.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert not [k for k in kept["quality"] if labels.get(k) == 0]
    packed = pipeline.STAGES[-1][1](llm, rows, SMALL).collect()
    assert {r.doc_id for r in packed} == set(kept["repeated_passages"])


def test_stages_with_odd_rows(llm, docs):
    text = " ".join(f"the and of word{i}" for i in range(40))
    odd = [(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, text, "en", None, 1), (10_003, text, "en", None, 1), (None, text + " more", "en", "s", None)]
    rows = docs.limit(60).unionByName(llm.createDataFrame(odd, docs.schema)).withColumn("n_words", F.lit("clash"))
    rows = stage(rows, "odd")
    for name, step in pipeline.STAGES[:-1]:
        rows = stage(step(llm, rows, SMALL), name)
        assert rows.columns == [*docs.columns, "n_words"] and rows.where("n_words <> 'clash'").isEmpty()
    assert rows.where("doc_id = 10003").count() <= 1
    empty = docs.limit(0)
    for _, step in pipeline.STAGES:
        assert step(llm, empty, SMALL).count() == 0


def test_texts_meet_decisions_in_one_way_at_any_size(llm, docs):
    """Tables far below the broadcast limit are joined as large ones are, and texts of a stage are shuffled once."""
    for step in (pipeline.quality, pipeline.near_duplicates, pipeline.repeated_passages):
        plan = step(llm, docs, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, step


def test_work_tables_with_sets_are_gone_afterwards(llm, docs, monkeypatch):
    from sharetide.llm import op02_jaccard

    made = {}
    real = stage
    monkeypatch.setattr(op02_jaccard, "stage", lambda df, label, *by: made.setdefault(label, real(df, label, *by)))
    op02_jaccard.join_similar(docs, 5, 80, limit=1).count()
    path = made["large"].inputFiles()[0] if "large" in made else None
    assert path and not path_exists(llm, path)
