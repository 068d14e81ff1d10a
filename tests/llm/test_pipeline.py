"""The stages on the smallest tables: what each keeps, and that it starts from what the one before kept."""

import re

import compare
from conftest import SF

import corpus_pipeline
from haulcomp.llm import common, queries

from .conftest import words


def test_mixing_equals_its_sql(spark):
    assert compare.check(spark, compare.connect(SF), "op3_mixing", SF) is None


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stage(stage(spark, docs, SF), f"test-{name.replace('_', '-')}")
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        kept[name] = ids
        docs = after
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    texts = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}
    long_enough = {i for i, t in texts.items() if len(words(t)) >= 50}
    judged = [(i in kept["quality_rules"], labels[i] == 1) for i in labels if i in long_enough]
    assert sum(a == b for a, b in judged) > 0.95 * len(judged)
    items = [" ".join(r.text.lower().split()) for r in common.table(spark, SF, "benchmark").collect()]
    for i in kept["near_duplicates"]:
        text = " ".join(texts[i].lower().split())
        if any(x in text for x in items):
            assert i not in kept["decontamination"]
    assert len(kept["decontamination"]) > 0.9 * len(kept["near_duplicates"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == kept["mix_to_weights"]
    assert [re.sub(r"\W", "", n) for n, _ in corpus_pipeline.STAGES] == [n for n, _ in corpus_pipeline.STAGES]


def test_queries_are_named_by_their_operators():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES if q != "pipeline"} == set(range(1, 14))
