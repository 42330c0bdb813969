"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import corpus_pipeline
from gridloom.llm import ngram_join, toxicity
from gridloom.llm.common import materialize, table
from tests.conftest import DATA


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, DATA))
        rows = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            after = {r.doc_id: r for r in rows}
            assert len(after) == len(rows) and set(after) <= set(before)
            if name == "line_dedup":
                assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in rows)
            else:
                assert all(after[d] == before[d] for d in after)
            if name == "ngram_jaccard_join":
                groups = {}
                for r in ngram_join.jaccard_components(docs).collect():
                    groups.setdefault(r.component_id, []).append(r.doc_id)
                assert set(after) == {min(g) for g in groups.values()}
            before = after
        else:
            assert {r.doc_id for r in rows} == set(before)
        docs = out


def test_toxic_documents_go_and_others_stay(spark):
    docs = table(spark, DATA, "documents")
    kept = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, DATA).collect()}
    assert 0.75 * docs.count() < len(kept) <= docs.count()
    assert toxicity.BITS == 20
