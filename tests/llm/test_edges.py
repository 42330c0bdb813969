"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names, for every operator and stage on documents."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import decontam, lines, ngram_join, packing, pii, quality, suffix, toxicity
from tests.conftest import DATA

LONG = " ".join(f"w{k % 977}x{k}" for k in range(250_000))
ROWS = [(1, "a b c"), (1, "a b c"), (1, "other words"), (None, None), (2, None), (3, ""), (4, " \n\t"), (5, "x" * 300_000), (6, LONG), (None, "some text"), (7, "\0\x01\x02\x03\x07 é 漢字 😀 ́"), (8, "tie one two"), (9, "tie one two")]
#: Names that the operators use themselves, inside or in their results.
CLASHES = "id tag base start anchor hash uid drop vote leaf parts n_lines n_dropped n_found pieces pseudonyms key score slots weights bin offset root sequence_id piece length text_hash group_id component_id n_shingles rep kept spans n_bytes lang source n_chars toxic distance end item_id _score Score".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    own = dict.fromkeys(c.lower() for c in CLASHES)
    return df.select("*", *(F.when(F.col("doc_id") > 3, F.lit(f"own {c}")).alias(c) for c in own)).repartition(3)


def label(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (None, 1), (6, 0), (6, 1)], "doc_id long, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "some text", "x"), (2, None, "x"), (3, "", None), (None, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10", "x"), (1, "some text", "x")], "item_id long, text string, doc_id string")


ONE_EACH = {
    "op2": lambda d, s: pii.pseudonymise(d, "k"),
    "op3": lambda d, s: ngram_join.jaccard_components(d),
    "op4": lambda d, s: quality.judge(d, quality.references(d)),
    "op6": lambda d, s: suffix.remove_repeats(d),
    "op7": lambda d, s: lines.drop_templates(d),
    "op8": lambda d, s: toxicity.scored(d, toxicity.train(d, label(s))),
}


@pytest.mark.parametrize("name", ONE_EACH)
def test_a_row_for_each_document(spark, docs, name):
    run = ONE_EACH[name]
    found = run(docs, spark)
    rows = found.collect()
    assert collections.Counter(r[0] for r in rows) == collections.Counter(i for i, _ in ROWS)
    twins = [tuple(map(repr, r)) for r in rows if r[0] == 1]
    assert len(set(twins)) == 2  # equal rows have equal results
    assert found.columns[0] == "doc_id" and run(docs.limit(0), spark).count() == 0
    nulls = run(docs.where("doc_id is null or text is null"), spark).collect()
    assert len(nulls) == 3


def test_kept_columns_keep_their_values(spark, docs):
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    for name in ("op2", "op7", "op8"):
        found = ONE_EACH[name](docs, spark)
        assert found.columns[: len(docs.columns)] == docs.columns and len(found.columns) == len({c.lower() for c in found.columns})
        assert {tuple(r) for r in found.where("doc_id = 6").select(own).collect()} == {tuple(f"own {c}" for c in own)}


def test_values(spark, docs):
    by = lambda name: {(r.doc_id, k): r for k, r in enumerate(ONE_EACH[name](docs, spark).collect())}
    joined = by("op3")
    assert {r.n_shingles for (i, _), r in joined.items() if i in (2, 3, 4)} == {0} and {r.component_id for (i, _), r in joined.items() if i in (8, 9)} == {8}
    assert next(r.n_shingles for (i, _), r in joined.items() if i == 6) == 250_000 - 4
    kept = by("op6")
    assert {(r.n_bytes, bytes(r.kept)) for (i, _), r in kept.items() if i in (2, 3)} == {(0, b"")} and next(len(r.kept) for (i, _), r in kept.items() if i == 5) == 0
    assert next(bytes(r.kept) for (i, _), r in kept.items() if i == 6) == LONG.encode()
    assert {r.text for (i, _), r in by("op2").items() if i == 7} == {"\0\x01\x02\x03\x07 é 漢字 😀 ́"}


def test_packing_and_leaks(spark, docs):
    pieces = packing.pack_documents(docs, packing.tokenizer_path())
    rows = pieces.collect()
    assert {r.doc_id for r in rows} == {i for i, _ in ROWS} and sum(r.piece == 0 for r in rows) == len(ROWS)
    assert packing.pack_documents(docs.limit(0), packing.tokenizer_path()).count() == 0
    found = collections.Counter((r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(docs, bench(spark)).collect())
    assert found == {(None, 1, 0): 2, (6, None, 0): 1}
    clean = decontam.decontaminate(docs, bench(spark))
    assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == sorted([0, 1, 1, 1, 2, 3, 4, 5, 7, 8, 9])
    for one in (docs.limit(0), docs):
        assert decontam.decontaminate(one, bench(spark).limit(0)).count() == one.count()
    assert decontam.find_leaks(docs.limit(0), bench(spark)).count() == 0
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {r.doc_id for r in decontam.find_leaks(named, bench(spark)).collect()} == {None, "6"}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, DATA)
    rows = out.collect()
    assert stage(spark, docs.limit(0), DATA).count() == 0
    if name == "best_fit_packing":
        assert sum(r.piece == 0 for r in rows) == len(ROWS)
        return
    assert out.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in rows)
    every = collections.Counter(i for i, _ in ROWS)
    if name == "ngram_jaccard_join":  # of equal texts the smallest id stays, once
        every = collections.Counter({**every, 1: 2, 9: 0})
    assert +ids == +every
    assert {r.text for r in rows if r.doc_id in (2, None)} == {None, "some text"}
    six = next(r for r in rows if r.doc_id == 6)
    assert six.text == LONG and six.key == "own key" and six.text_hash == "own text_hash"


def test_jaccard_stage_with_equal_ids(spark):
    base = " ".join(f"v{k}" for k in range(100))
    near = base.replace("v50 ", "changed ")
    rows = [(10, base), (10, near), (10, "some other text of ten words that is like none"), (20, base + " end"), (10, base), (30, "some other text of ten words that is like none"), (None, base)]
    kept = corpus_pipeline.jaccard_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert collections.Counter(r.doc_id for r in kept) == {10: 2, None: 1}
    assert len({r.text for r in kept if r.doc_id == 10 and r.text in (base, near)}) == 1
