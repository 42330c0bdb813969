from __future__ import annotations

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from gridloom import extract, schemas
from gridloom.functions import rules
from gridloom.functions.text import NON_PRINTABLE, NOT_WS, WS, clean_cell, lenient_number, non_empty
from gridloom.operators import catalog, classify, grids
from gridloom.plans import registry
from gridloom.sources import tables
from tests.conftest import DATA

SCHEMA = "doc_id bigint, page_number int, method string, method_rank int, raw_index int, cells array<array<string>>"


def frame(spark, *cells, method="lines"):
    return spark.createDataFrame([(k, 1, method, 1, k + 1, c) for k, c in enumerate(cells)], SCHEMA)


@pytest.mark.parametrize(
    ("raw", "clean"), [(None, ""), ("  a\t\n b ", "a b"), ("a​  b", "a b"), ("a ​ b", "a  b"), (" x ", "x"), ("\u0001", "")]
)
def test_clean_cell(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "c string").select(clean_cell(F.col("c"))).first()[0] == clean


@pytest.mark.parametrize(
    ("cells", "valid"),
    [
        ([["a", "b"]], False),
        ([["a", None, None, None, None], [None] * 5], False),
        ([["a", "b", None, None, None], [None] * 5], True),
        ([["a", "b"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]], True),
        ([], False),
        ([[], []], False),
    ],
)
def test_validity(spark, cells, valid):
    assert grids.valid(frame(spark, cells)).count() == int(valid)


def metric(spark, f, cells):
    return frame(spark, cells).select(f(F.col("cells"))).first()[0]


@pytest.mark.parametrize(("numbers", "share"), [(5, 1.0), (4, 0.0), (3, 0.0), (1, 0.0), (0, 1.0)])
def test_data_types_are_strict_at_the_limits(spark, numbers, share):
    assert metric(spark, grids.data_types, [["h"], *([["1"]] * numbers), *([["x"]] * (5 - numbers))]) == share


def test_empty_column_counts_but_is_not_consistent(spark):
    assert metric(spark, grids.data_types, [["a", "b"], ["x", ""], ["y", ""]]) == 0.5


def test_perfect_grid(spark):
    scored = grids.with_quality(frame(spark, [["h1", "h2"], ["a", "1"], ["b", "2"]])).first()
    assert scored.quality_score == pytest.approx(1.0) and scored.quality_metrics.asDict() == dict.fromkeys(grids.METRICS, 1.0)


def test_one_row_scores_nothing(spark):
    assert grids.with_quality(frame(spark, [["a", "b"]])).first().quality_score == 0.0


def test_pad_and_header(spark):
    row = grids.promote_header(grids.pad_rows(frame(spark, [["a"], ["b", "c"]]))).first()
    assert row.header == ["a", ""] and row.cells == [["b", "c"]]


def test_dedup_keeps_the_first_and_leaves_a_gap(spark):
    both = frame(spark, [["a"], ["b"]]).withColumn("doc_id", F.lit(1))
    again = both.withColumn("method_rank", F.lit(3)).withColumn("method", F.lit("stream"))
    other = both.withColumn("method_rank", F.lit(5)).withColumn("cells", F.array(F.array(F.lit("z"))))
    assert sorted((r.table_index, r.method_rank) for r in grids.dedup(grids.table_index(both.union(again).unionByName(other))).collect()) == [(1, 1), (3, 5)]


@pytest.mark.parametrize(("cells", "kind"), [([["x", "y"], ["z", "w"]], "general_data"), ([["operating"], ["q"]], "financial_income"), ([["a"], ["placebo patient"]], "clinical_trial")])
def test_classes_and_ties(spark, cells, kind):
    assert classify.classify_tables(frame(spark, cells)).first().table_type == kind


@pytest.mark.parametrize(
    ("text", "number"), [("+3", True), (".5", True), ("1e5", True), ("inf", True), (" 3 ", True), ("", False), ("nan", False), ("1,000", False), ("$5", False), ("5%", False), ("0x10", False), ("1_000", False), ("1e400", False)]
)
def test_lenient_numbers(spark, text, number):
    assert spark.createDataFrame([(text,)], "c string").select(F.coalesce(lenient_number(F.col("c")), F.lit(False))).first()[0] is number


def test_limits(spark):
    from gridloom.operators.catalog import limit_items

    df = spark.range(5)
    assert [limit_items(df, n, "id").count() for n in (None, -1, 0, 3)] == [5, 0, 0, 3]


def test_vocabulary_grids_hold_every_order(spark):
    at = datetime.date(1997, 1, 1)
    rows = [(i * 700, 9, i + 0.5, at) for i in range(1, 46)] + [(i, 4, i + 0.5, at) for i in range(20)] + [(7, None, 1.5, at), (None, 9, 0.5, at)]
    found = tables.vocabulary_grids(spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date").repartition(5)).collect()
    got = {(r.doc_id, r.page_number): [row[1] for row in r.cells[1:]] for r in found}
    assert len(found) == 5 and all(r.cells[0] == ["Metric", "Amount", "Period"] for r in found)
    assert got[9, 1] + got[9, 2] + got[9, 3] == [f"CHF {i}.50" for i in range(46)] and [len(got[9, k]) for k in (1, 2, 3)] == [20, 20, 6]
    assert len(got[4, 1]) == 20 and got[None, 1] == ["1.50"]


def test_extract_tables(spark):
    good = [["name", "amount"], ["revenue", "1"], ["cost", "2"]]
    rows = [(1, 1, "lines", 1, 1, good), (1, 1, "stream", 3, 1, good), (1, 2, "lines", 1, 1, [["a"]]), (1, 3, "lines", 1, 1, [["Free", "cash flow"], ["x", "y"]]), (1, 9, "lines", 1, 1, good), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schemas.GRID)
    present = spark.createDataFrame([("table_p001_t001_lines.csv",)], "name string")
    found = extract.extract_tables(df, extract.TableOptions(page_max=5), present)
    assert [(r.page_number, r.table_index, r.filename) for r in found.records.orderBy("page_number").collect()] == [(1, 1, "table_p001_t001_lines.csv"), (3, 1, "table_p003_t001_lines.csv")]
    assert [r.name for r in found.issues.collect()] == ["table_p003_t001_lines.csv"] and [r.place for r in found.statistics.collect()] == [1, 2]
    assert extract.extract_tables(df, extract.TableOptions(page_start=9, verify=False), present).records.count() == 1
    assert extract.extract_tables(df, extract.TableOptions(limit=1)).records.count() == 1 and extract.extract_tables(df, extract.TableOptions(limit=-1)).records.count() == 0
    document = json.loads(extract.table_documents(found.records).first().document)
    assert document["tables_extracted"] == 2 and document["configuration"]["min_quality"] == 0.3 and [t["page_number"] for t in document["tables"]] == [1, 3]


def test_enforced_filter_numbers_what_passes(spark):
    poor, good = [["1", ""], ["", "2"]], [["name", "amount"], ["revenue", "1"], ["cost", "2"]]
    df = spark.createDataFrame([(1, 1, "lines", 1, 1, poor), (1, 1, "text", 2, 1, good)], schemas.GRID)
    assert [(r.table_index, r.method) for r in catalog.catalog(df, 0.8, enforce=True).collect()] == [(1, "text")]
    assert sorted((r.table_index, r.method) for r in catalog.catalog(df, 0.8).collect()) == [(1, "lines"), (2, "text")]


def test_reports(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "kind string, n long")
    assert [(r.kind, r.place) for r in catalog.ranked(df, "kind").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    scored = spark.createDataFrame([(0.9,), (0.1,), (None,)], "quality_score double")
    assert catalog.filtered_count(scored, 0.5).first()[:] == (1, 2)
    pages = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "doc_id long, page_number int")
    assert catalog.throughput(pages, 4).first()[0] == 0.5 and catalog.throughput(pages, 0).first()[0] is None


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_scores_repeats_no_cleaning(spark):
    found = registry.QUERIES["quality_filter"](spark, DATA)
    assert plan(found).count(NON_PRINTABLE) == 1 and plan(found).count("date_format") == 1


ODD = [None, "", " ", "a", " a", "a  b", "a \t b", "\x7f", "\x7fa", "~", "!", "é", " é  b ", " ", " x ", "a​b", "　", "\x00", "a\x1fb", "\n", "a\n", "\U0001f600", "a  b "]


def test_quick_answers_are_the_patterns_answers(spark):
    c = F.col("c")
    collapsed = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))
    slow = F.regexp_replace(collapsed, f"{NON_PRINTABLE}+", ""), F.coalesce(c.rlike(NOT_WS), F.lit(False))
    for r in spark.createDataFrame([(x,) for x in ODD], "c string").select("c", clean_cell(c), non_empty(c), *slow).collect():
        assert r[1:3] == r[3:], repr(r[0])


def test_column_counts_beside_each_other(spark):
    assert metric(spark, grids.data_types, [["h", "i", "j"], ["1", None, "x"], ["2", "3"], ["y", "4", ""], ["5"]]) == pytest.approx(2 / 3)


def test_enforced_catalog_shuffles_and_cleans_once(spark):
    df = registry.QUERIES["enforced_catalog"](spark, DATA)
    assert plan(df).count(NON_PRINTABLE) == 1 and df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_scores_count_every_word_and_pattern(spark):
    texts = ["Cash flow 5% (a) $1,200 $3.50", "n = 12 r=.5 p < 0.05", "12.5% of 2.0x", "operating margin margin", "co2 scope 2 tCO2", "x", "100% %(q)"]
    cells = [[["Operating cash", None, ""], [t, "Phase 2"]] for t in texts]
    for got, c in zip(classify.class_scores(frame(spark, *cells)).orderBy("doc_id").collect(), cells):
        header, text = "operating cash", " ".join(x for row in c for x in row if x).lower()
        for s, (words, patterns) in zip(got.scores, rules.TABLE_TYPES.values()):
            want = sum(2 * (w in text) + 3 * (w in header) for w in words) + sum(2 * len(list(re.finditer(p, text))) for p in patterns)
            assert s.score == want, (s.name, text)
