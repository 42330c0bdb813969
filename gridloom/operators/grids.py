"""Grids: predicates, cleaning, shaping, scores. Every operator is a narrow projection or filter over `schemas.GRID`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import clean_cell, lenient_number, non_empty, numeric, present

CELLS = "cells"


def over_cells(cells: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(cells, lambda row: F.transform(row, f))


def _share(part: Column, whole: Column, none: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(none))


def _first_row(cells: Column) -> Column:
    return F.coalesce(F.get(cells, F.lit(0)), F.array().cast("array<string>"))


def modal_width_rows(cells: Column) -> Column:
    """How many rows have the commonest width."""
    widths = F.transform(cells, F.size)
    return F.coalesce(F.array_max(F.transform(F.array_distinct(widths), lambda w: F.size(F.filter(widths, lambda x: x == w)))), F.lit(0))


def is_valid(cells: Column) -> Column:
    """Two rows at least, a fifth of the cells filled, and half the rows of one width; over the raw grid."""
    flat = F.flatten(cells)
    return (F.size(cells) >= 2) & (_share(F.size(F.filter(flat, non_empty)), F.size(flat)) >= 0.2) & (modal_width_rows(cells) * 2 >= F.size(cells))


def _once(grids: DataFrame, name: str, value: Column) -> DataFrame:
    """A column out of a generator of one row, through which no filter is pushed.

    A filter on a projected value is pushed below the projections, and there repeats what makes the cells for each place that names them."""
    return grids.drop(name).select("*", F.explode(F.array(value)).alias(name))


def valid(grids: DataFrame) -> DataFrame:
    return _once(grids, "is_valid", is_valid(F.col(CELLS))).where("is_valid").drop("is_valid")


def clean_cells(grids: DataFrame) -> DataFrame:
    return grids.withColumn(CELLS, over_cells(F.col(CELLS), clean_cell))


def drop_empty_rows(grids: DataFrame) -> DataFrame:
    return grids.withColumn(CELLS, F.filter(CELLS, lambda row: F.exists(row, present)))


def clean(grids: DataFrame) -> DataFrame:
    return drop_empty_rows(clean_cells(grids))


def widest(cells: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0))


def pad_rows(grids: DataFrame) -> DataFrame:
    width = widest(F.col(CELLS))
    return grids.withColumn(CELLS, F.transform(CELLS, lambda row: F.concat(row, F.array_repeat(F.lit(""), width - F.size(row)))))


def promote_header(grids: DataFrame) -> DataFrame:
    """The first row as ``header``, the others as the cells."""
    return grids.withColumn("header", _first_row(F.col(CELLS))).withColumn(CELLS, F.when(F.size(CELLS) > 1, F.slice(CELLS, 2, F.size(CELLS) - 1)).otherwise(F.array().cast("array<array<string>>")))


def joined_text(cells: Column) -> Column:
    """The cells that aren't null or empty, a space between; nulls are left out by the join."""
    return F.array_join(F.array_remove(F.flatten(cells), ""), " ")


def with_text(grids: DataFrame) -> DataFrame:
    """Lower-cased text of the grid and of its first row."""
    return grids.withColumn("table_text", F.lower(joined_text(F.col(CELLS)))).withColumn("header_text", F.lower(F.array_join(F.filter(_first_row(F.col(CELLS)), present), " ")))


def completeness(cells: Column) -> Column:
    flat = F.flatten(cells)
    return _share(F.size(F.filter(flat, non_empty)), F.size(flat))


def consistency(cells: Column) -> Column:
    return _share(modal_width_rows(cells), F.size(cells))


def structure(cells: Column) -> Column:
    first = _first_row(cells)
    named = _share(F.size(F.filter(first, lambda c: present(c) & ~numeric(c))), F.size(first))
    rows, cols = F.size(cells), F.size(first)
    shape = F.when((rows < 2) | (cols < 2), 0.3).when((rows > 1000) | (cols > 50), 0.7).otherwise(1.0)
    return F.when(rows < 2, 0.5).otherwise((named + shape) / 2)


def data_types(cells: Column) -> Column:
    """Share of the columns whose filled body cells are nearly all numbers, or nearly none; an empty column is not consistent."""
    body, width = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), widest(cells)

    def counts(k: Column) -> Column:
        """Filled cells of a column, and numbers among them in the upper half of the long, in one pass over the rows."""

        def add(so_far: Column, row: Column) -> Column:
            cell = F.get(row, k)
            return F.when(present(cell), so_far + F.when(numeric(cell), (1 << 32) + 1).otherwise(F.lit(1))).otherwise(so_far)

        return F.aggregate(body, F.lit(0).cast("long"), add)

    def good(both: Column) -> Column:
        n, numbers = both.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright(both, 32)
        return (n > 0) & ((numbers > n * F.lit(0.8)) | (numbers < n * F.lit(0.2)))

    columns = F.filter(F.transform(F.sequence(F.lit(0), width - 1), counts), good)
    return F.when(F.size(cells) < 2, 0.5).when(width > 0, F.size(columns) / width).otherwise(0.0)


def size_score(cells: Column) -> Column:
    rows, cols = F.size(cells), F.size(_first_row(cells))
    return F.when(rows.between(2, 500) & cols.between(2, 30), 1.0).when((rows < 2) | (cols < 2), 0.1).when((rows > 1000) | (cols > 50), 0.6).otherwise(0.8)


#: Metrics with their weights, in the order in which they are added. Fixed values.
METRICS = {"completeness": (completeness, 0.3), "consistency": (consistency, 0.2), "structure": (structure, 0.2), "data_types": (data_types, 0.2), "size_appropriateness": (size_score, 0.1)}


def with_quality(grids: DataFrame) -> DataFrame:
    """``quality_metrics`` and their weighted sum, 0 below two rows."""
    scored = grids.withColumn("quality_metrics", F.struct(*(f(F.col(CELLS)).cast("double").alias(k) for k, (f, _) in METRICS.items())))
    total = F.lit(0.0)
    for k, (_, weight) in METRICS.items():
        total = total + F.col(f"quality_metrics.{k}") * weight
    return _once(scored, "quality_score", F.when(F.size(CELLS) >= 2, total).otherwise(0.0))


def quality_filter(grids: DataFrame, min_quality: float = 0.3, enforce: bool = True) -> DataFrame:
    return grids.where(F.col("quality_score") >= min_quality) if enforce else grids


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def numeric_share(body: Column) -> Column:
    flat = F.flatten(body)
    return _share(F.size(F.filter(flat, lambda c: F.coalesce(lenient_number(c), F.lit(False)))), F.size(flat))


def empty_share(body: Column) -> Column:
    flat = F.flatten(body)
    return _share(F.size(F.filter(flat, lambda c: ~present(c))), F.size(flat), 1.0)


def page_slice(pages: DataFrame, start: int | None = None, end: int | None = None, most: int | None = None) -> DataFrame:
    """Pages from ``start`` to ``end``, and of the whole only the first ``most``; None or 0 is no limit. A plain filter, so it reaches the scan."""
    for limit, test in ((start, F.col("page_number") >= F.lit(start)), (end, F.col("page_number") <= F.lit(end)), (most, F.col("page_number") <= F.lit(most))):
        pages = pages.where(test) if limit else pages
    return pages


def table_index(grids: DataFrame) -> DataFrame:
    """A running number per page over accepted candidates, in method order."""
    page = Window.partitionBy("doc_id", "page_number").orderBy("method_rank", "raw_index")
    return grids.withColumn("table_index", F.row_number().over(page))


def dedup(indexed: DataFrame) -> DataFrame:
    """The first of equal grids of a page; numbers keep their gaps."""
    same = Window.partitionBy("doc_id", "page_number", F.md5(F.to_json(CELLS))).orderBy("table_index")
    return indexed.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")


def table_filename(page: Column, index: Column, method: Column) -> Column:
    return F.format_string("table_p%03d_t%03d_%s.csv", page, index, method)
