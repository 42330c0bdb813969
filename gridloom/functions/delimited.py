"""Quoted delimited text: lines of cells out of grids as column expressions, and grids out of whole texts."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell(value: Column, delimiter: str = ",") -> Column:
    """A cell as it is written: null as nothing, and in quotes, doubled inside, what has a delimiter, a quote or a line break."""
    text = F.coalesce(value, F.lit(""))
    return F.when(text.rlike(f'[\\Q{delimiter}\\E"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def line(cells: Column, delimiter: str = ",") -> Column:
    """A row as it is written; one empty cell is quoted, so that the line isn't blank."""
    joined = F.array_join(F.transform(cells, lambda c: cell(c, delimiter)), delimiter)
    return F.when((joined == "") & (F.size(cells) == 1), F.lit('""')).otherwise(joined)


def text(cells: Column, delimiter: str = ",", ending: str = "\n") -> Column:
    return F.array_join(F.transform(cells, lambda row: F.concat(line(row, delimiter), F.lit(ending))), "")


def parse(content: str | None, delimiter: str = ",") -> tuple[list[list[str]] | None, str | None]:
    """The rows of a text, and what is wrong with it: ``empty`` without any row, ``error`` with a row wider than the first or a quote left open."""
    if content is None:
        return None, "error"
    try:
        rows = [r for r in csv.reader(io.StringIO(content, newline=""), delimiter=delimiter, strict=True) if r]
    except csv.Error:
        return None, "error"
    if not rows or all(not "".join(r).strip() for r in rows) and "\"" not in content and delimiter not in content:
        return [], "empty"
    return rows, "error" if any(len(r) > len(rows[0]) for r in rows) else None


csv.field_size_limit(2**31 - 1)


def grid(content: Column | str, delimiter: str = ",") -> Column:
    """The cells of a delimited text: rows of strings, blank lines left out; null where it doesn't parse."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([parse(c, delimiter)[0] for c in contents], dtype=object)

    return run(content)


@F.pandas_udf(T.StructType([T.StructField("fault", T.StringType()), T.StructField("n_rows", T.IntegerType()), T.StructField("n_columns", T.IntegerType())]))
def _facts(contents: pd.Series) -> pd.DataFrame:
    out = []
    for c in contents:
        rows, fault = parse(c)
        out.append((fault, len(rows or []), len(rows[0]) if rows else 0))
    return pd.DataFrame(out, columns=["fault", "n_rows", "n_columns"])


def facts(content: Column | str) -> Column:
    """(fault, n_rows, n_columns) of a delimited text: ``empty``, ``error`` or null; its rows with the header; the width of its first row."""
    return _facts(content)
