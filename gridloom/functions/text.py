"""Column expressions over cells: white space, printable characters, numbers, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and non-printable characters by code point, spelt so that Java and RE2 read the same class. Fixed values.
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
NON_PRINTABLE = r"[\p{C}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
NUMERIC = r"^-?[0-9]+\.?[0-9]*$"
#: What a lenient number parser takes.
LENIENT_NUMBER = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?)\s*$"


def clean_cell(cell: Column) -> Column:
    """White space trimmed and collapsed, then non-printables deleted; null is empty. Printable ASCII, most cells, takes neither pattern."""
    collapsed = F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), f"{WS}+", " "))
    ascii_only = F.trim(F.regexp_replace(cell, " {2,}", " "))
    return F.when(~cell.rlike("[^!-~]"), cell).when(~cell.rlike("[^ -~]"), ascii_only).otherwise(F.regexp_replace(collapsed, f"{NON_PRINTABLE}+", ""))


def non_empty(cell: Column) -> Column:
    """Whether there is anything but white space; a first character of visible ASCII settles it by two comparisons of bytes."""
    return F.when((cell >= "!") & (cell < "\x7f"), True).otherwise(F.coalesce(cell.rlike(NOT_WS), F.lit(False)))


def present(cell: Column) -> Column:
    return F.coalesce(cell != "", F.lit(False))


def numeric(cell: Column) -> Column:
    return F.trim(cell).rlike(NUMERIC)


def lenient_number(cell: Column) -> Column:
    """Whether a lenient parser reads the cell as a number; a literal beyond double's range is none."""
    return cell.rlike(LENIENT_NUMBER) & (F.lower(cell).contains("inf") | ~F.coalesce(F.abs(cell.try_cast("double")) == float("inf"), F.lit(False)))
