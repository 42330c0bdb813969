"""Rule scoring of tables and images, and the facets of a type.

Rules are a small fixed relation of literals. A table's text is computed once in a projection and each type's score is one expression over it, built
as one text rather than call by call, so scoring is a narrow stage without shuffles; the best type is the first of the highest scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import rules
from gridloom.operators.grids import joined_text, with_text


def _text(value: str) -> str:
    return "r'" + value + "'"


def _met(words: list[str], column: str) -> str:
    """How many of some words a text has, as an expression over a literal array: small plans, whatever the vocabulary."""
    return f"size(filter(array({', '.join(map(_text, words))}), w -> contains({column}, w)))"


def _found(column: str, kind: str) -> str:
    """How many of a type's words are among the found ones."""
    return f"size(filter({column}, w -> w in ({', '.join(map(_text, rules.TABLE_TYPES[kind][0]))})))"


def _count(pattern: str) -> str:
    needed, count = rules.NEEDED.get(pattern), f"regexp_count(table_text, {_text(pattern)})"
    return f"if(contains(table_text, {_text(needed)}), {count}, 0)" if needed else count


def table_score(kind: str) -> str:
    """The score of a type, over the columns table_text, found and found_in_header."""
    counts = " + ".join(map(_count, rules.TABLE_TYPES[kind][1]))
    return f"{_found('found', kind)} * {rules.KEYWORD_SCORE} + {_found('found_in_header', kind)} * {rules.HEADER_SCORE} + ({counts}) * {rules.PATTERN_SCORE}"


def class_scores(grids: DataFrame) -> DataFrame:
    """A column ``scores``: (name, score) of each type, in tie order.

    Each word is sought once, whatever types have it, and in the header only where the table has it: the header's text begins the table's."""
    scores = ", ".join(f"named_struct('name', '{k}', 'score', {table_score(k)})" for k in rules.TABLE_TYPES)
    words = ", ".join(map(_text, sorted({w for words, _ in rules.TABLE_TYPES.values() for w in words})))
    found = with_text(grids).withColumn("found", F.expr(f"filter(array({words}), w -> contains(table_text, w))"))
    found = found.withColumn("found_in_header", F.expr("filter(found, w -> contains(header_text, w))"))
    return found.withColumn("scores", F.expr(f"array({scores})")).drop("found", "found_in_header")


def best(scores: Column, otherwise: str) -> Column:
    top = F.array_max(F.transform(scores, lambda s: s["score"]))
    return F.when(top > 0, F.get(F.filter(scores, lambda s: s["score"] == top), F.lit(0))["name"]).otherwise(otherwise)


def classify_tables(grids: DataFrame) -> DataFrame:
    return class_scores(grids).withColumn("table_type", best(F.col("scores"), rules.GENERAL_TABLE)).drop("scores", "table_text", "header_text")


def currency(text: Column) -> Column:
    return reduce(lambda out, c: F.when(text.contains(c[0]), c[1]).otherwise(out), reversed(rules.CURRENCIES), F.lit(None).cast("string"))


def units(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(rf"(?i)\b{u}\b"), F.lit(u)) for u in rules.UNITS)))


def fiscal_period(text: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in rules.PERIODS))


def tickers(text: Column) -> Column:
    """The first ten by name of the distinct symbols."""
    found = F.regexp_extract_all(text, F.lit(rules.TICKER), F.lit(0))
    return F.slice(F.array_sort(F.array_except(found, F.array(*map(F.lit, rules.NO_TICKERS)))), 1, rules.TICKER_LIMIT)


def has_p_values(text: Column) -> Column:
    return text.rlike(r"p\s*[<=]\s*0\.[0-9]+")


def has_intervals(text: Column) -> Column:
    return text.rlike(r"(?i)(CI|confidence\s*interval)")


def table_facets(typed: DataFrame) -> DataFrame:
    """The facets that the table's type has, null otherwise."""
    text, kind = joined_text(F.col("cells")), F.col("table_type")
    of = lambda types, facet: F.when(kind.isin(types), facet)
    return typed.select(
        "*", of(rules.CURRENCY_TYPES, currency(text)).alias("currency"), of(rules.UNIT_TYPES, units(text)).alias("units"), of(rules.PERIOD_TYPES, fiscal_period(text)).alias("fiscal_period"),
        of(rules.TICKER_TYPES, tickers(text)).alias("tickers"), of(rules.STATISTIC_TYPES, has_p_values(text)).alias("has_p_values"),
        of(rules.STATISTIC_TYPES, F.lit(False)).alias("has_error_bars"), of(rules.STATISTIC_TYPES, has_intervals(text)).alias("has_confidence_intervals"),
    )


def image_scores(images: DataFrame, vectors: Column | None = None) -> DataFrame:
    """``scores`` of images with text, width, height and edge_density; vectors: the drawings that count, if any do."""
    aspect = F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(0.0)
    known = images.withColumn("shape", F.struct(F.lower("text").alias("low"), aspect.alias("aspect"), F.coalesce((F.lit(0) if vectors is None else vectors) > rules.MANY_VECTORS, F.lit(False)).alias("many")))

    def score(words: list[str], edges: tuple[float, float], shape: tuple[float, float], vector: bool) -> str:
        within = lambda column, least, most, points: f"if(coalesce({column} between {least!r}D and {most!r}D, false), {points!r}D, 0D)"
        terms = [f"coalesce({_met(words, 'shape.low')}, 0) * {rules.WORD_SCORE!r}D", within("edge_density", *edges, rules.EDGE_SCORE), within("shape.aspect", *shape, rules.ASPECT_SCORE)]
        return " + ".join(terms + ([f"if(shape.many, {rules.VECTOR_SCORE!r}D, 0D)"] if vector else []))

    scores = ", ".join(f"named_struct('name', '{k}', 'score', {score(*r)})" for k, r in rules.IMAGE_TYPES.items())
    return known.withColumn("scores", F.expr(f"array({scores})")).drop("shape")


def classify_images(images: DataFrame, vectors: Column | None = None) -> DataFrame:
    return image_scores(images, vectors).withColumn("image_type", best(F.col("scores"), rules.GENERAL_IMAGE)).drop("scores")


def first_of(text: Column, choices: list[tuple[str, list[str]]], otherwise: str) -> Column:
    low = F.lower(text)
    return reduce(lambda out, c: F.when(reduce(lambda a, b: a | b, (low.contains(w) for w in c[1])), c[0]).otherwise(out), reversed(choices), F.lit(otherwise))


def exhibit_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), r"exhibit\s*([0-9]+)", 1), F.lit(""))


def centuries(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b(19|20)[0-9]{2}\b"), F.lit(1))


def scale(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, rules.SCALE, 0), F.lit(""))
