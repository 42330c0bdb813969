"""The catalog of accepted tables, its histograms, verification and packaging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import delimited
from gridloom.operators import classify, grids


def catalog(candidates: DataFrame, min_quality: float = 0.3, enforce: bool = False) -> DataFrame:
    """Valid candidates cleaned, numbered, de-duplicated, scored, classified, with the share of numeric and empty cells of their padded bodies.

    Numbers count accepted candidates, so scores come before them only where the filter is enforced; what is dropped as a duplicate is neither
    scored nor classified otherwise."""
    accepted = grids.clean(grids.valid(candidates))
    if enforce:
        accepted = grids.quality_filter(grids.with_quality(accepted), min_quality)
    unique = grids.dedup(grids.table_index(accepted)).where(F.size("cells") > 0)
    unique = classify.classify_tables(unique if enforce else grids.with_quality(unique))
    width = grids.widest(F.col("cells"))
    body = grids.promote_header(grids.pad_rows(unique.withColumn("n_rows", F.size("cells")).withColumn("n_columns", width)))
    return body.select(
        "doc_id", "page_number", "table_index", "method", "table_type", "quality_score", F.col("n_rows").alias("rows"), F.col("n_columns").alias("columns"), F.lit(True).alias("has_headers"),
        grids.numeric_share(F.col("cells")).alias("numeric_percentage"), grids.empty_share(F.col("cells")).alias("empty_cell_percentage"),
        grids.table_filename(F.col("page_number"), F.col("table_index"), F.col("method")).alias("filename"),
        (F.aggregate(F.concat(F.array("header"), F.col("cells")), F.lit(0), lambda n, row: n + F.octet_length(F.array_join(row, ",")) + 1)).cast("bigint").alias("size_bytes"),
    )


def histogram(df: DataFrame, column: Column | str, name: str) -> DataFrame:
    return df.groupBy((F.col(column) if isinstance(column, str) else column).alias(name)).agg(F.count("*").alias("n"))


def ranked(counts: DataFrame, name: str) -> DataFrame:
    """A histogram's rows by falling count, then name, with their ``place``; a row a type, so one task sorts them."""
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), name))).orderBy("place")


def type_histogram(tables: DataFrame) -> DataFrame:
    return tables.groupBy("table_type").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("avg_quality"))


def filtered_count(scored: DataFrame, min_quality: float = 0.3) -> DataFrame:
    """How many scored candidates pass the quality filter and how many it drops."""
    good = F.coalesce(F.col("quality_score") >= min_quality, F.lit(False))
    return scored.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("filtered"))


def throughput(pages: DataFrame, seconds: float) -> DataFrame:
    """Distinct pages a second; null in no time."""
    return pages.agg(F.round(F.try_divide(F.count_distinct("doc_id", "page_number").cast("double"), F.lit(float(seconds))), 6).alias("pages_per_second"))


def doc_stats(tables: DataFrame) -> DataFrame:
    return tables.groupBy("doc_id").agg(F.count("*").alias("n_tables"), F.count_distinct("page_number").alias("n_pages"), F.round(F.avg("quality_score"), 6).alias("avg_quality"))


def largest(tables: DataFrame, n: int = 10) -> DataFrame:
    return tables.orderBy(F.desc("size_bytes"), "doc_id", "page_number", "table_index").limit(n)


def limit_items(items: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` by a total order; a negative limit keeps nothing, None everything."""
    return items if n is None else items.orderBy(*order).limit(max(0, n))


def _issue(test: Column, issue: str, severity: str, detail: Column | None = None) -> Column:
    return F.when(test, F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), (F.lit(None).cast("string") if detail is None else detail).alias("detail")))


def verify_files(files: DataFrame, max_columns: int = 100) -> DataFrame:
    """(doc_id, name, issue, severity, detail) of the files on disk; an empty or unparseable file has no other issue."""
    text = F.col("content")
    feeds, returns = F.regexp_count(text, F.lit("\n")), F.regexp_count(text, F.lit("\r\n"))
    filled, width, fault = text != "", F.col("facts.n_columns"), F.coalesce("facts.fault", F.lit(""))
    parsed = filled & (fault == "")
    issues = F.array_compact(
        F.array(
            _issue(~filled, "empty_file", "critical"),
            _issue(filled & (fault == "empty"), "pandas_empty_data", "critical"),
            _issue(text.isNull() | filled & (fault == "error"), "read_error", "critical"),
            _issue(parsed & (F.col("facts.n_rows") < 2), "no_data", "warning"),
            _issue(parsed & (width > max_columns), "too_many_columns", "warning", width.cast("string")),
            _issue(parsed & (returns > 0), "mixed_line_endings", "minor", F.concat((feeds - returns).cast("string"), F.lit("/"), returns.cast("string"))),
            _issue(parsed & (feeds <= 1), "single_line_file", "critical"),
        )
    )
    present = files.where("on_disk").withColumn("facts", delimited.facts("content"))
    return present.select("doc_id", "name", F.inline(issues))


def verification(files: DataFrame) -> DataFrame:
    """(name, issue, severity) of all files: faults of those on disk, and those that are listed and missing."""
    return verify_files(files).select("name", "issue", "severity").unionByName(missing_files(files, files.where("on_disk")))


def verification_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "issue").agg(F.count("*").alias("n"))


def first_critical(issues: DataFrame, n: int = 5) -> DataFrame:
    """The critical ones among the first ``n`` issues by name and issue, as a report shows them."""
    return issues.orderBy("name", "issue").limit(n).where("severity = 'critical'")


def missing_files(listed: DataFrame, present: DataFrame) -> DataFrame:
    return listed.join(present.select("name"), "name", "left_anti").select("name", F.lit("file_missing").alias("issue"), F.lit("critical").alias("severity"))


def package_files(files: DataFrame) -> DataFrame:
    """Row count with the header, width of the first row, and the content."""
    read = files.withColumn("facts", delimited.facts("content"))
    return read.select("name", F.col("facts.n_rows").alias("n_rows"), F.col("facts.n_columns").alias("n_columns"), F.octet_length("content").alias("size_bytes"), "content")


def stamped(name: Column, at: Column) -> Column:
    """An upload's name: the UTC time before the file's name."""
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), name)


def public_url(base: Column, bucket: Column, name: Column) -> Column:
    return F.concat_ws("/", F.rtrim(base, F.lit("/")), F.lit("storage/v1/object/public"), bucket, name)


def base64_fallback(uploaded: Column, content: Column) -> Column:
    """The content inline where the upload failed, null otherwise."""
    return F.when(~uploaded, F.regexp_replace(F.base64(content.cast("binary")), "[\r\n]", ""))


def envelope(tables: DataFrame, images: DataFrame) -> DataFrame:
    both = tables.select(F.lit(1).alias("t"), F.lit(0).alias("i")).union(images.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("tables_count"), F.coalesce(F.sum("i"), F.lit(0)).alias("images_count")).select(
        (F.col("tables_count") + F.col("images_count")).alias("count"), "tables_count", "images_count", F.lit(True).alias("success")
    )


def metadata_document(tables: DataFrame, configuration: dict | None = None) -> DataFrame:
    """One JSON document per source document: its records in order, counts, and the configuration where one is given."""
    record = F.struct("page_number", "table_index", "table_type", "quality_score", "filename")
    own = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(record)).alias("tables"))
    parts = ["doc_id", *([F.struct(*(F.lit(v).alias(k) for k, v in configuration.items())).alias("configuration")] if configuration else []), F.size("tables").alias("tables_extracted"), "tables"]
    return own.select("doc_id", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("document"))
