"""All queries of the engine, by name, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import rules
from gridloom import extract
from gridloom.operators import catalog, classify, grids, images, layout
from gridloom.plans.oracle import ORACLES as _SQL
from gridloom.sources import files
from gridloom.sources import tables as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = _SQL


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _show(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda row: F.array_join(row, "|", "~")), "\n")


def _keyed(df: DataFrame, *more: Column) -> DataFrame:
    return df.select("doc_id", "page_number", "method", *more)


def _grid(df: DataFrame, *more: Column) -> DataFrame:
    return _keyed(df, *more, _show(F.col("cells")).alias("grid"))


def f1(spark: SparkSession, d: str) -> DataFrame:
    return src.order_grids(src.read(spark, d, "lineitem"))


def f2(spark: SparkSession, d: str) -> DataFrame:
    return src.pipe_grids(src.read(spark, d, "documents"))


def f3(spark: SparkSession, d: str) -> DataFrame:
    return src.line_grids(src.read(spark, d, "documents"))


def f4(spark: SparkSession, d: str) -> DataFrame:
    return src.nav_grids(src.read(spark, d, "pages"))


def f5(spark: SparkSession, d: str) -> DataFrame:
    return src.vocabulary_grids(src.read(spark, d, "orders"))


def f6(spark: SparkSession, d: str) -> DataFrame:
    return src.synthetic_images(src.read(spark, d, "embeddings"))


def f7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = src.read(spark, d, "pages")
    return src.text_blocks(pages), src.image_boxes(pages)


def f8(spark: SparkSession, d: str) -> DataFrame:
    return src.csv_files(f1(spark, d))


def two_methods(spark: SparkSession, d: str) -> DataFrame:
    """Order grids, a third of them found by a second method as well; both from one reading, whose shuffle by order serves the windows on pages too."""
    first = F.struct("method", "method_rank")
    again = F.struct(F.lit("stream").alias("method"), F.lit(3).alias("method_rank"))
    methods = F.when(F.col("doc_id") % 3 == 0, F.array(first, again)).otherwise(F.array(first))
    return f1(spark, d).select("doc_id", "page_number", F.inline(methods), "raw_index", "cells")


def cataloged(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog(two_methods(spark, d))


def typed_images(spark: SparkSession, d: str) -> DataFrame:
    """Classified with the measured edge density."""
    return classify.classify_images(f6(spark, d).withColumn("edge_density", images.edge_density("pixels")), F.col("vector_count"))


@query
def src_order_grid(spark, d):
    return _grid(f1(spark, d))


@query
def src_pipe_grid(spark, d):
    return _grid(f2(spark, d))


@query
def src_line_grid(spark, d):
    return _keyed(f3(spark, d), F.md5(_show(F.col("cells"))).alias("grid_md5"))


@query
def src_nav_grid(spark, d):
    return _grid(f4(spark, d))


@query
def method_union(spark, d):
    every = f1(spark, d).unionByName(f2(spark, d)).unionByName(f3(spark, d)).unionByName(f4(spark, d))
    return every.groupBy("method").agg(F.count("*").alias("n_grids"), F.sum(F.size("cells")).alias("n_rows"), F.sum(F.size(F.flatten("cells"))).alias("n_cells"))


@query
def clean_cells(spark, d):
    return _grid(grids.clean_cells(f1(spark, d)))


@query
def drop_empty_rows(spark, d):
    return _keyed(grids.clean(f3(spark, d)), F.size("cells").alias("n_rows"), F.md5(_show(F.col("cells"))).alias("grid_md5"))


@query
def pad_rows(spark, d):
    return _grid(grids.pad_rows(grids.clean(f1(spark, d))))


@query
def promote_header(spark, d):
    return _grid(grids.promote_header(grids.clean(f1(spark, d))), F.array_join("header", "|").alias("header"))


@query
def table_text(spark, d):
    return _keyed(grids.with_text(grids.clean(f5(spark, d))), F.col("table_text"), F.col("header_text"))


@query
def valid_grid(spark, d):
    return grids.valid(f3(spark, d).unionByName(f2(spark, d))).select("doc_id", "method", F.size("cells").alias("n_rows"))


@query
def page_slice(spark, d):
    return grids.page_slice(f1(spark, d), start=2, most=5).select("doc_id", "page_number", F.size("cells").alias("n_rows"))


def _metric(fixture, name: str, f) -> None:
    def run(spark, d):
        return grids.clean(fixture(spark, d)).select("doc_id", F.round(f(F.col("cells")).cast("double"), 6).alias(name))

    QUERIES["q_size" if name == "size_appropriateness" else f"q_{name}"] = run


for _name, _fixture in (("completeness", f1), ("consistency", f3), ("structure", f1), ("data_types", f1), ("size_appropriateness", f3)):
    _metric(_fixture, _name, grids.METRICS[_name][0])


@query
def table_quality(spark, d):
    return grids.with_quality(grids.clean(grids.valid(f5(spark, d)))).select("doc_id", F.round("quality_score", 6).alias("quality_score"))


@query
def quality_filter(spark, d):
    scored = grids.with_quality(grids.clean(grids.valid(f1(spark, d))))
    return grids.quality_filter(scored, 0.85).select("doc_id", F.round("quality_score", 6).alias("quality_score"))


@query
def quality_band(spark, d):
    return catalog.histogram(grids.with_quality(grids.clean(f1(spark, d))), grids.quality_band(F.col("quality_score")), "band")


@query
def class_scores(spark, d):
    scores = classify.class_scores(grids.clean(f5(spark, d)))
    return scores.select("doc_id", *(F.col("scores")[i]["score"].alias(k) for i, k in enumerate(rules.TABLE_TYPES)))


@query
def classify_table(spark, d):
    return classify.classify_tables(grids.clean(f5(spark, d))).select("doc_id", "table_type")


@query
def table_facets(spark, d):
    found = classify.table_facets(classify.classify_tables(grids.clean(f5(spark, d))))
    return found.select("doc_id", "table_type", "currency", F.array_join("units", ",").alias("units"), "fiscal_period", F.array_join("tickers", ",").alias("tickers"))


def _facet(name: str, **columns) -> None:
    def run(spark, d):
        texts = grids.clean(f5(spark, d)).select("doc_id", grids.joined_text(F.col("cells")).alias("text"))
        return texts.select("doc_id", *(f(F.col("text")).alias(k) for k, f in columns.items()))

    QUERIES[name] = run


_facet("facet_currency", currency=classify.currency)
_facet("facet_units", units=lambda t: F.array_join(classify.units(t), ","))
_facet("facet_fiscal", fiscal_period=classify.fiscal_period)
_facet("facet_tickers", tickers=lambda t: F.array_join(classify.tickers(t), ","))
_facet("facet_stats", has_p_values=classify.has_p_values, has_confidence_intervals=classify.has_intervals)


@query
def numeric_pct(spark, d):
    return cataloged(spark, d).select("doc_id", "table_index", F.round("numeric_percentage", 6).alias("numeric_percentage"))


@query
def empty_pct(spark, d):
    return cataloged(spark, d).select("doc_id", "table_index", F.round("empty_cell_percentage", 6).alias("empty_cell_percentage"))


@query
def table_index(spark, d):
    return grids.table_index(two_methods(spark, d)).select("doc_id", "page_number", "method", "table_index")


@query
def dedup_grids(spark, d):
    return cataloged(spark, d).select("doc_id", "page_number", "table_index", "method")


@query
def table_filename(spark, d):
    return cataloged(spark, d).select("doc_id", "filename")


@query
def table_catalog(spark, d):
    rounded = ("quality_score", "numeric_percentage", "empty_cell_percentage")
    return cataloged(spark, d).withColumns({c: F.round(c, 6) for c in rounded})


@query
def type_histogram(spark, d):
    return catalog.type_histogram(cataloged(spark, d))


@query
def ranked_types(spark, d):
    return catalog.ranked(catalog.type_histogram(cataloged(spark, d)), "table_type")


@query
def ranked_methods(spark, d):
    return catalog.ranked(catalog.histogram(grids.valid(two_methods(spark, d)), "method", "method"), "method")


@query
def filtered_count(spark, d):
    return catalog.filtered_count(grids.with_quality(grids.clean(grids.valid(f1(spark, d)))), 0.85)


@query
def enforced_catalog(spark, d):
    """The catalog with the quality filter enforced: numbers count what passes."""
    return catalog.catalog(two_methods(spark, d), 0.85, enforce=True).select("doc_id", "page_number", "table_index", "method", "table_type", F.round("quality_score", 6).alias("quality_score"))


@query
def throughput(spark, d):
    return catalog.throughput(f1(spark, d), 60)


@query
def quality_histogram(spark, d):
    return catalog.histogram(cataloged(spark, d), grids.quality_band(F.col("quality_score")), "band")


@query
def method_histogram(spark, d):
    return catalog.histogram(grids.valid(two_methods(spark, d)), "method", "method")


@query
def doc_stats(spark, d):
    return catalog.doc_stats(cataloged(spark, d))


@query
def topk_tables(spark, d):
    return catalog.largest(cataloged(spark, d)).select("doc_id", "page_number", "table_index", "size_bytes")


@query
def limit_items(spark, d):
    return catalog.limit_items(cataloged(spark, d), 25, "doc_id", "page_number", "table_index").select("doc_id", "table_index", "filename")


@query
def verify_files(spark, d):
    return catalog.verify_files(f8(spark, d))


@query
def verify_missing(spark, d):
    listed = f8(spark, d)
    return catalog.missing_files(listed, listed.where("on_disk"))


@query
def verify_summary(spark, d):
    return catalog.verification_summary(catalog.verification(f8(spark, d)))


@query
def first_critical(spark, d):
    return catalog.first_critical(catalog.verification(f8(spark, d)))


@query
def verify_unparseable(spark, d):
    """Files with faults that a parser meets: nothing but line breaks, a row wider than the first, a quote left open."""
    n = F.col("doc_id") % 4
    spoilt = F.when(n == 0, "\n\r\n").when(n == 1, F.concat("content", F.lit("1,2,3,4,5,6,7,8\n"))).when(n == 2, F.concat("content", F.lit('"open,\n'))).otherwise(F.col("content"))
    return catalog.verify_files(f8(spark, d).where("content <> ''").withColumn("content", spoilt))


@query
def verify_images(spark, d):
    return images.too_small(f6(spark, d))


@query
def csv_roundtrip(spark, d):
    """Grids written as delimited text and read again; ``same`` says whether a grid came back. Every third has a cell that must be quoted."""
    odd = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit('say "$1,234.50",\r\nplease'), F.lit(""))).otherwise(F.array(F.lit("plain"), F.lit("x")))
    given = grids.pad_rows(grids.clean(f1(spark, d))).select("doc_id", "page_number", F.concat(F.array(F.array_append(F.get("cells", F.lit(0)), F.lit("Note"))), F.transform(F.slice("cells", 2, F.size("cells")), lambda row: F.concat(row, odd))).alias("cells"))
    named = given.withColumn("name", F.format_string("t%d.csv", F.col("doc_id")))
    path = files.scratch(spark)
    files.write_grids(named, f"{path}/tables")
    back = files.read_grids(spark, f"{path}/tables").withColumnRenamed("cells", "back")
    return named.join(back, "name", "left").select("doc_id", F.size("back").alias("n_rows"), F.coalesce(F.col("back") == F.col("cells"), F.lit(False)).alias("same"))


@query
def csv_export(spark, d):
    """What the sink writes: each grid's text."""
    padded = grids.pad_rows(grids.clean(f1(spark, d))).select("doc_id", F.col("doc_id").cast("string").alias("name"), F.transform("cells", lambda row: F.transform(row, lambda c: F.replace(c, F.lit("."), F.lit(',"')))).alias("cells"))
    return files.table_files(padded).select("name", F.octet_length("content").alias("size_bytes"), F.md5("content").alias("content_md5"))


@query
def package_tables(spark, d):
    return catalog.package_files(f8(spark, d).where("on_disk")).withColumn("content_md5", F.md5("content")).drop("content")


@query
def package_semi_join(spark, d):
    listed = f8(spark, d)
    return listed.join(listed.where("on_disk").select("name"), "name", "left_semi").select("name")


@query
def package_images(spark, d):
    return images.records(typed_images(spark, d), 50)


@query
def public_url(spark, d):
    name = catalog.stamped(F.col("name"), F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.col("doc_id") % 28 + 1).cast("int"), F.lit(9), F.lit(30), F.lit(5)))
    return f8(spark, d).where("on_disk").select("name", catalog.public_url(F.lit("https://store.example/"), F.lit("files"), name).alias("url"))


@query
def base64_fallback(spark, d):
    return f8(spark, d).where("on_disk").select("name", catalog.base64_fallback(F.col("doc_id") % 2 == 0, F.col("content")).alias("content_base64"))


@query
def envelope(spark, d):
    return catalog.envelope(cataloged(spark, d), f6(spark, d))


@query
def metadata_doc(spark, d):
    return catalog.metadata_document(cataloged(spark, d).withColumn("quality_score", F.round("quality_score", 6)))


@query
def blocks_scan(spark, d):
    return f7(spark, d)[0]


@query
def caption_join(spark, d):
    return layout.captions(*f7(spark, d))


@query
def surrounding_text(spark, d):
    return layout.surrounding_text(*f7(spark, d)).withColumn("surrounding_text", F.array_join("surrounding_text", "|"))


@query
def page_title(spark, d):
    return layout.page_titles(f7(spark, d)[0])


@query
def page_preview(spark, d):
    return layout.page_previews(layout.page_texts(f7(spark, d)[0]))


@query
def exhibits(spark, d):
    return layout.exhibits(f6(spark, d)).withColumn("exhibits_mentioned", F.array_join("exhibits_mentioned", ","))


@query
def img_scan(spark, d):
    """Pixels as a three-channel image source's bytes, read as gray."""
    data = F.unhex(F.array_join(F.transform("pixels", lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    wide = F.unhex(F.array_join(F.transform("pixels", lambda p: F.concat(F.lpad(F.hex(p), 2, "0"), F.lpad(F.hex(255 - p), 2, "0"), F.lpad(F.hex(F.floor(p / 2)), 2, "0"))), ""))
    packed = f6(spark, d).select("doc_id", data.alias("data"), wide.alias("wide"))
    read = packed.select("doc_id", images.gray("data", F.lit(1)).alias("gray"), images.gray("wide", F.lit(3)).alias("mixed"))
    return read.select("doc_id", F.size("gray").alias("n_pixels"), F.array_join(F.col("gray").cast("array<string>"), ",").alias("gray"), F.array_join(F.col("mixed").cast("array<string>"), ",").alias("mixed"))


@query
def img_color(spark, d):
    wide = F.unhex(F.array_join(F.transform("pixels", lambda p: F.concat(F.lpad(F.hex(p), 2, "0"), F.lpad(F.hex(255 - p), 2, "0"), F.lpad(F.hex(F.floor(p / 2)), 2, "0"))), ""))
    found = f6(spark, d).select("doc_id", wide.alias("wide")).select("doc_id", images.colors("wide", F.lit(3)).alias("color"))
    return found.select("doc_id", F.round("color.variance", 6).alias("color_variance"), *(F.round(F.col("color.means")[k], 6).alias(f"mean_{c}") for k, c in enumerate(("red", "green", "blue"))))


@query
def image_index(spark, d):
    """Twenty images a document, numbered on their pages, small ones too."""
    per_page = f6(spark, d).groupBy(F.floor(F.col("doc_id") / 20).alias("doc"), "page_number").agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("vec_id"), "width", "height"))).alias("images"))
    return images.numbered(per_page.withColumnRenamed("doc", "doc_id"))


@query
def img_geometry(spark, d):
    return f6(spark, d).select("doc_id", "width", "height", F.round(images.aspect_ratio(F.col("width"), F.col("height")), 6).alias("aspect_ratio"))


@query
def img_size_filter(spark, d):
    return images.size_filter(f6(spark, d)).select("doc_id", "width", "height")


@query
def img_quality_filter(spark, d):
    return images.quality_filter(images.with_quality(f6(spark, d)), 0.5).select("doc_id", F.round("quality_score", 6).alias("quality_score"))


@query
def vector_page_filter(spark, d):
    return images.vector_pages(f6(spark, d)).select("doc_id", "page_number", "vector_count")


@query
def image_union(spark, d):
    every = f6(spark, d)
    embedded = images.size_filter(every).select("doc_id", F.lit("embedded").alias("method"), "image_index", F.lit(None).cast("string").alias("vector_count"))
    return embedded.unionByName(images.vector_pages(every).select("doc_id", F.lit("vector_render").alias("method"), F.lit(1).alias("image_index"), F.col("vector_count").cast("string").alias("vector_count")))


@query
def image_filename(spark, d):
    typed = typed_images(spark, d)
    return typed.select("doc_id", images.image_filename(F.col("page_number"), images.is_vector_render(typed), F.col("image_index"), F.col("image_type")).alias("filename"))


@query
def ocr_coalesce(spark, d):
    first, second = F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.when(F.col("doc_id") % 3 == 0, "second")
    return f6(spark, d).select("doc_id", images.ocr_text(first, second).alias("ocr_text"))


def _image_metric(name: str, f) -> None:
    def run(spark, d):
        return f6(spark, d).select("doc_id", F.round(f(), 6).alias(name))

    QUERIES[f"img_{name}"] = run


_image_metric("resolution", lambda: images.resolution(F.col("width"), F.col("height")))
_image_metric("contrast", lambda: images.contrast(F.col("pixels")))
_image_metric("brightness", lambda: images.brightness(F.col("pixels")))
_image_metric("sharpness", lambda: images.sharpness(F.col("pixels")))
_image_metric("noise", lambda: images.noise("pixels"))
_image_metric("edge_density", lambda: images.edge_density("pixels"))


@query
def img_quality(spark, d):
    return images.with_quality(f6(spark, d)).select("doc_id", F.round("quality_score", 6).alias("quality_score"))


@query
def img_gridlines(spark, d):
    found = f6(spark, d).select("doc_id", images.straight_runs("pixels", dark=200).alias("segments"))
    rows, columns = images.grid_lines(F.col("segments"))
    return found.select("doc_id", rows.alias("estimated_rows"), columns.alias("estimated_columns"))


@query
def img_segments(spark, d):
    """Lines along the axes of the edge map, of six pixels or more."""
    found = f6(spark, d).select("doc_id", images.edge_segments("pixels", least=6, gap=1).alias("segments"))
    rows, columns = images.grid_lines(F.col("segments"))
    return found.select("doc_id", rows.alias("estimated_rows"), columns.alias("estimated_columns"))


@query
def classify_image(spark, d):
    return typed_images(spark, d).select("doc_id", "image_type")


@query
def facet_chart(spark, d):
    t = F.col("text")
    return typed_images(spark, d).where("image_type = 'chart'").select(
        "doc_id", classify.first_of(t, rules.CHARTS, "unknown").alias("chart_type"), classify.exhibit_number(t).alias("exhibit_number"), F.array_join(classify.centuries(t), ",").alias("years_referenced")
    )


@query
def facet_diagram(spark, d):
    return typed_images(spark, d).where("image_type = 'diagram'").select("doc_id", classify.first_of(F.col("text"), rules.DIAGRAMS, "general_diagram").alias("diagram_type"))


@query
def facet_scientific(spark, d):
    t = F.col("text")
    return typed_images(spark, d).where("image_type = 'scientific_figure'").select("doc_id", classify.first_of(t, rules.FIGURES, "general_scientific").alias("figure_type"), classify.scale(t).alias("scale"))


@query
def image_stats(spark, d):
    return images.statistics(f6(spark, d))


@query
def ocr_rate(spark, d):
    return images.text_rate(f6(spark, d))


@query
def enhance_brightness(spark, d):
    return f6(spark, d).select("doc_id", F.array_join(images.lit_up(F.col("pixels")).cast("array<string>"), ",").alias("pixels"))


def _pixels(column: Column) -> Column:
    return F.array_join(column.cast("array<string>"), ",").alias("pixels")


@query
def enhance_line_art(spark, d):
    return f6(spark, d).select("doc_id", images.line_art("pixels").alias("p")).select("doc_id", _pixels(F.col("p")))


@query
def enhance_screenshot(spark, d):
    return f6(spark, d).select("doc_id", images.screen("pixels").alias("p")).select("doc_id", _pixels(F.col("p")))


@query
def enhance_by_type(spark, d):
    return typed_images(spark, d).select("doc_id", "image_type", images.enhanced("pixels", "image_type").alias("p")).select("doc_id", "image_type", _pixels(F.col("p")))


@query
def extract_tables(spark, d):
    return extract.extract_tables(two_methods(spark, d), extract.TableOptions(page_start=2, page_max=6, limit=1000)).records.select("doc_id", "page_number", "table_index", "filename")


@query
def extract_images(spark, d):
    return extract.extract_images(f6(spark, d), extract.ImageOptions(page_limit=9, limit=200)).records.select("doc_id", "page_number", "method", "image_type", "filename")


@query
def extract_all(spark, d):
    """As extract_images does, whose statistics it returns."""
    return extract.extract_all(f6(spark, d), extract.ImageOptions(page_limit=9)).statistics
