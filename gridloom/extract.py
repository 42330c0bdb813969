"""The engine's front door: candidates and options in, records, statistics and issues out.

`extract_tables` takes candidate grids, `extract_images` images with pixels and text; both return plain DataFrames that are computed when they are
read. Page ranges are filters that reach the scan; a limit holds by document, page and index, after everything else.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import catalog, classify, grids, images


@dataclass(frozen=True)
class TableOptions:
    """min_quality counts only where the filter is enforced; 0 or None is no page limit, and None no limit of items."""

    min_quality: float = 0.3
    enforce_quality: bool = False
    verify: bool = True
    page_start: int | None = None
    page_end: int | None = None
    page_max: int | None = None
    limit: int | None = None


@dataclass(frozen=True)
class ImageOptions:
    """Embedded images must pass size and quality, pages with enough vector drawings pass as they are rendered."""

    min_width: int = 100
    min_height: int = 100
    min_quality: float = 0.3
    vector_threshold: int = 10
    recognise: bool = True
    enhance: bool = True
    page_limit: int | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Result:
    records: DataFrame
    statistics: DataFrame
    issues: DataFrame


def _set(options) -> dict:
    return {k: v for k, v in asdict(options).items() if v is not None}


def extract_tables(candidates: DataFrame, options: TableOptions | None = None, present: DataFrame | None = None) -> Result:
    """Cataloged tables. present: (name) of the files on disk, against which a verification holds the catalog."""
    o = options or TableOptions()
    pages = grids.page_slice(candidates, o.page_start, o.page_end, o.page_max)
    found = catalog.limit_items(catalog.catalog(pages, o.min_quality, o.enforce_quality), o.limit, "doc_id", "page_number", "table_index")
    statistics = catalog.ranked(catalog.type_histogram(found), "table_type")
    listed = found.select(F.col("filename").alias("name"))
    issues = catalog.missing_files(listed, listed.limit(0) if present is None else present)
    return Result(found, statistics, issues if o.verify and present is not None else issues.limit(0))


def table_documents(tables: DataFrame, options: TableOptions | None = None) -> DataFrame:
    """(doc_id, document): the metadata documents of a catalog."""
    return catalog.metadata_document(tables, _set(options or TableOptions()))


def extract_images(found: DataFrame, options: ImageOptions | None = None) -> Result:
    """Classified images (`schemas.IMAGE`): embedded ones and vector renders, enhanced by type, with file names."""
    o = options or ImageOptions()
    pages = found.where(F.col("page_number") <= F.lit(o.page_limit)) if o.page_limit else found
    if not o.recognise:
        pages = pages.withColumn("text", F.lit(""))
    pages = pages.withColumn("edge_density", images.edge_density("pixels"))
    embedded = images.quality_filter(images.with_quality(images.size_filter(pages, o.min_width, o.min_height)), o.min_quality)
    embedded = classify.classify_images(embedded.withColumn("method", F.lit("embedded")))
    if o.enhance:
        embedded = embedded.withColumn("pixels", images.enhanced("pixels", "image_type"))
    rendered = classify.classify_images(images.vector_pages(pages, o.vector_threshold).withColumns({"method": F.lit("vector_render"), "image_index": F.lit(1)}), F.col("vector_count"))
    both = embedded.unionByName(rendered, allowMissingColumns=True)
    named = both.withColumn("filename", images.image_filename(F.col("page_number"), F.col("method"), F.col("image_index"), F.col("image_type"))).withColumn("enhancement_applied", F.lit(o.enhance))
    kept = catalog.limit_items(named, o.limit, "doc_id", "page_number", "image_index", "method")
    return Result(kept, images.statistics(pages, o.min_width, o.min_height, o.vector_threshold), images.too_small(pages))


def extract_all(found: DataFrame, options: ImageOptions | None = None) -> Result:
    """Images alone, as the combined route has it."""
    return extract_images(found, options)
