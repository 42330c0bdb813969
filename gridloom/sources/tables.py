"""Adapters that turn tables, text and markup into the engine's relations. Each is a projection, at most with one aggregate on its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Orders in a page of `vocabulary_grids`, and the width of the key ranges in which it numbers them.
GRID_ORDERS, ORDER_RANGE = 20, 1 << 14


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(df: DataFrame, doc_id: Column, page: Column, method: str, rank: int, cells: Column, raw_index: Column | int = 1) -> DataFrame:
    index = F.lit(raw_index) if isinstance(raw_index, int) else raw_index
    return df.select(doc_id.alias("doc_id"), page.cast("int").alias("page_number"), F.lit(method).alias("method"), F.lit(rank).alias("method_rank"), index.cast("int").alias("raw_index"), cells.alias("cells"))


def _money(x: Column) -> Column:
    return x.cast("decimal(18,2)").cast("string")


def _row(*cells: Column | str) -> Column:
    return F.array(*(F.lit(c) if isinstance(c, str) else c for c in cells))


def order_grids(lineitem: DataFrame, method: str = "lines", rank: int = 1) -> DataFrame:
    """One grid per order: a header and its lines, every fifth line cut short."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("lines"))

    def cells(x: Column) -> Column:
        short = [x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")]
        shipped = F.concat(F.lit("  "), F.date_format(x["l_shipdate"], "yyyy-MM-dd"), F.lit("  "), x["l_returnflag"])
        discount = F.when(x["l_discount"] != 0, _money(x["l_discount"]))
        return F.when(x["l_linenumber"] % 5 == 0, F.array(*short)).otherwise(F.array(*short, _money(x["l_quantity"]), _money(x["l_extendedprice"]), discount, shipped))

    header = F.array(_row("Line", "Part", "Quantity", "Extended Price", "Discount", "Shipped"))
    return _grid(lines, F.col("l_orderkey"), F.col("l_orderkey") % 7 + 1, method, rank, F.concat(header, F.transform("lines", cells)))


def pipe_grids(documents: DataFrame) -> DataFrame:
    """One grid per document with pipe-delimited lines."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.contains("|"))
    return _grid(documents.where(F.col("text").contains("|")), F.col("doc_id"), F.lit(1), "text", 2, F.transform(lines, lambda x: F.split(x, r"\|")))


def line_grids(documents: DataFrame) -> DataFrame:
    """One grid per document: its lines, cut at each space."""
    return _grid(documents.where("text is not null"), F.col("doc_id"), F.lit(1), "stream", 3, F.transform(F.split("text", "\n"), lambda x: F.split(x, " ")))


def nav_grids(pages: DataFrame) -> DataFrame:
    """One two-column grid per page: targets and labels of its list links."""
    item = r'<li><a href="([^"]*)">([^<]*)'
    links, labels = (F.regexp_extract_all("html", F.lit(item), F.lit(k)) for k in (1, 2))
    return _grid(pages, F.col("page_id"), F.lit(1), "markup", 4, F.zip_with(links, labels, lambda a, b: F.array(a, b)))


def vocabulary_grids(orders: DataFrame) -> DataFrame:
    """Grids of each customer's orders, metric, amount, period: a page for every twenty orders.

    Orders are numbered within key ranges and the ranges' counts are summed up, so a customer with most of the orders isn't one task's work."""
    named = orders.select("o_custkey", F.floor(F.col("o_orderkey") / ORDER_RANGE).alias("range"), F.struct("o_orderkey", "o_totalprice", F.year("o_orderdate").cast("string").alias("year")).alias("order"))
    before = Window.partitionBy("o_custkey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = named.groupBy("o_custkey", "range").agg(F.count("*").alias("n")).select(F.col("o_custkey").alias("key"), F.col("range").alias("key_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("o_custkey", "range").orderBy("order")) + F.col("before") - 1
    paged = named.join(ranges, F.col("o_custkey").eqNullSafe(F.col("key")) & F.col("range").eqNullSafe(F.col("key_range"))).select("o_custkey", F.floor(nth / GRID_ORDERS + 1).alias("page"), "order")
    own = paged.groupBy("o_custkey", "page").agg(F.array_sort(F.collect_list("order")).alias("orders"))
    which, prefix = F.col("o_custkey") % 9, F.col("o_custkey") % 4

    def phrase(year: Column) -> Column:
        names = ["Total assets", "Free cash flow", "Current ratio", "Control sample p < 0.05 n = 12", "Phase 3 placebo", "Close price ACME", "Scope 1 emissions", "Sector weight"]
        out = F.when(which == 0, F.concat(F.lit("Net income Q2 "), year))
        for k, name in enumerate(names, 1):
            out = out.when(which == k, name)
        return out

    mark = F.when(prefix == 0, "$").when(prefix == 1, "CHF ").when(prefix == 2, "Rs ").otherwise("")
    row = lambda x: F.array(phrase(x["year"]), F.concat(mark, F.format_number(x["o_totalprice"], 2)), F.concat(F.lit("FY"), x["year"]))
    return _grid(own, F.col("o_custkey"), F.col("page"), "lines", 1, F.concat(F.array(_row("Metric", "Amount", "Period")), F.transform("orders", row)))


def synthetic_images(embeddings: DataFrame) -> DataFrame:
    """An 8 by 8 gray image per vector, with a declared size, recognised text and a count of vector drawings."""
    key = F.col("vec_id")
    said = [
        F.concat(F.lit("Exhibit "), key.cast("string"), F.lit(" bar chart revenue 2019 axis")), F.lit("process flow step arrow"), F.concat(F.lit("Figure "), key.cast("string"), F.lit(" western blot 50 nm")),
        F.lit("table row column grid"), F.lit("menu button window"), F.lit("logo brand"), F.lit(""), F.lit("line trend data 1987 and 2021"),
    ]
    text = F.when(key % 8 == 0, said[0])
    for k in range(1, 8):
        text = text.when(key % 8 == k, said[k])
    return embeddings.select(
        key.alias("doc_id"), (key % 11 + 1).cast("int").alias("page_number"), F.lit(1).alias("image_index"), F.lit("embedded").alias("method"),
        (8 * (1 + key % 300)).cast("int").alias("width"), (8 * (1 + (key * 7) % 200)).cast("int").alias("height"),
        F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 1000) % 256).cast("int")).alias("pixels"), text.alias("text"), ((key * 11) % 97).cast("int").alias("vector_count"),
    )


def text_blocks(pages: DataFrame) -> DataFrame:
    """Positioned blocks: the text after each heading or paragraph tag, every fourth one a figure caption."""
    said = F.regexp_extract_all("html", F.lit("<(?:h1|p)>([^<]*)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(said).alias("block_no", "said"))
    x0, y0 = (50 + (F.col("page_id") * 7 + F.col("block_no") * 13) % 90).cast("double"), (F.col("block_no") * 60).cast("double")
    text = F.when(F.col("block_no") % 4 == 3, F.concat(F.lit("Figure "), F.col("block_no").cast("string"), F.lit(": "), F.col("said"))).otherwise(F.col("said"))
    return rows.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), "block_no", x0.alias("x0"), y0.alias("y0"), (x0 + 300).alias("x1"), (y0 + 40).alias("y1"), text.alias("text"))


def image_boxes(pages: DataFrame) -> DataFrame:
    """Two boxes per page."""
    rows = pages.select("page_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    y0, y1 = (60 * (4 * F.col("k") - 2)).cast("double"), (60 * (4 * F.col("k") - 1) - 15).cast("double")
    return rows.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), F.col("k").alias("image_index"), F.lit(60.0).alias("x0"), y0.alias("y0"), F.lit(260.0).alias("x1"), y1.alias("y1"))


def csv_files(grids: DataFrame) -> DataFrame:
    """One file per grid, with the faults that verification looks for."""
    key = F.col("doc_id")
    ending = F.when(key % 5 == 0, F.lit("\r\n")).otherwise("\n")
    line = lambda row: F.concat(F.array_join(row, ",", ""), ending)
    lines = F.transform("cells", line)
    content = F.when(key % 11 == 0, "").when(key % 7 == 0, F.concat(F.array_join(F.get("cells", F.lit(0)), ",", ""), F.lit("\n"))).otherwise(F.array_join(lines, ""))
    return grids.select(key, F.format_string("table_p%03d_t001_lines_%d.csv", F.col("page_number"), key).alias("name"), content.alias("content"), (key % 13 != 0).alias("on_disk"))
