"""Joins of text blocks with image boxes, and page context. Band conditions stand beside equi keys, so no join is a product of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import rules

PAGE = ["doc_id", "page_number"]


def _near(blocks: DataFrame, boxes: DataFrame) -> tuple[DataFrame, object]:
    """Boxes with the blocks of their page, and whether a block is where a caption would be."""
    b, i = blocks.alias("b"), boxes.alias("i")
    pairs = i.join(b, [F.col(f"i.{k}") == F.col(f"b.{k}") for k in PAGE], "left")
    below = (F.col("b.y0") > F.col("i.y1")) & (F.col("b.y0") - F.col("i.y1") < 50) & (F.abs(F.col("b.x0") - F.col("i.x0")) < 100)
    return pairs, below


def captions(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """The last caption below each box, and the figure it names; null where there is none."""
    pairs, below = _near(blocks, boxes)
    text = F.trim("b.text")
    hit = F.when(F.coalesce(below & text.rlike(rules.CAPTION), F.lit(False)), F.struct(F.col("b.block_no").alias("block_no"), text.alias("text")))
    found = pairs.groupBy("i.doc_id", "i.page_number", "i.image_index").agg(F.max(hit).alias("hit"))
    return found.select(*PAGE, "image_index", F.col("hit.text").alias("caption"), F.nullif(F.regexp_extract("hit.text", rules.REFERENCE, 0), F.lit("")).alias("figure_reference"))


def surrounding_text(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """The blocks near each box that aren't in caption position, in order."""
    pairs, below = _near(blocks, boxes)
    near = (F.abs(F.col("b.y0") - F.col("i.y0")) < 100) | (F.abs(F.col("b.y1") - F.col("i.y1")) < 100)
    rows = pairs.groupBy("i.doc_id", "i.page_number", "i.image_index").agg(F.array_sort(F.collect_list(F.when(near & ~below, F.struct("b.block_no", F.trim("b.text").alias("text"))))).alias("near"))
    return rows.select(*PAGE, "image_index", F.transform("near", lambda x: x["text"]).alias("surrounding_text"))


def page_titles(blocks: DataFrame) -> DataFrame:
    """Of a page's first three blocks the first of 11 to 99 characters."""
    first = blocks.where("block_no < 3").groupBy(*PAGE).agg(F.min(F.when(F.length(F.trim("text")).between(11, 99), F.struct("block_no", F.trim("text").alias("text")))).alias("hit"))
    return first.select(*PAGE, F.col("hit.text").alias("page_title"))


def page_texts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("all")).select(*PAGE, F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"))


def page_previews(texts: DataFrame, most: int = 200) -> DataFrame:
    return texts.select(*PAGE, F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text")).alias("page_text_preview"))


def exhibits(texts: DataFrame) -> DataFrame:
    """The distinct exhibits that a page mentions, sorted."""
    return texts.select(*PAGE, F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(rules.EXHIBIT), F.lit(0)))).alias("exhibits_mentioned"))
