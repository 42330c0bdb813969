"""Schemas of the engine's relations."""

from __future__ import annotations

GRID = "doc_id bigint, page_number int, method string, method_rank int, raw_index int, cells array<array<string>>"
QUALITY = "struct<completeness:double,consistency:double,structure:double,data_types:double,size_appropriateness:double>"
IMAGE = "doc_id bigint, page_number int, image_index int, method string, width int, height int, pixels array<int>, text string, vector_count int"
BLOCK = "doc_id bigint, page_number int, block_no int, x0 double, y0 double, x1 double, y1 double, text string"
BOX = "doc_id bigint, page_number int, image_index int, x0 double, y0 double, x1 double, y1 double"
FILE = "doc_id bigint, name string, content string, on_disk boolean"
