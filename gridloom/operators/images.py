"""Image metrics, filters and enhancement over gray pixels in row order, for images of any size.

``width`` is the length of a pixel row; without it an image is square. Means and variances are array expressions; kernels that look at neighbours
are Arrow batches, in which images of one shape are stacked. A null or empty image, or one that isn't whole rows of its width, has null
for every metric and stays as it is when enhanced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(0.0)


def size_filter(images: DataFrame, min_width: int = 100, min_height: int = 100) -> DataFrame:
    return images.where((F.col("width") >= min_width) & (F.col("height") >= min_height))


def vector_pages(images: DataFrame, threshold: int = 10) -> DataFrame:
    return images.where(F.col("vector_count") >= threshold)


def too_small(images: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, width, height, issue, severity) of images narrower or lower than ``least``."""
    return images.where((F.col("width") < least) | (F.col("height") < least)).select("doc_id", "width", "height", F.lit("too_small").alias("issue"), F.lit("warning").alias("severity"))


def numbered(pages: DataFrame) -> DataFrame:
    """One row per image of pages (doc_id, page_number, images), with its position on the page, from 1, as ``image_index``; rejected ones count too."""
    at = pages.select("doc_id", "page_number", F.posexplode("images").alias("at", "image"))
    return at.select("doc_id", "page_number", (F.col("at") + 1).alias("image_index"), "image.*")


def statistics(images: DataFrame, min_width: int = 100, min_height: int = 100, vector_threshold: int = 10) -> DataFrame:
    embedded, vector = (F.col("width") >= min_width) & (F.col("height") >= min_height), F.col("vector_count") >= vector_threshold
    return images.agg(
        F.count_if(embedded).alias("embedded_images"), F.count_if(vector).alias("vector_images"), F.count_distinct("page_number").alias("pages_with_images"),
        F.count_distinct(F.when(vector, F.col("page_number"))).alias("pages_with_vectors"),
    )


def text_rate(images: DataFrame) -> DataFrame:
    """Share of the images with recognised text, 0 of none."""
    return images.agg(F.round(F.coalesce(F.avg(F.coalesce((F.trim("text") != "").cast("double"), F.lit(0.0))), F.lit(0.0)), 6).alias("ocr_rate"))


def resolution(width: Column, height: Column) -> Column:
    n = width.cast("bigint") * height
    return F.when(n >= 2_073_600, 1.0).when(n >= 921_600, 0.8).when(n >= 307_200, 0.6).when(n >= 76_800, 0.4).otherwise(0.2)


def _sum(values: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + f(x.cast("bigint")))


def mean(pixels: Column) -> Column:
    return F.when(F.size(pixels) > 0, _sum(pixels).cast("double") / F.size(pixels))


def variance(values: Column) -> Column:
    """Population variance of whole numbers, from exact sums."""
    wide, n = (lambda x: x.cast("decimal(19,0)")), F.size(values)
    total = wide(_sum(values))
    return F.when(n > 0, (wide(_sum(values, lambda x: x * x)) * wide(n) - total * total).cast("double") / (n.cast("double") * n))


def _at_most_one(x: Column) -> Column:
    return F.when(x > 1, 1.0).otherwise(x)


def contrast(pixels: Column) -> Column:
    return _at_most_one(F.sqrt(variance(pixels)) / 127.5)


def brightness(pixels: Column) -> Column:
    return 1 - F.abs(mean(pixels) - 127.5) / 127.5


def gaussian_kernel(size: int = 5) -> np.ndarray:
    """The usual kernel of a size: sigma grows with it."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return x / x.sum()


#: Pixels in a stack; bounds a kernel's temporaries, but for an image that has more by itself.
STACK_PIXELS = 1 << 20


def _stacks(pixels: pd.Series, widths: pd.Series) -> Iterator[tuple[list[int], np.ndarray]]:
    """The images by shape, in stacks of floats with their rows; what isn't an image is in none."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (p, w) in enumerate(zip(pixels, widths, strict=True)):
        if p is None or not len(p):
            continue
        w = int(len(p) ** 0.5 + 1e-9) if w is None or pd.isna(w) else int(w)
        if w > 0 and len(p) % w == 0 and not np.isnan(np.asarray(p, float)).any():
            shapes.setdefault((len(p) // w, w), []).append(i)
    for (h, w), rows in shapes.items():
        step = max(1, STACK_PIXELS // (h * w))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            yield some, np.stack([np.asarray(pixels.iloc[i], float) for i in some]).reshape(len(some), h, w)


def _reflected(stack: np.ndarray, pad: int) -> np.ndarray:
    """Padded by reflection without repeating the edge, as often as a small image needs; a side of one pixel repeats it."""
    for axis in (1, 2):
        width = [(0, 0)] * 3
        width[axis] = (pad, pad)
        stack = np.pad(stack, width, mode="reflect" if stack.shape[axis] > 1 else "edge")
    return stack


def blurred(stack: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    wide, (_, h, w) = _reflected(stack, len(kernel) // 2), stack.shape
    rows = sum(k * wide[:, i : i + h, :] for i, k in enumerate(kernel))
    return sum(k * rows[:, :, i : i + w] for i, k in enumerate(kernel))


def sobel(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide, (_, h, w) = np.pad(stack, ((0, 0), (1, 1), (1, 1)), mode="edge"), stack.shape
    at = lambda r, c: wide[:, 1 + r : 1 + r + h, 1 + c : 1 + c + w]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    return gx, gy


def _spread(mask: np.ndarray) -> np.ndarray:
    """A mask and its eight neighbours."""
    wide, (_, h, w) = np.pad(mask, ((0, 0), (1, 1), (1, 1))), mask.shape
    return np.logical_or.reduce([wide[:, r : r + h, c : c + w] for r in range(3) for c in range(3)])


def edge_map(stack: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Canny's edges: gradients by Sobel, thinned along their direction in steps of 45 degrees, above ``low`` and connected to one above ``high``."""
    gx, gy = sobel(stack)
    size = np.abs(gx) + np.abs(gy)
    wide, (_, h, w) = np.pad(size, ((0, 0), (1, 1), (1, 1))), size.shape
    at = lambda r, c: wide[:, 1 + r : 1 + r + h, 1 + c : 1 + c + w]
    flat, steep = np.abs(gy) < np.tan(np.pi / 8) * np.abs(gx), np.abs(gy) > np.tan(3 * np.pi / 8) * np.abs(gx)
    rising = (gx < 0) != (gy < 0)
    before = np.select([flat, steep, rising], [at(0, -1), at(-1, 0), at(-1, 1)], at(-1, -1))
    after = np.select([flat, steep, rising], [at(0, 1), at(1, 0), at(1, -1)], at(1, 1))
    thin = (size > low) & (size > before) & np.where(flat | steep, size >= after, size > after)
    edges = thin & (size > high)
    while True:
        more = thin & _spread(edges)
        if (more == edges).all():
            return edges
        edges = more


def _number(kernel: Callable[[np.ndarray], np.ndarray]):
    """A kernel over stacks, as a function of pixels and widths."""

    @F.pandas_udf(T.DoubleType())
    def run(pixels: pd.Series, widths: pd.Series) -> pd.Series:
        out = np.full(len(pixels), np.nan)
        for rows, stack in _stacks(pixels, widths):
            out[rows] = kernel(stack)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run


def _width(width: Column | None) -> Column:
    return F.lit(None).cast("int") if width is None else width.cast("int")


def laplacian(stack: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours less four times the pixel; borders reflect without repeating the edge."""
    wide, (_, h, w) = _reflected(stack, 1), stack.shape
    return wide[:, :h, 1 : 1 + w] + wide[:, 2:, 1 : 1 + w] + wide[:, 1 : 1 + h, :w] + wide[:, 1 : 1 + h, 2:] - 4 * stack


def sharpness(pixels: Column | str, width: Column | None = None) -> Column:
    """A thousandth of the variance of the second derivative, 1 at most."""
    return _number(lambda stack: np.minimum(laplacian(stack).var((1, 2)) / 1000, 1))(pixels, _width(width))


def noise(pixels: Column | str, width: Column | None = None) -> Column:
    """1 less a fiftieth of the mean distance from the smoothed image, 0 at least."""
    return _number(lambda stack: np.maximum(1 - np.abs(stack - blurred(stack, gaussian_kernel())).mean((1, 2)) / 50, 0))(pixels, _width(width))


def edge_density(pixels: Column | str, width: Column | None = None) -> Column:
    """Share of the pixels that are edges."""
    return _number(lambda stack: edge_map(stack).mean((1, 2)))(pixels, _width(width))


def _cut(x: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(x, 0, 255))


def contrasted(stack: np.ndarray, factor: float) -> np.ndarray:
    """Away from the mean gray, in whole numbers."""
    gray = np.floor(stack.mean((1, 2), keepdims=True) + 0.5)
    return _cut(gray + factor * (stack - gray))


def sharpened(stack: np.ndarray, factor: float) -> np.ndarray:
    """Away from a smoothed image, in whole numbers; the border is not smoothed."""
    smooth, (_, h, w) = stack.copy(), stack.shape
    if h > 2 and w > 2:
        smooth[:, 1:-1, 1:-1] = np.floor(sum(stack[:, r : r + h - 2, c : c + w - 2] * (5 if r == c == 1 else 1) for r in range(3) for c in range(3)) / 13 + 0.5)
    return _cut(smooth + factor * (stack - smooth))


#: Enhancements by type. Fixed values.
ENHANCE = {**dict.fromkeys(("chart", "diagram", "table_image"), lambda s: sharpened(contrasted(s, 1.5), 2.0)), "screenshot": lambda s: sharpened(s, 1.3)}


def _lit(stack: np.ndarray) -> np.ndarray:
    gray = stack.mean((1, 2), keepdims=True)
    return _cut(stack * np.where(gray < 100, 1.2, np.where(gray > 155, 0.8, 1.0)))


def enhanced(pixels: Column | str, kind: Column | str, width: Column | None = None) -> Column:
    """Pixels after their type's enhancement: line art by contrast and sharpness, screenshots by sharpness, photographs by brightness, others as they are."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(pixels: pd.Series, kinds: pd.Series, widths: pd.Series) -> pd.Series:
        out = [None if p is None else [None if x != x else int(x) for x in p] for p in pixels]
        for name, kernel in {**ENHANCE, "photograph": _lit}.items():
            own = pd.Series([p if kind == name else None for p, kind in zip(pixels, kinds, strict=True)], dtype=object)
            for rows, stack in _stacks(own, widths):
                for i, new in zip(rows, kernel(stack).reshape(len(rows), -1).astype(int).tolist(), strict=True):
                    out[i] = new
        return pd.Series(out, dtype=object)

    return run(pixels, kind, _width(width))


def line_art(pixels: Column | str, width: Column | None = None) -> Column:
    """Contrast by 1.5 about the mean gray, then sharpness by 2; for charts, diagrams and tables."""
    return enhanced(pixels, F.lit("chart"), width)


def screen(pixels: Column | str, width: Column | None = None) -> Column:
    """Sharpness by 1.3; for screenshots."""
    return enhanced(pixels, F.lit("screenshot"), width)


def lit_up(pixels: Column) -> Column:
    """Dark images by 1.2, bright ones by 0.8, others as they are; for photographs."""
    by = lambda f: F.transform(pixels, lambda p: F.least(F.lit(255), F.floor(p * F.lit(f)).cast("int")))
    return F.when(mean(pixels) < 100, by(1.2)).when(mean(pixels) > 155, by(0.8)).otherwise(pixels)


SEGMENT = T.ArrayType(T.StructType([T.StructField(k, T.IntegerType()) for k in ("x1", "y1", "x2", "y2")]))


def edge_segments(pixels: Column | str, width: Column | None = None, least: int = 100, gap: int = 10) -> Column:
    """Segments (x1, y1, x2, y2) along rows and columns of the edge map: runs of ``least`` pixels or more with gaps of ``gap`` at most.

    A deterministic stand-in for a randomised line transform; only lines along the axes are counted from it."""

    @F.pandas_udf(SEGMENT)
    def run(pixels: pd.Series, widths: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(pixels), dtype=object)
        for rows, stack in _stacks(pixels, widths):
            for i, edges in zip(rows, edge_map(stack), strict=True):
                found = [{"x1": a, "y1": y, "x2": b, "y2": y} for y, a, b in _runs(edges, least, gap)]
                out.iat[i] = found + [{"x1": x, "y1": a, "x2": x, "y2": b} for x, a, b in _runs(edges.T, least, gap)]
        return out

    return run(pixels, _width(width))


def _runs(edges: np.ndarray, least: int, gap: int) -> Iterator[tuple[int, int, int]]:
    """(row, first, last) of the runs of each row."""
    for k in np.flatnonzero(edges.sum(1) * (gap + 1) >= least):
        at = np.flatnonzero(edges[k])
        for part in np.split(at, np.flatnonzero(np.diff(at) > gap + 1) + 1):
            if part[-1] - part[0] + 1 >= least:
                yield int(k), int(part[0]), int(part[-1])


def grid_lines(segments: Column) -> tuple[Column, Column]:
    """Horizontal and vertical counts among line segments (x1, y1, x2, y2)."""
    return F.size(F.filter(segments, lambda s: F.abs(s["y1"] - s["y2"]) < 5)), F.size(F.filter(segments, lambda s: F.abs(s["x1"] - s["x2"]) < 5))


def straight_runs(pixels: Column | str, width: Column | None = None, dark: int = 64, scale: int = 10) -> Column:
    """Segments of rows and columns that are dark throughout, ``scale`` apart; for drawings of ruled tables."""

    @F.pandas_udf(SEGMENT)
    def run(pixels: pd.Series, widths: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(pixels), dtype=object)
        for rows, stack in _stacks(pixels, widths):
            _, h, w = stack.shape
            for i, a in zip(rows, stack < dark, strict=True):
                across = [{"x1": 0, "y1": k * scale, "x2": w * scale, "y2": k * scale} for k in np.flatnonzero(a.all(1)).tolist()]
                out.iat[i] = across + [{"x1": k * scale, "y1": 0, "x2": k * scale, "y2": h * scale} for k in np.flatnonzero(a.all(0)).tolist()]
        return out

    return run(pixels, _width(width))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _gray(data: pd.Series, channels: pd.Series) -> pd.Series:
    out = []
    for blob, n in zip(data, channels, strict=True):
        flat = None if blob is None or n not in (1, 3, 4) or len(blob) % int(n) else np.frombuffer(blob, np.uint8).astype(np.int64).reshape(-1, int(n))
        out.append(None if flat is None else (flat[:, 0] if n == 1 else (flat[:, 2] * 19595 + flat[:, 1] * 38470 + flat[:, 0] * 7471 + 0x8000) >> 16).astype(np.int32))
    return pd.Series(out, dtype=object)


def gray(data: Column | str, channels: Column | str) -> Column:
    """Gray pixels of an image source's bytes (blue, green, red order), by the usual weights of the three colours; null where they aren't an image."""
    return _gray(data, channels)


@F.pandas_udf(T.StructType([T.StructField("variance", T.DoubleType()), T.StructField("means", T.ArrayType(T.DoubleType()))]))
def _colors(data: pd.Series, channels: pd.Series) -> pd.DataFrame:
    found = []
    for blob, n in zip(data, channels, strict=True):
        flat = None if not blob or n not in (1, 3, 4) or len(blob) % int(n) else np.frombuffer(blob, np.uint8).astype(float).reshape(-1, int(n))
        found.append((None, None) if flat is None else (float(flat.var()), flat.mean(0)[[0] if n == 1 else [2, 1, 0, 3][: int(n)]].tolist()))
    return pd.DataFrame(found, columns=["variance", "means"])


def colors(data: Column | str, channels: Column | str) -> Column:
    """Variance of all of an image source's bytes, and their means by channel (red, green, blue and alpha, or gray)."""
    return _colors(data, channels)


#: Metrics and weights, in the order in which they are added. Fixed values.
WEIGHTS = {"resolution": 0.3, "sharpness": 0.2, "contrast": 0.2, "brightness": 0.2, "noise": 0.1}


def with_quality(images: DataFrame, pixel_width: Column | None = None) -> DataFrame:
    px = F.col("pixels")
    scored = images.withColumns(
        {"resolution": resolution(F.col("width"), F.col("height")), "sharpness": sharpness(px, pixel_width), "contrast": contrast(px), "brightness": brightness(px), "noise": noise(px, pixel_width)}
    )
    total = F.lit(0.0)
    for k, weight in WEIGHTS.items():
        total = total + F.col(k) * weight
    return scored.withColumn("quality_score", total)


def quality_filter(scored: DataFrame, min_quality: float = 0.3) -> DataFrame:
    return scored.where(F.col("quality_score") >= min_quality)


def image_filename(page: Column, method: Column, index: Column, kind: Column) -> Column:
    return F.when(method == "vector_render", F.format_string("page_%d_vector_%s.png", page, kind)).otherwise(F.format_string("page_%d_img_%d_%s.png", page, index, kind))


def ocr_text(first: Column, second: Column) -> Column:
    """The first engine's text, or the second's where it is blank."""
    return F.coalesce(F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(second), F.lit("")), F.lit(""))


def records(typed: DataFrame, limit: int | None = 50, enhance: bool = True) -> DataFrame:
    """Packaged image records; ``within_limit`` marks the first of them by document. enhancement_applied records the setting, as it does for types without one."""
    out = typed.select(
        "doc_id", F.col("page_number").alias("page"), F.col("image_index").alias("index"), "image_type", "width", "height", (F.col("text") != "").alias("has_text"), F.col("text").alias("text_content"), "vector_count",
        F.lit(enhance).alias("enhancement_applied"),
    )
    if limit is None:
        return out.withColumn("within_limit", F.lit(True))
    first = typed.select("doc_id", "page_number", "image_index").orderBy("doc_id", "page_number", "image_index").limit(max(0, limit)).select("doc_id", F.col("page_number").alias("page"), F.col("image_index").alias("index"), F.lit(True).alias("within"))
    return out.join(F.broadcast(first), ["doc_id", "page", "index"], "left").select(*out.columns, F.coalesce("within", F.lit(False)).alias("within_limit"))


def is_vector_render(images: DataFrame, threshold: int = 10) -> Column:
    return F.when(F.col("vector_count") >= threshold, "vector_render").otherwise("embedded")
