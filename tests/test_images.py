from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import extract
from gridloom.operators import images, layout

SIZES = [(8, 8), (8, 8), (5, 11), (1, 7), (9, 1), (1, 1), (2, 3), (40, 30)]
PIXELS = "doc_id int, pixels array<int>, w int"


@pytest.fixture(scope="module")
def arrays():
    """Images of several sizes: noise, blocks and lines, so that there are weak and strong edges."""
    rng, out = np.random.default_rng(3), []
    for k, (h, w) in enumerate(SIZES * 3):
        a = rng.integers(0, 256, (h, w)) if k % 3 else np.where(rng.random((h, w)) < 0.3, 200, 90) + rng.integers(0, 20, (h, w))
        if k % 2 and h > 3:
            a[h // 2] = 20
        out.append(a)
    return out


@pytest.fixture(scope="module")
def frame(spark, arrays):
    rows = [(i, a.ravel().tolist(), a.shape[1]) for i, a in enumerate(arrays)]
    return spark.createDataFrame([*rows, (900, None, 4), (901, [], 4), (902, [1, 2, 3], 2), (903, [1, None, 3, 4], 2), (904, [1, 2], 0)], PIXELS)


def around(a, r, c, mode):
    """The pixel at a place that may lie outside: the nearest one, or the mirrored one."""

    def back(k, n):
        if mode == "edge" or n == 1:
            return min(max(k, 0), n - 1)
        while not 0 <= k < n:
            k = -k if k < 0 else 2 * (n - 1) - k
        return k

    return float(a[back(r, a.shape[0]), back(c, a.shape[1])])


def over(a, f):
    return np.array([[f(r, c) for c in range(a.shape[1])] for r in range(a.shape[0])])


def canny(a, low=50, high=150):
    """Edges pixel by pixel."""
    at = lambda r, c: around(a, r, c, "edge")
    gx = over(a, lambda r, c: sum(k * (at(r + i, c + 1) - at(r + i, c - 1)) for i, k in ((-1, 1), (0, 2), (1, 1))))
    gy = over(a, lambda r, c: sum(k * (at(r + 1, c + i) - at(r - 1, c + i)) for i, k in ((-1, 1), (0, 2), (1, 1))))
    size = abs(gx) + abs(gy)
    m = lambda r, c: size[r, c] if 0 <= r < a.shape[0] and 0 <= c < a.shape[1] else 0

    def thin(r, c):
        if size[r, c] <= low:
            return False
        angle = np.degrees(np.arctan2(abs(gy[r, c]), abs(gx[r, c])))
        if angle < 22.5:
            return size[r, c] > m(r, c - 1) and size[r, c] >= m(r, c + 1)
        if angle > 67.5:
            return size[r, c] > m(r - 1, c) and size[r, c] >= m(r + 1, c)
        s = -1 if (gx[r, c] < 0) != (gy[r, c] < 0) else 1
        return size[r, c] > m(r - 1, c - s) and size[r, c] > m(r + 1, c + s)

    kept = over(a, thin)
    todo = [(r, c) for r in range(a.shape[0]) for c in range(a.shape[1]) if kept[r, c] and size[r, c] > high]
    found = set(todo)
    while todo:
        r, c = todo.pop()
        for p in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if 0 <= p[0] < a.shape[0] and 0 <= p[1] < a.shape[1] and kept[p] and p not in found:
                found.add(p)
                todo.append(p)
    return over(a, lambda r, c: (r, c) in found)


def test_metrics_of_any_size(arrays, frame):
    c, w = F.col("pixels"), F.col("w")
    rows = frame.select("doc_id", images.contrast(c).alias("contrast"), images.brightness(c).alias("brightness"), images.sharpness(c, w).alias("sharpness"), images.noise("pixels", w).alias("noise"), images.edge_density("pixels", w).alias("edges"))
    found = {r.doc_id: r for r in rows.collect()}
    k = images.gaussian_kernel()
    for i, a in enumerate(arrays):
        at = lambda r, c, a=a: around(a, r, c, "mirror")
        lap = over(a, lambda r, c: at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * at(r, c))
        smooth = over(a, lambda r, c: sum(k[x] * k[y] * at(r + x - 2, c + y - 2) for x in range(5) for y in range(5)))
        r = found[i]
        assert r.contrast == pytest.approx(min(a.std() / 127.5, 1)) and r.brightness == pytest.approx(1 - abs(a.mean() - 127.5) / 127.5)
        assert r.sharpness == pytest.approx(min(lap.var() / 1000, 1)) and r.noise == pytest.approx(max(1 - np.abs(a - smooth).mean() / 50, 0))
        assert r.edges == pytest.approx(canny(a).mean())
    assert found[900][1:] == (None,) * 5 and found[901][1:] == (None,) * 5
    for i in (902, 904):
        assert found[i][3:] == (None,) * 3
    assert found[903][4:] == (None,) * 2


def test_squares_need_no_width(arrays, frame):
    square = frame.where("doc_id < 900").where(F.size("pixels") == F.col("w") * F.col("w"))
    c, w = F.col("pixels"), F.col("w")
    for row in square.select(images.sharpness(c), images.sharpness(c, w), images.noise(c), images.noise(c, w), images.edge_density(c), images.edge_density(c, w)).collect():
        assert row[::2] == row[1::2]


def test_edges_are_thin(spark):
    df = spark.createDataFrame([(0, [100] * 64), (1, [0] * 32 + [255] * 32)], "doc_id int, pixels array<int>")
    assert [r[0] for r in df.orderBy("doc_id").select(images.edge_density("pixels")).collect()] == [0, 8 / 64]


def test_enhancement(arrays, frame):
    kinds = ["chart", "screenshot", "photograph", "logo"]
    named = frame.withColumn("kind", F.element_at(F.array(*map(F.lit, kinds)), F.col("doc_id") % 4 + 1))
    found = {r.doc_id: r.p for r in named.select("doc_id", images.enhanced("pixels", "kind", F.col("w")).alias("p")).collect()}

    def cut(x):
        return np.floor(np.clip(x, 0, 255))

    def sharp(a, f):
        inner = lambda r, c: 0 < r < a.shape[0] - 1 and 0 < c < a.shape[1] - 1
        smooth = over(a, lambda r, c: np.floor((a[r - 1 : r + 2, c - 1 : c + 2].sum() + 4 * a[r, c]) / 13 + 0.5) if inner(r, c) else a[r, c])
        return cut(smooth + f * (a - smooth))

    for i, a in enumerate(arrays):
        a = a.astype(float)
        gray = np.floor(a.mean() + 0.5)
        want = {"chart": lambda: sharp(cut(gray + 1.5 * (a - gray)), 2.0), "screenshot": lambda: sharp(a, 1.3), "photograph": lambda: cut(a * (1.2 if a.mean() < 100 else 0.8 if a.mean() > 155 else 1)), "logo": lambda: a}[kinds[i % 4]]()
        assert found[i] == want.ravel().tolist()
    assert found[900] is None and found[901] == [] and found[902] == [1, 2, 3]


def test_lines(spark):
    a = np.full((40, 60), 255)
    a[10, 5:50], a[30, 5:25], a[2:38, 20] = 0, 0, 0
    df = spark.createDataFrame([(a.ravel().tolist(), 60), (None, 60)], "pixels array<int>, w int")
    rows = [r.s for r in df.select(images.edge_segments("pixels", F.col("w"), least=30, gap=4).alias("s")).collect()]
    assert {(s.y1, s.y2) for s in rows[0] if s.y1 == s.y2} == {(9, 9), (11, 11)} and {s.x1 for s in rows[0] if s.x1 == s.x2} == {19, 21} and rows[1] is None
    b = np.full((4, 6), 255)
    b[1], b[:, 2] = 0, 0
    lines = images.grid_lines(images.straight_runs(F.col("pixels"), F.col("w")))
    assert spark.createDataFrame([(b.ravel().tolist(), 6)], "pixels array<int>, w int").select(*lines).first()[:] == (1, 1)


def test_bytes(spark):
    rng = np.random.default_rng(1)
    rows = [(n, bytearray(rng.integers(0, 256, 12 * max(n, 1)).tolist())) for n in (1, 3, 4)] + [(3, bytearray(b"ab")), (2, bytearray(b"ab")), (None, None)]
    found = spark.createDataFrame(rows, "n int, data binary").select("n", "data", images.gray("data", "n").alias("g"), images.colors("data", "n").alias("c")).collect()
    for r, (n, data) in zip(found, rows[:3], strict=False):
        a = np.array(list(data)).reshape(-1, n)
        assert r.g == (a[:, 0] if n == 1 else (a[:, 2] * 19595 + a[:, 1] * 38470 + a[:, 0] * 7471 + 32768) // 65536).tolist()
        assert r.c.variance == pytest.approx(a.var()) and r.c.means == pytest.approx(a.mean(0)[{1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[n]].tolist())
    assert all(r.g is None and r.c.variance is None for r in found[3:])


def test_extract_images(spark):
    def image(doc, page, index, w, h, vectors, text="axis"):
        return (doc, page, index, "embedded", w, h, [0, 255] * 32, text, vectors)

    rows = [image(1, 1, 1, 200, 200, 0), image(1, 1, 2, 50, 200, 0), image(1, 2, 1, 300, 300, 60), image(2, 9, 1, 300, 300, 60), image(3, 1, 1, 9, 9, 0, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, page_number int, image_index int, method string, width int, height int, pixels array<int>, text string, vector_count int")
    found = extract.extract_images(df, extract.ImageOptions(page_limit=5, limit=3))
    assert [(r.doc_id, r.page_number, r.method, r.enhancement_applied) for r in found.records.orderBy("doc_id", "page_number", "method").collect()] == [(1, 1, "embedded", True), (1, 2, "embedded", True), (1, 2, "vector_render", True)]
    assert found.statistics.first()[:] == (2, 1, 2, 1) and [r.doc_id for r in found.issues.collect()] == [3]
    assert extract.extract_all(df.limit(0)).records.count() == 0


def test_captions(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 60.0, 0.0, 260.0, 100.0), (2, 1, 1, 60.0, 0.0, 260.0, 100.0)], "doc_id bigint, page_number int, image_index int, x0 double, y0 double, x1 double, y1 double")
    rows = [(1, 1, 0, 60.0, 110.0, 300.0, 120.0, "Figure 1: a"), (1, 1, 1, 60.0, 140.0, 300.0, 150.0, "Figure. 2 b"), (1, 1, 2, 60.0, 120.0, 300.0, 130.0, "no caption"), (1, 1, 3, 60.0, 50.0, 300.0, 60.0, " near ")]
    blocks = spark.createDataFrame(rows, "doc_id bigint, page_number int, block_no int, x0 double, y0 double, x1 double, y1 double, text string")
    found = {r.doc_id: r for r in layout.captions(blocks, boxes).collect()}
    assert (found[1].caption, found[1].figure_reference) == ("Figure. 2 b", None) and found[2].caption is None
    near = {r.doc_id: r.surrounding_text for r in layout.surrounding_text(blocks, boxes).collect()}
    assert near == {1: ["near"], 2: []}
