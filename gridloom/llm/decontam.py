"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-cased words with one space between. An item of m characters may differ from a passage by k = m * ``percent`` // 100
edits. Split into k + 1 pieces, one piece at least is unharmed in such a passage; all pieces are looked for in one pass over each whole document,
by hashes of their first bytes and then byte for byte, and each hit is verified with Myers' bit-parallel distance around it.

Items are read to the driver in blocks of ``block_bytes`` of text (some hundred thousand items), each broadcast on its own: one block is one pass
over the corpus, and what is broadcast is bounded whatever the benchmark's size.

Defined cases: null or empty items and texts match nothing; items so short that no edit is allowed must be found as whole words;
repeated documents and items each give rows; a document with several passages of an item gives its nearest, the first of ties; ids have the
inputs' types; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from gridloom.llm.common import mix, release, slices

PERCENT, BLOCK_BYTES = 5, 1 << 26


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def distances(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to a part of ``text``, and where the first such part ends; None if over ``most``."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, ch in enumerate(text, 1):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = score, j
    return best


def _windows(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on; ``size`` is a power of two up to 16."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    return _hashed(np.lib.stride_tricks.sliding_window_view(data, size))


def _hashed(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    word = min(rows.shape[1], 8)
    at = lambda k: np.ascontiguousarray(rows[:, k : k + word]).view(f"<u{word}").ravel().astype(np.uint64)
    return mix(mix(at(0)) ^ at(8)) if rows.shape[1] == 16 else mix(at(0))


class _Pieces:
    """Pieces that begin with ``size`` bytes, by the hash of these."""

    def __init__(self, size: int, rows: list[tuple[bytes, int, int]]):
        hashes = _hashed(np.frombuffer(b"".join(r[0][:size] for r in rows), np.uint8).reshape(-1, size))
        order = np.argsort(hashes, kind="stable")
        self.size, self.rows = size, [rows[i] for i in order.tolist()]
        self.keys, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(rows)).tolist()
        self.shift = np.uint64(64 - max(16, min(27, 4 + len(self.keys).bit_length())))
        self.may = np.zeros(1 << (64 - int(self.shift)), bool)
        self.may[self.keys >> self.shift] = True

    def hits(self, data: np.ndarray, raw: bytes):
        """(position, item, offset in the item) of each piece found."""
        hashes = _windows(data, self.size)
        at = np.flatnonzero(self.may[hashes >> self.shift])
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[place] == hashes[at]
        for pos, k in zip(at[same].tolist(), place[same].tolist(), strict=True):
            for piece, item, offset in self.rows[self.first[k] : self.first[k + 1]]:
                if raw.startswith(piece, pos):
                    yield pos, item, offset


class Items:
    """A block of items with the index of their pieces."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.items, sized = [], {}
        for key, text in items:
            if not text:
                continue
            m = len(text)
            k = m * percent // 100
            cuts = [m * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                piece = text[a:b].encode()
                sized.setdefault(min(16, 1 << (len(piece).bit_length() - 1)), []).append((piece, len(self.items), a))
            self.items.append((key, text, k))
        self.pieces = [_Pieces(size, rows) for size, rows in sorted(sized.items())]

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each of some normal texts the (item, distance, end) of the items found, ``end`` in its characters."""
        joined = "\n".join(texts)  # in none of them
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        chars = None if len(raw) == len(joined) else np.cumsum((data & 0xC0) != 0x80) - 1
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[: len(texts)].tolist()
        places: dict[int, dict[int, set[int]]] = {}
        for pieces in self.pieces:
            for pos, item, offset in pieces.hits(data, raw):
                pos = pos if chars is None else int(chars[pos])
                row = bisect_right(starts, pos) - 1
                places.setdefault(row, {}).setdefault(item, set()).add(pos - starts[row] - offset)
        return [self._verified(text, places[row]) if row in places else [] for row, text in enumerate(texts)]

    def _verified(self, text: str, places: dict[int, set[int]]) -> list[tuple[int, int, int]]:
        out = []
        for at, starts in sorted(places.items()):
            key, item, k = self.items[at]
            best = None
            if not k:
                for s in sorted(starts):
                    e = s + len(item)
                    if (s == 0 or text[s - 1] == " ") and (e == len(text) or text[e] == " "):
                        best = best or (0, e)
            else:
                reach = -1
                for s in sorted(starts):
                    if s <= reach:
                        continue
                    lo, reach = max(0, s - k), s + k  # one window serves all hits that move the passage by at most k
                    window = text[lo : reach + len(item) + k]
                    if (hit := window.find(item)) >= 0:
                        found = 0, hit + len(item)
                    else:
                        found = distances(item, window, k)
                    if found and (best is None or found[0] < best[0]):
                        best = found[0], lo + found[1]
                    if best and best[0] == 0:
                        break
            if best:
                out.append((key, *best))
        return out


def _blocks(benchmark: DataFrame, percent: int, block_bytes: int):
    block, size, context = [], 0, benchmark.sparkSession.sparkContext
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r.item_id, normal(r.text)))
        size += len(block[-1][1].encode()) + 1
        if size >= block_bytes:
            yield context.broadcast((block, percent))
            block, size = [], 0
    if block:
        yield context.broadcast((block, percent))


def _searched(shared, batches):
    """Slices of batches with ``text``, and the matches of their rows."""
    items = Items(*shared.value)
    for batch in slices(batches, "text"):
        yield batch, items.search([normal(t.as_py()) for t in batch.column("text")])
    release()


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, end) of the benchmark items found in documents; ``end`` counts characters of the normal text."""
    schema = StructType([docs.schema["doc_id"], benchmark.schema["item_id"], StructField("distance", IntegerType()), StructField("end", IntegerType())])

    def search(shared):
        def found(batches):
            for batch, matches in _searched(shared, batches):
                of = [row for row, own in enumerate(matches) for _ in own]
                rows = [m for own in matches for m in own]
                keys, distance, end = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of, pa.int64())), pa.array(keys, key_type), pa.array(distance, pa.int32()), pa.array(end, pa.int32())], names=schema.names)

        return docs.select("doc_id", "text").mapInArrow(found, schema)

    key_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    parts = [search(b) for b in _blocks(benchmark, percent, block_bytes)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns; no shuffle."""

    def without(frame: DataFrame, shared) -> DataFrame:
        def clean(batches):
            for batch, matches in _searched(shared, batches):
                yield batch.filter(pa.array([not own for own in matches], pa.bool_()))

        return frame.mapInArrow(clean, frame.schema)

    return reduce(without, _blocks(benchmark, percent, block_bytes), docs)
