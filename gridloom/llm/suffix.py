"""Removal of long repeated passages with run-length compressed suffix indexes.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else, in any document or its own.

1. Windows of ``length`` bytes are dealt by their minimiser: equal windows have the same smallest gram of 24 bytes, the *anchor*. Consecutive
   windows with one anchor form a segment. Copies of a segment collapse, in their slice and then in Spark, to one with a count: a copy repeats
   whole, and the index needs its text once. Segments alone under their anchor repeat nothing.
2. What is left, different segments under one anchor (the edges of matches), is fetched as bytes and indexed in bounded blocks of whole anchors.
   A block's index is the runs of its Burrows-Wheeler transform: each run's byte, first row and the row that its first one leads to, and samples
   at both ends of a run: how far the suffix there matches its neighbour beyond the run.
3. Matching statistics stream through the index: all segments of a block step backwards from their ends by the runs alone; inside a run a match
   with a neighbour grows by one, at a run's end it is that run's sample. Positions with a match of ``length`` are marked.
4. An anchor with more than ``block_segments`` different segments would not fit a block. Its segments are dealt anew by minimisers of a longer gram, of
   72, 136 and at last ``length`` bytes, where a segment is a window and its copies collapse, so every level ends in bounded blocks.

Defined cases: null text is empty; texts shorter than ``length`` stay; repeated rows repeat each other; rows with equal ids are told apart
by their texts; very long texts are dealt in stretches that share ``length - 1`` bytes; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import _GAMMA, CHUNK_BYTES, _byte_codes, _powers, materialize, mix, signed, slices, text_buffer

LENGTH, BLOCK_BYTES, BLOCK_SEGMENTS, BROADCAST_IDS = 200, 1 << 20, 4096, 2_000_000


def grams(length: int) -> list[int]:
    """The gram lengths by level, the window's own last."""
    return [g for g in (24, 72, 136) if g < length] + [length]


def _hasher(data: np.ndarray):
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_byte_codes(False)[data] * up[:-1], out=total[1:])
    return lambda s, e: mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _GAMMA)


def segments(data: np.ndarray, off: np.ndarray, length: int, gram_bytes: int = 24) -> tuple[np.ndarray, ...]:
    """Rows, starts (in ``data``), lengths, anchors and content hashes of the segments of all rows."""
    n, places = len(data), length - gram_bytes + 1
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    windows = np.flatnonzero(off[rows + 1] - np.arange(n) >= length) if n else np.empty(0, np.int64)
    if not len(windows):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    hashed = _hasher(data)
    at = np.arange(n - gram_bytes + 1)
    gram = hashed(at, at + gram_bytes)
    least, span = gram >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64), 1
    while span * 2 <= places:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    least = np.minimum(least[: len(least) - (places - span)], least[places - span :])
    anchor_at = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor_at[1:] != anchor_at[:-1]]))
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    starts, sizes = windows[first], windows[last] - windows[first] + length
    return rows[starts], starts, sizes, gram[anchor_at[first]], hashed(starts, starts + sizes)


def _merged(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of overlapping intervals, row by row."""
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], (starts + sizes)[order]
    if not len(rows):
        return rows, starts, ends
    # rows lie apart in `starts` as they do in the slice, so one running maximum serves them all
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], (starts[1:] > reach[:-1]) | (rows[1:] != rows[:-1])])
    at = np.flatnonzero(new)
    return rows[at], starts[at], reach[np.concatenate([at[1:], [len(rows)]]) - 1] - starts[at]


def _stretches(batches, length: int):
    """Slices of batches with ``text`` as (batch, bytes, offsets of the rows, first byte): a row over `CHUNK_BYTES` in stretches that share ``length - 1`` bytes."""
    for batch in slices(batches, "text"):
        data, off = text_buffer(batch.column("text"))
        if len(data) <= CHUNK_BYTES + length:
            yield batch, data, off, 0
            continue
        for a in range(0, len(data) - length + 1, CHUNK_BYTES):
            part = data[a : a + CHUNK_BYTES + length - 1]
            yield batch, part, np.array([0, len(part)], np.int64), a


def _segment_rows(texts: DataFrame, length: int, gram_bytes: int) -> DataFrame:
    """A row per segment of texts (id, tag, base, text), equal ones of a slice but once (``again``); and with a null anchor the intervals that a slice
    itself repeats. Starts count from the document's, where the text has its ``base``."""

    def found(batches):
        for batch, data, off, first in _stretches(batches, length):
            rows, starts, sizes, anchors, hashes = segments(data, off, length, gram_bytes)
            ids, tags, base = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tag", "base"))
            order = np.lexsort((hashes, anchors))
            same = np.concatenate([[False], (anchors[order][1:] == anchors[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])]) if len(order) else np.empty(0, bool)
            head = order[~same]
            size = np.diff(np.concatenate([np.flatnonzero(~same), [len(order)]]))
            again = np.zeros(len(order), bool)
            again[order] = np.repeat(size > 1, size)
            mr, ms, ml = _merged(rows[again], starts[again], sizes[again])
            r, s = np.concatenate([rows[head], mr]), np.concatenate([starts[head], ms])
            none = np.concatenate([np.zeros(len(head), bool), np.ones(len(mr), bool)])
            zeros = np.zeros(len(mr), np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(np.concatenate([anchors[head], zeros])), mask=none), pa.array(signed(np.concatenate([hashes[head], zeros])), mask=none),
                    pa.array(ids[r]), pa.array(tags[r]), pa.array(base[r]), pa.array((s - off[r] + base[r] + first).astype(np.int64)), pa.array(np.concatenate([sizes[head], ml]).astype(np.int32)), pa.array(np.concatenate([size > 1, np.ones(len(mr), bool)])),
                ],
                names=["anchor", "hash", "id", "tag", "base", "start", "size", "again"],
            )

    return texts.select("id", "tag", "base", "text").mapInArrow(found, "anchor long, hash long, id long, tag long, base long, start long, size int, again boolean")


def suffix_array(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of all suffixes up to the ends of their segments, equal ones by position. left: bytes from each position to its segment's end.

    By prefix doubling from seven bytes on; only groups that are still tied are sorted again."""
    n, depth = len(data), 7
    key = np.minimum(left, depth).astype(np.uint64)
    wide = np.concatenate([data, np.zeros(depth, np.uint8)]).astype(np.uint64)
    for k in range(depth):
        key |= np.where(left > k, wide[k : n + k], 0) << np.uint64(8 * (depth - k))
    order = np.argsort(key, kind="stable")
    rank, slots, keys = np.empty(n, np.int64), np.arange(n), key[order]
    while True:
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        tied = ~first
        tied[:-1] |= ~first[1:]
        slots = slots[tied]
        if not len(slots) or depth >= left.max():
            return order
        at = order[slots]
        second = np.where(left[at] > depth, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        keys = rank[at] * (n + 2) + second
        by = np.argsort(keys, kind="stable")
        order[slots], keys, depth = at[by], keys[by], depth * 2


def common_lengths(data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, inside their segments."""
    most, out = np.minimum(left[a], left[b]), np.zeros(len(a), np.int64)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)[: len(data) + 1]).view("<u8").ravel()
    live = np.arange(len(a))
    while len(live):
        x = words[a[live] + out[live]] ^ words[b[live] + out[live]]
        same = np.full(len(live), 8, np.int64)
        diff = x != 0
        low = x[diff] & (~x[diff] + np.uint64(1))
        same[diff] = np.log2(low.astype(np.float64)).astype(np.int64) // 8
        out[live] += same
        live = live[~diff & (out[live] < most[live])]
    return np.minimum(out, most)


class RunIndex:
    """The Burrows-Wheeler transform of segments, each with an end mark of its own, by runs.

    Rows are the segments' end marks in their order, then all suffixes. For each run: its byte (below 0 for an end mark), its first row, the row
    that its first one leads to, and how long the suffixes led to from its first and last row match their neighbours beyond the run."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        n, m = len(data), len(sizes)
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        stop = np.repeat(self.ends, sizes)
        left = stop - np.arange(n)
        order = suffix_array(data, left)
        begins = np.zeros(n + 1, bool)
        begins[np.concatenate([[0], self.ends[:-1]])] = True
        sa = np.concatenate([self.ends, order])
        byte = np.where(np.concatenate([np.zeros(m, bool), begins[order]]), -1 - np.arange(n + m), data[sa - 1].astype(np.int64))
        self.start = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        self.byte, self.last = byte[self.start], np.append(self.start[1:], n + m) - 1
        size = self.last - self.start + 1

        by_byte = np.lexsort((self.start, self.byte))
        inner = by_byte[self.byte[by_byte] >= 0]
        self.leads = np.full(len(self.start), -1)
        self.leads[inner] = m + np.cumsum(size[inner]) - size[inner]

        # the runs before and after with the same byte, whose ends are the neighbours of this one's where the rows lead
        near = self.byte[inner][1:] == self.byte[inner][:-1]
        earlier, later = inner[:-1][near], inner[1:][near]
        match = common_lengths(data, left, sa[self.last[earlier]] - 1, sa[self.start[later]] - 1)
        self.above, self.below = np.zeros(len(self.start), np.int64), np.zeros(len(self.start), np.int64)
        self.above[later], self.below[earlier] = match, match

    def stream(self) -> np.ndarray:
        """For each position of the segments the longest match, inside its segment, with any other position."""
        best = np.zeros(int(self.ends[-1]) if len(self.ends) else 0, np.int64)
        by_size = np.argsort(-self.sizes, kind="stable")
        row, at, falling = by_size.copy(), self.ends[by_size].copy(), -self.sizes[by_size]
        up, down = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for step in range(int(self.sizes.max()) if len(row) else 0):
            live = int(np.searchsorted(falling, -step, "left"))
            row, at, up, down = row[:live], at[:live] - 1, up[:live], down[:live]
            run = np.searchsorted(self.start, row, "right") - 1
            up = np.where(row == self.start[run], self.above[run], up + 1)
            down = np.where(row == self.last[run], self.below[run], down + 1)
            row = self.leads[run] + row - self.start[run]
            best[at] = np.maximum(up, down)
        return best


def matching_statistics(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each position of the concatenated segments, the longest match, inside its segment, with any other position."""
    return RunIndex(data, sizes).stream()


def _indexed(parts: DataFrame, length: int) -> DataFrame:
    """(id, tag, start, size) of what repeats among segments (anchor, id, tag, start, whole, bytes) that lie with their anchors together."""

    def block(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, off = text_buffer(rows.column("bytes"))
        sizes = np.diff(off)
        hit = np.flatnonzero(matching_statistics(data, sizes) >= length)
        of = np.searchsorted(off, hit, "right") - 1
        keep = ~rows.column("whole").to_numpy(zero_copy_only=False)[of]
        r, s, size = _merged(of[keep], hit[keep], np.full(int(keep.sum()), length))
        take = pa.array(r)
        start = rows.column("start").take(take).to_numpy(zero_copy_only=False) + s - off[r]
        return pa.RecordBatch.from_arrays([rows.column("id").take(take), rows.column("tag").take(take), pa.array(start.astype(np.int64)), pa.array(size.astype(np.int32))], names=["id", "tag", "start", "size"])

    def found(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = batch.column("anchor").to_numpy()
            sizes = np.cumsum(np.diff(text_buffer(batch.column("bytes"))[1]))
            cuts = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            lo = 0
            if last is not None and anchors[0] != last and size >= BLOCK_BYTES:
                yield block(held)
                held, size = [], 0
            for cut in [*cuts.tolist(), batch.num_rows]:
                so_far = sizes[cut - 1] - (sizes[lo - 1] if lo else 0)
                if cut < batch.num_rows and size + so_far >= BLOCK_BYTES:
                    yield block([*held, batch.slice(lo, cut - lo)])
                    held, size, lo = [], 0, cut
            if lo < batch.num_rows:
                size += int(sizes[-1] - (sizes[lo - 1] if lo else 0))
                held.append(batch.slice(lo))
            last = anchors[-1]
        if held:
            yield block(held)

    return parts.mapInArrow(found, "id long, tag long, start long, size int")


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def repeated_spans(docs: DataFrame, length: int = LENGTH, block_segments: int = BLOCK_SEGMENTS) -> DataFrame:
    """(id, tag, start, size) of marked intervals of documents (id, tag, text); they may overlap."""
    texts, marks = docs.select("id", "tag", F.lit(0).cast("long").alias("base"), "text"), None
    for gram_bytes in grams(length):
        rows = materialize(_segment_rows(texts, length, gram_bytes))
        crowds = materialize(rows.where("anchor is not null").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
        many = rows.join(crowds, "anchor")
        kinds = many.groupBy("anchor", "hash").agg(F.count("*").alias("n"), F.max("again").alias("again"), *(F.first(c).alias(c) for c in ("id", "tag", "base", "start", "size")))
        kinds = materialize(kinds.withColumn("whole", (F.col("n") > 1) | F.col("again")))
        marked = rows.where("not again").join(kinds.where("whole").select("anchor", "hash"), ["anchor", "hash"]).select("id", "tag", "start", "size")
        marked = rows.where("anchor is null").select("id", "tag", "start", "size").union(marked)
        marks = marked if marks is None else marks.union(marked)
        several = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
        wanted = kinds.join(several, "anchor").select("id", "tag", "base", F.struct("anchor", "start", "size", "whole", "kinds").alias("part"))
        parts = materialize(_fetched(texts, wanted))
        blocks = parts.where(F.col("kinds") <= block_segments).repartition("anchor").sortWithinPartitions("anchor")
        marks = marks.union(_indexed(blocks, length))
        hot = parts.where(F.col("kinds") > block_segments)
        if gram_bytes == length or hot.isEmpty():
            return marks
        texts = hot.select("id", "tag", F.col("start").alias("base"), F.col("bytes").alias("text"))
    return marks


def _fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of segments (id, tag, base, part) out of the texts (id, tag, base, text) that they were found in."""
    found = _only(texts, materialize(wanted.select("id").distinct()), "left_semi").select("id", "tag", "base", F.col("text").cast("binary").alias("bytes"))
    places = wanted.groupBy("id", "tag", "base").agg(F.collect_list("part").alias("parts"))
    rows = found.join(places, ["id", "tag", "base"]).select("id", "tag", "base", "bytes", F.explode("parts").alias("p"))
    return rows.select("id", "tag", "p.anchor", "p.start", "p.whole", "p.kinds", F.substring("bytes", (F.col("p.start") - F.col("base") + 1).cast("int"), F.col("p.size")).alias("bytes"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row of ``docs`` (doc_id, text): the removed byte spans (start, end), and the bytes left."""
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("tag"), "text")
    marks = materialize(repeated_spans(keyed, length))
    ids = materialize(marks.select("id").distinct())
    spans = marks.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "size")).alias("marks"))

    def cut(batches):
        for batch in slices(batches, "text"):
            data, off = text_buffer(batch.column("text"))
            out, kept = [], []
            for k, marks in enumerate(batch.column("marks")):
                own = data[off[k] : off[k + 1]]
                if marks.is_valid and len(marks.values):
                    s, n = (x.to_numpy().astype(np.int64) for x in marks.values.flatten())
                    _, starts, size = _merged(np.zeros(len(s), np.int64), s, n)
                    kept.append(b"".join(own[i:j].tobytes() for i, j in zip([0, *(starts + size).tolist()], [*starts.tolist(), len(own)], strict=True)))
                    out.append([{"start": a, "end": a + b} for a, b in zip(starts.tolist(), size.tolist(), strict=True)])
                else:
                    kept.append(own.tobytes())
                    out.append([])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(out, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    touched = _only(keyed, ids, "left_semi").join(spans, ["id", "tag"], "left").select("doc_id", "text", "marks")
    whole = _only(keyed, ids, "left_anti").select("doc_id", "text", F.lit(None).cast(touched.schema["marks"].dataType).alias("marks"))
    return touched.union(whole).mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
