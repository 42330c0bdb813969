"""Hierarchical best-fit packing of tokenised documents into sequences of a fixed length.

1. Each document becomes token ids and an end id, cut into pieces of at most ``capacity`` ids.
2. Each partition packs its pieces by best fit, longest first. Bins within ``slack`` ids of full are final.
3. The other bins are items of the next round: they are dealt into groups of at most ``group_items``, each group packs them by best
   fit, and so on up the tree, until one group holds what is left or a round joins under 1 % of the bins.

Only rows about bins move between rounds; a group's memory is bounded by ``group_items`` rows whatever the input. Best fit leaves at most one
bin of a group half full or less, so a last round that joins little leaves bins that are nearly all over half full, and final bins are
at least ``capacity - slack`` full; where short documents abound the sequences come to within 1 % of the fewest possible.

Defined cases: null or empty text is the end id alone; repeated rows are packed separately; a null doc_id is kept, and its type is the
input's; an empty table gives no rows; pieces may have columns of any name but sequence_id, and an ``offset`` of theirs is replaced; a very long
text is tokenised in stretches between white space.
"""

from __future__ import annotations

import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from gridloom.llm.common import _GAMMA, _INVERSE, _POWER, CHUNK_BYTES, IS_SPACE, free_name, kept, materialize, mix, release, slices, text_buffer, with_fields

CAPACITY, SLACK, GROUP_ITEMS = 2048, 8, 50_000

#: Distinct units that a worker remembers; beyond this those go that were met longest ago.
CACHE_UNITS = 400_000

_SPACE, _MARK, _DIGIT, _LETTER, _ODD = range(5)
_CODES = 0xD800


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point under `_CODES`. Those are odd whose case, class or composition isn't a matter of one character, or
    might differ between versions of Unicode."""
    kinds, lower, early = np.full(_CODES, _ODD, np.uint8), np.arange(_CODES, dtype=np.uint32), unicodedata.ucd_3_2_0
    of = {"L": _LETTER, "N": _DIGIT, "P": _MARK, "S": _MARK}
    for code in range(32, _CODES):
        ch = chr(code)
        kind = of.get(unicodedata.category(ch)[0])
        low = ch.lower()
        if kind is None or of.get(early.category(ch)[0]) != kind or len(low) > 1 or unicodedata.normalize("NFC", ch) != ch or unicodedata.normalize("NFC", low) != low or ord(low) >= _CODES or 0x1100 <= code < 0x1200:
            continue
        kinds[code], lower[code] = kind, ord(low)
    kinds[np.flatnonzero(IS_SPACE)] = _SPACE
    return kinds, lower


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: its own where it prints, else one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class UnitEncoder:
    """Ids of texts under a lower-casing byte-level BPE tokenizer that drops white space and splits letter runs, digits, mark runs and contractions.

    Texts are split into these units by arrays; each distinct unit goes through the tokenizer's own model once while it is remembered. A word with a
    character that `_characters` calls odd, or with a special token's beginning, goes through the whole tokenizer instead."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.units = Tokenizer(self.tokenizer.model)  # the same model in memory; no normaliser: units are lower-case already, and between spaces
        self.units.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # whether a token ends a unit
        self.last[[i for token, i in self.units.get_vocab().items() if token.endswith(self.units.model.end_of_word_suffix)]] = True
        letters = _byte_letters()
        self.letters = str.maketrans({chr(b): c for b, c in letters.items()})
        self.keys, self.at, self.count, self.met = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used, self.tick = np.empty(1 << 16, np.uint32), 0, 0
        self.powers = np.empty((2, 0), np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if self.powers.shape[1] < n:
            self.powers = np.repeat(np.array([[_POWER], [_INVERSE]], np.uint64), max(n, CHUNK_BYTES), axis=1)
            self.powers[:, 0] = 1
            np.cumprod(self.powers, axis=1, dtype=np.uint64, out=self.powers)
        return self.powers[:, :n]

    def _ids_of(self, plain: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plain units and then of odd words, and their counts."""
        ids, counts = [], np.zeros(len(plain) + len(odd), np.int64)
        for lo in range(0, len(plain), 2000):
            some = plain[lo : lo + 2000]
            text = " ".join(some)
            if not text.isascii():
                text = " ".join([s if s.isascii() else s.encode().decode("latin-1").translate(self.letters) for s in some])
            ids.append(np.array(self.units.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
            stops = np.flatnonzero(self.last[ids[-1]])
            if len(stops) != len(some):
                raise ValueError("a unit's last id must be that of a token with the vocabulary's word end, and no other")
            counts[lo : lo + len(some)] = np.diff(stops, prepend=-1)
        for k, e in enumerate(self.tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else [], len(plain)):
            ids.append(np.array(e.ids, np.uint32))
            counts[k] = len(ids[-1])
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), counts

    def _learn(self, keys: np.ndarray, plain: list[str], odd: list[str]) -> None:
        """Remember new units; keys: those of the plain ones, then those of the odd ones."""
        if len(self.keys) + len(keys) > CACHE_UNITS and len(self.keys):
            keep = np.flatnonzero((self.met > np.median(self.met)) | (self.met == self.tick))
            at, count = self.at[keep], self.count[keep]
            stop = np.cumsum(count)
            self.ids = self.ids[np.repeat(at - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
            self.keys, self.at, self.count, self.met, self.used = self.keys[keep], stop - count, count, self.met[keep], len(self.ids)
        new, counts = self._ids_of(plain, odd)
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(new), self.used, 1 << 16), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(counts) - counts
        self.used += len(new)
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys, self.at, self.count = (np.insert(old, place, x[order]) for old, x in ((self.keys, keys), (self.at, at), (self.count, counts)))
        self.met = np.insert(self.met, place, self.tick)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all rows, and the rows' counts. Rows are read in stretches that end at white space or at a row's end."""
        total, ids = np.zeros(len(off) - 1, np.int64), []
        a, n = 0, len(data)
        while a < n:
            b = min(n, a + CHUNK_BYTES)
            if b < n:
                edge = int(off[np.searchsorted(off, b, "right") - 1])
                gaps = np.flatnonzero(IS_SPACE[data[max(a, edge) : b]])
                if len(gaps):
                    b = max(a, edge) + int(gaps[-1]) + 1
                elif edge > a:
                    b = edge
                else:  # a word longer than a stretch
                    end = int(off[np.searchsorted(off, a, "right")])
                    later = np.flatnonzero(IS_SPACE[data[b:end]])
                    b = b + int(later[0]) if len(later) else end
            lo, hi = int(np.searchsorted(off, a, "right")) - 1, int(np.searchsorted(off, b, "left"))
            found, counts = self._stretch(data[a:b], np.clip(off[lo : hi + 1], a, b) - a)
            ids.append(found)
            total[lo:hi] += counts
            a = b
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), total

    def _stretch(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, lower = _characters()
        text = data.tobytes().decode()
        if len(text) == len(data):
            raw, edges = data, off
        else:
            raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
        beyond = raw >= _CODES if raw.dtype == np.uint32 else np.zeros(len(raw), bool)
        codes = np.where(beyond, 0, raw) if beyond.any() else raw
        kind, low = kinds[codes], lower[codes]
        row_edge = np.zeros(len(raw) + 1, bool)
        row_edge[edges] = True
        fresh = np.concatenate([[True], kind[1:] != kind[:-1]]) | row_edge[:-1] | (kind == _DIGIT)

        # a lone apostrophe takes s, t, m, d, re, ve or ll after it
        lone = np.flatnonzero((raw[:-1] == 39) & fresh[:-1] & fresh[1:] & (kind[1:] == _LETTER) & ~row_edge[1:-1]) if len(raw) > 1 else np.empty(0, np.int64)
        if len(lone):
            wide = np.concatenate([low, np.zeros(3, low.dtype)])
            one, two = wide[lone + 1], wide[lone + 2]
            short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
            long = (((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108))
            stop = np.concatenate([fresh, [True, True, True]])
            long &= ~stop[lone + 2]
            for hit, size in ((lone[short], 2), (lone[long & ~short], 3)):
                fresh[hit + 1] = False
                end = hit + size
                end = end[end < len(raw)]
                fresh[end] = True

        odd = kind == _ODD
        odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
        seen = kind != _SPACE
        if odd.any():  # the whole words around odd characters
            first = seen.copy()
            first[1:] &= ~seen[:-1] | row_edge[1:-1]
            word = np.cumsum(first) - 1
            bad = np.zeros(int(word[-1]) + 1, bool)
            bad[word[odd & seen]] = True
            odd = seen & bad[np.maximum(word, 0)]
            fresh = np.where(odd, first, fresh)
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(raw))
        inside = seen[starts]
        starts, ends = starts[inside], ends[inside]
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(off) - 1, np.int64)

        up, down = self._powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        said = np.where(odd, raw.astype(np.uint64) + np.uint64(1 << 32), low) if odd.any() else low.astype(np.uint64)
        np.cumsum(mix(said + _GAMMA) * up, out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GAMMA)

        order = np.argsort(keys)
        sorted_keys = keys[order]
        head = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        distinct, first_at = sorted_keys[head], order[head]
        back = np.empty(len(keys), np.int64)
        back[order] = np.cumsum(head) - 1
        self.tick += 1
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        self.met[place[known]] = self.tick
        if not known.all():
            s, e = starts[first_at[~known]], ends[first_at[~known]]
            strange = odd[s]
            lowered = low.astype("<u4").tobytes().decode("utf-32-le")  # odd characters are as they were, but for those beyond the table
            plain = [lowered[i:j] for i, j in zip(s[~strange].tolist(), e[~strange].tolist(), strict=True)]
            words = [text[i:j] for i, j in zip(s[strange].tolist(), e[strange].tolist(), strict=True)]
            self._learn(np.concatenate([distinct[~known][~strange], distinct[~known][strange]]), plain, words)
            place = np.searchsorted(self.keys, distinct)
        at, count = self.at[place][back], self.count[place][back]
        stop = np.cumsum(count)
        ids = self.ids[np.repeat(at - (stop - count), count) + np.arange(stop[-1])]
        rows = np.searchsorted(edges, starts, "right") - 1
        return ids, np.bincount(rows, weights=count, minlength=len(off) - 1).astype(np.int64)


def encoder(path: str) -> UnitEncoder:
    """The encoder of ``path``, which a worker keeps while it runs no other operator."""
    return kept(UnitEncoder, path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(batches, tokenizer: str, capacity: int, end_id: int):
    """Batches of the pieces of documents, with their ids."""
    for batch in slices(batches, "text", keep=UnitEncoder):
        ids, counts = encoder(tokenizer).encode(*text_buffer(batch.column("text")))
        own = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4", copy=False)
        counts += 1
        per = -(-counts // capacity)
        rows = np.repeat(np.arange(len(counts)), per)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
        length = np.minimum(capacity, counts[rows] - piece * capacity)
        ends = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(own)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), blobs], names=["doc_id", "piece", "start", "length", "ids"])
    release()


def _pieces_schema(docs: DataFrame, last: StructField) -> StructType:
    return StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), last])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids cut into pieces; ids are little-endian unsigned 32-bit."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _cut(batches, tokenizer, capacity, end_id), _pieces_schema(docs, StructField("ids", BinaryType())))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fill: longest first, each into the fullest bin that takes it."""
    bins, offsets, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    open_bins: dict[int, list[int]] = {}
    free = 0  # bit r: some bin has r ids left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := free >> size:
            left = size + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                free &= ~(1 << left)
        else:
            b, left = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if left := left - size:
            open_bins.setdefault(left, []).append(b)
            free |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _packed(batches, bin_: str, capacity: int, group_items: int):
    """Batches of pieces with a column for their bins and ``offset``; pieces are packed by ``group_items`` at a time."""
    base, count, held, n = (TaskContext.get().partitionId() + 1) << 36, 0, [], 0

    def packed():
        nonlocal count, held, n
        whole = pa.Table.from_batches(held)
        bins, offsets, fill = best_fit(whole.column("length").to_numpy(), capacity)
        out = whole.append_column(bin_, pa.array(base + count + bins)).append_column("offset", pa.array(offsets))
        count, held, n = count + len(fill), [], 0
        return out.to_batches()

    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= group_items:
            yield from packed()
    if n:
        yield from packed()
    release()


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, group_items: int = GROUP_ITEMS) -> DataFrame:
    """All columns of ``pieces`` (which has ``length``), with sequence_id and offset."""
    pieces = pieces.drop("offset")
    bin_ = free_name(pieces, "bin")
    placed = pieces.mapInArrow(lambda batches: _packed(batches, bin_, capacity, group_items), with_fields(pieces, **{bin_: "long", "offset": "long"}))
    return _joined(placed, bin_, capacity, slack, group_items)


def _joined(placed: DataFrame, bin_: str, capacity: int, slack: int, group_items: int) -> DataFrame:
    """Pieces with their sequences, from those with bins: the rounds over underfull bins."""
    columns = [c for c in placed.columns if c not in (bin_, "offset")]
    placed = materialize(placed)
    items = placed.groupBy(F.col(bin_).alias("bin")).agg(F.sum("length").alias("fill")).where(F.col("fill") < capacity - slack)
    moved = materialize(items.select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("base"), "fill"))
    left, level = moved.count(), 0
    while left > 1:
        level, groups = level + 1, -(-left // group_items)

        def join_bins(pdf: pd.DataFrame) -> pd.DataFrame:
            bins, offsets, fill = best_fit(pdf["fill"].to_numpy(), capacity)
            leader = np.zeros(len(fill), np.int64)
            leader[bins[offsets == 0]] = pdf["root"].to_numpy()[offsets == 0]
            return pd.DataFrame({"root": pdf["root"], "new_root": leader[bins], "add": offsets, "new_fill": fill[bins]})

        open_roots = moved.where(F.col("fill") < capacity - slack).select("root", "fill").distinct()
        joined = open_roots.withColumn("group", F.pmod(F.xxhash64("root", F.lit(level)), F.lit(groups))).groupBy("group").applyInPandas(join_bins, "root long, new_root long, add long, new_fill long")
        moved = materialize(
            moved.join(joined, "root", "left").select(
                "bin", F.coalesce("new_root", "root").alias("root"), (F.col("base") + F.coalesce("add", F.lit(0))).alias("base"), F.coalesce("new_fill", "fill").alias("fill")
            )
        )
        before, left = left, moved.where(F.col("fill") < capacity - slack).select("root").distinct().count()
        if groups == 1 or left > 0.99 * before:
            break
    return (
        placed.alias("p").join(moved.drop("fill").alias("m"), F.col(f"p.{bin_}") == F.col("m.bin"), "left")
        .select(*(f"p.{c}" for c in columns), F.coalesce("m.root", f"p.{bin_}").alias("sequence_id"), (F.col("p.offset") + F.coalesce("m.base", F.lit(0))).alias("offset"))
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces with their places, and the digest of each piece's ids in place of the ids. One worker a task cuts and packs."""

    def placed(batches):
        return _packed((_digested(b) for b in _cut(batches, tokenizer, capacity, end_id)), "bin", capacity, GROUP_ITEMS)

    schema = _pieces_schema(docs, StructField("ids_crc32", LongType())).add("bin", "long").add("offset", "long")
    return _joined(docs.select("doc_id", "text").mapInArrow(placed, schema), "bin", capacity, SLACK, GROUP_ITEMS)


def _digested(pieces: pa.RecordBatch) -> pa.RecordBatch:
    """Pieces with the CRC-32 of their ids, ``ids_crc32``, in place of ``ids``."""
    crc = pa.array([zlib.crc32(x.as_buffer()) for x in pieces.column("ids")], pa.int64())
    return pieces.drop_columns(["ids"]).append_column("ids_crc32", crc)
