"""Shared parts: shared-folder tables, Arrow text buffers, and vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of text that one numpy pass handles; bounds the temporaries of a Python worker.
CHUNK_BYTES = 1 << 20

_MIX1, _MIX2, _GAMMA = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a temporary one, but only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/gridloom-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_root() -> str:
    path = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later stages neither recompute it nor depend on one executor. Deleted when the driver ends."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """The schema of ``df`` and more columns."""
    out = StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the n + 1 offsets of the rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    if off[-1] == off[0]:
        return np.empty(0, np.uint8), off - off[0]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


#: What a worker keeps from task to task, by the function that made it and this one's arguments.
_KEPT: dict[tuple, object] = {}


def kept(make, *key):
    """``make(*key)``, which this worker keeps until it runs another operator, or this one with another key."""
    name = (make, *key)
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make(*key)
    return _KEPT[name]


def slices(batches, column: str, max_bytes: int = CHUNK_BYTES, keep=None):
    """Cut record batches into pieces of at most ``max_bytes`` of ``column``, one row at least.

    What ``kept`` holds goes, but for what ``keep`` has made: an idle worker would hold it through all later stages."""
    for name in [n for n in _KEPT if n[0] is not keep]:
        del _KEPT[name]
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Give freed memory back to the system: Spark keeps idle workers, and a later stage's workers need the room."""
    _TABLES.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


@lru_cache(maxsize=2)
def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _GAMMA) | np.uint64(1)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_POWER = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        for name, base in (("up", _POWER), ("down", _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _TABLES[name] = np.cumprod(x, dtype=np.uint64)
    return _TABLES["up"][:n], _TABLES["down"][:n]


#: The bytes of the class [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words ``[^\\x20\\x09-\\x0D]+`` of all rows, and the words' rows."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans in rising order of their starts, by prefix sums of a polynomial with an invertible base."""
    out = np.empty(len(starts), np.uint64)
    codes, i = _byte_codes(lower), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
        a, b = starts[i], ends[j - 1]
        up, down = _powers(int(b - a))
        total = np.empty(int(b - a) + 1, np.uint64)
        total[0] = 0
        np.cumsum(codes[data[a:b]] * up, out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _GAMMA)
        i = j
    return out


def gram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of word hashes that stay inside a row, with the index of each one's first word."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(rows[n - 1 :] == rows[: len(rows) - n + 1])
    h = np.full(len(at), n, np.uint64) * _GAMMA
    for k in range(n):
        h = mix(h ^ words[at + k]) + _GAMMA
    return h, at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def as_list(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and the rows' lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))
