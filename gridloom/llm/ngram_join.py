"""Exact n-gram Jaccard join by grouped prefixes, returned as connected components.

1. A count sketch over all shingles gives a global order, rare shingles first. It is `1 << SKETCH_BITS` one-byte levels whatever the input,
   so it can be broadcast; being one fixed order for all documents, any error in it costs time only, never a link.
2. Documents with equal shingle sets collapse into classes, and classes with equal prefixes and sizes into groups.
3. Two sets with Jaccard >= t share a shingle of their prefixes (the first n - ceil(t n) + 1 shingles). In a few cheap rounds, each
   group is compared with one group that shares the most prefix shingles and is in another component so far; a last round takes
   *every* remaining pair of groups in different components that share a prefix shingle and pass the position and overlap bounds, expands
   it to members and verifies them on whole sets. Only pairs whose members are already connected are left out, so components are exact,
   while a large group of near copies costs about one verification a member and not one a pair.

Defined cases: null or wordless text has an empty set and is linked with nothing; a text with under n words has one shingle, the
whole sequence; equal sets are linked; a null doc_id has a null component and links nothing; repeated rows are judged by their own
texts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_list, gram_hashes, materialize, mix, signed, slices, span_hashes, text_buffer, word_spans
from gridloom.llm.components import components

SKETCH_BITS, SKETCH_BLOCKS, CHEAP_ROUNDS, BROADCAST_IDS = 23, 64, 2, 2_000_000

_A, _B, _C = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    starts, ends, rows = word_spans(data, off)
    words = span_hashes(data, starts, ends, lower=True)
    grams, at = gram_hashes(words, rows, n)
    count = np.bincount(rows, minlength=len(off) - 1)
    cut = np.concatenate([[0], np.cumsum(np.maximum(count - n + 1, 0))])
    out = [np.unique(grams[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    first = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero((count > 0) & (count < n)).tolist():
        own = words[first[i] : first[i + 1]]
        out[i] = gram_hashes(own, np.zeros(len(own), np.int64), len(own))[0]
    return out


def _order_levels(docs: DataFrame, n: int) -> bytes:
    """How common the shingles of each sketch slot are, on a log scale of one byte."""
    size, width = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def counted(batches):
        counts = np.zeros(size, np.uint32)
        for batch in slices(batches, "text"):
            if sets := [s for s in shingle_sets(*text_buffer(batch.column(0)), n) if len(s)]:
                np.add.at(counts, mix(np.concatenate(sets) ^ _C) >> np.uint64(64 - SKETCH_BITS), np.uint32(1))
        if counts.any():
            part = TaskContext.get().partitionId() // 64
            blobs = [pa.compress(counts[k * width : (k + 1) * width].tobytes(), codec="zstd", asbytes=True) for k in range(SKETCH_BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([part] * SKETCH_BLOCKS, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "part", "counts"])

    def total(pdf: pd.DataFrame) -> np.ndarray:
        return sum((np.frombuffer(pa.decompress(x, width * 4, codec="zstd"), np.uint32).astype(np.int64) for x in pdf["counts"]), np.zeros(width, np.int64))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        blob = pa.compress(np.minimum(total(pdf), 2**32 - 1).astype(np.uint32).tobytes(), codec="zstd", asbytes=True)
        return pd.DataFrame({"block": pdf["block"][:1], "counts": [blob]})

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        level = np.minimum(255, 8 * np.log2(1 + total(pdf))).astype(np.uint8)
        return pd.DataFrame({"block": pdf["block"][:1], "levels": [pa.compress(level.tobytes(), codec="zstd", asbytes=True)]})

    parts = docs.select("text").mapInArrow(counted, "block int, part int, counts binary")
    sums = parts.groupBy("block", "part").applyInPandas(merged, "block int, counts binary").groupBy("block").applyInPandas(levels, "block int, levels binary")
    found = {r.block: r.levels for r in sums.collect()}
    return b"".join(pa.decompress(found[k], width, codec="zstd", asbytes=True) if k in found else bytes(width) for k in range(SKETCH_BLOCKS))


def _prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """A row per document: set size, two 64-bit sums that name the set, two that name the prefix, and the prefix, rarest shingle first."""
    shared = docs.sparkSession.sparkContext.broadcast(_order_levels(docs, n))

    def rows(batches):
        level = np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches, "text"):
            sets = shingle_sets(*text_buffer(batch.column("text")), n)
            sizes, names, prefixes = np.array([len(s) for s in sets], np.int64), np.zeros((4, len(sets)), np.uint64), []
            for i, s in enumerate(sets):
                h = mix(s ^ _C)
                key = level[h >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56) | mix(s ^ _A) >> np.uint64(8)
                prefix = s[np.argsort(key, kind="stable")[: len(s) - (percent * len(s) + 99) // 100 + 1]] if len(s) else s
                names[:, i] = mix(s ^ _A).sum(dtype=np.uint64), mix(s ^ _B).sum(dtype=np.uint64), mix(prefix ^ _A).sum(dtype=np.uint64), mix(prefix ^ _B).sum(dtype=np.uint64)
                prefixes.append(prefix)
            flat = signed(np.concatenate(prefixes)) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes), *(pa.array(signed(x)) for x in names), as_list(flat, np.array([len(p) for p in prefixes], np.int64), pa.int64())],
                names=["doc_id", "text_hash", "n", "s1", "s2", "p1", "p2", "prefix"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(rows, "doc_id long, text_hash long, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(rep, set) of the classes in ``ids`` (rep, doc, s1), each read from one of its documents."""

    def rows(batches):
        for batch in slices(batches, "text"):
            sets = shingle_sets(*text_buffer(batch.column(1)), n)
            names = np.array([mix(s ^ _A).sum(dtype=np.uint64) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(names)), as_list(signed(np.concatenate(sets)), np.array([len(s) for s in sets]), pa.int64())], names=["doc", "s1", "set"])

    wanted = ids.select(F.col("doc").alias("doc_id")).distinct()
    some = docs.select("doc_id", "text").join(F.broadcast(wanted) if ids.count() <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
    return some.mapInArrow(rows, "doc long, s1 long, set array<long>").join(ids, ["doc", "s1"]).groupBy("rep").agg(F.first("set").alias("set"))


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of class representatives whose whole sets are similar enough."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    sets = _sets_of(docs, materialize(ends.join(classes.select("rep", "doc", "s1"), "rep")), n)
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return materialize(found.where(F.col("both") * (100 + percent) >= F.col("sum") * percent).select("a", "b"))


def _prefix_length(n, percent: int):
    return n - F.floor((n * percent + 99) / 100) + 1


def _labelled(rows: DataFrame, comps: DataFrame, column: str) -> DataFrame:
    """``rows`` with the component so far of the representative in ``column``."""
    return rows.join(comps.select(F.col("a").alias(column), F.col("b").alias("comp")), column, "left").withColumn("comp", F.coalesce("comp", column))


def _likely_pairs(shared: DataFrame, comps: DataFrame, percent: int, seed: int) -> DataFrame:
    """For each group at most one other, in another component: the one that leads most of its prefix shingles among groups of like size."""
    ratio = math.log(100 / percent) / 2
    rows = _labelled(shared, comps, "gid").withColumn("like", F.floor(F.log("n") / ratio))
    named = F.struct("comp", F.xxhash64("gid", F.lit(seed)), "gid")
    leads = materialize(rows.groupBy("token", "like").agg(F.min(named).alias("lo"), F.max(named).alias("hi")).where("lo.comp <> hi.comp"))
    partner = F.when(F.col("comp") == F.col("lo.comp"), F.col("hi.gid")).otherwise(F.col("lo.gid"))
    counts = rows.join(leads, ["token", "like"]).groupBy("gid", "n", partner.alias("partner")).agg(F.count("*").alias("c"))
    best = counts.where(F.col("c") * 4 >= _prefix_length(F.col("n"), percent)).groupBy("gid").agg(F.max(F.struct("c", "partner")).alias("best"))
    return best.select(F.col("gid").alias("a"), F.col("best.partner").alias("b"))


def _remaining_pairs(shared: DataFrame, members: DataFrame, prefixes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Every pair of members in different components whose groups can still reach the similarity.

    Such groups share a prefix shingle, and from the first one on both have at least as many shingles left as must be common; so a pair is
    joined only on shingles early enough in both prefixes for that, and its whole prefixes must leave the overlap within reach. Groups meet on the
    shingle and a band of sizes: the smaller one's own band or the next, beyond which no two are similar enough."""
    labels = materialize(_labelled(members.select("rep", "gid"), comps, "rep"))
    rows = shared.join(labels.select("gid", "comp").distinct(), "gid")
    mixed = materialize(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token"))
    rows = materialize(rows.join(mixed, "token").withColumn("band", F.floor(F.log("n") / math.log(100 / percent) - 1e-9) if percent < 100 else F.col("n")))
    x, y = (rows.select("token", "band", *(F.col(c).alias(f"{c}_{k}") for c in ("gid", "comp", "n", "pos"))) for k in "xy")
    x = x.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("comp_x") < F.col("comp_y")))
    sizes = (F.col("n_x") * 100 >= F.col("n_y") * percent) & (F.col("comp_x") != F.col("comp_y")) & smaller
    need = (F.col("n_x") + F.col("n_y")) * percent
    early = (F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) * (100 + percent)) >= need
    pairs = materialize(x.join(y, ["token", "band"]).where(sizes & early).select("gid_x", "comp_x", "n_x", "gid_y", "comp_y", "n_y").distinct())
    left, right = (prefixes.select(F.col("gid").alias(f"gid_{k}"), F.col("prefix").alias(f"prefix_{k}")) for k in "xy")
    both = F.size(F.array_intersect("prefix_x", "prefix_y"))
    rest = lambda n: F.col(n) - _prefix_length(F.col(n), percent)
    groups = pairs.select("gid_x", "n_x", "gid_y", "n_y").distinct().join(left, "gid_x").join(right, "gid_y")
    fit = groups.where((both + F.greatest(rest("n_x"), rest("n_y"))) * (100 + percent) >= need).select("gid_x", "gid_y")
    a, b = (labels.select(F.col("rep").alias(end), F.col("gid").alias(f"gid_{k}"), F.col("comp").alias(f"comp_{k}")) for end, k in (("a", "x"), ("b", "y")))
    return pairs.join(fit, ["gid_x", "gid_y"]).join(a, ["gid_x", "comp_x"]).join(b, ["gid_y", "comp_y"]).select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, group_id) of each row of ``docs`` (doc_id, text); links join sets with 100 * intersection >= percent * union.

    text_hash is Spark's xxhash64 of the text; it tells rows with equal ids apart. group_id numbers the components, and tells those apart that have
    the same smallest id; it is null for empty sets and null ids."""
    rows = materialize(_prefixes(docs, n, percent))
    named = rows.where("n > 0 and doc_id is not null")
    # a class is a set, whatever ids it occurs under: its name is a number of its own, in the order of its smallest id, since copies mostly come after what
    # they were copied from and a group's smallest name is the one that others are compared with first; ids come back with the labels
    found = named.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("doc"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    classes = materialize(found.orderBy("doc").withColumn("rep", F.monotonically_increasing_id()))
    ids = materialize(classes.groupBy("p1", "p2", "n").agg(F.min("rep").alias("gid"), (F.count("*") > 1).alias("several")))
    groups = named.groupBy("p1", "p2", "n").agg(F.first("prefix").alias("prefix")).join(ids, ["p1", "p2", "n"])
    index = groups.select("gid", "n", "several", F.posexplode("prefix").alias("pos", "token"))
    frequent = materialize(index.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"))
    shared = materialize(index.where("several").union(index.where("not several").join(frequent, "token").select(*index.columns)).drop("several"))
    members = materialize(classes.join(ids, ["p1", "p2", "n"]).select("rep", "gid"))

    comps = components(_verified(docs, members.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b")), classes, n, percent))
    for k in range(CHEAP_ROUNDS):
        found = _verified(docs, _likely_pairs(shared, comps, percent, k), classes, n, percent)
        if found.isEmpty():
            break
        comps = components(comps.union(found))
    whole = members.join(shared.select("gid").distinct(), "gid", "left_semi")
    some = groups.select("gid", "prefix").join(whole.select("gid").distinct(), "gid", "left_semi")
    last = _verified(docs, _remaining_pairs(shared, whole, some, comps, percent), classes, n, percent)
    if not last.isEmpty():
        comps = components(comps.union(last))

    own = classes.select(F.col("rep").alias("a"), "doc")
    nodes = materialize(comps.union(comps.select("b", "b").distinct()).join(own, "a"))
    least = materialize(nodes.groupBy("b").agg(F.min("doc").alias("least")))
    labels = classes.join(nodes.join(least, "b").select(F.col("a").alias("rep"), F.col("b").alias("group"), "least"), "rep", "left").select("s1", "s2", "n", F.coalesce("least", "doc").alias("component_id"), F.coalesce("group", "rep").alias("group_id"))
    return rows.select("doc_id", "text_hash", "n", "s1", "s2").join(labels, ["s1", "s2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("group_id")).alias("group_id")
    )
