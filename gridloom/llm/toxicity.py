"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct lower-cased words and their stems (the first 4, 6 and 8 bytes, so that endings and punctuation glued to a
word don't hide it), pairs of neighbouring words, and pairs with one word skipped, hashed to ``1 << BITS`` slots; a text's score sums
the weights of its distinct slots. Training reads a bounded sample of labelled rows (``max_rows``, a documented parameter)
in one task; per-coordinate rates and L1 keep few weights, at most one per slot, which are broadcast. Scoring reads every whole text.

Defined cases: null or wordless text is scored by the bias alone; a row labelled twice is toxic if any label says so; labels without a
document are ignored; with no usable label every score is 0; repeated rows score alike; an empty table gives no rows; extra columns pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name, gram_hashes, mix, release, slices, span_hashes, text_buffer, with_fields, word_spans

BITS, MAX_ROWS, EPOCHS, STEMS = 20, 10_000, 4, (4, 6, 8)
#: L1 is L1_RATE times the root of the number of training rows, as the noise in a coordinate's gradient sum is.
ALPHA, BETA, L1_RATE, L2 = 0.2, 1.0, 0.14, 1.0
SALT = 0x5851F42D4C957F2D


def slots(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all rows, with repetitions, and their rows."""
    starts, ends, rows = word_spans(data, off)
    words = span_hashes(data, starts, ends, lower=True)
    pair, at = gram_hashes(words, rows, 2)
    skip = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.empty(0, np.int64)
    skips = mix(mix(words[skip] ^ np.uint64(SALT)) ^ words[skip + 2])
    shift = np.uint64(64 - bits)
    found, of = [mix(words) >> shift, mix(pair) >> shift, skips >> shift], [rows, rows[at], rows[skip]]
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        stems = span_hashes(data, starts[long], starts[long] + size, lower=True)
        found.append(mix(stems ^ np.uint64(SALT * size % 2**64)) >> shift)
        of.append(rows[long])
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


def fit(features: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias; the bias is a coordinate of its own without L1."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng, rate = np.random.default_rng(seed), L1_RATE * np.sqrt(len(features))

    def weights(at: np.ndarray) -> np.ndarray:
        zs, l1 = z[at], np.where(at == size, 0.0, rate)
        return np.where(np.abs(zs) > l1, (np.sign(zs) * l1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for i in rng.permutation(len(features)).tolist():
            at = np.append(features[i].astype(np.int64), size)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    out = weights(np.arange(size + 1))
    return out[:-1], float(out[-1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, where: Column | None = None) -> dict[str, bytes | float] | None:
    """A model of ``labels`` (doc_id, toxic) for texts of ``docs``: the slots with weights, the weights and the bias; None without usable labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.lit(True) if where is None else where))
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def hashed(batches):
        for batch in slices(batches, "text"):
            at, of = slots(*text_buffer(batch.column("text")))
            pairs = np.unique(of << BITS | at)
            cut = np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1))
            own = [(pairs[a:b] & ((1 << BITS) - 1)).astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.binary())], names=["doc_id", "toxic", "slots"])

    def fitted(frames):
        ids, truth, features = [], [], []
        for pdf in frames:
            ids += pdf["doc_id"].tolist()
            truth += pdf["toxic"].tolist()
            features += [np.frombuffer(x, "<u4") for x in pdf["slots"]]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], len(features[i]), int(features[i].sum(dtype=np.uint64))))  # no copies of what may be all of a worker's memory
        if order:
            w, bias = fit([features[i] for i in order], np.array([float(truth[i] > 0) for i in order]))
            at = np.flatnonzero(w)
            features.clear()
            yield pd.DataFrame({"slots": [at.astype("<u4").tobytes()], "weights": [w[at].astype("<f8").tobytes()], "bias": [bias]})
        release()

    found = rows.mapInArrow(hashed, "doc_id long, toxic int, slots binary").repartition(1)
    model = found.mapInPandas(fitted, "slots binary, weights binary, bias double").collect()
    return {"slots": bytes(model[0].slots), "weights": bytes(model[0].weights), "bias": model[0].bias} if model else None


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """All columns of ``docs`` and a last one, ``score``, between 0 and 1; if that name is taken, with underscores before it."""
    name = free_name(docs, "score")
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        weights = np.zeros(1 << BITS)
        weights[np.frombuffer(shared.value["slots"], "<u4")] = np.frombuffer(shared.value["weights"], "<f8")
        for batch in slices(batches, "text"):
            at, of = slots(*text_buffer(batch.column("text")))
            hit = weights[at] != 0
            pairs = np.unique(of[hit] << BITS | at[hit])
            total = np.bincount(pairs >> BITS, weights=weights[pairs & ((1 << BITS) - 1)], minlength=batch.num_rows) + shared.value["bias"]
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35)))))

    return docs.mapInArrow(rows, with_fields(docs, **{name: "double"}))
