"""Quality rules by distribution divergence.

A document's character-class histogram and its histogram over the commonest words of its language are compared with the language's own
histograms over the whole corpus, by Jensen-Shannon distance (base 2, so 0 to 1). A document is kept if it passes the base rules and, where
it is long enough for a histogram to mean something, both distances stay under their limits.

Base rules: at least 50 words, and at most half the words inside repeated 3-word windows.

Defined cases: null text has no words; a null or unknown language is judged by the nearest reference of any language; a language with under
``min_reference`` words in the corpus has no reference of its own; without any reference only the base rules hold; repeated rows are
judged alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import gram_hashes, materialize, mix, signed, slices, span_hashes, text_buffer, word_spans

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COMMON_WORDS, MIN_REFERENCE, MIN_CHARS, MIN_JUDGED_WORDS = 64, 2000, 200, 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
#: Distinct words that a worker counts before it hands them on.
HELD_WORDS = 1 << 20
#: Character classes by byte: 0 lower, 1 upper, 2 digit, 3 white space, 4 sentence marks, 5 other ASCII marks, 6 control, 7 beyond ASCII (counted once a character).
_CLASS = np.full(256, 7, np.int8)
_CLASS[:32], _CLASS[127], _CLASS[32:127] = 6, 6, 5
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 1, 0
_CLASS[list(b" \t\n\r\x0b\x0c")], _CLASS[list(b".,;:!?'\"()-")] = 3, 4
_CLASSES = 8
_SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] - total[off[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_counts(data: np.ndarray, off: np.ndarray, spans) -> dict[str, np.ndarray]:
    starts, ends, rows = spans
    n = len(off) - 1
    character = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(character)])
    words = span_hashes(data, starts, ends)
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": np.bincount(rows, weights=chars[ends] - chars[starts], minlength=n).astype(np.int64), "n_symbols": _per_row(_SYMBOL[data], off)}
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_rows = np.searchsorted(off, line_starts, "right") - 1
    stop = np.searchsorted(breaks, line_starts)
    line_ends = np.minimum(off[line_rows + 1], np.append(breaks, len(data))[stop]) if len(line_starts) else line_starts
    wordy = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_rows = line_rows[wordy]
    keys = mix(span_hashes(data, line_starts[wordy], line_ends[wordy])) ^ mix(line_rows.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(line_rows, minlength=n) - np.bincount(line_rows[first], minlength=n)
    grams, at = gram_hashes(words, rows, 3)
    again = at[_repeated(grams ^ mix(rows[at].astype(np.uint64) + np.uint64(1)))]
    covered = np.zeros(len(words) + 2, bool)
    for k in range(3):
        covered[again + k] = True
    out["n_repeat_words"] = np.bincount(rows[covered[: len(rows)]], minlength=n)
    return out


def class_histogram(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    keep = (data & 0xC0) != 0x80
    rows = np.repeat(np.arange(n), np.diff(off))[keep]
    return np.bincount(rows * _CLASSES + _CLASS[data[keep]], minlength=n * _CLASSES).reshape(n, _CLASSES)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of the rows of count matrices; q may be one row."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(-1)
        return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def references(docs: DataFrame, common: int = COMMON_WORDS, min_words: int = MIN_REFERENCE) -> dict[str, tuple]:
    """For each language its class counts, the hashes of its commonest words, and their counts with the rest's last. Over all documents."""

    def sums(words: dict):
        for lang, (keys, counts, classes) in words.items():
            n = len(keys) + 1 + _CLASSES
            kind = np.concatenate([np.zeros(n - 1 - _CLASSES), [1], np.full(_CLASSES, 2)]).astype(np.int32)
            key = np.concatenate([signed(keys), [0], np.arange(_CLASSES)])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(kind), pa.array(key), pa.array(np.concatenate([counts, [counts.sum()], classes]))], names=["lang", "kind", "key", "n"])

    def counted(batches):
        words: dict = {}
        for batch in slices(batches, "text"):
            if sum(len(w[0]) for w in words.values()) > HELD_WORDS:
                yield from sums(words)
                words.clear()
            data, off = text_buffer(batch.column("text"))
            starts, ends, rows = word_spans(data, off)
            hashes, classes = span_hashes(data, starts, ends, lower=True), class_histogram(data, off)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in {x for x in langs if x is not None}:
                own = langs == lang
                keys, counts = np.unique(hashes[own[rows]], return_counts=True)
                held = words.setdefault(lang, [np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(_CLASSES, np.int64)])
                held[2] += classes[own].sum(0)
                all_keys, back = np.unique(np.concatenate([held[0], keys]), return_inverse=True)
                held[0], held[1] = all_keys, np.bincount(back, weights=np.concatenate([held[1], counts])).astype(np.int64)
        yield from sums(words)

    totals = docs.select("lang", "text").mapInArrow(counted, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    totals = materialize(totals)
    spoken = totals.where((F.col("kind") == 1) & (F.col("n") >= min_words)).select("lang")  # one language at most for so many words of the corpus
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")))
    out: dict = {}
    # one limit on the rank, so that each partition sends its highest alone; it leaves the few rows of the other kinds whole
    for r in ranked.where(F.col("rank") <= max(common, _CLASSES)).join(spoken, "lang").collect():
        ref = out.setdefault(r.lang, (np.zeros(_CLASSES), {}, [0]))
        if r.kind == 2:
            ref[0][r.key] = r.n
        elif r.kind == 1:
            ref[2][0] = r.n
        elif r.rank <= common:
            ref[1][r.key] = r.n
    done = {}
    for lang, (classes, words, total) in sorted(out.items()):
        if words and total[0] >= min_words:
            keys = sorted(words, key=lambda k: k % 2**64)  # as unsigned, in which they are looked up
            counts = np.array([words[k] for k in keys], float)
            done[lang] = classes, np.array(keys, np.int64).view(np.uint64), np.append(counts, total[0] - counts.sum())
    return done


def judge(docs: DataFrame, refs: dict[str, tuple], max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The base counts of each document, its distances from the reference, base_failed and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def rows(batches):
        refs = shared.value
        for batch in slices(batches, "text"):
            data, off = text_buffer(batch.column("text"))
            spans = starts, ends, of = word_spans(data, off)
            n = batch.num_rows
            counts = base_counts(data, off, spans)
            hashes, classes = span_hashes(data, starts, ends, lower=True), class_histogram(data, off)
            langs = np.array(batch.column("lang").to_pylist(), object)
            pairs, told = np.zeros((2, n)), np.zeros(n, bool)

            def distances(lang, mine):
                """The distances of the rows ``mine`` from a language's reference."""
                ref_classes, ref_words, ref_counts = refs[lang]
                place = np.cumsum(mine) - 1
                said = mine[of]
                at = np.minimum(np.searchsorted(ref_words, hashes[said]), len(ref_words) - 1)
                at = np.where(ref_words[at] == hashes[said], at, len(ref_words))
                k = int(mine.sum())
                histogram = np.bincount(place[of[said]] * (len(ref_words) + 1) + at, minlength=k * (len(ref_words) + 1)).reshape(k, -1)
                return np.stack([js_distance(classes[mine], ref_classes), js_distance(histogram, ref_counts)])

            for lang in {x for x in langs if x in refs}:
                mine = langs == lang
                pairs[:, mine], told[mine] = distances(lang, mine), True
            if refs and not told.all():  # the nearest of any language
                every = np.stack([distances(lang, ~told) for lang in refs])
                pairs[:, ~told] = np.take_along_axis(every, every.sum(1).argmin(0)[None, None, :], 0)[0]
            n_chars = classes.sum(1)
            words = counts["n_words"]
            failed = (words < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
            odd = (n_chars >= MIN_CHARS) & (pairs[0] > max_class) | (words >= MIN_JUDGED_WORDS) & (pairs[1] > max_word)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *(pa.array(counts[k].astype(np.int64)) for k in names), pa.array(pairs[0]), pa.array(pairs[1]), pa.array(failed), pa.array(~failed & ~odd)],
                names=["doc_id", "lang", *names, "class_distance", "word_distance", "base_failed", "kept"],
            )

    return docs.select("doc_id", "lang", "text").mapInArrow(rows, f"{_SCHEMA}, class_distance double, word_distance double, base_failed boolean, kept boolean")
