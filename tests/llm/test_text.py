"""Near duplicates, packing, suffix index, quality, toxicity, pages, decontamination: against brute force on small inputs."""

from __future__ import annotations

import collections
import gc
import html as html_module
import math
import random
import re
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import common, decontam, html, ngram_join, packing, quality, queries, suffix, toxicity
from gridloom.llm.common import text_buffer
from gridloom.llm.components import components
from tests.conftest import DATA

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in texts], DOCS)


def rare_words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def texts():
    """Unrelated documents, groups of near copies of different closeness, exact copies, a shared passage, and odd cases."""
    rng, out = random.Random(5), []
    passage = " ".join(rare_words(rng, 60))
    for _ in range(25):
        out.append(" ".join(rare_words(rng, rng.randrange(5, 120))) + " " + passage)
    for _ in range(6):
        base = rare_words(rng, 150)
        out += [" ".join(edited(rng, base, rng.randrange(0, 5))) for _ in range(14)]
    out += ["Same Text here\tand THERE again and on"] * 6 + ["same text here and there again and on"]
    out += [None, "", "  \n", "one", "one", "ONE two", "one two three", "one two three", "é É", "É é", "x" * 20_000, "long " * 5_000]
    return list(enumerate(out))


def shingles(text, n):
    w = re.findall(WORD, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, texts, n, percent):
    sets = {i: shingles(t, n) for i, t in texts}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, texts), n, percent).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_ids_with_several_texts(spark):
    rng = random.Random(11)
    a, b = rare_words(rng, 150), rare_words(rng, 150)
    rows = [(10, " ".join(a)), (10, " ".join(b)), (20, " ".join(edited(rng, a, 1))), (30, " ".join(edited(rng, b, 1)))]
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()) == [(10, 10), (10, 10), (20, 10), (30, 10)]
    # forty ids, each with several of a few groups' texts
    bases = [rare_words(rng, 120) for _ in range(12)]
    rows = [(rng.randrange(40), " ".join(edited(rng, rng.choice(bases), rng.randrange(0, 6)))) for _ in range(110)]
    sets = [shingles(t, 5) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                parent[root(x)] = root(y)
    least = collections.defaultdict(lambda: 99)
    for x, (i, _) in enumerate(rows):
        least[root(x)] = min(least[root(x)], i)
    want = collections.Counter((i, len(sets[x]), least[root(x)]) for x, (i, _) in enumerate(rows))
    got = ngram_join.jaccard_components(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    # a group's number tells groups apart that share their smallest id
    assert len({(r.component_id, r.group_id) for r in got}) == len({root(x) for x in range(len(rows))})


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v")]
    got = ngram_join.jaccard_components(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 2)]
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(11, 61)}, **{100 + i: 100 for i in range(1, 40)}}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit(sizes):
    bins, offsets, fill = packing.best_fit(np.array(sizes, np.int64), 64)
    used = collections.defaultdict(list)
    for b, o, s in zip(bins, offsets, sizes, strict=True):
        used[b].append((o, s))
    for b, places in used.items():
        at = 0
        for o, s in sorted(places):
            assert o == at
            at += s
        assert at == fill[b] <= 64


def test_unit_encoder(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok, own = Tokenizer.from_file(path), packing.UnitEncoder(path)

    def same(texts):
        ids, counts = own.encode(*text_buffer(pa.array(texts)))
        for part, e in zip(np.split(ids, np.cumsum(counts)[:-1]), tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False), strict=True):
            assert part.tolist() == e.ids

    every = [chr(c) for c in range(1, 0x3400) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3400, 0x1FFFF, 97) if not 0xD800 <= c < 0xE000]
    same([f"a{c}b {c} {c}{c} C{c}1 '{c} .{c}. s{c}'s" for c in every])
    same(["it's 'street ''s don't we'll they're I've I'm he'd 'l 'r 'v 'rev 'llx 'LL 'S can't. \"'s x'", "", None, "<|endoftext|> a<|endoftext|>b <| x", "x" * 20_000, "'s", "'", "a'"])
    rng, alphabet = random.Random(3), [*"aZ'.sStTrevlLdm0 9\n<|>", "\u00e9", "\u00c9", "\u0301", "\u0436", "\u00a0", "\U0001f600"]
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    monkeypatch.setattr(packing, "CHUNK_BYTES", 300)  # long rows in stretches
    monkeypatch.setattr(packing, "CACHE_UNITS", 500)  # and units forgotten on the way
    same([*odd, "y" * 1000 + " " + "z" * 700, " ".join(odd)])


def test_packing_takes_any_names_and_ids(spark):
    pieces = spark.range(50).select("id", (F.col("id") + 1).alias("length"), F.lit("x").alias("bin"), F.lit(7).alias("offset"), F.lit("y").alias("root"))
    got = packing.pack(pieces, 100, 0).collect()
    assert len(got) == 50 and {(r.bin, r.root) for r in got} == {("x", "y")}
    ends = collections.defaultdict(list)
    for r in got:
        ends[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(o for o, _ in p) == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] for p in ends.values())
    named = spark.createDataFrame([("a", "x y"), (None, None)], "doc_id string, text string")
    assert {r.doc_id for r in packing.pack_documents(named, packing.tokenizer_path()).collect()} == {"a", None}
    assert packing.pack_documents(named.limit(0), packing.tokenizer_path()).count() == 0


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    rows = [*texts, (500, "<|endoftext|> a<|startoftext|>b 's don't x 12 3"), (501, "word " * 5000), (501, "word " * 5000), (None, "q")]
    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack_documents(frame(spark, rows), packing.tokenizer_path(), 256).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for k, s in enumerate(range(0, len(ids), 256)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.02 * len(packing.best_fit(np.array([r.length for r in got]), 256)[2]) + 1


def test_packing_takes_one_worker_a_task(spark, monkeypatch):
    plans, write = [], packing.materialize

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(packing, "materialize", noted)
    assert packing.pack_documents(frame(spark, [(1, "a b"), (2, None)]), packing.tokenizer_path()).count() == 2
    assert [p.count("MapInArrow") for p in plans if "MapInArrow" in p] == [1]


def test_another_operator_frees_the_encoder():
    rows, path = pa.RecordBatch.from_pydict({"text": ["a b"]}), packing.tokenizer_path()
    held = weakref.ref(packing.encoder(path))
    assert packing.encoder(path) is held()
    list(common.slices([rows], "text"))
    gc.collect()
    assert held() is None
    held = weakref.ref(packing.encoder(path))
    list(common.slices([rows], "text", keep=packing.UnitEncoder))
    assert packing.encoder(path) is held()


def test_packing_in_small_groups(spark):
    pieces = spark.range(2000).select("id", (F.col("id") * 37 % 100 + 1).alias("length"))
    got = packing.pack(pieces, 100, 0, 150).collect()
    bins = collections.defaultdict(int)
    for r in got:
        bins[r.sequence_id] += r.length
    assert len(got) == 2000 and max(bins.values()) <= 100 and len(bins) <= 1.05 * sum(bins.values()) / 100 + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12).map(lambda b: bytes(c % 3 + 97 for c in b)), min_size=1, max_size=6))
def test_matching_statistics(parts):
    data, sizes = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
    ends = np.repeat(np.cumsum(sizes), sizes)

    def common(a, b):
        n = 0
        while a + n < ends[a] and b + n < ends[b] and data[a + n] == data[b + n]:
            n += 1
        return n

    assert suffix.matching_statistics(data, sizes).tolist() == [max([0, *(common(a, b) for b in range(len(data)) if b != a)]) for a in range(len(data))]


@pytest.mark.parametrize("block_segments", [suffix.BLOCK_SEGMENTS, 2])
def test_repeats(spark, texts, block_segments, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 3000)  # long texts in stretches
    rng = random.Random(2)
    whole = " ".join(rare_words(rng, 200))
    rows = [*texts, (600, whole), (601, "head " + whole[100:700] + " tail"), (602, whole[300:480]), (603, "ab" * 400), (604, "é" * 150), (605, whole[:400] + whole[:400]), (606, whole), (606, whole), (None, whole)]
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (suffix.LENGTH, block_segments))
    got = collections.Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in suffix.remove_repeats(frame(spark, rows)).collect())
    seen = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    want = collections.Counter()
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        want[(i, len(b), tuple(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(c for c, g in zip(b, gone, strict=False) if not g))] += 1
    assert got == want


def test_quality_counts(spark, texts):
    rows = [*texts, (700, "a b c a b c\na b\na b\n \n \n#x*|é"), (701, "x y " * 60)]
    found = {r.doc_id: r for r in quality.judge(frame(spark, rows), {}).collect()}
    for i, t in rows:
        w = re.findall(WORD, t or "")
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(WORD, line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), failed, not failed)


def test_quality_rejects_other_distributions(spark):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for c in ("", "er", "ly", "ed") for b in ("", "re", "on", "st", "ti", "an") for a in ("the", "and", "of", "in", "to", "is", "was", "for", "with", "by")]
    weights = [1 / (k + 3) for k in range(len(vocabulary))]
    prose = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    rows = [(i, prose(200)) for i in range(60)] + [(90, " ".join(x + "%%%" for x in prose(200).split())), (91, " ".join(f"zz{rng.randrange(10**6)}" for _ in range(200))), (92, None), (93, "")]
    df = frame(spark, rows)
    odd = df.union(spark.createDataFrame([(94, prose(200), None, 1), (95, prose(200), "xx", 1)], DOCS))
    kept = {r.doc_id: r.kept for r in quality.judge(odd, quality.references(odd)).collect()}
    assert all(kept[i] for i in [*range(60), 94, 95]) and not any(kept[i] for i in (90, 91, 92, 93))


def test_quality_references_count_all_rows(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(6000)]
    rows = [(i, " ".join(words[i * 100 : i * 100 + 100]), "xx", 0) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choices(words[:300], k=200) + ["rare"] * (i == 0)), "yy", 0) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    one, many = (quality.references(df.repartition(k, "doc_id"), common=400) for k in (1, 7))
    for lang, n in (("xx", 400), ("yy", 301)):
        assert len(one[lang][1]) == len(many[lang][1]) == n
        assert all((a == b).all() for a, b in zip(one[lang], many[lang], strict=True))
    assert one["yy"][2][-1] == 0 and quality.judge(df, quality.references(df)).count() == 120


def test_quality_kept_by_brute_force(spark):
    """The verdict of every document of a corpus in three languages, from histograms counted word by word."""
    rng = random.Random(6)
    vocabularies = {lang: [f"{a}{b}" for a in first for b in ("", "re", "on", "st", "ti", "an", "er")] for lang, first in (("xx", ["the", "and", "of", "in"]), ("yy", ["der", "und", "von", "bei"]), ("zz", ["q"]))}
    rows = []
    for i in range(160):
        lang = ("xx", "yy", None, "qq")[i % 4]
        own = vocabularies[lang if lang in ("xx", "yy") else "xx" if i % 3 else "yy"]
        words = rng.choices(own, [1 / (k + 3) for k in range(len(own))], k=rng.randrange(10, 220))
        if i % 10 == 0:
            words = [f"{w}%%{rng.randrange(99)}" for w in words]
        if i % 10 == 1:
            words = [f"n{rng.randrange(10**6)}" for _ in words]
        rows.append((i, " ".join(words).upper() if i % 10 == 2 else " ".join(words), lang, 0))
    rows += [(900, None, "xx", 0), (901, "", None, 0), (902, "Q " * 30, "zz", 0)]
    df = spark.createDataFrame(rows, DOCS)

    def classes(t):
        out = [0] * 8
        for c in t:
            out[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\r\x0b\x0c" else 4 if c in ".,;:!?'\"()-" else 7 if ord(c) > 127 else 6 if ord(c) < 32 or ord(c) == 127 else 5] += 1
        return out

    def distance_of(p, q):
        p, q = ([x / max(sum(v), 1e-300) for x in v] for v in (p, q))
        part = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x)
        return math.sqrt(min(1, max(0, (part(p, q) + part(q, p)) / 2)))

    said = {lang: collections.Counter(w for r in rows if r[2] == lang for w in re.findall(WORD, (r[1] or "").lower())) for lang in {r[2] for r in rows} - {None}}
    tops = {lang: c.most_common() for lang, c in said.items() if c.total() >= 300}
    assert set(tops) == {"xx", "yy", "qq"}
    common = next(k for k in range(6, 30) if all(t[k - 1][1] > t[k][1] for t in tops.values()))  # no tie at the edge
    refs = {lang: ([sum(x) for x in zip(*(classes(r[1] or "") for r in rows if r[2] == lang), strict=True)], dict(t[:common]), said[lang].total()) for lang, t in tops.items()}
    judged = {r.doc_id: r for r in quality.judge(df, quality.references(df, common=common, min_words=300)).collect()}
    verdicts = collections.Counter()
    for i, t, lang, _ in rows:
        words = re.findall(WORD, (t or "").lower())
        pairs = {}
        for name, (ref, top, total) in refs.items():
            own = collections.Counter(words)
            histogram = [own[w] for w in top] + [len(words) - sum(own[w] for w in top)]
            pairs[name] = distance_of(classes(t or ""), ref), distance_of(histogram, [*top.values(), total - sum(top.values())])
        a, b = pairs[lang] if lang in pairs else min(pairs.values(), key=sum)
        r = judged[i]
        assert (r.class_distance, r.word_distance) == (pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9))
        odd = len(t or "") >= quality.MIN_CHARS and a > quality.MAX_CLASS_DISTANCE or len(words) >= quality.MIN_JUDGED_WORDS and b > quality.MAX_WORD_DISTANCE
        assert r.kept == (not r.base_failed and not odd)
        verdicts[r.base_failed, r.kept] += 1
    assert len(verdicts) == 3


def test_quality_word_limit_lies_below_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    judged = quality.judge(docs, quality.references(docs)).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in judged if r.quality == 1)
    assert not [r.word_distance for r in judged if r.quality == 0 and r.kept and r.word_distance > 0.5]


def test_js_distance():
    p, q = np.array([[1.0, 0], [1, 1], [0, 2]]), np.array([1.0, 0])
    got = quality.js_distance(p, q)
    assert got[0] == 0 and got[2] == 1 and got[1] == pytest.approx(np.sqrt(0.5 * (np.log2(4 / 3) + 0.5 * np.log2(2 / 3) + 0.5)))


def test_ftrl_against_plain_python():
    rng = np.random.default_rng(2)
    features = [np.unique(rng.integers(0, 64, rng.integers(0, 12))).astype("<u4") for _ in range(300)]
    labels = np.array([float(len(f) > 0 and f.min() < 6) for f in features])
    w, bias = toxicity.fit(features, labels, bits=6, epochs=3)
    z, n, l1 = collections.defaultdict(float), collections.defaultdict(float), toxicity.L1_RATE * 300**0.5

    def weight(k):
        rate = 0 if k == "bias" else l1
        if abs(z[k]) <= rate:
            return 0.0
        return -(z[k] - math.copysign(rate, z[k])) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for i in order.permutation(300).tolist():
            keys = [*features[i].tolist(), "bias"]
            own = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(own.values()))) - labels[i]
            for k in keys:
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / toxicity.ALPHA * own[k]
                n[k] += g * g
    assert bias == pytest.approx(weight("bias")) and w == pytest.approx([weight(k) for k in range(64)])
    assert 0 < np.count_nonzero(w) < 64


def test_toxicity_learns_held_out(spark):
    rng = random.Random(9)
    bad = ["scum", "moron", "trash"]
    rows = []
    for i in range(900):
        words = rare_words(rng, 60)
        if toxic := i % 5 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", ".", "!!!"])
        rows.append((i, " ".join(words), int(toxic)))
    docs = frame(spark, [r[:2] for r in rows[:600]] + [(10_000, None), (10_001, "")])
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:600]] + [(None, 1), (99_999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    new = toxicity.scored(frame(spark, [r[:2] for r in rows[600:]] + [(10_000, None), (10_001, "")]).withColumn("Score", F.lit("x")), model)
    got = {r.doc_id: r["_score"] for r in new.collect()}
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in range(600, 900)]) > 0.97
    assert 0 <= got[10_000] == got[10_001] < 0.5
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


PAGES = "page_id long, url string, html string, text string"


def test_html_of_the_tables(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op9_html_extract(spark, DATA).collect():
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html_module.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_html_cases(spark):
    chrome = '<div class="top">Site name</div><div id="x">{}</div><div>Imprint and such</div>'
    rows = [(i, "http://a.example/p", f"<html><body>{chrome.format(f'<p>Own text {i}</p>')}</body></html>", "x") for i in range(8)]
    rows += [
        (20, None, None, "x"),
        (21, "", "", "x"),
        (22, "http://b.example", "<article><h1>T &amp; U</h1><p>a<b>b</b>c<br>d&nbsp;e<p>f<aside>no</aside><div class='comments'>no</div><ul><li>g<li>h</ul><script>if(a<b)no()</script></article><p>outside", "x"),
        (23, "http://b.example", "<p>plain &lt;b&gt; &#233; &unknown; <form><input>no</form>end", "x"),
        (24, "http://b.example", "text only < 3 and > 2", "x"),
        (25, "http://b.example", "<main><p>cut <b", "x"),
        (26, "http://b.example", "<div hidden>no</div><!-- no --><div role=navigation>no</div><table><tr><td>1<td>2</table>", "x"),
    ]
    df = spark.createDataFrame(rows, PAGES)
    want = {**{i: f"Own text {i}" for i in range(8)}, 20: "", 21: "", 22: "T & U abc d e f g h", 23: "plain <b> é &unknown; end", 24: "text only < 3 and > 2", 25: "cut", 26: "1 2"}
    for limit in (html.BROADCAST_ROWS, 0):
        assert {r.page_id: r.text for r in html.extract(df, broadcast_rows=limit).collect()} == want
    assert html.extract(df.limit(0)).count() == 0


def test_html_boxes_inside_articles(spark):
    box = "<div class='xyz'><p>Read this too</p><ul><li>that</ul></div><section>Seen by many</section><p class=k7>Tell a friend</p>"
    own = lambda i: f"<h1>News</h1><p>Own text {i}</p><p>Free licence</p><ul><li>one<li>{i}</ul>"
    rows = [(i, "http://a.example/p", f"<main><div>Site</div><article>{own(i)}{box}</article></main>", "x") for i in range(8)]
    # copies of one article, with a wrapper around their text and a changing box
    rows += [(20 + i, "http://b.example/p", f"<article><div class=body><h1>Same</h1><p>Same text</p></div><div class=n>{i}</div></article>", "x") for i in range(8)]
    rows += [(40 + i, "http://c.example/p", f"<main><div>{i}</div><div class=wrap><article><p>Same text</p></article></div></main>", "x") for i in range(8)]
    df = spark.createDataFrame(rows, PAGES)
    want = {**{i: f"News Own text {i} Free licence one {i}" for i in range(8)}, **{20 + i: f"Same Same text {i}" for i in range(8)}, **{40 + i: f"{i} Same text" for i in range(8)}}
    for limit in (html.BROADCAST_ROWS, 0):
        assert {r.page_id: r.text for r in html.extract(df, broadcast_rows=limit).collect()} == want


def test_html_counts_decide(spark):
    """Templates planted inside and outside articles go by their counts alone, hinted names only where the counts know them."""
    box = "<div class=zz><p>Join us {}</p></div>"
    page = lambda i, k: f"<div><p>Site line {k}</p></div><article><h1>H {i}</h1><p>Own {i}</p><section>Box {k}</section><p class=q>Call {k}</p><div class='related'>See {i}</div></article><div><p>Imprint {k}</p></div>"
    rows = [(i, f"http://h{i % 4}.example/{i}", page(i, i % 4), "x") for i in range(48)]
    rows += [(100 + i, "http://bare.example/x", f"<div>Top</div><p>Own {i}</p>{box.format('now')}<div>Bottom</div>", "x") for i in range(9)]
    rows += [(200, "http://h0.example/odd", "<article><h1>H</h1><p>Own</p><div class='widget-area'>Its own box</div></article>", "x"), (201, "http://small.example/", "<p>Own</p><div class='widget-area'>Its own box</div>", "x")]
    df = spark.createDataFrame(rows, PAGES)
    want = {**{i: f"H {i} Own {i}" for i in range(48)}, **{100 + i: f"Own {i}" for i in range(9)}, 200: "H Own Its own box", 201: "Own"}
    for limit in (html.BROADCAST_ROWS, 0):
        assert {r.page_id: r.text for r in html.extract(df, broadcast_rows=limit).collect()} == want
    # without the counts every template stays
    bare = {r.page_id: r.text for r in html.extract(df, min_pages=10**6).collect()}
    assert all(bare[i] == f"H {i} Own {i} Box {i % 4} Call {i % 4}" for i in range(48)) and bare[100] == "Top Own 0 Join us now Bottom"
    # a share of a large host's pages has an upper bound
    big = spark.createDataFrame([(i, "http://big.example/", f"<p>Own {i}</p>" + (f"<div>Part {i // 60}</div>" if i < 120 else ""), "x") for i in range(2000)], PAGES)
    assert {r.text for r in html.extract(big).collect()} == {f"Own {i}" for i in range(2000)}


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    best = min(row)
    return best, row.index(best)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=20), st.integers(0, 6))
def test_myers(pattern, text, most):
    best, end = distance(pattern, text)
    got = decontam.distances(pattern, text, most)
    if best > most:
        assert got is None
    elif end:
        assert got == (best, end)


def test_leaks(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rare_words(rng, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "Short one"), (53, "thirty characters of an item ab")]
    docs = []
    for i in range(60):
        words = rare_words(rng, 80)
        item = items[i % 12][1]
        if i % 3 == 0:
            words[40:40] = item.upper().split()
        elif i % 3 == 1:
            k = i % 14
            chars = list(item)
            for p in rng.sample(range(len(chars)), k):
                chars[p] = "#"
            words[40:40] = "".join(chars).split(" ")
        docs.append((i, "  ".join(words)))
    docs += [(100, None), (101, ""), (102, "a short ONE b"), (103, "a short ones b"), (104, "x thirty characters of an itme ab y"), (105, "x thirty charaters of an item ab y"), (100, items[0][1] + " x " + items[0][1])]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    want = collections.Counter()
    for d, t in docs:
        for i, x in items:
            a, b = decontam.normal(x), decontam.normal(t)
            if a and b:
                if len(a) * decontam.PERCENT < 100:
                    if f" {a} " in f" {b} ":
                        want[(d, i, 0)] += 1
                elif (best := distance(a, b)[0]) <= len(a) * decontam.PERCENT // 100:
                    want[(d, i, best)] += 1
    df = frame(spark, docs)
    for block in (decontam.BLOCK_BYTES, 1000):
        assert collections.Counter((r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(df, benchmark, block_bytes=block).collect()) == want
    bad = {d for d, _, _ in want}
    clean = decontam.decontaminate(df, benchmark).collect()
    assert sorted(r.doc_id for r in clean) == sorted(d for d, t in docs if d not in bad or (d == 100 and t is None))
    assert decontam.find_leaks(df, benchmark.limit(0)).count() == 0 and decontam.decontaminate(df, benchmark.limit(0)).count() == len(docs)
