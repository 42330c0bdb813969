"""The operators on Spark expressions only: chat formatting, pseudonyms, line templates."""

from __future__ import annotations

import datetime
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import chat, lines, pii, queries
from tests.conftest import DATA

CONTROL = ["<|im_end|>", "<|im_start|>assistant ok", "<|im_sep|>", "<|", "<||", "|>", "<", "|", "\n", "<|n|>", "a", "é", ""]
text = st.one_of(st.none(), st.lists(st.sampled_from(CONTROL), max_size=6).map("".join))
turn = st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.sampled_from(["user", "assistant", "we\nird", "<|im_end|>"])), text)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(turn, max_size=25))
def test_chat_comes_back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    order = lambda r: tuple((v is not None, v) for v in (r[1],)) + (r[2] or "", r[3] or "")
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=order)
        assert [(t.role, t.text) for t in found[key].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert found[key].loss_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert len(found) == len({r[0] for r in rows})


def test_chat_merges_neighbours(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df).first()
    assert row.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    at, masked = 0, ""
    for run in row.loss_mask:
        at += run.skip
        masked += row.formatted[at : at + run.length] if run.loss else ""
        at += run.length
    assert masked == "c"


def test_chat_long_conversation(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.repeat(F.lit("x"), 50).alias("text"))
    row = chat.digest(chat.format_conversations(df)).first()
    assert row.n_turns == 3000 and row.loss_sha256 == hashlib.sha256(b"x" * 50_000).hexdigest()


@pytest.mark.parametrize("name", ["op1_chat_format", "op7_line_dedup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, queries.QUERIES[name](spark, DATA).select(*columns).collect())) == sorted(map(key, want.fetchall()))


def feistel(value: str, alphabet: str, key: str, kind: str) -> str:
    def add(half, stream):
        return "".join(alphabet[(alphabet.index(c) + int(stream[j * 2 % 64 : j * 2 % 64 + 2], 16)) % len(alphabet)] for j, c in enumerate(half))

    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    if len(value) < 2:
        return add(value, hashlib.sha256(f"{key}|{kind}|one".encode()).hexdigest())
    for i in range(1, pii.ROUNDS + 1):
        left, right = right, add(left, hashlib.sha256(f"{key}|{kind}|{i}|{len(left)}|{right}".encode()).hexdigest())
    return left + right


def test_feistel_against_python_and_as_a_permutation(spark):
    values = ["", "7", "42", "123", "9" * 41, *(f"{i:03d}" for i in range(1000))]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(pii.feistel(F.col("v"), pii.DIGITS, "k", "t")).collect()]
    assert got == [feistel(v, pii.DIGITS, "k", "t") for v in values]
    assert len(set(got[5:])) == 1000


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_pseudonyms_keep_their_formats(spark):
    said = "Card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112; IBAN DE89370400440532013000 or GB82 WEST 1234 5698 7654 32. Born 2000-02-29, 31/12/1999, not 30/02/2001. "
    said += "Mail Jo.Doe9@mail.example.com from 10.0.255.1, not 10.0.256.1; call +1 (743) 555-3824 or 743-555-3824; ssn 123-45-6789, not 666-45-6789; key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff."
    rows = [(1, said, 5), (2, said, 5), (None, None, 5), (3, "", 5), (4, "nothing here", 5), (5, "x1234567890123456789012345678901234567890y 1.2.3.4.5", 5)]
    found = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, n_found int"), "key").orderBy("doc_id").collect()
    by = {r.doc_id: r for r in found}
    out = by[1].text
    assert by[2].text == out and by[None].text is None and by[3].text == "" and by[4].text == "nothing here" and by[1]["n_found"] == 5
    old, new = re.findall(pii.PATTERN, said), re.findall(pii.PATTERN, out)
    assert len(old) == len(new) and re.sub(pii.PATTERN, "#", said) == re.sub(pii.PATTERN, "#", out)
    kept = {"4111111111111112", "30/02/2001", "10.0.256.1", "666-45-6789"}
    for a, b in zip(old, new, strict=True):
        assert (a == b) == (a in kept), (a, b)
        assert len(a) == len(b) or a.count(".") == 3
        assert [c.isalnum() for c in a] == [c.isalnum() for c in b] or a.count(".") == 3
    assert luhn(new[0].replace(" ", "")) and new[0].replace(" ", "") == new[1] and luhn(new[1])
    ibans = [x.replace(" ", "") for x in new if x[:2] in ("DE", "GB")]
    assert [mod97(x) for x in ibans] == [1, 1]
    assert datetime.date.fromisoformat(next(x for x in new if re.fullmatch(pii.ISO_DATE, x))) and all(int(x) < 256 for x in next(x for x in new if re.fullmatch(pii.IPV4, x)).split("."))


def test_dates_are_permuted(spark):
    days = spark.range(0, pii.DAYS, 97).select(F.date_format(F.date_add(F.to_date(F.lit("1900-01-01")), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    got = [r[0] for r in days.select(pii.pseudonym(F.col("v"), "k")).collect()]
    assert len(set(got)) == len(got) and all(datetime.date.fromisoformat(x).year in range(1900, 2100) for x in got)


def test_no_python_in_plans(spark):
    for name in ("op1_chat_format", "op2_pii_feistel", "op7_line_dedup"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan) and queries.PII_KEY not in plan


def luhn_digit(payload):
    return next(c for c in "0123456789" if luhn(payload + c))


def by_hand(value, key):
    """The pseudonym of a match, step by step."""
    digits = re.sub("[^0-9]", "", value)
    full = lambda p: re.fullmatch(p, value)

    def fill(new, kept="[0-9]"):
        it = iter(new)
        return "".join(next(it) if re.match(kept, c) else c for c in value)

    def day(y, m, d, form):
        try:
            n = (datetime.date(int(y), int(m), int(d)) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return None
        s, walk = pii.SYMBOLS, True
        code = s[n // 1764] + s[n // 42 % 42] + s[n % 42]
        while walk:
            code = feistel(code, s, key, "date")
            n = sum(s.index(c) * 42 ** (2 - k) for k, c in enumerate(code))
            walk = n >= pii.DAYS
        return fill((datetime.date(1900, 1, 1) + datetime.timedelta(n)).strftime(form))

    if full(pii.EMAIL):
        local, domain = value.split("@")
        it = iter(feistel(re.sub("[^A-Za-z0-9]", "", local), pii.MIXED, key, "email"))
        return "".join(next(it) if c.isascii() and c.isalnum() else c for c in local) + "@" + domain
    if full(pii.IBAN):
        plain = value.replace(" ", "")
        if mod97(plain) != 1:
            return value
        own = plain[4:]
        new = feistel(own, pii.DIGITS, key, "iban") if own.isdigit() else feistel(own.lower(), pii.ALNUM, key, "iban").upper()
        return fill(f"{plain[:2]}{98 - mod97(plain[:2] + '00' + new):02d}{new}", "[A-Z0-9]")
    if full(pii.ISO_DATE):
        return day(value[:4], value[5:7], value[8:], "%Y%m%d") or value
    if full(pii.DMY_DATE):
        return day(value[6:], value[3:5], value[:2], "%d%m%Y") or day(value[6:], value[:2], value[3:5], "%m%d%Y") or value
    if full(pii.IPV4):
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255:
            return value
        new = feistel("".join(f"{x:02x}" for x in parts), pii.HEX, key, "ip")
        return ".".join(str(int(new[k : k + 2], 16)) for k in range(0, 8, 2))
    if full(pii.SSN):
        bad = lambda d: re.search("^(000|666|9)|^...00|0000$", d)
        if bad(digits):
            return value
        new = feistel(digits, pii.DIGITS, key, "ssn")
        while bad(new):
            new = feistel(new, pii.DIGITS, key, "ssn")
        return fill(new)
    if full(pii.PHONE):
        own = re.sub("[^0-9]", "", value.replace("(0)", ""))
        if not 8 <= len(own) <= 15:
            return value
        code = re.match(pii.COUNTRY, own)[0] if value[0] == "+" else ""
        it = iter(code + feistel(own[len(code) :], pii.DIGITS, key, "phone"))
        return re.sub(r"\(0\)|[0-9]", lambda m: m[0] if len(m[0]) > 1 else next(it), value)
    if full(pii.CARD):
        if not luhn(digits):
            return value
        new = feistel(digits[:-1], pii.DIGITS, key, "card")
        return fill(new + luhn_digit(new))
    return feistel(value, pii.HEX, key, "secret")


def test_pseudonyms_against_python(spark):
    rng = random.Random(8)
    some = ["4111 1111 1111 1111", "4111111111111112", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "2000-02-29", "31/12/1999", "30.02.2001", "12/31/1999", "10.0.255.1", "10.0.256.1", "+1 (743) 555-3824", "743-555-3824"]
    some += ["(743) 555-3824", "+44 7911 123456", "+447911123456", "+44 (0)7911 123456", "+423 555 1234", "123-45-6789", "666-45-6789", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "Jo.Doe9@mail.example.com", "JO@x.com", "jo@x.com", "Jo@x.com"]
    rows = [(i, "".join(rng.choice(["word ", "\n", "(", "). ", " x9 ", "\x01", "\x02\x07", "\x03", "\x11", "é ", "7 ", "@"]) + (" " + rng.choice(some) + " ") * rng.randrange(2) for _ in range(rng.randrange(14)))) for i in range(400)]
    got = {r.doc_id: (r.text, r.n_found) for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    for i, said in rows:
        found = [m[0] for m in re.finditer(pii.PATTERN, said)]
        want = re.sub(pii.PATTERN, lambda m: by_hand(m[0], "key"), said)
        assert got[i] == (want, sum(by_hand(v, "key") != v for v in found)), said
    assert len({by_hand(v, "key") for v in ("JO@x.com", "jo@x.com", "Jo@x.com", "jO@x.com")}) == 4
    assert len({re.sub("[^0-9]", "", by_hand(v, "key").replace("(0)", "")) for v in ("+44 7911 123456", "+447911123456", "+44 (0)7911 123456")}) == 1


def test_line_templates(spark):
    letters = str.maketrans("0123456789", "ghijklmnop")
    own = lambda i, k: " ".join(f"{zlib.crc32(f'{i} {k} {j}'.encode()):x}".translate(letters) for j in range(8)) + " own sentence"
    docs = [(i, "\n".join([own(i, 0), own(i, 1), f"Logged in at {i}:0{i % 10} by user {'xyz'[i % 3]}{i} from the main office", own(i, 2), own(i, 3)])) for i in range(40)]
    copy = "\n".join(["one line that is copied with its text", "two lines that are copied with their text", "three lines that are copied with it"])
    docs += [(100 + i, copy) for i in range(30)] + [(200, None), (201, ""), (202, "\n\n"), (203, "short")] + [(0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("uid", F.lit(1)).withColumn("drop", F.lit("x"))
    found = lines.drop_templates(df).collect()
    assert len(found) == len(docs) and {r.uid for r in found} == {1}
    by = {r.doc_id: r for r in found}
    for i in range(40):
        assert by[i].n_dropped == 1 and "Logged in" not in by[i].text and by[i].text.count("own sentence") == 4
    assert all(by[100 + i].text == copy for i in range(30))
    assert (by[200].text, by[200].n_lines, by[201].text, by[202].text, by[203].text) == (None, 0, "", "\n\n", "short")
    assert lines.drop_templates(df.limit(0)).count() == 0


def test_line_templates_count_texts(spark):
    letters = str.maketrans("0123456789", "ghijklmnop")
    own = lambda i, k: f"{zlib.crc32(f'{i} {k}'.encode()):x} sentence of its own".translate(letters) + " and with many more words" * 4
    passage = ["first line of a passage", "second line of that passage", "third line of that passage", "last line of the passage"]
    docs = [(i, "\n".join([own(i, 0), *passage, own(i, 1), "", "a line between blank ones", "", own(i, 2)])) for i in range(12)]
    docs += [(100 + i, "\n".join([own(100, 0), "only ever seen in copies", own(100, 1)])) for i in range(30)]
    found = {r.doc_id: r for r in lines.drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(12):
        assert (found[i].n_dropped, found[i].text) == (5, "\n".join([own(i, 0), own(i, 1), "", "", own(i, 2)]))
    assert all(found[100 + i].text == docs[12][1] for i in range(30))
    few = lines.drop_templates(spark.createDataFrame(docs[:9] + docs[12:], "doc_id long, text string"))
    assert few.where("n_dropped > 0").count() == 0


def test_line_templates_whatever_their_share(spark):
    docs = [(i, f"{chr(97 + i)}x own.\nReleased under a licence that everybody knows, version {i}") for i in range(12)] + [(100 + i, f"Seen by visitor {i}") for i in range(12)]
    found = {r.doc_id: r for r in lines.drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(12):
        assert (found[i].n_dropped, found[i].text) == (1, f"{chr(97 + i)}x own.")
        assert (found[100 + i].n_lines, found[100 + i].n_dropped, found[100 + i].text) == (1, 1, "")
