"""Removal of recurring lines by a log-template tree, with Spark expressions only.

Each line becomes tokens, those with a digit generalised to ``<*>``. A fixed-depth tree leads by token count and the first ``depth`` tokens to
a leaf. Below the leaf the other tokens form ``PARTS`` stretches by position; a template is a leaf with its stretches, and a line with a
variable field in one stretch still meets the template in the others. A line is dropped if three quarters of its stretches recur
in at least ``min_texts`` documents with different texts, whatever lines stand around it. Copies of a document are one text, so they don't
make a template by themselves; near copies are different texts and count one each. Such lines go
whatever their share of the document; a document left without lines has the empty text and stays a row.

Hot lines are counted with partial aggregates before each shuffle, and texts move once, at the end.

Defined cases: null text stays null with no lines; blank lines stay; rows with equal ids are told apart by their texts, equal rows are one
document; an empty table gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name, materialize

DEPTH, PARTS, MIN_TEXTS = 3, 4, 10


def generalised(line: Column) -> Column:
    """A line's tokens with one space between, those with a digit as ``<*>``."""
    plain = F.trim(F.regexp_replace(line, r"[\x09-\x0D\x20]+", " "))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(plain)


def _line_rows(docs: DataFrame, depth: int) -> DataFrame:
    """(uid, line, vote, leaf, parts) of the lines that have a token; docs: uid, text. Equal texts have one vote."""
    lines = docs.select("uid", F.xxhash64("text").alias("vote"), F.posexplode(F.split("text", "\n", -1)).alias("line", "l"))
    rows = lines.select("uid", "line", "vote", generalised(F.col("l")).alias("said")).where("said <> ''")
    rows = rows.select("uid", "line", "vote", F.split("said", " ").alias("tokens"))
    rest = F.size("tokens") - depth
    n = F.least(rest, F.lit(PARTS))
    cut = lambda k: F.floor(k * rest / n).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.xxhash64(k, F.slice("tokens", cut(k) + depth + 1, cut(k + 1) - cut(k))))
    return rows.select(
        "uid", "line", "vote", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"), F.when(rest > 0, parts).otherwise(F.array(F.lit(0).cast("long"))).alias("parts")
    )


def _recurring(rows: DataFrame, keys: list[str], min_texts: int) -> DataFrame:
    """The keys found in enough different texts; written, so that a join with them is broadcast where they are few, and splits hot keys where not."""
    votes = rows.select(*keys, "vote").distinct()
    return materialize(votes.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_texts).select(*keys))


def template_lines(docs: DataFrame, depth: int = DEPTH, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(uid, drop) of documents (uid, text) with recurring lines: their line numbers."""
    rows = materialize(_line_rows(docs, depth))
    some = rows.join(_recurring(rows, ["leaf"], min_texts), "leaf")
    parts = materialize(some.select("uid", "line", "vote", "leaf", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part")))
    keys = ["leaf", "k", "part"]
    hits = parts.join(_recurring(parts, keys, min_texts), keys).groupBy("uid", "line").agg(F.expr("bit_count(bit_or(shiftleft(1, k)))").alias("hits"), F.max("n").alias("n"))
    return hits.where("hits * 4 >= n * 3").groupBy("uid").agg(F.collect_set("line").alias("drop"))


def drop_templates(docs: DataFrame, depth: int = DEPTH, min_texts: int = MIN_TEXTS) -> DataFrame:
    """All columns of ``docs`` with the recurring lines gone from ``text``, and ``n_lines`` and ``n_dropped``."""
    uid, drop, taken = (free_name(docs, n) for n in ("uid", "drop", "taken"))
    keyed = docs.withColumn(uid, F.xxhash64("doc_id", "text"))
    found = template_lines(keyed.select(F.col(uid).alias("uid"), "text"), depth, min_texts).select(F.col("uid").alias(uid), F.col("drop").alias(drop))
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(drop), i)), "\n")
    joined = keyed.join(found, uid, "left").withColumn(taken, F.coalesce(F.size(drop), F.lit(0)).cast("long"))
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    return joined.select(*(F.when(F.col(drop).isNotNull(), kept).otherwise(F.col(c)).alias(c) if c == "text" else F.col(c) for c in docs.columns), n_lines.alias(free_name(docs, "n_lines")), F.col(taken).alias(free_name(docs, "n_dropped")))


#: Strings stand for hashes, and a document's whole text for its vote.
ORACLE_SQL = """
with split as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
exploded as (select doc_id, text, unnest(lines) as line_text, unnest(range(len(lines))) as line from split),
plain as (select doc_id, text, line, trim(regexp_replace(line_text, '[\\x09-\\x0D\\x20]+', ' ', 'g'), ' ') as plain from exploded),
tokens as (select doc_id, text, line, string_split(regexp_replace(plain, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') as t from plain where plain <> ''),
cut as (select *, len(t) || ' ' || array_to_string(t[1:3], ' ') as leaf, len(t) - 3 as rest, greatest(1, least(len(t) - 3, 4)) as n from tokens),
leaves as (select leaf from cut group by leaf having count(distinct text) >= 10),
parts as (
  select doc_id, text, line, leaf, n, k, case when rest > 0 then array_to_string(t[cast(floor(k * rest / n) as int) + 4 : cast(floor((k + 1) * rest / n) as int) + 3], ' ') else '' end as part
  from (select *, unnest(range(n)) as k from cut where leaf in (select leaf from leaves))),
recurring as (select leaf, k, part from parts group by all having count(distinct text) >= 10),
hits as (select doc_id, line, n from parts join recurring using (leaf, k, part) group by all having count(*) * 4 >= n * 3),
gone as (select doc_id, list(line) as drop_lines from hits group by 1)
select doc_id, coalesce(len(lines), 0) as n_lines, coalesce(len(drop_lines), 0) as n_dropped,
  case when drop_lines is null then text
    else array_to_string(list_transform(list_filter(list_zip(lines, range(len(lines))), lambda x: not list_contains(drop_lines, x[2])), lambda x: x[1]), chr(10)) end as text
from split left join gone using (doc_id)
"""
