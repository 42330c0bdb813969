"""A corpus pipeline of five stages over ``documents``; see STAGES. Each stage reads what the one before it wrote.

Every stage takes nulls in any column, repeated rows, an empty table, and more columns of any name, and all but the last return the columns they got."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, lines, ngram_join, packing, toxicity
from gridloom.llm.common import free_name, materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go; those without words or text are scored by its bias. Without labels all stay."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), where=fold != 0)
    scored = toxicity.scored(docs, model)
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, documents stay, also those left without lines; n_chars follows the text (null for null)."""
    found = lines.drop_templates(docs)
    return found.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, stays of each group of near duplicates; of rows with that id the one of the smallest text hash, once.

    Documents without words are linked with nothing and all stay, as do rows without an id."""
    found = ngram_join.jaccard_components(docs)
    key = free_name(docs, "text_hash")
    linked = found.where("group_id is not null")
    gone = linked.where("doc_id <> component_id").select("doc_id", F.col("text_hash").alias(key))
    # rows with equal ids, which a group's smallest id may have several of
    firsts = linked.where("doc_id = component_id").groupBy("doc_id", "group_id").agg(F.min("text_hash").alias(key), F.count("*").alias("n"))
    several = materialize(firsts.where("n > 1"))
    unique = several.isEmpty()
    if not unique:
        others = linked.join(several.select("doc_id", "group_id", F.col(key).alias("least")), ["doc_id", "group_id"]).where("text_hash <> least")
        gone = gone.union(others.select("doc_id", F.col("text_hash").alias(key)))
    kept = docs.withColumn(key, F.xxhash64("text")).join(gone.distinct(), ["doc_id", key], "left_anti")
    if not unique:
        twice = F.broadcast(several.select("doc_id", key)) if several.count() <= ngram_join.BROADCAST_IDS else several.select("doc_id", key)
        kept = kept.join(twice, ["doc_id", key], "left_anti").unionByName(kept.join(twice, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key]))
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; repeated rows are judged alike, and null or empty texts stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; repeated rows are packed separately, and null or empty texts are an end id alone."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained model, a tokenizer and edit distances are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
