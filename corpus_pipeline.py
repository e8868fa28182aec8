"""Preparing a corpus in five stages. Each takes the documents that the stage before it left.

Rows are told apart by doc_id and text together, so that rows with one doc_id, or with none, neither hide nor remove one
another. Tables may have any further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import decontam, jaccard, packing, rules, suffixes
from ripplegraph.llm.common import free_names, prepare, quoted, read
from ripplegraph.llm.queries import vocabulary
from ripplegraph.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts have no words and go. Rows are judged one by one."""
    return rules.filtered(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: the smallest doc_id, a missing one last. Texts without words stay."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that a document with a smaller doc_id has; n_chars, if there, is counted anew.

    A null text becomes empty; rows with one doc_id take nothing from each other, and rows without a doc_id stay whole.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    slim = docs.select("doc_id", "text", *[F.col(quoted(c)).alias(f"x{k}") for k, c in enumerate(others)])
    cleaned = suffixes.without_repeats(slim, 50, tuple(slim.columns[2:]), as_text=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col(f"x{k}") for k, c in enumerate(others)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[made[c].alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no window of a benchmark item occurs; null and empty texts stay, rows with one doc_id are judged apart."""
    found = decontam.contamination(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    doc_id, text_hash = free_names(docs, 2)
    hit = materialise(found.where("contaminated").select("doc_id", "text_hash").distinct().toDF(doc_id, text_hash), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(text_hash))
    return docs.join(hit, same, "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids, with the sequence that each is in and its place there.

    A null text counts as empty and gives one piece; repeated rows and rows without a doc_id are packed each on its own.
    """
    pieces = packing.tokenized(docs, vocabulary())
    return packing.packed_with(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Fitted rules, set similarity by hashing and packing can't be said in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written as Parquet and read again."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
