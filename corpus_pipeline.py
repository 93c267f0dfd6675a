"""The corpus pipeline: stages that each apply one operator to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from itemloom.llm.decontamination import contaminated
from itemloom.llm.near_dedup import near_duplicates
from itemloom.llm.packing import pack_documents
from itemloom.llm.queries import vocabulary
from itemloom.llm.substring_dedup import remove_repeats
from itemloom.llm.toxicity import toxicity
from itemloom.sources.writer import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are predicted to be toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = toxicity(docs, labels).where("predicted = 1").select("doc_id").distinct()
    return docs.join(rejected.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group."""
    copies = near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(copies.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts windows of 13 words that an earlier document has.

    A text of which nothing is cut stays as it is; a document of which nothing
    is left goes.
    """
    cut = remove_repeats(docs, width=13, carry=["text", "lang", "source"])
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.where("n_removed = 0 or kept <> ''").select(
        "doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars")
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that contain a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = contaminated(docs, items, width=5, percent=80).select("doc_id").distinct()
    return docs.join(leaks.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The learned and hashed stages cannot be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
