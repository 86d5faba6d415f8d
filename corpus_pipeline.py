"""From raw documents to token ids, stage by stage.

Each stage gets what its predecessor wrote and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrybook.llm.common import table, write_stage
from ferrybook.llm.decontamination import without_contaminated
from ferrybook.llm.near_dedup import keep_one
from ferrybook.llm.quality_rules import keep_good
from ferrybook.llm.repeat_dedup import without_repeats
from ferrybook.llm.sentence_pieces import encode_texts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and read like the trusted ones."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return keep_good(docs, trusted)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of 0.8 or more)."""
    return keep_one(docs, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of 200 bytes; the first copy stays."""
    cleaned = without_repeats(docs)
    return cleaned.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left."""
    return encode_texts(docs, with_text=False).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

# The stages are not expressible in SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir))
    return docs
