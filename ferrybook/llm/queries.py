"""One query per operator over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrybook.llm import sql
from ferrybook.llm.byte_pairs import decode_bytes, encode_bytes
from ferrybook.llm.common import table
from ferrybook.llm.decontamination import contaminated
from ferrybook.llm.html_extraction import extract_main_text
from ferrybook.llm.license_scans import scan_licenses
from ferrybook.llm.lm_scoring import score_texts
from ferrybook.llm.near_dedup import near_duplicates
from ferrybook.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt_steps
from ferrybook.llm.quality_rules import rate_quality
from ferrybook.llm.repeat_dedup import remove_repeats
from ferrybook.llm.sentence_pieces import encode_texts
from ferrybook.llm.sharding import shard_documents
from ferrybook.llm.url_filters import RULES, judge_urls, rule_table
from ferrybook.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are labelled as good ones."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and test item; clean documents have none."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contaminated(docs, items).drop("text_hash")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rate_quality(docs, trusted_documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    coded = encode_texts(table(spark, sf_dir, "documents"), with_text=False, verify=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here all occurrences go, the first one too."""
    left = remove_repeats(table(spark, sf_dir, "documents"), length=200, keep_first=False)
    return left.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of rebuilt conversations, which share turns with their base."""
    return prefix_trie(rebuilt_steps(ordered_turns(table(spark, sf_dir, "conversations"))))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode_bytes(encode_bytes(table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_benchmark_decontamination": op1_benchmark_decontamination,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_html_extraction": op3_html_extraction,
        "op4_quality_rules": op4_quality_rules,
        "op5_sharding": op5_sharding,
        "op6_license_scans": op6_license_scans,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_url_filters": op10_url_filters,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_byte_pairs": op12_byte_pairs,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the result; hashes, models and tokenizers it cannot."""
    return {
        "op7_minhash_near_dedup": sql.NEAR_DUPLICATES,
        "op9_suffix_array_dedup": sql.REPEATS,
        "op10_url_filters": sql.URL_FILTERS,
        "op11_conversation_trie": sql.CONVERSATION_TRIE,
    }
