"""The dealt operators over the shared tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from ..session import scratch_dir
from . import chat, decontaminate, fingerprint, neardup, negatives, packing, pii, quality, recompress, spelling, suffix, toxicity, wavelet
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.report(pii.find_pii(read_table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return fingerprint.exact_groups(read_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes over all documents."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written to wavelet-matrix shards and read back."""
    out = scratch_dir(spark, "token-shards")
    wavelet.write_shards(read_table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.documents(wavelet.read_shards(spark, out))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted, written and read back."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(chat.PROBE, "conv_id long, turn long, role string, text string"))
    out = scratch_dir(spark, "chat")
    chat.format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")).write.parquet(out)
    return chat.report(spark.read.parquet(out))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.report(packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that repeat an earlier document, over all documents."""
    return suffix.repeated_strings(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor among all vectors."""
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op13_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words that repeat an earlier document, over all documents."""
    return recompress.repeated_words(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontamination, op2_pii, op3_exact_dedup, op4_near_dedup, op5_token_shards, op6_quality, op7_chat_format, op8_packing,
                                               op9_suffix_dedup, op10_toxicity, op11_spelling, op12_hard_negatives, op13_recompression)}
SQL: dict[str, str] = {"op1_decontamination": decontaminate.SQL, "op3_exact_dedup": fingerprint.SQL,
                       "op7_chat_format": chat.SQL, "op11_spelling": spelling.SQL,
                       "op12_hard_negatives": negatives.SQL, "op13_recompression": recompress.SQL}
