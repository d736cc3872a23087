"""The registered queries of this subpackage: thin wrappers over the operators, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, chat, cobucket, fill_in_middle, imatch, language, mixing, permutation_index, quality, sanitise, substring_dedup, toxicity
from textloom.llm.near_dedup import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of documents on 2-word shingles at 80 %."""
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, per_cent=80).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents covered by a repeated window of 35 words are removed."""
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents, and the terms that disclose it."""
    return sanitise.digests(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of documents under the public 50k byte-level vocabulary, and back."""
    return bpe.digests(_table(spark, sf_dir, "documents"), _tokenizer())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their half-replaced texts."""
    return imatch.digests(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return permutation_index.search(_table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, read back; one more conversation holds control strings."""
    return chat.digests(chat.with_control_case(_table(spark, sf_dir, "conversations")))


def op12_cobucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales and sale_lines rewritten into one file a table and bucket."""
    return cobucket.sales_and_lines(_table(spark, sf_dir, "sales"), _table(spark, sf_dir, "sale_lines"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rearranged around a middle, and restored."""
    return fill_in_middle.digests(_table(spark, sf_dir, "documents"))


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_substring, op3_pii, op4_bpe, op5_mixing, op6_language, op7_imatch, op8_toxicity, op9_neighbours, op10_quality, op11_chat, op12_cobucket, op13_fim)}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.ORACLE, "op11_chat": chat.ORACLE, "op13_fim": fill_in_middle.ORACLE}
