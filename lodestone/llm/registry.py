"""The corpus operators' registered queries, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, huffman, langid, linededup, pii, quality, sharding, simhash, toxicity
from lodestone.llm.common import Scratch, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    return huffman.report(table(spark, sf_dir, "documents"), TOKENIZER, f"{scratch.root}/files", scratch)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op5"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op6"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"), f"{Scratch(spark, 'op7').root}/store")


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), TOKENIZER, Scratch(spark, "op8"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_token_id_output, op4_pii, op5_toxicity, op6_benchmark_decontamination, op7_sharding, op8_bpe_encode_decode, op9_simhash_near_dedup, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.ORACLE_SQL, "op6_benchmark_decontamination": decontaminate.ORACLE_SQL, "op7_sharding": sharding.ORACLE_SQL}
