"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), with docs in the columns of ``documents``, and returns a frame;
its caller writes that as Parquet and rereads it as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, linededup, neardup, quality
from lodestone.llm.common import Scratch, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _scratch(spark: SparkSession) -> Scratch:
    """By the time a stage begins, the one before it has been written, so that one's tables go."""
    return Scratch(spark, "pipeline_stage", replaces=True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without boilerplate lines."""
    return quality.clean(docs, _scratch(spark))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat or nearly repeat an earlier one."""
    return linededup.clean(docs, _scratch(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles at a similarity of 0.8."""
    return neardup.keep_one(docs, _scratch(spark))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), _scratch(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents."""
    encoded = bpe.encode(docs, TOKENIZER, bpe.build_lexicon(docs, TOKENIZER, _scratch(spark)))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: XXH64 and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    written, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
