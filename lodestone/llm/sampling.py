"""Bounded, repeatable samples of labelled rows, and remainders of doc_id for held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_ROWS

#: Labels that a classifier may have; their counts are held by the driver.
MOST_LABELS = 1_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """(doc_id, text, label): per label the per_label rows whose ids hash lowest.

    Labels are counted first, and only ids whose hash is below what some four times per_label rows of the
    label can be expected to have are ranked. The bounds are broadcast, so all other ids are left out where
    they are read, and a ranking task holds no more than that of a label.
    """
    if per_label > BROADCAST_ROWS:
        raise ValueError("a sample is for fitting on the driver")
    ids = rows.select("doc_id", F.col(label).alias("_label"), F.xxhash64("doc_id", F.lit(17)).alias("_hash"))
    counts = ids.groupBy("_label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    bounds = [(r["_label"], min(1.0, (4.0 * per_label + 100) / r["n"]) * 2.0**64 - 2.0**63) for r in counts]
    limits = rows.sparkSession.createDataFrame(bounds, ids.select(F.col("_label"), F.lit(0.0).alias("_bound")).schema)
    low = ids.join(F.broadcast(limits), "_label").filter(F.col("_hash").cast("double") <= F.col("_bound"))
    order = Window.partitionBy("_label").orderBy("_hash", "doc_id")
    chosen = low.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_label).select("doc_id").distinct()
    return rows.select("doc_id", "text", label).join(F.broadcast(chosen), "doc_id", "left_semi")  # per_label ids of each label
