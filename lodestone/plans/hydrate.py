"""Chunk texts from current sources, and the chunks around chunks.

A stored range counts only if the source still is what was indexed: its fingerprint is the file's, the
range lies within it, and the text there is the stored one, if a text is stored. Otherwise the text is
empty and a diagnostic says why; a file that fails has one diagnostic, whatever the number of its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import byte_slice


def stored(chunks: DataFrame) -> DataFrame:
    """Chunks without what is rebuilt from elsewhere."""
    return chunks.drop("text", "embedding")


def matches_source(source: Column, start: Column, end: Column, text: Column) -> Column:
    """Whether the bytes from start to end of the source are the text."""
    return byte_slice(source, start, end) == text


def hydrated(chunks: DataFrame, files: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with text and reason, diagnostics (path, code, message)).

    chunks (id, path, byte_start, byte_end, and text if stored), files (path, fingerprint as indexed),
    sources (path, text, fingerprint as it is now).
    """
    s = sources.select("path", F.col("text").alias("_source"), F.col("fingerprint").alias("_now"))
    rows = chunks.join(files.select("path", F.col("fingerprint").alias("_then")), "path", "left").join(s, "path", "left")
    valid = (F.col("byte_start") >= 0) & (F.col("byte_start") <= F.col("byte_end")) & (F.col("byte_end") <= F.octet_length("_source"))
    reason = (
        F.when(F.col("_source").isNull(), "source read failed")
        .when(~F.col("_now").eqNullSafe(F.col("_then")), "source changed since it was indexed")
        .when(~F.coalesce(valid, F.lit(False)), "range is not in the source")
    )
    if "text" in chunks.columns:
        reason = reason.when(F.col("text").isNotNull() & ~matches_source(F.col("_source"), F.col("byte_start"), F.col("byte_end"), F.col("text")), "text differs from the source")
    checked = rows.withColumn("reason", reason)
    text = F.when(F.col("reason").isNull(), byte_slice(F.col("_source"), F.col("byte_start"), F.col("byte_end"))).otherwise("")
    out = checked.withColumn("text", text).drop("_source", "_now", "_then")
    said = out.filter("reason is not null").groupBy("path").agg(F.min_by("reason", F.struct("byte_start", "id")).alias("message"))
    return out, said.select("path", F.lit("source_mismatch").alias("code"), "message")


def expanded(asked: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(id, pos): each asked chunk (id, pos), then its parent, children, previous and next; of chunks met twice the first place.

    relations: (id, parent_id, child_ids, previous_id, next_id). Without them asked has these columns itself.
    """
    own = asked.withColumnRenamed("pos", "_pos") if relations is None else asked.select("id", F.col("pos").alias("_pos")).join(relations, "id", "left")
    around = F.concat(F.array("id", "parent_id"), F.coalesce("child_ids", F.array().cast("array<string>")), F.array("previous_id", "next_id"))
    met = own.select("_pos", F.posexplode(around).alias("_at", "id")).filter("_at = 0 or id is not null")
    place = F.struct((F.col("_at") > 0).cast("int").alias("later"), F.col("_pos").alias("pos"), F.greatest(F.col("_at") - 1, F.lit(0)).alias("at"))
    return met.groupBy("id").agg(F.min(place).alias("place"))


def path_diagnostics(diagnostics: DataFrame, where: Column | None) -> DataFrame:
    """(message): files' diagnostics (path, message) under the search's paths, with the path before."""
    rows = diagnostics if where is None else diagnostics.filter(where)
    return rows.select(F.concat("path", F.lit(": "), "message").alias("message")).distinct()
