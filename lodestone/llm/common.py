"""What the corpus operators share: shared-folder tables, size checks, table reading."""

from __future__ import annotations

import threading
import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import shared_dir

#: ASCII white space, the separator of words and the trim set: space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"

#: A side of a join is broadcast only up to so many rows of at most about a hundred bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    ``keep`` writes a frame and reads it back. ``drop`` deletes all that this scratch has kept, ``part`` is a
    scratch inside it; a scratch that ``replaces`` drops the last one of its owner in this thread, whose
    results have been consumed by then.
    """

    _last: dict[tuple[int, str], Scratch] = {}

    def __init__(self, spark: SparkSession, owner: str, replaces: bool = False):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables/{owner}-{uuid.uuid4().hex}"
        if replaces:
            mine = (threading.get_ident(), owner)
            if mine in Scratch._last:
                Scratch._last[mine].drop()
            Scratch._last[mine] = self

    def part(self, name: str) -> Scratch:
        inner = Scratch(self.spark, name)
        inner.root = f"{self.root}/{name}"
        return inner

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self) -> None:
        delete(self.spark, self.root)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(frame: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """The frame, marked for broadcast if a count (of a written table) proves it small; else as it is, for a shuffled join.

    size: the bytes of a row's columns of no fixed length, of which all rows may have ``BROADCAST_BYTES``.
    """
    if frame.limit(rows + 1).count() > rows:
        return frame
    if size is not None and frame.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] > BROADCAST_BYTES:
        return frame
    return F.broadcast(frame)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for null."""
    inner = trimmed(F.coalesce(text, F.lit("")))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_CLASS + "+"))
