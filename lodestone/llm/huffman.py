"""Token-id files in canonical length-limited Huffman code.

Documents are encoded with the tokenizer and closed with an end id; the ids are counted over the whole
corpus; package-merge gives code lengths of at most ``LONGEST`` bits, and lengths alone fix the
canonical codes. Files hold *blocks* in ascending doc_id order. A block decodes on its own: it has the
doc_ids and token counts of its documents, the place of its first token, the coded bits, and the bit
offset of every ``STEP``-th token. Decoding goes by one table of 2^LONGEST entries; all checkpoints of
some blocks are decoded in step with one another.

A block is a row of a Parquet folder, the code lengths are a second folder, so that any store Spark
writes to can hold them and lost tasks are run again.

Defined results: a null text has the end id alone; a null doc_id comes first; rows with equal doc_id
are in the order of their ids' bytes; a very long text makes a long block; an empty table gives a file
without blocks; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch
from lodestone.llm.wordbpe import library_memo, texts_of, tokenizer

LONGEST = 16
#: Tokens between checkpoints, and tokens after which a block is closed at a document's end.
STEP, BLOCK = 256, 1 << 16
#: Bytes of ids in a partition of the ordered encoding.
PART_BYTES = 24 << 20

BLOCK_SCHEMA = "part int, block int, start long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, checkpoints binary, bits binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits for the counts (0: no code), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    levels = []  # per level, which of its sorted items are packages
    packages = np.empty(0)
    for _ in range(longest):
        items = np.concatenate([coins, packages])
        rank = np.argsort(items, kind="stable")
        levels.append(rank >= len(coins))
        merged = items[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, per = 2 * (len(order) - 1), np.zeros(len(order), np.int64)
    for packed in reversed(levels):
        chosen = packed[:take]
        n_packages = int(chosen.sum())
        per[: take - n_packages] += 1  # coins are taken in ascending order
        take = 2 * n_packages
    lengths[order] = per
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.uint64(1) << (LONGEST - lengths[order].astype(np.uint64))
    left = np.concatenate([[0], np.cumsum(span, dtype=np.uint64)[:-1]]) if len(order) else np.empty(0, np.uint64)
    codes[order] = (left.astype(np.uint64) // span).astype(np.uint32)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each LONGEST-bit window the id that it starts with, and that code's length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (LONGEST - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << LONGEST, np.uint16), np.ones(1 << LONGEST, np.uint8)
    ids[: span.sum()], bits[: span.sum()] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, bits


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes, first bit highest, with four bytes after them; and the bit offset of every STEP-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    words = np.zeros(int(ends[-1] // 32 + 2) if len(ids) else 1, np.uint64)
    value = codes[ids].astype(np.uint64) << (64 - n - (starts & 31)).astype(np.uint64)
    at = starts >> 5
    first = np.flatnonzero(np.diff(at, prepend=-1))
    if len(ids):
        words[at[first]] = np.bitwise_or.reduceat(value >> np.uint64(32), first)
        words[at[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), starts[::STEP].astype(np.uint32 if not len(ids) or ends[-1] < 1 << 32 else np.uint64)


def unpack(blocks: list[tuple[bytes, bytes, int]], table: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The ids of blocks (bits, checkpoints, number of ids); all runs between checkpoints go in step."""
    sizes = np.array([n for _, _, n in blocks], np.int64)
    data = np.frombuffer(b"".join([*(b for b, _, _ in blocks), b"\0" * 8]), np.uint8)
    base = np.concatenate([[0], np.cumsum([8 * len(b) for b, _, _ in blocks])])[:-1]
    runs = -(-sizes // STEP)
    width = [len(c) // max(1, r) for (_, c, _), r in zip(blocks, runs.tolist())]
    marks = [np.frombuffer(c, np.uint32 if w == 4 else np.uint64).astype(np.int64) if c else np.empty(0, np.int64) for (_, c, _), w in zip(blocks, width)]
    at = np.concatenate([np.empty(0, np.int64), *[m + b for m, b in zip(marks, base.tolist())]])
    long = np.full(len(at), STEP, np.int64)
    last = np.cumsum(runs) - 1
    filled = runs > 0
    long[last[filled]] = sizes[filled] - STEP * (runs[filled] - 1)
    out = np.zeros((len(at), STEP), np.uint16)
    ids, bits = table
    for i in range(STEP):
        byte = at >> 3
        window = (data[byte].astype(np.uint32) << 16) | (data[byte + 1].astype(np.uint32) << 8) | data[byte + 2]
        window = (window >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[:, i] = ids[window]
        at = np.minimum(at + bits[window], len(data) * 8 - 32)
    flat = out.reshape(-1)
    ends = np.cumsum(runs) * STEP
    return [flat[e - r * STEP : e - r * STEP + n] for e, r, n in zip(ends.tolist(), runs.tolist(), sizes.tolist())]


def encode_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows (doc_id, ids as little-endian 16-bit numbers with the end id), and rows with a task's counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        coded = library_memo(path).__getitem__
        end, seen = np.uint16(end_id).astype("<u2").tobytes(), np.zeros(len(bpe.tokens), np.int64)
        counts = pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))

        def batch(ids: list, data: list, pairs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary()), pa.array(pairs, counts)], ["doc_id", "ids", "counts"])

        for ids, texts in texts_of(batches):
            data = [b"".join(map(coded, bpe.pieces(t))) + end for t in texts]
            seen += np.bincount(np.frombuffer(b"".join(data), "<u2"), minlength=len(seen))
            yield batch(ids, data, [None] * len(ids))
        yield batch([None], [None], [[{"id": i, "n": int(seen[i])} for i in np.flatnonzero(seen).tolist()]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, counts array<struct<id:int,n:bigint>>")


def write(docs: DataFrame, path: str, to: str, scratch: Scratch, end_id: int = 2) -> None:
    """Writes the folders ``to``/codes and ``to``/blocks."""
    spark = docs.sparkSession
    kept = scratch.keep(encode_ids(docs, path, end_id), "ids")
    counts = np.zeros(len(tokenizer(path).tokens), np.int64)
    for row in kept.filter("counts is not null").select(F.explode("counts").alias("c")).select("c.*").groupBy("id").agg(F.sum("n").alias("n")).collect():  # bounded by the vocabulary
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{to}/codes")
    coded = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        names, data, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, start, names, data, held
            ids = np.frombuffer(b"".join(data), "<u2")
            bits, marks = pack(ids, *coded.value)
            row = [[part], [block], [start], [len(ids)], [names], [[len(d) // 2 for d in data]], [marks.tobytes()], [bits]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            block, start, names, data, held = block + 1, start + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                data.append(ids.as_py())
                held += len(data[-1]) // 2
                if held >= BLOCK:
                    yield close()
        if names:
            yield close()

    ids = kept.filter("counts is null").select("doc_id", "ids")
    parts = max(1, int(2 * counts.sum()) // PART_BYTES)
    ordered = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.length("ids"), F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.length("ids"), F.xxhash64("ids"), "ids")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{to}/blocks")


def read_blocks(spark: SparkSession, at: str) -> tuple[DataFrame, np.ndarray]:
    """The blocks, each with its start in the whole corpus, and the code lengths."""
    blocks = spark.read.parquet(f"{at}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each file
    before, rows = 0, []
    for r in totals:
        rows.append((r["part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(rows, "part int, offset long")
    placed = blocks.join(F.broadcast(offsets), "part").withColumn("start", F.col("start") + F.col("offset")).drop("offset")
    return placed, np.frombuffer(bytes(spark.read.parquet(f"{at}/codes").first()[0]), np.uint8)


def _decoded(blocks: DataFrame, lengths: np.ndarray, out, schema: str) -> DataFrame:
    """out(doc ids, starts, arrays of ids) -> Arrow batch, for runs of blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast(lengths)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = batch.slice(at, 16).to_pylist()
                names, starts, arrays = [], [], []
                for row, ids in zip(rows, unpack([(r["bits"], r["checkpoints"], r["n_tokens"]) for r in rows], table)):
                    cuts = np.concatenate([[0], np.cumsum(row["lengths"])]).tolist()
                    names += row["doc_ids"]
                    starts += [row["start"] + c for c in cuts[:-1]]
                    arrays += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
                yield out(names, starts, arrays)

    return blocks.select("start", "n_tokens", "doc_ids", "lengths", "checkpoints", "bits").mapInArrow(run, schema)


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, ids) of files."""

    def out(names: list, starts: list, arrays: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array([a.tolist() for a in arrays], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return _decoded(*read_blocks(spark, at), out, "doc_id long, start long, ids array<int>")


def report(docs: DataFrame, path: str, to: str, scratch: Scratch, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from files written to ``to``."""
    write(docs, path, to, scratch, end_id)

    def out(names: list, starts: list, arrays: list) -> pa.RecordBatch:
        crc = [zlib.crc32(a.astype("<u4").tobytes()) for a in arrays]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names, starts, [len(a) for a in arrays], crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _decoded(*read_blocks(docs.sparkSession, to), out, "doc_id long, start long, n_tokens long, ids_crc32 long")
