"""SimHash near-duplicates: fingerprints, links by pivot tables, components.

A fingerprint has a bit for each of the 64 bits of the shingles' XXH64: 1 if it is set in over half of
them. Two fingerprints are linked if they differ in at most ``RADIUS`` bits.

Links are looked for among distinct fingerprints only. The 64 bits fall into six blocks; fingerprints
that differ in three bits agree in three whole blocks, so each goes to the twenty buckets named by
three of its blocks (about 32 bits). Each distinct fingerprint has a *pivot table*, its Hamming distances
to ``PIVOTS`` reference fingerprints, which is computed once and goes with it to its buckets. Two
fingerprints can only be linked if no entry differs by more than ``RADIUS``: pairs of a bucket that fail
this are discarded, the others are verified on their bits. Buckets are what keeps the pairs from growing
with the square of the input; within them the tables discard nearly all that isn't linked. A bucket gives no pairs but a star for each of its connected sets, so what it emits is linear in its
size. A bucket of more than ``CROWD`` fingerprints (a large group of near copies) is not compared: its
fingerprints are dealt out again by thirteen of sixteen blocks, and such a bucket can hold 4096 at most.

Components come from rounds of large and small stars over the link table, kept in the shared folder.

Defined results: a null or empty text has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle; rows with a null doc_id get a component as others do, but no component
is named by null unless all its rows are such; repeated rows give a row each; empty tables give empty
results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, small
from lodestone.llm.wordbpe import texts_of

SEED, RADIUS = 42, 3
PIVOTS = 16
CROWD = 256


def fingerprint(text: str, shingle: int) -> int:
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, hashes = len(hashes), hashes.astype("<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in texts_of(batches):
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def masks(blocks: int, agree: int) -> list[int]:
    """As signed longs, the bits of each choice of ``agree`` out of ``blocks`` near-equal blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [int(np.uint64(sum(chosen)).view(np.int64)) for chosen in combinations(block, agree)]


def with_pivots(prints: DataFrame) -> DataFrame:
    """(fp, t0, t1) of distinct fingerprints (fp): the pivot table's bytes as two longs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            packed = pivot_table(own.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed[:, 0].copy()), pa.array(packed[:, 1].copy())], ["fp", "t0", "t1"])

    return prints.select("fp").mapInArrow(run, "fp long, t0 long, t1 long")


def bucketed(tables: DataFrame, blocks: int, agree: int) -> DataFrame:
    """(choice, bucket, fp, t0, t1) of distinct fingerprints with pivot tables, those of a bucket together and in order."""
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(masks(blocks, agree))])
    return tables.select("fp", "t0", "t1", F.explode(keys).alias("key")).select("key.choice", "key.bucket", "fp", "t0", "t1").repartition("choice", "bucket").sortWithinPartitions("choice", "bucket", "fp")


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """A row of distances to the reference fingerprints for each print; the references are fixed by a seed."""
    pivots = np.random.default_rng(SEED).integers(0, 1 << 63, PIVOTS, np.uint64) * np.uint64(2) + np.arange(PIVOTS, dtype=np.uint64) % np.uint64(2)
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def linked_pairs(prints: np.ndarray, group: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked prints of one group (groups are consecutive), by pivot tables and then by their bits."""
    left, right = [], []
    at, lag = np.arange(len(prints)), 1
    while len(at):
        at = at[at + lag < len(prints)]
        at = at[group[at] == group[at + lag]]
        near = at[(np.abs(table[at] - table[at + lag]) <= RADIUS).all(axis=1)]
        near = near[np.bitwise_count(prints[near] ^ prints[near + lag]) <= RADIUS]
        left.append(near)
        right.append(near + lag)
        lag += 1
    return np.concatenate([np.empty(0, np.int64), *left]), np.concatenate([np.empty(0, np.int64), *right])


def stars(prints: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(print, smallest print of its connected set) for the linked prints, itself left out."""
    values, place = np.unique(prints.view(np.int64), return_inverse=True)
    a, b, label = place[left], place[right], np.arange(len(values))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def compare(buckets: DataFrame, crowd: int) -> DataFrame:
    """(fp, to): a link of the star kind, or to null for a fingerprint in a bucket of more than ``crowd``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 5  # choice, bucket, print and table of the last bucket so far
        crowded = None  # the bucket that has been passed on in part

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            choice, bucket, prints, t0, t1 = rows
            edge = np.flatnonzero((np.diff(choice) != 0) | (np.diff(bucket) != 0)) + 1
            starts = np.concatenate([[0], edge])
            sizes = np.diff(np.concatenate([starts, [len(prints)]]))
            large = np.repeat(sizes > crowd, sizes)
            keep = ~large
            group = np.repeat(np.arange(len(sizes)), sizes)[keep]
            own = prints[keep].view(np.uint64)
            table = np.column_stack([t0[keep], t1[keep]]).view(np.int8)
            a, b = stars(own, *linked_pairs(own, group, table))
            alone = np.unique(prints[large])
            to = pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(alone), pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, alone]), pa.int64()), to], ["fp", "to"])

        def passed(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[2], pa.int64()), pa.nulls(len(rows[2]), pa.int64())], ["fp", "to"])

        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns)]
            if crowded is not None:
                same = (rows[0] == crowded[0]) & (rows[1] == crowded[1])
                if same.any():
                    yield passed([r[same] for r in rows])
                    rows = [r[~same] for r in rows]
            if not len(rows[0]):
                held = rows
                continue
            last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1] + 1) if ((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])).any() else 0
            if last:
                yield out([r[:last] for r in rows])
            held = [r[last:] for r in rows]
            if len(held[0]) > crowd:
                crowded = (held[0][0], held[1][0])
                yield passed(held)
                held = [h[:0] for h in held]
        if len(held[0]):
            yield out(held)

    return buckets.mapInArrow(run, "fp long, to long")


def links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of distinct fingerprints: links enough to connect what is linked."""
    tables = scratch.keep(with_pivots(prints), "pivot_tables")
    first = scratch.keep(compare(bucketed(tables, 6, 3), CROWD).distinct(), "links")
    crowd = tables.join(first.filter("to is null").select("fp"), "fp", "left_semi")
    second = scratch.keep(compare(bucketed(crowd, 16, 13), 1 << 12).distinct(), "links_of_crowds")
    return first.filter("to is not null").unionByName(second).select(F.col("fp").alias("a"), F.col("to").alias("b"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): each node of (a, b) but the roots, with the smallest node connected to it."""

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = both.join(smallest(both), "u").withColumn("m", F.least("m", "u"))
        if large:
            return near.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(near.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()

    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    current = scratch.keep(edges.filter("a <> b").distinct(), "edges_0")
    before, turn = state(current), 0
    while before[0]:
        turn += 1
        current = scratch.keep(star(star(current, True), False), f"edges_{turn}")
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(docs: DataFrame, scratch: Scratch, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links lead to."""
    prints = scratch.keep(fingerprints(docs, shingle), "fingerprints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "distinct")
    roots = components(links(distinct.select("fp"), scratch), scratch)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("head").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def report(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return groups(docs, scratch).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, scratch: Scratch, shingle: int = 3) -> DataFrame:
    """One document of each group: that with the smallest doc_id (of equal ids, any one)."""
    return keep_first(docs, scratch.keep(groups(docs.select("doc_id", "text"), scratch, shingle), "groups"), scratch)


def keep_first(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that name their group. found: doc_id, component_id."""
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    by_id = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    dropped = small(scratch.keep(by_id.filter("not stays").select(F.col("doc_id").alias("r_doc_id")), "dropped"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("l_doc_id"))
    kept = rows.join(dropped, F.col("l_doc_id").eqNullSafe(F.col("r_doc_id")), "left_anti")
    repeated = scratch.keep(chosen.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("r_doc_id")), "repeated")
    if not repeated.isEmpty():
        twice = F.col("l_doc_id").eqNullSafe(F.col("r_doc_id"))
        kept = kept.join(repeated, twice, "left_anti").unionByName(kept.join(repeated, twice, "left_semi").dropDuplicates(["l_doc_id"]))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
