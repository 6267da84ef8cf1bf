"""Near copies as the pipeline's stage means them: Jaccard similarity of five-word shingles of 0.8 or more.

Documents of equal shingle sets are folded first. Candidates come from two searches. The first is
``simhash``: the sets' fingerprints, linked within its radius by pivot tables. At a similarity of 0.8 some
ten of 64 bits differ, and no pivot table tells that from the thirty-two of unrelated sets without
comparing all; so a second search goes on from there. A set has a signature of ``HASHES`` smallest hashes,
and each ``BAND`` of them names a bucket; two sets at similarity 0.8 share a bucket with a probability of
1 - (1 - 0.8 ** 4) ** 24 = 0.999997. What shares a bucket is compared in two steps. Each set of a bucket
is compared with the bucket's smallest; then, in buckets whose sets are still of several components,
sets of different components are compared by signatures, and those that agree in ``ALIKE`` hashes
(five standard deviations below 0.8) exactly, where they meet first. A bucket's sets are held for that, so
no pairs but links leave it; beyond ``HELD`` bytes its pairs are verified elsewhere. So a group of copies
costs a comparison a copy and bucket, and only sets of a bucket that are no copies of each other are
compared in pairs. Every link is verified on the
shingle sets, and components are formed of the links as in ``simhash``.

Defined results: as in ``simhash``; the texts without words are one group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, small
from lodestone.llm.simhash import components, keep_first, majority
from lodestone.llm.simhash import links as print_links
from lodestone.llm.wordbpe import texts_of

SEED, SHINGLE = 42, 5
#: Similarity in per cent from which two sets are linked.
PERCENT = 80
HASHES, BAND, ALIKE = 96, 4, 57
#: Parts that the comparisons with one set are dealt to.
PARTS = 16
#: Sets that are formed at once, and bytes of a bucket's sets that a task holds.
STEP, HELD = 32, 64 << 20


def shingles(text: str) -> np.ndarray:
    """The hashes of the text's shingles, ascending; fewer words than a shingle make one shingle."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)])) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def key_of(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def signature(own: np.ndarray) -> np.ndarray:
    random = np.random.default_rng(SEED)
    mask, factor = random.integers(0, 1 << 63, HASHES, np.uint64), random.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), 1 << 10):
        least = np.minimum(least, ((own[at : at + (1 << 10), None] ^ mask) * factor).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, sig, fp): key names the shingle set, sig is its signature and fp its fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in texts_of(batches):
            sets = [shingles(t) for t in texts]
            columns = [pa.array(ids, pa.int64()), pa.array([key_of(s) for s in sets], pa.int64()), pa.array([signature(s).tobytes() for s in sets], pa.binary())]
            prints = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints)], ["doc_id", "key", "sig", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, sig binary, fp long")


def print_pairs(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of sets (key, fp): those of one fingerprint with the first of it, and firsts of linked fingerprints."""
    first = scratch.keep(sets.groupBy("fp").agg(F.min("key").alias("a")), "firsts")
    equal = sets.join(first, "fp").filter("key <> a").select("a", F.col("key").alias("b"))
    linked = print_links(first.select("fp"), scratch).join(first.withColumnRenamed("fp", "b").withColumnRenamed("a", "_b"), "b")
    return equal.unionByName(linked.join(first.withColumnRenamed("a", "_a"), F.col("a") == F.col("fp")).select(F.col("_b").alias("a"), F.col("_a").alias("b")))


def shared_buckets(sets: DataFrame) -> DataFrame:
    """(bucket, band, key, least) of the buckets of several sets; least is the bucket's smallest key. sets: key, sig."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            buckets = [xxhash.xxh64_intdigest(s[4 * k : 4 * (k + BAND)], k) for s in batch.column(1).to_pylist() for k in range(0, HASHES, BAND)]
            bands = np.tile(np.arange(HASHES // BAND, dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(buckets, np.uint64).view(np.int64)), pa.array(bands), pa.array(np.repeat(keys, HASHES // BAND))], ["bucket", "band", "key"])

    bucket = Window.partitionBy("bucket")
    rows = sets.select("key", "sig").mapInArrow(run, "bucket long, band int, key long")
    return rows.withColumn("n", F.count("*").over(bucket)).withColumn("least", F.min("key").over(bucket)).filter("n > 1").select("bucket", "band", "key", "least")


def formed(keys: DataFrame, docs: DataFrame, heads: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(key, own): the shingle sets of the keys, from the texts of their heads."""

    def form(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in texts_of(batches):
            for at in range(0, len(texts), STEP):
                sets = [shingles(t) for t in texts[at : at + STEP]]
                yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "own"])

    ids = small(scratch.keep(heads.join(keys, "key", "left_semi").select(F.col("doc_id").alias("r_doc_id")).distinct(), f"{name}_ids"))
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("r_doc_id")), "left_semi")
    # Repeated rows, and rows that repeat an id with another text, give sets again or sets that aren't asked for.
    return texts.mapInArrow(form, "key long, own binary").join(keys, "key", "left_semi").dropDuplicates(["key"])


def verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of similar sets. heads: key, and the doc_id of a document of the set.

    Sets are formed again from the texts of the documents concerned, and each b travels once per a.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.empty(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for at in range(batch.num_rows):
                a, b, data = batch.column(0)[at].as_py(), batch.column(2)[at].as_py(), np.frombuffer(batch.column(3)[at].as_py(), np.uint64)
                if b is None:
                    head, own = a, data
                    continue
                if a != head:
                    raise ValueError("a set to compare with is missing")
                both = len(np.intersect1d(own, data, assume_unique=True))
                if 100 * both >= PERCENT * (len(own) + len(data) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    concerned = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = formed(concerned, docs, heads, scratch, name)
    first = pairs.select("a", "part").distinct().join(sets.withColumnRenamed("key", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "own")
    rest = pairs.join(sets.withColumnRenamed("key", "b"), "b").select("a", "part", "b", "own")
    rows = first.unionByName(rest).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return scratch.keep(rows.mapInArrow(compare, "a long, b long").distinct(), name)


def alike(mixed: DataFrame) -> DataFrame:
    """(a, b, sure), a < b, of sets of a bucket, but of different roots: sure ones are similar, others agree in their signatures.

    mixed: bucket, band, root, key, sig, own. A pair counts in the first of the bands that it shares.
    """

    def pairs(band: int, columns: tuple[list, ...], whole: bool) -> pa.RecordBatch:
        root, key = (np.array(c, np.int64) for c in columns[:2])
        hashes, left, right = np.frombuffer(b"".join(columns[2]), "<u4").reshape(-1, HASHES), [], []
        own = [np.frombuffer(x, np.uint64) for x in columns[3]]
        sizes = np.array([len(x) for x in own], np.int64)
        for at in range(len(key) - 1):
            later = at + 1 + np.flatnonzero(root[at + 1 :] != root[at])
            same = hashes[later] == hashes[at]
            near = same.sum(axis=1) >= ALIKE
            near[near] = ~same[near][:, : band * BAND].reshape(int(near.sum()), band, BAND).all(axis=2).any(axis=1)
            later = later[near]
            if whole and len(later):
                others = np.concatenate([own[i] for i in later])
                place = np.minimum(np.searchsorted(own[at], others), sizes[at] - 1)
                both = np.add.reduceat((own[at][place] == others).astype(np.int64), np.cumsum(sizes[later]) - sizes[later])
                later = later[100 * both >= PERCENT * (sizes[at] + sizes[later] - both)]
            left.append(np.minimum(key[at], key[later]))
            right.append(np.maximum(key[at], key[later]))
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), whole))], ["a", "b", "sure"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, band, held, size = None, 0, ([], [], [], []), 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != bucket:
                    if len(held[0]) > 1:
                        yield pairs(band, held, size <= HELD)
                    bucket, band, held, size = row[0], row[1], ([], [], [], []), 0
                size += len(row[5])
                if size > HELD:
                    held[3].clear()  # too many to hold; their signatures stay
                for column, value in zip(held, row[2:]):
                    if column is not held[3] or size <= HELD:
                        column.append(value)
        if len(held[0]) > 1:
            yield pairs(band, held, size <= HELD)

    rows = mixed.select("bucket", "band", "root", "key", "sig", "own").repartition("bucket").sortWithinPartitions("bucket", "root", "key")
    return rows.mapInArrow(run, "a long, b long, sure boolean").distinct()


def groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id that links lead to."""
    found = scratch.keep(sketches(docs), "sketches")
    sets = scratch.keep(found.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig"), F.min("fp").alias("fp")), "sets")
    shared = scratch.keep(shared_buckets(sets), "shared")
    heads = sets.select("key", "doc_id")
    near = print_pairs(sets.select("key", "fp"), scratch.part("prints")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = scratch.keep(shared.filter("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).unionByName(near).distinct(), "tried")
    links = verified(tried, docs, heads, scratch, "links")
    roots = components(links, scratch.part("first"))
    rooted = shared.join(small(scratch.keep(roots.withColumnRenamed("node", "key"), "roots")), "key", "left").withColumn("root", F.coalesce("root", "key"))
    bucket = Window.partitionBy("bucket")
    mixed = scratch.keep(rooted.withColumn("low", F.min("root").over(bucket)).withColumn("high", F.max("root").over(bucket)).filter("low <> high").select("bucket", "band", "root", "key"), "mixed")
    own = scratch.keep(formed(mixed.select("key").distinct(), docs, heads, scratch, "mixed_sets"), "own")
    more = scratch.keep(alike(mixed.join(sets.select("key", "sig"), "key").join(own, "key")).join(tried, ["a", "b"], "left_anti"), "alike")
    if not more.isEmpty():
        links = links.unionByName(more.filter("sure").select("a", "b")).unionByName(verified(more.filter("not sure").select("a", "b"), docs, heads, scratch, "more_links"))
        roots = components(links, scratch.part("second"))
    named = heads.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = named.join(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("key", "component_id")
    return found.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One document of each group: that with the smallest doc_id (of equal ids, any one)."""
    return keep_first(docs, scratch.keep(groups(docs.select("doc_id", "text"), scratch), "groups"), scratch)
