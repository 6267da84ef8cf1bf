import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash
from lodestone.llm.common import Scratch
from tests.llm.helpers import frame, odd_rows, prose


def naive_fingerprint(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(rows):
    prints = [(i, naive_fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[root(a)] = root(b)
    heads = {}
    for x, (i, _) in enumerate(prints):
        heads.setdefault(root(x), []).append(i)
    return sorted(((i, f"{f:016x}", min((h for h in heads[root(x)] if h is not None), default=None)) for x, (i, f) in enumerate(prints)), key=str)


def test_report_equals_brute_force(spark):
    rng = random.Random(1)
    rows = odd_rows()
    for g in range(12):
        words = prose(rng, rng.choice([20, 80, 300])).split()
        for c in range(rng.choice([1, 2, 8])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((100 + len(rows), " ".join(copy), "en", "a"))
    got = simhash.report(frame(spark, rows, extra=True), Scratch(spark, "t")).collect()
    assert sorted((tuple(r) for r in got), key=str) == naive_components([(r[0], r[1]) for r in rows])


def test_empty_table(spark):
    assert simhash.report(frame(spark, []), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("n, bits", [(700, 9), (3000, 14)])
def test_crowded_buckets_lose_no_connection(spark, n, bits):
    """Fingerprints that differ in a few low bits crowd the buckets of the upper blocks."""
    rng = np.random.default_rng(n)
    values = np.unique(np.concatenate([rng.integers(0, 1 << bits, n), rng.integers(0, 1 << 62, 200)]).astype(np.int64))
    prints = spark.createDataFrame([(int(v),) for v in values], "fp long").repartition(4)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(prints, Scratch(spark, "t")), Scratch(spark, "u")).collect()}
    label = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert [roots.get(int(v), int(v)) for v in values] == [int(values[x]) for x in label]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (502, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500, 502: 500}


def test_keep_one(spark):
    rows = odd_rows()
    kept = simhash.keep_one(frame(spark, rows, extra=True), Scratch(spark, "t"))
    expected = {i for i, _, c in naive_components([(r[0], r[1]) for r in rows]) if i == c}
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == expected and len(ids) == len(expected)
    assert kept.columns == frame(spark, [], extra=True).columns
