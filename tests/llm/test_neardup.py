import random

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import neardup
from lodestone.llm.common import Scratch
from tests.llm.helpers import frame, odd_rows, prose


def naive_sets(rows):
    sets = []
    for _, t, *_ in rows:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return sets


def naive_components(rows):
    sets, label = naive_sets(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    heads = {}
    for x, r in enumerate(rows):
        heads.setdefault(label[x], []).append(r[0])
    return [(r[0], min((h for h in heads[label[x]] if h is not None), default=None)) for x, r in enumerate(rows)]


def edited_rows():
    """Copies of copies with edits, many of them at similarities about 0.8."""
    rng = random.Random(11)
    rows = odd_rows()
    for _ in range(25):
        chain = [prose(rng, rng.choice([30, 80, 250, 600])).split()]
        for _ in range(rng.choice([1, 4, 12])):
            copy = list(rng.choice(chain))
            for _ in range(rng.randrange(1, max(2, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(1000)}"
            chain.append(copy)
        rows += [(100 + len(rows) + i, " ".join(c), "en", "a") for i, c in enumerate(chain)]
    return rows


@pytest.mark.parametrize("held", [neardup.HELD, 3000])
def test_groups_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(neardup, "HELD", held)
    rows = edited_rows()
    got = neardup.groups(frame(spark, rows, extra=True), Scratch(spark, "t")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(naive_components(rows), key=str)
    assert neardup.groups(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_stage_drops_edited_copies(spark):
    """Copies with one word in forty changed, which lie at more than 3 bits of a fingerprint."""
    rng = random.Random(3)
    rows = []
    for g in range(10):
        words = prose(rng, 120).split()
        copy = [f"edit{g}" if i in (40, 80) else w for i, w in enumerate(words)]
        rows += [(2 * g, " ".join(words), "en", "a"), (2 * g + 1, " ".join(copy), "en", "a")]
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows, extra=True), "")
    assert {r["doc_id"] for r in kept.collect()} == {2 * g for g in range(10)}


def test_signatures_tell_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for n in (50, 1000, 5000):
        for _ in range(20):
            both, x, y = (rng.integers(0, 1 << 63, k, np.uint64) for k in (8 * n // 10, n // 10, n // 10))
            a, b = (neardup.signature(np.concatenate([both, own])) for own in (x, y))
            errors.append((a == b).mean() - len(both) / (len(both) + len(x) + len(y)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
