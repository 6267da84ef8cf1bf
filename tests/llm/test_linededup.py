import random
from itertools import combinations

import numpy as np
import pytest

from lodestone.llm import linededup
from lodestone.llm.common import Scratch
from tests.llm.helpers import frame, odd_rows, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n, alphabet="abcdé "):
    chars = list(text)
    for _ in range(n):
        if not chars:
            break
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice(alphabet)
        elif kind == 1:
            chars.insert(at, rng.choice(alphabet))
        else:
            del chars[at]
    return "".join(chars)


@pytest.mark.parametrize("tau", [1, 2, 3, 5])
def test_banded_distance(tau):
    rng = random.Random(tau)
    left, right = [], []
    for _ in range(1500):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(tau, 40)))
        b = edited(rng, a, rng.randrange(0, tau + 3), "ab") if a else a
        if rng.random() < 0.2:
            b = "".join(rng.choice("ab") for _ in range(rng.randrange(tau, 40)))
        left.append(a)
        right.append(b)
    got = linededup.edit_distances(left, right, tau)
    expected = [min(distance(a, b), tau + 1) if min(len(a), len(b)) >= tau else tau + 1 for a, b in zip(left, right)]
    assert got.tolist() == expected


@pytest.mark.parametrize("tau, k", [(1, 2), (2, 3), (2, 8), (3, 4), (2, 24), (1, 8)])
def test_entries_meet_for_every_pair_within_tau(tau, k):
    rng = random.Random(10 * tau + k)
    missed = 0
    for _ in range(400 if k < 24 else 60):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(linededup.MIN_CHARS + tau, 60)))
        b = edited(rng, a, rng.randrange(0, tau + 1), "abc")
        if len(b) < linededup.MIN_CHARS:
            continue
        keys, ids = linededup.entries([a, b], np.array([1, 2]), k, tau)
        index = {(i, int(x)) for x, i in zip(keys, ids) if not x & 1}
        missed += not any((3 - i, int(x) & ~1) in index for x, i in zip(keys, ids) if x & 1)
    assert missed == 0


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_deletions_are_all_that_deleting_makes(tau):
    rng = random.Random(tau)
    lines = ["".join(rng.choice("abé") for _ in range(n)) for n in (1, 2, 5, 9, 9, 12)] + ["ab" * 4, "ab" * 4 + "a"]
    keys, ids = linededup.deletions(lines, np.arange(len(lines)), tau)
    made = {}
    for i, x in enumerate(lines):
        for n in range(min(tau, len(x)) + 1):
            for gone in combinations(range(len(x)), n):
                made.setdefault("".join(c for j, c in enumerate(x) if j not in gone), []).append(i)
    found = {}
    for key, i in zip(keys.tolist(), ids.tolist()):
        found.setdefault(key, []).append(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, made.values()))


def test_template_lines_are_linked_without_comparing_all(spark, monkeypatch):
    monkeypatch.setattr(linededup, "CROWD", 1000)
    rows = [(i, f"row {i * 37 % 10_000:05d} of the template that all of these lines share", "en", "a") for i in range(1500)]
    rows += [(5000 + i, "x" * 300 + f"{i:04d}" + "y" * 300, "en", "a") for i in range(40)]
    got = {r["doc_id"]: (r["n_links"], r["kept"]) for r in linededup.report(frame(spark, rows), Scratch(spark, "t")).collect()}
    texts = [t for _, t, *_ in rows]
    digits = [t[300:304] if t[0] == "x" else t[4:9] for t in texts]  # lines of a template differ in these alone
    for at in range(0, len(rows), 50):
        near = [j for j, t in enumerate(texts) if j != at and t[0] == texts[at][0] and distance(digits[j], digits[at]) <= 2]
        assert got[rows[at][0]] == (len(near), not any(rows[j][0] < rows[at][0] for j in near))


def naive(rows, tau=linededup.TAU):
    places = {}
    for i, text, *_ in rows:
        for n, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\x0b\f\r")
            if line:
                places.setdefault(line, []).append((-1 if i is None else i, n))
    heads = {line: min(p) for line, p in places.items()}
    texts = list(places)
    near = {t: [u for u in texts if u != t and min(len(t), len(u)) >= linededup.MIN_CHARS and abs(len(u) - len(t)) <= tau and distance(t, u) <= tau] for t in texts}
    out = []
    for t, where in places.items():
        dropped = any(heads[u] < heads[t] for u in near[t])
        out += [(*p, *heads[t], len(near[t]), p == heads[t] and not dropped) for p in where]
    return sorted(out)


def rows_with_copies(rng, crowd=False):
    rows = [r for r in odd_rows() if r[0] != 6]
    for g in range(10):
        base = [prose(rng, rng.choice([6, 12]), 60) for _ in range(4)]
        for _ in range(rng.choice([1, 3, 5])):
            rows.append((100 + len(rows), "\n".join(edited(rng, x, rng.choice([0, 0, 1, 2, 3])) for x in base), "en", "a"))
    if crowd:
        shared = prose(rng, 14, 60)
        for i in range(150):
            words = shared.split()
            words[rng.randrange(14)] = f"other{i % 40}"
            rows.append((1000 + i, " ".join(words), "en", "a"))
    return rows


@pytest.mark.parametrize("crowd", [False, True])
def test_report_equals_brute_force(spark, monkeypatch, crowd):
    if crowd:
        monkeypatch.setattr(linededup, "CROWD", 4)
    rows = rows_with_copies(random.Random(4), crowd)
    got = linededup.report(frame(spark, rows, extra=True), Scratch(spark, "t")).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == naive(rows)


def test_clean(spark):
    rows = rows_with_copies(random.Random(6))
    docs = frame(spark, rows, extra=True)
    got = linededup.clean(docs, Scratch(spark, "t"))
    assert got.columns == docs.columns
    keep = {(a, b) for a, b, *_, kept in naive(rows) if not kept}
    texts = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["n_chars"]) for r in got.collect() if r["text"] is not None)
    expected = []
    for i, text, *_ in rows:
        if text is not None:
            i = -1 if i is None else i
            left = "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in keep)
            expected.append((i, left, len(left)))
    assert texts == sorted(expected)


def test_empty(spark):
    assert linededup.report(frame(spark, []), Scratch(spark, "t")).count() == 0
