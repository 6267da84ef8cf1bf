import hashlib
import random
import re

from lodestone.llm import pii
from lodestone.llm.common import Scratch
from tests.llm.helpers import frame, odd_rows, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [(a, kind, b) for a, _, b, kind in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    pieces = ["a@b.c", "@", "x.y@", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (988) 555-2485", "+", "1", ".", " ", "-", "é", "a", "12", "(", ")", "\n", "255.255.255.255", "+49 30 123456", "0"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == naive(text), text


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000) == [] and pii.base_spans("1" * 300_000) == [] and pii.base_spans("1." * 100_000) is not None
    assert pii.candidates("9" * 300_000) == [(0, 300_000)]


def test_em_finds_the_reliable_labeler():
    rng = random.Random(5)
    counts = {}
    for _ in range(5000):
        y = rng.random() < 0.3
        good = str(int(y)) if rng.random() < 0.95 else str(int(not y))
        fair = str(int(y)) if rng.random() < 0.7 else "-"
        noise = rng.choice("01-")
        counts[good + fair + noise] = counts.get(good + fair + noise, 0) + 1
    p, reliability = pii.expectation_maximisation(counts)
    assert p["11-"] > 0.9 and p["00-"] < 0.1
    assert reliability[0] > 0.85 > reliability[2] and abs(reliability[2] - 0.5) < 0.15


def test_report(spark):
    rng = random.Random(2)
    rows = odd_rows()
    secret_ids, plain_ids = [], []
    for i in range(100, 300):
        if i % 2:
            token = "".join(rng.choice("0123456789abcdef") for _ in range(18))
            rows.append((i, f"{prose(rng, 20)} password={token} {prose(rng, 5)} mail x{i}@mail.example.com", "en", "a"))
            secret_ids.append(i)
        else:
            rows.append((i, f"{prose(rng, 20)} in 1998-2004 and 12345678 pages, +1 (988) 555-2485 to 10.0.0.{i % 256}", "en", "a"))
            plain_ids.append(i)
    got = {r["doc_id"]: r for r in pii.report(frame(spark, rows, extra=True), Scratch(spark, "t")).collect()}
    for i, text, *_ in rows:
        base = naive(text or "")
        said = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[1] == k for s in base) for k in PATTERNS]
        assert {s for s in said.split(",") if s} <= set(got[i]["spans"].split(","))
    assert all(got[i]["n_secret"] == 1 for i in secret_ids)
    assert all(got[i]["n_secret"] == 0 for i in plain_ids)


def test_empty(spark):
    assert pii.report(frame(spark, []), Scratch(spark, "t")).count() == 0


def planted_rows(rng):
    """(doc_id, text, {kind: spans}): each kind in many contexts, and numbers that aren't private."""
    rows = []
    for i in range(400):
        kind = ("secret", "account", "iban", None)[i % 4]
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        while kind == "account" and pii.luhn(digits):
            digits = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        body = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int(body + "131400") % 97
        value = {"secret": "".join(rng.choice("0123456789abcdef") for _ in range(40)), "account": digits, "iban": f"DE{check:02d}{body}", None: rng.choice(["1999", "3.5", "12:30", "chapter4", "111111111111", "2,000", "version2"])}[kind]
        lead = {"secret": rng.choice(['token = "', 'api_key: "', "password="]), "account": rng.choice(["", "card ", "number "]), "iban": rng.choice(["iban ", "account "]), None: ""}[kind]
        text = f"{prose(rng, 12)} {lead}"
        spans = [] if kind is None else [(("account" if kind == "iban" else kind), len(text), len(text) + len(value))]
        rows.append((i, f"{text}{value}{'\"' if lead.endswith('\"') else ''} {prose(rng, 8)}", spans))
    return rows


def test_added_spans_are_found_by_kind(spark):
    rows = planted_rows(random.Random(12))
    got = {r["doc_id"]: r for r in pii.report(frame(spark, [(i, t, "en", "a") for i, t, _ in rows]), Scratch(spark, "t")).collect()}
    for kind in ("secret", "account"):
        planted = [(i, f"{k}:{a}:{b}") for i, _, spans in rows for k, a, b in spans if k == kind]
        hit = sum(s in got[i]["spans"].split(",") for i, s in planted)
        assert hit >= 0.9 * len(planted), (kind, hit, len(planted))
    assert all(got[i]["n_private"] == 0 for i, _, spans in rows if not spans)


def test_grouped_numbers():
    text = "pay 4000 1234 5678 9010 now, 12 3 or 1234-5678-9012"
    assert [text[a:b] for a, b in pii.candidates(text)] == ["4000 1234 5678 9010", "1234-5678-9012"]
