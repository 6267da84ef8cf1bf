"""Personal data and secrets by weak supervision.

Four base patterns (email, ip, card, phone) always stand. Beyond them, *candidates* are tokens with a
digit, tokens after a cue word such as ``password``, and numbers of 12 to 19 digits in groups. Labelers
vote on each candidate, private (1), not (0) or abstain: patterns (key=value, known key formats, hex
strings, mixed character classes, lengths and check digits of account numbers), gazetteers (cue words
before it; reserved example names; units after it) and context (quotes, plain-number surroundings). The
counts of all vote patterns of the corpus go to expectation-maximisation, which estimates each labeler's
reliability and the probability of each pattern; on these probabilities, for a bounded sample of
``SAMPLE`` candidates, a logistic span classifier is trained on shape and context features, and it
decides about every candidate. Candidates that it finds private, outside the base spans, are added, as
``account`` if they are numbers of an account's length or carry an account's check digits, and as
``secret`` if not. Names and postal addresses are not looked for.

Defined results: null and empty texts have no spans; base spans of different kinds may overlap; very
long texts are scanned whole, in linear time; repeated rows give the same row each; an empty table, or a
corpus without candidates, gives base spans only; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch
from lodestone.llm.wordbpe import texts_of

KINDS = ("email", "ip", "card", "phone", "secret", "account")
SAMPLE, PLACES, SURE = 20_000, 1 << 12, 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: An address or a card number lies within one of these, which start at a digit.
NUMERIC = re.compile(r"[0-9][0-9. -]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """By the @ signs: the local part is what of the run before it no earlier match has taken."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start and then by kind as in KINDS."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    for chunk in NUMERIC.finditer(text):
        a, b = chunk.span()
        if b - a < 7:
            continue
        for m in IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text, a, b):
            if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


#: Words before a secret; words that name what a number counts; parts of names reserved for examples.
CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "key", "bearer", "credential")
ACCOUNTS = ("card", "account", "iban", "visa", "mastercard", "konto", "karte", "carte", "compte", "tarjeta", "cuenta", "acct")
UNITS = ("kg", "km", "cm", "mm", "eur", "usd", "percent", "years", "days", "hours", "pages", "chapter")
RESERVED = ("example", "test", "sample", "dummy", "placeholder", "localhost", "xxxx")

BREAK = frozenset(" \t\n\x0b\x0c\r\"'`,;()[]{}<>=|")
DIGIT = re.compile("[0-9]")
CUE = re.compile(r"(?i)\b(?:" + "|".join(CUES) + r")\b[\x20\t]*[=:][\x20\t]*[\"']?")
KNOWN = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{36}$|sk[-_][A-Za-z0-9_-]{20,}$|xox[abprs]-[A-Za-z0-9-]{10,}$|eyJ[A-Za-z0-9_.-]{20,}$")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
HEX = re.compile(r"[0-9a-f]{16,}$|[0-9A-F]{16,}$")
ORDINARY = re.compile(r"[0-9]{1,4}(?:[.:/,%-][0-9]{1,4})*[a-z%]{0,3}[.:!?]*$|[A-Za-z]+[0-9]{1,3}[.:!?]*$")


def is_number(token: str) -> bool:
    """Digits alone, or in groups, of the length of a card's or an account's number."""
    return 12 <= len(digits_of(token)) <= 19 and all("0" <= c <= "9" or c in " -" for c in token)


def is_iban(token: str) -> bool:
    """By its form and the remainder of its check digits."""
    return bool(IBAN.match(token)) and int("".join(str(int(c, 36)) for c in token[4:] + token[:4])) % 97 == 1


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens of eight characters or more with a digit, tokens after a cue with = or :, and grouped numbers of an account's length."""
    found, at, n = {m.span() for chunk in NUMERIC.finditer(text) if chunk.end() - chunk.start() >= 12 for m in CARD.finditer(text, *chunk.span()) if is_number(m[0])}, 0, len(text)
    while (m := DIGIT.search(text, at)) is not None:
        a = b = m.start()
        while a > at and text[a - 1] not in BREAK:
            a -= 1
        while b < n and text[b] not in BREAK:
            b += 1
        if b - a >= 8:
            found.add((a, b))
        at = b
    if "=" in text or ":" in text:
        for m in CUE.finditer(text):
            a = b = m.end()
            while b < n and text[b] not in BREAK:
                b += 1
            if b - a >= 4:
                found.add((a, b))
    trimmed = set()
    for a, b in found:
        while b > a and text[b - 1] in ".:!?$%*&#":
            b -= 1
        trimmed.add((a, b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(trimmed, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:  # a token within a grouped number is part of it
            out.append((a, b))
    return out


def surroundings(text: str, a: int, b: int) -> tuple[str, str]:
    return text[max(0, a - 24) : a].lower(), text[b : b + 12].lower()


def votes(text: str, a: int, b: int) -> str:
    """A character for each labeler: 1 private, 0 not, - abstains."""
    token = text[a:b]
    before, after = surroundings(text, a, b)
    classes = sum(any(t(c) for c in token) for t in (str.islower, str.isupper, str.isdigit))
    switches = sum(x.isdigit() != y.isdigit() for x, y in zip(token, token[1:]))
    tail = before.rstrip(" =:\"'\t")
    last = re.split(r"[^a-z_]+", tail)[-1] if tail else ""
    first = re.split(r"[^a-z]+", after.lstrip())[0]
    number, kinds = is_number(token), len(set(digits_of(token)))
    return "".join((
        "1" if re.search(r"(?:" + "|".join(CUES) + r")[\x20\t]*[=:][\x20\t]*[\"']?$", before) else "-",
        "1" if KNOWN.match(token) else "-",
        "1" if HEX.match(token) and not token.isdigit() else "-",
        "1" if len(token) >= 12 and classes >= 2 and switches >= 3 and token.isalnum() else "0" if switches <= 1 and not number else "-",
        "1" if last in CUES else "-",
        "0" if any(r in token.lower() for r in RESERVED) else "-",
        "0" if first in UNITS else "-",
        "1" if a and text[a - 1] in "\"'=" and len(token) >= 12 else "-",
        "0" if ORDINARY.match(token) else "-",
        "1" if number and len(token) in (16, 19) else "-",
        "1" if number and kinds >= 5 else "0" if number and kinds <= 3 else "-",
        "1" if (number or is_iban(token)) and any(w in ACCOUNTS for w in re.split(r"[^a-z]+", before)) else "-",
        "1" if is_iban(token) else "-",
    ))


def shape(token: str) -> str:
    kinds = ["d" if c.isdigit() else "U" if c.isupper() else "l" if c.islower() else c for c in token[:48]]
    return "".join(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1])


def features(text: str, a: int, b: int) -> list[int]:
    """Hashed places: shape, start, length, share of digits, words around."""
    token = text[a:b]
    before, after = surroundings(text, a, b)
    share = 4 * sum(map(str.isdigit, token)) // max(1, len(token))
    hexed = all(c in "0123456789abcdefABCDEF" for c in token)
    left = re.findall(r"[^\W\d_]+|[=:\"']", before)[-2:]
    right = re.findall(r"[^\W\d_]+|[=:\"']", after)[:1]
    keys = [f"s{shape(token)[:8]}", f"p{token[:4] if token[:4].isupper() else ''}", f"n{min(len(token) // 4, 12)}", f"d{share}", f"h{hexed}", f"m{len(shape(token)) // 4}"]
    keys += [f"l{i}{w}" for i, w in enumerate(reversed(left)) if w in CUES or w in "=:\"'"] + [f"r{w}" for w in right if w in UNITS or w in "\"'"]
    return sorted({zlib.crc32(k.encode("utf-8")) % PLACES for k in keys})


def expectation_maximisation(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """P(private) of each vote pattern, and each labeler's reliability: how often its votes are right.

    Votes are right or wrong independently of each other. An abstention says nothing: several labelers
    abstain or vote together by their making, and would outvote one that knows a format of its own. Without
    votes either class is as likely. The start is the share of votes for private; a few votes given in
    advance, four of five right, keep a labeler that hardly votes near its prior.
    """
    names = sorted(patterns)
    if not names:
        return {}, np.empty(0)
    v = np.array([[{"0": -1.0, "1": 1.0, "-": 0.0}[c] for c in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    p = np.array([(1 + 2 * s.count("1")) / (2 + 2 * s.count("1") + 2 * s.count("0")) for s in names])
    for _ in range(rounds):
        right = (n[:, None] * ((v > 0) * p[:, None] + (v < 0) * (1 - p)[:, None])).sum(axis=0)
        reliability = (right + 4) / ((n[:, None] * (v != 0)).sum(axis=0) + 5)
        new = 1 / (1 + np.exp(-np.clip(v @ np.log(reliability / (1 - reliability)), -30, 30)))
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return dict(zip(names, p.tolist())), reliability


def train(rows: list[tuple[list[int], float]], epochs: int = 200, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights (the last is the constant) on features and probable labels, by AdaGrad."""
    w, g2 = np.zeros(PLACES + 1), np.full(PLACES + 1, 1e-8)
    if not rows:
        w[-1] = -30.0
        return w
    places = np.concatenate([np.array([*f, PLACES]) for f, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(f) + 1 for f, _ in rows])
    y = np.array([p for _, p in rows])
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.bincount(owner, w[places], len(rows))))
        g = np.bincount(places, (p - y)[owner], PLACES + 1) / len(rows) + decay * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


SCAN = "doc_id long, base array<struct<kind:int,start:int,end:int>>, found array<struct<kind:int,start:int,end:int,votes:string,places:array<int>>>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and candidates (with votes and features) of each text."""
    base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    found_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("places", pa.list_(pa.int32()))]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in texts_of(batches):
            base, found = [], []
            for text in texts:
                spans = base_spans(text)
                base.append([{"kind": KINDS.index(k), "start": a, "end": b} for a, k, b in spans])
                own, i = [], 0
                for a, b in candidates(text):
                    while i < len(spans) and spans[i][2] <= a and (i + 1 == len(spans) or spans[i + 1][0] <= a):
                        i += 1
                    if not any(s < b and a < e for s, _, e in spans[max(0, i - 4) : i + 4]):
                        token = text[a:b]
                        own.append({"kind": KINDS.index("account" if is_number(token) or is_iban(token) else "secret"), "start": a, "end": b, "votes": votes(text, a, b), "places": features(text, a, b)})
                found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base, base_type), pa.array(found, found_type)], ["doc_id", "base", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, SCAN)


def fit(scanned: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The span classifier's weights."""
    found = scanned.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    patterns = {r["votes"]: r["n"] for r in found.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # bounded by the labelers
    probable, _ = expectation_maximisation(patterns)
    order = F.xxhash64("doc_id", "start", F.lit(23))
    rows = found.select("votes", "places", order.alias("o"), "doc_id", "start").orderBy("o", "doc_id", "start").limit(sample).collect()
    return train([(list(r["places"]), probable[r["votes"]]) for r in rows])


def report(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_account, n_private, base_sha256, spans); n_private counts all spans."""
    scanned = scratch.keep(scan(docs), "scanned")
    shared = docs.sparkSession.sparkContext.broadcast(fit(scanned))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                base = [(s["start"], s["kind"], s["end"]) for s in row["base"]]
                added = [(c["start"], c["kind"], c["end"]) for c in row["found"] if 1 / (1 + np.exp(-(w[c["places"]].sum() + w[-1]))) >= SURE]
                said = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)) for spans in (base, base + added)]
                rows.append((row["doc_id"], *(sum(k == i for _, k, _ in base) for i in range(4)), *(sum(k == i for _, k, _ in added) for i in (4, 5)), len(base) + len(added), hashlib.sha256(said[0].encode()).hexdigest(), said[1]))
            columns = list(zip(*rows)) or [()] * 10
            kinds = [pa.int64()] * 8 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret", "n_account", "n_private", "base_sha256", "spans"])

    return scanned.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, n_account long, n_private long, base_sha256 string, spans string")
