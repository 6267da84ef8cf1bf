"""Toxic spans by a linear-chain conditional random field, and document scores.

Documents are labelled, tokens are not, so token labels are derived first: over all labelled training
documents the document frequencies of words and of their prefixes are counted per label, and a token is
labelled toxic where it stands in a toxic document and its word or prefix is found almost only in those.
On sequences around such tokens, and on sequences of clean documents, a chain of two states is trained
by gradient ascent on the conditional likelihood; its features are the word, its prefixes and suffix,
and the evidence bins of the word and its neighbours. Forward-backward gives each token of a whole text
its marginal; the marginals' sum and maximum make the document score, by a logistic function fitted on
the training sample, and runs of tokens above one half are the offending spans.

Learning uses rows whose crc32(doc_id as text) mod 3 is not 1; the counts take all of those, the chain
a bounded sample of ``PER_LABEL`` documents of each label, and of the features found oftener in toxic documents than in any, by their odds,
``EVIDENCE`` at most are kept.

Defined results: a null or empty text has the score of no evidence, as has every text if nothing toxic
is labelled; labels that are null, or of documents that are missing, are not used; a document labelled
twice counts as toxic if one label says so; a null doc_id is not held out and not learned from; very
long texts are tagged whole, in runs of tokens; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch
from lodestone.llm.sampling import fold, sample
from lodestone.llm.wordbpe import MEMO, Memo, texts_of

FOLDS, HELD_OUT = 3, 1
PER_LABEL, EVIDENCE = 1_500, 20_000
#: Hashed features, tokens on either side of a sequence's centre, tokens that are combined at once.
PLACES, AROUND, RUN = 1 << 16, 8, 128
#: Characters of texts that are tagged at once.
TAGGED = 1 << 20
MIN_DOCUMENTS = 5
#: Marked tokens of a document, drawn from all of them, around which sequences are trained on.
CENTRES = 6
WORDS = re.compile(r"[^\W_]+")
#: Upper limits of the bins of a feature's log-odds.
LIMITS = [-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
BINS = np.array(LIMITS)
#: Log-odds, over those of any document, from which a word or prefix marks tokens of toxic documents.
STRONG = 4.0


def parts(word: str) -> list[str]:
    """The word and its prefixes, as keys of evidence."""
    return [f"={word}"] + [f"^{word[:n]}" for n in range(3, 9) if len(word) > n]


def one_of_each_copy(training: DataFrame) -> DataFrame:
    """Training documents without copies, which would make every word of a copied document evidence.

    Documents of one label with the same words in the same order are copies; the one with the smallest
    doc_id stands for them.
    """
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    texts = training.select("doc_id", "toxic", F.md5(F.array_join(F.array_remove(words, ""), " ").cast("binary")).alias("same"))
    return training.join(texts.groupBy("toxic", "same").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "doc_id", "left_semi")


def evidence(training: DataFrame, base: float) -> dict[str, float]:
    """Log-odds of toxic documents by key, for the keys with most evidence over the base. training: doc_id, text, toxic."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = Memo(parts), (Counter(), Counter())

        def out() -> pa.RecordBatch:
            both = list(seen[0].keys() | seen[1].keys())
            rows = [both, [seen[1][k] for k in both], [seen[0][k] for k in both]]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], ["key", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen[int(toxic > 0)].update(set().union(*map(keys.__getitem__, set(WORDS.findall((text or "").lower())))))
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield out()
        yield out()

    sums = training.mapInArrow(run, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    rows = sums.filter(F.col("toxic") >= MIN_DOCUMENTS).withColumn("odds", odds).filter(F.col("odds") >= base + float(BINS[2])).orderBy(F.desc(F.col("toxic") * (F.col("odds") - base)), "key").limit(EVIDENCE).collect()  # bounded
    return {r["key"]: r["odds"] for r in rows}


def bin_of(word: str, odds: dict[str, float], base: float) -> int:
    best = max((odds[k] for k in parts(word) if k in odds), default=-9.0)
    return int(np.searchsorted(BINS, best - base))


def features(word: str, bin_: int) -> list[int]:
    """Places of the word's own features."""
    own = [f"={word}", f"${word[-3:]}", *(f"{n}{word[:n]}" for n in range(3, 9))]
    return [zlib.crc32(k.encode("utf-8")) % PLACES for k in own] + [PLACES + bin_]


@dataclass
class Chain:
    """own: of state 1 against 0 per feature; left, right: by the neighbour's bin; move[i, j]: from state i to j."""

    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    move: np.ndarray


def marginals(emission: np.ndarray, starts: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(state 1) of each token of sequences that start at the given places (ascending, the first 0).

    Runs of up to RUN tokens of all sequences are taken in step: the product of a run's 2 x 2 factors
    first, then along each sequence the messages that enter its runs, then the tokens within runs.
    """
    n = len(emission)
    if not n:
        return np.empty(0)
    sizes = np.diff(np.append(starts, n))
    runs = -(-sizes // RUN)
    first = np.repeat(starts, runs) + RUN * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    stop = np.minimum(first + RUN, np.repeat(starts + sizes, runs))
    order = np.argsort(first - stop, kind="stable")  # long runs first
    long = (stop - first)[order]
    weight = np.exp(np.clip(emission, -30, 30))  # of state 1 against state 0
    m = np.exp(move - move.max())
    head = np.zeros(n, bool)
    head[starts] = True
    k = len(first)

    def live(step: int) -> int:
        return int(np.searchsorted(-long, -step, side="left"))

    product = np.tile(np.eye(2), (k, 1, 1))
    for s in range(int(long[0])):
        c = live(s)
        at = first[order[:c]] + s
        p = product[:c]
        step = np.where(head[at][:, None, None], p, p @ m)
        step[:, :, 1] *= weight[at][:, None]
        product[:c] = step / step.sum(axis=(1, 2), keepdims=True)
    matrix = np.empty_like(product)
    matrix[order] = product
    forward, backward = np.empty((k, 2)), np.empty((k, 2))
    ends = np.cumsum(runs)
    for e, r in zip(ends.tolist(), runs.tolist()):
        v = np.array([0.5, 0.5])
        for i in range(e - r, e):
            forward[i] = v
            v = v @ matrix[i]
            v /= v.sum()
        v = np.array([0.5, 0.5])
        for i in range(e - 1, e - r - 1, -1):
            backward[i] = v
            v = matrix[i] @ v
            v /= v.sum()
    alpha = np.empty((n, 2))
    v = forward[order].copy()
    for s in range(int(long[0])):
        c = live(s)
        at = first[order[:c]] + s
        step = np.where(head[at][:, None], v[:c], v[:c] @ m)
        step[:, 1] *= weight[at]
        v[:c] = step / step.sum(axis=1, keepdims=True)
        alpha[at] = v[:c]
    out = np.empty(n)
    v = backward[order].copy()
    for s in range(int(long[0])):
        c = live(s)
        at = stop[order[:c]] - 1 - s
        both = alpha[at] * v[:c]
        out[at] = both[:, 1] / both.sum(axis=1)
        step = v[:c].copy()
        step[:, 1] *= weight[at]
        step = np.where(head[at][:, None], step, step @ m.T)
        v[:c] = step / step.sum(axis=1, keepdims=True)
    return out


def train(sequences: list[tuple[list[list[int]], list[int], list[int]]], epochs: int = 60, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Adam on the mean conditional log-likelihood. A sequence: features, bins and labels of its tokens."""
    nb = len(BINS) + 1
    width = max(len(s[2]) for s in sequences)
    n = len(sequences)
    slots = len(sequences[0][0][0])
    dummy = PLACES + nb
    f = np.full((n, width, slots), dummy, np.int64)
    bins, y, mask = np.full((n, width + 2), nb, np.int64), np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    for i, (own, b, labels) in enumerate(sequences):
        f[i, : len(labels)], bins[i, 1 : len(labels) + 1], y[i, : len(labels)], mask[i, : len(labels)] = own, b, labels, True
    own, left, right, move = np.zeros(PLACES + nb + 1), np.zeros(nb + 1), np.zeros(nb + 1), np.zeros((2, 2))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (own, left, right, move)]
    for epoch in range(1, epochs + 1):
        e = own[f].sum(axis=2) + left[bins[:, :-2]] + right[bins[:, 2:]]
        psi = np.stack([np.zeros_like(e), e], axis=2)
        alpha, beta = np.empty((n, width, 2)), np.zeros((n, width, 2))
        alpha[:, 0] = psi[:, 0]
        for t in range(1, width):
            alpha[:, t] = np.where(mask[:, t, None], np.logaddexp(alpha[:, t - 1, 0, None] + move[0], alpha[:, t - 1, 1, None] + move[1]) + psi[:, t], alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            nxt = beta[:, t + 1] + psi[:, t + 1]
            back = np.stack([np.logaddexp(move[i, 0] + nxt[:, 0], move[i, 1] + nxt[:, 1]) for i in (0, 1)], axis=1)
            beta[:, t] = np.where(mask[:, t + 1, None], back, 0.0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - total[:, None, None])[:, :, 1]
        delta = (y - p) * mask / n
        g_own = np.bincount(f.reshape(-1), np.repeat(delta.reshape(-1), slots), len(own)) - decay * own
        g_own[dummy] = 0
        g_left = np.bincount(bins[:, :-2].reshape(-1), delta.reshape(-1), nb + 1) - decay * left
        g_right = np.bincount(bins[:, 2:].reshape(-1), delta.reshape(-1), nb + 1) - decay * right
        g_move, pair = np.zeros((2, 2)), mask[:, 1:] & mask[:, :-1]
        for i in (0, 1):
            for j in (0, 1):
                expected = np.exp(alpha[:, :-1, i] + move[i, j] + psi[:, 1:, j] + beta[:, 1:, j] - total[:, None])
                g_move[i, j] = (((y[:, :-1] == i) & (y[:, 1:] == j)) * pair - expected * pair).sum() / n
        g_move -= decay * move
        for value, g, (m1, m2) in zip((own, left, right, move), (g_own, g_left, g_right, g_move), state):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.999
            m2 += 0.001 * g * g
            value += rate * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.999**epoch)) + 1e-8)
    return Chain(own, left, right, move)


#: What the hash of a feature begins with: the word, its last three letters, its beginnings of 3 to 8.
MARKS = [(n, zlib.crc32(str(n).encode())) for n in range(3, 9)]
WHOLE, LAST = zlib.crc32(b"="), zlib.crc32(b"$")


class WordTable:
    """Of each word its bin, its emission, and what it adds to its neighbours'; started anew between texts when large.

    The emission is the sum over ``features``, whose hashes are continued here from those of their marks.
    """

    def __init__(self, model: ToxicityModel):
        trained = model.chain
        self.base, self.own, self.left, self.right = model.base, trained.own.tolist(), trained.left.tolist(), trained.right.tolist()
        self.whole = {k[1:]: v for k, v in model.odds.items() if k[0] == "="}
        self.begun = {k[1:]: v for k, v in model.odds.items() if k[0] == "^"}
        self._restart()

    def _restart(self) -> None:
        self.table, self.places = array("d"), Memo(self._made, 1 << 62)

    def _made(self, word: str) -> int:
        at, own, crc32, best = len(self.places), self.own, zlib.crc32, self.whole.get(word, -9.0)
        for n in range(3, min(9, len(word))):
            odds = self.begun.get(word[:n])
            if odds is None:
                continue
            best = max(best, odds)
        b = bisect_left(LIMITS, best - self.base)
        data = word.encode("utf-8")
        if len(data) == len(word):
            beginnings, last = [data[:n] for n, _ in MARKS], data[-3:]
        else:
            beginnings, last = [word[:n].encode("utf-8") for n, _ in MARKS], word[-3:].encode("utf-8")
        e = own[PLACES + b] + own[crc32(data, WHOLE) % PLACES] + own[crc32(last, LAST) % PLACES]
        for (_, mark), beginning in zip(MARKS, beginnings):
            e += own[crc32(beginning, mark) % PLACES]
        self.table.extend((b, e, self.left[b], self.right[b]))
        return at

    def rows_of(self, token_lists: list[list[str]]) -> np.ndarray:
        if len(self.places) > MEMO:
            self._restart()
        places = np.fromiter(map(self.places.__getitem__, chain.from_iterable(token_lists)), np.int64, sum(map(len, token_lists)))
        return np.frombuffer(self.table).reshape(-1, 4)[places] if len(places) else np.empty((0, 4))


@lru_cache(1)
def word_table(model: ToxicityModel) -> WordTable:
    """A worker's words; kept from task to task."""
    return WordTable(model)


def groups_of(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about ``TAGGED`` characters, which are tagged at once."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= TAGGED:
            yield slice(start, at + 1)
            start, size = at + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


@dataclass(eq=False)
class ToxicityModel:
    odds: dict[str, float]
    base: float
    chain: Chain
    #: Of the score: constant, weight of the highest marginal, weight of the logarithm of 1 + their sum.
    score: np.ndarray

    def words(self) -> WordTable:
        return WordTable(self)

    def tag(self, token_lists: list[list[str]], words: WordTable) -> list[np.ndarray]:
        """Marginals of the tokens of each text."""
        sizes = [len(t) for t in token_lists]
        rows = words.rows_of(token_lists)
        starts = np.cumsum([0, *sizes])[:-1]
        filled = np.unique(starts[np.array(sizes, int) > 0]) if len(rows) else np.empty(0, int)
        outside = len(BINS) + 1
        e = rows[:, 1].copy()
        if len(rows):
            head = np.zeros(len(rows), bool)
            head[filled] = True
            tail = np.append(head[1:], True)
            e += np.where(head, self.chain.left[outside], np.roll(rows[:, 2], 1)) + np.where(tail, self.chain.right[outside], np.roll(rows[:, 3], -1))
        p = marginals(e, filled, self.chain.move)
        return np.split(p, starts[1:]) if sizes else []

    def scores(self, tagged: list[np.ndarray]) -> np.ndarray:
        x = np.array([summary(p) for p in tagged]).reshape(-1, 2)
        return 1 / (1 + np.exp(-(self.score[0] + x @ self.score[1:])))


def summary(p: np.ndarray) -> tuple[float, float]:
    return (float(p.max()), float(np.log1p(p.sum()))) if len(p) else (0.0, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the constant first) by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.eye(len(w))
        w += np.linalg.solve(h, a.T @ (y - p) - ridge * len(x) * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, per_label: int = PER_LABEL) -> ToxicityModel | None:
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    training = docs.select("doc_id", "text").join(marks.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT), "doc_id").select("doc_id", "text", "toxic")
    training = scratch.keep(one_of_each_copy(training), "training")
    rows = sorted(sample(training, "toxic", per_label).collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"] or ""))
    if len({r["toxic"] for r in rows}) < 2:
        return None
    balance = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    base = float(np.log((balance[1] + 0.5) / (balance[0] + 0.5)))
    odds = evidence(training, base)
    strong = {k for k, v in odds.items() if v - base >= STRONG}
    tokens = [WORDS.findall((r["text"] or "").lower()) for r in rows]
    bins = Memo(lambda w: bin_of(w, odds, base))
    random, sequences = np.random.default_rng(3), []
    for r, words in zip(rows, tokens):
        marked = [i for i, w in enumerate(words) if r["toxic"] and any(k in strong for k in parts(w))]
        centres = sorted(random.choice(marked, min(CENTRES, len(marked)), replace=False).tolist()) + ([int(random.integers(len(words))) for _ in range(2)] if words else [])
        for c in centres:
            cut = words[max(0, c - AROUND) : c + AROUND + 1]
            b = [bins[w] for w in cut]
            sequences.append(([features(w, x) for w, x in zip(cut, b)], b, [int(bool(r["toxic"]) and any(k in strong for k in parts(w))) for w in cut]))
    if not any(sum(s[2]) for s in sequences):
        return None
    model = ToxicityModel(odds, base, train(sequences), np.zeros(3))
    words, x = model.words(), []
    for at in range(0, len(tokens), 64):
        x += [summary(p) for p in model.tag(tokens[at : at + 64], words)]
    model.score = logistic(np.array(x), np.array([r["toxic"] for r in rows], float))
    return model


def _apply(docs: DataFrame, model: ToxicityModel | None, out, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        words = word_table(own) if own else None
        for ids, texts in texts_of(batches):
            for run_of in groups_of(texts):
                part = texts[run_of]
                tagged = own.tag([WORDS.findall(t.lower()) for t in part], words) if own else [np.empty(0)] * len(part)
                yield out(ids[run_of], part, tagged, own.scores(tagged) if own else np.zeros(len(part)))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""

    def out(ids: list, texts: list, tagged: list, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores)], ["doc_id", "score"])

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return _apply(docs, model, out, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def spans(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, spans): start, end (code points, end exclusive) and highest marginal of each run of tokens above one half."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def out(ids: list, texts: list, tagged: list, scores: np.ndarray) -> pa.RecordBatch:
        found = []
        for text, p in zip(texts, tagged):
            runs: list[dict] = []
            last = -2
            # Lower case can change a text's length ("İ"), so offsets come from the text itself.
            places = list(WORDS.finditer(text)) if (p > 0.5).any() else []
            if len(places) != len(p):
                places = list(WORDS.finditer(text.lower())) if places else []
            for i in np.flatnonzero(p > 0.5).tolist():
                if i == last + 1:
                    runs[-1]["end"], runs[-1]["p"] = places[i].end(), max(runs[-1]["p"], float(p[i]))
                else:
                    runs.append({"start": places[i].start(), "end": places[i].end(), "p": float(p[i])})
                last = i
            found.append(runs)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], ["doc_id", "spans"])

    return _apply(docs, model, out, "doc_id long, spans array<struct<start:int,end:int,p:double>>")


def report(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    return score(docs, fit(docs, labels, scratch))
