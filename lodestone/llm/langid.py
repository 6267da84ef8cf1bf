"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Words (runs of letters, in lower case) give the 1- to 3-grams of the word with its boundaries, hashed into
``DIMENSIONS`` places. A text's vector is log(1 + count) * idf, of length one. Document frequencies are counted over
all training documents; the weights are fitted by follow-the-regularised-leader (FTRL-proximal) with
elastic-net penalties on a bounded sample (``PER_LANGUAGE`` documents of each language, a fifth of
them kept back to set the temperature that calibrates the scores).

Training documents are those with a language and a text whose crc32(doc_id as text) mod 5 is not 0.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text if
there was nothing to learn from; a null doc_id is not held out and not learned from; very long texts
are scored whole; repeated rows give the same row each; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sampling import fold, sample
from lodestone.llm.wordbpe import texts_of

DIMENSIONS, LONGEST_GRAM = 1 << 15, 3
PER_LANGUAGE = 600
FOLDS = 5


@lru_cache(1)
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def places_of(texts: list[str]) -> list[np.ndarray]:
    """The places of each text's grams; empty for a text without a letter.

    All texts are taken at once: other characters become one boundary between words, and a gram is any
    run of up to LONGEST_GRAM characters with a letter and without a boundary inside.
    """
    lowered = ["\n" + t.lower() + "\n" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    letter = letters()[codes]
    starts = np.append(True, owner[1:] != owner[:-1])
    kept = letter | starts | np.append(False, letter[:-1])  # of each run of others the first
    codes, owner, letter = np.where(letter, codes, 1)[kept].astype(np.uint32), owner[kept], letter[kept]
    places, owners = [], []
    for n in range(1, LONGEST_GRAM + 1):
        count = max(0, len(codes) - n + 1)
        h = np.full(count, np.uint32(0x9E3779B1 * n & 0xFFFFFFFF))
        inside, some = np.ones(count, bool), np.zeros(count, bool)
        for k in range(n):
            h = (h ^ codes[k : k + count]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            some |= letter[k : k + count]
            if 0 < k < n - 1:
                inside &= letter[k : k + count]
        # Two boundaries side by side are the end of one text and the start of the next.
        wanted = some & inside & (owner[:count] == owner[n - 1 : n - 1 + count])
        places.append((h[wanted] % np.uint32(DIMENSIONS)).astype(np.int32))
        owners.append(owner[:count][wanted])
    every, owners = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.split(every[order], np.searchsorted(owners[order], np.arange(1, len(texts))))


def vector(places: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's TF-IDF vector."""
    tf = np.bincount(places, minlength=DIMENSIONS)
    at = np.flatnonzero(tf)
    x = np.log1p(tf[at]) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """Per place the number of training documents that have one of its grams, and the number of documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMENSIONS + 1, np.int64)
        for _, texts in texts_of(batches):
            for places in places_of(texts):
                seen[:DIMENSIONS] += np.bincount(places, minlength=DIMENSIONS) > 0
            seen[DIMENSIONS] += len(texts)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["place", "n"])

    rows = training.select("doc_id", "text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # bounded by DIMENSIONS
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:
        out[r["place"]] = r["n"]
    return out[:DIMENSIONS], int(out[DIMENSIONS])


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIMENSIONS x classes) and biases (without penalties)."""
    z, n = np.zeros((DIMENSIONS + 1, classes)), np.zeros((DIMENSIONS + 1, classes))
    penalty1, penalty2 = np.full((DIMENSIONS + 1, 1), l1), np.full((DIMENSIONS + 1, 1), l2)
    penalty1[-1] = penalty2[-1] = 0

    def weights(at) -> np.ndarray:
        rate = (beta + np.sqrt(n[at])) / alpha + penalty2[at]
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty1[at], 0) / rate

    random = np.random.default_rng(5)
    for _ in range(epochs):
        for i in random.permutation(len(samples)):
            at, x, label = samples[i]
            at, x = np.append(at, DIMENSIONS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    final = weights(slice(None))
    return final[:-1], final[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean()

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    training = docs.select("doc_id", "text", "lang").filter((fold(F.col("doc_id"), FOLDS) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = sorted(sample(training, "lang", per_language).collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))
    languages = tuple(sorted({r["lang"] for r in rows}))
    counted = [(places_of([r["text"]])[0], languages.index(r["lang"])) for r in rows]
    counted = [(places, label) for places, label in counted if len(places)]
    if not counted:
        return None
    frequencies, n = document_frequencies(training)
    idf = np.log((1 + n) / (1 + frequencies)) + 1
    vectors = [(*vector(places, idf), label) for places, label in counted]
    back = vectors[::5]
    weights, bias = ftrl([v for i, v in enumerate(vectors) if i % 5 or len(vectors) < 10], len(languages))
    model = LanguageModel(languages, idf, weights, bias, 1.0)
    logits = np.array([model.logits(at, x) for at, x, _ in back])
    return LanguageModel(languages, idf, weights, bias, temperature(logits, np.array([label for *_, label in back])))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for ids, texts in texts_of(batches):
            names, scores = [], []
            for places in places_of(texts):
                if own is None or not len(places):
                    names.append("und")
                    scores.append(0.0)
                    continue
                p = softmax(own.logits(*vector(places, own.idf)) / own.temperature)
                names.append(own.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
