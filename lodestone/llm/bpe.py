"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

First all documents' pieces are counted (partial counts per task, summed by a shuffle on the piece);
the most frequent, ``LEXICON`` at most, are compiled, with their ids as outputs, into one automaton (see
``wordbpe``). Which these are is settled on the executors: a histogram of the counts gives the least
count that stays within that number, and only pieces from that count on go to the driver. The automaton's
bytes are broadcast, a few hundred kB at most for that number of pieces, and each worker reads them
through a memory map. Encoding looks pieces up there and merges unseen ones exactly, so the lexicon's
size changes the time and not the result.

Defined results: a null text counts as empty and has no ids; the strings of the tokenizer's special
tokens become their ids, as in the library; repeated rows each give their row; very long texts are
encoded whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch
from lodestone.llm.wordbpe import MEMO, Lexicon, Memo, WordBpe, texts_of, tokenizer

#: Pieces in the lexicon at most, and classes of the histogram per doubling of a count.
LEXICON, CLASSES = 32_768, 16
#: Bytes of a piece in the lexicon at most; longer ones are always merged.
PIECE_BYTES = 64
#: Distinct pieces that a task counts before it passes its partial counts on.
PARTIAL = 200_000


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """(piece, n) over all documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = tokenizer(path), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

        for _, texts in texts_of(batches):
            for text in texts:
                seen.update(bpe.pieces(text))
            if len(seen) > PARTIAL:
                yield out()
                seen.clear()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_pieces(counts: DataFrame, size: int) -> DataFrame:
    """(piece) of written counts: those of the highest classes of counts that have no more than ``size`` pieces together."""
    of_class = F.floor(F.log2(F.col("n")) * CLASSES).alias("class")
    fits = counts.filter((F.col("n") > 0) & (F.octet_length("piece") <= PIECE_BYTES))
    histogram = fits.groupBy(of_class).agg(F.count("*").alias("pieces")).orderBy(F.desc("class")).collect()  # CLASSES rows a bit of a long
    least, total = None, 0
    for row in histogram:
        total += row["pieces"]
        if total > size:
            break
        least = row["class"]
    return fits.filter(F.lit(False) if least is None else of_class >= least).select("piece")


def build_lexicon(docs: DataFrame, path: str, scratch: Scratch, size: int = LEXICON) -> bytes:
    """The automaton of the most frequent pieces."""
    top = frequent_pieces(scratch.keep(piece_counts(docs, path), "piece_counts"), size).collect()  # size pieces at most
    bpe = tokenizer(path)
    return Lexicon.compile({r["piece"]: bpe.merge(r["piece"]) for r in top if r["piece"]})


def ids_of(lexicon: Lexicon, bpe: WordBpe, piece: str) -> list[int]:
    """From the lexicon; of a piece that isn't there, by merging."""
    found = lexicon.find(piece) if piece not in bpe.special else None
    return bpe.merge(piece) if found is None else found


@lru_cache(1)
def lexicon_memo(path: str, lexicon: bytes) -> Memo:
    """A worker's pieces with their ids; kept from task to task."""
    bpe, lex = tokenizer(path), Lexicon(lexicon)
    return Memo(lambda piece: tuple(ids_of(lex, bpe, piece)), MEMO)


def encode(docs: DataFrame, path: str, lexicon: bytes) -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lex = tokenizer(path), Lexicon(shared.value)
        coded = Memo(lambda piece: np.asarray(ids_of(lex, bpe, piece), np.uint16).tobytes()).__getitem__
        for ids, texts in texts_of(batches):
            data = [b"".join(map(coded, bpe.pieces(t))) for t in texts]
            ends = np.cumsum([0, *(len(d) // 2 for d in data)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(data), np.uint16).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the tokens joined by spaces, as the library has no decoder for this vocabulary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(path).tokens
        for batch in batches:
            texts = [" ".join([tokens[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, lexicon: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding each text to its ids and decoding those."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, looked_up = tokenizer(path), lexicon_memo(path, shared.value).__getitem__
        decimal, token = [str(i) for i in range(len(bpe.tokens))].__getitem__, bpe.tokens.__getitem__
        for doc_ids, texts in texts_of(batches):
            n, ids_sha, decoded_sha = [], [], []
            for text in texts:
                ids = list(chain.from_iterable(map(looked_up, bpe.pieces(text))))
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(" ".join(map(token, ids)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def report(docs: DataFrame, path: str, scratch: Scratch) -> DataFrame:
    return digests(docs, path, build_lexicon(docs, path, scratch))
