"""Lexical search: token statistics, full-text queries and BM25.

A query is parsed on the driver to a tree of phrases under AND, OR and NOT. Each document's tokens are
an array, a phrase's frequency is counted in it, and all corpus statistics come from one aggregation
with a row as result; so a query takes two scans, and no exchange but for that row and the top k.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ACCENTED, CODE_TOKEN, PLAIN, code_tokens, word_tokens

#: Fixed values of the ranking function; the floor of a term's weight; tokens of a fallback query.
K1, B, FLOOR, FALLBACK_TOKENS = 1.2, 0.75, 1e-6, 16


def term_frequencies(docs: DataFrame, tokens: Column) -> DataFrame:
    """(path, term, tf)."""
    return docs.select("path", F.explode(tokens).alias("term")).groupBy("path", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df) of (path, term, tf)."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: document_count and average_length, 0 for an empty corpus."""
    return docs.agg(F.count("*").alias("document_count"), F.coalesce(F.avg(F.size(tokens)), F.lit(0.0)).alias("average_length"))


def merged_document_frequencies(kept: DataFrame, changed: DataFrame) -> DataFrame:
    """(term, df) from the stored maps path -> {term: tf} of unchanged files and those of changed ones."""
    maps = kept.select("path", "tf").join(changed.select("path"), "path", "left_anti").unionByName(changed.select("path", "tf"))
    return maps.select(F.explode(F.map_keys("tf")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def overlap(tf: DataFrame, terms: list[str]) -> DataFrame:
    """(path, score): how often the distinct terms are in each document of (path, term, tf)."""
    return tf.filter(F.col("term").isin(list(dict.fromkeys(terms)))).groupBy("path").agg(F.sum("tf").alias("score"))


# Full-text queries


class NotFullText(ValueError):
    """The string isn't a full-text expression."""


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Node:
    op: str  # AND, OR, NOT
    parts: tuple = field(default_factory=tuple)


LEXEME = re.compile(r'\s*(?:"((?:[^"]|"")*)"|(\(|\)|\+|\*|:|,)|([^\s"()+*:,]+))')
BAREWORD = re.compile(r"[A-Za-z0-9_\x1a\u0080-\U0010FFFF]+$")


def plain_tokens(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(ACCENTED, PLAIN))))


class _Parser:
    def __init__(self, query: str):
        self.items, at = [], 0
        query = query.rstrip()
        while at < len(query):
            m = LEXEME.match(query, at)
            if not m:
                raise NotFullText(query)
            if m[1] is not None:
                self.items.append(("string", m[1].replace('""', '"')))
            elif m[2]:
                self.items.append((m[2], m[2]))
            elif BAREWORD.match(m[3]):
                self.items.append((m[3] if m[3] in ("AND", "OR", "NOT") else "word", m[3]))
            else:
                raise NotFullText(query)
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        return self.items[self.at + ahead][0] if self.at + ahead < len(self.items) else None

    def take(self, kind: str | None = None) -> str:
        if self.peek() is None or (kind and self.peek() != kind):
            raise NotFullText("unexpected end or token")
        self.at += 1
        return self.items[self.at - 1][1]

    def chain(self, op: str, below):
        parts = [below()]
        while self.peek() == op:
            self.take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else reduce(lambda a, b: Node(op, (a, b)), parts)

    def either(self):
        return self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", self.implied)))

    def implied(self):
        parts = [self.unit()]
        while self.peek() in ("word", "string", "("):
            parts.append(self.unit())
        return reduce(lambda a, b: Node("AND", (a, b)), parts)

    def unit(self):
        if self.peek() == "(":
            self.take()
            inner = self.either()
            self.take(")")
            return inner
        if self.peek() == "word" and self.peek(1) == ":":
            if self.items[self.at][1] != "content":
                raise NotFullText("no such column")
            self.at += 2
            return self.unit()
        if self.peek() == "word" and self.items[self.at][1] == "NEAR" and self.peek(1) == "(":
            self.at += 2
            phrases, distance = [], 10
            while self.peek() in ("word", "string"):
                phrases.append(self.phrase())
            if self.peek() == ",":
                self.take()
                distance = int(self.take("word"))
            self.take(")")
            return Near(tuple(phrases), distance)
        return self.phrase()

    def phrase(self) -> Phrase:
        if self.peek() not in ("word", "string"):
            raise NotFullText("a phrase is missing")
        terms = list(plain_tokens(self.take()))
        while self.peek() == "+":
            self.take()
            if self.peek() not in ("word", "string"):
                raise NotFullText("a phrase is missing")
            terms += plain_tokens(self.take())
        prefix = self.peek() == "*"
        if prefix:
            self.take()
        return Phrase(tuple(terms), prefix)


def parse(query: str):
    """The query's tree; NotFullText where it isn't an expression."""
    parser = _Parser(query)
    tree = parser.either()
    if parser.peek() is not None:
        raise NotFullText(query)
    return tree


def fallback(query: str):
    """The first distinct code tokens of the query under OR; None if it has none."""
    tokens: list[str] = []
    for run in re.findall(CODE_TOKEN, query):
        low = run.lower()
        pieces = [p for p in re.split("[/.]+", low) if p]
        parts = [p for p in re.split(r"[_./\s-]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", run).lower()) if p]
        tokens += [low, *(".".join(pieces[i:]) for i in range(1, len(pieces))), *parts, *(["".join(parts)] if len(parts) > 1 else [])]
    phrases = [Phrase(plain_tokens(t)) for t in list(dict.fromkeys(tokens))[:FALLBACK_TOKENS]]
    phrases = [p for p in phrases if p.terms]
    return reduce(lambda a, b: Node("OR", (a, b)), phrases) if phrases else None


def parse_or_fallback(query: str):
    try:
        return parse(query)
    except NotFullText:
        return fallback(query)


def phrases_of(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    return [p for part in tree.parts for p in phrases_of(part)]


def starts_of(tokens: Column, phrase: Phrase) -> Column:
    """Positions, from 0, at which the phrase begins."""
    if not phrase.terms:
        return F.array().cast("array<int>")

    def here(i: Column) -> Column:
        checks = [F.get(tokens, i + k) == t for k, t in enumerate(phrase.terms)]
        if phrase.prefix:
            checks[-1] = F.get(tokens, i + len(phrase.terms) - 1).startswith(phrase.terms[-1])
        return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))

    return F.when(F.size(tokens) >= len(phrase.terms), F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), here)).otherwise(F.array().cast("array<int>"))


def frequency(tokens: Column, phrase: Phrase) -> Column:
    if len(phrase.terms) == 1 and not phrase.prefix:
        return F.size(F.filter(tokens, lambda x: x == phrase.terms[0]))
    return F.size(starts_of(tokens, phrase))


def holds(tree, tokens: Column, found: dict[Phrase, Column]) -> Column:
    if isinstance(tree, Phrase):
        return found[tree] > 0
    if isinstance(tree, Near):
        all_there = reduce(lambda a, b: a & b, [found[p] > 0 for p in tree.phrases])
        if len(tree.phrases) < 2:
            return all_there
        # Some start of the first phrase has a start of every other within the distance.
        first = tree.phrases[0]

        def near(i: Column, p: Phrase) -> Column:
            after, before = tree.distance + len(first.terms), tree.distance + len(p.terms)
            return F.exists(starts_of(tokens, p), lambda j: (j - i <= after) & (i - j <= before))

        def close(i: Column) -> Column:
            return reduce(lambda a, b: a & b, [near(i, p) for p in tree.phrases[1:]])

        return all_there & F.exists(starts_of(tokens, first), close)
    left, right = (holds(p, tokens, found) for p in tree.parts)
    return {"AND": left & right, "OR": left | right, "NOT": left & ~right}[tree.op]


def bm25(docs: DataFrame, tree, tokens: Column | None = None) -> DataFrame:
    """(path, score) of the documents (path, text) that the tree holds for; statistics are those of all documents."""
    if tree is None:
        return docs.select("path", F.lit(0.0).alias("score")).filter(F.lit(False))
    phrases = list(dict.fromkeys(phrases_of(tree)))
    array = F.col("_tokens")
    made = word_tokens(F.col("text")) if tokens is None else tokens

    def counts(t: Column) -> Column:
        return F.struct(F.size(t).alias("_size"), *[frequency(t, p).alias(f"_tf{i}") for i, p in enumerate(phrases)], *([t.alias("_tokens")] if any_near(tree) else []))

    # Bound by a lambda, so that the tokens of a row are made once and not for each use.
    counted = docs.select("path", F.get(F.transform(F.array(made), counts), F.lit(0)).alias("_c")).select("path", "_c.*")
    totals = [F.count("*").alias("_n"), F.avg("_size").alias("_mean"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(phrases))]]
    joined = counted.crossJoin(F.broadcast(counted.agg(*totals)))  # one row
    found = {p: F.col(f"_tf{i}") for i, p in enumerate(phrases)}
    score = F.lit(0.0)
    for i in range(len(phrases)):
        tf, df = F.col(f"_tf{i}").cast("double"), F.col(f"_df{i}")
        raw = F.log((F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + F.when(raw <= 0, FLOOR).otherwise(raw) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_size") / F.col("_mean")))
    return joined.filter(holds(tree, array, found)).select("path", score.alias("score"))


def any_near(tree) -> bool:
    return isinstance(tree, Near) or (isinstance(tree, Node) and any(any_near(p) for p in tree.parts))


def search(docs: DataFrame, query: str, k: int, where: Column | None = None) -> DataFrame:
    """(path, score): the k best for the query string, ties by path; ``where`` limits what is returned and not the statistics."""
    if k <= 0 or not query.strip():
        return docs.select("path", F.lit(0.0).alias("score")).filter(F.lit(False))
    found = bm25(docs, parse_or_fallback(query))
    return (found if where is None else found.filter(where)).orderBy(F.desc("score"), "path").limit(k)


__all__ = ["bm25", "code_tokens", "corpus_statistics", "document_frequencies", "fallback", "merged_document_frequencies", "parse", "parse_or_fallback", "search", "term_frequencies"]
