"""Line dedup: a segment-partition edit join over the lines of all documents.

Lines (without blanks at their ends) with a character left fall into *classes* of equal text, told apart
by two 64-bit hashes. Two classes of ``MIN_CHARS`` characters or more are linked if their texts are within
``TAU`` edits; in shorter lines so many edits make another line, and only equal ones are repeats. An occurrence of a line is dropped if it isn't the first of its class (by doc_id, then line number), or
if its class is linked to a class that begins earlier.

The join: a line of length L is cut into tau + 1 segments. Whatever is within tau edits has one of them
unchanged, at a place that tau limits, so each line gives one index entry for each segment, and as probe
one entry for each substring that could be such a segment of a line of its length or up to tau less.
Entries meet by a hash of segment number, length and content. Lines that meet are compared by the parities
of their characters' counts first, which discard most pairs that are further apart, so that few but
linked pairs leave a key; these are verified by banded bit-parallel edit distance, many pairs in step. A
key where too many meet for that (half a passage that very many lines share) gives no pairs: its lines
are entered again in ``FINER`` segments, of which all but tau have to agree, which leaves together only
lines that differ in the same small stretches. Lines that are still crowded (numbered rows of a template)
are entered by all that deleting up to tau characters makes of them, which brings together only what is
within 2 tau edits, so that what is compared grows with what is linked. Only of lines of more than
``DELETED_CHARS`` characters that agree in all but tau of the finest segments all are compared in place.

Defined results: null and empty texts, and blank lines, have no row; rows that repeat a doc_id with the same text are the same lines; a null doc_id comes first; very
long lines and texts are taken whole; empty tables give empty results; other columns are carried through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BLANKS, Scratch

TAU, MIN_CHARS = 2, 24
#: Segments for the lines of keys with more than CROWD pairs to compare.
FINER, CROWD = (8, 24), 4_000_000
#: Characters of a line up to which it can be entered by deletions, and variants that are made at once.
DELETED_CHARS, VARIANTS = 512, 1 << 20
#: Ids (a long each) up to which a set is broadcast.
SET_ROWS = 1_000_000
#: Characters of lines that are keyed at once, and distinct lines that a task remembers.
CHARS, SEEN = 1 << 20, 500_000

BASE = np.uint64(0x9E3779B97F4A7C55)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Substrings:
    """Hashes of substrings of some lines, from prefix sums of code * BASE ** position modulo 2 ** 64."""

    def __init__(self, lines: list[str]):
        self.sizes = np.array([len(x) for x in lines], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        powers = np.full(len(codes) + 1, BASE)
        powers[0] = 1
        back = np.full(len(codes) + 1, INVERSE)
        back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(codes + np.uint64(1)) * np.cumprod(powers)[:-1])])

    def __call__(self, line: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = self.starts[line] + start, self.starts[line] + end
        return mix((self.sums[b] - self.sums[a]) * self.back[a])


def layouts(k: int, tau: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(number, runs) for each choice of tau of k segments to leave out; a run: first and last edge, segments left out before it."""
    for number, out in enumerate(combinations(range(k), tau)):
        runs, at = [], 0
        for before, j in enumerate([*out, k]):
            if j > at:
                runs.append((at, j, before))
            at = j + 1
        yield number, runs


def shifts(runs: list[tuple[int, int, int]], delta: int, k: int, tau: int) -> set[tuple[int, ...]]:
    """The places, relative to a line's own, where the runs of a line shorter by delta can stand in it."""
    found = set()
    for change in product(range(-tau, tau + 1), repeat=tau):
        if sum(change) == delta and sum(map(abs, change)) <= tau:
            moved = tuple(sum(change[:before]) for _, _, before in runs)
            # With tau + 1 segments the one that stays can be chosen with no more edits on either side than segments.
            if k > tau + 1 or (abs(moved[0]) <= runs[0][2] and abs(delta - moved[0]) <= tau - runs[0][2]):
                found.add(moved)
    return found


def entries(lines: list[str], ids: np.ndarray, k: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, id): the lowest bit of a key is 0 for index entries and 1 for probes."""
    sub, keys, owners = Substrings(lines), [], []
    everyone = np.arange(len(lines))

    def key(line: np.ndarray, number: int, size: np.ndarray, runs: list, moved: tuple) -> np.ndarray:
        h = mix(size.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(number) + np.uint64(k << 56))
        for (a, b, _), shift in zip(runs, moved):
            h = mix(h ^ sub(line, a * size // k + shift, b * size // k + shift))
        return h

    for number, runs in layouts(k, tau):
        keys.append(key(everyone, number, sub.sizes, runs, (0,) * len(runs)) & ~np.uint64(1))
        owners.append(everyone)
        for delta in range(tau + 1):
            line = np.flatnonzero(sub.sizes - delta >= MIN_CHARS)
            size = sub.sizes[line] - delta
            for moved in shifts(runs, delta, k, tau):
                fits = np.ones(len(line), bool)
                for (a, b, _), shift in zip(runs, moved):
                    fits &= (a * size // k + shift >= 0) & (b * size // k + shift <= size + delta)
                keys.append(key(line[fits], number, size[fits], runs, moved) | np.uint64(1))
                owners.append(line[fits])
    return np.concatenate(keys).view(np.int64), ids[np.concatenate(owners)]


def deletions(lines: list[str], ids: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, id) for each way to delete up to tau characters of a line."""
    sub, keys, owners = Substrings(lines), [], []
    for line, (start, size) in enumerate(zip(sub.starts.tolist(), sub.sizes.tolist())):
        for n in range(min(tau, size) + 1):
            at = np.zeros((1, 0), np.int64)
            for _ in range(n):  # ascending places
                free = size - 1 - (at[:, -1] if at.shape[1] else np.full(1, -1))
                last = np.repeat(size - free, free) + np.arange(free.sum()) - np.repeat(np.cumsum(free) - free, free)
                at = np.column_stack([np.repeat(at, free, axis=0), last])
            h, before = np.zeros(len(at), np.uint64), np.full(len(at), start, np.int64)
            for k in range(n + 1):
                end = start + at[:, k] if k < n else np.full(len(at), start + size, np.int64)
                h += (sub.sums[end] - sub.sums[before]) * sub.back[start + k]
                before = end + 1
            keys.append(mix(h ^ np.uint64(size - n)))
            owners.append(np.full(len(at), line, np.int64))
    return np.concatenate(keys).view(np.int64), ids[np.concatenate(owners)]


def parities(lines: list[str]) -> np.ndarray:
    """Per line, as bits by hash, whether each character (low half) and each pair of characters (high half) occurs an odd number of times.

    An edit changes two bits of the low half at most, and four of the high one.
    """
    sizes = np.array([len(x) for x in lines], np.int64)
    codes = mix(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    one, starts = np.uint64(1), np.cumsum(sizes) - sizes
    marks = one << (codes >> np.uint64(59))
    twos = one << ((mix(codes[:-1] * np.uint64(3) + codes[1:]) >> np.uint64(59)) + np.uint64(32))
    twos = np.append(twos, np.uint64(0))
    twos[starts + sizes - 1] = 0  # from one line to the next
    return np.bitwise_xor.reduceat(marks ^ twos, starts).view(np.int64)


def keyed(lines: DataFrame, k: int, tau: int) -> DataFrame:
    """(key, id, mark) of lines (id, line), mark being their parities; by k segments, or by deletions if k is 0.

    A line that the task has just keyed is passed over.
    """

    def cost(text: str) -> int:
        return max(1, len(text) ** tau // 2) * CHARS // VARIANTS if k == 0 else len(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        per = CHARS if k in (0, tau + 1) else max(1, CHARS // k)
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (i, hash(text)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((i, hash(text)))
                ids.append(i)
                texts.append(text)
                size += cost(text)
                if size >= per:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield made(ids, texts)

    def made(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        everyone = np.arange(len(ids))
        keys, owners = entries(texts, everyone, k, tau) if k else deletions(texts, everyone, tau)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, np.array(ids, np.int64)[owners], parities(texts)[owners])], ["key", "id", "mark"])

    return lines.mapInArrow(run, "key long, id long, mark long")


def meeting(entered: DataFrame, crowd: int | None, tau: int, sides: bool = True) -> DataFrame:
    """(a, b): ids, a < b, of an index entry and a probe with one key; or (id, null) where more than ``crowd`` such pairs meet.

    Without sides any two entries with one key meet.

    Pairs whose parities tell that they are further apart are left out.
    """
    low = np.uint64(0xFFFFFFFF)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        passed = None  # the key whose entries go on one by one, as there are too many to hold

        def batch_of(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], ["a", "b"])

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, ids = columns[:2]
            new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))  # sorted: the same line from several tasks
            key, ids, marks = (c[new] for c in columns)
            starts = np.append(0, np.flatnonzero(np.diff(key >> 1)) + 1)
            sizes = np.diff(np.append(starts, len(key)))
            probes = np.add.reduceat(key & 1, starts)
            wanted = (probes > 0) & (probes < sizes) if sides else sizes > 1
            large = wanted & (probes * (sizes - probes) > crowd) if crowd else np.zeros(len(sizes), bool)
            hot = np.repeat(large, sizes)
            if hot.any():
                yield batch_of(np.unique(ids[hot]), None)
            rest = np.repeat(wanted & ~large, sizes)
            key, ids, marks = (c[rest] for c in (key, ids, marks))
            at, lag, found, size = np.arange(len(key)), 1, [np.empty((0, 2), np.int64)], 0
            while len(at):
                at = at[at + lag < len(key)]
                at = at[(key[at] >> 1) == (key[at + lag] >> 1)]
                pair = at[(((key[at] & 1) != (key[at + lag] & 1)) | (not sides)) & (ids[at] != ids[at + lag])]
                odd = (marks[pair] ^ marks[pair + lag]).view(np.uint64)
                pair = pair[(np.bitwise_count(odd & low) <= 2 * tau) & (np.bitwise_count(odd >> np.uint64(32)) <= 4 * tau)]
                found.append(np.sort(np.stack([ids[pair], ids[pair + lag]], axis=1), axis=1))
                size, lag = size + len(pair), lag + 1
                if size > 1 << 20:
                    found, size = [np.unique(np.concatenate(found), axis=0)], 0
            pairs = np.unique(np.concatenate(found), axis=0)
            if len(pairs):
                yield batch_of(pairs[:, 0].copy(), pairs[:, 1].copy())

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            if passed is not None:
                more = columns[0] >> 1 == passed
                if more.any():
                    yield batch_of(np.unique(columns[1][more]), None)
                    columns = [c[~more] for c in columns]
            key = columns[0]
            if not len(key):
                held = columns
                continue
            other = np.flatnonzero((key >> 1) != (key[-1] >> 1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from out([c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
            if crowd and len(held[0]) > crowd:
                passed = held[0][0] >> 1
                yield batch_of(np.unique(held[1]), None)
                held = [c[:0] for c in held]
        if held is not None and len(held[0]):
            yield from out(held)

    return entered.repartition(F.shiftright("key", 1)).sortWithinPartitions("key", "id").mapInArrow(run, "a long, b long")


def edit_distances(left: list[str], right: list[str], tau: int) -> np.ndarray:
    """Edit distance of each pair, or tau + 1 if it is more.

    Per pair a band of 2 tau + 1 diagonals is kept as vertical differences in two bit vectors, with the
    lowest diagonal in the highest bit; a step takes one character of every right text.
    """
    n1, n2 = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    out = np.full(len(left), tau + 1, np.int64)
    alive = np.flatnonzero((np.abs(n1 - n2) <= tau) & (np.minimum(n1, n2) >= tau))
    alive = alive[np.argsort(n2[alive], kind="stable")]
    at = 0
    while at < len(alive):
        most = 1
        while at + most < len(alive) and (most + 1) * int(n2[alive[at + most]] + 2 * tau) <= 4 << 20:
            most += 1
        rows = alive[at : at + most]
        out[rows] = _band([left[i] for i in rows], [right[i] for i in rows], n1[rows], n2[rows], tau)
        at += most
    return out


def _codes(texts: list[str], width: int, before: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, np.uint32)
    for i, x in enumerate(texts):
        out[i, before : before + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _band(left: list[str], right: list[str], n1: np.ndarray, n2: np.ndarray, tau: int) -> np.ndarray:
    top, one = np.uint64(1 << 63), np.uint64(1)
    width = int(max(n1.max(), n2.max())) + 2 * tau + 1
    p, t = _codes(left, width, tau, 0xFFFFFFFF).T.copy(), _codes(right, width, 0, 0xFFFFFFFE).T.copy()
    result = np.full(len(left), tau + 1, np.int64)
    rows = np.arange(len(left))
    vp, vn = np.full(len(left), np.uint64((((1 << 64) - 1) << (63 - tau)) & ((1 << 64) - 1))), np.zeros(len(left), np.uint64)
    score, limit, level = np.full(len(left), tau, np.int64), 2 * tau + n2 - n1, np.full(len(left), np.uint64(1 << 62))
    for i in range(int(n2.max())):
        ended = n2[rows] == i
        if i % 16 == 0 or ended.any():
            result[rows[ended]] = score[ended]
            go = ~ended & (score <= limit[rows])
            if not go.all():
                rows, vp, vn, score, level, p, t = rows[go], vp[go], vn[go], score[go], level[go], p[:, go], t[:, go]
            if not len(rows):
                break
        x = np.zeros(len(rows), np.uint64)
        for o in range(2 * tau + 1):
            x |= (p[i + o] == t[i]).astype(np.uint64) << np.uint64(63 - 2 * tau + o)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        diagonal = i < n1[rows] - tau
        flat = ~diagonal
        score += np.where(diagonal, (d0 & top) == 0, 0)
        score += np.where(flat, ((hp & level) != 0).astype(np.int64) - ((hn & level) != 0), 0)
        level = np.where(flat, level >> one, level)
        down = d0 >> one
        vp, vn = hn | ~(down | hp), down & hp
    result[rows] = np.where(n2[rows] == n2.max(), score, result[rows])
    return np.minimum(result, tau + 1)


def verified(pairs: DataFrame, tau: int) -> DataFrame:
    """(a, b) of pairs (a, b, left, right) within tau edits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = edit_distances(batch.column(2).to_pylist(), batch.column(3).to_pylist(), tau) <= tau
            yield batch.select([0, 1, 4, 5]).filter(pa.array(near))

    return pairs.select("a", "b", "left", "right", "a2", "b2").mapInArrow(run, "a long, b long, a2 long, b2 long")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, at, line, id, id2): the lines with a character; key is of the text, id and id2 of the line."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(BLANKS)).alias("line")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.explode(F.filter(lines, lambda x: x["line"] != "")).alias("x")).select("doc_id", "key", "x.*")
    return rows.withColumn("id", F.xxhash64("line")).withColumn("id2", F.xxhash64(F.lit(7), "line"))


def _bounded(ids: DataFrame) -> DataFrame:
    """A written set of ids, for broadcast if it is small."""
    return F.broadcast(ids) if ids.count() <= SET_ROWS else ids


def links(docs: DataFrame, scratch: Scratch, tau: int = TAU) -> DataFrame:
    """(id, id2, other, other2): both ways, the classes within tau edits.

    Texts are fetched once, for the lines of pairs and of crowded keys; what is entered again in finer
    segments is taken from those.
    """
    lines = lines_of(docs).filter(F.length("line") >= MIN_CHARS)
    first = scratch.keep(meeting(keyed(lines.select("id", "line"), tau + 1, tau), CROWD, tau).distinct(), "met_0")
    pairs, crowded = first.filter("b is not null"), first.filter("b is null").select(F.col("a").alias("id"))
    needed = scratch.keep(first.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    texts = scratch.keep(lines.select("id", "id2", "line").join(_bounded(needed), "id", "left_semi").groupBy("id", "id2").agg(F.first("line").alias("line")), "texts")
    for k in FINER:
        if crowded.isEmpty():
            break
        again = texts.select("id", "line").join(_bounded(crowded), "id", "left_semi")
        met = scratch.keep(meeting(keyed(again, k, tau), CROWD, tau).distinct(), f"met_{k}")
        pairs, crowded = pairs.unionByName(met.filter("b is not null")), met.filter("b is null").select(F.col("a").alias("id"))
    if not crowded.isEmpty():
        again = texts.select("id", "line").join(_bounded(crowded), "id", "left_semi")
        # Of two lines within tau edits either both are short enough for deletions, or both are longer than DELETED_CHARS.
        short = meeting(keyed(again.filter(F.length("line") <= DELETED_CHARS + tau), 0, tau), None, tau, sides=False)
        long = meeting(keyed(again.filter(F.length("line") > DELETED_CHARS), FINER[-1], tau), None, tau)
        pairs = pairs.unionByName(scratch.keep(short.unionByName(long).distinct(), "met_crowds"))
    one, two = (texts.select(F.col("id").alias(n), F.col("id2").alias(f"{n}2"), F.col("line").alias(side)) for n, side in (("a", "left"), ("b", "right")))
    near = scratch.keep(verified(pairs.distinct().join(one, "a").join(two, "b"), tau), "links")
    names = ("id", "id2", "other", "other2")
    return near.select(*[F.col(c).alias(n) for c, n in zip(("a", "a2", "b", "b2"), names)]).union(near.select(*[F.col(c).alias(n) for c, n in zip(("b", "b2", "a", "a2"), names)]))


def classes(docs: DataFrame, places: DataFrame, scratch: Scratch, tau: int = TAU) -> DataFrame:
    """(id, id2, head, n_links, dropped): head is the first occurrence (doc_id, key, at); dropped if a linked class has an earlier one."""
    heads = scratch.keep(places.select("id", "id2", F.struct("doc_id", "key", "at").alias("place")).groupBy("id", "id2").agg(F.min("place").alias("head")), "heads")
    both = links(docs, scratch, tau).join(heads.select(F.col("id").alias("other"), F.col("id2").alias("other2"), F.col("head").alias("other_head")), ["other", "other2"])
    linked = both.groupBy("id", "id2").agg(F.count("*").alias("n_links"), F.min("other_head").alias("least"))
    joined = heads.join(linked, ["id", "id2"], "left")
    return joined.select("id", "id2", "head", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("least") < F.col("head"), F.lit(False)).alias("dropped"))


def occurrences(docs: DataFrame, scratch: Scratch, tau: int = TAU) -> DataFrame:
    """Per line of a document (doc_id, key, at): its class's first occurrence, the class's number of links, and kept."""
    places = scratch.keep(lines_of(docs).drop("line"), "places")
    rows = places.join(classes(docs, places, scratch, tau), ["id", "id2"])
    first = F.struct("doc_id", "key", "at").eqNullSafe(F.col("head"))
    return rows.select("doc_id", "key", "at", F.col("head.doc_id").alias("class_doc_id"), F.col("head.at").alias("class_line"), "n_links", (first & ~F.col("dropped")).alias("kept"))


def report(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, line, class_doc_id, class_line, n_links, kept), lines numbered from 0."""
    return occurrences(docs.select("doc_id", "text"), scratch).select("doc_id", F.col("at").alias("line"), "class_doc_id", "class_line", "n_links", "kept")


def clean(docs: DataFrame, scratch: Scratch, tau: int = TAU) -> DataFrame:
    """The documents without their dropped lines; n_chars follows the text. All rows stay, if with an empty text."""
    gone = occurrences(docs.select("doc_id", "text"), scratch, tau).filter("not kept").groupBy("doc_id", "key").agg(F.collect_set("at").alias("r_gone"))
    gone = scratch.keep(gone.withColumnRenamed("doc_id", "r_doc_id").withColumnRenamed("key", "r_key"), "gone")
    total = gone.agg(F.coalesce(F.sum(4 + F.size("r_gone")), F.lit(0))).first()[0]
    gone = F.broadcast(gone) if total <= 4 * SET_ROWS else gone
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("l_doc_id"), F.xxhash64("text").alias("l_key"))
    joined = rows.join(gone, F.col("l_doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("l_key") == F.col("r_key")), "left")
    lines = F.split(F.col("row.text"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("r_gone"))
    text = F.when(F.col("r_gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn("_text", text)
    given = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[given[c].alias(c) if c in given else F.col("row")[c].alias(c) for c in docs.columns])
