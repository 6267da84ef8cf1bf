"""Benchmark decontamination by word windows, on DataFrame functions alone.

Benchmark and training words are the runs of digits, letters and characters beyond ASCII after A-Z
are lower-cased. A window is ten consecutive words of an item, or the whole of a shorter item. The
windows' hashes form a set that is broadcast (its size is counted first; a larger set is joined by a
shuffle), the windows of every training text probe it, and each hit is verified on the words
themselves.

Defined results: a null or empty text has no words and no hits; an item without words has no window;
the same item twice, or two items with a window in common, count by their ids; repeated documents get
the same row each; empty tables give empty results or no hits; other columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, small

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A broadcast hash set has at most so many longs, and so many hits (a dozen bytes each) are broadcast.
SET_ROWS = 2_000_000


def lower_ascii(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def window_hashes(hashes: str, n: int) -> Column:
    """Of an array of word hashes, the hash of each window of n, in order."""
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(n, window, hash, items): each window of the items once, with the ids of its items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    windows = items.select("item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("v"))
    size = F.size("v")
    hashed = F.coalesce(*[F.when(size == k, F.xxhash64(*[F.xxhash64(F.get("v", F.lit(j))) for j in range(k)])) for k in range(1, WINDOW + 1)])
    return windows.select("n", F.array_join("v", " ").alias("window"), hashed.alias("hash"), "item_id").groupBy("n", "window", "hash").agg(F.collect_set("item_id").alias("items"))


def _bounded(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= SET_ROWS else frame


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, key, hit_words, items) of the documents with a hit: sorted word positions and sorted item ids; key is a hash of the text."""
    windows = scratch.keep(benchmark_windows(benchmark), "windows")
    sizes = {r["n"]: r["rows"] for r in windows.groupBy("n").agg(F.count("*").alias("rows")).collect()}  # at most ten rows
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), item_words(F.col("text")).alias("w"))
    hashed = texts.select("doc_id", "key", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    found = None
    for n, rows in sorted(sizes.items()):
        probe = hashed.select("doc_id", "key", F.posexplode(window_hashes("h", n)).alias("at", "hash"))
        hits = probe.join(_bounded(windows.filter(F.col("n") == n).select("hash").distinct(), rows), "hash", "left_semi").select("doc_id", "key", F.lit(n).alias("n"), "at")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.select("doc_id", F.xxhash64("text").alias("key"), F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<string>").alias("items")).filter(F.lit(False))
    by_doc = scratch.keep(found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("n", "at")).alias("hits")), "hits")
    total = by_doc.agg(F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()[0]
    r = _bounded(by_doc.select(F.col("doc_id").alias("r_doc_id"), F.col("key").alias("r_key"), "hits"), total)
    texts = texts.dropDuplicates(["doc_id", "key"]) if total > SET_ROWS else texts
    hit = texts.join(r, F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("key") == F.col("r_key")))
    read = F.transform("hits", lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), F.array_join(F.slice("w", x["at"] + 1, x["n"]), " ").alias("window")))
    verified = hit.select("doc_id", "key", F.explode(read).alias("hit")).select("doc_id", "key", "hit.*").join(small(windows.select("n", "window", "items"), SET_ROWS, F.octet_length("window") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x))), ["n", "window"])
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))))
    return verified.groupBy("doc_id", "key").agg(places.alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = scratch.keep(contamination(docs, benchmark, scratch), "contamination").select(
        F.col("doc_id").alias("r_doc_id"), F.col("key").alias("r_key"), F.size("hit_words").cast("long").alias("r_hit"), F.size("items").cast("long").alias("r_items"), F.sha2(F.array_join("items", ","), 256).alias("r_sha")
    )
    counted = docs.select("doc_id", F.xxhash64("text").alias("key"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(_bounded(hits, hits.count()), F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("key") == F.col("r_key")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("r_hit", F.lit(0)).alias("n_hit"), F.coalesce("r_items", F.lit(0)).alias("n_items"),
        F.coalesce("r_sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("r_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents without any hit, columns unchanged."""
    hits = scratch.keep(contamination(docs.select("doc_id", "text"), benchmark, scratch), "contamination").select(F.col("doc_id").alias("r_doc_id"), F.col("key").alias("r_key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("l_doc_id"), F.xxhash64("text").alias("l_key"))
    kept = rows.join(_bounded(hits, hits.count()), F.col("l_doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("l_key") == F.col("r_key")), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM low),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bn, unnest(range(1, len(w) - n + 2)) AS t(i)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
hit AS (SELECT doc_id, dw.n AS n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
agg AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM hit), unnest(range(0, n)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN agg USING (doc_id) LEFT JOIN items USING (doc_id)
"""
