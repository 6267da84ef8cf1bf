"""Quality rules on documents, on DataFrame functions alone.

Two kinds of rule. *Text rules* look at one document: too few words, or too many words in
8-word windows that the document repeats. The *line rule* looks across documents: every line is
normalised and hashed, the distinct documents that hold it are counted per host (``source``), and lines
above the limit are removed as boilerplate; a document that this leaves with too little is rejected as
depleted. Documents are distinct if the hashes of all their normalised lines, in order, are: a document
copied a thousand times counts once, and so does a row that is repeated.

Defined results: a null text has no words and no lines (base_failed, not kept); a null host is a host
of its own; repeated rows get the same verdict; very long texts are taken whole; an empty table gives
an empty result; other columns are carried through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BLANK_CLASS, BLANKS, Scratch, small, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: The low bits of a packed window hold its position, the high ones its hash.
POSITION_BITS = 24


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules."""

    min_words: int = 20
    max_repeat_percent: int = 30
    #: A line in more documents of a host than this is boilerplate.
    max_documents: int = 20
    #: A document keeps at least so many words, and so many per cent of its words, or is rejected.
    min_left_words: int = 5
    min_left_percent: int = 30


def repeated_words(tokens: str) -> list[tuple[str, Column]]:
    """Steps (new column, expression) that end in ``n_repeat_words`` for the column of words named.

    Windows are hashed, packed with their position into one long and sorted, so equal ones are
    neighbours; neighbours are compared word by word, and if a hash ever misled, or the text has more
    words than a position can tell, the windows themselves are sorted instead.
    """
    last = F.size(tokens) - WINDOW
    low = (1 << POSITION_BITS) - 1

    def prefix(x: Column) -> Column:
        return F.shiftright(x, POSITION_BITS)

    def packed(i: Column) -> Column:
        window = F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])
        return window.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))

    def twin(array: str, i: Column, key) -> Column:
        here = key(F.get(array, i))
        return F.coalesce(here == key(F.get(array, i - 1)), F.lit(False)) | F.coalesce(here == key(F.get(array, i + 1)), F.lit(False))

    def at(x: Column) -> Column:
        return F.slice(tokens, x.bitwiseAND(low).cast("int") + 1, WINDOW)

    misled = F.exists(
        F.sequence(F.lit(0), F.size("_twins") - 1),
        lambda i: F.coalesce((i > 0) & (prefix(F.get("_twins", i)) == prefix(F.get("_twins", i - 1))) & (at(F.get("_twins", i)) != at(F.get("_twins", i - 1))), F.lit(False)),
    )
    exact = F.when(
        F.col("_misled"),
        F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.array_join(F.slice(tokens, i + 1, WINDOW), " ").alias("key"), i.alias("at")))),
    )
    starts = F.when(
        F.col("_misled"),
        F.transform(F.filter("_exact", lambda x, i: twin("_exact", i, lambda y: y["key"])), lambda x: x["at"].cast("int")),
    ).otherwise(F.transform("_twins", lambda x: x.bitwiseAND(low).cast("int")))
    gaps = F.transform("_starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - x, F.lit(WINDOW))).cast("long"))
    return [
        ("_hashes", F.when(last >= 0, F.transform(tokens, lambda x: F.xxhash64(x)))),
        ("_sorted", F.when(last >= 0, F.sort_array(F.transform(F.sequence(F.lit(0), last), packed)))),
        ("_twins", F.when(last >= 0, F.filter("_sorted", lambda x, i: twin("_sorted", i, prefix)))),
        ("_misled", F.when((last >= 0) & (F.size("_twins") > 0), misled | (F.size(tokens) > low)).otherwise(False)),
        ("_exact", exact),
        ("_starts", F.sort_array(starts)),
        ("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))),
    ]


def text_rules(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """The frame with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    frame = docs.withColumn("_words", words(F.col("text"))).withColumn("_lines", lines)
    for name, step in repeated_words("_words"):
        frame = frame.withColumn(name, step)
    n_words = F.size("_words").cast("long")
    return (
        frame.withColumn("n_words", n_words)
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
        .drop("_words", "_lines", "_hashes", "_sorted", "_twins", "_misled", "_exact", "_starts")
    )


def normalised_lines(text: Column) -> Column:
    """Per line its form in lower case with runs of blanks as one space and of digits as 0; empty lines stay, to keep the numbering."""
    one_space = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(F.lower(F.regexp_replace(one_space, "[0-9]+", "0")), "\n"), lambda x: F.btrim(x, F.lit(" ")))


def line_hash(line: Column) -> Column:
    """The first 60 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def _with_lines(docs: DataFrame) -> DataFrame:
    """The frame with key (of the text), host, form (of all lines) and items: position, hash and words of each line with a word."""
    line = F.transform("_norm", lambda x, i: F.struct(i.alias("at"), F.when(x != "", line_hash(x)).alias("hash"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n")))
    return (
        docs.withColumn("key", F.xxhash64("text")).withColumn("host", F.coalesce("source", F.lit(""))).withColumn("_norm", normalised_lines(F.col("text")))
        .withColumn("items", F.filter(line, lambda x: x["hash"].isNotNull()))
        .withColumn("form", line_hash(F.array_join(F.transform("items", lambda x: x["hash"].cast("string")), ",")))
        .drop("_norm")
    )


def frequent_lines(lined: DataFrame, rules: QualityRules) -> DataFrame:
    """(host, hash, n_docs) of the lines above the limit.

    A distinct document gives each of its lines once, so documents are counted without a distinct count;
    copies and counts are folded map-side, so neither a hot host nor a hot line meets in one task.
    """
    hashes = F.array_distinct(F.transform("items", lambda x: x["hash"]))
    distinct = lined.filter(F.size("items") > 0).select("host", "form", hashes.alias("hashes")).groupBy("host", "form").agg(F.first("hashes").alias("hashes"))
    counted = distinct.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n_docs"))
    return counted.filter(F.col("n_docs") > rules.max_documents)


def removals(lined: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, key, host, removed_words, removed_at) of documents with lines to remove."""
    lines = lined.select("doc_id", "key", "host", F.explode("items").alias("item")).select("doc_id", "key", "host", "item.*")
    hits = lines.join(frequent.select("host", "hash"), ["host", "hash"], "left_semi")
    return (
        hits.groupBy("doc_id", "key", "host", "at").agg(F.max("n").alias("n"))  # repeated rows once
        .groupBy("doc_id", "key", "host").agg(F.sum("n").alias("removed_words"), F.collect_list("at").alias("removed_at"))
    )


def judge(docs: DataFrame, scratch: Scratch, rules: QualityRules = QualityRules(), places: bool = False) -> DataFrame:
    """Per document doc_id, key, host, the text rules' figures, removed_words and kept; with places also r_removed_at."""
    lined = scratch.keep(_with_lines(text_rules(docs.select("doc_id", "text", "source"), rules)).drop("text", "source"), "lined")
    frequent = scratch.keep(frequent_lines(lined, rules), "frequent_lines")
    removed = scratch.keep(removals(lined, small(frequent)), "removals")
    judged = lined.drop("items", "form")
    removed = small(removed, size=4 * F.size("removed_at")) if places else small(removed.drop("removed_at"))
    r = removed.select(*[F.col(c).alias(f"r_{c}") for c in removed.columns])
    joined = judged.join(r, F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("key") == F.col("r_key")) & (F.col("host") == F.col("r_host")), "left")
    gone = F.coalesce("r_removed_words", F.lit(0))
    left = F.col("n_words") - gone
    depleted = (gone > 0) & ((left < rules.min_left_words) | (100 * left < rules.min_left_percent * F.col("n_words")))
    return joined.withColumn("removed_words", gone).withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, scratch: Scratch, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents kept, without their boilerplate lines; n_chars follows the text.

    Verdicts are written first and then joined to the rows: as a filter they would be pushed below the
    columns that they are made of, and take all those steps' expressions apart.
    """
    judged = judge(docs, scratch, rules, places=True).select("doc_id", "key", "host", "kept", F.col("r_removed_at").alias("at"))
    verdicts = scratch.keep(judged, "verdicts").filter("not kept or at is not null").dropDuplicates(["doc_id", "key", "host"])
    v = small(scratch.keep(verdicts.select(*[F.col(c).alias(f"v_{c}") for c in verdicts.columns]), "changes"), size=4 * F.size(F.coalesce("v_at", F.array().cast("array<int>"))))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("l_doc_id"), F.xxhash64("text").alias("l_key"), F.coalesce("source", F.lit("")).alias("l_host"))
    joined = rows.join(v, F.col("l_doc_id").eqNullSafe(F.col("v_doc_id")) & (F.col("l_key") == F.col("v_key")) & (F.col("l_host") == F.col("v_host")), "left").filter(F.coalesce("v_kept", F.lit(True)))
    lines = F.split(F.col("row.text"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("v_at"))
    text = F.when(F.col("v_at").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn("_text", text)
    given = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[given[c].alias(c) if c in given else F.col("row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM w, unnest(range(1, greatest(len(ws) - 6, 1))) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, unnest(range(0, 8)) AS t(k) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id)),
lines AS (SELECT doc_id, host, pos, trim(line, ' ') AS line FROM (SELECT doc_id, host, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(lower(regexp_replace(regexp_replace(text, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')), chr(10))) AS line FROM d)),
hashed AS (SELECT doc_id, host, pos, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) AS hash, length(line) - length(replace(line, ' ', '')) + 1 AS n FROM lines WHERE line <> ''),
form AS (SELECT doc_id, md5(string_agg(CAST(hash AS VARCHAR), ',' ORDER BY pos)) AS form FROM hashed GROUP BY doc_id),
freq AS (SELECT host, hash FROM hashed JOIN form USING (doc_id) GROUP BY host, hash HAVING count(DISTINCT form) > 20),
gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM hashed JOIN freq USING (host, hash) GROUP BY doc_id)
SELECT base.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(gone.n, 0) AS removed_words,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
  AND NOT (coalesce(gone.n, 0) > 0 AND (n_words - coalesce(gone.n, 0) < 5 OR 100 * (n_words - coalesce(gone.n, 0)) < 30 * n_words)) AS kept
FROM base LEFT JOIN gone USING (doc_id)
"""
