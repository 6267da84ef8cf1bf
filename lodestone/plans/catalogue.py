"""Registered queries over the driver tables, with the SQL each must equal.

Files are the documents (see ``sources.files.corpus``), chunks their lines and groups of three lines,
symbols groups of two and four lines, so that both sides build the same intervals by one rule.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import paths, text
from lodestone.models import HashEmbedder, embedded, embedding_text, rerank_document
from lodestone.operators import chunking, fusion, incremental, lexical, output, postings, topology, vectors
from lodestone.options import Options, parse
from lodestone.plans import hydrate, refresh as plan
from lodestone.plans.search import Index, search
from lodestone.session import shared_dir
from lodestone.sources import validate
from lodestone.sources.files import corpus
from lodestone.sources.store import IndexStore
from lodestone.streaming import mutations

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return register


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


CORPUS = "corpus AS (SELECT doc_id, concat('src/', coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', doc_id, '.txt') AS path, coalesce(text, '') AS text FROM documents)"
ENC = "octet_length(encode({}))"

# Vectors


def vec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vector(spark: SparkSession, d: str, i: int = 0) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").filter(F.col("vec_id") == i).select("embedding").first()[0]]


VEC = "vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {})"
COS = "list_cosine_similarity(e, q)"


@query(f"WITH {VEC.format(0)} SELECT id, round({COS}, 6) AS score FROM vec, q ORDER BY {COS} DESC, id LIMIT 20")
def vector_topk_cosine(spark, d):
    return vectors.top_cosine(vec(spark, d), query_vector(spark, d), 20).withColumn("score", F.round("score", 6))


@query(f"WITH {VEC.format(1)} SELECT id, round(list_distance(e, q), 6) AS distance FROM vec, q ORDER BY list_distance(e, q), id LIMIT 20")
def vector_topk_l2(spark, d):
    return vectors.top_l2(vec(spark, d), query_vector(spark, d, 1), 20).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {VEC.format(0)}, qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, id, list_cosine_similarity(e, qs.q) AS score FROM vec, qs),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def vector_batch_topk(spark, d):
    asked = table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.batch_top_cosine(vec(spark, d), asked, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {VEC.format(2)} SELECT id, round({COS}, 6) AS score FROM vec, q WHERE concat('src/', label, '/', id) LIKE 'src/3/%' OR label = 5 ORDER BY {COS} DESC, id LIMIT 15")
def vector_topk_path_filtered(spark, d):
    path = F.concat(F.lit("src/"), F.col("label").cast("string"), F.lit("/"), F.col("id").cast("string"))
    return vectors.top_cosine(vec(spark, d), query_vector(spark, d, 2), 15, paths.matches(path, ["src/3/", "src/5/**"])).withColumn("score", F.round("score", 6))


@query(f"""WITH {VEC.format(3)}, near AS (SELECT id, e, q FROM vec, q ORDER BY list_distance(e, q), id LIMIT 100)
SELECT id, round({COS}, 6) AS score FROM near ORDER BY {COS} DESC, id LIMIT 10""")
def vector_shortlist_rescore(spark, d):
    return vectors.shortlist_then_cosine(vec(spark, d), query_vector(spark, d, 3), 10).withColumn("score", F.round("score", 6))


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY label")
def vector_norms(spark, d):
    return vec(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(text.norm(F.col("embedding"))), 6).alias("mean_norm"))


# Tokens and statistics

CODE_SQL = r"""runs AS (SELECT page_id, unnest(regexp_extract_all(url, '[A-Za-z0-9_]+(?:[./-][A-Za-z0-9_]+)*')) AS run FROM pages),
pieces AS (SELECT page_id, run, list_filter(regexp_split_to_array(lower(run), '[/.]+'), lambda p: p <> '') AS ps,
 list_filter(regexp_split_to_array(lower(regexp_replace(run, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[_./\s-]+'), lambda p: p <> '') AS parts FROM runs),
tokens AS (SELECT page_id, lower(run) AS term FROM pieces
 UNION ALL SELECT page_id, array_to_string(ps[i:], '.') FROM pieces, unnest(range(2, len(ps) + 1)) AS t(i)
 UNION ALL SELECT page_id, unnest(parts) FROM pieces
 UNION ALL SELECT page_id, array_to_string(parts, '') FROM pieces WHERE len(parts) > 1),
tf AS (SELECT page_id, term, count(*) AS tf FROM tokens GROUP BY page_id, term)"""


def page_tf(spark, d) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("page_id").alias("path"), "url")
    return lexical.term_frequencies(pages, text.code_tokens(F.col("url")))


@query(f"WITH {CODE_SQL} SELECT page_id, term, tf FROM tf")
def code_token_tf(spark, d):
    return page_tf(spark, d).withColumnRenamed("path", "page_id")


@query(f"WITH {CODE_SQL} SELECT term, count(*) AS df FROM tf GROUP BY term")
def code_token_df(spark, d):
    return lexical.document_frequencies(page_tf(spark, d))


TOK = rf"tok AS (SELECT path, text, regexp_extract_all(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), '[\p{{L}}\p{{N}}]+') AS t FROM corpus)"


@query(f"WITH {CORPUS}, {TOK} SELECT count(*) AS document_count, round(avg(len(t)), 6) AS average_length FROM tok")
def corpus_stats(spark, d):
    return lexical.corpus_statistics(corpus(spark, d), text.word_tokens(F.col("text"))).withColumn("average_length", F.round("average_length", 6))


@query(f"WITH {CODE_SQL}, now AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN concat(term, 'x') ELSE term END AS term FROM tf) SELECT term, count(*) AS df FROM now GROUP BY term")
def incremental_df(spark, d):
    tf = page_tf(spark, d)
    maps = tf.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tf"))
    changed = maps.filter("path % 10 = 0").select("path", F.transform_keys("tf", lambda k, v: F.concat(k, F.lit("x"))).alias("tf"))
    return lexical.merged_document_frequencies(maps, changed)


# BM25


def bm25_sql(counts: list[str], holds: str, tail: str, extra: str = "") -> str:
    """The score of phrases, given as SQL for their frequencies in the token list t."""
    n = range(len(counts))
    idf = "CASE WHEN ln((n - df{0} + 0.5) / (df{0} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{0} + 0.5) / (df{0} + 0.5)) END"
    terms = " + ".join(f"({idf.format(i)}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in n)
    return f"""WITH {CORPUS}, {TOK}, c AS (SELECT path, len(t) AS size, {', '.join(f'CAST({x} AS DOUBLE) AS tf{i}' for i, x in enumerate(counts))} FROM tok),
s AS (SELECT count(*) AS n, avg(size) AS mean, {', '.join(f'sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}' for i in n)} FROM c),
bm AS (SELECT path, {terms} AS score FROM c, s WHERE {holds}){extra} {tail}"""


def term_sql(term: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{term}'))"


STORED: dict[tuple[str, str], str] = {}


def stored_postings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(postings, documents) of the documents' texts, written once a session."""
    at = STORED.setdefault((spark.sparkContext.applicationId, d), f"{shared_dir(spark)}/catalogue/{uuid.uuid4().hex}")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/documents/_SUCCESS")):
        posted, docs = postings.build(corpus(spark, d).select(F.col("doc_id").cast("string").alias("id"), "path", "text"))
        posted.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{at}/postings")
        docs.write.mode("overwrite").parquet(f"{at}/documents")
    return spark.read.schema(f"{postings.POSTINGS}, bucket int").parquet(f"{at}/postings"), spark.read.schema(postings.DOCS).parquet(f"{at}/documents")


def stored_search(spark: SparkSession, d: str, query: str, k: int, where: Column | None = None) -> DataFrame:
    """(path, score) by the stored postings, ties by path."""
    posted, docs = stored_postings(spark, d)
    found = postings.bm25(posted, docs, lexical.parse_or_fallback(query))
    return rounded((found if where is None else found.filter(where)).orderBy(F.desc("score"), "path").limit(k).select("path", "score"))


@query(f"WITH {CORPUS}, {TOK}, o AS (SELECT path, unnest(t) AS term FROM tok) SELECT term, count(DISTINCT path) AS df, count(*) AS n FROM o GROUP BY term")
def lexical_index(spark, d):
    """Each stored term with its documents and occurrences."""
    return stored_postings(spark, d)[0].groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("n"))


TOP50 = "SELECT path, round(score, 6) AS score FROM bm ORDER BY score DESC, path LIMIT 50"


def rounded(frame: DataFrame) -> DataFrame:
    return frame.withColumn("score", F.round("score", 6))


@query(bm25_sql([term_sql("der"), term_sql("heed"), term_sql("queos")], "tf0 > 0 OR tf1 > 0 OR tf2 > 0", TOP50))
def bm25_or(spark, d):
    return stored_search(spark, d, "der OR heed OR queos", 50)


@query(bm25_sql([term_sql("with"), term_sql("that")], "tf0 > 0 AND tf1 > 0", TOP50))
def bm25_and(spark, d):
    return stored_search(spark, d, "with that", 50)


@query(bm25_sql([term_sql("with"), term_sql("scum")], "tf0 > 0 AND NOT tf1 > 0", TOP50))
def bm25_not(spark, d):
    return stored_search(spark, d, "with NOT scum", 50)


@query(bm25_sql(["len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the'))"], "tf0 > 0", TOP50))
def bm25_phrase(spark, d):
    return stored_search(spark, d, '"of the"', 50)


@query(bm25_sql(["len(list_filter(t, lambda x: starts_with(x, 'wit')))"], "tf0 > 0", TOP50))
def bm25_prefix(spark, d):
    return stored_search(spark, d, "wit*", 50)


@query(bm25_sql([term_sql("der"), term_sql("heed")], "tf0 > 0 OR tf1 > 0", TOP50))
def bm25_fallback(spark, d):
    return stored_search(spark, d, "der heed?", 50)


@query(bm25_sql([term_sql("der"), term_sql("queos")], "tf0 > 0 OR tf1 > 0", TOP50))
def bm25_scan(spark, d):
    """The same without an index, over texts."""
    return rounded(lexical.search(corpus(spark, d), "der OR queos", 50))


@query(bm25_sql([term_sql("der"), term_sql("with")], "tf0 > 0 OR tf1 > 0", "SELECT path, round(score, 6) AS score FROM bm WHERE path LIKE 'src/src1/%' OR (path LIKE 'src/src2/%' AND regexp_matches(path, '^src/src2/(?:[^/]+/)*[^/]*7\\.txt$')) ORDER BY score DESC, path LIMIT 50"))
def bm25_path_filtered(spark, d):
    return stored_search(spark, d, "der OR with", 50, paths.matches(F.col("path"), ["src/src1/", "src/src2/**/*7.txt"]))


# Fusion


def lists(spark, d) -> tuple[DataFrame, DataFrame]:
    near = vectors.top_cosine(vec(spark, d), query_vector(spark, d), 40)
    found = postings.bm25(*stored_postings(spark, d), lexical.parse("der OR heed OR with")).select(F.col("id").cast("long").alias("id"), "score")
    return near, found.orderBy(F.desc("score"), "id").limit(40)


LISTS = bm25_sql([term_sql("der"), term_sql("heed"), term_sql("with")], "tf0 > 0 OR tf1 > 0 OR tf2 > 0", "{}", f""", ids AS (SELECT doc_id AS id, score FROM bm JOIN corpus USING (path) ORDER BY score DESC, doc_id LIMIT 40),
{VEC.format(0)}, near AS (SELECT id, {COS} AS score FROM vec, q ORDER BY {COS} DESC, id LIMIT 40),
v AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM near), l AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ids)""")
FUSED = "SELECT id, sum(s) AS score FROM (SELECT id, 2.0 / (60 + rank) AS s FROM v UNION ALL SELECT id, 1.0 / (60 + rank) FROM l) GROUP BY id ORDER BY score DESC, id LIMIT 25"


@query(LISTS.replace("{}", f"SELECT id, round(score, 6) AS score FROM ({FUSED})"))
def rrf_fusion(spark, d):
    near, words = lists(spark, d)
    return rounded(fusion.reciprocal_rank_fusion([(fusion.ranked(near), 2.0), (fusion.ranked(words), 1.0)], 60, 25))


@query(LISTS.replace("{}", """SELECT id, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + l.rank), 0), 6) AS score, 'hybrid' AS mode, v.rank AS vector_rank, l.rank AS bm25_rank, round(l.score, 6) AS bm25_score
FROM v FULL JOIN l USING (id) ORDER BY coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + l.rank), 0) DESC, id LIMIT 25"""))
def rrf_detail(spark, d):
    fused = fusion.fuse(*lists(spark, d), 60, 25)
    return rounded(fused).withColumn("bm25_score", F.round("bm25_score", 6)).withColumn("vector_rank", F.col("vector_rank").cast("long")).withColumn("bm25_rank", F.col("bm25_rank").cast("long"))


@query(f"WITH {VEC.format(0)} SELECT id, round({COS}, 6) AS score, 'vector' AS mode FROM vec, q ORDER BY {COS} DESC, id LIMIT 25")
def vector_only_fallback(spark, d):
    near, words = lists(spark, d)
    return rounded(fusion.fuse(near, words.filter(F.lit(False)), 60, 25).select("id", "score", "mode"))


@query(f"""WITH {VEC.format(0)}, q2 AS (SELECT embedding::DOUBLE[] AS q2 FROM embeddings WHERE vec_id = 7),
a AS (SELECT id, {COS} AS score FROM vec, q ORDER BY {COS} DESC, id LIMIT 30), b AS (SELECT id, list_cosine_similarity(e, q2) AS score FROM vec, q2 ORDER BY list_cosine_similarity(e, q2) DESC, id LIMIT 30)
SELECT id, round(max(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def hyde_max_merge(spark, d):
    v = vec(spark, d)
    return rounded(fusion.merge_best(vectors.top_cosine(v, query_vector(spark, d), 30), vectors.top_cosine(v, query_vector(spark, d, 7), 30)))


@query("""WITH s AS (SELECT a.vec_id AS query_id, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS best FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id)
SELECT query_id, round(best, 6) AS best, best < 0.35 AS expand FROM s""")
def hyde_trigger(spark, d):
    asked = table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    best = vectors.batch_top_cosine(vec(spark, d), asked, 2).filter("id <> query_id").groupBy("query_id").agg(F.max("score").alias("best"))
    return best.select("query_id", F.round("best", 6).alias("best"), fusion.expansion_wanted(F.col("best"), 0.35).alias("expand"))


RERANK = f"""WITH {VEC.format(0)}, c AS (SELECT id, {COS} AS score FROM vec, q ORDER BY {COS} DESC, id LIMIT 20), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM c),
r AS (SELECT rank - 1 AS i, (rank * 7) % 20 AS position, rank / 100.0 AS relevance FROM k WHERE rank % 2 = 1),
o AS (SELECT id, coalesce(relevance, score) AS final_score, position, relevance, rank FROM k LEFT JOIN r ON i = rank - 1)"""


@query(RERANK + " SELECT id, round(final_score, 6) AS final_score, row_number() OVER (ORDER BY position NULLS LAST, rank) AS final_rank, round(relevance, 6) AS rerank_score FROM o")
def rerank_apply(spark, d):
    k = fusion.ranked(vectors.top_cosine(vec(spark, d), query_vector(spark, d), 20))
    response = k.filter("rank % 2 = 1").select(((F.col("rank") * 7) % 20).alias("position"), (F.col("rank") - 1).alias("index"), (F.col("rank") / 100.0).alias("relevance"))
    again = response.select(F.col("position") + 100, "index", F.lit(9.0))  # a second mention, which doesn't count
    out = fusion.rerank(k, response.union(again))
    return out.select("id", F.round("final_score", 6).alias("final_score"), F.col("final_rank").cast("long").alias("final_rank"), F.round("rerank_score", 6).alias("rerank_score"))


@query(f"WITH {VEC.format(5)}, c AS (SELECT id, {COS} AS score FROM vec, q ORDER BY {COS} DESC, id LIMIT 30) SELECT id, round(score, 6) AS score FROM c WHERE score >= 0.2")
def topk_then_threshold(spark, d):
    return rounded(fusion.top_then_threshold(vectors.top_cosine(vec(spark, d), query_vector(spark, d, 5), 1000), 30, 0.2))


@query(f"WITH {VEC.format(5)}, c AS (SELECT id, {COS} AS score FROM vec, q ORDER BY {COS} DESC, id LIMIT 30) SELECT count(*) AS candidates, count(*) FILTER (score < 0.2) AS filtered, round(max(score), 6) AS best FROM c")
def search_status_metrics(spark, d):
    c = vectors.top_cosine(vec(spark, d), query_vector(spark, d, 5), 30)
    return fusion.status_counts(c, 0.2).select("candidates", "filtered", F.round("best", 6).alias("best"))


# Paths and files


def docs_source(spark: SparkSession, d: str, max_bytes: int, edited: bool = False) -> plan.Table:
    """The documents as a source; edited: every tenth is gone, every tenth has more text, every tenth is touched."""
    rows = corpus(spark, d).withColumn("mtime", F.lit(1000.0))
    if edited:
        kind = F.pmod("doc_id", F.lit(10))
        rows = rows.filter(kind != 0).withColumn("text", F.when(kind == 1, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))).withColumn("mtime", F.when(kind == 2, 2000.0).otherwise(F.col("mtime")))
    return plan.Table("documents", rows, docs_options(max_bytes))


def docs_options(max_bytes: int) -> Options:
    return parse({"maxFileBytes": max_bytes, "maxChunkNonWhitespaceChars": 200}, {})


def path_rows(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path")).unionByName(corpus(spark, d).select((-F.col("doc_id") - 1).alias("page_id"), "path"))


PATHS = rf"WITH {CORPUS}, p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages UNION ALL SELECT -doc_id - 1, path FROM corpus)"


def path_query(name: str, filters: list[str], where: str) -> None:
    def run(spark, d):
        return path_rows(spark, d).filter(paths.matches(F.col("path"), filters))

    run.__name__ = name
    query(f"{PATHS} SELECT page_id, path FROM p WHERE {where}")(run)


path_query("path_prefix", ["src/src1", "src/src2/en/"], "starts_with(path, 'src/src1/') OR starts_with(path, 'src/src2/en/') OR path IN ('src/src1', 'src/src2/en', 'src/src2/en/')")
path_query("path_glob", ["src/*/[ef]?/*1.txt"], "regexp_matches(path, '^src/[^/]+/[ef][^/]/[^/]*1\\.txt$')")
path_query("path_mixed_or", ["src/src3/", "**/*{7,8}.txt"], "starts_with(path, 'src/src3/') OR regexp_matches(path, '^(?:[^/]+/)*[^/]*(?:7|8)\\.txt$')")


@query(f"{PATHS} SELECT page_id, path FROM p WHERE regexp_matches(path, '^src/.*$') AND NOT regexp_matches(path, '^(?:[^/]+/)*[^/]*5\\.txt$') AND NOT regexp_matches(path, '^src/src4/.*$')")
def scan_include_exclude(spark, d):
    return path_rows(spark, d).filter(paths.scanned(F.col("path"), ["src/**"], ["**/*5.txt", "src/src4/**"]))


@query(f"{PATHS}, n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('node_modules/', path) WHEN 1 THEN concat('a/build/', path) ELSE path END AS path FROM p) SELECT page_id, path FROM n WHERE NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'dist', 'build', '.cache'])")
def ignored_dirs(spark, d):
    moved = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("node_modules/"), "path")).when(F.col("page_id") % 5 == 1, F.concat(F.lit("a/build/"), "path")).otherwise(F.col("path"))
    return path_rows(spark, d).select("page_id", moved.alias("path")).filter(~paths.in_ignored_directory(F.col("path")))


@query(f"{PATHS} SELECT page_id, path FROM p WHERE NOT (regexp_matches(path, '(^|/)[^/]*3\\.txt($|/)') AND NOT regexp_matches(path, '(^|/)[^/]*13\\.txt($|/)')) AND NOT starts_with(path, 'src/src6/fr/')")
def gitignore_rules(spark, d):
    rules = [paths.IgnoreFile("", ("# comment", "*3.txt", "!*13.txt", "")), paths.IgnoreFile("src/src6", ("/fr/",))]
    return path_rows(spark, d).filter(~paths.ignored(F.col("path"), rules))


@query(f"WITH {CORPUS} SELECT path, sha256(text) AS fingerprint, {ENC.format('text')} AS size FROM corpus")
def fingerprint_sha256(spark, d):
    return corpus(spark, d).select("path", F.sha2(F.encode("text", "UTF-8"), 256).alias("fingerprint"), F.octet_length("text").cast("long").alias("size"))


@query(f"WITH {CORPUS} SELECT path, CASE WHEN {ENC.format('text')} > 4096 THEN 'file_too_large' ELSE 'ok' END AS verdict FROM corpus")
def size_skip(spark, d):
    source = docs_source(spark, d, 4096)
    files, skipped = source.read(source.manifest())
    return skipped.select("path", F.col("code").alias("verdict")).unionByName(files.select("path", F.lit("ok").alias("verdict")))


@query(f"""WITH {CORPUS}, b AS (SELECT path, CASE doc_id % 4 WHEN 0 THEN concat(repeat(chr(1), CAST(doc_id % 50 AS INT)), text) WHEN 1 THEN replace(text, ' ', chr(5)) ELSE text END AS t FROM corpus)
SELECT path, len(regexp_extract_all(t, '[\\x01-\\x07\\x0B\\x0E-\\x1F]')) > 0.3 * least({ENC.format('t')}, 16384) AND {ENC.format('t')} > 0 AS is_binary FROM b""")
def binary_sniff(spark, d):
    """Control bytes of whole texts, as the SQL counts them; ``text.binary_looking``, for files, takes the first 16 KiB alone."""
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.repeat(F.lit("\x01"), (F.col("doc_id") % 50).cast("int")), "text")).when(F.col("doc_id") % 4 == 1, F.replace("text", F.lit(" "), F.lit("\x05"))).otherwise(F.col("text"))
    return corpus(spark, d).select("path", text.many_controls(F.encode(t, "UTF-8")).alias("is_binary"))


@query(f"""WITH {CORPUS}, p AS (SELECT doc_id, concat('a/', doc_id, list_extract(['.py', '.TS', '.go', '.txt', '/.bashrc', '.php5', '.JSX'], CAST(doc_id % 7 AS INT) + 1)) AS path FROM corpus)
SELECT path, list_extract(['python', 'typescript', 'go', 'text', 'bash', 'php', 'javascript'], CAST(doc_id % 7 AS INT) + 1) AS language FROM p""")
def language_detect(spark, d):
    tail = F.element_at(F.lit([".py", ".TS", ".go", ".txt", "/.bashrc", ".php5", ".JSX"]), (F.col("doc_id") % 7).cast("int") + 1)
    p = corpus(spark, d).select(F.concat(F.lit("a/"), F.col("doc_id").cast("string"), tail).alias("path"))
    return p.select("path", paths.language_of(F.col("path")).alias("language"))


# Lines, chunks and topology

LINES = f"""ls AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM corpus),
lines AS (SELECT path, line, n, CAST(coalesce(sum({ENC.format('line')} + 1) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM ls),
spans AS (SELECT path, line, n, s, s + {ENC.format('line')} AS e FROM lines)"""
GROUPED = "(SELECT path, (n - 1) // {0} AS g, min(s) AS s, max(e) AS e, min(n) AS a, max(n) AS b, arg_min(line, n) AS line FROM spans GROUP BY path, (n - 1) // {0} HAVING max(e) > min(s))"
CHUNKS = f"""{CORPUS}, {LINES}, chunks AS (SELECT concat('block:', path, ':', s, ':', e) AS id, path, 'block' AS kind, s, e, n AS a, n AS b, line FROM spans WHERE line <> ''
UNION ALL SELECT concat('class:', path, ':', s, ':', e), path, 'class', s, e, a, b, line FROM {GROUPED.format(3)}),
symbols AS (SELECT concat(path, ':class:C', g, ':', s, ':', e) AS sid, path, 'class' AS kind, concat('C', g) AS name, s, e FROM {GROUPED.format(4)}
UNION ALL SELECT concat(path, ':function:f', g, ':', s, ':', e), path, 'function', concat('f', g), s, e FROM {GROUPED.format(2)}),
cs AS (SELECT c.id, c.path, c.s, c.e, y.sid, y.kind, y.name, y.s AS ys, y.e AS ye FROM chunks c JOIN symbols y ON c.path = y.path AND y.s <= c.s AND c.e <= y.e),
pairs AS (SELECT c.id, p.id AS pid, row_number() OVER (PARTITION BY c.id ORDER BY p.s DESC, p.e, p.id DESC) AS r FROM chunks c JOIN chunks p ON c.path = p.path AND p.s <= c.s AND c.e <= p.e AND (p.s < c.s OR c.e < p.e)),
parent AS (SELECT chunks.id, pid FROM chunks LEFT JOIN (SELECT * FROM pairs WHERE r = 1) USING (id)),
inner_symbol AS (SELECT id, sid FROM (SELECT id, sid, row_number() OVER (PARTITION BY id ORDER BY ys DESC, ye, sid DESC) AS r FROM cs) WHERE r = 1),
sib AS (SELECT chunks.id, lag(chunks.id) OVER w AS prev, lead(chunks.id) OVER w AS next FROM chunks JOIN parent USING (id) LEFT JOIN inner_symbol USING (id) WINDOW w AS (PARTITION BY path, pid, sid ORDER BY s, e, chunks.id))"""
LABELS = """, local AS (SELECT id, kind, name FROM (SELECT cs.id, cs.kind, cs.name, row_number() OVER (PARTITION BY cs.id ORDER BY ys DESC, ye, sid DESC) AS r FROM cs WHERE ys >= s AND ys <= e) WHERE r = 1),
around AS (SELECT id, kind, name FROM (SELECT id, kind, name, row_number() OVER (PARTITION BY id ORDER BY ys DESC, ye, sid DESC) AS r FROM cs) WHERE r = 1),
fl AS (SELECT id, trim(regexp_replace(trim(line, ' ' || chr(9) || chr(13)), '^[,;]+', ''), ' ' || chr(9) || chr(13)) AS f FROM chunks),
cut AS (SELECT id, CASE WHEN f = '' THEN NULL WHEN length(f) > 80 THEN concat(left(f, 77), '...') ELSE f END AS f FROM fl),
labels AS (SELECT chunks.id, CASE WHEN local.name IS NOT NULL THEN concat(local.kind, ' ', local.name) WHEN f IS NOT NULL THEN concat(chunks.kind, ' ', CASE WHEN starts_with(f, chunks.kind || ' ') THEN substr(f, length(chunks.kind) + 2) ELSE f END)
 WHEN around.name IS NOT NULL THEN concat(around.kind, ' ', around.name) ELSE concat(chunks.kind, ' chunk') END AS label, concat(path, ':', a, CASE WHEN a = b THEN '' ELSE concat('-', b) END) AS range_label
 FROM chunks LEFT JOIN local USING (id) LEFT JOIN around USING (id) JOIN cut USING (id))"""


def line_spans(spark, d) -> DataFrame:
    return chunking.line_groups(corpus(spark, d), (1,)).select("path", F.col("line_start").alias("n"), F.col("text").alias("line"), "byte_start", "byte_end")


def _ids(kind: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), "path", F.lit(":"), F.col("byte_start").cast("string"), F.lit(":"), F.col("byte_end").cast("string"))


def line_chunks(spark, d) -> DataFrame:
    kind = F.when(F.col("size") == 1, "block").otherwise("class")
    groups = chunking.line_groups(corpus(spark, d), (1, 3)).filter("byte_end > byte_start")
    own = F.when(F.col("size") == 1, _ids("block")).otherwise(_ids("class"))
    return groups.select(own.alias("id"), kind.alias("kind"), "path", "byte_start", "byte_end", "line_start", "line_end", "text", F.lit("text").alias("language"))


def line_symbols(spark, d) -> DataFrame:
    kind, letter = (F.when(F.col("size") == 4, a).otherwise(b) for a, b in (("class", "function"), ("C", "f")))
    name = F.concat(letter, F.floor((F.col("line_start") - 1) / F.col("size")).cast("string"))
    own = F.concat("path", F.lit(":"), kind, F.lit(":"), name, F.lit(":"), F.col("byte_start").cast("string"), F.lit(":"), F.col("byte_end").cast("string"))
    groups = chunking.line_groups(corpus(spark, d), (4, 2), texts=False).filter("byte_end > byte_start")
    return groups.select(own.alias("id"), "path", kind.alias("kind"), name.alias("name"), "byte_start", "byte_end")


@query(f"WITH {CORPUS}, {LINES} SELECT path, n, s AS byte_start, e AS byte_end, length(regexp_replace(line, '{text.WHITE_SPACE}', '', 'g')) AS non_white FROM spans")
def line_ranges(spark, d):
    return chunking.line_index(corpus(spark, d))


@query(f"WITH {CORPUS}, {LINES} SELECT path, n, md5(line) AS slice FROM spans")
def byte_slice(spark, d):
    rows = line_spans(spark, d).join(corpus(spark, d).select("path", "text"), "path")
    return rows.select("path", F.col("n").cast("long").alias("n"), F.md5(F.encode(text.byte_slice(F.col("text"), F.col("byte_start"), F.col("byte_end")), "UTF-8")).alias("slice"))


@query(f"""WITH {CORPUS}, {LINES}, t AS (SELECT path, n, s, e, line, lead(line) OVER (PARTITION BY path ORDER BY n) IS NOT NULL AS more FROM spans) SELECT path, n, n AS line_end FROM t""")
def line_of_offset(spark, d):
    rows = line_spans(spark, d).join(corpus(spark, d).select("path", "text"), "path")
    start = text.line_start(text.byte_slice(F.col("text"), F.lit(0), F.col("byte_start")))
    part = text.byte_slice(F.col("text"), F.col("byte_start"), F.least(F.col("byte_end") + 1, F.octet_length("text")))
    return rows.select("path", start.cast("long").alias("n"), text.line_end(start, part).cast("long").alias("line_end"))


@query(f"WITH {CHUNKS} SELECT chunks.id, coalesce(string_agg(sid, '|' ORDER BY ys, ye DESC, sid), '') AS symbol_ids FROM chunks LEFT JOIN cs USING (id) GROUP BY chunks.id")
def chunk_symbols(spark, d):
    found = topology.chunk_symbols(line_chunks(spark, d), line_symbols(spark, d))
    return found.select("id", F.array_join("symbol_ids", "|").alias("symbol_ids"))


@query(f"WITH {CHUNKS} SELECT chunks.id, coalesce(string_agg(cs.kind || ' ' || name, ' > ' ORDER BY ys, ye DESC, sid), '') AS breadcrumbs FROM chunks LEFT JOIN cs USING (id) GROUP BY chunks.id")
def breadcrumbs(spark, d):
    found = topology.chunk_symbols(line_chunks(spark, d), line_symbols(spark, d))
    return found.select("id", F.array_join("breadcrumbs", " > ").alias("breadcrumbs"))


@query(f"WITH {CHUNKS} SELECT id, pid AS parent_id FROM parent")
def chunk_parent(spark, d):
    return topology.chunk_parents(line_chunks(spark, d))


@query(f"WITH {CHUNKS} SELECT pid AS id, string_agg(chunks.id, '|' ORDER BY s, e DESC, chunks.id) AS child_ids FROM parent JOIN chunks USING (id) WHERE pid IS NOT NULL GROUP BY pid")
def chunk_children(spark, d):
    found = topology.relations(line_chunks(spark, d), None, ["child_ids"])
    return found.filter(F.size("child_ids") > 0).select("id", F.array_join("child_ids", "|").alias("child_ids"))


@query(f"WITH {CHUNKS}, k AS (SELECT pid AS id, chunks.id AS c, row_number() OVER (PARTITION BY pid ORDER BY s, e DESC, chunks.id) AS r, count(*) OVER (PARTITION BY pid) AS total FROM parent JOIN chunks USING (id) WHERE pid IS NOT NULL) SELECT id, string_agg(c, '|' ORDER BY r) AS page, any_value(total) AS total, any_value(total) > 3 AS has_more FROM k WHERE r BETWEEN 2 AND 3 GROUP BY id")
def children_page(spark, d):
    page = topology.child_page(topology.relations(line_chunks(spark, d), None, ["child_ids"]), 1, 2)
    return page.filter(F.size("page") > 0).withColumn("page", F.array_join("page", "|"))


@query(f"WITH {CHUNKS} SELECT id, prev AS previous_id, next AS next_id FROM sib")
def chunk_siblings(spark, d):
    return topology.relations(line_chunks(spark, d), line_symbols(spark, d), ["previous_id", "next_id"])


@query(f"WITH {CHUNKS}{LABELS} SELECT id, label, range_label FROM labels")
def chunk_labels(spark, d):
    found = topology.relations(line_chunks(spark, d), line_symbols(spark, d), ["label"], ["path", "line_start", "line_end"])
    return found.select("id", "label", topology.range_label().alias("range_label"))


@query(f"""WITH {CHUNKS}{LABELS}, kids AS (SELECT pid AS id, string_agg(label, '|' ORDER BY s, e DESC, chunks.id) AS child_labels FROM parent JOIN chunks USING (id) JOIN labels USING (id) WHERE pid IS NOT NULL GROUP BY pid)
SELECT l.id, l.label, p.label AS parent_label, a.label AS previous_label, b.label AS next_label, coalesce(child_labels, '') AS child_labels
FROM labels l JOIN parent USING (id) JOIN sib USING (id) LEFT JOIN labels p ON p.id = pid LEFT JOIN labels a ON a.id = prev LEFT JOIN labels b ON b.id = next LEFT JOIN kids ON kids.id = l.id""")
def topology_summary(spark, d):
    s = topology.summaries(line_chunks(spark, d), line_symbols(spark, d))
    return s.select("id", "label", "parent_label", "previous_label", "next_label", F.array_join("child_labels", "|").alias("child_labels"))


OUTER = "outermost AS (SELECT id, kind, name, ys, ye FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ys, ye DESC, sid) AS r FROM cs) WHERE r = 1)"
CONTEXT = f"""{CHUNKS}, {OUTER}, whole AS (SELECT o.id, o.kind, o.name, ys, ye, string_agg(x.line, chr(10) ORDER BY n) AS w FROM outermost o JOIN chunks c USING (id) JOIN spans x ON x.path = c.path AND x.s >= ys AND x.e <= ye GROUP BY o.id, o.kind, o.name, ys, ye)"""


@query(f"""WITH {CONTEXT} SELECT c.id, md5(CASE WHEN w IS NULL THEN NULL WHEN length(w) <= 400 THEN w ELSE left(concat(whole.kind, ' ', name, chr(10), regexp_replace(line, '[ \\t\\r\\n]+$', '')), 400) END) AS parent_text, ys AS parent_start, ye AS parent_end FROM chunks c LEFT JOIN whole ON whole.id = c.id""")
def parent_context(spark, d):
    found = topology.parent_context(line_chunks(spark, d), line_symbols(spark, d), corpus(spark, d), 400)
    return found.select("id", F.md5(F.encode("parent_text", "UTF-8")).alias("parent_text"), "parent_start", "parent_end")


@query(f"WITH {CHUNKS}, {OUTER}, r AS (SELECT id, ys, ye, row_number() OVER (PARTITION BY path, ys, ye ORDER BY s, e, id) AS k FROM chunks c JOIN outermost USING (id)) SELECT id, CASE WHEN k = 1 THEN ys END AS parent_start, CASE WHEN k = 1 THEN ye END AS parent_end FROM r")
def parent_dedup(spark, d):
    chunks, symbols = line_chunks(spark, d), line_symbols(spark, d)
    outer = topology.chunk_symbols(chunks, symbols).filter(F.size("symbols") > 0).select("id", F.get("symbols", F.lit(0)).alias("o"))
    rows = chunks.join(outer, "id").select("id", "path", F.struct("byte_start", "byte_end", "id").alias("rank"), F.col("o.start").alias("parent_start"), (-F.col("o.minus_end")).alias("parent_end"))
    return topology.without_repeated_parents(rows).select("id", "parent_start", "parent_end")


@query(f"""WITH {CHUNKS}, asked AS (SELECT id, s FROM chunks WHERE kind = 'class'), n AS (SELECT id AS near, 0 AS later FROM asked UNION ALL SELECT pid, 1 FROM asked JOIN parent USING (id)
UNION ALL SELECT parent.id, 1 FROM parent JOIN asked ON pid = asked.id UNION ALL SELECT prev, 1 FROM asked JOIN sib USING (id) UNION ALL SELECT next, 1 FROM asked JOIN sib USING (id))
SELECT near AS id, CAST(min(later) AS INT) AS later FROM n WHERE near IS NOT NULL GROUP BY near""")
def hydrate_neighbours(spark, d):
    """The chunks asked for and those around them, each once."""
    related = topology.relations(line_chunks(spark, d), line_symbols(spark, d), ["parent_id", "child_ids", "previous_id", "next_id"], ["kind", "byte_start"])
    asked = related.filter("kind = 'class'").withColumn("pos", F.col("byte_start"))
    return hydrate.expanded(asked).select("id", F.col("place.later").alias("later"))


@query(f"WITH {CHUNKS}, l AS (SELECT id, s, e, lag(s) OVER w AS ps, lead(e) OVER w AS ne FROM chunks WHERE kind = 'block' WINDOW w AS (PARTITION BY path ORDER BY s)) SELECT id, coalesce(ps, s) AS wide_start, coalesce(ne, e) AS wide_end FROM l")
def overlap_windows(spark, d):
    wide = chunking.widened_lines(corpus(spark, d), 1)
    return wide.select(_ids("block").alias("id"), "wide_start", "wide_end")


@query(f"WITH {CORPUS}, {LINES}, t AS (SELECT path, n, list_transform(string_split(line, ' ')[1:3], lambda x: lower(x)) AS ts FROM spans) SELECT path, n, CASE WHEN len(list_filter(ts, lambda x: contains(x, 'th'))) > 0 THEN 'class' WHEN len(list_filter(ts, lambda x: contains(x, 'er'))) > 0 THEN 'method' WHEN len(list_filter(ts, lambda x: contains(x, 'de'))) > 0 THEN 'function' ELSE 'block' END AS kind FROM t")
def chunk_kind(spark, d):
    ts = F.transform(F.slice(F.split("line", " "), 1, 3), lambda x: F.lower(x))
    types = F.transform(ts, lambda x: F.concat_ws("_", F.lit("node"), F.when(x.contains("th"), "class"), F.when(x.contains("er"), "method"), F.when(x.contains("de"), "function")))
    rows = line_spans(spark, d).select(F.concat_ws("#", F.col("n").cast("string"), "path").alias("id"), types.alias("node_types"))
    return chunking.kinds(rows).select(F.substring_index("id", "#", 1).cast("long").alias("n"), F.expr("substr(id, instr(id, '#') + 1)").alias("path"), "kind")


# Chunkers and models: sequential or learned, so without SQL unless their results can be put together in SQL


@query(f"WITH {CORPUS} SELECT path, md5(text) AS text_md5, true AS within, true AS packed, true AS at_lines FROM corpus WHERE text <> ''")
def fallback_chunks(spark, d):
    """Line chunks: together they give the text, keep to the budget, take all that fits, and end at lines unless a line is too long."""
    chunks = chunking.chunk_files(corpus(spark, d), budget=200)
    order = Window.partitionBy("path").orderBy("ordinal")
    next_line = F.lead(text.non_white_space(F.regexp_extract("text", r"^[^\n]*\n?", 0))).over(order)
    checked = chunks.withColumn("next", next_line)
    joined = checked.groupBy("path").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "").alias("t"), F.every(F.col("non_white") <= 200).alias("within"),
        F.every(F.coalesce(F.col("non_white") + F.col("next") > 200, F.lit(True))).alias("packed"), F.every(F.col("text").endswith("\n") | F.col("next").isNull() | (F.col("non_white") == 200)).alias("at_lines"),
    )
    return joined.select("path", F.md5(F.encode("t", "UTF-8")).alias("text_md5"), "within", "packed", "at_lines")


def pages_as_files(spark, d) -> DataFrame:
    return table(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("language"), F.coalesce("html", F.lit("")).alias("text"))


@query(f"SELECT concat('pages/', page_id, '.html') AS path, CAST(length(regexp_replace(html, '{text.WHITE_SPACE}', '', 'g')) AS BIGINT) AS non_white, true AS within, true AS in_order FROM pages WHERE html <> ''")
def structural_chunks_html(spark, d):
    """Structural chunks of pages: all that isn't white is in one chunk, within the budget, and chunks don't overlap."""
    chunks = chunking.chunk_files(pages_as_files(spark, d).filter("text <> ''"), budget=200)
    before = F.lag("byte_end").over(Window.partitionBy("path").orderBy("ordinal"))
    checked = chunks.withColumn("after", F.coalesce(F.col("byte_start") >= before, F.lit(True)))
    return checked.groupBy("path").agg(F.sum("non_white").alias("non_white"), F.every(F.col("non_white") <= 200).alias("within"), F.every("after").alias("in_order"))


@query(f"""WITH {CORPUS}, {LINES}, m AS (SELECT path, concat('m', regexp_replace(lower(left(line, 8)), '[^a-z0-9]', '', 'g')) AS name FROM lines)
SELECT regexp_replace(path, 'txt$', 'py') AS path, kind, name, parent, n FROM (SELECT path, 'method' AS kind, name, 'Doc' AS parent, count(*) AS n FROM m GROUP BY path, name UNION ALL SELECT DISTINCT path, 'class', 'Doc', NULL, 1 FROM m)""")
def symbols_extract(spark, d):
    """Symbols of sources made of the documents: a class for each, with a method for each line's first word; counted by name and parent."""
    name = F.concat(F.lit("m"), F.regexp_replace(F.lower(F.substring("line", 1, 8)), "[^a-z0-9]", ""))
    body = line_spans(spark, d).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("n", name.alias("m")))).alias("ms"))
    source = F.concat(F.lit("class Doc:\n"), F.array_join(F.transform("ms", lambda x: F.concat(F.lit("    def "), x["m"], F.lit("(self):\n        return "), x["n"].cast("string"), F.lit("\n"))), ""))
    found = chunking.file_symbols(body.select(F.regexp_replace("path", "txt$", "py").alias("path"), F.lit("python").alias("language"), source.alias("text")))
    parent = found.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return found.join(parent, "parent_id", "left").groupBy("path", "kind", "name", "parent").agg(F.count("*").alias("n"))


@query(f"WITH {CHUNKS}, bc AS (SELECT chunks.id, coalesce(string_agg(cs.kind || ' ' || name, chr(10) ORDER BY ys, ye DESC, sid), '') AS bc FROM chunks LEFT JOIN cs USING (id) GROUP BY chunks.id) SELECT id, md5(concat('path: ', path, chr(10), 'language: text', chr(10), 'symbols:', chr(10), bc, chr(10), 'text:', chr(10), line)) AS input FROM chunks JOIN bc USING (id)")
def embedding_texts(spark, d):
    chunks = line_chunks(spark, d)
    rows = chunks.join(topology.chunk_symbols(chunks, line_symbols(spark, d)).select("id", "breadcrumbs"), "id")
    return rows.select("id", F.md5(F.encode(embedding_text(), "UTF-8")).alias("input"))


@query(f"WITH {CHUNKS} SELECT id, md5(concat(path, ':', a, CASE WHEN a = b THEN '' ELSE concat('-', b) END, chr(10), 'kind: ', kind, chr(10), line)) AS document FROM chunks")
def rerank_document_text(spark, d):
    return line_chunks(spark, d).select("id", F.md5(F.encode(rerank_document(), "UTF-8")).alias("document"))


@query(f"WITH {CORPUS}, h AS (SELECT path, sha256(text) AS h FROM corpus) SELECT path, round(list_sum(list_transform(range(0, 8), lambda i: CAST(CAST((CAST(concat('0x', substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS INT) - 127.5) / 127.5 AS FLOAT) AS DOUBLE))), 4) AS total FROM h")
def embed_hash_udf(spark, d):
    made = embedded(corpus(spark, d).select(F.col("path").alias("id"), F.col("text").alias("input")), HashEmbedder(8))
    return made.select(F.col("id").alias("path"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


class _FailsOnToxic:
    """An embedder that fails on some texts, to show errors caught row by row."""

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        if any("scum" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t))] for t in texts]


@query(f"WITH {CORPUS} SELECT path, CASE WHEN contains(text, 'scum') THEN NULL ELSE CAST(length(text) AS DOUBLE) END AS value, CASE WHEN contains(text, 'scum') THEN 'refused' END AS error FROM corpus")
def embed_error_capture(spark, d):
    made = embedded(corpus(spark, d).select(F.col("path").alias("id"), F.col("text").alias("input")), _FailsOnToxic())
    return made.select(F.col("id").alias("path"), F.get("embedding", F.lit(0)).cast("double").alias("value"), F.col("embedding_error").alias("error"))


# Runs and incremental refresh

OLD = f"""{CORPUS}, now AS (SELECT doc_id, path, sha256(text) AS fingerprint, CAST({ENC.format('text')} AS BIGINT) AS size, doc_id * 1000.0 AS mtime FROM corpus),
old AS (SELECT CASE WHEN doc_id % 13 = 0 THEN concat(path, '.old') ELSE path END AS path, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE fingerprint END AS fingerprint, size, CASE WHEN doc_id % 3 = 0 THEN mtime - 1 ELSE mtime END AS mtime FROM now WHERE doc_id % 10 <> 0),
changes AS (SELECT coalesce(now.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN now.path IS NULL THEN 'deleted' WHEN now.size = old.size AND now.mtime = old.mtime THEN 'unchanged_stat' WHEN now.fingerprint = old.fingerprint THEN 'unchanged_hash' ELSE 'changed' END AS change FROM now FULL JOIN old ON now.path = old.path)"""


def file_states(spark, d) -> tuple[DataFrame, DataFrame]:
    now = corpus(spark, d).select("doc_id", "path", F.sha2(F.encode("text", "UTF-8"), 256).alias("fingerprint"), F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") * 1000.0).alias("mtime"), F.lit(None).cast("double").alias("ctime"))
    old = now.filter("doc_id % 10 <> 0").select(
        F.when(F.col("doc_id") % 13 == 0, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("fingerprint")).alias("fingerprint"),
        "size", F.when(F.col("doc_id") % 3 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"), "ctime",
    )
    return now, old


@query(f"WITH {OLD} SELECT path, change FROM changes")
def change_detection(spark, d):
    return incremental.changes(*file_states(spark, d))


@query(f"WITH {OLD} SELECT path FROM changes WHERE change = 'deleted'")
def deleted_files(spark, d):
    return incremental.changes(*file_states(spark, d)).filter("change = 'deleted'").select("path")


@query(f"WITH {OLD} SELECT old.path, coalesce(CASE WHEN length(now.fingerprint) % 2 = 0 AND now.doc_id % 4 = 0 THEN NULL ELSE now.size END, old.size) AS size FROM old LEFT JOIN now ON now.path = old.path")
def files_coalesce(spark, d):
    now, old = file_states(spark, d)
    n = now.select("path", F.when(~((F.length("fingerprint") % 2 == 0) & (F.col("doc_id") % 4 == 0)), F.col("size")).alias("size"))
    listed = old.select("path").join(n, "path", "left")
    return incremental.with_run_values(listed, old.select("path", "size"))


@query(f"WITH {OLD} SELECT path FROM old WHERE path NOT IN (SELECT path FROM now)")
def prune_orphans(spark, d):
    now, old = file_states(spark, d)
    return incremental.orphans(old.select("path"), now)


@query(f"WITH {OLD} SELECT (SELECT count(*) FROM changes WHERE change IN ('new', 'deleted')) = 0 AS same")
def activation_check(spark, d):
    now, old = file_states(spark, d)
    return incremental.same_files(now, old)


RUNS = "runs AS (SELECT user_id AS run, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS started FROM events GROUP BY user_id)"


@query(f"WITH {RUNS} SELECT arg_max(run, (started, run)) AS run FROM runs WHERE status = (SELECT min(event_type) FROM events)")
def run_resume(spark, d):
    """The latest run in a given state, of runs made of the events."""
    e = table(spark, d, "events")
    runs = e.groupBy(F.col("user_id").alias("run")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("started"))
    return incremental.latest_run(runs, e.agg(F.min("event_type")).first()[0])


@query(f"WITH {OLD} SELECT path, fingerprint, size FROM now")
def active_run_scan(spark, d):
    """Files of the active run of a store that has another one in the making."""
    now, old = file_states(spark, d)
    store = IndexStore(spark, f"{shared_dir(spark)}/catalogue/store-{uuid.uuid4().hex}")
    files = [f.select("path", F.lit("text").alias("language"), "fingerprint", "size", "mtime", "ctime") for f in (now, old)]
    run = store.begin("a")
    store.write_files(run, files=files[0])
    store.activate(run, now)
    store.write_files(store.begin("b"), files=files[1])
    return store.table("files").select("path", "fingerprint", "size")


# The refresh driver, over the documents as files

BYTES = ENC.format("text")


def refreshed(spark: SparkSession, d: str, edited: bool) -> tuple[IndexStore, list[plan.Refreshed]]:
    store = IndexStore(spark, f"{shared_dir(spark)}/catalogue/store-{uuid.uuid4().hex}")
    done = [plan.refresh(spark, store, docs_source(spark, d, 20_000), docs_options(20_000), HashEmbedder())]
    if edited:
        done.append(plan.refresh(spark, store, docs_source(spark, d, 20_000, True), docs_options(20_000), HashEmbedder()))
    return store, done


@query(f"WITH {CORPUS} SELECT path, CASE WHEN {BYTES} > 20000 THEN NULL ELSE sha256(text) END AS fingerprint, CASE WHEN {BYTES} > 20000 THEN NULL ELSE md5(text) END AS chunks_md5, {BYTES} > 20000 AS skipped FROM corpus")
def refresh_full(spark, d):
    """A first refresh: every file with its chunks, put together again, or as skipped."""
    store, _ = refreshed(spark, d, False)
    texts = store.with_vectors(store.table("chunks")).filter("embedding is not null").groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "").alias("t"))
    kept = store.table("files").join(texts, "path", "left").select("path", "fingerprint", F.md5(F.encode(F.coalesce("t", F.lit("")), "UTF-8")).alias("chunks_md5"), F.lit(False).alias("skipped"))
    return kept.unionByName(store.skipped().select("path", F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast("string").alias("chunks_md5"), F.lit(True).alias("skipped")))


@query(f"WITH {CORPUS}, e AS (SELECT doc_id, path, CASE WHEN doc_id % 10 = 1 THEN concat(text, ' more') ELSE text END AS text FROM corpus WHERE doc_id % 10 <> 0) SELECT path, sha256(text) AS fingerprint, doc_id % 10 <> 1 AS taken_over, CAST(CASE WHEN doc_id % 10 = 2 THEN 2000 ELSE 1000 END AS DOUBLE) AS mtime FROM e WHERE {BYTES} <= 20000")
def refresh_incremental(spark, d):
    """A second refresh, after some files are gone, changed or touched: which rows are taken over from the first."""
    store, (first, _) = refreshed(spark, d, True)
    files = store.table("files")
    edited = docs_source(spark, d, 20_000, True).read(docs_source(spark, d, 20_000, True).manifest())[0].select("path", "fingerprint")
    newest = files.agg(F.max("batch")).first()[0]
    return files.join(edited, ["path", "fingerprint"]).select("path", "fingerprint", (F.col("batch") < newest).alias("taken_over"), "mtime")


@query("SELECT 'none' AS \"table\", 'none' AS key, 'none' AS violation WHERE false")
def index_is_valid(spark, d):
    """Rows of a refreshed index that break its structure: none."""
    return validate.check(refreshed(spark, d, False)[0])


@query(f"WITH {CHUNKS} SELECT id, CASE WHEN length(path) % 5 = 0 THEN 'source read failed' WHEN length(path) % 5 = 1 THEN 'source changed since it was indexed' WHEN e % 7 = 0 THEN 'range is not in the source' WHEN e % 7 = 1 THEN 'text differs from the source' END AS reason FROM chunks WHERE kind = 'block'")
def hydrate_checks(spark, d):
    """Line chunks against sources of which some are missing, changed or shorter, and texts of which some are others."""
    chunks = line_chunks(spark, d).filter("kind = 'block'")
    moved = chunks.select("id", "path", "byte_start", F.when(F.col("byte_end") % 7 == 0, F.col("byte_end") + (1 << 40)).otherwise(F.col("byte_end")).alias("byte_end"), F.when(F.col("byte_end") % 7 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    files = corpus(spark, d).select("path", F.sha2(F.encode("text", "UTF-8"), 256).alias("fingerprint"), "text")
    now = files.filter(F.length("path") % 5 != 0).withColumn("fingerprint", F.when(F.length("path") % 5 == 1, "other").otherwise(F.col("fingerprint")))
    return hydrate.hydrated(moved, files.select("path", "fingerprint"), now)[0].select("id", "reason")


VIOLATIONS = """c AS (SELECT CAST(vec_id AS VARCHAR) AS id, concat('f', label) AS path, vec_id, label FROM embeddings), f AS (SELECT path, id FROM c UNION ALL SELECT DISTINCT path, 'none' FROM c UNION ALL SELECT 'f0', '1'),
y AS (SELECT concat('s', k) AS id, CASE WHEN k > 0 THEN concat('s', k + 1) END AS parent, 'f1' AS path FROM range(0, 4) AS t(k))"""


@query(f"""WITH {VIOLATIONS} SELECT DISTINCT path, violation FROM (
SELECT f.path, 'missing chunk' AS violation FROM f ANTI JOIN c USING (id) UNION ALL SELECT f.path, 'foreign chunk' FROM f JOIN c USING (id) WHERE f.path <> c.path
UNION ALL SELECT path, 'empty chunk' FROM c WHERE vec_id % 11 = 0 UNION ALL SELECT path, 'chunk without embedding' FROM c WHERE vec_id % 170 = 0 UNION ALL SELECT path, 'chunk with error' FROM c WHERE vec_id % 230 = 0
UNION ALL SELECT path, 'dangling neighbour' FROM c WHERE vec_id + 1 NOT IN (SELECT vec_id FROM c) UNION ALL SELECT path, 'dangling symbol' FROM c WHERE vec_id % 50 = 4 UNION ALL SELECT path, 'dangling parent' FROM y WHERE parent NOT IN (SELECT id FROM y))""")
def consistency_violations(spark, d):
    e = table(spark, d, "embeddings")
    own, path = F.col("vec_id").cast("string"), F.concat(F.lit("f"), F.col("label").cast("string"))
    chunks = e.select(
        own.alias("id"), path.alias("path"), F.when(F.col("vec_id") % 11 == 0, "").otherwise("t").alias("text"), F.when(F.col("vec_id") % 170 != 0, F.col("embedding")).alias("embedding"),
        F.when(F.col("vec_id") % 230 == 0, "x").alias("embedding_error"), F.array(F.concat(F.lit("s"), F.when(F.col("vec_id") % 50 == 4, 9).otherwise(F.col("vec_id") % 4).cast("string"))).alias("symbol_ids"), F.array((F.col("vec_id") + 1).cast("string")).alias("neighbours"),
    )
    listed = chunks.select("path", "id").unionByName(chunks.select("path", F.lit("none").alias("id")).distinct()).unionByName(spark.createDataFrame([("f0", "1")], "path string, id string"))
    symbols = spark.range(4).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.lit("f1").alias("path"), F.when(F.col("id") > 0, F.concat(F.lit("s"), (F.col("id") + 1).cast("string"))).alias("parent_id"))
    return incremental.violations(listed.select("path", F.array("id").alias("chunk_ids")), chunks, symbols)


@query("WITH RECURSIVE s AS (SELECT vec_id AS id, CASE WHEN vec_id > 0 THEN vec_id // 2 END AS parent_id FROM embeddings), r AS (SELECT id FROM s WHERE id % 50 = 49 UNION SELECT s.parent_id FROM s JOIN r USING (id) WHERE s.parent_id IS NOT NULL) SELECT id FROM r")
def symbol_closure(spark, d):
    s = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") > 0, F.floor(F.col("vec_id") / 2)).alias("parent_id"))
    return incremental.symbol_closure(s.filter("id % 50 = 49"), s)


# Events and diagnostics

MUTATIONS = "m AS (SELECT concat('f', user_id) AS path, ts, event_id, event_type FROM events)"
LATEST = f"WITH {MUTATIONS} SELECT path, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM m) WHERE r = 1"


def as_mutations(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), "ts", "event_id", "event_type")


@query(LATEST)
def mutation_latest_events(spark, d):
    return incremental.latest_mutations(as_mutations(table(spark, d, "events"))).select("path", "event_id", "event_type")


@query(LATEST)
def mutation_stream_equals_batch(spark, d):
    """The same by a stream, whose batches are merged into a state one after the other."""
    source = table(spark, d, "events")
    root = f"{shared_dir(spark)}/mutations-{uuid.uuid4().hex}"
    empty = as_mutations(source).limit(0)
    states: list[DataFrame] = [empty]

    def refresh(latest: DataFrame, batch_id: int) -> None:
        mutations.merged(states[-1], latest).write.mode("overwrite").parquet(f"{root}/state-{batch_id}")
        states.append(latest.sparkSession.read.schema(empty.schema).parquet(f"{root}/state-{batch_id}"))

    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(f"{d}/events.parque[t]")  # as a pattern, for a file as for a folder
    mutations.follow(as_mutations(stream), refresh, f"{root}/checkpoint").awaitTermination()
    return states[-1].select("path", "event_id", "event_type")


DETAILS = "details AS (SELECT event_id AS pos, event_type AS code, concat('value ', CAST(event_id % 9 AS VARCHAR)) AS message, concat('f', user_id % 3) AS path, '' AS chunk_id FROM events)"


def details(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("pos"), F.col("event_type").alias("code"), F.concat(F.lit("value "), (F.col("event_id") % 9).cast("string")).alias("message"), F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("path"), F.lit("").alias("chunk_id")
    )


@query(f"""WITH {DETAILS}, per AS (SELECT code, message, count(*) AS n, min(pos) AS pos FROM details GROUP BY code, message), k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY pos, message) AS place FROM per)
SELECT code, CAST(sum(n) AS BIGINT) AS n, arg_min(message, place) AS first, coalesce(string_agg(message, '|' ORDER BY place) FILTER (place BETWEEN 2 AND 6), '') AS others, count(*) FILTER (place > 6) AS suppressed FROM k GROUP BY code""")
def diagnostics_summary(spark, d):
    return output.summarise_diagnostics(details(spark, d))


@query(f"WITH {DETAILS} SELECT code, message, path, chunk_id, min(pos) AS pos FROM details GROUP BY code, message, path, chunk_id")
def diagnostics_dedup(spark, d):
    return output.distinct_diagnostics(details(spark, d))


# The whole search


@dataclass(frozen=True)
class FirstVector:
    """An embedder that gives one vector, whatever the text."""

    values: list[float]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.values for _ in texts]


def docs_index(spark: SparkSession, d: str) -> Index:
    """Each document as one chunk, with the vector of its number."""
    docs = corpus(spark, d)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    chunks = docs.select(F.col("doc_id").cast("string").alias("id"), "path", F.lit("file").alias("kind"), F.lit(0).cast("long").alias("byte_start"), F.octet_length("text").cast("long").alias("byte_end"), F.lit(1).alias("line_start"), lines.alias("line_end"), "text", "language")
    near = vec(spark, d).select(F.col("id").cast("string").alias("id"), "embedding")
    symbols = spark.createDataFrame([], chunking.SYMBOLS)
    return Index(chunks, near, symbols, docs.select("path", "text"), *stored_postings(spark, d))

E2E = LISTS.replace("doc_id AS id", "CAST(doc_id AS VARCHAR) AS id").replace("DESC, doc_id", "DESC, CAST(doc_id AS VARCHAR)").replace("vec_id AS id", "CAST(vec_id AS VARCHAR) AS id").replace(" {}", """, f AS (SELECT id, coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + l.rank), 0) AS score FROM v FULL JOIN l USING (id)), k AS (SELECT * FROM f ORDER BY score DESC, id LIMIT 5)
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank, path, left(text, 80) AS head FROM k JOIN corpus ON CAST(doc_id AS VARCHAR) = id WHERE score >= 0.01""")


@query(E2E)
def search_e2e(spark, d):
    """Hybrid search by the pipeline: cosine and BM25 candidates, fused by ranks, top five, threshold, and wide columns joined last."""
    found = search(docs_index(spark, d), "der OR heed OR with", FirstVector(query_vector(spark, d)), parse({}, {}), k=5).results
    return rounded(found).select("id", "score", F.col("rank").cast("long").alias("rank"), "path", F.substring("text", 1, 80).alias("head"))


@query()
def search_output_json(spark, d):
    """The search's answer as fitted JSON."""
    rows = [{"id": r["id"], "range": r["path"], "text": r["head"], "score": r["score"]} for r in search_e2e(spark, d).orderBy("rank").collect()]  # five rows
    answer = {"status": {"state": "ready"}, "results": [output.visible(r) for r in rows], "diagnostics": []}
    return spark.createDataFrame([(output.serialise(answer, output.Limits(max_bytes=600)),)], "answer string")
