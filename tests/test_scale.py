"""What shows only on odd or larger tables than the smallest driver tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import postings, topology, vectors
from lodestone.plans import catalogue


def documents(spark, at, texts):
    """A folder with texts as documents, numbered from 0."""
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return str(at)


def by_sql(at, name, *tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return con.execute(catalogue.oracle_sql()[name])


def same_as_sql(spark, at, name, *tables):
    cursor = by_sql(at, name, *tables)
    got = catalogue.queries()[name](spark, at).select(*[c[0] for c in cursor.description])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, cursor.fetchall()))


def test_binary_sniff_counts_beyond_16_kib(spark, tmp_path):
    # In the second text a seventh of the first 16 KiB is control bytes, and of all 40,000 characters more than 0.3 * 16 KiB.
    at = documents(spark, tmp_path, ["plain", "six by " * 5800, None, "x" * 20_000])
    same_as_sql(spark, at, "binary_sniff", "documents")
    assert [r["is_binary"] for r in catalogue.queries()["binary_sniff"](spark, at).orderBy("path").collect()] == [False, True, False, False]


def test_postings_go_through_one_exchange_of_blocks(spark, monkeypatch):
    """Rows of postings don't go through exchanges: with a group-by there were two."""
    monkeypatch.setattr(postings, "BLOCK", 7)
    texts = {"a": "one two one", "b": "", "c": "two " * 9, "d": "three one", "e": None}
    docs = spark.createDataFrame([(i, f"p/{i}", t) for i, t in texts.items()], "id string, path string, text string")
    for volume in (None, 3 * postings.VOLUME, 200 * postings.VOLUME):
        posted, sizes = postings.build(docs, volume=volume)
        want = {("one", "a", (0, 2)), ("two", "a", (1,)), ("two", "c", tuple(range(9))), ("three", "d", (0,)), ("one", "d", (1,))}
        rows = posted.collect()
        assert {(r["term"], r["id"], tuple(r["positions"])) for r in rows} == want and len(rows) == len(want)
        assert all(r["path"] == f"p/{r['id']}" for r in rows)
        assert posted.filter(F.col("bucket") != postings.bucket_of(F.col("term"))).isEmpty()
        assert {r["id"]: r["size"] for r in sizes.collect()} == {"a": 3, "b": 0, "c": 9, "d": 2, "e": 0}
    plan = posted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Aggregate" not in plan and postings.partitions_for(6 << 30) == 384


def test_batch_search_multiplies_and_equals_the_formula(spark, monkeypatch):
    """No join of all pairs, and the same rows, scores and ties, with copies, nulls, zeros, and vectors of other lengths."""
    monkeypatch.setattr(vectors, "ROWS", 16)
    monkeypatch.setattr(vectors, "COLUMNS", 3)
    monkeypatch.setattr(vectors, "PAIRS", 40)
    rows = [(str(i), [float((i * 7 + j * j * 3) % 11 - 5 + (i % 3) * 1e-6) for j in range(6)]) for i in range(150)]
    rows += [(f"copy{i:03}", rows[5][1]) for i in range(60)] + [("zero", [0.0] * 6), ("null", None), ("hole", [1.0, None, 2.0]), ("short", [1.0, 2.0]), ("long", [1.0] * 8)]
    frame = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    asked = frame.filter("id in ('5', '17', 'copy001', 'zero', 'short', 'long', '99')").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    for k in (1, 4, 70, 300):
        scored = frame.crossJoin(asked).select("query_id", "id", text.cosine(F.col("embedding"), F.col("query")).alias("score"))
        want = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        got = vectors.batch_top_cosine(frame, asked, k)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(vectors, "BLOCK", 3)
    assert sorted(map(tuple, vectors.batch_top_cosine(frame, asked, 300).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert vectors.batch_top_cosine(frame, asked.limit(0), 5).isEmpty()


ODD_TEXTS = ["one\ntwo\n\nfour\n", "", None, "\n\n\n", " \t\r\n,; ,x\nclass k\n" + "y" * 99, "é\r\n\U0001f600\n" * 20, "\n".join(f"line {i % 7}" for i in range(150))]


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.fixture
def small_batches(spark):
    """Files go over several batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "7")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("name", ["topology_summary", "chunk_symbols", "chunk_parent", "chunk_children", "children_page", "chunk_siblings", "chunk_labels"])
def test_topology_goes_through_one_exchange(spark, tmp_path, small_batches, name):
    """Neighbours' labels were joined by ids that are mostly null, so these rows came to one task; and lines were made anew for each join."""
    at = documents(spark, tmp_path, ODD_TEXTS)
    found = catalogue.queries()[name](spark, at)
    assert exchanges(found) == 1 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    same_as_sql(spark, at, name, "documents")


def test_a_sweep_equals_comparing_all_pairs(spark, small_batches, monkeypatch):
    """Ranges that cross, are equal, are empty or missing, and chunks without a file."""
    monkeypatch.setattr(topology, "SWEPT", 50)
    rng = random.Random(5)
    ranges = lambda p, n: [(f"{p}{i:03}", p, a := rng.randrange(30), a + rng.choice([0, 1, 3, 9, 20])) for i in range(n)]
    chunks = [x for p in "ab" for x in ranges(p, 90)] + [("none", "c", None, 4), ("lost", None, 1, 2), ("alone", "d", 1, 2)]
    symbols = [x for p in "ab" for x in ranges(p, 40)] + [("s", None, 0, 9), ("t", "c", 0, None)]
    frame = spark.createDataFrame(chunks, "id string, path string, byte_start long, byte_end long").repartition(3)
    names = spark.createDataFrame(symbols, "id string, path string, byte_start long, byte_end long").selectExpr("*", "'k' AS kind", "id AS name")
    got = {r["id"]: r for r in topology.relations(frame, names, ["parent_id", "child_ids", "previous_id", "next_id", "symbols"], ["byte_end"]).collect()}
    assert len(got) == len(chunks)
    whole = [c for c in chunks if None not in c]
    holds = lambda x, c: x[1] == c[1] and x[2] <= c[2] and c[3] <= x[3]
    parent, inner = {}, {}
    for c in whole:
        around = sorted((s for s in symbols if None not in s and holds(s, c)), key=lambda s: (s[2], -s[3], s[0]))
        parent[c] = max((p for p in whole if holds(p, c) and p[2:] != c[2:]), key=lambda p: (p[2], -p[3], p[0]), default=None)
        inner[c] = around[-1][0] if around else None
        assert [x["id"] for x in got[c[0]]["symbols"]] == [s[0] for s in around] and got[c[0]]["parent_id"] == (parent[c] and parent[c][0]) and got[c[0]]["byte_end"] == c[3]
    for c in whole:
        assert got[c[0]]["child_ids"] == [x[0] for x in sorted((x for x in whole if parent[x] == c), key=lambda x: (x[2], -x[3], x[0]))]
        row = sorted((x for x in whole if (x[1], parent[x], inner[x]) == (c[1], parent[c], inner[c])), key=lambda x: (x[2], x[3], x[0]))
        near = [None, *(x[0] for x in row), None]
        assert (got[c[0]]["previous_id"], got[c[0]]["next_id"]) == (near[row.index(c)], near[row.index(c) + 2])
    for lost in ("none", "lost"):
        assert tuple(got[lost])[1:-1] == (None, [], None, None, [])


def test_neighbours_go_through_two_exchanges(spark, tmp_path, small_batches):
    """One of chunks and symbols and one of neighbours, no joins; each relation was worked out and joined on its own."""
    at = documents(spark, tmp_path, ODD_TEXTS)
    found = catalogue.queries()["hydrate_neighbours"](spark, at)
    assert exchanges(found) == 2 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    same_as_sql(spark, at, "hydrate_neighbours", "documents")
