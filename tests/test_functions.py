import math
import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import paths, text
from lodestone.operators import lexical


def tokens(spark, value):
    return spark.createDataFrame([(value,)], "t string").select(text.code_tokens(F.col("t")).alias("x")).first()[0]


def test_code_tokens(spark):
    assert {"foo-bar", "foo", "bar", "src/retriever.test.ts", "retriever.test.ts", "retriever", "test", "ts"} <= set(tokens(spark, "foo-bar src/retriever.test.ts"))
    assert {"semanticgetchunk", "semantic", "get", "chunk"} <= set(tokens(spark, "semanticGetChunk"))
    assert {"pi_cache_dir", "pi", "cache", "dir", "picachedir"} <= set(tokens(spark, "PI_CACHE_DIR"))
    assert tokens(spark, "constructor(message: string)") == ["constructor", "constructor", "message", "message", "string", "string"]
    assert tokens(spark, "") == []


GLOBS = [
    ("{src,test}/package.json", ["src/package.json", "test/package.json"], ["lib/package.json"]),
    ("@(src|test)/package.json", ["src/package.json", "test/package.json"], ["lib/package.json"]),
    ("**/*.yml", [".github/workflows/ci.yml", "a.yml"], ["a.yaml"]),
    ("src/[ab].ts", ["src/a.ts", "src/b.ts"], ["src/c.ts"]),
    ("src/[!ab].ts", ["src/c.ts"], ["src/a.ts"]),
    ("foo/*", ["foo/x", "foo/.x"], ["foo/x/y", "foo/"]),
    ("foo/**/*.ts", ["foo/a.ts", "foo/b/c/a.ts"], ["a.ts", "foo/a.js"]),
    ("vendor/**", ["vendor/a/b", "vendor/a"], ["x/vendor/a"]),
    ("a?c", ["abc"], ["a/c", "ac"]),
    ("!(x|y).js", ["z.js", "xx.js"], ["x.js", "y.js"]),
    ("v{1..3}.txt", ["v1.txt", "v3.txt"], ["v4.txt"]),
    ("*", ["a", ".a"], ["a/b"]),
]


@pytest.mark.parametrize("glob, yes, no", GLOBS)
def test_globs(glob, yes, no):
    regex = re.compile(paths.glob_regex(glob))
    assert all(regex.search(p) for p in yes) and not any(regex.search(p) for p in no)


def test_path_filters_are_or(spark):
    df = spark.createDataFrame([(p,) for p in ["src/a.ts", "src/b.md", "docs/a.md", "test/x", "testing/y", "!foo/a"]], "p string")

    def kept(filters):
        return {r[0] for r in df.filter(paths.matches(F.col("p"), filters)).collect()}

    assert kept(["src/", "**/*.md"]) == {"src/a.ts", "src/b.md", "docs/a.md"}
    assert kept(["test"]) == {"test/x"} and kept(["test/"]) == {"test/x"} and kept(["!foo"]) == {"!foo/a"}
    assert len(kept([])) == 6
    assert paths.static_prefix("src/a/*.ts") == "src/a/" and paths.static_prefix("**/x") == ""


def test_ignore_rules(spark):
    files = [paths.IgnoreFile("", ("*.log", "!keep.log", "/out", "tmp/", "# no")), paths.IgnoreFile("sub", ("!a.log", "/only.txt"))]
    names = ["a.log", "keep.log", "out/x", "b/out/x", "tmp/x", "b/tmp/y", "sub/a.log", "sub/only.txt", "sub/d/only.txt", "ok"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert {r[0] for r in df.filter(~paths.ignored(F.col("p"), files)).collect()} == {"keep.log", "b/out/x", "sub/d/only.txt", "ok"}


def test_binary_and_bytes(spark):
    rows = [(b"abc\n", False), (b"a\x00b", True), (b"\x01\x02\x03abc", True), (b"\x01aaaaaaaaa", False), (b"", False)]
    df = spark.createDataFrame([(bytearray(b), e) for b, e in rows], "c binary, e boolean")
    assert all(r[0] == r[1] for r in df.select(text.binary_looking(F.col("c")), "e").collect())
    got = spark.createDataFrame([("préface\nαβγ\n",)], "t string").select(text.byte_slice(F.col("t"), F.lit(9), F.lit(15)), text.non_white_space(F.lit("a b  c"))).first()
    assert tuple(got) == ("αβγ", 3)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0]), ([0.0], [1.0]), ([100.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(text.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.6, 0.0, 1.0]


DOCS = {"a": "alpha beta gamma", "b": "alpha alpha delta", "c": "beta beta gamma alpha", "d": "epsilon zeta", "e": "Café foo_bar theta", "f": "gamma delta epsilon epsilon beta"}
FTS_QUERIES = ["alpha", "alpha beta", "alpha OR epsilon", "epsilon NOT beta", '"beta gamma"', "al*", "cafe", "foo_bar", "(alpha OR delta) AND gamma", "NEAR(beta epsilon)", "beta + gamma", "content : delta"]


@pytest.mark.parametrize("query", FTS_QUERIES)
def test_bm25_equals_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, content)")
    db.executemany("insert into t values (?, ?)", DOCS.items())
    expected = {i: -s for i, s in db.execute("select id, bm25(t) from t where t match ?", (query,))}
    docs = spark.createDataFrame(list(DOCS.items()), "path string, text string")
    got = {r["path"]: r["score"] for r in lexical.bm25(docs, lexical.parse(query)).collect()}
    assert got.keys() == expected.keys()
    if "NEAR" not in query:  # there SQLite counts only phrases within the distance
        assert all(math.isclose(got[k], expected[k], rel_tol=1e-9) for k in got)


@pytest.mark.parametrize("query", ["how does it work?", "foo-bar", "a:b", '"open', "*", "don't", "zeta AND", "foo.bar", "class Foo {"])
def test_what_is_no_expression_falls_back(spark, query):
    with pytest.raises(lexical.NotFullText):
        lexical.parse(query)
    lexical.parse_or_fallback(query)
    docs = spark.createDataFrame([("x", "class Foo { method() {} }"), ("y", "nothing")], "path string, text string")
    if query == "class Foo {":
        assert [r["path"] for r in lexical.search(docs, query, 5).collect()] == ["x"]
    assert lexical.search(docs, "  ", 5).count() == 0 and lexical.search(docs, "foo", 0).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc*?[]{}()!@+|/.,-", max_size=12))
def test_any_glob_compiles(glob):
    re.compile(paths.glob_regex(glob))
