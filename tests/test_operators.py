"""Fusion, topology, chunking, models, options, store, scan, streams and search, on small inputs with known answers."""

import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import options
from lodestone.models import HashEmbedder, HttpModel, ModelError, embedded, embedding_text, rerank_document, retry_delay
from lodestone.operators import chunking, fusion, incremental, output, topology, vectors
from lodestone.operators.chunking import Chunker, Node, Source
from lodestone.plans.search import Index, lookup, search
from lodestone.sources import files
from lodestone.sources.store import IncompleteRun, IndexStore
from lodestone.streaming import mutations


def candidates(spark, rows):
    return spark.createDataFrame([(i, float(s)) for i, s in rows], "id string, score double")


# Fusion


def test_reciprocal_ranks(spark):
    one = spark.createDataFrame([("a", 1)], "id string, rank int")
    two = spark.createDataFrame([("b", 1), ("a", 2)], "id string, rank int")
    got = [tuple(r) for r in fusion.reciprocal_rank_fusion([(one, 2), (two, 1)], 60, 2).collect()]
    assert got == [("a", pytest.approx(2 / 61 + 1 / 62)), ("b", pytest.approx(1 / 61))]
    assert fusion.reciprocal_rank_fusion([(one, 2)], 60, 0).count() == 0


def test_fuse_modes(spark):
    v, none = candidates(spark, [("a", 0.9), ("b", 0.5)]), candidates(spark, [])
    assert [(r["id"], r["score"], r["mode"]) for r in fusion.fuse(v, none, 60, 5).collect()] == [("a", 0.9, "vector"), ("b", 0.5, "vector")]
    r = fusion.fuse(v, candidates(spark, [("b", 3.0), ("c", 2.0)]), 60, 5).collect()
    assert [x["id"] for x in r] == ["b", "a", "c"] and (r[0]["vector_rank"], r[0]["bm25_rank"], r[0]["mode"]) == (2, 1, "hybrid")


def test_budgets():
    assert fusion.budgets(10, True, None, 100, 100, most_vectors=12).vector == 12
    assert fusion.budgets(5, True) == fusion.Budgets(5, 40, 40) and fusion.budgets(5, False) == fusion.Budgets(5, 15, 0)
    assert fusion.budgets(10, True, 100, most_reranked=3).ranking == 10


def test_rerank(spark):
    c = fusion.ranked(candidates(spark, [("c1", 1.0), ("c2", 0.9)]))
    response = spark.createDataFrame([(0, 1, 0.99), (1, 0, 0.1)], "position int, index int, relevance double")
    assert [(r["id"], r["final_score"]) for r in fusion.rerank(c, response).orderBy("final_rank").collect()] == [("c2", 0.99), ("c1", 0.1)]
    partial = spark.createDataFrame([(0, 1, 0.99), (1, 7, 0.5), (2, 1, 0.2)], "position int, index int, relevance double")
    assert [(r["id"], r["final_score"]) for r in fusion.rerank(c, partial).orderBy("final_rank").collect()] == [("c2", 0.99), ("c1", 1.0)]


def test_threshold_comes_after_the_limit(spark):
    c = candidates(spark, [("a", 0.5), ("b", -0.1), ("c", 0.0)])
    assert [r["id"] for r in fusion.top_then_threshold(c, 2, -5).collect()] == ["a", "c"]
    assert [r["id"] for r in fusion.top_then_threshold(c, 2, 0.1).collect()] == ["a"]
    assert fusion.needs_expansion(None, 0.35) and not fusion.needs_expansion(0.35, 0.35) and not fusion.needs_expansion(0.1, 0.35, False)


def test_vectors(spark):
    v = spark.createDataFrame([("near", [1.0, 0.0]), ("far", [0.0, 1.0]), ("large", [100.0, 0.0]), ("short", [1.0]), ("none", None)], "id string, embedding array<double>")
    assert [r["id"] for r in vectors.top_cosine(v, [1.0, 0.0], 2).collect()] == ["large", "near"]
    for bad in ([], [float("nan"), 1.0], None, [True, 1.0]):
        assert vectors.top_cosine(v, bad, 2).count() == 0
    assert [r["id"] for r in vectors.top_cosine(v, [1.0, 0.0], 1, F.col("id") == "far").collect()] == ["far"]


# Chunking


def test_line_chunks():
    got = chunking.chunks_of("a", "text", "aaaa\nbbbb\ncccc\n", 8)
    assert [(c["text"], c["line_start"], c["line_end"], c["kind"]) for c in got] == [("aaaa\nbbbb\n", 1, 2, "fallback"), ("cccc\n", 3, 3, "fallback")]
    assert chunking.chunks_of("a", "text", "") == []
    assert [c["text"] for c in chunking.chunks_of("a", "text", "préface\nαβγ\nδεζ\n", 3)][-2:] == ["αβγ\n", "δεζ\n"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\n\t😀\u2003", max_size=80), st.integers(1, 9))
def test_line_chunks_make_up_the_text(value, budget):
    got = chunking.chunks_of("p", "text", value, budget)
    assert "".join(c["text"] for c in got) == value
    assert all(c["non_white"] <= budget for c in got)
    assert all(a["byte_end"] == b["byte_start"] for a, b in zip(got, got[1:]))
    assert len({c["id"] for c in got}) == len(got)


def three():
    return Source("function a() {}\n" * 3), Node("program", 0, 48, tuple(Node("function_declaration", i * 16, i * 16 + 16) for i in range(3)))


def test_structural_chunks():
    source, root = three()
    assert len(Chunker(source, 26).windows(root)) == 2
    wide = Chunker(source, 13, overlap=1).windows(root)
    assert [len(w.types) for w in wide] == [2, 3, 2] and len({w.own for w in wide}) == 3
    text = "class A {\n  a() {}\n  b() {}\n}\n"
    tree = Node("program", 0, 30, (Node("class_declaration", 0, 30, (Node("method_definition", 10, 19), Node("method_definition", 19, 28))),))
    got = Chunker(Source(text), 8, meaning=0).windows(tree)
    assert [text[w.start : w.end] for w in got] == ["  a() {}\n", "  b() {}\n"] and {w.bounds for w in got} == {(0, 30)}
    assert Chunker(Source(text), 99).windows(tree)[0].kind == "file"


def test_random_trees_give_ordered_disjoint_windows():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab \n{}") for _ in range(120))

        def made(a, b, depth):
            cuts = sorted(rng.sample(range(a, b + 1), min(b - a + 1, 2 * rng.randrange(4)))) if depth and b > a else []
            return Node(rng.choice(["class_x", "block", "function_y"]), a, b, tuple(made(x, y, depth - 1) for x, y in zip(cuts[::2], cuts[1::2])))

        budget = rng.randrange(3, 40)
        got = Chunker(Source(text), budget).windows(made(0, 120, 3))
        assert all(x.end <= y.start for x, y in zip(got, got[1:]))
        assert all(Source(text).weight(w.start, w.end) <= budget for w in got if w.kind != "file")


def test_parsers_and_symbols(spark):
    python = "class A:\n    def f(self):\n        pass\n\n\ndef g():\n    return 1\n"
    assert [(s["kind"], s["name"], s["parent_id"] is not None) for s in chunking.symbols("a.py", Source(python), chunking.python_tree(python))] == [("class", "A", False), ("method", "f", True), ("function", "g", False)]
    script = "class Köln {\n  run() { return 1 }\n}\nfunction go(a) { return a }\n"
    assert [(s["kind"], s["name"]) for s in chunking.symbols("a.ts", Source(script), chunking.brace_tree(script))] == [("class", "Köln"), ("method", "run"), ("function", "go")]
    assert chunking.symbol_name("function", "test('it\\'s ok', () => {})") == "test it's ok"
    html = chunking.html_tree("<html><body><p>a<br>b</p><div>c</body></html>")
    assert [n.type for n in html.children] == ["element"]
    broken = chunking.chunks_of("x.py", "python", "def (", parser=lambda language, text: 1 / 0)
    assert broken[0]["language"] == "text" and broken[0]["diagnostic"].startswith("parse failed")
    df = spark.createDataFrame([("a.py", "python", python), ("b.txt", "text", "x y\n"), ("c.txt", "text", None)], "path string, language string, text string")
    assert {r["path"] for r in chunking.chunk_files(df).collect()} == {"a.py", "b.txt"} and chunking.file_symbols(df).count() == 3


# Topology

CHUNKS = "id string, path string, kind string, byte_start long, byte_end long, line_start int, line_end int, text string, language string"
SYMBOLS = "id string, path string, kind string, name string, byte_start long, byte_end long"


def tree_frames(spark):
    chunks = spark.createDataFrame([
        ("root", "a", "class", 0, 40, 1, 5, "class A {", "ts"), ("child", "a", "method", 10, 20, 2, 2, "  run() {}", "ts"), ("child2", "a", "method", 20, 30, 3, 3, ", function x", "ts"),
        ("same", "a", "method", 10, 20, 2, 2, "", "ts"), ("other", "b", "block", 10, 20, 1, 1, "\n", "ts"),
    ], CHUNKS)
    symbols = spark.createDataFrame([("A", "a", "class", "A", 0, 40), ("r", "a", "method", "run", 10, 20), ("b", "b", "class", "B", 0, 99)], SYMBOLS)
    return chunks, symbols


def test_topology(spark):
    chunks, symbols = tree_frames(spark)
    own = topology.chunk_symbols(chunks, symbols)
    assert {r["id"]: r["symbol_ids"] for r in own.collect()} == {"root": ["A"], "child": ["A", "r"], "child2": ["A"], "same": ["A", "r"], "other": ["b"]}
    parents = topology.chunk_parents(chunks)
    assert {r["id"]: r["parent_id"] for r in parents.collect()} == {"root": None, "child": "root", "child2": "root", "same": "root", "other": None}  # equal ranges aren't parent and child
    assert {r["id"]: r["child_ids"] for r in topology.chunk_children(chunks, parents).collect()} == {"root": ["child", "same", "child2"]}
    siblings = {r["id"]: (r["previous_id"], r["next_id"]) for r in topology.chunk_siblings(chunks, parents, own).collect()}
    assert siblings["child"] == (None, "same") and siblings["child2"] == (None, None)
    labels = {r["id"]: (r["label"], r["range_label"]) for r in topology.labels(chunks, own).collect()}
    assert labels["root"] == ("class A", "a:1-5") and labels["child"] == ("method run", "a:2") and labels["child2"][0] == "method function x" and labels["other"][0] == "class B"
    context = {r["id"]: r["parent_text"] for r in topology.parent_context(chunks, symbols, spark.createDataFrame([("a", "x" * 40), ("b", "y" * 99)], "path string, text string"), 50).collect()}
    assert context["child"] == "x" * 40 and context["other"] == "class B\n"


def test_parents_equal_a_stack_sweep(spark):
    rng = random.Random(3)
    rows = [(f"{p}{i:03}", p, "block", a := rng.randrange(40), a + rng.randrange(1, 20), 1, 1, "", "x") for p in "ab" for i in range(120)]
    got = {r["id"]: r["parent_id"] for r in topology.chunk_parents(spark.createDataFrame(rows, CHUNKS)).collect()}
    for p in "ab":
        stack = []
        for r in sorted((r for r in rows if r[1] == p), key=lambda r: (r[3], -r[4], r[0])):
            while stack and not (stack[-1][4] >= r[4] and (stack[-1][3], stack[-1][4]) != (r[3], r[4])):
                stack.pop()
            parent = {x[0]: (x[3], x[4]) for x in rows}.get(got[r[0]])
            assert parent == ((stack[-1][3], stack[-1][4]) if stack else None)
            stack.append(r)


# Models, options, output


def test_embedding_and_rerank_texts(spark):
    df = spark.createDataFrame([("a.ts", "typescript", "function", 1, 2, ["function a"], "export")], "path string, language string, kind string, line_start int, line_end int, breadcrumbs array<string>, text string")
    got = df.select(embedding_text(), embedding_text(True), rerank_document()).first()
    assert got[0] == "path: a.ts\nlanguage: typescript\nsymbols:\nfunction a\ntext:\nexport" and "kind: function\nrange: 1-2" in got[1] and got[2] == "a.ts:1-2\nkind: function\nexport"


class Picky:
    def embed_batch(self, texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[1.0] for _ in texts]


def test_errors_stay_with_their_rows(spark):
    df = spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", "fine")], "id string, input string").coalesce(1)
    assert {r["id"]: (r["embedding"], r["embedding_error"]) for r in embedded(df, Picky()).collect()} == {"1": ([1.0], None), "2": (None, "no"), "3": ([1.0], None)}


def test_http_model():
    sent, answers = [], []

    def send(url, body, headers, timeout):
        sent.append((url, json.loads(body), headers))
        return answers.pop(0)

    waits = []
    model = HttpModel("http://x/", "m", "key", 2, send=send, wait=waits.append)
    answers[:] = [(429, {"Retry-After": "3"}, b""), (500, {}, b""), (200, {}, b'{"data":[{"embedding":[1,2]}]}')]
    assert model.embed_batch(["a"]) == [[1, 2]] and waits[0] == 3 and sent[0][0] == "http://x/embeddings" and sent[0][2]["authorization"] == "Bearer key" and sent[0][1]["dimensions"] == 2
    for body in (b"{", b'{"data":[]}', b'{"data":[{"embedding":[]}]}', b'{"data":[{"embedding":["x"]}]}'):
        answers[:] = [(200, {}, body)]
        with pytest.raises(ModelError):
            model.embed_batch(["a"])
    answers[:] = [(400, {}, b"")]
    with pytest.raises(ModelError):
        model.embed_batch(["a"])
    answers[:] = [(200, {}, b'{"results":[{"index":1,"relevance_score":0.5}]}'), (200, {}, b'{"results":[{"index":5,"relevance_score":0.5}]}')]
    assert model.rerank("q", ["a", "b"]) == [(1, 0.5)]
    with pytest.raises(ModelError):
        model.rerank("q", ["a", "b"])
    assert 0.02 <= retry_delay(1, "soon") <= 0.04


def test_options():
    got = options.parse({"topK": 0, "rrfK": 30, "batchSize": 9999, "overlap": 0, "vectorWeight": 0, "excludeGlobs": [1], "baseURL": "http://x", "model": "m", "apiKeyEnv": "K"}, {"K": "s"})
    assert (got["topK"], got["rrfK"], got["batchSize"], got["vectorWeight"]) == (5, 30, 2048, 0.0) and got.api_key == "s" and got.embeds and got.hyde_mode == "active-model" and len(got.diagnostics) == 3
    assert options.parse(None)["minFinalScore"] == 0.01 and options.parse([]).diagnostics


def test_options_files(tmp_path):
    (tmp_path / "b.json").write_text('{"topK": 9}')
    assert options.load([str(tmp_path / "a.json"), str(tmp_path / "b.json")])["topK"] == 9
    (tmp_path / "a.json").write_text("{")
    with pytest.raises(ValueError):
        options.load([str(tmp_path / "a.json")])


def test_output_fits():
    answer = {"status": {"state": "ready"}, "diagnostics": [], "results": [{"id": str(i), "range": "a:1", "text": "é" * 500, "parent_text": "p" * 900} for i in range(3)]}
    assert output.serialise(answer) == output.pretty(answer)
    for size in (4000, 1500, 700, 300, 60, 20):
        text = output.serialise(answer, output.Limits(max_bytes=size))
        assert len(text.encode()) <= size
    assert output.cut_utf8("éé", 3) == "é"


# Files, store, refresh, streams


def test_scan_and_read(spark, tmp_path):
    for name, data in {"a.py": b"print(1)\n", "sub/b.ts": b"\xef\xbb\xbfx", "sub/skip.log": b"l", "node_modules/c.js": b"c", "bin.dat": b"\x00\x01", "big.txt": b"y" * 500, "bad.txt": b"ok \xff end", ".gitignore": b"*.log\n"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    manifest = files.scan(spark, str(tmp_path), ["**/*"], ["**/.gitignore"])
    assert {r["path"] for r in manifest.collect()} == {"a.py", "sub/b.ts", "bin.dat", "big.txt", "bad.txt"}
    kept, said = files.read(spark, str(tmp_path), manifest, 100)
    rows = {r["path"]: r for r in kept.collect()}
    assert rows.keys() == {"a.py", "sub/b.ts", "bad.txt"} and rows["sub/b.ts"]["text"] == "x" and rows["bad.txt"]["text"] == "ok � end" and rows["a.py"]["language"] == "python"
    assert {(r["path"], r["code"]) for r in said.collect()} == {("bin.dat", "binary_file"), ("big.txt", "file_too_large")}
    assert files.inside(str(tmp_path), "@sub/b.ts") == "sub/b.ts"
    with pytest.raises(files.OutsideTree):
        files.inside(str(tmp_path), "../x")


FILES = "path string, language string, fingerprint string, size long, mtime double, ctime double"


def test_store_runs(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/store")
    assert store.status() == "empty" and store.table("files").count() == 0

    def rows(*names, mark="f"):
        return spark.createDataFrame([(n, "text", mark + n, 1, 1.0, 1.0) for n in names], FILES)

    run = store.begin("h")
    assert store.begin("h") == run and store.begin("other") != run and store.status() == "indexing"
    store.write_files(run, files=rows("a", "b"))
    assert [r["path"] for r in store.completed(run, spark.createDataFrame([("a", "fa"), ("b", "x")], "path string, fingerprint string")).collect()] == ["a"]
    with pytest.raises(IncompleteRun):
        store.activate(run, rows("a", "b", "c"))
    store.write_files(run, files=rows("b", "c", mark="g"))
    store.activate(run, rows("a", "b", "c"))
    assert {(r["path"], r["fingerprint"]) for r in store.table("files").collect()} == {("a", "fa"), ("b", "gb"), ("c", "gc")} and store.status() == "ready"
    with pytest.raises(IncompleteRun):
        store.activate(run, rows("a", "b", "c"))
    again = store.begin("h")
    assert again != run
    store.write_files(again, files=rows("a"))
    assert store.table("files").count() == 3  # the old run is read until the new one is active
    store.activate(again, rows("a"))
    assert store.table("files").count() == 1 and store.prune() == 1


def test_changes_with_times(spark):
    schema = "path string, fingerprint string, size long, mtime double, ctime double"
    now = spark.createDataFrame([("same", "f", 1, 5000.0, 5000.0), ("fresh", "f", 1, 9500.0, 9500.0), ("touched", "f", 1, 6000.0, 6000.0), ("edited", "g", 1, 5000.0, 6000.0), ("new", "n", 1, 1.0, 1.0)], schema)
    old = spark.createDataFrame([("same", "f", 1, 5000.0, 5000.0), ("fresh", "f", 1, 9500.0, 9500.0), ("touched", "f", 1, 5000.0, 5000.0), ("edited", "f", 1, 5000.0, 5000.0), ("gone", "n", 1, 1.0, 1.0)], schema)
    assert {r["path"]: r["change"] for r in incremental.changes(now, old, 10_000).collect()} == {
        "same": "unchanged_stat", "fresh": "unchanged_hash", "touched": "unchanged_hash", "edited": "changed", "new": "new", "gone": "deleted"}
    assert incremental.config_hash({"a": 1, "b": 2}) == incremental.config_hash({"b": 2, "a": 1})


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"f{rng.randrange(6)}", rng.randrange(20), i, rng.choice(["edit", "write"])) for i in range(60)]
    schema = "path string, ts long, event_id long, event_type string"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    states = [spark.createDataFrame([], schema)]

    def refresh(latest, batch_id):
        mutations.merged(states[-1], latest).write.mode("overwrite").parquet(f"{tmp_path}/s{batch_id}")
        states.append(spark.read.schema(schema).parquet(f"{tmp_path}/s{batch_id}"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    mutations.follow(stream, refresh, f"{tmp_path}/c").awaitTermination()
    assert len(states) == 4
    assert sorted(map(tuple, states[-1].collect())) == sorted(map(tuple, incremental.latest_mutations(spark.createDataFrame(rows, schema)).collect()))


# Search


class Scripted:
    """Texts with a word on the first axis, others on the second."""

    def embed_batch(self, texts):
        return [[1.0, 0.0] if "first" in t else [0.0, 1.0] for t in texts]


class Backwards:
    def rerank(self, query, documents):
        assert documents[0].startswith("a:")
        return [(len(documents) - 1, 0.99)]


class Generated:
    def generate(self, query):
        return "first"


class Broken:
    generate = rerank = lambda self, *a: 1 / 0


def index(spark):
    chunks, symbols = tree_frames(spark)
    v = spark.createDataFrame([("root", [1.0, 0.0]), ("child", [0.9, 0.19**0.5]), ("child2", [0.0, 1.0]), ("other", [0.5, 0.5])], "id string, embedding array<double>")
    return Index(chunks, v, symbols, spark.createDataFrame([("a", "x" * 40), ("b", "y" * 99)], "path string, text string"))


def test_search(spark):
    i = index(spark)
    got = search(i, "first", Scripted(), k=2)
    assert got.mode == "vector" and [r["id"] for r in got.results.collect()] == ["root", "child"]
    assert [r["id"] for r in search(i, "first", Scripted(), paths=["b"], k=2).results.collect()] == ["other"]
    hybrid = search(i, "run", Scripted(), k=3)
    assert hybrid.mode == "hybrid" and "child" in {r["id"] for r in hybrid.results.collect()}
    again = search(i, "first", Scripted(), k=1, reranker=Backwards())
    r = again.results.collect()[0]
    assert r["final_score"] == pytest.approx(0.99) and r["id"] == "child2" and r["rank"] == 1
    failed = search(i, "first", Scripted(), k=1, reranker=Broken())
    assert failed.diagnostics and failed.diagnostics[0].startswith("Rerank failed") and failed.results.count() == 1
    weak = Index(i.chunks, i.vectors.filter("id = 'root'"), i.symbols, i.sources)
    assert search(weak, "unknown", Scripted(), k=1, expander=Generated()).hyde
    assert search(weak, "unknown", Scripted(), k=1, expander=Broken()).diagnostics[0].startswith("HyDE failed")
    parents = search(i, "first", Scripted(), k=2, include_parents=True).results.collect()
    assert [p["parent_text"] for p in parents] == ["x" * 40, None]  # shown once
    assert [r["id"] for r in search(i, "run", None, k=1).results.collect()] == ["child"]
    assert HashEmbedder(4).embed_batch(["a"]) == HashEmbedder(4).embed_batch(["a"])


def test_lookup(spark):
    got = lookup(index(spark), "root", offset=1, limit=1)
    assert got["children_page"] == {"offset": 1, "limit": 1, "total": 3, "has_more": True} and len(got["children"]) == 1
    assert lookup(index(spark), "child")["parent"] == "class A {"
    assert lookup(index(spark), "nope")["diagnostics"] == ["chunk not found: nope"]
