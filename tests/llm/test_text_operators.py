"""Quality rules, decontamination, BPE, token files and shards against plain versions."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import bpe, decontaminate, huffman, quality, sharding, simhash, wordbpe
from lodestone.llm.common import Scratch, words
from tests.llm.helpers import SCHEMA, frame, odd_rows, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def key(row):
    return str(row)


# Quality rules


def naive_base(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(found)
    return n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def quality_rows():
    rng = random.Random(1)
    rows = [r for r in odd_rows() if r[0] != 6]
    for i in range(20, 60):
        body = prose(rng, rng.choice([5, 30, 80]), rng.choice([4, 100]))
        rows.append((i, f"{body}\nHOME |  page {i}  of the site\n{body if i % 5 == 0 else 'x # y'}", "en", "host" if i % 2 else None))
    for i in range(60, 90):
        rows.append((i, f"home | page {i} of the site\n{prose(rng, 3)}\nfooter text that all pages of this host have in common again and again and so on for twenty words at least", "en", "host"))
    return rows


def naive_quality(rows, rules=quality.QualityRules()):
    def norm(line):
        return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line)).lower().strip(" ")

    def h(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:15], 16)

    docs = [[norm(x) for x in (t or "").split("\n")] for _, t, *_ in rows]
    where = {}
    for (_, _, _, host), lines in zip(rows, docs):
        for x in filter(None, lines):
            where.setdefault((host or "", h(x)), set()).add(tuple(filter(None, lines)))
    frequent = {k for k, v in where.items() if len(v) > rules.max_documents}
    out = []
    for (i, t, _, host), lines in zip(rows, docs):
        base = naive_base(t)
        gone = sum(len(x.split(" ")) for x in lines if x and (host or "", h(x)) in frequent)
        left = base[0] - gone
        depleted = gone > 0 and (left < rules.min_left_words or 100 * left < rules.min_left_percent * base[0])
        out.append((i, *base, gone, not base[5] and not depleted))
    return out


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]


def test_quality_equals_plain_version(spark):
    rows = quality_rows()
    got = quality.judge(frame(spark, rows, extra=True), Scratch(spark, "t")).select(*COLUMNS)
    expected = naive_quality(rows)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    assert any(e[-2] for e in expected) and any(not e[-1] and not e[-3] for e in expected)


def run_sql(sql, rows):
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string())})
    with duckdb.connect() as db:
        db.register("documents", docs)
        return db.sql(sql).fetchall()


def test_pages_of_a_template_lose_the_lines_they_share(spark):
    rng = random.Random(8)
    menu = [prose(rng, 6) for _ in range(10)]
    rows = [(i, "\n".join([*menu, f"own line of page {prose(rng, 4, 10_000)}"]), "en", "shop") for i in range(200)]
    rows += [(200 + i, "\n".join(prose(rng, 8) for _ in range(6)), "en", "shop") for i in range(5)]
    rows += [(300 + i, rows[200][1], "en", "shop") for i in range(60)]  # copies of one document are one document
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, rows), Scratch(spark, "t")).collect()}
    assert all(got[i]["removed_words"] == 60 and not got[i]["kept"] for i in range(200))
    assert all(got[i]["removed_words"] == 0 and got[i]["kept"] for i in [*range(200, 205), *range(300, 360)])


def test_quality_sql_on_repeated_rows(spark):
    rng = random.Random(9)
    rows = [(i, f"the same line in every document\n{prose(rng, 30)}", "en", "a") for i in range(20)]
    for more in ([rows[3]] * 3, [(50, f"the same line in every document\n{prose(rng, 30)}", "en", "a")] + [rows[3]] * 3):
        own = quality.judge(frame(spark, rows + more), Scratch(spark, "t")).select("doc_id", "removed_words", "kept").distinct().collect()
        sql = [(r[0], r[7], r[8]) for r in run_sql(quality.ORACLE_SQL.replace("FROM documents", "FROM (SELECT DISTINCT * FROM documents)"), rows + more)]
        assert sorted(map(tuple, own)) == sorted(sql)
        assert sum(r["removed_words"] > 0 for r in own) == (21 if len(more) == 4 else 0)


def test_quality_when_hashes_mislead(spark, monkeypatch):
    monkeypatch.setattr(quality, "POSITION_BITS", 60)
    rng = random.Random(2)
    rows = [(i, prose(rng, 60, 3), "en", "a") for i in range(30)]
    got = quality.text_rules(frame(spark, rows), quality.QualityRules()).select("doc_id", "n_repeat_words").collect()
    assert {r[0]: r[1] for r in got} == {i: naive_base(t)[4] for i, t, *_ in rows}


def test_quality_clean_keeps_columns(spark):
    rows = quality_rows()
    docs = frame(spark, rows, extra=True)
    got = quality.clean(docs, Scratch(spark, "t"))
    assert got.columns == docs.columns
    kept = {r["doc_id"]: r for r in got.collect()}
    expected = {e[0]: e for e in naive_quality(rows) if e[-1]}
    assert set(kept) == set(expected)
    for i, r in kept.items():
        assert len(r["text"].split()) == expected[i][1] - expected[i][-2] and r["n_chars"] == len(r["text"])


def test_words(spark):
    texts = ["", None, " \x0b", "a", " a\tb\x0cc\r\n", "é\xa0x y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(words("text").alias("w") if False else words(quality.F.col("text")).alias("w"))
    assert [r["w"] for r in df.collect()] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


# Decontamination


def naive_hits(rows, items):
    def split(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t, *_ in rows:
        w, hit, ids = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def contaminated_rows():
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([1, 3, 9, 10, 14, 40]))) for i in range(12)] + [(12, None), (13, "!!"), (14, "É Ärger Ünder mit CAPS Wörtern hier und da noch elf")]
    items.append((15, items[3][1]))
    rows = odd_rows()
    for i in range(50):
        text = prose(rng, 30)
        if i % 3 == 0:
            w = items[rng.randrange(12)][1].split()
            text += " -- " + ", ".join(w[: rng.choice([5, 12, 40])]).upper() + ". " + prose(rng, 4)
        rows.append((100 + i, text, "en", "a"))
    return rows + [(200, items[14][1], "de", "a")], items


def test_decontamination_equals_plain_version(spark):
    rows, items = contaminated_rows()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(frame(spark, rows, extra=True), benchmark, Scratch(spark, "t"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(naive_hits(rows, items), key=key)


def test_decontamination_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SET_ROWS", 0)
    rows, items = contaminated_rows()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows, extra=True)
    assert sorted(map(tuple, decontaminate.report(docs, benchmark, Scratch(spark, "t")).collect()), key=key) == sorted(naive_hits(rows, items), key=key)
    left = decontaminate.remove_contaminated(docs, benchmark, Scratch(spark, "t"))
    assert left.columns == docs.columns
    assert sorted([r["doc_id"] for r in left.collect()], key=key) == sorted([r[0] for r in naive_hits(rows, items) if not r[-1]], key=key)


def test_decontamination_of_nothing(spark):
    docs = frame(spark, odd_rows())
    none = spark.createDataFrame([], "item_id long, text string")
    assert {tuple(r)[2:] for r in decontaminate.report(docs, none, Scratch(spark, "t")).collect()} == {(0, 0, hashlib.sha256(b"").hexdigest(), False)}
    assert decontaminate.report(frame(spark, []), none, Scratch(spark, "t")).count() == 0


# BPE and token files

ODD_TEXTS = ["", " ", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "Don't we'll I'VE", "ΑΣ Σίσυφος ΣΑΣ", "İstanbul ǅ ﬁ", "é\u0085x\xa0y\x1cz", "日本語 😀👍🏽 12½²", "ªº µß ÀÉ", "x​y", "\x00\x01a", "Å ệ"]


def test_pieces_and_ids_equal_the_library():
    rng = random.Random(4)
    alphabet = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x1100, 0x4E00, 0x1F600, 0x301, 0x2019, 0x2028, 0x3000, 0xFEFF]]
    texts = ODD_TEXTS + ["".join(rng.choice(alphabet[: rng.choice([128, 256, len(alphabet)])]) for _ in range(50)) for _ in range(600)]
    own, library = wordbpe.WordBpe(PATH), Tokenizer.from_file(PATH)
    pieces = {p for t in texts for p in own.pieces(t)}
    lexicon = wordbpe.Lexicon(wordbpe.Lexicon.compile({p: own.merge(p) for p in sorted(pieces - own.special.keys())[::2]}))
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert [i for p in own.pieces(t) for i in bpe.ids_of(lexicon, own, p)] == e.ids, t
        assert [i for p in own.pieces(t) for i in own.library_ids(p)] == e.ids, t
        assert [i for p in own.pieces(t) for i in own.merge(p)] == e.ids, t


def test_lexicon_is_minimal_and_exact():
    rng = random.Random(5)
    have = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))): [rng.randrange(9)] * rng.randrange(1, 4) for _ in range(200)}
    lexicon = wordbpe.Lexicon(wordbpe.Lexicon.compile(have))
    for n in range(1, 10):
        for _ in range(200):
            w = "".join(rng.choice("abc") for _ in range(n))
            assert lexicon.find(w) == have.get(w)
    assert all(lexicon.find(w) == ids for w, ids in have.items())
    suffixes = {w[i:] for w in have for i in range(len(w) + 1)}
    ends = {frozenset(w[i:] for w in have if w.startswith(p)) for v in have for i in range(len(v) + 1) for p in [v[:i]]}
    assert suffixes and len(lexicon.final) == len(ends)
    assert wordbpe.Lexicon(wordbpe.Lexicon.compile({})).find("a") is None


def token_rows():
    return odd_rows() + [(100 + i, t, "en", "a") for i, t in enumerate(ODD_TEXTS)]


@pytest.mark.parametrize("size", [0, 5, 10_000])
def test_bpe_report_equals_the_library(spark, size):
    rows, library = token_rows(), Tokenizer.from_file(PATH)
    docs = frame(spark, rows, extra=True)
    lexicon = bpe.build_lexicon(docs, PATH, Scratch(spark, "t"), size) if size else wordbpe.Lexicon.compile({})
    expected = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(docs, PATH, lexicon).collect()), key=key) == sorted(expected, key=key)
    decoded = bpe.decode(bpe.encode(docs, PATH, lexicon), PATH).collect()
    assert sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in decoded if r["doc_id"] is not None) == sorted((e[0], e[3]) for e in expected if e[0] is not None)


def test_bpe_counts_all_pieces(spark):
    rows = token_rows()
    own = wordbpe.WordBpe(PATH)
    expected = {}
    for _, t, *_ in rows:
        for p in own.pieces(t or ""):
            expected[p] = expected.get(p, 0) + 1
    assert {r["piece"]: r["n"] for r in bpe.piece_counts(frame(spark, rows).repartition(3), PATH).collect()} == expected
    assert bpe.report(frame(spark, []), PATH, Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("size", [0, 1, 40, 10**6])
def test_lexicon_has_the_most_frequent_pieces(spark, size):
    docs, scratch = frame(spark, token_rows()), Scratch(spark, "t")
    counts = scratch.keep(bpe.piece_counts(docs, PATH), "counts")
    chosen = {r[0] for r in bpe.frequent_pieces(counts, size).collect()}
    n = {r["piece"]: r["n"] for r in counts.collect()}
    assert len(chosen) <= size and (size < 10**6 or chosen == {p for p in n if len(p.encode()) <= bpe.PIECE_BYTES})
    assert min([n[p] for p in chosen], default=0) >= max([v for p, v in n.items() if p not in chosen and len(p.encode()) <= bpe.PIECE_BYTES], default=0) or not chosen


@pytest.mark.parametrize("trial", range(12))
def test_huffman_round_trip(trial):
    rng = np.random.default_rng(trial)
    size = [1, 2, 3, 50, 3000, 40_000][trial % 6]
    counts = rng.zipf(1.2, size) % (1 << 40)
    counts[0] += 1
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= huffman.LONGEST and (lengths[counts > 0] > 0).all()
    assert size == 1 or sum(2.0 ** -lengths[lengths > 0].astype(float)) == pytest.approx(1)
    codes, blocks, wanted = huffman.canonical_codes(lengths), [], []
    for n in [0, 1, 255, 256, 257, 5000]:
        ids = rng.choice(np.flatnonzero(counts), n).astype(np.uint16)
        bits, marks = huffman.pack(ids, lengths, codes)
        blocks.append((bits, marks.tobytes(), n))
        wanted.append(ids.tolist())
    assert [x.tolist() for x in huffman.unpack(blocks, huffman.decoding_table(lengths))] == wanted


def test_huffman_lengths_are_optimal():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 60)
    heap, cost = list(counts.tolist()), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((counts * huffman.code_lengths(counts)).sum()) == cost


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(huffman, "PART_BYTES", 2000)
    monkeypatch.setattr(huffman, "BLOCK", 500)
    rows, library = token_rows(), Tokenizer.from_file(PATH)
    scratch = Scratch(spark, "t")
    got = huffman.report(frame(spark, rows, extra=True).repartition(3), PATH, f"{scratch.root}/files", scratch)
    coded = sorted(((-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in rows), key=lambda x: x[0])
    expected, start = [], 0
    for i, ids in coded:
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == sorted(expected)
    back = {r["start"]: r["ids"] for r in huffman.read_ids(spark, f"{scratch.root}/files").collect()}
    assert back == {e[1]: c[1] for e, c in zip(expected, coded)}
    other = Scratch(spark, "t")
    assert huffman.report(frame(spark, []), PATH, f"{other.root}/files", other).count() == 0


# Shards


def test_store(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000, fan_in=3)
    rng, expected = random.Random(6), []
    for a in range(4):
        rows = [(i, prose(rng, 50), "en", "a", 1) for i in range(a * 100, a * 100 + 100)] + [(None, None, None, None, None)] * 2
        expected += rows
        store.append(spark.createDataFrame(rows, SCHEMA).repartition(5))
    before = store.manifest()
    assert before.version == 4 and len(before.shards) == 20
    after = store.compact()
    assert len(after.shards) < 8 and sum(s.rows for s in after.shards) == 408
    assert all(s.bytes <= 60_000 * 1.2 for s in after.shards)
    assert sorted(map(tuple, store.read().collect()), key=key) == sorted(expected, key=key)
    assert sorted(map(tuple, store.read(4).collect()), key=key) == sorted(expected, key=key)  # an old version stays readable
    assert store.vacuum() == 20 and sorted(map(tuple, store.read().collect()), key=key) == sorted(expected, key=key)
    assert store.compact().version == after.version  # nothing left to do
    with pytest.raises(sharding.CommitConflict):
        store.commit(after)
    with pytest.raises(ValueError):
        store.append(spark.range(3))
    store.append(spark.createDataFrame([], SCHEMA))
    assert store.read().count() == 408


def test_store_report(spark, tmp_path):
    rows = odd_rows()
    got = sharding.report(frame(spark, rows).repartition(6), f"file://{tmp_path}/s").collect()
    expected = [(i, lang, s, None if t is None else len(t), None if t is None else len(t.encode()), None if t is None else hashlib.md5(t.encode()).hexdigest()) for i, t, lang, s in rows]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


# The pipeline


def test_pipeline_stages_equal_plain_versions(spark, tmp_path):
    from tests.llm.test_linededup import naive as naive_lines
    from tests.llm.test_neardup import naive_components

    rows, items = contaminated_rows()
    rows = [r for r in quality_rows() + rows if r[0] is not None and r[0] != 6]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        got = {r["doc_id"]: r for r in out.collect()}
        assert k == 4 or out.columns == docs.columns
        if k == 0:
            assert set(got) == {e[0] for e in naive_quality(seen) if e[-1]}
        if k == 1:
            gone = {(a, b) for a, b, *_, kept in naive_lines(seen) if not kept}
            assert {i: r["text"] for i, r in got.items()} == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t, *_ in seen}
        if k == 2:
            assert set(got) == {i for i, c in naive_components(seen) if i == c}
        if k == 3:
            assert set(got) == {r[0] for r in naive_hits(seen, items) if not r[-1]}
        if k == 4:
            library = Tokenizer.from_file(PATH)
            assert {i: r["ids"] for i, r in got.items()} == {i: library.encode(t, add_special_tokens=False).ids for i, t, *_ in seen}
        else:
            seen = [(i, r["text"], r["lang"], r["source"]) for i, r in got.items()]
        docs = out
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["ids"] for r in ran} == {i: r["ids"] for i, r in got.items()}
