"""The search pipeline: candidates, fusion, expansion, reranking, hydration and point lookup."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import matches
from lodestone.models import Embedder, Expander, Reranker, rerank_document
from lodestone.operators import fusion, lexical, output, postings, vectors
from lodestone.plans.hydrate import path_diagnostics
from lodestone.operators.topology import chunk_children, chunk_parents, chunk_siblings, chunk_symbols, parent_context, range_label, summaries, without_repeated_parents
from lodestone.options import Options, parse
from lodestone.session import shared_dir
from lodestone.sources.store import IndexStore


@dataclass
class Index:
    """chunks (id, path, kind, byte_start, byte_end, line_start, line_end, text, language), vectors (id, embedding), symbols, sources (path, text).

    With postings and lexical_docs (see ``operators.postings``) the lexical half reads these, else the chunks' texts.
    dimensions are those of the run; diagnostics (path, message) are its files'; notes says what else there is to say.
    """

    chunks: DataFrame
    vectors: DataFrame
    symbols: DataFrame
    sources: DataFrame
    postings: DataFrame | None = None
    lexical_docs: DataFrame | None = None
    dimensions: int | None = None
    diagnostics: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def stored_index(store: IndexStore, sources: DataFrame, notes: list[str] | None = None) -> Index:
    """The active run of a store."""
    record = store.metadata() or {"metadata": {}}
    said = store.table("diagnostics").select("path", "message").unionByName(store.skipped().select("path", "message"))
    return Index(store.table("chunks"), store.table("vectors"), store.table("symbols"), sources, store.table("postings"), store.table("lexical_docs"), record["metadata"].get("dimensions"), said, list(notes or ()))


@dataclass
class Answer:
    """results is lazily built; the other fields say how it came about.

    status: candidate_count (fused), filtered_count (of the top k, below the least score), best_score (of all
    candidates), incomplete.
    """

    results: DataFrame
    mode: str
    diagnostics: list[str] = field(default_factory=list)
    hyde: bool = False
    status: dict = field(default_factory=dict)


CAPPED = "vector search was capped before the path filter was satisfied; narrow the query or the paths"


def _lexical(index: Index, query: str, k: int, where: Column | None) -> DataFrame:
    """(id, score) by BM25, from the stored postings if there are any."""
    if index.postings is not None:
        return postings.search(index.postings, index.lexical_docs, query, k, where).select("id", "score")
    texts = postings.search_text(index.chunks, chunk_symbols(index.chunks, index.symbols))
    found = lexical.bm25(texts.select(F.col("id").alias("path"), F.col("search_text").alias("text")), lexical.parse_or_fallback(query)).withColumnRenamed("path", "id")
    if where is not None:
        found = found.join(index.chunks.filter(where).select("id"), "id", "left_semi")
    return found.orderBy(F.desc("score"), "id").limit(k)


def search(index: Index, query: str, embedder: Embedder | None, options: Options | None = None, paths: list[str] | None = None, k: int | None = None, expander: Expander | None = None, reranker: Reranker | None = None, include_parents: bool = False, shortlists: bool = False) -> Answer:
    """Ranked chunks for a query.

    Candidates are at most a few hundred rows, written out once (checkpoint) where a later step has to look
    at them; wide columns are joined after the top k. With shortlists vectors are searched by growing
    shortlists of the nearest by distance, which can leave a path filter incomplete; else exactly.
    """
    options = options or parse(None)
    shared_dir(index.chunks.sparkSession)
    k = options["topK"] if k is None else k
    chunks, said, capped = index.chunks, list(index.notes), False
    budget = fusion.budgets(k, options.hybrid, options["rerankCandidateMultiplier"] if reranker else None, options["vectorCandidateMultiplier"], options["bm25CandidateMultiplier"], 3, options["maxVectorCandidates"], options["maxRerankCandidates"])
    where = matches(F.col("path"), paths) if paths else None

    def nearest(text: str) -> DataFrame:
        nonlocal capped
        asked = [float(x) for x in embedder.embed_batch([text])[0]]
        if not vectors.valid(asked, index.dimensions):
            return none
        if shortlists:
            placed = index.vectors if where is None or "path" in index.vectors.columns else index.vectors.join(chunks.select("id", "path"), "id")
            found, short = vectors.search_in_rounds(placed, asked, budget.vector, where)
            capped = capped or short
            return found
        rows = index.vectors if where is None else index.vectors.join(chunks.filter(where).select("id"), "id", "left_semi")
        return vectors.top_cosine(rows, asked, budget.vector)

    none = chunks.select("id", F.lit(0.0).alias("score")).filter(F.lit(False))
    near, hyde = (nearest(query) if embedder else none).checkpoint(), False
    if embedder and expander:
        best = near.agg(F.max("score")).first()[0]
        if fusion.needs_expansion(best, options["hydeThreshold"]):
            try:
                near, hyde = fusion.merge_best(near, nearest(expander.generate(query))).checkpoint(), True
            except Exception as error:  # the query's own candidates stand
                said.append(f"HyDE failed: {error}")
    words = _lexical(index, query, budget.lexical, where).checkpoint() if options.hybrid and query.strip() else none
    fused = fusion.fuse(near, words, options["rrfK"], budget.ranking, options["vectorWeight"], options["bm25Weight"]).checkpoint()
    mode = "hybrid" if not words.isEmpty() else "vector"
    ranked = fused.withColumn("final_score", F.col("score"))
    if reranker:
        order = fusion.ranked(fused)
        documents = order.join(chunks, "id").select("rank", rerank_document().alias("document")).orderBy("rank").collect()  # at most maxRerankCandidates
        try:
            response = [(i, index_, float(score)) for i, (index_, score) in enumerate(reranker.rerank(query, [d["document"] for d in documents]))]
            answer = fused.sparkSession.createDataFrame(response, "position int, index int, relevance double")
            ranked = fused.join(fusion.rerank(order.select("id", "score", "rank"), answer), "id").withColumn("score", -F.col("final_rank").cast("double"))
        except Exception as error:
            said.append(f"Rerank failed: {error}")
    best = ranked.orderBy(F.desc("score"), "id").limit(k)
    least = F.col("final_score") >= max(0.0, options["minFinalScore"])
    counted = fusion.status_counts(best.select(F.col("final_score").alias("score")), options["minFinalScore"]).first()
    status = {"candidate_count": fused.count(), "filtered_count": counted["filtered"], "best_score": ranked.agg(F.max("final_score")).first()[0], "incomplete": capped}
    if paths and capped:
        said.append(CAPPED)
    if index.diagnostics is not None:
        said += [r[0] for r in path_diagnostics(index.diagnostics, where).orderBy("message").limit(MOST_SAID).collect()]
    initial = near.select("id", F.col("score").alias("vector_score"))
    top = best.filter(least).join(initial, "id", "left").withColumn("initial_score", F.coalesce("vector_score", "final_score")).drop("vector_score")
    top = fusion.ranked(top).withColumn("score", F.col("final_score")).checkpoint()
    hits = chunks.join(F.broadcast(top), "id")
    files = hits.select("path").distinct()
    near_chunks = chunks.join(F.broadcast(files), "path", "left_semi")  # at most k files
    near_symbols = index.symbols.join(F.broadcast(files), "path", "left_semi")
    results = hits.withColumn("range", range_label()).join(summaries(near_chunks, near_symbols).drop("range_label"), "id")
    if include_parents:
        context = parent_context(near_chunks, near_symbols, index.sources.join(F.broadcast(files), "path", "left_semi"), options["maxContextChars"])
        results = without_repeated_parents(results.join(context.drop("breadcrumbs"), "id"))
    return Answer(results.orderBy("rank"), mode, output.distinct_strings(said), hyde, status)


#: Diagnostics of files that an answer names, and the length of a text where none is given.
MOST_SAID, TEXT = 1000, 12_000


def lookup(index: Index, chunk_id: str, offset: int = 0, limit: int = 20, max_chars: int | None = None, parent: bool = True, siblings: bool = True, with_children: bool = True) -> dict:
    """A chunk with its parent, siblings and a page of its children, each unless it is not wanted.

    Texts around are cut to max_chars; the chunk's own only where no length is given, and then to ``TEXT``.
    """
    target = index.chunks.filter(F.col("id") == chunk_id).limit(1).collect()
    if not target:
        return {"chunk": None, "diagnostics": [f"chunk not found: {chunk_id}"]}
    own = index.chunks.filter(F.col("path") == target[0]["path"])
    symbols = index.symbols.filter(F.col("path") == target[0]["path"])
    parents, around = chunk_parents(own), chunk_symbols(own, symbols)
    row = parents.join(chunk_siblings(own, parents, around), "id").join(chunk_children(own, parents), "id", "left").filter(F.col("id") == chunk_id).first()
    children = list(row["child_ids"] or []) if with_children else []
    row = {**row.asDict(), **({} if parent else {"parent_id": None}), **({} if siblings else {"previous_id": None, "next_id": None})}
    offset, limit = max(0, offset), max(0, limit)
    page = children[offset : offset + limit]
    wanted = [i for i in (row["parent_id"], row["previous_id"], row["next_id"], *page) if i]
    related = {r["id"]: r["text"][: TEXT if max_chars is None else max_chars] for r in own.filter(F.col("id").isin(wanted)).select("id", "text").collect()}
    return {
        "chunk": {**target[0].asDict(), "text": target[0]["text"][:TEXT] if max_chars is None else target[0]["text"]}, "parent": related.get(row["parent_id"]), "previous": related.get(row["previous_id"]), "next": related.get(row["next_id"]),
        "children": [related[i] for i in page if i in related], "children_page": {"offset": offset, "limit": limit, "total": len(children), "has_more": offset + len(page) < len(children)}, "diagnostics": [],
    }
