"""Chunk topology: symbols of chunks, parents, children, siblings, labels and context.

Chunks have (id, path, kind, byte_start, byte_end, line_start, line_end, text), symbols (id, path, kind,
name, byte_start, byte_end); ranges don't end before they start. Both are dealt out by the file once and
sorted, and one sweep of each file, whose size the scan limits, finds all that its chunks have to do with
one another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Children in a summary, and the label's length with and without its ellipsis.
CHILDREN, LABEL, CUT = 20, 80, 77
#: Rows of a sweep in their order at one start, and chunks that leave it together.
SYMBOL, CHUNK, ADRIFT = range(3)
SWEPT = 16_384

SYMBOLS = "array<struct<start: bigint, minus_end: bigint, id: string, kind: string, name: string>>"
#: What a sweep can tell of a chunk.
RELATIONS = {
    **dict.fromkeys(["parent_id", "previous_id", "next_id", "label", "parent_label", "previous_label", "next_label"], "string"),
    **dict.fromkeys(["child_ids", "child_labels"], "array<string>"),
    "symbols": SYMBOLS,
}


def _files(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each file's rows; path, the first, is sorted."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False).tolist() if not c.null_count or pa.types.is_string(c.type) else c.to_pylist() for c in batch.columns]
        paths = columns[0]
        bounds = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
        for a, b in pairwise(bounds):
            part = [c[a:b] for c in columns]
            if held and held[0][0] == part[0][0]:
                for own, more in zip(held, part):
                    own += more
                continue
            if held:
                yield held
            held = part
    if held:
        yield held


def _related(path: str | None, tags: list, starts: list, minus_ends: list, ids: list, kinds: list, names: list, wanted: set[str]) -> tuple[list[int], dict[str, list]]:
    """The rows that are chunks, and what is wanted of each, from a file's rows by start, tag, minus_end, id, kind and name."""
    chunks, around, above = [], [], [-1] * len(ids)
    active, stack, groups, below = [], [], {}, {}
    for i, (tag, start, minus_end) in enumerate(zip(tags, starts, minus_ends)):
        if tag == SYMBOL:
            active.append(i)
            continue
        chunks.append(i)
        if tag == ADRIFT:
            around.append([])
            continue
        own = [a for a in active if minus_ends[a] <= minus_end]
        if len(own) < len(active):
            active = [a for a in active if -minus_ends[a] >= start]
        around.append(own)
        # What ends before this chunk starts no later, so of what follows this one contains all that it would.
        while stack and minus_ends[stack[-1]] > minus_end:
            stack.pop()
        if stack and starts[stack[-1]] == start and minus_ends[stack[-1]] == minus_end:
            above[i] = above[stack[-1]]
            stack[-1] = i  # of equal ranges the greatest id is the parent
        else:
            above[i] = stack[-1] if stack else -1
            stack.append(i)
        below.setdefault(above[i], []).append(i)
        groups.setdefault((above[i], ids[own[-1]] if own else None), []).append(i)
    before, after = {}, {}
    for group in groups.values():
        group.sort(key=lambda i: (starts[i], -minus_ends[i], ids[i]))
        for a, b in pairwise(group):
            after[a], before[b] = b, a
    near = {"parent": above, "previous": [before.get(i, -1) for i in range(len(ids))], "next": [after.get(i, -1) for i in range(len(ids))]}
    below.pop(-1, None)
    out = {f"{k}_id": [ids[v[i]] if v[i] >= 0 else None for i in chunks] for k, v in near.items() if f"{k}_id" in wanted}
    if "child_ids" in wanted:
        out["child_ids"] = [[ids[j] for j in below.get(i, ())] for i in chunks]
    if "symbols" in wanted:
        out["symbols"] = [[(starts[a], minus_ends[a], ids[a], kinds[a], names[a]) for a in own] for own in around]
    if any(w.endswith(("label", "labels")) for w in wanted):
        label = dict(zip(chunks, (_label(path, kinds[i], names[i], own, starts, starts[i], -minus_ends[i], kinds, names) for i, own in zip(chunks, around))))
        out |= {"label": [label[i] for i in chunks], "child_labels": [[label[j] for j in below.get(i, ())[:CHILDREN]] for i in chunks]}
        out |= {f"{k}_label": [label[v[i]] if v[i] >= 0 else None for i in chunks] for k, v in near.items()}
    return chunks, out


def _label(path: str | None, kind: str | None, line: str | None, around: list[int], starts: list, start: int, end: int, kinds: list, names: list) -> str | None:
    """As in ``labels``, from a chunk's line_label."""
    if kind == "file":
        return None if path is None else f"file {path}"
    local = next((a for a in reversed(around) if start <= starts[a] <= end), None)
    if local is None and line is not None:
        return line
    if local is None and not around:
        return " ".join(x for x in (kind, "chunk") if x is not None)
    of = around[-1] if local is None else local
    return " ".join(x for x in (kinds[of], names[of]) if x is not None)


def relations(chunks: DataFrame, symbols: DataFrame | None, wanted: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """(id, then the wanted ones of RELATIONS, then the carried columns of chunks), by one exchange of chunks and symbols.

    Symbols are those around a chunk, from the outermost in. The parent is the nearest chunk of the file
    that strictly contains it; children are by start, widest first; siblings are those of one parent and
    innermost symbol, by start, shortest first. A chunk without a file or range has none of them.
    """
    labelled = any(w.endswith(("label", "labels")) for w in wanted)
    placed = F.col("path").isNotNull() & F.col("byte_start").isNotNull() & F.col("byte_end").isNotNull()
    start, minus_end = F.coalesce(F.col("byte_start").cast("long"), F.lit(0)), F.coalesce(-F.col("byte_end").cast("long"), F.lit(0))
    kind, name = (F.col("kind"), F.col("line_label")) if labelled else (F.lit(None).cast("string"),) * 2
    types = dict(chunks.select(*carried).dtypes)
    rows = (with_line_label(chunks) if labelled else chunks).select("path", F.when(placed, CHUNK).otherwise(ADRIFT).alias("tag"), start.alias("start"), minus_end.alias("minus_end"), "id", kind.alias("kind"), name.alias("name"), *[F.col(c).alias(f"_{c}") for c in carried])
    if symbols is not None:
        nothing = [F.lit(None).cast(t).alias(f"_{c}") for c, t in types.items()]
        whole = symbols.filter(placed & F.col("id").isNotNull())
        rows = rows.unionByName(whole.select("path", F.lit(SYMBOL).alias("tag"), start.alias("start"), minus_end.alias("minus_end"), "id", "kind", "name", *nothing))
    columns = {"id": "string"} | {w: RELATIONS[w] for w in wanted} | types
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    arrow = [f.type for f in chunks.sparkSession.createDataFrame([], schema).toArrow().schema]

    def batch(found: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_array(found[c], t) for c, t in zip(columns, arrow)], list(columns))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {c: [] for c in columns}
        for path, *own in _files(batches):
            at, told = _related(path[0], *own[:6], set(wanted))
            told |= {"id": [own[3][i] for i in at]} | {c: [values[i] for i in at] for c, values in zip(carried, own[6:])}
            for c in columns:
                found[c] += told[c]
            if len(found["id"]) >= SWEPT:
                yield batch(found)
                found = {c: [] for c in columns}
        yield batch(found)

    return rows.repartition("path").sortWithinPartitions("path", "start", "tag", "minus_end", "id", "kind", "name").mapInArrow(run, schema)


def _array(values: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    flat = [x for v in values for x in v]
    bounds = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
    if pa.types.is_struct(kind.value_type):
        fields = list(kind.value_type)
        flat = pa.StructArray.from_arrays([pa.array([x[n] for x in flat], f.type) for n, f in enumerate(fields)], fields=fields)
    else:
        flat = pa.array(flat, kind.value_type)
    return pa.ListArray.from_arrays(bounds, flat, type=kind)


def chunk_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, symbol_ids, breadcrumbs, symbols): the symbols around each chunk, from the outermost in."""
    found = relations(chunks, symbols, ["symbols"])
    return found.select("id", F.col("symbols.id").alias("symbol_ids"), breadcrumbs().alias("breadcrumbs"), "symbols")


def breadcrumbs() -> Column:
    return F.transform("symbols", lambda x: F.concat_ws(" ", x["kind"], x["name"]))


def chunk_parents(chunks: DataFrame) -> DataFrame:
    """(id, parent_id): the nearest chunk of the file that strictly contains each; null without one."""
    return relations(chunks, None, ["parent_id"])


def emitted_siblings(chunks: DataFrame) -> DataFrame:
    """(id, previous_id, next_id) in the order in which a file's chunks were made (ordinal)."""
    order = Window.partitionBy("path").orderBy("ordinal")
    return chunks.select("id", F.lag("id").over(order).alias("previous_id"), F.lead("id").over(order).alias("next_id"))


def chunk_children(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, child_ids) of chunks with children, by start, widest first."""
    own = chunks.select("id", "byte_start", "byte_end").join(parents.filter("parent_id is not null"), "id")
    return own.groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("byte_start", (-F.col("byte_end")).alias("e"), "id"))).alias("c")).select(F.col("parent_id").alias("id"), F.col("c.id").alias("child_ids"))


def chunk_siblings(chunks: DataFrame, parents: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, previous_id, next_id) among chunks of one file, parent and innermost symbol. symbols: from chunk_symbols."""
    inner = F.try_element_at("symbol_ids", F.lit(-1))
    rows = chunks.select("id", "path", "byte_start", "byte_end").join(parents, "id").join(symbols.select("id", inner.alias("inner")), "id")
    order = Window.partitionBy("path", "parent_id", "inner").orderBy("byte_start", "byte_end", "id")
    return rows.select("id", F.lag("id").over(order).alias("previous_id"), F.lead("id").over(order).alias("next_id"))


def child_page(children: DataFrame, offset: int, limit: int) -> DataFrame:
    """(id, page, total, has_more) of (id, child_ids); offset and limit are at least 0."""
    offset, limit = max(0, offset), max(0, limit)
    page = F.slice("child_ids", offset + 1, limit)
    return children.select("id", page.alias("page"), F.size("child_ids").cast("long").alias("total"), (F.lit(offset) + F.size(page) < F.size("child_ids")).alias("has_more"))


def range_label() -> Column:
    one = F.col("line_start") == F.col("line_end")
    return F.concat(F.col("path"), F.lit(":"), F.col("line_start").cast("string"), F.when(one, "").otherwise(F.concat(F.lit("-"), F.col("line_end").cast("string"))))


def with_line_label(chunks: DataFrame) -> DataFrame:
    """Chunks with line_label, the label by the kind and the first line that isn't blank; null without such a line.

    That line is without leading , and ; and cut to the label's length. Each step is a column of its own,
    as what is named twice in one expression is worked out twice.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(F.regexp_replace(F.btrim(x, F.lit(" \t\r")), "^[,;]+", ""), F.lit(" \t\r"))), lambda x: x != "")
    line = F.col("line_label")
    cut = F.when(F.length(line) > LABEL, F.concat(F.substring(line, 1, CUT), F.lit("..."))).otherwise(line)
    bare = F.when(F.col("kind") == "function", F.regexp_replace(line, "^(?:async function )?(?:function )?", "")).otherwise(
        F.when(line.startswith(F.concat(F.col("kind"), F.lit(" "))), F.substring(line, F.length("kind") + 2, F.length(line))).otherwise(line)
    )
    found = chunks.withColumn("line_label", F.get(lines, F.lit(0))).withColumn("line_label", cut)
    return found.withColumn("line_label", F.when(line.isNotNull(), F.concat_ws(" ", "kind", bare)))


def labels(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, label, range_label): by the file, the innermost symbol that begins in the chunk, the first line, or the innermost symbol."""
    rows = with_line_label(chunks).join(symbols.select("id", "symbols"), "id", "left")
    inward = F.reverse("symbols")
    local = F.get(F.filter(inward, lambda s: (s["start"] >= F.col("byte_start")) & (s["start"] <= F.col("byte_end"))), F.lit(0))
    around = F.get(inward, F.lit(0))
    label = (
        F.when(F.col("kind") == "file", F.concat(F.lit("file "), F.col("path")))
        .when(local.isNotNull(), F.concat_ws(" ", local["kind"], local["name"]))
        .when(F.col("line_label").isNotNull(), F.col("line_label"))
        .when(around.isNotNull(), F.concat_ws(" ", around["kind"], around["name"]))
        .otherwise(F.concat_ws(" ", "kind", F.lit("chunk")))
    )
    return rows.select("id", label.alias("label"), range_label().alias("range_label"))


def summaries(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, label, range_label, parent_label, previous_label, next_label, child_labels, breadcrumbs): neighbours that are missing are null."""
    neighbours = ["label", "parent_label", "previous_label", "next_label", "child_labels"]
    found = relations(chunks, symbols, [*neighbours, "symbols"], ["path", "line_start", "line_end"])
    return found.select("id", "label", range_label().alias("range_label"), *neighbours[1:], breadcrumbs().alias("breadcrumbs"))


def parent_context(chunks: DataFrame, symbols: DataFrame, sources: DataFrame, budget: int) -> DataFrame:
    """(id, breadcrumbs, parent_text, parent_start, parent_end): the text of the outermost symbol.

    One longer than the budget gives its breadcrumb and the chunk's own text, cut to the budget. sources
    has (path, text); chunks without a symbol have null.
    """
    own = chunk_symbols(chunks, symbols)
    outer = F.get("symbols", F.lit(0))
    rows = chunks.select("id", "path", F.col("text").alias("own_text")).join(own, "id").join(sources.select("path", F.col("text").alias("source")), "path", "left")
    start, end = outer["start"], -outer["minus_end"]
    whole = F.decode(F.substring(F.encode("source", "UTF-8"), start.cast("int") + 1, (end - start).cast("int")), "UTF-8")
    short = F.substring(F.concat(F.get("breadcrumbs", F.lit(0)), F.lit("\n"), F.regexp_replace("own_text", r"[ \t\r\n]+$", "")), 1, budget)
    return rows.select("id", "breadcrumbs", F.when(outer.isNotNull(), F.when(F.length(whole) <= budget, whole).otherwise(short)).alias("parent_text"), start.alias("parent_start"), end.alias("parent_end"))


def without_repeated_parents(results: DataFrame) -> DataFrame:
    """Results (path, rank, parent_start, parent_end, parent_text): a parent range that a better result of the file has shown is null."""
    order = Window.partitionBy("path", "parent_start", "parent_end").orderBy("rank")
    again = F.row_number().over(order) > 1
    return results.select(*[F.when(~again, F.col(c)).alias(c) if c in ("parent_start", "parent_end", "parent_text") else F.col(c) for c in results.columns])
