"""Chunking: source index, line chunks, structural chunks, parsers and symbols.

What is sequential or recursive runs in one Python function for each file, within an Arrow-batched map;
a file is a row, so a partition needs memory for one file at a time. Offsets are UTF-8 bytes, half open;
lines count from 1.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as ECMAScript has it; the chunk budget; the least size of a meaningful chunk.
SPACES = frozenset("\t\n\x0b\x0c\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B))))
BUDGET, MIN_MEANING = 2000, 8
#: Bytes of groups of lines that leave together.
GROUPED = 4 << 20
SPACE_CODES = np.array(sorted(map(ord, SPACES)), np.uint32)


@dataclass(frozen=True)
class Node:
    """A named syntax node with its byte range."""

    type: str
    start: int
    end: int
    children: tuple[Node, ...] = ()


class Source:
    """A text with prefix sums of its non-white characters, and its line starts, by byte offset."""

    def __init__(self, text: str):
        self.text, self.bytes = text, text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(self.bytes, np.uint8)
        self.lines = [0, *(np.flatnonzero(data == 10) + 1).tolist()]
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        count = np.cumsum(~np.isin(codes, SPACE_CODES))
        # A byte counts what its character does, so a character's first byte brings its weight.
        self.solid = np.concatenate([[0], count[np.cumsum((data & 0xC0) != 0x80) - 1]]) if len(data) else np.zeros(1, np.int64)

    def part(self, start: int, end: int) -> str:
        return self.bytes[start:end].decode("utf-8", "replace")

    def weight(self, start: int, end: int) -> int:
        return int(self.solid[max(start, end)] - self.solid[start])

    def line_range(self, start: int, end: int) -> tuple[int, int]:
        first = bisect_right(self.lines, start)
        part = self.bytes[start:end]
        return first, first + part.removesuffix(b"\n").count(b"\n")


@dataclass
class Window:
    """A chunk to be: byte range, node types, and the bounds of the node that it was split from."""

    start: int
    end: int
    types: list[str] = field(default_factory=list)
    kind: str | None = None
    bounds: tuple[int, int] | None = None
    own: tuple[int, int] | None = None

    def joined(self, other: Window) -> Window:
        bounds = self.bounds or other.bounds
        if bounds and not (bounds[0] <= self.start and other.end <= bounds[1]):
            bounds = None
        return Window(self.start, other.end, self.types + other.types, self.kind or other.kind, bounds)


def line_windows(source: Source, start: int, end: int, budget: int) -> list[Window]:
    """Greedy packing of lines up to the budget; a line over the budget is cut between characters."""
    pieces: list[tuple[int, int, int]] = []
    edges = [start, *source.lines[bisect_right(source.lines, start) : bisect_left(source.lines, end)], end]
    totals = source.solid[edges].tolist()
    for a, b, low, high in zip(edges, edges[1:], totals, totals[1:]):
        # Cut before each character that would be one too many.
        cuts = (np.searchsorted(source.solid, np.arange(low + budget + 1, high + 1, budget)) - 1).tolist() if high - low > budget else []
        for begin, stop in zip([a, *cuts], [*cuts, b]):
            if begin < stop:
                pieces.append((begin, stop, source.weight(begin, stop)))
    out: list[Window] = []
    total = 0
    for a, b, weight in pieces:
        if out and total + weight <= budget:
            out[-1].end, total = b, total + weight
        else:
            out.append(Window(a, b, kind="fallback"))
            total = weight
    return out


class Chunker:
    """Splits a syntax tree and merges neighbours, within a budget of non-white characters."""

    def __init__(self, source: Source, budget: int, overlap: int = 0, meaning: int = MIN_MEANING):
        self.source, self.budget, self.overlap, self.meaning = source, budget, overlap, meaning

    def fits(self, start: int, end: int) -> bool:
        return self.source.weight(start, end) <= self.budget

    def windows(self, root: Node) -> list[Window]:
        whole = len(self.source.bytes)
        if self.fits(0, whole):
            return [Window(root.start, root.end, [root.type], "file")]
        if not root.children:
            return line_windows(self.source, 0, whole, self.budget)
        return self.overlapped(self.meaningful(self.packed(root.children, None)))

    def packed(self, nodes: tuple[Node, ...], bounds: tuple[int, int] | None) -> list[Window]:
        """Runs of siblings that fit; a node too large is split, and what waited before it joins its first part if that fits."""
        out: list[Window] = []
        waiting: list[Node] = []

        def flush() -> list[Window]:
            made = [Window(waiting[0].start, waiting[-1].end, [n.type for n in waiting])] if waiting else []
            waiting.clear()
            return made

        for node in nodes:
            if self.fits(node.start, node.end):
                if waiting and not self.fits(waiting[0].start, node.end):
                    out += flush()
                waiting.append(node)
                continue
            before, parts = flush(), self.split(node)
            if before and parts and self.fits(before[0].start, parts[0].end):
                before, parts = [], [before[0].joined(parts[0]), *parts[1:]]
            out += before + parts
        return out + flush()

    def split(self, node: Node) -> list[Window]:
        bounds = (node.start, node.end)
        if not node.children:
            return [replace(w, types=[node.type], bounds=bounds) for w in line_windows(self.source, node.start, node.end, self.budget)]
        merged: list[Window] = []
        for w in self.packed(node.children, bounds):
            if merged and self.fits(merged[-1].start, w.end):
                merged[-1] = merged[-1].joined(w)
            else:
                merged.append(w)
        return [replace(w, bounds=w.bounds or bounds) for w in merged]

    def trivial(self, w: Window) -> bool:
        text = self.source.part(w.start, w.end).strip("".join(SPACES))
        return self.source.weight(w.start, w.end) < self.meaning or not re.search(r"[A-Za-z_$][A-Za-z0-9_$]*", text) or not any(c.isalnum() for c in text)

    def meaningful(self, windows: list[Window]) -> list[Window]:
        """Trivial windows join the one before, or else the next, where the budget allows."""
        out: list[Window] = []
        i = 0
        while i < len(windows):
            w = windows[i]
            i += 1
            if not self.trivial(w):
                out.append(w)
            elif out and self.fits(out[-1].start, w.end):
                out[-1] = out[-1].joined(w)
            elif i < len(windows) and self.fits(w.start, windows[i].end):
                out.append(w.joined(windows[i]))
                i += 1
            else:
                out.append(w)
        return out

    def overlapped(self, windows: list[Window]) -> list[Window]:
        """Each window with its neighbours' text; its identity stays its own range."""
        if not self.overlap:
            return windows
        out = []
        for i, w in enumerate(windows):
            wide = reduce(Window.joined, windows[max(0, i - self.overlap) : i + 1 + self.overlap])
            inside = w.bounds and w.bounds[0] <= wide.start and wide.end <= w.bounds[1]
            out.append(replace(wide, own=(w.start, w.end), bounds=w.bounds if inside else None))
        return out


def kind_of(types: list[str]) -> str:
    return next((k for k in ("class", "method", "function") if any(k in t for t in types)), "block")


# Parsers: (language, text) -> root node, or None without a grammar


def python_tree(text: str) -> Node | None:
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    starts = [0]
    for line in text.encode("utf-8").split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)

    def of(node: ast.stmt, inside_class: bool) -> Node:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        start = starts[first - 1] + (node.col_offset if first == node.lineno else 0)
        end = starts[node.end_lineno - 1] + node.end_col_offset
        if isinstance(node, ast.ClassDef):
            kind, body = "class_definition", node.body
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind, body = "method_definition" if inside_class else "function_definition", node.body
        else:
            kind, body = re.sub(r"(?<!^)(?=[A-Z])", "_", type(node).__name__).lower(), getattr(node, "body", [])
        children = [of(n, isinstance(node, ast.ClassDef)) for n in body if isinstance(n, ast.stmt)] if isinstance(body, list) else []
        return Node(kind, start, end, tuple(children))

    return Node("module", 0, len(text.encode("utf-8")), tuple(of(n, False) for n in module.body))


VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


def html_tree(text: str) -> Node:
    """Elements with their tags, texts, entities and comments; an end tag closes what is open above its start tag, and the end of text all."""
    starts, size = [0], len(text.encode("utf-8", "surrogatepass"))
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    to_byte = [0, *np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).tolist()]
    stack: list[list] = [["document", 0, []]]

    def leaf(kind: str, at: int, end: int) -> Node:
        return Node(kind, to_byte[at], to_byte[min(end, len(text))])

    def after(piece: str, at: int) -> int:
        found = text.find(piece, at)
        return len(text) if found < 0 else found + len(piece)

    class Parser(HTMLParser):
        def here(self) -> int:
            line, column = self.getpos()
            return min(starts[line - 1] + column, len(text))

        def handle_starttag(self, tag, attrs):
            at, width = self.here(), len(self.get_starttag_text() or "")
            if tag in VOID_TAGS:
                stack[-1][2].append(Node("element", to_byte[at], to_byte[min(at + width, len(text))]))
            else:
                stack.append([tag, to_byte[at], [leaf("start_tag", at, at + width)]])

        def handle_startendtag(self, tag, attrs):
            at = self.here()
            stack[-1][2].append(Node("element", to_byte[at], to_byte[min(at + len(self.get_starttag_text() or ""), len(text))]))

        def handle_data(self, data):
            at = self.here()
            if data.strip():
                stack[-1][2].append(Node("text", to_byte[at], to_byte[min(at + len(data), len(text))]))

        def handle_decl(self, decl):
            stack[-1][2].append(leaf("doctype", self.here(), after(">", self.here())))

        unknown_decl = handle_pi = handle_decl

        def handle_comment(self, data):
            at = self.here()
            stack[-1][2].append(leaf("comment", at, after("-->" if text.startswith("<!--", at) else ">", at + 2)))

        def handle_entityref(self, name):
            at, end = self.here(), self.here() + 1 + len(name)
            stack[-1][2].append(leaf("entity", at, end + (text[end : end + 1] == ";")))

        def handle_charref(self, name):
            at, end = self.here(), self.here() + 2 + len(name)
            stack[-1][2].append(leaf("entity", at, end + (text[end : end + 1] == ";")))

        def handle_endtag(self, tag):
            at = self.here()
            own = leaf("end_tag", at, after(">", at))
            if tag not in [s[0] for s in stack[1:]]:
                stack[-1][2].append(replace(own, type="erroneous_end_tag"))
                return
            end = own.end
            while True:
                name, start, children = stack.pop()
                if name == tag:
                    children = [*children, own]
                stack[-1][2].append(Node("script_element" if name == "script" else "style_element" if name == "style" else "element", start, end, tuple(children)))
                if name == tag:
                    return

    parser = Parser(convert_charrefs=False)
    parser.feed(text)
    parser.close()
    while len(stack) > 1:
        name, start, children = stack.pop()
        stack[-1][2].append(Node("element", start, size, tuple(children)))
    return Node("document", 0, size, tuple(stack[0][2]))


BRACE_TOKENS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[{};]", re.S)
BRACE_KINDS = (("class_declaration", re.compile(r"\b(?:class|struct|trait|impl|enum)\b")), ("interface_declaration", re.compile(r"\binterface\b")), ("function_declaration", re.compile(r"\b(?:function|func|fn)\b|=>\s*$|=\s*(?:async\s*)?\(")))


def brace_tree(text: str) -> Node:
    """Statements by their braces and semicolons; what a block's head says makes its type."""
    to_byte = [0]
    for c in text:
        to_byte.append(to_byte[-1] + len(c.encode("utf-8", "surrogatepass")))

    def trimmed(a: int, b: int) -> tuple[int, int]:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        return a, b

    stack: list[list] = [["program", 0, []]]
    begin = 0

    def leaf(end: int, into: list) -> None:
        a, b = trimmed(begin, end)
        if a < b:
            into.append(Node("statement", to_byte[a], to_byte[b]))

    for m in BRACE_TOKENS.finditer(text):
        c = m[0]
        if c == ";":
            leaf(m.end(), stack[-1][2])
            begin = m.end()
        elif c == "{":
            a, _ = trimmed(begin, m.end())
            head = text[a : m.start()]
            kind = next((k for k, p in BRACE_KINDS if p.search(head)), None)
            if kind is None:
                in_class = stack[-1][0] in ("class_declaration", "interface_declaration")
                kind = "method_definition" if in_class and re.search(r"[\w$]\s*\([^)]*\)[^()]*$", head) else "block"
            stack.append([kind, to_byte[a], []])
            begin = m.end()
        elif c == "}" and len(stack) > 1:
            leaf(m.start(), stack[-1][2])
            kind, start, children = stack.pop()
            stack[-1][2].append(Node(kind, start, to_byte[m.end()], tuple(children)))
            begin = m.end()
    leaf(len(text), stack[-1][2])
    while len(stack) > 1:
        kind, start, children = stack.pop()
        stack[-1][2].append(Node(kind, start, to_byte[-1], tuple(children)))
    return Node("program", 0, to_byte[-1], tuple(stack[0][2]))


def parse(language: str, text: str) -> Node | None:
    if language == "python":
        return python_tree(text)
    if language == "html":
        return html_tree(text)
    if language in ("javascript", "typescript", "tsx", "java", "go", "rust", "php"):
        return brace_tree(text)
    return None


# Symbols

_NAME = r"([^\W\d][\w$]*|[$_][\w$]*)"
TEST_CALL = re.compile(r"^\s*(?:test|it)\s*\(\s*([\"'`])((?:\\.|(?!\1)[^\\\n])*)\1")
PROPERTY = re.compile(rf"^\s*{_NAME}\s*:\s*(?:{_NAME}\s*\(|async\s+|function\b|\()")
SYMBOL_NAMES = {
    "class": [re.compile(rf"class\s+{_NAME}")],
    "interface": [re.compile(rf"interface\s+{_NAME}")],
    "method": [re.compile(rf"(?:async\s+)?(?:def\s+)?{_NAME}\s*\(")],
    "function": [PROPERTY, re.compile(rf"function\s+{_NAME}"), re.compile(rf"{_NAME}\s*=\s*(?:async\s+)?(?:function|\()"), re.compile(rf"(?:def|func|fn)\s+{_NAME}")],
}


def symbol_kind(node: Node, text: Callable[[], str]) -> str | None:
    if (node.type == "pair" or ("property" in node.type and "signature" not in node.type)) and PROPERTY.search(text()):
        return "function"
    if "call" in node.type and TEST_CALL.search(text()):
        return "function"
    return next((k for k in ("interface", "class", "method", "function") if k in node.type), None)


def symbol_name(kind: str, text: str) -> str:
    if kind == "function" and (m := TEST_CALL.search(text)):
        return "test " + re.sub(r"\\(.)", r"\1", m[2])
    return next((m[1] for p in SYMBOL_NAMES[kind] if (m := p.search(text))), "anonymous")


def symbols(path: str, source: Source, root: Node) -> list[dict]:
    """In preorder, each with the nearest symbol around it as parent."""
    out: list[dict] = []
    stack: list[tuple[Node, str | None]] = [(n, None) for n in reversed(root.children)]
    while stack:
        node, parent = stack.pop()
        kind = symbol_kind(node, lambda: source.part(node.start, node.end))
        if kind:
            name = symbol_name(kind, source.part(node.start, node.end))
            own = f"{path}:{kind}:{name}:{node.start}:{node.end}"
            first, last = source.line_range(node.start, node.end)
            out.append({"id": own, "path": path, "kind": kind, "name": name, "byte_start": node.start, "byte_end": node.end, "line_start": first, "line_end": last, "parent_id": parent})
            parent = own
        stack += [(n, parent) for n in reversed(node.children)]
    return out


# DataFrame forms

CHUNKS = "id string, path string, language string, kind string, ordinal int, byte_start long, byte_end long, line_start int, line_end int, text string, non_white int, node_types array<string>, diagnostic string"
SYMBOLS = "id string, path string, kind string, name string, byte_start long, byte_end long, line_start int, line_end int, parent_id string"


def chunks_of(path: str, language: str, text: str, budget: int = BUDGET, overlap: int = 0, meaning: int = MIN_MEANING, parser=parse) -> list[dict]:
    source, diagnostic = Source(text), None
    try:
        root = parser(language, text)
    except Exception as error:  # a broken parser makes plain text of the file
        root, language, diagnostic = None, "text", f"parse failed: {error}"
    if root is None:
        windows = line_windows(source, 0, len(source.bytes), budget)
    else:
        windows = Chunker(source, budget, overlap, meaning).windows(root)
    out = []
    for i, w in enumerate(windows):
        first, last = source.line_range(w.start, w.end)
        start, end = w.own or (w.start, w.end)
        out.append({
            "id": f"{path}:{start}:{end}", "path": path, "language": language, "kind": w.kind or kind_of(w.types), "ordinal": i, "byte_start": w.start, "byte_end": w.end,
            "line_start": first, "line_end": last, "text": source.part(w.start, w.end), "non_white": source.weight(w.start, w.end), "node_types": w.types, "diagnostic": diagnostic,
        })
    return out


def _mapped(files: DataFrame, schema: str, rows_of) -> DataFrame:
    empty = files.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns)):
                if rows := rows_of(path, language, text or ""):
                    yield pa.RecordBatch.from_pylist(rows, schema=empty)

    return files.select("path", "language", "text").mapInArrow(run, schema)


def chunk_files(files: DataFrame, budget: int = BUDGET, overlap: int = 0, meaning: int = MIN_MEANING, parser=parse) -> DataFrame:
    """Chunks of files (path, language, text)."""
    return _mapped(files, CHUNKS, lambda path, language, text: chunks_of(path, language, text, budget, overlap, meaning, parser))


def line_index(files: DataFrame) -> DataFrame:
    """(path, n, byte_start, byte_end, non_white) of each line of files, without its newline."""

    def rows(path: str, language: str, text: str) -> list[dict]:
        source = Source(text)
        ends = [*(a - 1 for a in source.lines[1:]), len(source.bytes)]
        return [{"path": path, "n": n, "byte_start": a, "byte_end": b, "non_white": source.weight(a, b)} for n, (a, b) in enumerate(zip(source.lines, ends), 1)]

    return _mapped(files, "path string, n long, byte_start long, byte_end long, non_white long", rows)


def line_groups(files: DataFrame, sizes: tuple[int, ...], texts: bool = True) -> DataFrame:
    """(path, size, line_start, line_end, byte_start, byte_end, and text: the first line) of groups of so many lines.

    Groups of a size follow one another from the first line; the last may have fewer. They are made in one
    pass over the files, where these are, so lines go through no exchange.
    """
    schema = "path string, size int, line_start int, line_end int, byte_start long, byte_end long" + ", text string" * texts

    def table(parts: list[tuple]) -> pa.RecordBatch:
        paths, groups, lines, *numbers = zip(*parts)
        path = pa.array(paths, pa.string()).take(pa.array(np.repeat(np.arange(len(paths)), groups)))
        columns = [path, *(pa.array(np.concatenate(x), kind) for x, kind in zip(numbers, [pa.int32()] * 3 + [pa.int64()] * 2))]
        names = ["path", "size", "line_start", "line_end", "byte_start", "byte_end"]
        if texts:
            columns, names = [*columns, pa.array(list(chain.from_iterable(lines)), pa.binary()).view(pa.string())], [*names, "text"]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = text.as_py().split(b"\n")
                count = len(lines)
                lengths = np.fromiter(map(len, lines), np.int64, count)
                ends = np.cumsum(lengths + 1) - 1
                for size in sizes:
                    first = np.arange(0, count, size)
                    last = np.minimum(first + size, count) - 1
                    parts.append((path, len(first), lines[::size] if texts else (), np.full(len(first), size), first + 1, last + 1, ends[first] - lengths[first], ends[last]))
                    held += len(first) * 64 + int(lengths.sum()) * texts
                if held > GROUPED:
                    yield table(parts)
                    parts, held = [], 0
        if parts:
            yield table(parts)

    return files.select("path", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, schema)


def widened_lines(files: DataFrame, overlap: int) -> DataFrame:
    """(path, byte_start, byte_end, wide_start, wide_end): the lines that aren't empty as windows, with their neighbours."""

    def rows(path: str, language: str, text: str) -> list[dict]:
        source = Source(text)
        ends = [*(a - 1 for a in source.lines[1:]), len(source.bytes)]
        windows = [Window(a, b) for a, b in zip(source.lines, ends) if a < b]
        return [{"path": path, "byte_start": w.own[0], "byte_end": w.own[1], "wide_start": w.start, "wide_end": w.end} for w in Chunker(source, BUDGET, overlap).overlapped(windows)]

    return _mapped(files, "path string, byte_start long, byte_end long, wide_start long, wide_end long", rows)


def kinds(rows: DataFrame) -> DataFrame:
    """(id, kind) of (id, node_types)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kind_of(t) for t in batch.column(1).to_pylist()], pa.string())], ["id", "kind"])

    return rows.select("id", "node_types").mapInArrow(run, "id string, kind string")


def file_symbols(files: DataFrame, parser=parse) -> DataFrame:
    """Symbols of files (path, language, text)."""

    def rows(path: str, language: str, text: str) -> list[dict]:
        try:
            root = parser(language, text)
        except Exception:  # as in chunks_of
            root = None
        return symbols(path, Source(text), root) if root else []

    return _mapped(files, SYMBOLS, rows)
