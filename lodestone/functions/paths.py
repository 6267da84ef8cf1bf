"""Path predicates: prefixes, globs and ignore rules, compiled on the driver to regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import any_of

#: Names of directories that are never scanned.
IGNORED_NAMES = (".git", "node_modules", "dist", "build", ".cache")
GLOB_SYNTAX = re.compile(r"[*?\[{]|[!+@]\(")


def is_glob(pattern: str) -> bool:
    return GLOB_SYNTAX.search(pattern) is not None


class _Glob:
    """A recursive-descent compiler of one glob; names that start with a dot match like others."""

    def __init__(self, glob: str):
        self.glob, self.at = glob, 0

    def compile(self) -> str:
        return self.sequence("")

    def sequence(self, stop: str) -> str:
        out = []
        while self.at < len(self.glob) and self.glob[self.at] not in stop:
            out.append(self.one(stop))
        return "".join(out)

    def one(self, stop: str) -> str:
        g, i = self.glob, self.at
        c = g[i]
        if c in "@?+*!" and g[i + 1 : i + 2] == "(" and ")" in g[i:]:
            self.at += 2
            return self.extended(c)
        if g.startswith("**", i) and (i == 0 or g[i - 1] == "/"):
            if g[i + 2 : i + 3] == "/":
                self.at += 3
                return "(?:[^/]+/)*"
            if i + 2 == len(g):
                self.at += 2
                return ".*"
        self.at += 1
        if c == "*":
            while g[self.at : self.at + 1] == "*":
                self.at += 1
            return "[^/]*" if self.at < len(g) and g[self.at] not in "/" or (i > 0 and g[i - 1] != "/") else "[^/]+"
        if c == "?":
            return "[^/]"
        if c == "[" and (end := g.find("]", i + 2)) > 0:
            body = g[i + 1 : end]
            self.at = end + 1
            negated = body[0] in "!^"
            inner = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            return f"(?!/)[{'^' if negated else ''}{inner}]"
        if c == "{" and (closing := self.closing(i)) > 0:
            return self.braces(closing)
        if c == "\\" and self.at < len(g):
            self.at += 1
            return re.escape(g[self.at - 1])
        return re.escape(c)

    def closing(self, i: int) -> int:
        depth = 0
        for j in range(i, len(self.glob)):
            depth += (self.glob[j] == "{") - (self.glob[j] == "}")
            if not depth:
                return j
        return -1

    def braces(self, closing: int) -> str:
        body = self.glob[self.at : closing]
        if m := re.fullmatch(r"(-?\d+)\.\.(-?\d+)", body):
            self.at = closing + 1
            a, b = int(m[1]), int(m[2])
            return "(?:" + "|".join(str(n) for n in range(min(a, b), max(a, b) + 1)) + ")"
        options = []
        while self.at <= closing:
            options.append(self.sequence(",}"))
            self.at += 1
        return "(?:" + "|".join(options) + ")" if len(options) > 1 else r"\{" + options[0] + r"\}"

    def extended(self, kind: str) -> str:
        options = []
        while True:
            options.append(self.sequence("|)"))
            ended = self.at >= len(self.glob) or self.glob[self.at] == ")"
            self.at += 1
            if ended:
                break
        body = "|".join(options)
        if kind == "!":
            rest = _Glob(self.glob[self.at :]).compile()
            return f"(?!(?:{body}){rest}$)[^/]*"
        return f"(?:{body})" + {"@": "", "?": "?", "+": "+", "*": "*"}[kind]


def glob_regex(glob: str) -> str:
    return f"^{_Glob(glob).compile()}$"


def static_prefix(glob: str) -> str:
    """What stands before the last slash ahead of the first magic character, with that slash."""
    m = GLOB_SYNTAX.search(glob)
    head = glob[: m.start()] if m else glob
    return head[: head.rfind("/") + 1]


def prefix_matches(path: Column, prefix: str) -> Column:
    bare = prefix.rstrip("/")
    return (path == prefix) | (path == bare) | path.startswith(bare + "/")


def matches(path: Column, filters: list[str]) -> Column:
    """Any of the filters, prefixes or globs; none means all.

    A glob is also asked for its static prefix, which the scan can use.
    """
    if not filters:
        return F.lit(True)
    return any_of([(path.startswith(static_prefix(f)) & path.rlike(glob_regex(f))) if is_glob(f) else prefix_matches(path, f) for f in filters])


def scanned(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Some include glob and no exclude glob."""
    return any_of([path.rlike(glob_regex(g)) for g in include]) & ~any_of([path.rlike(glob_regex(g)) for g in exclude])


def in_ignored_directory(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.lit(list(IGNORED_NAMES)))


@dataclass(frozen=True)
class IgnoreFile:
    """The rules of one ignore file: the directory that it stands in ('' for the root), and its lines."""

    base: str
    lines: tuple[str, ...]


def ignore_regexes(lines: tuple[str, ...]) -> list[tuple[bool, str]]:
    """(negated, regular expression) of each rule, in order. A match of a directory takes what is below it."""
    out = []
    for raw in lines:
        line = raw.rstrip("\r\n").rstrip() if not raw.endswith("\\ ") else raw
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        rule = line[negated:].removeprefix("\\") if line[:1] in "!\\" else line
        folder = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        body = _Glob(rule.lstrip("/")).compile()
        out.append((negated, f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$"))
    return out


def ignored(path: Column, files: list[IgnoreFile]) -> Column:
    """Any ignore file that ignores the path; within a file the last rule that matches decides, across files nothing is taken back."""
    verdicts = []
    for f in files:
        below = F.lit(True) if not f.base else path.startswith(f.base + "/")
        relative = F.substring(path, len(f.base) + 2 if f.base else 1, 1 << 20)
        verdict = F.lit(False)
        for negated, regex in ignore_regexes(f.lines):
            verdict = F.when(relative.rlike(regex), F.lit(not negated)).otherwise(verdict)
        verdicts.append(below & verdict)
    return any_of(verdicts)


#: Extensions and whole file names of the languages with a grammar.
LANGUAGE_OF_EXTENSION = {
    "sh": "bash", "bash": "bash", "go": "go", "html": "html", "htm": "html", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "php": "php", "phtml": "php", "php3": "php", "php4": "php", "php5": "php", "py": "python", "rb": "ruby", "rs": "rust", "ts": "typescript", "tsx": "tsx",
}
LANGUAGE_OF_NAME = {".bashrc": "bash", ".bash_profile": "bash"}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_of(path: Column) -> Column:
    """By the file's name, or its extension whatever the case; ``text`` for others."""
    name = F.regexp_extract(path, r"([^\\/]*)$", 1)
    return F.coalesce(_looked_up(LANGUAGE_OF_NAME, name), _looked_up(LANGUAGE_OF_EXTENSION, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("text"))
