"""File sources: a manifest of a source tree, and its texts.

Listing is metadata work and is done by the driver, which holds ``LISTED`` files at a time and writes the
others to the shared folder; contents are read by Spark's binaryFile source.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import IGNORED_NAMES, IgnoreFile, glob_regex, ignore_regexes, ignored, is_glob, language_of, scanned
from lodestone.functions.text import binary_looking
from lodestone.session import shared_dir

MANIFEST = "path string, size long, mtime double, ctime double"
#: Files that the driver lists before it writes them out, and files that are read by name.
LISTED, NAMED = 100_000, 10_000


class OutsideTree(ValueError):
    """A path that leads out of the tree."""


def inside(root: str, path: str) -> str:
    """The path relative to the tree, after a leading @; OutsideTree if it, or a link on its way, leaves the tree."""
    root = os.path.realpath(root)
    full = os.path.realpath(os.path.join(root, path.removeprefix("@")))
    if full != root and not full.startswith(root + os.sep):
        raise OutsideTree(path)
    return os.path.relpath(full, root).replace(os.sep, "/") if full != root else ""


@dataclass(frozen=True)
class Tree:
    manifest: list[tuple[str, int, float, float]]
    ignore_files: list[IgnoreFile]


def prunes(folder: str, exclude: list[str]) -> bool:
    """Whether an exclude glob takes a whole folder away: one that ends in /**, or one without magic that names it."""
    return any(re.match(glob_regex(g.removesuffix("/**")), folder) if g.endswith("/**") else g.rstrip("/") == folder and not is_glob(g) for g in exclude)


def ignore_file(folder: str, base: str) -> IgnoreFile | None:
    name = os.path.join(folder, ".gitignore")
    if not os.path.isfile(name) or os.path.islink(name):
        return None
    with open(name, encoding="utf-8", errors="replace") as file:
        return IgnoreFile(base, tuple(file.read().split("\n")))


def stat_of(root: str, path: str) -> tuple[str, int, float, float] | None:
    """A row of the manifest; None for a file that is gone. Other errors are raised."""
    try:
        stat = os.stat(os.path.join(root, path))
    except FileNotFoundError:
        return None
    return path, stat.st_size, stat.st_mtime * 1000, stat.st_ctime * 1000


def listed(root: str, exclude: list[str], rules: list[IgnoreFile]) -> Iterator[tuple[str, int, float, float]]:
    """Files with size and times (ms), without symbolic links, names that are never scanned and folders that are excluded whole.

    Ignore files on the way are added to rules.
    """
    for folder, names, files in os.walk(root, followlinks=False):
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        base = "" if base == "." else base

        def under(name: str) -> str:
            return f"{base}/{name}" if base else name

        names[:] = sorted(n for n in names if n not in IGNORED_NAMES and not os.path.islink(os.path.join(folder, n)) and not prunes(under(n), exclude))
        if own := ignore_file(folder, base):
            rules.append(own)
        for name in sorted(files):
            if name in IGNORED_NAMES or os.path.islink(os.path.join(folder, name)):
                continue
            if row := stat_of(root, under(name)):
                yield row


def walk(root: str, exclude: list[str] | tuple[str, ...] = ()) -> Tree:
    rules: list[IgnoreFile] = []
    return Tree(list(listed(root, list(exclude), rules)), rules)


def scan(spark: SparkSession, root: str, include: list[str], exclude: list[str], tree: Tree | None = None) -> DataFrame:
    """(path, size, mtime, ctime) of the files that the globs take and no ignore file takes away."""
    if tree:
        rows, rules = spark.createDataFrame(tree.manifest, MANIFEST), tree.ignore_files
    else:
        rules, at = [], f"{shared_dir(spark)}/tables/manifest-{uuid.uuid4().hex}"
        for part in batched(listed(root, exclude, rules), LISTED):
            spark.createDataFrame(list(part), MANIFEST).write.mode("append").parquet(at)
        spark.createDataFrame([], MANIFEST).write.mode("append").parquet(at)
        rows = spark.read.schema(MANIFEST).parquet(at)
    return rows.filter(scanned(F.col("path"), include, exclude) & ~ignored(F.col("path"), rules))


def has_link(root: str, path: str) -> bool:
    """Whether the file, or a folder on its way, is a symbolic link."""
    parts = path.split("/")
    return any(os.path.islink(os.path.join(root, *parts[: n + 1])) for n in range(len(parts)))


def eligible(root: str, path: str, include: list[str], exclude: list[str]) -> bool:
    """The scan's verdict on one file, which need not exist: names, links, ignore files of its folders, and globs."""
    if has_link(root, os.path.normpath(path.removeprefix("@"))):
        return False
    try:
        path = inside(root, path)
    except OutsideTree:
        return False
    parts = path.split("/")
    if not path or set(IGNORED_NAMES) & set(parts):
        return False
    folders = ["/".join(parts[:n]) for n in range(len(parts))]
    if any(f and prunes(f, exclude) for f in folders):
        return False
    for base in folders:
        if (own := ignore_file(os.path.join(root, base), base)) is None:
            continue
        verdict = False
        for negated, regex in ignore_regexes(own.lines):
            if re.match(regex, path.removeprefix(f"{base}/" if base else "")):
                verdict = not negated
        if verdict:
            return False
    return any(re.match(glob_regex(g), path) for g in include) and not any(re.match(glob_regex(g), path) for g in exclude)


def readable(root: str, path: str) -> bool:
    return os.access(os.path.join(root, path), os.R_OK)


def contents(spark: SparkSession, root: str, manifest: DataFrame, max_bytes: int) -> DataFrame:
    """(path, content) of the manifest's files of up to max_bytes: read by name if they are few, else by the tree's listing."""
    root = os.path.realpath(root)
    reader = spark.read.format("binaryFile")
    names = [r[0] for r in manifest.filter(F.col("size") <= max_bytes).select("path").limit(NAMED + 1).collect()]
    if not names:
        return spark.createDataFrame([], "path string, content binary")
    if len(names) <= NAMED:
        there = [n for n in names if os.path.exists(os.path.join(root, n))]
        content = reader.load(["file://" + os.path.join(root, re.sub(r"([\\*?\[\]{}])", r"\\\1", n)) for n in there]) if there else spark.createDataFrame([], "path string, length long, content binary")
    else:
        content = reader.option("recursiveFileLookup", "true").load("file://" + root)
    return content.filter(F.col("length") <= max_bytes).select(F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root) + 2, 1 << 20).alias("path"), "content")


def decoded(content: Column) -> Column:
    """UTF-8 text with replacements for what is invalid, without a byte order mark."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\\x{FEFF}", "")


def read(spark: SparkSession, root: str, manifest: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(files, diagnostics): files (path, language, fingerprint, size, mtime, ctime, text); diagnostics (path, code, message) of those left out."""
    joined = manifest.join(contents(spark, root, manifest, max_bytes), "path", "left").filter((F.col("size") > max_bytes) | F.col("content").isNotNull())
    return sorted_out(joined, max_bytes)


def sorted_out(joined: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(files, diagnostics) of a manifest with contents."""
    large = F.col("size") > max_bytes
    binary = F.coalesce(binary_looking(F.col("content")), F.lit(False))
    files = joined.filter(~large & ~binary).select("path", language_of(F.col("path")).alias("language"), F.sha2("content", 256).alias("fingerprint"), "size", "mtime", "ctime", decoded(F.col("content")).alias("text"))
    code = F.when(large, "file_too_large").otherwise("binary_file")
    message = F.when(large, F.concat(F.lit("skipped: "), F.col("size").cast("string"), F.lit(f" bytes are more than {max_bytes}"))).otherwise("skipped: the file looks binary")
    return files, joined.filter(large | binary).select("path", code.alias("code"), message.alias("message"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as files (path, text, language, doc_id)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("src/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("path"), F.coalesce("text", F.lit("")).alias("text"), language_of(path).alias("language"), "doc_id")
