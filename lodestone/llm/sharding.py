"""A store of immutable shards with size-tiered compaction, on DataFrame functions and the file system alone.

``append`` writes an arrival as small shards. ``compact`` looks for tiers, runs of shards of similar
size, and merges as many of a tier as make up a target-sized file; each merge reads its shards one
after the other in one task, without a shuffle, so its memory doesn't depend on their size. Every
change is committed as a new version of the manifest: the list of shards is written to a file of its
own, which is then renamed to the version's name, and the rename fails if that name is taken. Readers
see one version or the next, and a writer that loses the race starts again from the newer one. Files of
lost tasks or of lost races are in no manifest; ``vacuum`` deletes what no kept version names.

The driver holds a line for each shard, never rows.

Defined results: an empty arrival adds a version without new shards; null values, very long texts,
repeated rows and any columns are stored as they are; all arrivals of a store have the same columns,
and another schema raises ValueError.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    #: Arrivals are numbered; a merged shard has the number of its first.
    sequence: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 256 << 20, fan_in: int = 4, merges_at_once: int = 8):
        """Shards of at least half of target_bytes are left alone; fan_in similar ones make a tier worth merging."""
        self.spark, self.root, self.target, self.fan_in, self.at_once = spark, root.rstrip("/"), target_bytes, fan_in, merges_at_once
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.conf)

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if not known:
            return Manifest(0, "", ())
        at = self._path(f"manifests/v{known[-1] if version is None else version:010d}.json")
        stream = self._fs().open(at)
        try:
            raw = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(raw["version"], raw["schema"], tuple(Shard(**s) for s in raw["shards"]))

    def commit(self, manifest: Manifest) -> Manifest:
        """Writes the manifest under its version, or raises CommitConflict."""
        draft, final = self._path(f"manifests/.draft-{uuid.uuid4().hex}"), self._path(f"manifests/v{manifest.version:010d}.json")
        out = self._fs().create(draft, True)
        out.write(bytearray(json.dumps({"version": manifest.version, "schema": manifest.schema, "shards": [asdict(s) for s in manifest.shards]}).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf)
        rename = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, final, rename)
        except Exception as error:
            self._fs().delete(draft, False)
            if self._fs().exists(final):
                raise CommitConflict(f"version {manifest.version} exists") from error
            raise
        return manifest

    def _shards_in(self, folder: str, schema: StructType, sequence: int) -> list[Shard]:
        """The shards that a write left in a folder, in the order of their partitions."""
        seen = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"))
        rows = seen.groupBy("name", "size").count().collect()  # a row for each shard
        return [Shard(f"{folder}/{r['name']}", r["size"], r["count"], sequence) for r in sorted(rows, key=lambda r: r["name"])]

    def append(self, arrival: DataFrame, attempts: int = 5) -> Manifest:
        """Adds the rows as shards of the arrival's own partitions."""
        folder = f"data/append-{uuid.uuid4().hex}"
        arrival.write.parquet(f"{self.root}/{folder}")
        schema = arrival.schema.json()
        for attempt in range(attempts):
            now = self.manifest()
            if now.schema and StructType.fromJson(json.loads(now.schema)).simpleString() != arrival.schema.simpleString():
                raise ValueError("the arrival's columns differ from the store's")
            sequence = 1 + max((s.sequence for s in now.shards), default=-1)
            new = self._shards_in(folder, arrival.schema, sequence)
            try:
                return self.commit(Manifest(now.version + 1, now.schema or schema, now.shards + tuple(new)))
            except CommitConflict:
                if attempt + 1 == attempts:
                    raise
        raise AssertionError

    def plan(self, shards: tuple[Shard, ...]) -> list[list[Shard]]:
        """Groups to merge: of each tier, runs in the order of arrival that fill a target-sized file."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes < self.target:
                tier, size = 0, self.target / 2
                while s.bytes * self.fan_in < size:
                    tier, size = tier + 1, size / self.fan_in
                tiers.setdefault(tier, []).append(s)
        groups = []
        for tier in sorted(tiers):
            members = sorted(tiers[tier], key=lambda s: (s.sequence, s.path))
            if len(members) < self.fan_in:
                continue
            group: list[Shard] = []
            for s in members:
                if group and sum(x.bytes for x in group) + s.bytes > self.target:
                    groups.append(group)
                    group = []
                group.append(s)
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> Manifest:
        """Merges until no tier is worth it, a version for each round; replaced shards stay until ``vacuum``."""
        while groups := self.plan((now := self.manifest()).shards):
            schema = StructType.fromJson(json.loads(now.schema))

            def merge(group: list[Shard]) -> list[Shard]:
                folder = f"data/merge-{uuid.uuid4().hex}"
                self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in group]).coalesce(1).write.parquet(f"{self.root}/{folder}")
                made = self._shards_in(folder, schema, min(s.sequence for s in group))
                if sum(s.rows for s in made) != sum(s.rows for s in group):
                    raise RuntimeError("a merge lost rows")
                return made

            with ThreadPoolExecutor(self.at_once) as pool:
                made = [s for shards in pool.map(merge, groups) for s in shards]
            gone = {s.path for g in groups for s in g}
            latest = self.manifest()
            if not gone <= {s.path for s in latest.shards}:
                continue  # another writer has merged some of them
            try:
                self.commit(replace(latest, version=latest.version + 1, shards=tuple(s for s in latest.shards if s.path not in gone) + tuple(made)))
            except CommitConflict:
                continue
        return now

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes the shard files that the last versions don't name; the number of files deleted. Not to be run beside a writer."""
        known = self.versions()
        named = {s.path for v in known[-keep_versions:] for s in self.manifest(v).shards}
        folder, gone = self._path("data"), 0
        if not self._fs().exists(folder):
            return 0
        for sub in self._fs().listStatus(folder):
            files = [f for f in self._fs().listStatus(sub.getPath()) if f.getPath().getName().endswith(".parquet")]
            unused = [f for f in files if f"data/{sub.getPath().getName()}/{f.getPath().getName()}" not in named]
            if len(unused) == len(files):
                self._fs().delete(sub.getPath(), True)
            else:
                for f in unused:
                    self._fs().delete(f.getPath(), False)
            gone += len(unused)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        now = self.manifest(version)
        if not now.schema:
            raise ValueError("the store has no version yet")
        schema = StructType.fromJson(json.loads(now.schema))
        paths = [f"{self.root}/{s.path}" for s in now.shards]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def report(docs: DataFrame, root: str, arrivals: int = 2, **limits) -> DataFrame:
    """The documents as read back from a store that took them in so many arrivals and compacted after each."""
    store = ShardStore(docs.sparkSession, root, **limits)
    for k in range(arrivals):
        store.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k))
        store.compact()
        store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE_SQL = "SELECT doc_id, lang, source, n_chars, octet_length(encode(text)) AS n_bytes, md5(text) AS text_md5 FROM documents"
