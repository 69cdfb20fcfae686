"""Shards with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable Parquet shards. Compaction sorts shards into tiers by
size (each tier ``FAN_IN`` times the one below); a tier with ``FAN_IN`` shards or more is merged,
shards that fit together going into one file of at most the target size. No merge shuffles: each
new file is one task that reads its shards and writes them, and several jobs of such tasks run side
by side.

A manifest lists the schema and the shards of one version. It is written under a name of its own
and then takes its version's name, which fails if that version is there: of two writers one gets
it, and the other reads the new state and tries again. Readers see one version or the next, never
parts. Files are never changed; those that no manifest lists any more are removed by ``vacuum``. A
writer that dies leaves files that no manifest lists.

The commit needs a file system where a name can be taken only once. A local or mounted one does it
with a hard link, HDFS and others of ``RENAMES`` by a rename that doesn't overwrite. Object stores
copy and delete instead, so there the caller passes ``put``, a conditional put of the store's own;
without one the store refuses to open. The driver holds the names and sizes of shards (about 200
bytes each): for 100 TB take a target of 1 GB and arrivals of 128 MB or so.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path

TARGET_BYTES, ARRIVAL_BYTES = 64 << 20, 8 << 20
FAN_IN, BASE_BYTES = 4, 1 << 20
#: Schemes of file systems whose rename is atomic and can refuse to overwrite.
RENAMES = frozenset({"hdfs", "viewfs", "abfs", "abfss", "ofs"})
#: New files that one Spark job makes, and jobs at once.
MERGES_PER_JOB, JOBS = 200, 8


@dataclass(frozen=True)
class Shard:
    name: str  #: below the store's folder
    bytes: int

    @property
    def tier(self) -> int:
        return max(0, math.ceil(math.log(max(1, self.bytes) / BASE_BYTES, FAN_IN)))


class Conflict(Exception):
    """Another writer has committed the version."""


class ShardStore:
    """A folder with shards/ and manifests/.

    put: (path, content) to whether the name was free and has the content now; for object stores.
    """

    def __init__(self, spark: SparkSession, path: str, put: Callable[[str, bytes], bool] | None = None):
        self.spark, self.path, self._put = spark, path.rstrip("/"), put
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._fs_path(self.path).getFileSystem(self._conf)
        self._scheme = self._fs.getUri().getScheme()
        if put is None and self._scheme != "file" and self._scheme not in RENAMES:
            raise ValueError(f"{self._scheme} has no rename that takes a name once: pass put")
        self._fs.mkdirs(self._at("manifests"))

    def _at(self, name: str):
        return self._fs_path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        """The files of a small folder, as names below the store."""
        if not self._fs.exists(self._at(folder)):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at(folder)) if s.isFile())
        return [f"{folder}/{n}" for n in names if n[0] not in "._"]

    def _files(self, folder: str) -> list[Shard]:
        """The Parquet files of a folder, listed by Spark, without their contents."""
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.path}/{folder}")
        return [Shard(f"{folder}/{r['path'].rpartition('/')[2]}", r["length"]) for r in listed.select("path", "length").toLocalIterator()]

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        return max((int(n.rpartition("/")[2][1:-5]) for n in self._names("manifests") if n.endswith(".json") and "/v" in n), default=0)

    def _manifest(self, version: int | None) -> tuple[T.StructType | None, list[Shard]]:
        version = self.version() if version is None else version
        if not version:
            return None, []
        stream = self._fs.open(self._at(f"manifests/v{version:08d}.json"))
        try:
            first, *rest = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()
        return T.StructType.fromJson(json.loads(first)), [Shard(**json.loads(line)) for line in rest]

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, by default the newest."""
        return self._manifest(version)[1]

    def schema(self, version: int | None = None) -> T.StructType | None:
        """The columns of a version; None before the first."""
        return self._manifest(version)[0]

    def commit(self, version: int, schema: T.StructType, shards: list[Shard]) -> None:
        """Makes schema and shards the given version, or raises Conflict if there is one already."""
        lines = [json.dumps(schema.jsonValue()), *(json.dumps(asdict(s)) for s in sorted(shards, key=lambda s: s.name))]
        content = "".join(f"{x}\n" for x in lines).encode()
        to = self._at(f"manifests/v{version:08d}.json")
        if self._put is not None:
            if not self._put(to.toString(), content):
                raise Conflict(f"version {version} is there")
            return
        name = self._at(f"manifests/tmp-{uuid.uuid4().hex}")
        stream = self._fs.create(name, False)
        try:
            stream.write(content)
        finally:
            stream.close()
        try:
            if not self._takes(name, to):
                raise Conflict(f"version {version} is there")
        finally:
            if self._fs.exists(name):
                self._fs.delete(name, False)

    def _takes(self, name, to) -> bool:
        """Whether the file at name now is the one at to, which wasn't there."""
        if self._scheme == "file":
            local = [unquote(urlparse(self._fs.makeQualified(p).toString()).path) for p in (name, to)]
            try:
                os.link(*local)
            except FileExistsError:
                return False
            return True
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(name), self._fs.makeQualified(to), options)
        except Exception:
            if self._fs.exists(to):
                return False
            raise
        return True

    def append(self, df: DataFrame, rows: int | None = None, evolve: bool = False) -> int:
        """Writes df as new shards without a shuffle; the new version.

        rows: in a shard at most; by default as many as make about ``ARRIVAL_BYTES`` of what df reads.
        All columns, nulls, repeated rows and texts of any length are kept as they are; an empty df
        adds no rows. ValueError if a column's type isn't the store's; also if df lacks a column or
        has another one, unless evolve: then new columns are added, and missing ones are null.
        """
        self._fits(df.schema, self.schema(), evolve)
        new = self._write(df.write.option("maxRecordsPerFile", rows or arrival_rows(df)))
        while True:
            version = self.version()
            schema, now = self._manifest(version)
            schema = self._fits(df.schema, schema, evolve)  # another append may have been the first
            try:
                self.commit(version + 1, schema, [*now, *new])
                return version + 1
            except Conflict:
                continue

    @staticmethod
    def _fits(new: T.StructType, have: T.StructType | None, evolve: bool) -> T.StructType:
        """The columns of both."""
        loose = T.StructType([T.StructField(f.name, f.dataType) for f in new])  # all may be null
        if have is None:
            return loose
        kinds = {f.name: f.dataType for f in have}
        other = [f.name for f in loose if f.dataType != kinds.get(f.name, f.dataType)]
        if other or not evolve and set(kinds) != set(loose.names):
            raise ValueError(f"the store has columns {have.simpleString()}, not {loose.simpleString()}")
        return T.StructType([*have.fields, *(f for f in loose if f.name not in kinds)])

    def _write(self, writer) -> list[Shard]:
        folder = f"shards/{uuid.uuid4().hex}"
        writer.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return self._files(folder)

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> int:
        """Merges until no tier has fan_in shards that belong together; the newest version.

        Each round commits. If an append comes between, its shards stay beside the merged ones; if
        another compaction has taken away what this one merged, this round is dropped. Rows, repeated
        ones too, stay as they are; a store without shards stays as it is.
        """
        while merges := planned(self.shards(), target, fan_in):
            new = self._merged(merges)
            old = {s for m in merges for s in m}
            while True:
                version = self.version()
                schema, now = self._manifest(version)
                if not old <= set(now):
                    break
                try:
                    self.commit(version + 1, schema, [s for s in now if s not in old] + new)
                    break
                except Conflict:
                    continue
        return self.version()

    def _merged(self, merges: list[list[Shard]]) -> list[Shard]:
        """One new shard for each list of shards."""
        schema = self.schema()

        def job(some: list[list[Shard]]) -> list[Shard]:
            return self._write(reduce(DataFrame.unionAll, [self._read(m, schema).coalesce(1) for m in some]).write)

        # Else a union of single partitions is one partition.
        with settings(self.spark, {"spark.sql.unionOutputPartitioning": "false"}), ThreadPoolExecutor(JOBS) as jobs:
            parts = [merges[at : at + MERGES_PER_JOB] for at in range(0, len(merges), MERGES_PER_JOB)]
            return [s for new in jobs.map(job, parts) for s in new]

    def _read(self, shards: list[Shard], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s.name}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        schema, shards = self._manifest(version)
        if schema is None:
            raise ValueError(f"{self.path} has no shards")
        return self._read(shards, schema) if shards else self.spark.createDataFrame([], schema)

    def vacuum(self) -> None:
        """Removes all but the newest manifest and all files that it doesn't list. Only when nobody
        reads an older version and nobody writes."""
        version = self.version()
        listed = {s.name for s in self.shards(version)}
        for name in self._names("manifests"):
            if not name.endswith(f"/v{version:08d}.json"):
                self._fs.delete(self._at(name), False)
        if not self._fs.exists(self._at("shards")):
            return
        for folder in self._fs.listStatus(self._at("shards")):
            files = set(self._names(f"shards/{folder.getPath().getName()}"))
            if not listed & files:
                self._fs.delete(folder.getPath(), True)
                continue
            for name in files - listed:
                self._fs.delete(self._at(name), False)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and as it was afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrival_rows(df: DataFrame) -> int:
    """Rows that make about ARRIVAL_BYTES, by the plan's size and the row count (of files: their
    footers say it)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(1 << 31, math.ceil(df.count() * ARRIVAL_BYTES / max(1, size))))


def planned(shards: list[Shard], target: int, fan_in: int) -> list[list[Shard]]:
    """The merges of one round: in each tier with fan_in shards or more, shards from small to large
    are put together while they fit the target. A list of one isn't a merge."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes * 2 <= target:
            tiers.setdefault(s.tier, []).append(s)
    merges = []
    for _, tier in sorted(tiers.items()):
        if len(tier) < fan_in:
            continue
        group, size = [], 0
        for s in sorted(tier, key=lambda s: (s.bytes, s.name)):
            if group and size + s.bytes > target:
                merges.append(group)
                group, size = [], 0
            group.append(s)
            size += s.bytes
        merges.append(group)
    return [m for m in merges if len(m) > 1]


def compacted(docs: DataFrame, path: str, target: int = TARGET_BYTES, rows: int | None = None) -> ShardStore:
    """The store at path after docs arrived and were compacted. All columns are kept as they are,
    with nulls and repeated rows; an empty table makes one empty shard at most."""
    store = ShardStore(docs.sparkSession, path)
    store.append(docs, rows)
    store.compact(target)
    store.vacuum()
    return store


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a store: doc_id and digest of the text as the compacted shards have
    them, and whether the shard is within the target size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = compacted(docs, fresh_path(spark, "shards"))
    found = store.read().select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col("_metadata.file_size").alias("bytes"))
    return found.select("doc_id", "text_sha256", (F.col("bytes") <= TARGET_BYTES).alias("within_target"))


SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, true AS within_target FROM documents"
