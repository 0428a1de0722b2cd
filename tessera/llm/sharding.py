"""Operator 4: size-tiered compaction of immutable shards (DataFrame functions only).

A store is a folder.  Arrivals are appended as small Parquet files that never
change.  Compaction sorts shards into tiers by size, merges runs of similarly
sized shards and repeats this on paper until no tier holds a full run; only
the final merges are carried out, so each row is rewritten once.  A version is
a manifest file that lists the live shards; it is written aside and renamed to
its numbered place, which fails if another writer has taken the number, so a
reader sees either the old version or the new one.  The files of older
versions stay, so that their readers go on and ``read(version)`` works, until
``expire`` removes what no version after a given one lists.  A commit that
fails removes the files that were written for it.

Shard metadata (name, bytes, rows) is held by the driver, rows never are.

Defined results: any columns and nulls are kept as they are; repeated rows
stay repeated; an empty table makes a version without shards, which is read as
no rows of the same columns; arrivals have the columns of the first ones; a
column that is named as the one asked for the shard's number is replaced when
a version is read.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shard names are broadcast up to this number, some 15 MB; beyond it they are joined as Spark sees fit.
BROADCAST_SHARDS = 100_000
NAME, GROUP = "_tessera_file", "_tessera_group"


@dataclass(frozen=True)
class Shard:
    name: str  # relative to the store's data folder
    bytes: int
    rows: int


def plan_merges(sizes: list[int], target: int, fanout: int, least: int = 1 << 16) -> list[list[int]]:
    """Groups of positions to merge: size-tiered runs, followed to their end.

    A shard of at least half the target is finished.  A run is ``fanout`` or
    more shards of one tier, closed when it reaches the target.  Groups of one
    shard are left out.
    """
    runs = [(size, [i]) for i, size in enumerate(sizes)]
    done = [r for r in runs if 2 * r[0] >= target]
    runs = [r for r in runs if 2 * r[0] < target]
    moved = True
    while moved:
        moved = False
        tiers: dict[int, list] = {}
        for r in runs:
            tiers.setdefault(int(math.log(max(r[0], least) / least, fanout)), []).append(r)
        runs = []
        for _, members in sorted(tiers.items()):
            if len(members) < fanout:
                runs += members
                continue
            moved = True
            size, own = 0, []
            for s, ids in members:
                if own and size + s > target:
                    (done if 2 * size >= target else runs).append((size, own))
                    size, own = 0, []
                size, own = size + s, own + ids
            (done if 2 * size >= target else runs).append((size, own))
    return [ids for _, ids in [*done, *runs] if len(ids) > 1]


class ShardStore:
    """Shards and manifests under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, codec: str = "zstd") -> None:
        self.spark, self.root, self.target, self.fanout, self.codec = spark, root.rstrip("/"), target_bytes, fanout, codec
        self._jvm = spark._jvm
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        self._fs.mkdirs(self._path(f"{self.root}/data"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        return [Shard(**x) for x in self._manifest(version)["shards"]] if version else []

    def schema(self, version: int) -> T.StructType:
        return T.StructType.fromJson(self._manifest(version)["schema"])

    def commit(self, based_on: int, shards: list[Shard], schema: T.StructType) -> int:
        """Make ``shards`` the version after ``based_on``; raises if that version exists."""
        aside = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": based_on + 1, "schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(aside, self._path(f"{self.root}/manifest/v{based_on + 1}.json"), options)
        return based_on + 1

    def _new_shards(self, folder: str) -> list[Shard]:
        """The Parquet files that a job has written to ``folder``, with sizes and row counts."""
        files = self._fs.listFiles(self._path(f"{self.root}/data/{folder}"), True)
        base, sizes = f"/{folder}/", {}
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString()
            if name.endswith(".parquet"):
                sizes[folder + "/" + name.split(base, 1)[1]] = f.getLen()
        if not sizes:
            return []
        counted = (
            self.spark.read.option("recursiveFileLookup", True).parquet(*[f"{self.root}/data/{n}" for n in sizes])
            .groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
        )
        rows = {r["f"].split(base, 1)[1]: r["count"] for r in counted}
        return sorted((Shard(n, b, rows.get(n.removeprefix(f"{folder}/"), 0)) for n, b in sizes.items()), key=lambda s: s.name)

    def append(self, df: DataFrame, shard_rows: int = 1024) -> int:
        """Append a table as small shards of at most ``shard_rows`` rows, without a shuffle."""
        before = self.version()
        schema = self.schema(before) if before else df.schema
        folder = f"a-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", shard_rows).option("compression", self.codec).parquet(f"{self.root}/data/{folder}")
        return self._commit_folder(before, schema, self.shards(before), folder)

    def _commit_folder(self, before: int, schema: T.StructType, kept: list[Shard], folder: str) -> int:
        """Commit the kept shards and those just written; a failure takes the new files away."""
        try:
            return self.commit(before, [*kept, *(s for s in self._new_shards(folder) if s.rows)], schema)
        except Exception:
            self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)
            raise

    def expire(self, oldest: int) -> int:
        """Forget the versions before ``oldest`` and delete the files that only they list; gives their number."""
        oldest = min(oldest, self.version())
        live = {s.name for v in range(oldest, self.version() + 1) for s in self.shards(v)}
        old = [v for v in range(1, oldest) if self._fs.exists(self._path(f"{self.root}/manifest/v{v}.json"))]
        dead = {s.name for v in old for s in self.shards(v)} - live
        for v in old:
            self._fs.delete(self._path(f"{self.root}/manifest/v{v}.json"), False)
        for name in dead:
            self._fs.delete(self._path(f"{self.root}/data/{name}"), False)
        return len(dead)

    def compact(self) -> int:
        """Merge similarly sized shards and commit the result as a version."""
        before = self.version()
        live = self.shards(before)
        groups = plan_merges([s.bytes for s in live], self.target, self.fanout)
        if not groups:
            return before
        merged = {i for g in groups for i in g}
        folder = f"c-{uuid.uuid4().hex}"
        names = [(live[i].name, g) for g, ids in enumerate(groups) for i in ids]
        placed = self._placed([n for n, _ in names], [(n, g) for n, g in names], GROUP)
        placed.repartitionById(len(groups), F.col(GROUP)).write.partitionBy(GROUP).option("compression", self.codec).parquet(f"{self.root}/data/{folder}")
        return self._commit_folder(before, self.schema(before), [s for i, s in enumerate(live) if i not in merged], folder)

    def read(self, version: int | None = None, number: str = "shard") -> DataFrame:
        """The rows of a version, with the place of their shard in the manifest as ``number``."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError("nothing has been appended yet")
        shards = self.shards(version)
        if not shards:
            empty = self.spark.createDataFrame([], self.schema(version))
            return empty.drop(number).withColumn(number, F.lit(None).cast("int"))
        return self._placed([s.name for s in shards], [(s.name, i) for i, s in enumerate(shards)], number)

    def _placed(self, names: list[str], numbers: list[tuple[str, int]], column: str) -> DataFrame:
        """The rows of some shards with the number of their shard in ``column``."""
        table = self.spark.createDataFrame(numbers, f"{NAME} string, {column} int")
        if len(numbers) <= BROADCAST_SHARDS:
            table = F.broadcast(table)
        source = self.spark.read.schema(self.schema(self.version())).option("recursiveFileLookup", True).parquet(*[f"{self.root}/data/{n}" for n in names])
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1)
        return source.withColumn(NAME, name).drop(column).join(table, NAME).drop(NAME)
