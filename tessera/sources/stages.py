"""Stage output with an owner: versions, a manifest, and deletion.

A stage is a folder with one sub-folder per version and a small file that names
the current one. A version is reused only while its fingerprint holds: columns,
plan, and the files that the plan reads (path, size, time). A refresh writes a
new version beside the old one and then swaps the pointer, so a reader of the
old one is not disturbed; old versions go when the owner says so.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Paths that ``owned_stages`` will delete; None where no owner is in charge.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned stages", default=None)


def _place(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder or file from whatever store it is in."""
    at, store = _place(spark, path)
    store.delete(at, True)


def own(path: str) -> None:
    """Hand a path to the owner in charge, if there is one."""
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)


@contextmanager
def owned_stages(spark: SparkSession) -> Iterator[None]:
    """Delete derived stages written inside when the block ends.

    For work whose result is on the driver or in a table of its own: a frame
    that still reads such a stage cannot be used afterwards.
    """
    paths: list[str] = []
    token = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in paths:
            delete_path(spark, path)


def releases_stages(work: Callable) -> Callable:
    """Run a function of (frame, ...) whose result reads no stage, and delete what it staged."""

    @wraps(work)
    def run(df: DataFrame, *args, **options):
        with owned_stages(df.sparkSession):
            return work(df, *args, **options)

    return run


def _roots(df: DataFrame) -> list[str]:
    """Folders and files that the plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    out = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            out += [paths.apply(j).toString() for j in range(paths.size())]
    return sorted(set(out))


def fingerprint(df: DataFrame) -> str:
    """Digest of columns, plan and input files; it changes when any of them does (a job lists the files)."""
    spark, roots = df.sparkSession, _roots(df)
    files = None
    if roots:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
        # the sum over all files is taken where they are listed
        one = F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)")
        row = listed.select("path", "length", "modificationTime").agg(F.count("*"), F.sum(one)).head()
        files = [str(v) for v in row]
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    return hashlib.sha256(json.dumps([df.schema.jsonValue(), plan, roots, files]).encode()).hexdigest()


class Stage:
    """One named result in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read_pointer(self) -> dict | None:
        at, store = _place(self.spark, f"{self.path}/current")
        if not store.exists(at):
            return None
        stream = store.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap_pointer(self, manifest: dict) -> None:
        """Write the new pointer beside the old one and move it over it."""
        fresh, store = _place(self.spark, f"{self.path}/.current-{uuid.uuid4().hex}")
        stream = store.create(fresh)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark._sc._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.OVERWRITE
        context = fs.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fresh, fs.Path(f"{self.path}/current"), options)

    def versions(self) -> list[str]:
        """Version folders, the current one last."""
        at, store = _place(self.spark, self.path)
        if not store.exists(at):
            return []
        names = [s.getPath().getName() for s in store.listStatus(at) if s.isDirectory()]
        current = (self._read_pointer() or {}).get("version")
        return sorted(names, key=lambda n: (n == current, n))

    def table(self, df: DataFrame, refresh: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
        """The stored result if it still answers to ``df``, else a new version of it (an eager job)."""
        mark = fingerprint(df)
        found = None if refresh else self._read_pointer()
        if found is None or found["fingerprint"] != mark or found["partition_by"] != list(partition_by):
            found = {
                "version": f"v-{uuid.uuid4().hex}", "fingerprint": mark, "partition_by": list(partition_by),
                "schema": df.schema.jsonValue(),
            }
            df.write.partitionBy(*partition_by).parquet(f"{self.path}/{found['version']}")
            self._swap_pointer(found)
        return self._load(found)

    def _load(self, manifest: dict) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{manifest['version']}")

    def stored(self) -> DataFrame:
        """The current version as it is."""
        found = self._read_pointer()
        if found is None:
            raise FileNotFoundError(f"no finished stage in {self.path}")
        return self._load(found)

    def prune(self) -> None:
        """Delete every version but the current one, unfinished ones too."""
        current = (self._read_pointer() or {}).get("version")
        for name in self.versions():
            if name != current:
                delete_path(self.spark, f"{self.path}/{name}")

    def delete(self) -> None:
        delete_path(self.spark, self.path)


class StageOwner:
    """Stages of one piece of work; closing deletes them all.

    ``with StageOwner(spark, folder) as stages: people = stages.table("people", df)``
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._stages = spark, folder.rstrip("/"), {}

    def stage(self, name: str) -> Stage:
        return self._stages.setdefault(name, Stage(self.spark, f"{self.folder}/{name}"))

    def table(self, name: str, df: DataFrame, **options) -> DataFrame:
        return self.stage(name).table(df, **options)

    def close(self) -> None:
        for stage in self._stages.values():
            stage.delete()
        self._stages.clear()

    def __enter__(self) -> StageOwner:
        return self

    def __exit__(self, *_) -> None:
        self.close()
