"""State tables of which a reader sees one whole version, and writers that never mix.

Rows lie in folders that no one changes once written. A version is a small
manifest that says which folder holds each bucket of sessions; it becomes
current by one rename to its number. A writer that dies before the rename has
changed nothing, and of two that come to it at once the second finds the number
taken and starts again from the new version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
#: How often a writer starts again.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer took the version first."""


class _Files:
    """A table's folder on whatever file system it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def take(self, source: str, target: str) -> bool:
        """Rename, unless the target is there."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(target).toUri(), self.conf)
        rename = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        try:
            context.rename(self.path(source), self.path(target), self.jvm.java.lang.reflect.Array.newInstance(rename, 0))
            return True
        except Exception as error:
            if "FileAlreadyExistsException" not in str(error):
                raise
            return False


def moved(spark: SparkSession, source: str, target: str) -> None:
    """A folder, if there is one, under another name, at once and whole."""
    files = _Files(spark, target)
    if files.fs.exists(files.path(source)):
        files.fs.mkdirs(files.path(target).getParent())
        files.take(source, target)


def _version(files: _Files, path: str) -> tuple[int, dict[str, str]]:
    """The newest version's number, and the folder of each bucket; 0 if there is none."""
    numbers = [int(n[2:-5]) for n in files.names(f"{path}/manifests") if n.startswith("v-") and n.endswith(".json")]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(files.text(f"{path}/manifests/v-{max(numbers):012d}.json"))["buckets"]


def _read(spark: SparkSession, path: str, buckets: dict[str, str]) -> DataFrame | None:
    folders: dict[str, list[str]] = {}
    for bucket, folder in buckets.items():
        folders.setdefault(folder, []).append(f"{path}/data/{folder}/bucket={bucket}")
    out = None
    for folder, parts in sorted(folders.items()):
        rows = spark.read.option("basePath", f"{path}/data/{folder}").parquet(*sorted(parts)).drop("bucket")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table's rows as of the newest version, or of an earlier one; None if there is none. What is read stays as it is while others write."""
    path = path.rstrip("/")
    files = _Files(spark, path)
    if version is None:
        return _read(spark, path, _version(files, path)[1])
    return _read(spark, path, json.loads(files.text(f"{path}/manifests/v-{version:012d}.json"))["buckets"])


def commit(df: DataFrame, path: str, before_rename: Callable[[], None] = lambda: None) -> int:
    """Rows of ``df`` (session_id, ...) in place of those that their sessions had; other sessions keep theirs. Returns the new version.

    Only buckets of sessions in ``df`` are written anew. A null session_id is a
    session. No rows: nothing changes.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    files = _Files(spark, path)
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")
    for _ in range(ATTEMPTS):
        version, have = _version(files, path)
        folder = uuid.uuid4().hex
        new = df.withColumn("bucket", bucket)
        touched = [str(r.bucket) for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        if not touched:
            return version
        old = _read(spark, path, {b: f for b, f in have.items() if b in touched})
        if old is not None:
            named = df.select(F.col("session_id").alias("named")).distinct()
            rest = old.join(named, F.col("session_id").eqNullSafe(F.col("named")), "left_anti")
            new = new.unionByName(rest.withColumn("bucket", bucket), allowMissingColumns=True)
        new.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
        staged = f"{path}/manifests/.{folder}"
        files.write(staged, json.dumps({"buckets": have | dict.fromkeys(touched, folder)}))
        before_rename()
        if files.take(staged, f"{path}/manifests/v-{version + 1:012d}.json"):
            return version + 1
        files.fs.delete(files.path(staged), False)
        files.fs.delete(files.path(f"{path}/data/{folder}"), True)
    raise Conflict(f"{path}: {ATTEMPTS} versions of other writers came first")


def expired(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions and the folders that only they name; how many folders went. Not while a writer is at work on the table."""
    path = path.rstrip("/")
    files = _Files(spark, path)
    names = sorted(n for n in files.names(f"{path}/manifests") if n.startswith("v-"))
    used = {f for n in names[-keep:] for f in json.loads(files.text(f"{path}/manifests/{n}"))["buckets"].values()}
    for n in names[:-keep]:
        files.fs.delete(files.path(f"{path}/manifests/{n}"), False)
    gone = [f for f in files.names(f"{path}/data") if f not in used]
    for f in gone:
        files.fs.delete(files.path(f"{path}/data/{f}"), True)
    return len(gone)
