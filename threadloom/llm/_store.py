"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Only where a local session names no shared folder, as in single-machine tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: While a table is written: Arrow batches of whole texts small enough for a Python worker
#: beside its executor's heap, and shuffle files go once the table stands.
WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which only a local session may leave unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = LOCAL_CHECKPOINTS
    return f"{root.rstrip('/')}/threadloom/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str, **options) -> None:
    """``df`` written as Parquet under the settings of WRITING, which are put back afterwards."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            conf.set(k, v)
        writer = df.write
        for k, v in options.items():
            writer = writer.partitionBy(v) if k == "partitionBy" else writer.option(k, v)
        writer.parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: later steps neither
    recompute it nor depend on the executors that made it."""
    path = shared_path(df.sparkSession, name)
    saved(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: What a reused Python worker keeps between tasks, by the name of its user.
_kept: dict[str, dict] = {}


def kept(name: str) -> dict:
    """A Python worker's memory for tasks of one user; tasks of another one empty it first."""
    return _kept.setdefault(name, {})


def _trim(keep: str) -> None:
    for name, memory in _kept.items():
        if name != keep:
            memory.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(rows: Callable, keep: str = "") -> Callable:
    """``rows`` as a task's function before and after which a Python worker gives back what this task does not need."""

    def run(batches):
        _trim(keep)
        try:
            yield from rows(batches)
        finally:
            _trim(keep)

    return run
