"""Intermediate tables in the folder that all executors share, and Python tasks of bounded memory."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Collection
from contextlib import suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Arrow batches hold about so many bytes: a batch of long texts would fill a worker's memory and the JVM's buffers.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; in local mode a temporary one where it is unset."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder, which goes when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        path = _folders[app] = f"{shared_dir(spark)}/tables-{app}"

        def tidy() -> None:
            with suppress(Py4JError, OSError, AttributeError):
                _delete(spark, path)

        atexit.register(tidy)
    return _folders[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        if path := table.__dict__.pop("_table", None):
            _delete(table.sparkSession, path)


def release() -> None:
    """Give a worker's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def _released(run: Callable) -> Callable:
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def mapped(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH_BYTES; workers keep no memory from one task to the next.

    The bound is set once for a session, where the session has a wider one.
    """
    conf = df.sparkSession.conf
    bound = conf.get(_BATCH).rstrip("bB")
    if not bound.isdigit() or int(bound) > BATCH_BYTES:
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df.mapInArrow(_released(run), schema)


def fresh(name: str, taken: Collection[str]) -> str:
    """A column name like ``name`` that is not taken yet."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
