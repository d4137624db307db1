"""Scratch folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; in local mode a temporary one where it is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; it goes with this application."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        home = _folders[app] = f"{_root(spark)}/scratch-{app}"

        def tidy() -> None:
            with suppress(Py4JError, OSError, AttributeError):
                at = spark._jvm.org.apache.hadoop.fs.Path(home)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

        atexit.register(tidy)
    return f"{_folders[app]}/{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` written once and read back, so that several passes share the work and a lost executor costs its tasks only."""
    spark = rows.sparkSession
    path = scratch(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
