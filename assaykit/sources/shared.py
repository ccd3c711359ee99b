"""Where tables that outlive a task are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_ROOTS: dict[str, str] = {}


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop has it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all machines share. Where that is unset, a temporary one serves a local master (tests,
    one machine); on a cluster that is an error, as other machines wouldn't see it. All go when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir isn't set: with master {master} it must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="assaykit-")
        spark.conf.set("spark.checkpoint.dir", base)
    key = f"{spark.sparkContext.applicationId} {base}"
    if key not in _ROOTS:
        root = f"{base.rstrip('/')}/assaykit-{uuid.uuid4().hex}"
        fs, where = _file_system(spark, root)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _ROOTS[key] = root
    return f"{_ROOTS[key]}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)
