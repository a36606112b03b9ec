"""Places in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Folders made for sessions on one machine, by application.
_OWN: dict[str, str] = {}


def _shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine one is made if it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="staging-")
    return _OWN[context.applicationId]


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _files(spark, path)
    return files.exists(hadoop)


def new_path(spark: SparkSession, name: str) -> str:
    """A path nothing is at yet, deleted when the driver ends."""
    path = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, hadoop = _files(spark, path)
    files.deleteOnExit(hadoop)
    return path


@contextmanager
def staging(spark: SparkSession, name: str) -> Iterator[str]:
    """A path for what is read back before the block ends; deleted then."""
    path = new_path(spark, name)
    try:
        yield path
    finally:
        files, hadoop = _files(spark, path)
        files.delete(hadoop, True)
