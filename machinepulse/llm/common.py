"""Reading, cutting lineage, and other small helpers the operators share."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A batch handed to Python holds at most so many bytes, however long the texts.
_BATCH_BYTES = 8 << 20
# By application: whether the package was sent, and the folder made for tests.
_SHIPPED: set[str] = set()
_OWN_FOLDERS: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Make the session ready for the operators that run Python.

    Arrow batches are bounded by bytes, since ten thousand long texts would not
    fit, and the package is sent along for executors that do not have it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="package-")
        context.addPyFile(
            shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
        )
        _SHIPPED.add(context.applicationId)
    return spark


def handing_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work for a worker that, at the end of its task, gives freed memory back to the system.

    Workers go on to later tasks, of other stages too, and allocators keep what
    was freed; without this a worker stays as large as its largest task was.
    """

    @wraps(work)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return task


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor can reach.

    Only where the cluster names none (tests on one machine) is one made here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _OWN_FOLDERS[context.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop_path.getFileSystem(conf).deleteOnExit(hadoop_path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and go on from the files.

    This cuts the lineage: a lost executor costs the unfinished tasks only, and
    what the rows held when they were written stays, whatever is run again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(rows: int, each: int) -> int:
    """How many partitions counted rows fill; a small table in hundreds of them
    costs more to schedule than to work on."""
    return max(1, -(-rows // each))


def bucket(identifier: str, parts: int) -> Column:
    """crc32 of an id as text, modulo parts; null ids have no bucket."""
    return F.crc32(F.col(identifier).cast("string").cast("binary")) % parts


def whole(text: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def text_key(text: str = "text") -> Column:
    return F.sha2(whole(text), 256)


def rows_kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs, all columns, whose (doc_id, sha256 of text) is in kept.

    kept has columns id and digest. Rows that repeat both come once.
    """
    names = docs.columns
    key, digest = free_name("key", names), free_name("digest", names)
    # Without nulls in the key the join and the last step share one shuffle.
    found = docs.withColumns({key: _filled("doc_id"), digest: text_key()}).join(
        kept.select(_filled("id").alias(key), F.col("digest").alias(digest)),
        [key, digest],
        "left_semi",
    )
    return found.dropDuplicates([key, digest]).select(*names)


def _filled(identifier: str) -> Column:
    return F.coalesce(F.col(identifier).cast("string"), F.lit(""))


def rows_leading(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs, all columns, whose (doc_id, 64-bit hash of text) is in kept.

    kept has columns id and version. Rows that repeat doc_id and text come once.
    """
    names = docs.columns
    key, version = free_name("key", names), free_name("version", names)
    found = docs.withColumns({key: _filled("doc_id"), version: F.xxhash64("text")}).join(
        kept.select(_filled("id").alias(key), F.col("version").alias(version)),
        [key, version],
        "left_semi",
    )
    return found.dropDuplicates([key, version]).select(*names)


def rows_without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs, all columns, whose (doc_id, 64-bit hash of text) is not in found.

    found has columns id and version.
    """
    names = docs.columns
    id_, version = free_name("id", names), free_name("version", names)
    drop = found.select(F.col("id").alias(id_), F.col("version").alias(version)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(version))
    return docs.join(drop, same, "left_anti").select(*names)


def free_name(name: str, taken: list[str]) -> str:
    """A column name that no column of the input has, in any case."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"{name}_"
    return name
