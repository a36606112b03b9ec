"""Exact duplicates by sorting contents.

Spark samples splitters and ranges the rows over partitions by content; an
external sort inside each partition puts equal texts side by side; each row is
compared in full with the one before it. No group is ever gathered: a group
that holds a third of all rows spreads over neighbouring partitions, since the
identifier is the last part of the range key, and is put together again from
one light row per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from machinepulse.llm.common import stored

# Leading characters in the range key. Splitters reach the driver, so they must
# be short; the digest behind it orders texts that share their beginning.
HEAD = 32


def content_groups(
    docs: DataFrame,
    text: str = "text",
    identifier: str = "doc_id",
    normalize: Callable[[Column], Column] = lambda c: c,
    keep: str = "smallest",
) -> DataFrame:
    """One row per row of docs: identifier, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after normalize, compared in full. keep says
    which identifier of a group stays, "smallest" or "largest". Null texts
    count as empty, and empty texts equal each other. A null identifier stays
    only if the group has no other. Of rows that share text and identifier
    exactly one is kept. An empty table gives an empty table; other columns of
    docs are not looked at, so their names cannot clash.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    best, order = (
        (F.max, lambda c: F.desc_nulls_last(c))
        if keep == "largest"
        else (F.min, lambda c: F.asc_nulls_last(c))
    )
    body = normalize(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(identifier).alias("id"), body.alias("body")).select(
        "id", F.substring("body", 1, HEAD).alias("head"), F.sha2("body", 256).alias("sha"), "body"
    )
    keys = [F.col("head"), F.col("sha"), order("id")]
    id_type = docs.schema[identifier].dataType.simpleString()
    marked = stored(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("id", "sha", "body")
        .mapInArrow(_mark_runs, f"id {id_type}, sha string, part int, leads boolean"),
        "content-runs",
    )
    # One row per run and partition, so a group has at most one per partition.
    runs = marked.groupBy("sha", "part").agg(F.count("*").alias("n"), best("id").alias("best"))
    group = Window.partitionBy("sha")
    totals = runs.select(
        "sha",
        "part",
        F.sum("n").over(group).alias("group_size"),
        best("best").over(group).alias("keep_id"),
        F.min("part").over(group).alias("first_part"),
    )
    # Keyed on the partition too, so that a large group's rows stay spread.
    return marked.join(totals, ["sha", "part"]).select(
        F.col("id").alias(identifier),
        "keep_id",
        "group_size",
        (F.col("leads") & (F.col("part") == F.col("first_part"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each text with the one before it, also across batches."""
    part = TaskContext.get().partitionId()
    last_sha, last_body = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sha, body = batch.column("sha"), batch.column("body")
        same_sha, same = [sha[0].as_py() == last_sha], [body[0].as_py() == last_body]
        if n > 1:
            same_sha += pc.equal(sha[1:], sha[:-1]).to_pylist()
            same += pc.equal(body[1:], body[:-1]).to_pylist()
        if same != same_sha:
            raise ValueError("different texts share a SHA-256 digest")
        yield pa.record_batch(
            [
                batch.column("id"),
                sha,
                pa.array([part] * n, pa.int32()),
                pa.array([not s for s in same], pa.bool_()),
            ],
            names=["id", "sha", "part", "leads"],
        )
        last_sha, last_body = sha[n - 1].as_py(), body[n - 1].as_py()
