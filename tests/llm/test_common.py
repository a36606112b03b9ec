from __future__ import annotations

import inspect
from collections.abc import Iterator

import pytest

from machinepulse.llm.common import handing_back, rows_leading
from tests.llm.rows import texts


def doubled(batches: Iterator[int]) -> Iterator[int]:
    for batch in batches:
        if batch is None:
            raise ValueError("no batch")
        yield 2 * batch


def test_a_task_that_hands_memory_back_yields_the_same():
    task = handing_back(doubled)
    assert list(task(iter([1, 2, 3]))) == [2, 4, 6] and list(task(iter([]))) == []
    # What Spark reads off a function stays.
    assert inspect.signature(task) == inspect.signature(doubled)
    with pytest.raises(ValueError, match="no batch"):
        list(task(iter([1, None])))


def test_rows_are_kept_by_id_and_text(spark):
    docs = texts(spark, (1, "a"), (1, "b"), (1, "a"), (None, "a"), (None, None), (2, "a"))
    kept = docs.where("doc_id is null or text = 'a' and doc_id = 1").selectExpr(
        "doc_id AS id", "xxhash64(text) AS version"
    )
    got = rows_leading(docs, kept)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == [
        (1, "a"), (None, "a"), (None, None),
    ]
