from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from machinepulse.llm.content_sort import content_groups
from tests.llm.rows import found, texts


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        marked = False
        for i in ids:
            kept = i == best and not marked
            marked |= kept
            out.append((i, best, len(ids), kept, digest))
    return sorted(out, key=lambda row: tuple((v is not None, str(v)) for v in row))


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups_are_those_of_a_dictionary(spark, keep):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b" * 100, "b" * 100 + "x", "ü\n", "", None])) for i in range(60)]
    # A group that holds most rows, repeated rows, and a null identifier.
    rows += [(i, "hot") for i in range(100, 400)] + [(7, "same"), (7, "same"), (None, "same")]
    rows += [(None, "lonely"), (5, "x" * 200_000)]
    got = content_groups(texts(spark, *rows), keep=keep)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found(got, *columns) == brute(rows, keep)


def test_a_large_group_spreads_over_partitions(spark):
    table = texts(spark, *[(i, "hot") for i in range(4000)])
    group = content_groups(table)
    assert group.where("kept").count() == 1
    assert found(group.select("keep_id", "group_size").distinct(), "keep_id", "group_size") == [
        (0, 4000)
    ]


def test_normalized_texts_are_compared(spark):
    from pyspark.sql import functions as F

    table = texts(spark, (1, "A b"), (2, "a B"), (3, "c"))
    got = content_groups(table, normalize=F.lower)
    assert found(got, "doc_id", "keep_id") == [(1, 1), (2, 1), (3, 3)]


def test_an_empty_table(spark):
    assert content_groups(texts(spark, (1, "a")).limit(0)).collect() == []


def test_keep_is_checked(spark):
    with pytest.raises(ValueError, match="smallest or largest"):
        content_groups(texts(spark, (1, "a")), keep="first")
