from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from machinepulse.llm import lexical_search, registry
from tests.llm.rows import CLASHING, documents, texts

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text: str | None) -> list[str]:
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [t.translate(LOWER) for t in found]


def brute(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if null else i, -score))
    return sorted(out, key=str)


def words(rng: random.Random, n: int) -> str:
    # Common and rare words, signs between them, and letters outside of ASCII.
    return "".join(
        rng.choice(["w", "W", "é", "É"]) + str(int(rng.paretovariate(0.6))) + rng.choice(" ,_-\n")
        for _ in range(n)
    )


def tables(rng: random.Random) -> tuple[list[tuple], list[tuple]]:
    docs = [(i, words(rng, rng.randrange(1, 60))) for i in range(700)]
    items = [(i, words(rng, rng.randrange(1, 25))) for i in range(40)]
    # A third of all documents are copies of a passage of an item, in ordinary texts.
    docs += [(i, f"{items[3][1]} {items[3][1]}") for i in range(1000, 1350)]
    docs += [(i, f"{words(rng, 30)} {items[5][1]} {words(rng, 30)}") for i in range(2000, 2020)]
    # Nulls, texts without terms, ties and repeated rows.
    docs += [(None, items[3][1]), (None, items[7][1]), (3000, None), (3001, ""), (3002, "..")]
    docs += [(5, docs[5][1])] * 3 + [(3003, "one " * 20_000)]
    items += [(40, None), (41, ""), (42, "?!"), (None, items[7][1]), (7, items[7][1])]
    items += [(43, "one one one two"), (44, "neverheard")]
    return docs, items


def benchmark(spark, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    return table.withColumns({name: F.lit(name) for name in CLASHING})


def listed(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [1, 10])
def test_ranks_are_those_of_scoring_every_pair(spark, k):
    docs, items = tables(random.Random(k))
    got = lexical_search.search(texts(spark, *docs), benchmark(spark, items), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert listed(got) == brute(docs, items, k)


def test_small_buckets_and_blocks_give_the_same(spark, monkeypatch):
    docs, items = tables(random.Random(3))
    monkeypatch.setattr(lexical_search, "BUCKET", 16)
    monkeypatch.setattr(lexical_search, "_VECTORS", 100)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 120)
    blocks = list(lexical_search._blocks(benchmark(spark, items)))
    assert len(blocks) > 2 and all(len(b.term) <= 120 for b in blocks)
    got = lexical_search.search(texts(spark, *docs), benchmark(spark, items))
    assert listed(got) == brute(docs, items)


def test_empty_tables_and_sides_without_terms(spark):
    docs, items = texts(spark, (1, "a"), (2, None)), benchmark(spark, [(1, "a"), (2, None)])
    search = lexical_search.search
    assert search(docs.limit(0), items).collect() == []
    assert search(docs, items.limit(0)).collect() == []
    assert search(docs.where("doc_id = 2"), items).collect() == []
    assert search(docs, items.where("item_id = 2")).collect() == []
    # A term that every document holds weighs something only if that rounds to 1 or more.
    assert listed(search(docs, items)) == brute([(1, "a")], [(1, "a")])


def vectors(rng: np.random.Generator, n: int, n_terms: int) -> pa.RecordBatch:
    """Skewed terms, lengths that vary much, ordered by length."""
    rows = []
    for i in range(n):
        held = np.unique((rng.pareto(0.7, rng.integers(1, 12)) * 3).astype(int) % n_terms)
        impact = rng.integers(1, 10 ** int(rng.integers(2, 7)), len(held))
        rows.append((i, held.astype(np.int32), impact.astype(np.int64)))
    root = np.sqrt(np.arange(n_terms))
    norms = [float(np.sqrt(((root[t] * x) ** 2).sum())) for _, t, x in rows]
    order = np.argsort(norms)[::-1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[j][0] for j in order]),
            pa.array([rows[j][1] for j in order], pa.list_(pa.int32())),
            pa.array([rows[j][2] for j in order], pa.list_(pa.int64())),
            pa.array([norms[j] for j in order]),
        ],
        ["doc_id", "term", "impact", "norm"],
    )


def test_bounds_drop_vectors_but_none_that_counts():
    rng = np.random.default_rng(1)
    n_terms, n = 60, 3000
    weight = np.arange(n_terms)
    held = [np.unique(rng.integers(0, n_terms, 9)) for _ in range(30)]
    block = lexical_search.Block(
        list(range(30)),
        {},
        np.append(0, np.cumsum([len(h) for h in held])),
        np.concatenate(held),
        rng.integers(1, 4, sum(map(len, held))),
    )
    items = lexical_search._items(block, weight)
    batch = vectors(rng, n, n_terms)
    best = lexical_search.Best(items, 10)
    scored = 0
    exact = best._exact

    def counted(bucket, item, rows):
        nonlocal scored
        scored += len(rows)
        return exact(bucket, item, rows)

    best._exact = counted
    for at in range(0, n, 100):
        best.add(lexical_search.Bucket(batch.slice(at, 100), n_terms))
    dense = np.zeros((n, n_terms), np.int64)
    for i, t, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "term", "impact"))):
        dense[i, t] = x
    for item in range(30):
        points = np.zeros(n_terms, np.int64)
        part = slice(block.first[item], block.first[item + 1])
        points[block.term[part]] = block.count[part] * weight[block.term[part]]
        scores = dense @ points
        order = np.lexsort((np.arange(n), -scores))[:10]
        assert best.docs[item].tolist() == order.tolist()
        assert best.scores[item].tolist() == scores[order].tolist()
    assert scored < 0.2 * 30 * n


def test_the_query_and_its_columns(spark, tmp_path):
    docs, items = tables(random.Random(5))
    documents(spark, [(i, t, "en", "s") for i, t in docs]).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark(spark, items).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.op12_lexical_search(spark, str(tmp_path))
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert listed(got) == brute(docs, items)
