"""Ranked lexical search by norm buckets: the k best documents of each item.

A document is a vector of impacts, an item one of counts, over the terms of the
items; the score of a pair is their product with the terms' weights, in whole
numbers. For pruning, both sides carry the square root of a weight, so that the
same product is that of two vectors of real numbers. Vectors are ordered by
length (norm) over the whole corpus and cut into buckets:

- A bucket is left out for an item whose length times the longest vector of the
  bucket is under the item's k-th best score so far (Cauchy-Schwarz), or whose
  product with the largest coordinates of the bucket is.
- Inside, the item's largest coordinates (its rarest terms) are worked out for
  all vectors that hold them. What the others can add is at most the product of
  the two remaining lengths, and of the remaining largest coordinates. Vectors
  that cannot reach the k-th score are dropped.
- Those left are scored anew in integers, and these scores alone rank.

The longest vectors are searched first, everywhere at once; their k-th scores
are where the search of the others begins. Each task hands on k rows an item at
most, of which a window takes the best.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from machinepulse.llm.common import bounded_batches, partitions, stored

# All of ASCII but digits and letters separates terms; A-Z are lowered.
_TABLE = bytes(
    ord(chr(b).lower()) if b >= 128 or chr(b) in string.ascii_letters + string.digits else 32
    for b in range(128)
) + bytes(range(128, 256))
# Items are taken in blocks of at most so many pairs of item and term (one
# larger item is a block of its own); a block is sent to every executor, about
# 100 bytes a pair. Each block reads the documents once.
BLOCK_TERMS = 200_000
# Vectors of a bucket.
BUCKET = 2048
# A partition of vectors holds about so many.
_VECTORS = 1 << 13
# The share of vectors, the longest ones, that is searched first.
_FIRST = 1 / 16
# The coordinates worked out first leave at most this share of an item's length.
_REST = 0.5
# Float sums are this near to the exact ones; nothing nearer to the limit is dropped.
_SLACK = 1 + 1e-9

# Fixed values of the impact of a term: parts of a thousand, and the share of
# the score that depends on the document's length, in percent.
SCALE, STEP, LENGTH_SHARE, SATURATION = 1_000_000_000, 1000, 75, 8


def terms(text: str | None) -> list[bytes]:
    """Runs of 0-9, A-Z, a-z and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


class Block(NamedTuple):
    """Items as rows of (term, count), in flat arrays; first has where each begins."""

    ids: list
    vocabulary: dict[bytes, int]
    first: np.ndarray
    term: np.ndarray
    count: np.ndarray


class Items(NamedTuple):
    """A block with weights: coordinates, largest first within an item."""

    first: np.ndarray
    term: np.ndarray
    points: np.ndarray  # count times weight
    coordinate: np.ndarray  # count times root of weight
    norm: np.ndarray
    focus: np.ndarray  # how many coordinates are worked out first
    rest: np.ndarray  # length of the others
    root: np.ndarray  # root of weight, by term
    least: np.ndarray  # scores under this cannot be among the best, by item


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item.

    docs has doc_id (a whole number) and text, items have item_id and text.
    Documents without terms, null texts included, count for nothing. A pair
    without points is not listed, nor is an item without terms. Equal scores go
    by doc_id, null last. Every row is a document of its own and every row an
    item of its own, so repeated rows come repeatedly. Empty tables give no
    rows; other columns are not looked at.
    """
    spark = bounded_batches(docs.sparkSession)
    found = [_search(docs, block, items, k) for block in _blocks(items)]
    if not found:
        schema = StructType(
            [items.schema["item_id"], _long("rank", "int"), docs.schema["doc_id"], _long("score")]
        )
        return spark.createDataFrame([], schema)
    result = found[0]
    for other in found[1:]:
        result = result.unionAll(other)
    return result


def _long(name: str, kind: str = "long") -> StructField:
    return StructField(name, StructType.fromDDL(f"x {kind}")["x"].dataType)


def _blocks(items: DataFrame) -> Iterator[Block]:
    """The items with terms, counted on the way in; one block is held at a time."""
    ids: list = []
    vocabulary: dict[bytes, int] = {}
    pairs: list[list[tuple[int, int]]] = []
    held = 0

    def block() -> Block:
        sizes = [len(p) for p in pairs]
        flat = np.array([pair for p in pairs for pair in p], np.int64).reshape(-1, 2)
        return Block(ids, vocabulary, np.append(0, np.cumsum(sizes)), flat[:, 0], flat[:, 1])

    for item_id, text in items.select("item_id", "text").toLocalIterator():
        counts = Counter(terms(text))
        if not counts:
            continue
        if ids and held + len(counts) > BLOCK_TERMS:
            yield block()
            ids, vocabulary, pairs, held = [], {}, [], 0
        ids.append(item_id)
        pairs.append(
            [(vocabulary.setdefault(t, len(vocabulary)), n) for t, n in counts.items()]
        )
        held += len(counts)
    if ids:
        yield block()


def _search(docs: DataFrame, block: Block, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    vectors = stored(_vectors(docs, block), "search-vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    held = np.zeros(len(block.vocabulary), np.int64)
    # One row for each term of the block at most.
    for term, n in vectors.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        held[term] = n
    weight = np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()],
        np.int64,
    )
    ready = _items(block, weight)
    impacts = _impacts(vectors, ready.root, n_docs, n_terms or 1)
    limit = impacts.agg(F.percentile_approx("norm", 1 - _FIRST, 1000)).first()[0]
    long_ = F.col("norm") >= F.lit(limit)
    first = stored(_best(_scanned(impacts.where(long_), ready, n_docs, k), k), "search-first")
    # One number for each item of the block at most.
    for item, score in first.where(F.col("rank") == k).select("item", "score").collect():
        ready.least[item] = score
    rest = _scanned(impacts.where(~long_), ready, n_docs, k)
    names = spark.createDataFrame(
        list(enumerate(block.ids)),
        StructType([StructField("item", LongType()), items.schema["item_id"]]),
    )
    return (
        _best(first.drop("rank").unionAll(rest), k)
        .join(names, "item")
        .select("item_id", "rank", F.col("doc_id").cast(docs.schema["doc_id"].dataType), "score")
    )


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _vectors(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, n (terms of the whole text), and the block's terms in it with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    @F.arrow_udf("struct<n:bigint,term:array<int>,times:array<int>>")
    def vector(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            n, term, times, ends = [], [], [], [0]
            for text in batch:
                words = terms(text.as_py())
                n.append(len(words))
                for word, count in Counter(words).items():
                    number = known.get(word)
                    if number is not None:
                        term.append(number)
                        times.append(count)
                ends.append(len(term))
            lists = [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                for values in (term, times)
            ]
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), *lists], ["n", "term", "times"]
            )

    found = docs.select(F.col("doc_id").cast("long"), vector(F.col("text")).alias("vector"))
    return found.select("doc_id", "vector.*").where(F.col("n") > 0)


def _items(block: Block, weight: np.ndarray) -> Items:
    root = np.sqrt(weight)
    owner = np.repeat(np.arange(len(block.ids)), np.diff(block.first))
    coordinate = block.count * root[block.term]
    order = np.lexsort((block.term, -coordinate, owner))
    term, coordinate, count = block.term[order], coordinate[order], block.count[order]
    square = np.bincount(owner, coordinate**2, minlength=len(block.ids))
    # Of each item the coordinates before which more than the rest is left.
    before = np.cumsum(coordinate**2) - coordinate**2
    left = square[owner] - (before - before[block.first[:-1]][owner])
    focus = np.bincount(owner, left > (_REST**2) * square[owner], minlength=len(square))
    focus = focus.astype(np.int64)
    outside = np.arange(len(owner)) >= (block.first[:-1] + focus)[owner]
    rest = np.bincount(owner, np.where(outside, coordinate**2, 0), minlength=len(square))
    return Items(
        block.first, term, count * weight[term], coordinate, np.sqrt(square), focus,
        np.sqrt(rest), root, np.ones(len(square), np.int64),
    )


def _impacts(vectors: DataFrame, root: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, term, impact, and the length of the weighted vector; only vectors with terms."""
    shared = vectors.sparkSession.sparkContext.broadcast(root)

    @F.arrow_udf("struct<impact:array<bigint>,norm:double>")
    def weigh(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        roots = shared.value
        for n, term, times in batches:
            sizes = np.diff(term.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            tf = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            m = (100 - LENGTH_SHARE) + (LENGTH_SHARE * n.to_numpy() * n_docs) // n_terms
            impact = (SCALE * tf) // (STEP * tf + SATURATION * m[owner])
            square = (roots[term.flatten().to_numpy(zero_copy_only=False)] * impact) ** 2
            norm = np.sqrt(np.bincount(owner, square, minlength=len(sizes)))
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(ends, pa.array(impact)), pa.array(norm)],
                ["impact", "norm"],
            )

    held = vectors.where(F.size("term") > 0)
    weighed = held.withColumn("weighed", weigh("n", "term", "times"))
    return weighed.select("doc_id", "term", "weighed.*")


def _scanned(impacts: DataFrame, items: Items, n_docs: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each item in each part of the vectors, longest first."""
    spark = impacts.sparkSession
    shared = spark.sparkContext.broadcast(items)
    parts = partitions(n_docs, _VECTORS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value, k)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                best.add(Bucket(batch.slice(at, BUCKET), len(shared.value.root)))
        yield best.rows()

    # Equal vectors have equal lengths; the id keeps them from one partition.
    key = F.xxhash64("doc_id")
    ordered = impacts.repartitionByRange(parts, F.desc("norm"), key).sortWithinPartitions(
        F.desc("norm"), key
    )
    return ordered.mapInArrow(scan, "item long, doc_id long, score long")


class Bucket:
    """Vectors of similar length, by row and by term."""

    def __init__(self, batch: pa.RecordBatch, n_terms: int) -> None:
        lists = {name: batch.column(name) for name in ("term", "impact")}
        self.doc_id = batch.column("doc_id")
        offsets = lists["term"].offsets.to_numpy()
        self.first = offsets - offsets[0]
        self.term = lists["term"].flatten().to_numpy(zero_copy_only=False)
        self.impact = lists["impact"].flatten().to_numpy(zero_copy_only=False)
        self.norm = batch.column("norm").to_numpy()
        order = np.argsort(self.term, kind="stable")
        self.row = np.repeat(np.arange(len(self.norm)), np.diff(self.first))[order]
        self.by_term = self.impact[order]
        self.begin = np.searchsorted(self.term[order], np.arange(n_terms + 1))
        self.largest = np.zeros(n_terms, np.int64)
        held = self.begin[:-1] < self.begin[1:]
        self.largest[held] = np.maximum.reduceat(self.by_term, self.begin[:-1][held])


class Best:
    """The best documents of every item so far."""

    def __init__(self, items: Items, k: int) -> None:
        self.items, self.k = items, k
        self.least = items.least.copy()
        self.docs: list[np.ndarray] = [np.empty(0, np.int64)] * len(items.norm)
        self.nulls: list[np.ndarray] = [np.empty(0, bool)] * len(items.norm)
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * len(items.norm)
        self.points = np.zeros(len(items.root), np.int64)

    def add(self, bucket: Bucket) -> None:
        items = self.items
        near = items.norm * bucket.norm.max() * _SLACK >= self.least
        most = items.coordinate * (items.root * bucket.largest)[items.term]
        near &= np.add.reduceat(most, items.first[:-1]) * _SLACK >= self.least
        nulls = np.asarray(bucket.doc_id.is_null())
        docs = bucket.doc_id.fill_null(0).to_numpy()
        for item in np.flatnonzero(near).tolist():
            rows = self._open_rows(bucket, item, most)
            if not len(rows):
                continue
            scores = self._exact(bucket, item, rows)
            good = scores >= self.least[item]
            if good.any():
                rows = rows[good]
                self._keep(item, docs[rows], nulls[rows], scores[good])

    def _open_rows(self, bucket: Bucket, item: int, most: np.ndarray) -> np.ndarray:
        """Rows of the bucket whose bound reaches the item's least score."""
        items = self.items
        begin, end = items.first[item], items.first[item + 1]
        middle = begin + items.focus[item]
        term = items.term[begin:middle]
        low, high = bucket.begin[term], bucket.begin[term + 1]
        place, owner = _ranges(low, high)
        row = bucket.row[place]
        coordinate = items.root[term][owner] * bucket.by_term[place]
        n = len(bucket.norm)
        got = np.bincount(row, items.coordinate[begin:middle][owner] * coordinate, minlength=n)
        square = np.bincount(row, coordinate**2, minlength=n)
        # A difference of squares is only as exact as the larger of them.
        left = np.sqrt(np.maximum(bucket.norm**2 * _SLACK - square, 0)) * items.rest[item]
        bound = got + np.minimum(left, most[middle:end].sum())
        return np.flatnonzero(bound * _SLACK >= self.least[item])

    def _exact(self, bucket: Bucket, item: int, rows: np.ndarray) -> np.ndarray:
        begin, end = self.items.first[item], self.items.first[item + 1]
        term = self.items.term[begin:end]
        self.points[term] = self.items.points[begin:end]
        low, high = bucket.first[rows], bucket.first[rows + 1]
        place, _ = _ranges(low, high)
        gained = self.points[bucket.term[place]] * bucket.impact[place]
        self.points[term] = 0
        # Every vector has a term, so no range is empty.
        return np.add.reduceat(gained, np.cumsum(high - low) - (high - low))

    def _keep(self, item: int, docs: np.ndarray, nulls: np.ndarray, scores: np.ndarray) -> None:
        docs = np.concatenate([self.docs[item], docs])
        nulls = np.concatenate([self.nulls[item], nulls])
        scores = np.concatenate([self.scores[item], scores])
        best = np.lexsort((docs, nulls, -scores))[: self.k]
        self.docs[item], self.nulls[item], self.scores[item] = docs[best], nulls[best], scores[best]
        if len(best) == self.k:
            self.least[item] = max(self.least[item], self.scores[item][-1])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(s) for s in self.scores]
        columns = [
            pa.array(np.repeat(np.arange(len(sizes)), sizes)),
            pa.array(np.concatenate(self.docs), mask=np.concatenate(self.nulls)),
            pa.array(np.concatenate(self.scores)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each low up to its high, and the number of the range they are of."""
    sizes = high - low
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - (np.cumsum(sizes) - sizes - low)[owner], owner
