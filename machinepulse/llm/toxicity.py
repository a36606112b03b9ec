"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum of w_i + sum over pairs of <v_i, v_j>), over the terms
present in a text. The pairwise part learns what a linear model cannot: two
terms that are harmless alone and toxic together, such as an insult beside the
mention of a group. Terms are words and word beginnings, the latter so that an
inflected word shares weight with its other forms.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.llm.common import bounded_batches, bucket, handing_back, stored

BUCKETS = 1 << 18
_WORD = re.compile(r"\w+")
_STEMS = (4, 5, 6)
_CACHE = 150_000


@dataclass(frozen=True)
class Model:
    """slots maps a bucket to its place in w and v, or to -1."""

    bias: float
    slots: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def score(self, places: np.ndarray) -> float:
        """Probability for a text with these distinct places."""
        x = self.v[places]
        s = x.sum(axis=0)
        z = self.bias + self.w[places].sum() + 0.5 * float((s * s - (x * x).sum(axis=0)).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0))))


def term_buckets(word: str) -> list[int]:
    terms = [word, *(f"{word[:k]}*" for k in _STEMS if len(word) > k)]
    return [zlib.crc32(t.encode()) % BUCKETS for t in terms]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    train: Column | None = None,
    max_per_class: int = 4000,
    selected: int = 4096,
    factors: int = 4,
) -> Model:
    """Learn from labelled documents.

    The fit takes a bounded sample: of each class the max_per_class documents
    whose hashed id is smallest. train restricts the labels further. Several
    labels of one document count as 1 if any is 1; null labels and labels
    without document are left out. With no label, or one class only, the model
    is the constant class share.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if train is not None:
        marked = marked.where(train)
    marked = marked.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    marked = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = [
        marked.where(F.col("y") == y).orderBy(order, "doc_id").limit(max_per_class) for y in (0, 1)
    ]
    # At most 2 * max_per_class rows of two numbers: small enough to repeat.
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = stored(
        docs.select("doc_id", "text")
        .join(sample, "doc_id")
        .select("y", "text")
        .mapInPandas(handing_back(_features), "y int, x binary"),
        "sampled-terms",
    )
    n, positives = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if positives in (0, n):
        # No label at all scores low: nothing is known to be toxic.
        share = (positives + 0.5) / (n + 1.0) if n else 0.01
        unknown = np.full(BUCKETS, -1, np.int32)
        return Model(
            float(np.log(share / (1 - share))), unknown, np.zeros(0), np.zeros((0, factors))
        )
    # One row for each of BUCKETS terms at most; of the texts only the chosen
    # terms come to the driver, however long they are.
    seen = (
        rows.mapInPandas(_counted, "term int, df long, a long")
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("a").alias("a"))
        .toArrow()
    )
    term = seen.column("term").to_numpy()
    df, a = np.zeros(BUCKETS), np.zeros(BUCKETS)
    df[term], a[term] = seen.column("df").to_numpy(), seen.column("a").to_numpy()
    slots = _slots(df, a, n, positives, selected)
    held = rows.mapInPandas(_chosen(slots), "y int, x binary").toArrow()
    x = [np.frombuffer(b, "<i4") for b in held.column("x").to_pylist()]
    best = slots >= 0
    return _train(held.column("y").to_numpy(), x, slots, df[best], a[best], factors)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        buckets = [sorted({b for w in words(t) for b in term_buckets(w)}) for t in batch["text"]]
        x = [np.array(b, "<i4").tobytes() for b in buckets]
        yield pd.DataFrame({"y": batch["y"], "x": x})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each term of a batch how many texts hold it, and how many of them are labelled 1."""
    for batch in batches:
        x = [np.frombuffer(b, "<i4") for b in batch["x"]]
        terms = np.concatenate([np.empty(0, "<i4"), *x])
        y = np.repeat(batch["y"].to_numpy(), [len(b) for b in x])
        term, place = np.unique(terms, return_inverse=True)
        df, a = np.bincount(place), np.bincount(place, weights=y)
        yield pd.DataFrame({"term": term, "df": df, "a": a.astype(np.int64)})


def _chosen(slots: np.ndarray) -> Callable:
    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = [slots[np.frombuffer(b, "<i4")] for b in batch["x"]]
            x = [p[p >= 0].astype("<i4").tobytes() for p in places]
            yield pd.DataFrame({"y": batch["y"], "x": x})

    return chosen


def _slots(df: np.ndarray, a: np.ndarray, n: int, positives: int, selected: int) -> np.ndarray:
    """A place from 0 for the terms that depend on the label most (chi-square), else -1."""
    p = positives / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (a - df * p) ** 2 / (df * p * (1 - p) * (1 - df / n).clip(1e-9))
    chi[(df < 3) | ~np.isfinite(chi)] = 0.0
    best = np.argsort(-chi, kind="stable")[:selected]
    best = np.sort(best[chi[best] > 12.0])
    slots = np.full(BUCKETS, -1, np.int32)
    slots[best] = np.arange(len(best))
    return slots


def _train(
    y: np.ndarray, docs: list, slots: np.ndarray, df: np.ndarray, a: np.ndarray, factors: int
) -> Model:
    """Full-batch Adagrad, over documents as lists of places.

    It begins at half the log odds of each term, so that a single strong term
    weighs enough even if toxic texts usually hold several.
    """
    n, positives, m = len(y), int(y.sum()), len(df)
    p = positives / n
    owner = np.repeat(np.arange(n, dtype=np.int32), np.fromiter(map(len, docs), np.int64, n))
    place = np.concatenate(docs) if docs else np.empty(0, np.int32)
    rng = np.random.default_rng(7)
    w = 0.5 * (
        np.log((a + 1) / (positives + 2))
        - np.log((df - a + 1) / (n - positives + 2))
    )
    v, b = rng.normal(0.0, 0.01, (m, factors)), -2.0
    gw, gv, gb = np.full(m, 1e-8), np.full((m, factors), 1e-8), 1e-8
    weight = np.where(y == 1, 0.5 / p, 0.5 / (1 - p))
    rate, decay = 0.3, 1e-5

    def sums(values: np.ndarray, by: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(by, weights=c, minlength=size) for c in values.T], axis=1)

    for _ in range(150):
        x = v[place]
        s = sums(x, owner, n)
        pair = 0.5 * (s**2 - sums(x * x, owner, n)).sum(axis=1)
        z = b + np.bincount(owner, weights=w[place], minlength=n) + pair
        g = weight * (1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y) / n
        dw = np.bincount(place, weights=g[owner], minlength=m) + decay * w
        dv = sums(g[owner, None] * (s[owner] - x), place, m) + decay * v
        gw, gv, gb = gw + dw**2, gv + dv**2, gb + g.sum() ** 2
        w -= rate * dw / np.sqrt(gw)
        v -= 0.1 * rate * dv / np.sqrt(gv)
        b -= rate * g.sum() / np.sqrt(gb)
    # Both classes weigh alike, so 0.5 is where a text speaks for neither.
    return Model(b, slots, w, v)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column name (0 to 1), from the whole text alone.

    Null and empty texts get the score of a text without known terms. A column
    called name is replaced. The model is broadcast; its size is fixed by
    BUCKETS and the number of selected terms.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for t in batch:
                places: set[int] = set()
                for word in words(t):
                    found = known.get(word)
                    if found is None:
                        if len(known) >= _CACHE:
                            known.clear()
                        slots = fitted.slots[term_buckets(word)]
                        found = known[word] = tuple(slots[slots >= 0].tolist())
                    places.update(found)
                scores.append(fitted.score(np.fromiter(sorted(places), np.int64, len(places))))
            yield pd.Series(scores, dtype="float64")

    answer = F.pandas_udf(handing_back(probability), "double")
    return docs.withColumn(name, answer(F.col(text)))


def training_rows() -> Column:
    """Labels the contract lets the model see: crc32(doc_id) mod 5 is not 0."""
    return bucket("doc_id", 5) != 0
