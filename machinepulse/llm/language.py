"""Language identification with error-correcting output codes.

Each language has a codeword of bits. One binary classifier per bit reads
hashed n-grams of the letters; decoding takes the codeword whose bits cost
least, each bit's loss weighted by how well its classifier did in training.
Where two codewords cost nearly the same, the answer is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from machinepulse.llm.common import bounded_batches, bucket

UNDETERMINED = "und"
DIMENSIONS = 4096
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    """codes: languages x bits of -1 and 1; weights: features x bits; trust: per bit."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, features: np.ndarray) -> tuple[str, float, bool]:
        margins = features @ self.weights + self.bias
        # Logistic loss of each bit against each codeword.
        loss = np.logaddexp(0.0, -margins[None, :] * self.codes) @ self.trust
        cost = np.exp(loss.min() - loss)
        share = cost / cost.sum()
        order = np.argsort(loss, kind="stable")
        ambiguous = len(order) > 1 and bool(share[order[1]] > 0.5 * share[order[0]])
        return self.languages[order[0]], float(share[order[0]]), ambiguous


def letters(text: str | None) -> str:
    """Lower-cased runs of letters, one space between and around them; empty if none.

    Letters are what Unicode calls so; a number such as a half is none.
    """
    run = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not run.replace(" ", "").isalpha():
        run = " ".join("".join(c if c.isalpha() else " " for c in run).split())
    return f" {run} " if run else ""


def features(run: str) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, triples and quadruples."""
    raw = np.frombuffer(run.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    total = np.zeros(DIMENSIONS)
    code = raw
    for k in (1, 2, 3):
        code = code[:-1] * np.uint32(257) + raw[k:] if len(raw) > k else code[:0]
        hashed = (code * np.uint32(2654435761) + np.uint32(k)) >> np.uint32(20)
        total += np.bincount(hashed, minlength=DIMENSIONS)
    return np.sqrt(total / max(total.sum(), 1.0))


def codewords(n: int) -> np.ndarray:
    """Exhaustive codes up to six languages, else spread-out random ones.

    Rows differ in at least half of the bits for exhaustive codes; of random
    codes, the best of many fixed draws by smallest distance is taken.
    """
    if n == 1:
        return np.ones((1, 1))
    if n <= 6:
        bits = 2 ** (n - 1) - 1
        columns = []
        for value in range(1, bits + 1):
            columns.append([-1 if (value >> k) & 1 else 1 for k in range(n - 1)] + [1])
        return np.array(columns, float).T
    bits = int(np.ceil(15 * np.log2(n)))
    rng, best, far = np.random.default_rng(11), None, -1
    for _ in range(50):
        draw = rng.choice([-1.0, 1.0], (n, bits))
        if (np.abs(draw.sum(axis=0)) == n).any():
            continue
        near = min(int((draw[a] != draw[b]).sum()) for a, b in combinations(range(n), 2))
        if near > far:
            best, far = draw, near
    return best if best is not None else 2.0 * np.eye(n) - 1.0


def fit(
    docs: DataFrame,
    train: Column | None = None,
    max_rows: int = 4000,
    rounds: int = 150,
) -> Model:
    """Learn the languages of lang from text.

    The fit takes a bounded sample: per language the max_rows / languages rows
    (at most 1000) whose hashed id is smallest. Rows without lang, or without
    any letter in the text, are left out. Learning nothing gives a model that
    answers und.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if train is not None:
        labelled = labelled.where(train)
    labelled = labelled.select("doc_id", "lang", "text")
    # One row for each language.
    counts = dict(labelled.groupBy("lang").count().collect())
    per_language = max(1, min(1000, max_rows // max(1, len(counts))))
    # The rows that count are found by id first: texts stay out of the ranking.
    chosen = docs.sparkSession.createDataFrame(
        _smallest(labelled, counts, per_language), StructType([docs.schema["doc_id"]])
    ).distinct()
    rows = (
        labelled.join(F.broadcast(chosen), "doc_id")
        .select("lang", "text")
        .mapInPandas(_features, "lang string, x binary")
        .toPandas()
    )
    return _train(rows["lang"].to_numpy(), list(rows["x"]), rounds)


def _smallest(labelled: DataFrame, counts: dict[str, int], each: int) -> list[tuple]:
    """The ids of the rows that count: of each language those whose hashed id is smallest.

    A threshold on the hash, from the counted rows of a language, leaves about
    four times as many as are wanted, so no language meets in one task. Should
    it leave too few, it is raised.
    """
    hashed = F.xxhash64("doc_id")
    place = Window.partitionBy("lang").orderBy("hash", "doc_id")
    for spread in (4, 64, None):
        limit = F.lit(None).cast("long")
        for lang, n in counts.items():
            share = min(1.0, spread * each / n) if spread else 1.0
            most = min(2**63 - 1, -(2**63) + int(share * 2**64))
            limit = F.when(F.col("lang") == lang, F.lit(most)).otherwise(limit)
        found = (
            labelled.select("doc_id", "lang", hashed.alias("hash"))
            .where(F.col("hash") <= limit)
            .withColumn("place", F.row_number().over(place))
            .where(F.col("place") <= each)
            .select("doc_id", "lang")
            .collect()
        )
        held = Counter(row.lang for row in found)
        if all(held[lang] >= min(n, each) for lang, n in counts.items()):
            break
    return [(row.doc_id,) for row in found]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        runs = [letters(t) for t in batch["text"]]
        kept = [i for i, run in enumerate(runs) if run]
        x = [features(runs[i]).astype("<f4").tobytes() for i in kept]
        yield pd.DataFrame({"lang": batch["lang"].iloc[kept].to_numpy(), "x": x})


def _train(lang: np.ndarray, rows: list, rounds: int) -> Model:
    languages = sorted(set(lang))
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((DIMENSIONS, 1)), np.zeros(1), np.ones(1))
    x = np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), DIMENSIONS)
    place = np.searchsorted(languages, lang)
    codes = codewords(len(languages))
    target = (codes[place] > 0).astype("float32")
    # Each language weighs alike, however many rows it has.
    row_weight = (1.0 / np.bincount(place)[place] / len(languages)).astype("float32")[:, None]
    w, b = np.zeros((DIMENSIONS, codes.shape[1]), "float32"), np.zeros(codes.shape[1], "float32")
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = row_weight * (p - target)
        dw, db = x.T @ g + 1e-6 * w, g.sum(axis=0)
        gw, gb = gw + dw**2, gb + db**2
        w -= 0.5 * dw / np.sqrt(gw)
        b -= 0.5 * db / np.sqrt(gb)
    right = (row_weight * (((x @ w + b) > 0) == (target > 0))).sum(axis=0).clip(0.5, 1 - 1e-3)
    trust = np.log(right / (1 - right)) + 1e-3
    return Model(languages, codes, w.astype(float), b.astype(float), trust / trust.sum() * len(trust))


def identify(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """docs with a struct column name of lang_pred, score (0 to 1) and ambiguous.

    Texts that are null or hold no letter are und with score 0. A column called
    name is replaced. The model is broadcast; its size is fixed by DIMENSIONS
    and the number of languages.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for batch in batches:
            out = []
            for t in batch:
                run = letters(t)
                known = run and fitted.languages
                out.append(fitted.decode(features(run)) if known else (UNDETERMINED, 0.0, False))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    return docs.withColumn(name, answer(F.col(text)))


def training_rows() -> Column:
    """Rows the contract lets the model see: crc32(doc_id) mod 3 is not 1."""
    return bucket("doc_id", 3) != 1
