"""Quality rules: how well a text compresses, beside counts of words, symbols and repeats.

Text that repeats itself compresses too well, and encoded or random text not
well enough. What is normal depends on the length, since a short text gives the
compressor little to refer to, so each length has its own band of zstandard
ratios (compressed by plain size). The whole text is measured, and chunks of a
fixed size too, since a long text can hide a repetitive or random part in an
ordinary whole; a chunk is held against the band of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.llm.common import bounded_batches
from machinepulse.llm.word_numbers import numbered, together


class Band(NamedTuple):
    """Ratios from low to high are normal for texts of at least so many bytes."""

    least_bytes: int
    low: float
    high: float


# By length, longest last. Below 64 bytes the frame outweighs the text and
# nothing is judged. Prose in the Latin alphabet is between 0.34 (long texts)
# and 1.15 (64 bytes); lines said over and over are below the lower limits from
# 256 bytes on, random characters above the upper ones from 1,024 bytes on.
BANDS = (
    Band(0, 0.0, float("inf")),
    Band(64, 0.2, 1.25),
    Band(128, 0.25, 1.05),
    Band(256, 0.3, 0.9),
    Band(1 << 10, 0.26, 0.77),
    Band(1 << 12, 0.22, 0.7),
    Band(1 << 14, 0.2, 0.66),
)
CHUNK = 1 << 12
# A text is rejected if more than this share of its chunks is out of its band.
BAD_CHUNKS = 0.5
LEVEL = 3
# How many words a window has whose repeats are counted.
WINDOW = 5

_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
    "n_repeat_words": "long", "n_bytes": "long", "ratio": "double", "n_chunks": "long",
    "n_repetitive": "long", "n_incompressible": "long",
}
_SCHEMA = "struct<" + ",".join(f"{name}:{kind}" for name, kind in _FIELDS.items()) + ">"


def measure(docs: DataFrame, text: str = "text", name: str = "measures") -> DataFrame:
    """docs with a struct column name: counts and ratios of the whole text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that an earlier line equals), n_repeat_words (words in windows
    of WINDOW words that the text holds twice or more, the first included),
    n_bytes, ratio (null for empty texts), n_chunks, n_repetitive and
    n_incompressible (chunks below and above their band). Null counts as empty.
    Each row is measured on its own; a column called name is replaced.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(_SCHEMA)
    def measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            yield _measured(batch, compressor)

    return docs.withColumn(name, measures(F.col(text)))


def judge(docs: DataFrame, text: str = "text", name: str = "quality") -> DataFrame:
    """docs with a struct column name: the measures, base_failed, verdict and kept.

    base_failed: fewer than 10 words, or over a fifth of them in repeated
    windows. verdict: "normal", "repetitive" or "incompressible", by the whole
    text's band or else by its chunks. kept: not base_failed and normal. Empty
    and null texts are normal by ratio and fail for want of words.
    """
    low, high = _limits(F.col(f"{name}.n_bytes"))
    measures = F.col(name)
    ratio, chunks = measures["ratio"], measures["n_chunks"]
    failed = (measures["n_words"] < 10) | (
        100 * measures["n_repeat_words"] > 20 * measures["n_words"]
    )
    verdict = (
        F.when((ratio < low) | (measures["n_repetitive"] > BAD_CHUNKS * chunks), "repetitive")
        .when((ratio > high) | (measures["n_incompressible"] > BAD_CHUNKS * chunks), "incompressible")
        .otherwise("normal")
    )
    judged = measure(docs, text, name)
    judged = judged.withColumn(
        name, measures.withField("base_failed", failed).withField("verdict", verdict)
    )
    kept = ~F.col(f"{name}.base_failed") & (F.col(f"{name}.verdict") == "normal")
    return judged.withColumn(name, measures.withField("kept", kept))


def _limits(n_bytes: Column) -> tuple[Column, Column]:
    """The band of a length, as columns."""
    low, high = F.lit(BANDS[0].low), F.lit(BANDS[0].high)
    for band in BANDS[1:]:
        reached = n_bytes >= band.least_bytes
        low = F.when(reached, band.low).otherwise(low)
        high = F.when(reached, band.high).otherwise(high)
    return low, high


def band_of(n_bytes: int) -> Band:
    return next(band for band in reversed(BANDS) if n_bytes >= band.least_bytes)


def _measured(texts: pa.Array, compressor: zstandard.ZstdCompressor) -> pa.Array:
    words = [counts for split in together(texts) for counts in repeats(split)]
    rows = [
        (n, *_characters(text), n_repeats, *_ratios(text.encode(), compressor))
        for text, (n, n_repeats) in zip((t.as_py() or "" for t in texts), words)
    ]
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.StructArray.from_arrays(
        [pa.array(c, kinds[kind]) for c, kind in zip(columns, _FIELDS.values())], list(_FIELDS)
    )


def _characters(text: str) -> tuple[int, int, int]:
    """Code points in words, symbols, and lines with a word that an earlier one equals."""
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return chars, symbols, len(lines) - len(set(lines))


def _ratios(
    plain: bytes, compressor: zstandard.ZstdCompressor
) -> tuple[int, float | None, int, int, int]:
    """Bytes, ratio, and chunks: all, those below and those above their band."""
    if not plain:
        return 0, None, 0, 0, 0
    ratio = len(compressor.compress(plain)) / len(plain)
    chunks = repetitive = incompressible = 0
    view = memoryview(plain)
    for at in range(0, len(plain), CHUNK):
        chunk = view[at : at + CHUNK]
        band = band_of(len(chunk))
        own = ratio if len(chunk) == len(plain) else len(compressor.compress(chunk)) / len(chunk)
        chunks += 1
        repetitive += own < band.low
        incompressible += own > band.high
    return len(plain), ratio, chunks, repetitive, incompressible


def repeats(split: list[list[bytes]], window: int = WINDOW) -> list[tuple[int, int]]:
    """For each text how many words it has, and how many are in a window found twice or more."""
    tokens, first = numbered(split)
    sizes = np.append(first[1:], len(tokens)) - first
    if len(tokens) < window:
        return [(n, 0) for n in sizes.tolist()]
    # Classes of windows, one word longer each time. A window that reaches into
    # the next text equals no other.
    classes = tokens
    for shift in range(1, window):
        key = classes[:-1] * (len(tokens) + 1) + tokens[shift:]
        classes = np.unique(key, return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(classes)[classes] > 1)
    change = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + window, -1)
    covered = np.append(0, np.cumsum(np.cumsum(change[:-1]) > 0))
    counts = covered[first + sizes] - covered[first]
    return list(zip(sizes.tolist(), counts.tolist()))
