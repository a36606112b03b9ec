"""Words of many texts as one array of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts of about so many words are put together; a longer text stands alone.
WORDS = 1 << 16


def together(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of the texts in order, texts of about WORDS words at a time.

    Words lie between ASCII white space; null texts have none.
    """
    split: list[list[bytes]] = []
    n = 0
    for text in texts.cast(pa.binary()):
        # Without an argument bytes are split at ASCII white space alone.
        words = (text.as_py() or b"").split()
        if split and n + len(words) > WORDS:
            yield split
            split, n = [], 0
        split.append(words)
        n += len(words)
    if split:
        yield split


def numbered(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 for each word, equal ones for equal words of one text, and where texts begin.

    Words of two texts never share a number. So a stretch of words that reaches
    into the next text equals no other stretch.
    """
    numbers: list[int] = []
    base = 0
    for words in split:
        known: dict[bytes, int] = {}
        numbers += [base + known.setdefault(w, len(known)) for w in words]
        base += len(known)
    sizes = np.array([len(words) for words in split], np.int64)
    return np.array(numbers, np.int64), np.cumsum(sizes) - sizes
