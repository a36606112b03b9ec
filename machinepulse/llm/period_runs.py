"""Periodic runs of words, by branching tandem repeats over an enhanced suffix array.

A run is a stretch of words with smallest period q, at least 2q long, that no
neighbouring word extends. Its last 2q words are a branching square: two equal
halves of which the second could not go on as the first did. The starts of the
halves, i and i + q, are suffixes that agree in exactly q words, so they lie in
different children of an LCP interval of depth q. For every interval the
suffixes of the smaller child are taken, and the inverse suffix array tells for
i + depth and i - depth whether they are in the other child. Each square found
is rotated to the left as far as its period holds, and squares that come to the
same stretch are one run with the smallest of their periods.

The texts of a batch share one suffix array. Words of different texts get
different numbers, so no repeat reaches from one text into the next. Suffixes
are ordered by doubling, on which only those still tied go on; the ranks of each
round are kept and give the LCP values from the longest step down. Intervals
are bounds in arrays, there are no tree nodes.

A run of at least `least` words holds a branching square of a depth over
`least` / 4, its period or a multiple, so shallower intervals are not visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from machinepulse.llm.common import bounded_batches
from machinepulse.llm.word_numbers import numbered, together

# Checks of smaller children made at once.
_CHECKS = 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Order and rank of all suffixes, and the classes of their first 2**k tokens.

    Tokens are numbers from 0. A suffix that ends is before one that goes on.
    The classes of each round have one entry more than there are tokens, for
    the empty suffix. There are as many rounds as the longest repeat needs.
    """
    n = len(tokens)
    first = np.append(tokens, -1).astype(np.int64)
    levels = [first]
    key = (first[:-1] + 1) * (first.max() + 2) + first[1:] + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(head)[np.cumsum(head) - 1]
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = start
    width = 2
    # Places in order whose suffix is tied with a neighbour.
    tied = np.flatnonzero(_tied(head))
    while True:
        levels.append(rank.copy())
        if not len(tied):
            return order, rank[:-1], levels
        suffixes = order[tied]
        group = rank[suffixes].astype(np.int64)
        # A tied suffix has at least width tokens, so this stays in the array.
        key = group * (n + 1) + rank[suffixes + width] + 1
        inner = np.argsort(key, kind="stable")
        suffixes, key = suffixes[inner], key[inner]
        order[tied] = suffixes
        head = np.ones(len(tied), bool)
        head[1:] = key[1:] != key[:-1]
        rank[suffixes] = tied[np.flatnonzero(head)[np.cumsum(head) - 1]]
        tied = tied[_tied(head)]
        width *= 2


def _tied(head: np.ndarray) -> np.ndarray:
    """Members of groups of two or more, groups beginning where head is set."""
    alone = head.copy()
    alone[:-1] &= head[1:]
    return ~alone


def common_prefixes(
    order: np.ndarray, levels: list[np.ndarray], depth: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places in order whose suffix shares depth tokens or more with the one before, and how many."""
    known = levels[min(len(levels) - 1, depth.bit_length() - 1)]
    ranks = known[order]
    places = np.flatnonzero(ranks[1:] == ranks[:-1]) + 1
    one, other = order[places - 1].copy(), order[places].copy()
    shared = np.zeros(len(places), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][one] == levels[k][other]).astype(np.int64) << k
        one += step
        other += step
        shared += step
    deep = shared >= depth
    return places[deep], shared[deep]


def children(places: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the first suffix of the child on its left, and the end of that on its right.

    An interval of several children is taken as a chain of pairs: all earlier
    children, and the one that begins at the place.
    """
    left, right = [0] * len(places), [0] * len(places)
    at, depth = places.tolist(), shared.tolist()
    stack: list[int] = []
    begin = before = -2
    for j, place in enumerate(at):
        if place != before + 1:
            for open_ in stack:
                right[open_] = before + 1
            stack.clear()
            begin = place - 1
        while stack and depth[stack[-1]] >= depth[j]:
            right[stack.pop()] = place
        left[j] = at[stack[-1]] if stack else begin
        stack.append(j)
        before = place
    for open_ in stack:
        right[open_] = before + 1
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_squares(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching squares whose period is depth or more."""
    order, rank, levels = suffix_array(tokens)
    places, shared = common_prefixes(order, levels, depth)
    left, right = children(places, shared)
    smaller_left = places - left <= right - places
    low, high = np.where(smaller_left, left, places), np.where(smaller_left, places, right)
    other_low, other_high = np.where(smaller_left, places, left), np.where(smaller_left, right, places)
    starts, periods = [], []
    for part in _parts(high - low):
        sizes = (high - low)[part]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        suffix, period = order[low[part][owner] + within], shared[part][owner]
        for sign in (1, -1):
            partner = suffix + sign * period
            inside = (partner >= 0) & (partner < len(tokens))
            place = rank[np.where(inside, partner, 0)]
            found = inside & (other_low[part][owner] <= place) & (place < other_high[part][owner])
            starts.append(np.minimum(suffix, partner)[found])
            periods.append(period[found])
    none = [np.empty(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(periods or none)


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Cut so that each part holds about _CHECKS, or one interval."""
    cut = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), _CHECKS), side="right")
    cut = np.unique(np.append(cut, [0, len(sizes)])) if len(sizes) else np.empty(0, np.int64)
    for low, high in zip(cut[:-1], cut[1:]):
        yield slice(low, high)


def runs(tokens: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of the runs of at least `least` tokens, by start, then period."""
    # Of the multiples of a small period up to half of least, the largest is at
    # least so deep.
    depth = (least // 2 + 2) // 2
    found: list[tuple[int, int, int]] = []
    starts, periods = branching_squares(tokens, depth)
    ends = starts + 2 * periods
    ending, end_before = [], -1
    for j in np.lexsort((periods, ends)).tolist():
        start, period, end = int(starts[j]), int(periods[j]), int(ends[j])
        if end != end_before:
            ending, end_before = [], end
        # A square in a run of a divisor of its period is that run once more.
        if any(period % q == 0 and start >= s for s, q in ending):
            continue
        begin = _rotated(tokens, start, period)
        q = next(
            (
                q
                for q in range(1, min(depth, period))
                if period % q == 0
                and np.array_equal(tokens[begin : end - q], tokens[begin + q : end])
            ),
            period,
        )
        ending.append((begin, q))
        if end - begin >= least:
            found.append((begin, q, end - begin))
    found.sort()
    table = np.array(found, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 2], table[:, 1]


def _rotated(tokens: np.ndarray, start: int, period: int) -> int:
    """How far to the left the period holds, looked up in ever longer pieces."""
    step = 32
    while start:
        low = max(0, start - step)
        differ = np.flatnonzero(tokens[low:start] != tokens[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, 2 * step
    return start


def find(
    docs: DataFrame, text: str = "text", name: str = "periodic", least: int = 12
) -> DataFrame:
    """docs with a struct column name: n_words, runs, collapsed.

    Words are what lies between ASCII white space, numbered from 0. runs lists
    (start, length, period) of all runs of at least `least` words, by start and
    then period; runs may overlap. collapsed is the text without the words that
    a run repeats, each run keeping its first period, words joined by one space.
    Null and empty texts have no words, no runs and an empty collapsed text.
    Rows are looked at one by one, so repeated rows get equal results; a column
    called name is replaced. Memory is that of the longest text, times the
    logarithm of its longest repeat.
    """
    if least < 2:
        raise ValueError("a run has at least two words")
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(f"struct<n_words:bigint,runs:{RUNS},collapsed:string>")
    def periodic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _described(batch, least)

    return docs.withColumn(name, periodic(F.col(text)))


def _described(texts: pa.Array, least: int) -> pa.Array:
    sizes, counts, collapsed = [], [], []
    columns: list[list[np.ndarray]] = [[], [], []]
    for split in together(texts):
        tokens, first = numbered(split)
        length = np.append(first[1:], len(tokens)) - first
        start, size, period = runs(tokens, least) if len(tokens) else (tokens,) * 3
        owner = np.searchsorted(first, start, side="right") - 1
        for column, values in zip(columns, (start - first[owner], size, period)):
            column.append(values)
        counts.append(np.bincount(owner, minlength=len(split)))
        sizes.append(length)
        change = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + size, -1)
        kept = (np.cumsum(change[:-1]) == 0).tolist()
        repeats = set(owner.tolist())
        for i, words in enumerate(split):
            if i in repeats:
                at = int(first[i])
                words = [w for j, w in enumerate(words, at) if kept[j]]
            collapsed.append(b" ".join(words))
    flat = lambda parts: np.concatenate([np.empty(0, np.int64), *parts])
    found = pa.StructArray.from_arrays(
        [pa.array(flat(column), pa.int64()) for column in columns], ["start", "length", "period"]
    )
    ends = pa.array(np.append(0, np.cumsum(flat(counts))).astype(np.int32))
    return pa.StructArray.from_arrays(
        [
            pa.array(flat(sizes), pa.int64()),
            pa.ListArray.from_arrays(ends, found),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ],
        ["n_words", "runs", "collapsed"],
    )
