"""Leaving out rows that match nothing before they are shuffled to a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Bits for each key, and the most bits of all: four megabytes, which each task
# gets. Beyond two million keys a filter of that size lets more rows pass that
# match nothing (one in twenty at four million keys, one in six at eight); the
# join drops them as it would without a filter.
BITS_PER_KEY = 16
MOST_BITS = 1 << 25
_WORD = 64
_LEAST_WORDS = 64


def may_match(keys: DataFrame, names: Sequence[str]) -> Column:
    """A condition on another table with columns of these names and types: true for
    every row whose key is among `keys`, false for nearly all others.

    A Bloom filter as an array of words, two bits a key, sized from the number of
    keys. It is a scalar subquery, so it is made once, when the query runs. Each
    task folds the keys it reads into words before anything is shuffled.
    """
    counted = keys.agg(F.count(F.lit(1))).scalar()
    words = F.least(
        F.lit(MOST_BITS // _WORD),
        F.greatest(F.lit(_LEAST_WORDS), F.ceil(counted * BITS_PER_KEY / _WORD)),
    ).cast("int")
    bits = words.cast("long") * _WORD

    def places(bits: Column) -> list[Column]:
        hashed = F.xxhash64(*names)
        return [F.pmod(hashed, bits), F.pmod(F.shiftrightunsigned(hashed, 31), bits)]

    one = F.lit(1).cast("long")
    at = F.col("at")
    held = keys.select(F.explode(F.array(*places(bits))).alias("at")).select(
        F.call_function("div", at, F.lit(_WORD)).cast("int").alias("word"),
        # The shift takes its distance from the last six bits.
        F.call_function("shiftleft", one, (at % _WORD).cast("int")).alias("bits"),
    )
    empty = keys.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(0), words - 1)).alias("word"), F.lit(0).cast("long").alias("bits")
    )
    folded = held.unionAll(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # At most MOST_BITS / 64 rows.
    filled = folded.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda word: word["bits"]
        ).alias("filled")
    ).scalar()

    def is_set(place: Column) -> Column:
        word = F.get(filled, F.call_function("div", place, F.lit(_WORD)).cast("int"))
        return F.getbit(word, (place % _WORD).cast("int")) == 1

    first, second = places(bits)
    return is_set(first) & is_set(second)
