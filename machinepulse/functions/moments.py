"""Count, mean and squared distance from the mean, in a form that can be merged."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def moments(name: str) -> Column:
    """Aggregate: the moments of a column as a struct; null values do not count."""
    n = F.count(name)
    return F.struct(
        n.alias("n"),
        F.coalesce(F.avg(name), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(name) * n, F.lit(0.0)).alias("m2"),
    )


def merged(parts: Column) -> Column:
    """The moments of the union, from an array of the moments of its parts.

    Pair by pair: the squared distance grows by that of the part and by what
    the two means are apart. Sums of squares would lose the digits that large
    values and small spreads leave.
    """
    return F.aggregate(
        F.filter(parts, lambda part: part["n"] > 0),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")),
        lambda known, part: _pair(known, part),
    )


def _pair(a: Column, b: Column) -> Column:
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    return F.struct(
        n.alias("n"),
        (a["mean"] + apart * b["n"] / n).alias("mean"),
        (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"),
    )


def mean(known: Column) -> Column:
    """Null where nothing was counted."""
    return F.when(known["n"] > 0, known["mean"])


def stddev_samp(known: Column) -> Column:
    """Null for fewer than two values."""
    return F.when(known["n"] > 1, F.sqrt(known["m2"] / (known["n"] - 1)))
