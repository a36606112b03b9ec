"""Newest rows per group, and matching verdicts with their readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from machinepulse.schemas import EVENT_TIME
from machinepulse.sources.facts import with_event_time


def newest(columns: Sequence[str], where: Column | None = None) -> Column:
    """Aggregate: the columns of the newest row, as a struct led by timestamp.

    Ordering whole structs settles equal timestamps by the remaining columns,
    so a re-run picks the same row. Each task reduces its input to one row per
    machine before anything is shuffled, whatever share of the rows one machine
    has.
    """
    row = F.struct("timestamp", *columns)
    return F.max(row if where is None else F.when(where, row))


# Pieces of a group that are cut to the limit on their own.
_PIECES = 64


def newest_rows(
    df: DataFrame,
    group: Sequence[str],
    limit: int | None,
    order: Sequence[str],
    large_groups: bool = True,
) -> DataFrame:
    """The `limit` newest rows of each group; None leaves all of them.

    More than one row per group is found in two steps, first in hashed pieces
    of a group and then among what the pieces kept, so that a group sends at
    most `limit` rows per piece to one task, whatever the limit and however
    many tasks read it. Spark's own cut before the shuffle, which holds for
    small limits only, comes on top. Without `large_groups` the first step is
    left out.
    """
    if limit is None:
        return df
    if limit > 1 and large_groups:
        piece = F.pmod(F.xxhash64(*order), F.lit(_PIECES))
        pieces = df.withColumn("machinepulse_piece", piece)
        df = _cut(pieces, [*group, "machinepulse_piece"], limit, order).drop("machinepulse_piece")
    return _cut(df, group, limit, order)


def _cut(df: DataFrame, group: Sequence[str], limit: int, order: Sequence[str]) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*[F.col(name).desc_nulls_last() for name in order])
    return (
        df.withColumn("machinepulse_place", F.row_number().over(window))
        .filter(F.col("machinepulse_place") <= limit)
        .drop("machinepulse_place")
    )


def latest_rows(df: DataFrame, columns: Sequence[str], *group: str) -> DataFrame:
    """The newest row of each machine, or of each machine and further group.

    Same row as `newest` picks. For wide rows on their own this is the cheaper
    way: rows behind the newest are dropped while still sorted by time, instead
    of being compared as structs.
    """
    own = df.select("machine_id", "timestamp", *columns, *group)
    return newest_rows(own, ["machine_id", *group], 1, ["timestamp", *columns])


def matched(
    verdicts: DataFrame,
    readings: DataFrame,
    verdict_columns: Sequence[str],
    reading_columns: Sequence[str],
) -> DataFrame:
    """Verdicts joined with the reading of the same machine and microsecond.

    The key holds the time, so a machine with many rows is spread over all join
    partitions.
    """
    timed = with_event_time(verdicts).select(
        "machine_id",
        F.col(EVENT_TIME).alias("timestamp"),
        F.col("timestamp").alias("nanos"),
        *verdict_columns,
    )
    return timed.join(
        readings.select("machine_id", "timestamp", *reading_columns),
        ["machine_id", "timestamp"],
    )


def ordered(df: DataFrame, machine_id: str | None, *order: Column) -> DataFrame:
    """Sorted rows of one machine. Over all machines the order across machines
    carries nothing, and a total sort of a large result would be one more shuffle."""
    return df if machine_id is None else df.orderBy(*order)
