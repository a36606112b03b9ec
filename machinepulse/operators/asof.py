"""As-of matching: for each row the newest other row at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from machinepulse.functions.periods import ALL_TIME, Period, of_machine, readings_in, verdicts_in
from machinepulse.operators.latest import ordered
from machinepulse.operators.machines import measure
from machinepulse.schemas import EVENT_TIME, VERDICT_FLAGS
from machinepulse.sources.facts import with_event_time

# Seconds of a piece of a machine's time.
PIECE = 86_400


def as_of(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    columns: Sequence[str],
    tolerance: int | None = None,
    piece: int = PIECE,
    name: str = "found",
) -> DataFrame:
    """left with a struct column name: the newest row of right at or before its timestamp.

    Both have a column timestamp; `on` are keys that must be equal, and never
    match where they are null. The struct holds the timestamp and the columns
    of that row, of several at one time the greatest by the columns, and is null
    where there is none, or none within the last `tolerance` seconds. Every row
    of left comes once.

    Both tables are put together, cut into pieces of time, and sorted within a
    piece, where the last row of right seen so far is carried along. A piece
    begins with what the pieces before it end on, one row each, so a key with a
    large share of the rows is as many groups as it has pieces.
    """
    if tolerance is not None and tolerance < 0:
        raise ValueError(f"tolerance must not be negative, got {tolerance}")
    if piece < 1:
        raise ValueError(f"a piece has at least one second, got {piece}")
    taken = {c.lower() for c in left.columns} - {c.lower() for c in (*on, "timestamp")}
    kept, side, place, carried = (_free(c, taken) for c in ("row", "side", "piece", "carried"))
    number: Column = F.floor(F.unix_seconds("timestamp") / piece)
    keys = list(on)
    rows = F.struct("timestamp", *columns)
    found_type = right.select(rows.alias("x")).schema["x"].dataType
    kept_type = left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType

    of_left = left.select(
        *keys, "timestamp", F.lit(2).alias(side), number.alias(place),
        F.struct(*left.columns).alias(kept), F.lit(None).cast(found_type).alias(carried),
    )
    known = [F.col(key).isNotNull() for key in (*keys, "timestamp")]
    timed = right
    for condition in known:
        timed = timed.filter(condition)
    of_right = timed.select(
        *keys, "timestamp", F.lit(1).alias(side), number.alias(place),
        F.lit(None).cast(kept_type).alias(kept), rows.alias(carried),
    )
    # The last row of each piece, and for each piece of left that of the pieces before.
    ends = of_right.groupBy(*keys, place).agg(F.max(carried).alias(carried))
    asked = of_left.select(*keys, place).distinct().withColumn(carried, F.lit(None).cast(found_type))
    both = ends.withColumn("machinepulse_end", F.lit(True)).unionAll(
        asked.withColumn("machinepulse_end", F.lit(False))
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(place).rangeBetween(Window.unboundedPreceding, -1)
    )
    begins = (
        both.withColumn(carried, F.max(carried).over(earlier))
        .filter(~F.col("machinepulse_end") & F.col(carried).isNotNull())
        .select(
            *keys, F.col(f"{carried}.timestamp").alias("timestamp"), F.lit(0).alias(side), place,
            F.lit(None).cast(kept_type).alias(kept), carried,
        )
    )
    so_far = (
        Window.partitionBy(*keys, place)
        .orderBy("timestamp", side)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = (
        begins.unionAll(of_right)
        .unionAll(of_left)
        .withColumn(carried, F.max(carried).over(so_far))
        .filter(F.col(side) == 2)
    )
    found = F.col(carried)
    if tolerance is not None:
        age = F.unix_micros(F.col("timestamp")) - F.unix_micros(found["timestamp"])
        found = F.when(age <= F.lit(tolerance * 1_000_000), found)
    return matched.select(f"{kept}.*", found.alias(name))


def _free(name: str, taken: set[str]) -> str:
    name = f"machinepulse_{name}"
    while name in taken:
        name += "_"
    return name


def trend_asof(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
    tolerance: int | None = 7 * 86_400,
) -> DataFrame:
    """The time series with the verdict that held at each reading: the newest one
    at or before it, of the last week unless told otherwise, and its age.

    `asset_trend` takes verdicts of the same second only. Both sides lie in the
    period.
    """
    series = readings_in(of_machine(readings, machine_id), period).select(
        "machine_id", "timestamp", "health_pct", "operational_time"
    )
    judged = with_event_time(verdicts_in(of_machine(verdicts, machine_id), period)).select(
        "machine_id",
        F.col(EVENT_TIME).alias("timestamp"),
        F.col("timestamp").alias("nanos"),
        "anomaly_score",
        *VERDICT_FLAGS,
    )
    columns = ("nanos", "anomaly_score", *VERDICT_FLAGS)
    found = as_of(series, judged, ["machine_id"], columns, tolerance, name="verdict")
    points = found.select(
        "machine_id",
        "timestamp",
        "operational_time",
        measure("health_pct"),
        F.col("verdict.timestamp").alias("verdict_ts"),
        (F.unix_seconds("timestamp") - F.unix_seconds("verdict.timestamp")).alias("verdict_age_s"),
        measure("anomaly_score", "verdict.anomaly_score"),
        *[F.col(f"verdict.{flag}").alias(flag) for flag in VERDICT_FLAGS],
    )
    return ordered(points, machine_id, F.col("timestamp").asc())
