"""Health bands, priorities and display rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Cut points of the health percentage (higher is better).
HEALTHY_FROM = 80
WARNING_FROM = 55
BORDERLINE_FROM = 30

# Estimated remaining life in days per band, worst band first.
RUL_CRITICAL = 3
RUL_BORDERLINE = 7
RUL_WARNING = 30
RUL_HEALTHY = 90

# A week-on-week change within this many points counts as flat.
FLAT_TREND = 0.5

# Shares of the score spread from which severity is medium, high.
MEDIUM_FROM = 0.33
HIGH_FROM = 0.66


def by_band(
    health: Column, *, critical: object, borderline: object, warning: object, healthy: object
) -> Column:
    """One value per band; a missing health takes the last."""
    return (
        F.when(health < BORDERLINE_FROM, F.lit(critical))
        .when(health < WARNING_FROM, F.lit(borderline))
        .when(health < HEALTHY_FROM, F.lit(warning))
        .otherwise(F.lit(healthy))
    )


def status_from_health(health: Column) -> Column:
    """The status a health percentage implies; null for a missing one."""
    status = by_band(
        health,
        critical="CRITICAL", borderline="BORDERLINE", warning="WARNING", healthy="HEALTHY",
    )
    return F.when(health.isNotNull(), status)


def health_band(health: Column) -> Column:
    """Display band; a missing health counts as poor."""
    return (
        F.when(health >= HEALTHY_FROM, F.lit("good"))
        .when(health >= WARNING_FROM, F.lit("fair"))
        .otherwise(F.lit("poor"))
    )


def rul_days(health: Column) -> Column:
    """Estimated remaining useful life; a missing health gets the longest."""
    return by_band(
        health,
        critical=RUL_CRITICAL, borderline=RUL_BORDERLINE,
        warning=RUL_WARNING, healthy=RUL_HEALTHY,
    ).cast("int")


def priority(health: Column, is_anomaly: Column) -> Column:
    """Urgent needs an anomaly on top of critical health; null for a missing health."""
    calm = by_band(health, critical="High", borderline="High", warning="Medium", healthy="Low")
    urgent = (health < BORDERLINE_FROM) & F.coalesce(is_anomaly, F.lit(False))
    return F.when(urgent, F.lit("Urgent")).when(health.isNotNull(), calm)


def trend_direction(trend: Column) -> Column:
    """A missing trend is neither up nor down."""
    return (
        F.when(trend < -FLAT_TREND, F.lit("down"))
        .when(trend > FLAT_TREND, F.lit("up"))
        .otherwise(F.lit("flat"))
    )


def count_true(*flags: Column) -> Column:
    """How many flags are set; a missing flag is not."""
    ones = [F.coalesce(flag, F.lit(False)).cast("int") for flag in flags]
    return reduce(lambda left, right: left + right, ones)


def asset_state(active_flags: Column, past_events: Column) -> Column:
    """Flagged now, anomalous earlier in the period, or normal."""
    return (
        F.when(active_flags > 0, F.lit("flagged"))
        .when(past_events > 0, F.lit("past"))
        .otherwise(F.lit("normal"))
    )


def severity(ratio: Column) -> Column:
    """Severity from a score scaled to 0-1."""
    return (
        F.when(ratio >= HIGH_FROM, F.lit("high"))
        .when(ratio >= MEDIUM_FROM, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def task_mode(is_anomaly: Column, health: Column, past_events: Column) -> Column:
    """A: anomalous now. B: degraded or with a history. C: healthy.

    A missing health is not known to be good and counts as degraded.
    """
    return report_format(is_anomaly, health, past_events, F.lit(0))


def report_format(
    is_anomaly: Column, health: Column, past_events: Column, out_of_range: Column
) -> Column:
    """`task_mode`, where a sensor outside its normal range also means B."""
    degraded = (
        F.coalesce(health < HEALTHY_FROM, F.lit(True))
        | (F.coalesce(past_events, F.lit(0)) > 0)
        | (out_of_range > 0)
    )
    return (
        F.when(F.coalesce(is_anomaly, F.lit(False)), F.lit("A"))
        .when(degraded, F.lit("B"))
        .otherwise(F.lit("C"))
    )
