"""Normal operating ranges per machine type, as literal lookups.

The table is fixed and tiny, so a lookup is a CASE over literals inside the
same projection; it needs neither a join nor a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from machinepulse.functions.numbers import number_text, rounded

# Fixed values: (lowest, highest) normal value per machine type and sensor.
NORMAL_RANGES = {
    "conveyor": {"temperature": (0.0, 60.0), "vibration": (0.0, 4.5)},
    "furnace": {"temperature": (1150.0, 1250.0)},
    "motor": {"temperature": (0.0, 70.0), "vibration": (0.0, 4.5)},
    "slurry_pump": {
        "temperature": (0.0, 70.0),
        "vibration": (0.0, 4.5),
        "pressure": (4.5, 5.5),
    },
}

# Unit of each sensor.
UNITS = {"temperature": "°C", "vibration": "mm/s", "pressure": "bar"}


def _bound(machine_type: Column, sensor: str, side: int) -> Column:
    kind = F.lower(machine_type)
    found = F.lit(None).cast("double")
    for name, sensors in NORMAL_RANGES.items():
        if sensor in sensors:
            found = F.when(kind == name, F.lit(sensors[sensor][side])).otherwise(found)
    return found


def range_min(machine_type: Column, sensor: str) -> Column:
    return _bound(machine_type, sensor, 0)


def range_max(machine_type: Column, sensor: str) -> Column:
    return _bound(machine_type, sensor, 1)


def range_position(value: Column, low: Column, high: Column) -> Column:
    """above, below, within (bounds included) or no spec."""
    return (
        F.when(low.isNull(), F.lit("no spec"))
        .when(value > high, F.lit("above"))
        .when(value < low, F.lit("below"))
        .when(value.isNotNull(), F.lit("within"))
    )


def range_deviation(value: Column, low: Column, high: Column) -> Column:
    """Percent beyond the crossed bound, 0 within; null where the bound is 0."""
    beyond = (
        F.when(value > high, F.try_divide(value - high, high) * 100)
        .when(value < low, F.try_divide(low - value, low) * 100)
        .when(value.isNotNull() & low.isNotNull(), F.lit(0.0))
    )
    return rounded(beyond, 1)


def out_of_range_count(machine_type: Column, values: dict[str, Column]) -> Column:
    """How many of the given sensors lie outside their normal range."""
    count = F.lit(0)
    for sensor, value in values.items():
        outside = (value > range_max(machine_type, sensor)) | (
            value < range_min(machine_type, sensor)
        )
        count = count + F.coalesce(outside, F.lit(False)).cast("int")
    return count


def explanation(
    sensor: str, machine_type: Column, value: Column, low: Column, high: Column
) -> Column:
    """One sentence on why a sensor was flagged, by its place in the range."""
    unit = F.lit(f" {UNITS[sensor]}")
    measured = F.concat(
        F.lit(f"{sensor.capitalize()} of the "), machine_type, F.lit(" is "),
        number_text(value), unit,
    )
    position = range_position(value, low, high)
    return F.concat(
        measured,
        F.when(
            position == "above",
            F.concat(F.lit(", over the upper limit of "), number_text(high), unit,
                     F.lit("; an inspection is advised.")),
        )
        .when(
            position == "below",
            F.concat(F.lit(", under the lower limit of "), number_text(low), unit,
                     F.lit("; operating conditions look unusual.")),
        )
        .when(
            position == "within",
            F.concat(F.lit(", inside the usual "), number_text(low), F.lit(" to "),
                     number_text(high), unit,
                     F.lit("; the model flagged it against the type baseline.")),
        )
        .otherwise(F.lit("; the guide states no usual range, the model alone flagged it.")),
    )
