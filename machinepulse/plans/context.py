"""Text contexts for downstream assistants, in this package's own wording.

Whatever belongs to one machine or one conversation becomes one text. The line
per machine of the fleet stays a table of lines: it is the same for every
question, so it is stored once instead of being copied into each prompt, and no
task ever holds the whole fleet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.functions.numbers import number_text, shown
from machinepulse.functions.periods import ALL_TIME, Period
from machinepulse.functions.ranges import UNITS
from machinepulse.operators.fleet import health_figures, kpi_anomaly_count, kpi_latest
from machinepulse.operators.guide import guide_for_type, guide_type
from machinepulse.operators.machines import fleet_rows
from machinepulse.operators.turns import TURN_LIMIT, open_questions
from machinepulse.plans.reports import machine_report, with_rules
from machinepulse.schemas import SENSOR_FLAGS, SENSORS

BLANK_LINE = "\n\n"

# What each task mode asks for.
TASKS = {
    "A": "Task: explain the active anomaly from the flagged sensors and the history.",
    "B": "Task: explain why the machine is degraded and what to do about it.",
    "C": "Task: confirm normal operation after checking every sensor range.",
}


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _figures_text(figures: DataFrame, label: str) -> DataFrame:
    def count(name: str) -> Column:
        return F.col(name).cast("string")

    return figures.select(
        _lines(
            F.lit(f"Fleet figures, {label}"),
            _labelled("Machines", count("total_machines")),
            _labelled("Mean health %", number_text(F.coalesce("avg_health", F.lit(0.0)))),
            F.concat(
                _labelled("Healthy", count("healthy_count")),
                _labelled(", warning", count("warning_count")),
                _labelled(", critical", count("critical_count")),
            ),
            _labelled("Anomalous verdicts", count("anomaly_count")),
        ).alias("fleet_text")
    )


def fleet_header(
    readings: DataFrame, verdicts: DataFrame, period: Period = ALL_TIME
) -> DataFrame:
    """The fleet figures as one text, in one row."""
    figures = kpi_latest(readings, period).withColumn(
        "anomaly_count", kpi_anomaly_count(verdicts, period).scalar()
    )
    return _figures_text(figures, period.label)


def fleet_context(
    readings: DataFrame, verdicts: DataFrame, period: Period = ALL_TIME
) -> DataFrame:
    """The fleet text as lines: section 0 the figures, section 1 a line per
    machine. Sorted by section, health and machine they read lowest health
    first; `df.write.text` of the sorted lines is the whole text.

    Figures and lines come from the same rows per machine, whose shuffle Spark
    then runs once.
    """
    rows = fleet_rows(readings, verdicts, period)
    figures = rows.agg(*health_figures("health_order", "health_status")).withColumn(
        "anomaly_count", kpi_anomaly_count(verdicts, period).scalar()
    )
    header = _figures_text(figures, period.label).select(
        F.lit(0).alias("section"),
        F.lit(None).cast("double").alias("health_order"),
        F.lit("").alias("machine_id"),
        F.col("fleet_text").alias("line"),
    )
    machines = rows.select(
        F.lit(1).alias("section"),
        "health_order",
        "machine_id",
        F.concat_ws(
            "; ",
            F.concat(F.col("machine_id"), F.lit(" "), shown(F.col("machine_type"))),
            F.concat(
                _labelled("health %", number_text(F.col("health_pct"))),
                F.lit(" "),
                shown(F.col("health_status")),
            ),
            *[_labelled(sensor, number_text(F.col(sensor))) for sensor in SENSORS],
            _labelled("anomalous", F.col("is_anomaly").cast("string")),
            _labelled("events", F.col("anomaly_history_count").cast("string")),
        ).alias("line"),
    )
    return header.unionByName(machines).orderBy(
        "section", F.col("health_order").asc_nulls_last(), "machine_id"
    )


def _history_text(label: str) -> Column:
    title = F.lit(f"Anomaly history, {label}")

    def time(name: str) -> Column:
        return F.date_format(name, "yyyy-MM-dd HH:mm:ss")

    recorded = _lines(
        title,
        _labelled("Events", F.col("anomaly_history_count").cast("string")),
        F.concat(
            _labelled("By sensor: temperature", F.col("temp_anomaly_count").cast("string")),
            _labelled(", vibration", F.col("vib_anomaly_count").cast("string")),
            _labelled(", pressure", F.col("press_anomaly_count").cast("string")),
        ),
        _labelled("First", shown(time("first_anomaly_ts"))),
        _labelled("Last", shown(time("last_anomaly_ts"))),
        F.concat(
            _labelled("Means in anomaly: temperature", number_text(F.col("avg_temp_anomaly"))),
            _labelled(", vibration", number_text(F.col("avg_vib_anomaly"))),
            _labelled(", pressure", number_text(F.col("avg_press_anomaly"))),
            _labelled(", health %", number_text(F.col("avg_health_anomaly"))),
        ),
    )
    return F.when(F.col("anomaly_history_count") > 0, recorded).otherwise(
        _lines(title, F.lit("None recorded"))
    )


def _context_text(label: str) -> Column:
    return F.concat_ws(
        BLANK_LINE,
        _lines(
            F.lit(f"Newest reading, {label}"),
            _labelled("Machine", F.col("machine_id")),
            _labelled("Type", shown(F.col("machine_type"))),
            *[
                F.concat(
                    _labelled(sensor.capitalize(), number_text(F.col(sensor))),
                    F.lit(f" {UNITS[sensor]}"),
                )
                for sensor in SENSORS
            ],
            F.concat(
                _labelled("Health %", number_text(F.col("health_pct"))),
                F.lit(" "),
                shown(F.col("health_status")),
            ),
            _labelled("Anomalous", shown(F.col("is_anomaly"))),
            *[
                _labelled(f"{sensor.capitalize()} flag", shown(F.col(flag)))
                for sensor, flag in zip(SENSORS, SENSOR_FLAGS)
            ],
            _labelled("Operating hours", shown(F.col("operational_time"))),
        ),
        _history_text(label),
    )


def machine_context(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
) -> DataFrame:
    """Snapshot and anomaly history of each machine as a text."""
    return with_rules(machine_report(readings, verdicts, period, machine_id)).select(
        "machine_id",
        "machine_type",
        "task_mode",
        _context_text(period.label).alias("context"),
    )


def _with_guide(contexts: DataFrame, pages: DataFrame, machine_guides: DataFrame) -> DataFrame:
    """Adds the guide text for the type of each machine.

    A machine that is given several guides has the first by id, so that no
    prompt comes twice.
    """
    guides = machine_guides.groupBy("machine_id").agg(F.min("guide_id").alias("guide_id"))
    return (
        contexts.withColumn("guide_type", guide_type(F.col("machine_type")))
        .join(guides, "machine_id", "left")
        .join(
            guide_for_type(pages).select("guide_id", "guide_type", "guide_text"),
            ["guide_id", "guide_type"],
            "left",
        )
    )


def _guide_part() -> Column:
    return F.when(
        F.col("guide_text") != "", F.concat(F.lit("Maintenance guide\n"), F.col("guide_text"))
    )


def recommendation_context(
    readings: DataFrame,
    verdicts: DataFrame,
    pages: DataFrame,
    machine_guides: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
) -> DataFrame:
    """Per machine: its context, its guide text and the task of its mode."""
    task = F.lit(TASKS["C"])
    for mode in ("B", "A"):
        task = F.when(F.col("task_mode") == mode, F.lit(TASKS[mode])).otherwise(task)
    contexts = machine_context(readings, verdicts, period, machine_id)
    return _with_guide(contexts, pages, machine_guides).select(
        "machine_id",
        "task_mode",
        F.concat_ws(BLANK_LINE, "context", _guide_part(), task).alias("prompt"),
    )


def prompt_context(
    readings: DataFrame,
    verdicts: DataFrame,
    pages: DataFrame,
    messages: DataFrame,
    conversation_machines: DataFrame,
    machine_guides: DataFrame,
    period: Period = ALL_TIME,
) -> DataFrame:
    """Per conversation that waits for an answer: recent turns, fleet figures,
    context and guide of the machine it is about, and the question.

    A conversation about no machine has neither context nor guide; one about a
    machine without readings in the period says so. The per-machine lines of
    the fleet are those of `fleet_context`.

    Only the machines that conversations are about are computed; finding those
    with an open question first would go through all turns twice. A conversation
    that is given several machines is about the first by id.
    """
    about = conversation_machines.groupBy("conv_id").agg(F.min("machine_id").alias("machine_id"))
    questions = open_questions(messages, TURN_LIMIT).join(about, "conv_id", "left")
    wanted = about.select("machine_id").distinct()
    contexts = machine_context(
        readings.join(wanted, "machine_id", "left_semi"),
        verdicts.join(wanted, "machine_id", "left_semi"),
        period,
    ).drop("task_mode")
    asked = questions.join(contexts, "machine_id", "left")
    unknown = F.concat(F.lit("No data for machine "), F.col("machine_id"))
    history = F.when(
        F.col("history") != "", F.concat(F.lit("Conversation so far\n"), F.col("history"))
    )
    return _with_guide(asked, pages, machine_guides).select(
        "conv_id",
        "machine_id",
        F.concat_ws(
            BLANK_LINE,
            history,
            fleet_header(readings, verdicts, period).scalar(),
            F.coalesce("context", unknown),
            F.when(F.col("context").isNotNull(), _guide_part()),
            F.concat(F.lit("Question: "), F.col("question")),
        ).alias("prompt"),
    )
