from __future__ import annotations

import json

from pyspark.sql import functions as F

from machinepulse.functions.periods import Period
from machinepulse.operators import charts, turns
from machinepulse.plans import context, reports
from tests.rows import at, by, messages, only, pages, reading, readings, verdict, verdicts


def conversation(conv: int, count: int):
    roles = ("user", "assistant")
    return [(conv, turn, roles[turn % 2], f"t{turn}") for turn in range(count)]


def test_recent_turns(spark):
    m = messages(spark, *conversation(1, 1), *conversation(6, 6), *conversation(7, 7),
                 (8, 0, "system", "s"))
    found = by(turns.recent_turns(m), "conv_id")
    assert found[1].history == "User: t0"
    assert [found[c].turn_count for c in (1, 6, 7, 8)] == [1, 6, 6, 1]
    assert found[7].history.startswith("Assistant: t1\n\nUser: t2")
    assert found[7].history.endswith("User: t6")
    assert found[8].history == "Assistant: s"


def test_open_questions(spark):
    m = messages(spark, *conversation(1, 1), *conversation(2, 2), *conversation(9, 9))
    found = by(turns.open_questions(m), "conv_id")
    assert set(found) == {1, 9}
    assert (found[1].question, found[1].history) == ("t0", "")
    assert found[9].question == "t8"
    assert found[9].history.split("\n\n") == [
        "User: t2", "Assistant: t3", "User: t4", "Assistant: t5", "User: t6", "Assistant: t7",
    ]


def block(language: str, body: str, fence: str = "```") -> str:
    return f"{fence}{language}\n{body}\n{fence}\n"


BAR = '{"type":"bar","data":[{"n":"a","v":1.50},{"n":2,"v":"x"}],"xKey":"n","yKey":"v"}'


def chart_texts(spark, **texts: str):
    rows = [(name, text) for name, text in texts.items()]
    return spark.createDataFrame(rows, "message_id string, text string")


def test_only_well_formed_blocks_survive(spark):
    found = charts.chart_blocks(
        chart_texts(
            spark,
            two=f"intro\n{block('chart', BAR)}between\n{block('json', BAR)}end",
            other_language=block("sql", BAR),
            no_language=block("", BAR),
            broken=block("chart", "{broken"),
            trailing=block("chart", BAR + " {}"),
            trailing_word=block("chart", BAR + " x}"),
            list_inside=block("chart", BAR + "," + BAR),
            list_ended=block("chart", BAR + "] [" + BAR),
            list_ended_alike=block("chart", BAR + ",0] [" + BAR),
            members=block("chart", BAR + ',"x":{}'),
            object_ended=block("chart", BAR + "} {}"),
            spaces=block("chart", f"  {BAR}  \n"),
            single_quotes=block("chart", BAR.replace('"', "'")),
            no_key=block("chart", BAR.replace('"xKey":"n",', "")),
            blank_key=block("chart", BAR.replace('"xKey":"n"', '"xKey":""')),
            no_data=block("chart", '{"type":"bar","xKey":"n","yKey":"v"}'),
            null_data=block("chart", '{"type":"bar","data":null,"xKey":"n","yKey":"v"}'),
            empty_data=block("chart", '{"type":"bar","data":[],"xKey":"n","yKey":"v"}'),
            many_lines=block("chart", BAR.replace(",", ",\n")),
            long_fence=block("chart", BAR, "````"),
            unclosed=f"```chart\n{BAR}",
            inline=f"see ```chart {BAR}```",
            nothing="no block",
        )
    )
    assert {(row.message_id, row.block_no) for row in found.collect()} == {
        ("two", 1), ("two", 2), ("empty_data", 1), ("many_lines", 1), ("long_fence", 1),
        ("unclosed", 1), ("spaces", 1),
    }


def test_points(spark):
    pie = json.loads(BAR) | {"type": "pie", "colors": ["red"]}
    plain_pie = json.loads(BAR) | {"type": "pie"}
    line = json.loads(BAR) | {"type": "line", "color": "blue", "yKey": "absent"}
    texts = {
        "bar": BAR, "pie": json.dumps(pie), "plain_pie": json.dumps(plain_pie),
        "line": json.dumps(line),
    }
    m = chart_texts(spark, **{name: block("chart", body) for name, body in texts.items()})
    found = by(charts.chart_points(charts.chart_blocks(m)), "message_id", "point_no")
    first, second = found["bar", 1], found["bar", 2]
    assert (first.label, first.value_text, first.value) == ("a", "1.5", 1.5)
    assert (second.label, second.value_text, second.value) == ("2", "x", None)
    assert first.color == second.color == "#6366f1"
    assert [found["pie", i].color for i in (1, 2)] == ["red", "red"]
    assert [found["plain_pie", i].color for i in (1, 2)] == ["#6366f1", "#f59e0b"]
    assert (found["line", 1].color, found["line", 1].value) == ("blue", None)


def fleet(spark):
    r = readings(
        spark,
        reading("M1", health_pct=20.0, health_status="CRITICAL", temperature=80.25),
        reading("M2"),
        reading("M3", health_pct=None, health_status=None),
    )
    v = verdicts(spark, verdict("M1", at(0), is_temperature_anomaly=True))
    return r, v


def test_fleet_lines(spark):
    rows = context.fleet_context(*fleet(spark)).collect()
    assert [row.machine_id for row in rows] == ["", "M1", "M2", "M3"]
    assert rows[0].line.splitlines() == [
        "Fleet figures, All time", "Machines: 3", "Mean health %: 55",
        "Healthy: 1, warning: 0, critical: 1", "Anomalous verdicts: 1",
    ]
    assert rows[1].line == (
        "M1 motor; health %: 20 CRITICAL; temperature: 80.25; vibration: 1; pressure: 5; "
        "anomalous: true; events: 1"
    )
    assert "health %: n/a n/a" in rows[3].line


def test_fleet_lines_of_an_empty_period(spark):
    row = only(context.fleet_context(*fleet(spark), Period(year=1999)))
    assert "Machines: 0" in row.line and "Mean health %: 0\n" in row.line


def test_machine_texts(spark):
    found = by(context.machine_context(*fleet(spark), Period(6, 2024)), "machine_id")
    first = found["M1"].context
    assert first.startswith("Newest reading, Jun 2024\nMachine: M1\nType: motor\n")
    assert "Temperature flag: true" in first and "Events: 1" in first
    assert "Last: 2024-06-15 12:00:00" in first and "health %: 20" in first
    assert found["M1"].task_mode == "A"
    assert "Anomalous: n/a" in found["M2"].context
    assert found["M2"].context.endswith("None recorded")


def guides(spark):
    machine_guides = spark.createDataFrame(
        [("M1", 1), ("M2", 9)], "machine_id string, guide_id long"
    )
    return pages(spark, {12: "motors", 7: "flow"}), machine_guides


def test_recommendation_texts(spark):
    p, machine_guides = guides(spark)
    found = by(
        context.recommendation_context(*fleet(spark), p, machine_guides), "machine_id"
    )
    assert (
        "\n\nMaintenance guide\n--- Page 12 ---\nmotors\n\n--- Page 7 ---\nflow"
        "\n\nTask: explain the active anomaly"
    ) in found["M1"].prompt
    assert "Maintenance guide" not in found["M2"].prompt
    assert found["M2"].task_mode == "C" and "confirm normal operation" in found["M2"].prompt


def test_prompts(spark):
    p, machine_guides = guides(spark)
    m = messages(
        spark, *conversation(1, 3), *conversation(2, 1), *conversation(3, 1), *conversation(4, 2)
    )
    about = spark.createDataFrame([(1, "M1"), (2, "M99")], "conv_id long, machine_id string")
    found = by(
        context.prompt_context(*fleet(spark), p, m, about, machine_guides), "conv_id"
    )
    assert set(found) == {1, 2, 3}
    parts = [part.splitlines()[0] for part in found[1].prompt.split("\n\n")]
    assert parts == [
        "Conversation so far", "Assistant: t1", "Fleet figures, All time",
        "Newest reading, All time", "Anomaly history, All time", "Maintenance guide",
        "--- Page 7 ---", "Question: t2",
    ]
    assert "No data for machine M99" in found[2].prompt
    assert "Newest reading" not in found[3].prompt and "No data" not in found[3].prompt


def test_records(spark):
    report = reports.machine_report(*fleet(spark))
    found = by(reports.recommendation_snapshot(report), "machine_id")
    assert json.loads(found["M1"].record) == {
        "machine_id": "M1", "machine_type": "motor", "is_anomaly": True, "health_pct": 20,
        "sensor_snapshot": {
            "temperature": 80.25, "vibration": 1, "pressure": 5, "health_pct": 20,
        },
    }
    assert json.loads(found["M3"].record)["is_anomaly"] is None


def test_report_rules(spark):
    found = by(reports.with_rules(reports.machine_report(*fleet(spark))), "machine_id")
    assert (found["M1"].report_format, found["M1"].priority) == ("A", "Urgent")
    assert found["M1"].sensors_out_of_range == 1
    assert (found["M2"].report_format, found["M2"].priority) == ("C", "Low")


def test_mode_uses_rounded_health(spark):
    r = readings(spark, reading("M1", health_pct=79.96), reading("M2", health_pct=79.94))
    v = verdicts(spark, verdict("M9"))
    found = by(reports.with_rules(reports.machine_report(r, v)), "machine_id")
    assert (found["M1"].task_mode, found["M2"].task_mode) == ("C", "B")


def test_fences_of_every_form(spark):
    quoted = "".join(f"> {line}\n" for line in block("chart", BAR, "~~~").splitlines())
    doubled = BAR.replace('"type":"bar"', '"type":"bar","type":"line"')
    listed = "- item\n\n" + "".join(
        f"      {line}\n" for line in block("chart", BAR).splitlines()
    )
    m = chart_texts(
        spark,
        tildes=block("chart", BAR, "~~~"),
        quoted=quoted,
        listed=listed,
        bullet=f"1. ```chart\n   {BAR}\n   ```\n",
        code="".join(f"      {line}\n" for line in block("chart", BAR).splitlines()),
        repeated=block("chart", doubled),
        mixed=block("chart", "{broken") + block("sql", "x") + block("json", BAR),
    )
    found = {row.message_id: row for row in charts.chart_blocks(m).collect()}
    assert set(found) == {"tildes", "quoted", "listed", "bullet", "repeated", "mixed"}
    assert found["repeated"].chart_type == "line" and found["mixed"].block_no == 3
    unread = charts.unread_blocks(m).collect()
    assert [(row.message_id, row.unread_blocks) for row in unread] == [("mixed", 1)]


def test_slices_have_shares(spark):
    pie = '{"type":"pie","data":[{"n":"a","v":1},{"n":"b","v":2},{"n":"c"}],"xKey":"n","yKey":"v"}'
    points = charts.chart_points(charts.chart_blocks(chart_texts(spark, pie=block("chart", pie))))
    assert [row.share_pct for row in points.orderBy("point_no").collect()] == [33, 67, None]


def test_a_machine_with_two_guides_has_one_prompt(spark):
    p, machine_guides = guides(spark)
    doubled = machine_guides.unionByName(machine_guides.withColumn("guide_id", F.lit(5).cast("long")))
    prompts = context.recommendation_context(*fleet(spark), p, doubled)
    assert prompts.count() == prompts.select("machine_id").distinct().count()
