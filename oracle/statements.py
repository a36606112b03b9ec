"""SQL twins of the registered queries.

Each statement stands alone: it starts from the raw tables, and a `WITH` list
brings in just the named steps it uses. The dialect is DuckDB's.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- the given tables as readings, verdicts, guide pages and messages ---------

_STEPS: dict[str, str] = {
    "event_base": """
        SELECT event_id, user_id, event_type, value,
               CAST(json_extract(props, '$.k') AS INT) AS k,
               1704067200 + ((epoch_us(ts) - 1704067200000000) * 24) // 1000000 AS ts_s
        FROM events""",
    "readings": """
        SELECT concat('M', lpad(CAST(user_id AS VARCHAR), CAST(greatest(5, length(CAST(user_id AS VARCHAR))) AS INT), '0')) AS machine_id,
               CASE user_id % 4 WHEN 0 THEN 'furnace' WHEN 1 THEN 'conveyor'
                                WHEN 2 THEN 'motor' ELSE 'slurry_pump' END AS machine_type,
               make_timestamp(ts_s * 1000000) AS ts,
               CASE WHEN user_id % 4 = 0 THEN 1100.0e0 + k * 2.0e0
                    ELSE 30.0e0 + k * 0.6e0 END AS temperature,
               value * 0.02e0 AS vibration,
               CASE WHEN event_id % 11 <> 5 THEN 4.0e0 + (k % 25) * 0.1e0 END AS pressure,
               greatest(0.0e0, 100.0e0 - value * 0.8e0) AS health_pct,
               CASE WHEN 100.0e0 - value * 0.8e0 >= 80 THEN 'HEALTHY'
                    WHEN 100.0e0 - value * 0.8e0 >= 55 THEN 'WARNING'
                    WHEN 100.0e0 - value * 0.8e0 >= 30 THEN 'BORDERLINE'
                    ELSE 'CRITICAL' END AS health_status,
               event_id AS operational_time,
               event_type <> 'error' AS is_running,
               abs(value - 50.0e0) / 50.0e0 * 100.0e0 AS avg_deviation_pct
        FROM event_base""",
    "verdicts": """
        SELECT concat('M', lpad(CAST(user_id AS VARCHAR), CAST(greatest(5, length(CAST(user_id AS VARCHAR))) AS INT), '0')) AS machine_id,
               ts_s * 1000000000 + CASE WHEN event_id % 7 = 3 THEN 300 ELSE 0 END AS ns,
               make_timestamp(ts_s * 1000000) AS ts,
               value / (value + 100.0e0) AS anomaly_score,
               value > 100.0e0 AND user_id % 3 <> 2 AS is_anomaly,
               value > 100.0e0 AND user_id % 3 <> 2 AND k % 3 = 0 AS is_temperature_anomaly,
               value > 150.0e0 AND user_id % 3 <> 2 AS is_vibration_anomaly,
               value > 100.0e0 AND user_id % 3 <> 2 AND k % 5 = 0 AS is_pressure_anomaly
        FROM event_base
        WHERE event_id % 10 <> 9""",
    "pages_of_guides": """
        SELECT doc_id // 22 AS guide_id, CAST(doc_id % 22 + 1 AS INT) AS page, text AS content
        FROM documents""",
    "chart_messages": """
        SELECT event_id AS message_id,
               CASE event_id % 4 WHEN 1 THEN 'json' WHEN 2 THEN 'sql' ELSE 'chart' END AS lang,
               CASE WHEN event_id % 4 = 3 THEN '{broken'
                    WHEN event_id % 8 = 1 THEN '{"type":"bar","data":[{"name":"a","v":1}]}'
                    WHEN event_id % 8 = 4 THEN concat('{"type":"pie","data":[{"name":"a","v":',
                        CAST(user_id AS VARCHAR),
                        '},{"name":"b","v":3}],"colors":["#111111"],"xKey":"name","yKey":"v"}')
                    ELSE concat('{"type":"bar","data":[{"name":"', event_type, '","v":',
                                CAST(user_id AS VARCHAR), '}],"xKey":"name","yKey":"v"}')
               END AS body,
               concat('Report', chr(10), '```', lang, chr(10), body, chr(10), '```', chr(10),
                      'end') AS text
        FROM events""",
    "page_wanted": """
        SELECT * FROM (VALUES
            ('furnace', 1, 6), ('furnace', 2, 7),
            ('conveyor', 1, 8),
            ('slurry_pump', 1, 10), ('slurry_pump', 2, 11),
            ('motor', 1, 12), ('motor', 2, 13)) AS own(guide_type, place, page)
        UNION ALL
        SELECT t.guide_type,
               t.own_count + row_number() OVER (PARTITION BY t.guide_type ORDER BY a.page),
               a.page
        FROM (VALUES ('furnace', 2), ('conveyor', 1), ('slurry_pump', 2), ('motor', 2),
                     ('other', 0)) AS t(guide_type, own_count)
        CROSS JOIN (VALUES (7), (17), (18), (19), (20), (21)) AS a(page)
        WHERE NOT (t.guide_type = 'furnace' AND a.page = 7)""",
    "guide_texts": """
        SELECT p.guide_id, w.guide_type,
               string_agg(concat('--- Page ', p.page, ' ---', chr(10), p.content),
                          chr(10) || chr(10)
                          ORDER BY w.page NOT IN (6, 8, 10, 11, 12, 13)
                                   AND NOT (w.guide_type = 'furnace' AND w.page = 7),
                                   p.page) AS guide_text
        FROM pages_of_guides p JOIN page_wanted w ON w.page = p.page
        GROUP BY p.guide_id, w.guide_type""",
    "ranges": """
        SELECT * FROM (VALUES
            ('conveyor', 'temperature', 0.0e0, 60.0e0),
            ('conveyor', 'vibration', 0.0e0, 4.5e0),
            ('furnace', 'temperature', 1150.0e0, 1250.0e0),
            ('motor', 'temperature', 0.0e0, 70.0e0),
            ('motor', 'vibration', 0.0e0, 4.5e0),
            ('slurry_pump', 'temperature', 0.0e0, 70.0e0),
            ('slurry_pump', 'vibration', 0.0e0, 4.5e0),
            ('slurry_pump', 'pressure', 4.5e0, 5.5e0)
        ) AS r(machine_type, sensor, range_min, range_max)""",
    "sensor_values": """
        SELECT machine_id, machine_type, 'temperature' AS sensor, '°C' AS unit,
               temperature AS value, is_temperature_anomaly AS is_flagged FROM assets
        UNION ALL
        SELECT machine_id, machine_type, 'vibration', 'mm/s', vibration, is_vibration_anomaly
        FROM assets
        UNION ALL
        SELECT machine_id, machine_type, 'pressure', 'bar', pressure, is_pressure_anomaly
        FROM assets""",
    "sensor_checks": """
        SELECT v.machine_id, v.machine_type, v.sensor, v.value, r.range_min, r.range_max,
               v.unit, v.is_flagged,
               CASE WHEN r.sensor IS NULL THEN 'no spec'
                    WHEN v.value > r.range_max THEN 'above'
                    WHEN v.value < r.range_min THEN 'below'
                    WHEN v.value IS NOT NULL THEN 'within' END AS range_state
        FROM sensor_values v LEFT JOIN ranges r USING (machine_type, sensor)""",
    "numbered_turns": """
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back,
               concat(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END, ': ', text)
                   AS line
        FROM conversations""",
}


@dataclass(frozen=True)
class Span:
    """A period as conditions on a timestamp column."""

    month: int | None = None
    year: int | None = None

    def on(self, ts: str = "ts") -> str:
        parts = ["TRUE"]
        if self.month:
            parts.append(f"month({ts}) = {self.month}")
        if self.year:
            parts.append(f"year({ts}) = {self.year}")
        return " AND ".join(parts)

    @property
    def label(self) -> str:
        if self.month == 6 and self.year:
            return f"Jun {self.year}"
        return f"Year {self.year}" if self.year else "All time"


SPANS = {
    "": Span(),
    "_2024": Span(year=2024),
    "_m06": Span(month=6),
    "_2024_06": Span(month=6, year=2024),
}

# --- expressions ---------------------------------------------------------------


def rnd(expression: str, digits: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(28,9)), {digits}) AS DOUBLE)"


def num(expression: str, missing: str = "n/a") -> str:
    """Plain number text."""
    text = f"CAST(CAST({expression} AS DECIMAL(28,4)) AS VARCHAR)"
    return f"coalesce(regexp_replace({text}, '\\.?0+$', ''), '{missing}')"


def lines(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


_SHOWN = {"temperature": 2, "vibration": 4, "pressure": 4, "health_pct": 1}
_SHORT = {"temperature": "temp", "vibration": "vib", "pressure": "press", "health_pct": "health"}
_FLAGS = ("is_anomaly", "is_temperature_anomaly", "is_vibration_anomaly", "is_pressure_anomaly")


def shown(alias: str = "") -> str:
    dot = f"{alias}." if alias else ""
    return ", ".join(f"{rnd(dot + name, digits)} AS {name}" for name, digits in _SHOWN.items())


def flags(alias: str = "") -> str:
    dot = f"{alias}." if alias else ""
    return ", ".join(f"{dot}{flag}" for flag in _FLAGS)


def means(condition: str, suffix: str) -> str:
    return ", ".join(
        f"{rnd(f'avg({name}) FILTER ({condition})', digits)} AS avg_{_SHORT[name]}_{suffix}"
        for name, digits in _SHOWN.items()
    )


_COUNTS = """
    count(*) FILTER (is_anomaly) AS anomaly_history_count,
    count(*) FILTER (is_temperature_anomaly) AS temp_anomaly_count,
    count(*) FILTER (is_vibration_anomaly) AS vib_anomaly_count,
    count(*) FILTER (is_pressure_anomaly) AS press_anomaly_count"""

_ZERO_COUNTS = ", ".join(
    f"coalesce({name}, 0) AS {name}"
    for name in (
        "anomaly_history_count", "temp_anomaly_count", "vib_anomaly_count",
        "press_anomaly_count",
    )
)

# --- steps that depend on the period ---------------------------------------------


def _span_steps(span: Span) -> dict[str, str]:
    own, judged = span.on(), span.on("v.ts")
    return {
        "now": f"""
            SELECT * FROM readings WHERE {own}
            QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC) = 1""",
        "past": f"""
            SELECT machine_id, health_pct AS past_health FROM readings
            WHERE {own}
              AND ts <= (SELECT max(ts) FROM readings WHERE {own}) - INTERVAL 7 DAY
            QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC) = 1""",
        "verdict_now": f"""
            SELECT * FROM verdicts WHERE {own}
            QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ns DESC) = 1""",
        "verdict_counts": f"""
            SELECT machine_id, {_COUNTS},
                   min(ts) FILTER (is_anomaly) AS first_anomaly_ts,
                   max(ts) FILTER (is_anomaly) AS last_anomaly_ts
            FROM verdicts WHERE {own} GROUP BY machine_id""",
        "assets": f"""
            SELECT n.machine_id, n.machine_type, {shown('n')}, n.health_status,
                   n.operational_time, n.is_running,
                   {rnd('n.avg_deviation_pct', 2)} AS avg_deviation_pct,
                   n.ts AS timestamp,
                   {rnd('p.past_health', 1)} AS health_past_ago,
                   {rnd('n.health_pct - p.past_health', 1)} AS trend_pct,
                   {rnd('v.anomaly_score', 4)} AS anomaly_score, {flags('v')},
                   {_ZERO_COUNTS},
                   c.first_anomaly_ts, c.last_anomaly_ts
            FROM now n
            LEFT JOIN past p USING (machine_id)
            LEFT JOIN verdict_now v USING (machine_id)
            LEFT JOIN verdict_counts c USING (machine_id)""",
        "matches": f"""
            SELECT v.machine_id, v.ns, v.ts, v.anomaly_score, {flags('v')},
                   r.machine_type, r.temperature, r.vibration, r.pressure, r.health_pct,
                   r.health_status
            FROM verdicts v JOIN readings r ON r.machine_id = v.machine_id AND r.ts = v.ts
            WHERE {judged}""",
        "trend": f"""
            SELECT r.machine_id, r.ts AS timestamp, {shown('r')}, {flags('v')}
            FROM readings r LEFT JOIN verdicts v
              ON v.machine_id = r.machine_id
             AND v.ns = epoch_us(r.ts) // 1000000 * 1000000000
            WHERE {span.on('r.ts')}""",
        "histories": f"""
            SELECT m.machine_id, {_COUNTS},
                   min(ts) FILTER (is_anomaly) AS first_anomaly_ts,
                   max(ts) FILTER (is_anomaly) AS last_anomaly_ts,
                   {means('is_anomaly', 'anomaly')}
            FROM (SELECT DISTINCT machine_id FROM readings) m
            LEFT JOIN matches USING (machine_id) GROUP BY m.machine_id""",
        "stats": f"""
            SELECT m.machine_id, count(x.ns) AS total_readings,
                   {_COUNTS.replace('anomaly_history_count', 'anomaly_count')},
                   {rnd('100.0e0 * count(*) FILTER (is_anomaly) / nullif(count(x.ns), 0)', 2)}
                       AS anomaly_pct,
                   {rnd('max(anomaly_score)', 4)} AS max_score,
                   {rnd('min(anomaly_score)', 4)} AS min_score,
                   {rnd('avg(anomaly_score)', 4)} AS avg_score,
                   min(ts) FILTER (is_anomaly) AS first_anomaly_ts,
                   max(ts) FILTER (is_anomaly) AS last_anomaly_ts,
                   {means('is_anomaly', 'anomaly')}, {means('NOT is_anomaly', 'normal')}
            FROM (SELECT DISTINCT machine_id FROM readings) m
            LEFT JOIN matches x USING (machine_id) GROUP BY m.machine_id""",
        "summary": f"""
            SELECT v.machine_id, t.machine_type,
                   {_COUNTS.replace('anomaly_history_count', 'anomaly_count')},
                   {rnd('max(anomaly_score)', 4)} AS max_score,
                   {rnd('avg(anomaly_score)', 4)} AS avg_score,
                   max(ns) AS latest_anomaly_ts
            FROM verdicts v
            JOIN (SELECT DISTINCT machine_id, machine_type FROM readings) t USING (machine_id)
            WHERE is_anomaly AND {span.on('v.ts')} GROUP BY v.machine_id, t.machine_type""",
        "figures": f"""
            SELECT {rnd('avg(health_pct)', 1)} AS avg_health,
                   count(*) FILTER (health_status = 'HEALTHY') AS healthy_count,
                   count(*) FILTER (health_status = 'WARNING') AS warning_count,
                   count(*) FILTER (health_status = 'CRITICAL') AS critical_count,
                   count(*) AS total_machines
            FROM now""",
        "totals": f"""
            SELECT f.*,
                   (SELECT count(*) FROM verdicts WHERE is_anomaly AND {own}) AS anomaly_count,
                   (SELECT count(*) FROM readings WHERE {own}) AS total_readings
            FROM figures f""",
        "reports": f"""
            SELECT n.machine_id, n.machine_type, {shown('n')}, n.health_status,
                   n.operational_time, {rnd('v.anomaly_score', 4)} AS anomaly_score,
                   {flags('v')}, h.anomaly_history_count, h.temp_anomaly_count,
                   h.vib_anomaly_count, h.press_anomaly_count, h.first_anomaly_ts,
                   h.last_anomaly_ts, h.avg_temp_anomaly, h.avg_vib_anomaly,
                   h.avg_press_anomaly, h.avg_health_anomaly
            FROM now n LEFT JOIN verdict_now v USING (machine_id)
            LEFT JOIN histories h USING (machine_id)""",
        "modes": """
            SELECT *, CASE WHEN is_anomaly THEN 'A'
                           WHEN health_pct IS NULL OR health_pct < 80
                                OR anomaly_history_count > 0 THEN 'B'
                           ELSE 'C' END AS task_mode
            FROM reports""",
        "contexts": f"""
            SELECT machine_id, machine_type, task_mode, {_context_sql(span.label)} AS context
            FROM modes""",
        "fleet_text": f"""
            SELECT {lines(
                f"'Fleet figures, {span.label}'",
                "'Machines: ' || total_machines",
                f"'Mean health %: ' || {num('coalesce(avg_health, 0)')}",
                "concat('Healthy: ', healthy_count, ', warning: ', warning_count, "
                "', critical: ', critical_count)",
                "'Anomalous verdicts: ' || anomaly_count",
            )} AS line FROM totals""",
        "guided": """
            SELECT c.*, g.guide_text
            FROM contexts c
            LEFT JOIN (SELECT DISTINCT concat('M', lpad(CAST(user_id AS VARCHAR), CAST(greatest(5, length(CAST(user_id AS VARCHAR))) AS INT), '0'))
                              AS machine_id, user_id // 3 AS guide_id FROM events) a
                   USING (machine_id)
            LEFT JOIN guide_texts g
                   ON g.guide_id = a.guide_id AND g.guide_type = c.machine_type""",
    }


def _context_sql(label: str) -> str:
    reading = lines(
        f"'Newest reading, {label}'",
        "'Machine: ' || machine_id",
        "'Type: ' || machine_type",
        f"concat('Temperature: ', {num('temperature')}, ' °C')",
        f"concat('Vibration: ', {num('vibration')}, ' mm/s')",
        f"concat('Pressure: ', {num('pressure')}, ' bar')",
        f"concat('Health %: ', {num('health_pct')}, ' ', health_status)",
        "'Anomalous: ' || coalesce(CAST(is_anomaly AS VARCHAR), 'n/a')",
        "'Temperature flag: ' || coalesce(CAST(is_temperature_anomaly AS VARCHAR), 'n/a')",
        "'Vibration flag: ' || coalesce(CAST(is_vibration_anomaly AS VARCHAR), 'n/a')",
        "'Pressure flag: ' || coalesce(CAST(is_pressure_anomaly AS VARCHAR), 'n/a')",
        "'Operating hours: ' || operational_time",
    )
    recorded = lines(
        f"'Anomaly history, {label}'",
        "'Events: ' || anomaly_history_count",
        "concat('By sensor: temperature: ', temp_anomaly_count, ', vibration: ', "
        "vib_anomaly_count, ', pressure: ', press_anomaly_count)",
        "'First: ' || strftime(first_anomaly_ts, '%Y-%m-%d %H:%M:%S')",
        "'Last: ' || strftime(last_anomaly_ts, '%Y-%m-%d %H:%M:%S')",
        f"concat('Means in anomaly: temperature: ', {num('avg_temp_anomaly')}, "
        f"', vibration: ', {num('avg_vib_anomaly')}, ', pressure: ', "
        f"{num('avg_press_anomaly')}, ', health %: ', {num('avg_health_anomaly')})",
    )
    none = lines(f"'Anomaly history, {label}'", "'None recorded'")
    return (
        f"concat_ws(chr(10) || chr(10), {reading}, "
        f"CASE WHEN anomaly_history_count > 0 THEN {recorded} ELSE {none} END)"
    )


_ORDER = (
    "event_base", "readings", "verdicts", "pages_of_guides", "chart_messages", "page_wanted",
    "guide_texts", "now", "past", "verdict_now", "verdict_counts", "assets", "matches", "trend",
    "histories", "stats", "summary", "figures", "totals", "reports", "modes", "contexts",
    "fleet_text", "guided", "ranges", "sensor_values", "sensor_checks", "numbered_turns",
)


def _mentions(sql: str, name: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(
        word == name and before.upper() in ("FROM", "JOIN")
        for before, word in zip(words, words[1:])
    )


def statement(select: str, span: Span = Span()) -> str:
    """The select with a WITH list of just the steps it reaches."""
    steps = {**_STEPS, **_span_steps(span)}
    needed: set[str] = set()
    queue = [select]
    while queue:
        sql = queue.pop()
        for name in _ORDER:
            if name not in needed and _mentions(sql, name):
                needed.add(name)
                queue.append(steps[name])
    if not needed:
        return select
    ctes = ",\n".join(f"{name} AS ({steps[name]})" for name in _ORDER if name in needed)
    return f"WITH {ctes}\n{select}"


# --- the statements ----------------------------------------------------------------


def _by_period(span: Span) -> dict[str, str]:
    own = span.on()
    history_columns = (
        f"machine_id, ts AS timestamp, {shown()}, is_temperature_anomaly, "
        "is_vibration_anomaly, is_pressure_anomaly"
    )
    return {
        "kpi_latest": "SELECT * FROM figures",
        "trend_asof": f"""
            SELECT r.machine_id, r.ts AS timestamp, r.operational_time,
                   {rnd('r.health_pct', 1)} AS health_pct,
                   CASE WHEN near THEN v.ts END AS verdict_ts,
                   CASE WHEN near THEN epoch_us(r.ts) // 1000000 - epoch_us(v.ts) // 1000000 END
                       AS verdict_age_s,
                   CASE WHEN near THEN {rnd('v.anomaly_score', 4)} END AS anomaly_score,
                   {', '.join(f'CASE WHEN near THEN v.{flag} END AS {flag}' for flag in _FLAGS)}
            FROM (SELECT r.*, v, epoch_us(r.ts) - epoch_us(v.ts) <= 7 * 86400000000 AS near
                  FROM (SELECT * FROM readings WHERE {span.on()}) r
                  ASOF LEFT JOIN (
                      SELECT * FROM verdicts WHERE {span.on()}
                      QUALIFY row_number() OVER (
                          PARTITION BY machine_id, ts ORDER BY ns DESC, anomaly_score DESC,
                          {', '.join(f'{flag} DESC' for flag in _FLAGS)}) = 1) v
                  ON v.machine_id = r.machine_id AND v.ts <= r.ts) r""",
        "kpi_anomaly_count": f"""
            SELECT count(*) AS anomaly_count FROM verdicts WHERE is_anomaly AND {own}""",
        "kpi_reading_count": f"""
            SELECT count(*) AS total_readings FROM readings WHERE {own}""",
        "kpi_summary": """
            SELECT coalesce(avg_health, 0) AS avg_health, healthy_count, warning_count,
                   critical_count, total_machines, anomaly_count, total_readings
            FROM totals""",
        "asset_overview": "SELECT * FROM assets",
        "asset_detail": f"""
            SELECT n.machine_id, n.machine_type, n.ts AS timestamp, {shown('n')},
                   n.health_status, n.operational_time, n.is_running,
                   {rnd('n.avg_deviation_pct', 2)} AS avg_deviation_pct,
                   {rnd('abs(n.temperature - b.avg_t) / nullif(b.std_t, 0) * 100', 2)}
                       AS temp_deviation_pct,
                   {rnd('abs(n.vibration - b.avg_v) / nullif(b.std_v, 0) * 100', 2)}
                       AS vib_deviation_pct,
                   {rnd('abs(n.pressure - b.avg_p) / nullif(b.std_p, 0) * 100', 2)}
                       AS press_deviation_pct,
                   {rnd('v.anomaly_score', 4)} AS anomaly_score, {flags('v')},
                   CAST(CASE WHEN n.health_pct < 30 THEN 3 WHEN n.health_pct < 55 THEN 7
                             WHEN n.health_pct < 80 THEN 30 ELSE 90 END AS INT) AS rul_days
            FROM now n
            LEFT JOIN (SELECT machine_type, avg(temperature) AS avg_t, avg(vibration) AS avg_v,
                              avg(pressure) AS avg_p, stddev_samp(temperature) AS std_t,
                              stddev_samp(vibration) AS std_v, stddev_samp(pressure) AS std_p
                       FROM readings GROUP BY machine_type) b USING (machine_type)
            LEFT JOIN verdict_now v USING (machine_id)""",
        "asset_trend": "SELECT * FROM trend",
        "anomaly_history": f"""
            SELECT {history_columns} FROM matches WHERE is_anomaly
            QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ns DESC) <= 500""",
        "anomaly_events": f"""
            SELECT machine_id, ns AS timestamp, {rnd('anomaly_score', 4)} AS anomaly_score,
                   {flags()}
            FROM verdicts WHERE is_anomaly AND {own}
            QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ns DESC) <= 50""",
        "anomaly_summary": "SELECT * FROM summary",
        "anomaly_stats": "SELECT * FROM stats",
        "anomaly_recent": f"""
            SELECT machine_id, ts AS timestamp, {rnd('anomaly_score', 4)} AS anomaly_score,
                   {flags()}, {shown()}, health_status
            FROM matches WHERE is_anomaly
            QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ns DESC) <= 20""",
        "anomaly_latest_reading": f"""
            SELECT machine_id, machine_type, {shown()}, health_status,
                   {rnd('anomaly_score', 4)} AS anomaly_score, {flags()}, ts AS timestamp
            FROM matches
            QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC) = 1""",
        "machine_overview": f"""
            SELECT n.machine_id, n.machine_type, {shown('n')}, n.health_status,
                   {', '.join(f'coalesce(v.{flag}, FALSE) AS {flag}' for flag in _FLAGS)},
                   coalesce(c.anomaly_history_count, 0) AS anomaly_history_count
            FROM now n LEFT JOIN verdict_now v USING (machine_id)
            LEFT JOIN verdict_counts c USING (machine_id)""",
        "machine_snapshot": f"""
            SELECT n.machine_id, n.machine_type, {shown('n')}, n.health_status,
                   n.operational_time, {rnd('v.anomaly_score', 4)} AS anomaly_score,
                   {flags('v')}
            FROM now n LEFT JOIN verdict_now v USING (machine_id)""",
        "machine_anomaly_history": "SELECT * FROM histories",
        "task_mode": """
            SELECT machine_id, is_anomaly, health_pct, anomaly_history_count, task_mode
            FROM modes""",
        "report_format": """
            SELECT m.machine_id, m.task_mode,
                   CAST(coalesce(o.outside, 0) AS INT) AS sensors_out_of_range,
                   CASE WHEN m.task_mode = 'C' AND o.outside > 0 THEN 'B'
                        ELSE m.task_mode END AS report_format
            FROM modes m
            LEFT JOIN (SELECT machine_id,
                              count(*) FILTER (range_state IN ('above', 'below')) AS outside
                       FROM sensor_checks GROUP BY machine_id) o USING (machine_id)""",
        "fleet_context": f"""
            SELECT CAST(0 AS INT) AS section, CAST(NULL AS DOUBLE) AS health_order,
                   '' AS machine_id, line FROM fleet_text
            UNION ALL
            SELECT CAST(1 AS INT), n.health_pct, n.machine_id,
                   concat_ws('; ',
                       concat(n.machine_id, ' ', n.machine_type),
                       concat('health %: ', {num(rnd('n.health_pct', 1))}, ' ', n.health_status),
                       concat('temperature: ', {num(rnd('n.temperature', 2))}),
                       concat('vibration: ', {num(rnd('n.vibration', 4))}),
                       concat('pressure: ', {num(rnd('n.pressure', 4))}),
                       concat('anomalous: ', coalesce(v.is_anomaly, FALSE)),
                       concat('events: ', coalesce(c.anomaly_history_count, 0)))
            FROM now n LEFT JOIN verdict_now v USING (machine_id)
            LEFT JOIN verdict_counts c USING (machine_id)""",
        "machine_context": "SELECT * FROM contexts",
    }


def _all_time() -> dict[str, str]:
    history = (
        f"SELECT machine_id, ts AS timestamp, {shown()}, is_temperature_anomaly, "
        "is_vibration_anomaly, is_pressure_anomaly FROM matches WHERE is_anomaly"
    )
    newest = "QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ns DESC)"
    keywords = ", ".join(
        f"CASE WHEN {' OR '.join(f'contains(lower(p.content), {word!r})' for word in words)} "
        f"THEN '{label}' END"
        for label, words in (
            ("refractory", ["refractory"]), ("bearing", ["bearing"]),
            ("cavitation", ["cavitation"]), ("impeller", ["impeller"]),
            ("vibration", ["vibration"]), ("temperature", ["temperature"]),
            ("pressure", ["pressure"]), ("safety/urgent", ["safety", "urgent"]),
            ("output-format", ["output format"]), ("priority", ["priority"]),
            ("workflow", ["workflow"]),
        )
    )
    wanted = """
            FROM (SELECT DISTINCT guide_id FROM pages_of_guides) g
            CROSS JOIN (SELECT * FROM page_wanted WHERE guide_type <> 'other') w
            LEFT JOIN pages_of_guides p ON p.guide_id = g.guide_id AND p.page = w.page"""
    kpi_over_assets = """
            SELECT CAST(coalesce(floor(avg(coalesce(health_pct, 0)) + 0.5e0), 0) AS BIGINT) AS avg_health,
                   count(*) FILTER (health_status = 'HEALTHY') AS healthy_count,
                   count(*) FILTER (health_status = 'WARNING') AS warning_count,
                   count(*) FILTER (health_status = 'CRITICAL') AS critical_count,
                   count(*) AS total_machines,
                   count(*) FILTER (is_anomaly) AS anomaly_count,
                   count(*) AS total_readings
            FROM assets"""
    active = (
        "CAST(coalesce(is_temperature_anomaly, FALSE) AS INT) + "
        "CAST(coalesce(is_vibration_anomaly, FALSE) AS INT) + "
        "CAST(coalesce(is_pressure_anomaly, FALSE) AS INT)"
    )
    measured = (
        f"concat(upper(c.sensor[1]), c.sensor[2:], ' of the ', c.machine_type, ' is ', "
        f"{num('c.value')}, ' ', c.unit, "
    )
    return {
        "readings_per_machine": """
            SELECT machine_id, machine_type, count(*) AS row_count
            FROM readings GROUP BY machine_id, machine_type""",
        "anomaly_history_top5": f"{history} {newest} <= 5",
        "anomaly_events_top5": f"""
            SELECT machine_id, ns AS timestamp, {rnd('anomaly_score', 4)} AS anomaly_score,
                   {flags()} FROM verdicts WHERE is_anomaly {newest} <= 5""",
        "anomaly_recent_top5": f"""
            SELECT machine_id, ts AS timestamp, {rnd('anomaly_score', 4)} AS anomaly_score,
                   {flags()}, {shown()}, health_status
            FROM matches WHERE is_anomaly {newest} <= 5""",
        "assets_filtered": """
            SELECT * FROM assets WHERE machine_type = 'furnace' AND health_status = 'WARNING'""",
        "assets_anomalous": "SELECT * FROM assets WHERE is_anomaly",
        "kpi_filtered": f"{kpi_over_assets} WHERE machine_type = 'furnace'",
        "kpi_filtered_all": kpi_over_assets,
        "focus_machine": """
            SELECT a.* FROM assets a JOIN now n USING (machine_id)
            ORDER BY coalesce(a.is_anomaly, FALSE) DESC, n.health_pct NULLS LAST, a.machine_id
            LIMIT 1""",
        "active_sensor_flags": f"SELECT machine_id, {active} AS active_flags FROM assets",
        "asset_state": f"""
            SELECT machine_id, {active} AS active_flags, anomaly_history_count,
                   CASE WHEN {active} > 0 THEN 'flagged'
                        WHEN anomaly_history_count > 0 THEN 'past' ELSE 'normal' END AS state,
                   CASE WHEN {active} > 0 THEN 'flagged'
                        WHEN anomaly_history_count > 0
                        THEN anomaly_history_count || ' past' ELSE 'normal' END AS state_label
            FROM assets""",
        "sensor_range_check": f"""
            SELECT c.*, {rnd('''CASE range_state
                       WHEN 'above' THEN (value - range_max) / nullif(range_max, 0) * 100
                       WHEN 'below' THEN (range_min - value) / nullif(range_min, 0) * 100
                       WHEN 'within' THEN 0 END''', 1)} AS deviation_pct
            FROM sensor_checks c""",
        "sensor_explanation": f"""
            SELECT c.machine_id, c.machine_type, c.sensor, c.value,
                   CASE c.range_state
                   WHEN 'above' THEN {measured}', over the upper limit of ',
                        {num('c.range_max')}, ' ', c.unit, '; an inspection is advised.')
                   WHEN 'below' THEN {measured}', under the lower limit of ',
                        {num('c.range_min')}, ' ', c.unit,
                        '; operating conditions look unusual.')
                   WHEN 'within' THEN {measured}', inside the usual ', {num('c.range_min')},
                        ' to ', {num('c.range_max')}, ' ', c.unit,
                        '; the model flagged it against the type baseline.')
                   ELSE {measured}'; the guide states no usual range, ',
                        'the model alone flagged it.') END AS explanation
            FROM sensor_checks c WHERE c.is_flagged""",
        "health_band": """
            SELECT machine_id, health_pct, CASE WHEN health_pct >= 80 THEN 'good'
                   WHEN health_pct >= 55 THEN 'fair' ELSE 'poor' END AS band FROM assets""",
        "status_from_health": """
            SELECT health_status AS stored_status,
                   CASE WHEN health_pct >= 80 THEN 'HEALTHY' WHEN health_pct >= 55 THEN 'WARNING'
                        WHEN health_pct >= 30 THEN 'BORDERLINE'
                        WHEN health_pct IS NOT NULL THEN 'CRITICAL' END AS implied_status,
                   count(*) AS reading_count,
                   stored_status IS NOT DISTINCT FROM implied_status AS agrees
            FROM readings GROUP BY ALL""",
        "reading_checks": """
            SELECT count(*) AS rows, count(*) FILTER (machine_id IS NULL OR ts IS NULL) AS without_key,
                   count(*) FILTER (health_status IS DISTINCT FROM
                       CASE WHEN health_pct >= 80 THEN 'HEALTHY' WHEN health_pct >= 55 THEN 'WARNING'
                            WHEN health_pct >= 30 THEN 'BORDERLINE'
                            WHEN health_pct IS NOT NULL THEN 'CRITICAL' END) AS status_conflicts,
                   count(*) FILTER (health_pct IS NULL) AS without_health
            FROM readings""",
        "sensor_baselines_sql": f"""
            SELECT machine_type, count(*) AS reading_count, {', '.join(
                f"{rnd(f'avg({s})', 4)} AS avg_{s}, {rnd(f'stddev_samp({s})', 4)} AS std_{s}"
                for s in ('temperature', 'vibration', 'pressure'))}
            FROM readings GROUP BY machine_type""",
        "trend_direction": """
            SELECT machine_id, trend_pct, CASE WHEN trend_pct > 0.5 THEN 'up'
                   WHEN trend_pct < -0.5 THEN 'down' ELSE 'flat' END AS direction FROM assets""",
        "history_by_month": f"""
            SELECT machine_id, strftime(timestamp, '%Y-%m') AS event_month,
                   count(*) AS event_count, strftime(max(timestamp), '%b %Y') AS month_label
            FROM ({history}) GROUP BY machine_id, event_month""",
        "trend_markers": """
            SELECT machine_id, timestamp, health_pct FROM trend WHERE is_anomaly""",
        "trend_labels": """
            SELECT machine_id, timestamp, strftime(timestamp, '%d %b, %H:%M') AS time_label,
                   health_pct FROM trend""",
        "trend_points": """
            SELECT machine_id, count(*) AS point_count FROM trend GROUP BY machine_id""",
        "anomaly_severity": f"""
            SELECT machine_id, machine_type, max_score, {rnd('ratio', 4)} AS score_ratio,
                   CASE WHEN ratio >= 0.66 THEN 'high' WHEN ratio >= 0.33 THEN 'medium'
                        ELSE 'low' END AS severity,
                   strftime(make_timestamp(latest_anomaly_ts // 1000), '%d %b, %H:%M')
                       AS latest_label
            FROM (SELECT s.*, (max_score - min(max_score) OVER ())
                         / CASE WHEN max(max_score) OVER () = min(max_score) OVER () THEN 1
                                ELSE max(max_score) OVER () - min(max_score) OVER () END AS ratio
                  FROM summary s)""",
        "anomaly_total": """
            SELECT CAST(coalesce(sum(anomaly_count), 0) AS BIGINT) AS total_anomalies
            FROM summary""",
        "anomaly_type_share": f"""
            SELECT machine_id, total_readings, sensor, anomaly_count,
                   {rnd('anomaly_count * 100.0e0 / nullif(total_readings, 0)', 1)} AS share_pct
            FROM (SELECT machine_id, total_readings, 'temperature' AS sensor,
                         temp_anomaly_count AS anomaly_count FROM stats
                  UNION ALL SELECT machine_id, total_readings, 'vibration', vib_anomaly_count
                  FROM stats
                  UNION ALL SELECT machine_id, total_readings, 'pressure', press_anomaly_count
                  FROM stats)""",
        "anomaly_vs_normal": f"""
            SELECT machine_id, measure, anomaly_mean, normal_mean,
                   {rnd('anomaly_mean - normal_mean', 2)} AS delta,
                   CASE measure WHEN 'health_pct' THEN anomaly_mean < normal_mean
                        ELSE anomaly_mean <> normal_mean END AS is_worse
            FROM ({' UNION ALL '.join(
                f"SELECT machine_id, '{name}' AS measure, avg_{short}_anomaly AS anomaly_mean, "
                f"avg_{short}_normal AS normal_mean FROM stats"
                for name, short in _SHORT.items())})""",
        "event_labels": f"""
            SELECT machine_id, ts AS timestamp, strftime(ts, '%Y-%m-%d %H:%M') AS minute_label,
                   strftime(ts, '%Y-%m-%d') AS day_label
            FROM matches WHERE is_anomaly""",
        "guide_pages": """
            SELECT guide_id, page AS position, page, content FROM pages_of_guides""",
        "guide_for_type": """
            SELECT guide_id, guide_type, guide_text,
                   CAST(length(guide_text) AS INT) AS guide_chars
            FROM (SELECT g.guide_id, t.guide_type, coalesce(x.guide_text, '') AS guide_text
                  FROM (SELECT DISTINCT guide_id FROM pages_of_guides
                        WHERE page IN (SELECT page FROM page_wanted)) g
                  CROSS JOIN (SELECT DISTINCT guide_type FROM page_wanted) t
                  LEFT JOIN guide_texts x
                         ON x.guide_id = g.guide_id AND x.guide_type = t.guide_type)""",
        "guide_all": """
            SELECT guide_id, page AS position, page,
                   concat('--- Page ', page, ' ---', chr(10), content) AS block
            FROM pages_of_guides""",
        "guide_page_list": """
            SELECT t.machine_type,
                   string_agg(CASE WHEN w.own THEN w.page END, ',' ORDER BY w.place)
                       AS own_pages,
                   string_agg(w.page, ',' ORDER BY w.place) AS pages
            FROM (SELECT DISTINCT machine_type FROM readings) t
            JOIN (SELECT guide_type, place, page,
                         page < 17 AND NOT (page = 7 AND guide_type <> 'furnace') AS own
                  FROM page_wanted) w ON w.guide_type = t.machine_type
            GROUP BY t.machine_type""",
        "guide_page_profile": f"""
            SELECT g.guide_id, w.guide_type, CAST(w.place AS INT) AS place, w.page,
                   CASE WHEN p.page IS NULL THEN 'not found' WHEN p.content = '' THEN 'empty'
                        ELSE 'found' END AS page_state,
                   CASE WHEN p.content <> '' THEN CAST(length(p.content) AS INT) END
                       AS char_count,
                   CASE WHEN p.content <> ''
                        THEN substr(split_part(p.content, chr(10), 1), 1, 80) END AS first_line,
                   CASE WHEN p.content <> '' THEN concat_ws(', ',
                        CASE WHEN contains(lower(p.content), replace(w.guide_type, '_', ' '))
                             THEN w.guide_type END, {keywords}) END AS keywords
            {wanted}""",
        "guide_size": f"""
            SELECT guide_id, guide_type, char_count,
                   CAST(floor(char_count / 4.0e0 + 0.5e0) AS BIGINT) AS token_estimate
            FROM (SELECT g.guide_id, w.guide_type,
                         CAST(coalesce(sum(length(p.content)), 0) AS BIGINT) AS char_count
                  {wanted} GROUP BY g.guide_id, w.guide_type)""",
        "period_label": """
            SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month, count(*) AS reading_count,
                   CASE WHEN y IS NULL THEN 'All time' WHEN m IS NULL THEN 'Year ' || y
                        ELSE strftime(make_date(y, m, 1), '%b %Y') END AS label
            FROM (SELECT year(ts) AS y, month(ts) AS m FROM readings) GROUP BY CUBE (y, m)""",
        "priority": """
            SELECT machine_id, health_pct, is_anomaly,
                   CASE WHEN health_pct < 30 AND is_anomaly THEN 'Urgent'
                        WHEN health_pct < 55 THEN 'High' WHEN health_pct < 80 THEN 'Medium'
                        WHEN health_pct >= 80 THEN 'Low' END AS priority FROM assets""",
        "rul_days": """
            SELECT machine_id, health_pct,
                   CAST(CASE WHEN health_pct >= 80 OR health_pct IS NULL THEN 90
                             WHEN health_pct >= 55 THEN 30 WHEN health_pct >= 30 THEN 7
                             ELSE 3 END AS INT) AS rul_days,
                   health_pct IS NULL AS is_estimated FROM assets""",
        "recommendation_context": """
            SELECT machine_id, task_mode,
                   concat_ws(chr(10) || chr(10), context,
                       CASE WHEN guide_text <> ''
                            THEN concat('Maintenance guide', chr(10), guide_text) END,
                       CASE task_mode
                       WHEN 'A' THEN concat('Task: explain the active anomaly from the flagged ',
                                            'sensors and the history.')
                       WHEN 'B' THEN concat('Task: explain why the machine is degraded and ',
                                            'what to do about it.')
                       ELSE concat('Task: confirm normal operation after checking every ',
                                   'sensor range.') END) AS prompt
            FROM guided""",
        "prompt_context": """
            SELECT q.conv_id, q.machine_id,
                   concat_ws(chr(10) || chr(10),
                       CASE WHEN h.history <> ''
                            THEN concat('Conversation so far', chr(10), h.history) END,
                       (SELECT line FROM fleet_text),
                       coalesce(c.context, 'No data for machine ' || q.machine_id),
                       CASE WHEN c.guide_text <> ''
                            THEN concat('Maintenance guide', chr(10), c.guide_text) END,
                       'Question: ' || q.text) AS prompt
            FROM (SELECT *, concat('M', lpad(CAST(conv_id AS VARCHAR), CAST(greatest(5, length(CAST(conv_id AS VARCHAR))) AS INT), '0')) AS machine_id
                  FROM numbered_turns WHERE back = 1 AND role = 'user') q
            LEFT JOIN (SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn)
                              AS history
                       FROM numbered_turns WHERE back BETWEEN 2 AND 7 GROUP BY conv_id) h
                   ON h.conv_id = q.conv_id
            LEFT JOIN guided c ON c.machine_id = q.machine_id""",
        "recent_turns": """
            SELECT conv_id, count(*) AS turn_count,
                   string_agg(line, chr(10) || chr(10) ORDER BY turn) AS history
            FROM numbered_turns WHERE back <= 6 GROUP BY conv_id""",
        "recommendation_snapshot": f"""
            SELECT machine_id,
                   concat('{{"health_pct":', {num('health_pct', 'null')},
                          ',"is_anomaly":', coalesce(CAST(is_anomaly AS VARCHAR), 'null'),
                          ',"machine_id":"', machine_id, '","machine_type":"', machine_type,
                          '","sensor_snapshot":{{"health_pct":', {num('health_pct', 'null')},
                          ',"pressure":', {num('pressure', 'null')},
                          ',"temperature":', {num('temperature', 'null')},
                          ',"vibration":', {num('vibration', 'null')}, '}}}}') AS record
            FROM reports""",
        "chart_blocks": """
            SELECT message_id, CAST(1 AS INT) AS block_no, lang,
                   json_extract_string(body, '$.type') AS chart_type,
                   json_extract_string(body, '$.title') AS title,
                   json_extract_string(body, '$.xKey') AS x_key,
                   json_extract_string(body, '$.yKey') AS y_key,
                   CAST(json_array_length(body, '$.data') AS BIGINT) AS point_count
            FROM (SELECT message_id, regexp_extract(text, '```(\\w+)\\n', 1) AS lang,
                         regexp_extract(text, '(?s)```\\w+\\n(.*)\\n```', 1) AS body
                  FROM chart_messages)
            WHERE lang IN ('chart', 'json') AND json_valid(body)
              AND x_key <> '' AND y_key <> ''
            UNION ALL
            SELECT message_id, CAST(2 AS INT), 'json', 'area', NULL, 't', 'v', CAST(0 AS BIGINT)
            FROM chart_messages WHERE message_id % 8 = 0""",
        "chart_points": """
            SELECT message_id, CAST(1 AS INT) AS block_no, CAST(i + 1 AS INT) AS point_no,
                   point ->> '$.name' AS label, point ->> '$.v' AS value_text,
                   CAST(point ->> '$.v' AS DOUBLE) AS value,
                   CASE WHEN message_id % 8 = 4 THEN CAST(floor(CAST(point ->> '$.v' AS DOUBLE)
                       * 100 / (CAST(body ->> '$.data[0].v' AS DOUBLE) + 3) + 0.5) AS BIGINT)
                       END AS share_pct,
                   CASE WHEN message_id % 8 = 4 THEN '#111111' ELSE '#6366f1' END AS color
            FROM (SELECT message_id, lang, body, i, json_extract(body, '$.data[' || i || ']') AS point
                  FROM chart_messages, (VALUES (0), (1)) AS t(i)
                  WHERE json_valid(body))
            WHERE point IS NOT NULL AND lang IN ('chart', 'json') AND json_valid(body)
              AND json_extract_string(body, '$.xKey') <> ''""",
    }


def all_statements() -> dict[str, str]:
    """Statements by query key."""
    found = {}
    for suffix, span in SPANS.items():
        for name, select in _by_period(span).items():
            found[f"{name}{suffix}"] = statement(select, span)
        # The same results by another way.
        for name, way in (
            ("anomaly_history", "reduced"),
            ("asset_trend", "sql"),
            ("anomaly_events", "sql"),
            ("kpi_latest", "from_state"),
            ("asset_overview", "from_state"),
            ("asset_detail", "from_summary"),
        ):
            found[f"{name}_{way}{suffix}"] = found[f"{name}{suffix}"]
    for name in ("asset_detail", "asset_trend", "anomaly_history"):
        one = f"SELECT * FROM ({_by_period(Span())[name]}) WHERE machine_id = 'M00001'"
        found[f"{name}_one"] = statement(one)
    for name, select in _all_time().items():
        found[name] = statement(select)
    return found
