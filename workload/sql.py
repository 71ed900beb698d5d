"""The same queries in plain SQL over the given tables, for an independent engine."""

from __future__ import annotations

from workload import views as v

READINGS = """
readings AS (
  SELECT user_id AS device_id, event_id AS seq,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS date_heure, ts, CAST(ts AS DATE) AS log_date,
         value - 100 AS "whOut",
         CAST((event_id % 101) * 15 AS DOUBLE) AS "whStored",
         CAST(event_id % 101 AS DOUBLE) AS "socPercent",
         value AS "wattsOut", value / 12 AS "ampsOut",
         nullif(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS "wattsIn",
         nullif(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) / 12 AS "ampsIn",
         CAST(20.0 AS DOUBLE) + CAST(event_id % 200 AS DOUBLE) / 10 AS temperature,
         CAST(CASE WHEN event_id % 7 = 0 THEN -1 WHEN event_id % 11 = 0 THEN NULL
              ELSE event_id % 9000 END AS DOUBLE) AS "timeToEmptyFull"
  FROM events
)"""

MONTHLY = """
monthly AS (
  SELECT o_custkey AS device_id, o_orderkey AS seq, o_orderdate AS ts,
         CAST(o_orderdate AS DATE) AS log_date, o_totalprice AS "wattsOut",
         CAST(nullif(o_orderkey % 50, 0) AS DOUBLE) AS "wattsIn",
         CAST(20 + o_orderkey % 30 AS DOUBLE) AS temperature
  FROM orders
)"""

# The documents, with the broken ones (event_id % 97 = 0) left out.
STATES = f"""
{READINGS},
states AS (
  SELECT device_id, seq, ts, log_date,
         CASE WHEN seq % 13 = 0 THEN 0 ELSE "whOut" END AS "whOut",
         "whStored", "socPercent",
         CASE WHEN seq % 17 = 0 THEN NULL ELSE "wattsOut" END AS "wattsOut",
         "ampsOut", "wattsIn", "ampsIn",
         CASE WHEN seq % 13 = 0 THEN 0 ELSE temperature END AS temperature,
         "timeToEmptyFull",
         seq % 2 AS ac, CASE WHEN seq % 17 = 0 THEN NULL ELSE seq % 3 END AS usb,
         CASE WHEN seq % 13 = 0 THEN 0 ELSE seq % 2 END AS v12,
         CASE seq % 5 WHEN 0 THEN 20 WHEN 1 THEN 0 WHEN 2 THEN 10 WHEN 4 THEN 20 END AS p_min,
         CASE seq % 5 WHEN 0 THEN 85 WHEN 1 THEN 100 WHEN 2 THEN 90 END AS p_max,
         CASE seq % 5 WHEN 0 THEN 25 WHEN 1 THEN 95 WHEN 2 THEN 30 WHEN 4 THEN 25 END AS p_re
  FROM readings WHERE seq % 97 <> 0
)"""

CHANGES = """
changes AS (
  SELECT user_id AS device_id, ts AS changed, event_id AS seq,
         CASE WHEN event_type = 'signup' THEN 'hotspot' ELSE 'reseau' END AS mode,
         CASE WHEN event_id % 5 = 0 THEN '' ELSE '192.168.1.' || (event_id % 250) END AS ip,
         event_id % 3 <> 0 AS success
  FROM events WHERE event_type IN ('signup', 'click')
)"""

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
SHOWN_MEASURES = ", ".join(
    f'round(round("{m}", 9), 6) AS "{m}"'
    for m in (
        "whOut",
        "whStored",
        "socPercent",
        "wattsOut",
        "ampsOut",
        "wattsIn",
        "ampsIn",
        "temperature",
        "timeToEmptyFull",
    )
)
AVERAGES = """round(round(avg("wattsOut"), 9), 6) AS avg_watts_out,
  round(round(avg(temperature), 9), 6) AS avg_temp,
  round(round(avg("wattsIn"), 9), 6) AS avg_watts_in"""
EXTREMES = """min("wattsIn") AS min_watts_in, max("wattsIn") AS max_watts_in,
  min("wattsOut") AS min_watts_out, max("wattsOut") AS max_watts_out"""
STATS = """round(round(avg("wattsOut"), 9), 6) AS avg_watts_out,
  max("wattsOut") AS max_watts_out, min("wattsOut") AS min_watts_out,
  round(round(avg("socPercent"), 9), 6) AS avg_soc,
  round(sum(abs("whOut")), 4) AS sum_abs_wh_out, count(*) AS n"""
LATEST = """{ts} AS ts, "socPercent" AS soc, "wattsOut" AS watts_out, "wattsIn" AS watts_in,
  round(round(temperature, 9), 6) AS temp, "whStored" AS wh_stored,
  "timeToEmptyFull" AS time_to_empty_full, {left} AS time_left"""


def _time_left(minutes: str, unknown: str = "false") -> str:
    whole = f"CAST(floor(abs({minutes})) AS BIGINT)"
    return (
        f"CASE WHEN {unknown} OR {minutes} IS NULL OR {minutes} = -1 THEN '--:--' "
        f"ELSE printf('%02d:%02d', {whole} // 60, {whole} % 60) END"
    )


def _on(table: str, body: str) -> str:
    return f"WITH {table} {body}"


def _points(source: str, name: str, where: str) -> str:
    return _on(source, f'SELECT device_id, seq, "wattsOut" FROM {name} WHERE {where}')


def _rollup(source: str, name: str, label: str, where: str = "true", keys: str = "") -> str:
    return _on(
        source,
        f"SELECT {keys}{label} AS periode, {AVERAGES} FROM {name} WHERE {where} "
        f"GROUP BY {keys}{label}",
    )


def _summary(source: str, name: str, label: str, where: str, key: str = "") -> str:
    group = f"GROUP BY {key.rstrip(', ')}" if key else ""
    inner = f'''SELECT {key}{label} AS b, avg("wattsIn") AS ai, min("wattsIn") AS ni,
      max("wattsIn") AS xi, avg("wattsOut") AS ao, min("wattsOut") AS no, max("wattsOut") AS xo
      FROM {name} WHERE {where} GROUP BY {key}{label}'''
    parts = ", ".join(
        f"round(round(coalesce({fold}({col}), 0), 9), 6) AS {alias}"
        for fold, col, alias in (
            ("avg", "ai", "avg_watts_in"),
            ("min", "ni", "min_watts_in"),
            ("max", "xi", "max_watts_in"),
            ("avg", "ao", "avg_watts_out"),
            ("min", "no", "min_watts_out"),
            ("max", "xo", "max_watts_out"),
        )
    )
    return _on(source, f"SELECT {key}{parts} FROM ({inner}) {group}")


def _latest(per_device: bool, source: str | None = None, name: str = "readings") -> str:
    part, key = ("PARTITION BY device_id", "device_id, ") if per_device else ("", "")
    shown = LATEST.format(ts=TS.format("ts"), left=_time_left('"timeToEmptyFull"'))
    return _on(
        source or READINGS,
        f"SELECT {key}{shown} FROM (SELECT *, row_number() OVER ({part} ORDER BY ts DESC, "
        f"seq DESC) AS rn FROM {name}) WHERE rn = 1",
    )


def _current() -> str:
    shown = LATEST.format(
        ts=TS.format("ts"), left=_time_left('"timeToEmptyFull"', "NOT connected")
    )
    return _on(
        READINGS,
        f"""SELECT device_id, {shown}, connected,
        CASE WHEN NOT connected THEN 'neutral'
        WHEN coalesce("wattsIn", 0) > coalesce("wattsOut", 0) THEN 'charging'
        WHEN coalesce("wattsOut", 0) > 0 THEN 'discharging' ELSE 'neutral' END AS direction
        FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC) AS rn
          FROM readings
          WHERE seq IN (SELECT event_id FROM events WHERE event_type <> 'error'))
        JOIN (SELECT user_id AS device_id, event_type <> 'error' AS connected,
          row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pn
          FROM events) USING (device_id) WHERE rn = 1 AND pn = 1""",
    )


def _chart(label: str) -> str:
    return _on(
        READINGS,
        f'''SELECT seq, strftime(ts, '{label}') AS label,
        coalesce("wattsOut", 0) AS chart_watts_out, coalesce(temperature, 0) AS chart_temp,
        coalesce("wattsIn", 0) AS chart_watts_in FROM readings''',
    )


def _survivors(source: str, name: str, doomed: str) -> str:
    return _on(
        source,
        f'''SELECT device_id, seq, "wattsOut",
        (SELECT count(*) FROM {name} WHERE {doomed}) AS removed
        FROM {name} WHERE NOT ({doomed})''',
    )


DAY = f"log_date = DATE '{v.DAY}'"
WEEK = f"strftime(ts, '%Y-W%W') = '{v.WEEK}'"
MONTHS = "strftime(ts, '%Y-%m') IN ({})".format(
    ", ".join(f"'{m}'" for m in v.MONTHS.split(","))
)
LAST_DAY = "ts >= TIMESTAMP '2024-01-29 00:00:00'"
LAST_WEEK = "ts >= TIMESTAMP '2024-01-23 00:00:00'"
# 31 August less 6 months runs over the end of February.
LAST_MONTHS = "ts >= TIMESTAMP '2001-03-03 00:00:00'"
HOUR_LABEL = "strftime(ts, '%H:00')"
DATE_HOUR = "strftime(ts, '%Y-%m-%d %H:00')"
DAY_LABEL = "strftime(ts, '%Y-%m-%d')"
MONTH_LABEL = "strftime(ts, '%m/%Y')"

FAILURE_RUNS = f"""
WITH polls AS (
  SELECT user_id AS device_id, ts, event_type <> 'error' AS ok,
         sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM events)
SELECT device_id, {TS.format('min(ts)')} AS "start", {TS.format('max(ts)')} AS "end",
       count(*) AS n, count(*) - 2 AS alerts
FROM polls WHERE NOT ok GROUP BY device_id, run HAVING count(*) >= 3"""

OUTAGE_EVENTS = f"""
WITH polls AS (
  SELECT user_id AS device_id, event_id, ts, event_type <> 'error' AS ok,
         sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM events),
failed AS (
  SELECT device_id, run, ts,
         row_number() OVER (PARTITION BY device_id, run ORDER BY ts, event_id) AS n,
         min(ts) OVER (PARTITION BY device_id, run) AS "start"
  FROM polls WHERE NOT ok),
runs AS (
  SELECT device_id, run, min("start") AS "start", max(ts) AS "end", max(n) AS n
  FROM failed GROUP BY device_id, run HAVING max(n) >= 3)
SELECT device_id, 'alert' AS kind, {TS.format('ts')} AS ts, {TS.format('"start"')} AS "start",
       {TS.format('ts')} AS "end", n
FROM failed WHERE n >= 3
UNION ALL
SELECT r.device_id, 'recovery', {TS.format('p.ts')}, {TS.format('r."start"')},
       {TS.format('r."end"')}, r.n
FROM runs r JOIN polls p ON p.device_id = r.device_id AND p.run = r.run + 1 AND p.ok"""

HOURLY_COLUMNS = """count(*) AS n,
  sum("wattsOut") AS sum_watts_out, count("wattsOut") AS count_watts_out,
  sum(temperature) AS sum_temp, count(temperature) AS count_temp,
  sum("wattsIn") AS sum_watts_in, count("wattsIn") AS count_watts_in,
  sum("socPercent") AS sum_soc, count("socPercent") AS count_soc,
  min("wattsIn") AS min_watts_in, max("wattsIn") AS max_watts_in,
  min("wattsOut") AS min_watts_out, max("wattsOut") AS max_watts_out,
  sum(abs("whOut")) AS sum_abs_wh_out"""

HOURLY_SHOWN = f"""{TS.format('ts')} AS ts, n,
  round(sum_watts_out, 4) AS sum_watts_out, count_watts_out,
  round(sum_temp, 4) AS sum_temp, count_temp,
  round(sum_watts_in, 4) AS sum_watts_in, count_watts_in,
  round(sum_soc, 4) AS sum_soc, count_soc,
  min_watts_in, max_watts_in, min_watts_out, max_watts_out,
  round(sum_abs_wh_out, 4) AS sum_abs_wh_out, CAST(ts AS DATE) AS log_date"""

STREAM_STATS = f"""
WITH {READINGS},
hours AS (SELECT date_trunc('hour', ts) AS h, {HOURLY_COLUMNS} FROM readings GROUP BY 1),
days AS (
  SELECT h + INTERVAL 1 HOUR * k AS window_end, hours.*
  FROM hours, generate_series(1, 24) AS g(k))
SELECT {TS.format('window_end - INTERVAL 24 HOUR')} AS window_start,
       {TS.format('window_end')} AS window_end,
       round(round(sum(sum_watts_out) / sum(count_watts_out), 9), 6) AS avg_watts_out,
       max(max_watts_out) AS max_watts_out, min(min_watts_out) AS min_watts_out,
       round(round(sum(sum_soc) / sum(count_soc), 9), 6) AS avg_soc,
       round(sum(sum_abs_wh_out), 4) AS sum_abs_wh_out, CAST(sum(n) AS BIGINT) AS n
FROM days GROUP BY days.window_end"""


def _config(columns: str, fixed_hotspot: bool = True, tail: str = "") -> str:
    address = "coalesce(f.ip, m.seed)"
    if fixed_hotspot:
        address = f"CASE WHEN m.mode = 'hotspot' THEN m.seed ELSE {address} END"
    return f"""
WITH {CHANGES},
modes(mode, seed) AS (VALUES ('hotspot', '10.1.1.1'), ('reseau', '192.168.1.100')),
devices AS (SELECT DISTINCT device_id FROM changes),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY changed DESC, seq DESC) AS r,
         row_number() OVER (PARTITION BY device_id, mode ORDER BY changed DESC, seq DESC) AS rm
  FROM changes),
addressed AS (
  SELECT device_id, mode, ip FROM (
    SELECT *, row_number() OVER (PARTITION BY device_id, mode ORDER BY changed DESC, seq DESC) AS ra
    FROM changes WHERE ip <> '') WHERE ra = 1),
state AS (
  SELECT d.device_id, m.mode, {address} AS ip, a.mode = m.mode AS is_active,
         coalesce(c.success, false) AS last_tested_success, {TS.format('c.changed')} AS last_updated
  FROM devices d CROSS JOIN modes m
  LEFT JOIN ranked c ON c.device_id = d.device_id AND c.mode = m.mode AND c.rm = 1
  LEFT JOIN addressed f ON f.device_id = d.device_id AND f.mode = m.mode
  JOIN ranked a ON a.device_id = d.device_id AND a.r = 1)
SELECT {columns} FROM state {tail}"""


ACTIVE = _config(
    "e.device_id, coalesce(state.mode, 'hotspot') AS mode, coalesce(state.ip, '10.1.1.1') AS ip",
    tail="""RIGHT JOIN (SELECT DISTINCT user_id AS device_id FROM events) e
    ON e.device_id = state.device_id AND state.is_active WHERE true""",
)

SQL: dict[str, str] = {
    "read_state": _on(STATES, f"SELECT device_id, seq, {SHOWN_MEASURES}, log_date FROM states"),
    "count_states": """SELECT count(*) FILTER (WHERE event_id % 97 <> 0) AS n_readable,
        count(*) FILTER (WHERE event_id % 97 = 0) AS n_corrupt FROM events""",
    "corrupt_states": """SELECT user_id AS device_id, event_id AS seq, 'bad' AS payload
        FROM events WHERE event_id % 97 = 0""",
    "append_readings": _on(
        READINGS,
        """SELECT log_date, count(*) AS n, round(sum("wattsOut"), 4) AS sum_watts_out
        FROM readings GROUP BY log_date""",
    ),
    "read_logs": _on(
        READINGS,
        f"SELECT device_id, seq, date_heure, {TS.format('ts')} AS ts, {SHOWN_MEASURES}, log_date "
        "FROM readings",
    ),
    "parse_time": _on(
        READINGS,
        f"""SELECT seq, CASE WHEN seq % 19 = 0 THEN date_heure || '+02:00'
          WHEN seq % 23 = 0 THEN substr(date_heure, 1, 7) WHEN seq % 29 = 0 THEN 'garbage'
          ELSE date_heure END AS date_heure,
        CASE WHEN seq % 19 = 0 OR seq % 23 = 0 OR seq % 29 = 0 THEN NULL
          ELSE {TS.format('ts')} END AS ts,
        CASE WHEN seq % 19 = 0 OR seq % 23 = 0 OR seq % 29 = 0 THEN NULL
          ELSE log_date END AS log_date FROM readings""",
    ),
    "export_json": _on(
        READINGS,
        """SELECT '{"device_id":' || device_id || ',"seq":' || seq || ',"socPercent":' ||
        CAST("socPercent" AS VARCHAR) || ',"wattsOut":' || CAST("wattsOut" AS VARCHAR) ||
        ',"wattsIn":' || coalesce(CAST("wattsIn" AS VARCHAR), 'null') || '}' AS json
        FROM readings""",
    ),
    "default_missing": _on(
        STATES,
        """SELECT seq, "whOut", "wattsOut", "wattsIn", temperature, "timeToEmptyFull"
        FROM states""",
    ),
    "port_states": _on(
        STATES,
        """SELECT seq, CAST(ac AS INT) AS ac, CAST(usb AS INT) AS usb, CAST(v12 AS INT) AS "12v",
        ac <> 0 AS ac_on, coalesce(usb <> 0, false) AS usb_on, v12 <> 0 AS "12v_on"
        FROM states""",
    ),
    "charge_profile": _on(
        STATES, 'SELECT seq, CAST(p_min AS DOUBLE) AS "min", CAST(p_max AS DOUBLE) AS "max", '
        "CAST(p_re AS DOUBLE) AS re FROM states",
    ),
    "classify_profile": _on(
        STATES,
        """SELECT seq, CASE WHEN p_min IS NULL OR p_max IS NULL OR p_re IS NULL THEN NULL
        WHEN (p_min, p_max, p_re) = (20, 85, 25) THEN 'eco'
        WHEN (p_min, p_max, p_re) = (0, 100, 95) THEN 'standard' ELSE 'custom' END AS profile
        FROM states""",
    ),
    "format_time_left": _on(
        READINGS,
        f"""SELECT seq, {_time_left("t", "seq % 10 = 0")} AS time_left
        FROM (SELECT seq, "timeToEmptyFull" * -1.5 AS t FROM readings)""",
    ),
    "charge_direction": _on(
        READINGS,
        """SELECT seq, CASE WHEN seq % 10 = 0 THEN 'neutral'
        WHEN coalesce("wattsIn", 0) > coalesce("wattsOut", 0) THEN 'charging'
        WHEN coalesce("wattsOut", 0) > 0 THEN 'discharging' ELSE 'neutral' END AS direction
        FROM readings""",
    ),
    "chart_series": _chart("%H:%M"),
    "chart_series_day": _chart("%d/%m %H:%M"),
    "chart_series_month": _chart("%d/%m"),
    "null_to_zero": _on(
        READINGS,
        f"""SELECT device_id, {DATE_HOUR} AS periode,
        round(round(coalesce(avg("wattsOut"), 0), 9), 6) AS avg_watts_out,
        round(round(coalesce(avg(temperature), 0), 9), 6) AS avg_temp,
        round(round(coalesce(avg("wattsIn"), 0), 9), 6) AS avg_watts_in
        FROM readings GROUP BY device_id, {DATE_HOUR}""",
    ),
    "display_round": _on(
        READINGS,
        """SELECT seq, CAST(printf('%.1f', "wattsOut") AS DOUBLE) AS "wattsOut",
        CAST(printf('%.2f', "whOut") AS DOUBLE) AS "whOut", floor("ampsOut" + 0.5) AS "ampsOut"
        FROM readings""",
    ),
    "time_keys": _on(
        READINGS,
        f"""SELECT seq, {HOUR_LABEL} AS hour_of_day, {DATE_HOUR} AS date_hour,
        {DAY_LABEL} AS day, strftime(ts, '%Y-W%W') AS week, strftime(ts, '%Y-%m') AS year_month,
        {MONTH_LABEL} AS month_label FROM readings""",
    ),
    "time_keys_years": _on(
        MONTHLY,
        f"""SELECT seq, {DAY_LABEL} AS day, strftime(ts, '%Y-W%W') AS week,
        strftime(ts, '%Y-%m') AS year_month, {MONTH_LABEL} AS month_label FROM monthly""",
    ),
    "period_key": _on(
        MONTHLY,
        f"""SELECT DISTINCT {MONTH_LABEL} AS periode, strftime(ts, '%Y-%m') AS "key"
        FROM monthly""",
    ),
    "period_key_hour": _on(
        READINGS,
        f"""SELECT DISTINCT {HOUR_LABEL} AS periode, strftime(ts, '%Y-%m-%d %H') AS "key"
        FROM readings WHERE {DAY}""",
    ),
    "rated_utilisation": _on(
        MONTHLY,
        """SELECT seq, round(round((seq % 130) / 100.0, 9), 6) AS "socPercent_share",
        round(round(CASE WHEN "wattsOut" > 2000 THEN 1 ELSE "wattsOut" / 2000 END, 9), 6)
          AS "wattsOut_share",
        round(round(CASE WHEN "wattsIn" > 1500 THEN 1 ELSE "wattsIn" / 1500 END, 9), 6)
          AS "wattsIn_share",
        round(round(CASE WHEN temperature > 60 THEN 1 ELSE temperature / 60 END, 9), 6)
          AS temperature_share FROM monthly""",
    ),
    "poll_success": """SELECT event_id AS seq, event_type <> 'error' AS ok_dashboard,
        CASE WHEN event_type = 'error' THEN event_id % 2 = 1 ELSE event_id % 97 <> 0 END
          AS ok_logger FROM events""",
    "lookback": _points(READINGS, "readings", LAST_DAY),
    "lookback_exact": _points(READINGS, "readings", "ts >= TIMESTAMP '2024-01-23 12:00:00'"),
    "lookback_months": _points(MONTHLY, "monthly", LAST_MONTHS),
    "on_day": _points(READINGS, "readings", DAY),
    "in_week": _points(READINGS, "readings", WEEK),
    "in_week_zero": _points(MONTHLY, "monthly", "strftime(ts, '%Y-W%W') = '1999-W00'"),
    "in_months": _points(MONTHLY, "monthly", MONTHS),
    "in_hour": _points(READINGS, "readings", f"strftime(ts, '%Y-%m-%d %H') = '{v.HOUR}'"),
    "select_period": _points(READINGS, "readings", LAST_WEEK),
    "rollup_hour_of_day": _rollup(READINGS, "readings", HOUR_LABEL, DAY),
    "rollup_date_hour": _rollup(READINGS, "readings", DATE_HOUR, LAST_DAY),
    "rollup_day_in_week": _rollup(READINGS, "readings", DAY_LABEL, WEEK),
    "rollup_day_7d": _rollup(READINGS, "readings", DAY_LABEL, LAST_WEEK),
    "rollup_month_selected": _rollup(MONTHLY, "monthly", MONTH_LABEL, MONTHS),
    "rollup_month_6m": _rollup(MONTHLY, "monthly", MONTH_LABEL, LAST_MONTHS),
    "rollup_device_hours": _rollup(READINGS, "readings", DATE_HOUR, keys="device_id, "),
    "minmax_raw": _on(READINGS, f"SELECT {EXTREMES} FROM readings WHERE {DAY}"),
    "minmax_raw_device": _on(
        READINGS, f"SELECT device_id, {EXTREMES} FROM readings GROUP BY device_id"
    ),
    "minmax_hourly": _on(READINGS, f"SELECT {EXTREMES} FROM readings WHERE {WEEK}"),
    "minmax_daily": _on(MONTHLY, f"SELECT {EXTREMES} FROM monthly WHERE {LAST_MONTHS}"),
    "mean_of_buckets": _on(
        READINGS,
        f"""SELECT round(round(coalesce(avg(i), 0), 9), 6) AS avg_watts_in,
        round(round(coalesce(avg(o), 0), 9), 6) AS avg_watts_out
        FROM (SELECT avg("wattsIn") AS i, avg("wattsOut") AS o FROM readings
              WHERE {DAY} GROUP BY {HOUR_LABEL})""",
    ),
    "mean_of_buckets_device": _on(
        READINGS,
        """SELECT device_id, round(round(coalesce(avg(i), 0), 9), 6) AS avg_watts_in,
        round(round(coalesce(avg(o), 0), 9), 6) AS avg_watts_out
        FROM (SELECT device_id, avg("wattsIn") AS i, avg("wattsOut") AS o FROM readings
              GROUP BY device_id, log_date) GROUP BY device_id""",
    ),
    "stats_24h": _on(READINGS, f"SELECT {STATS} FROM readings WHERE {LAST_DAY}"),
    "stats_24h_device": _on(
        READINGS, f"SELECT device_id, {STATS} FROM readings WHERE {LAST_DAY} GROUP BY device_id"
    ),
    "failure_runs": FAILURE_RUNS,
    "failure_runs_by_hour": FAILURE_RUNS,
    "available_dates": f"SELECT DISTINCT {DAY_LABEL} AS date FROM events",
    "available_weeks": _on(
        MONTHLY,
        """SELECT strftime(ts, '%Y-W%W') AS week, min(log_date) AS week_start
        FROM monthly GROUP BY 1""",
    ),
    "available_months": _on(
        MONTHLY,
        "SELECT DISTINCT strftime(ts, '%Y-%m') AS month FROM monthly ORDER BY month DESC LIMIT 6",
    ),
    "latest_reading": _latest(False),
    "latest_reading_device": _latest(True),
    "latest_of_newest_day": _latest(False),
    "current_stats": _current(),
    "config_from_polls": f"""SELECT device_id, ts AS at, seq, NULL::VARCHAR AS ip,
        CASE WHEN device_id % 3 = 0 THEN 'hotspot' ELSE 'reseau' END AS mode,
        kind = 'recovery' AS success
        FROM ({OUTAGE_EVENTS}) JOIN (SELECT event_id AS seq, user_id AS device_id,
          {TS.format('ts')} AS ts FROM events) USING (device_id, ts)""",
    "ordered_series": _on(
        READINGS,
        f"""SELECT device_id, seq, date_heure, {TS.format('ts')} AS ts, "wattsOut",
        round(round(temperature, 9), 6) AS temperature, "wattsIn" FROM readings
        WHERE {WEEK} ORDER BY readings.ts, device_id, seq""",
    ),
    "label_order": _rollup(MONTHLY, "monthly", MONTH_LABEL, MONTHS) + " ORDER BY periode",
    "active_config": ACTIVE,
    "delete_hour": _survivors(
        READINGS, "readings", f"strftime(ts, '%Y-%m-%d %H') = '{v.HOUR}'"
    ),
    "delete_day": _survivors(READINGS, "readings", DAY),
    # The readings fifteen days later.
    "delete_month": _survivors(
        READINGS, "readings", f"strftime(ts + INTERVAL 15 DAY, '%Y-%m') = '{v.MONTH}'"
    ),
    "survivors": _points(MONTHLY, "monthly", f"strftime(ts, '%Y-%m') <> '{v.ONE_MONTH}'"),
    "fold_config": _config("*"),
    "fold_config_ip": _config("device_id, mode, ip"),
    "fold_config_ip_any_mode": _config("device_id, mode, ip", fixed_hotspot=False),
    "summary": _summary(READINGS, "readings", HOUR_LABEL, DAY),
    "summary_day": _summary(READINGS, "readings", DAY_LABEL, LAST_WEEK),
    "summary_month": _summary(MONTHLY, "monthly", MONTH_LABEL, LAST_MONTHS),
    "summary_device": _summary(READINGS, "readings", DAY_LABEL, WEEK, "device_id, "),
    "dashboard": "SELECT *, 'Par jour - Semaine 03/2024' AS title FROM ("
    + _rollup(READINGS, "readings", DAY_LABEL, WEEK)
    + ")",
    "dashboard_table": "SELECT periode, "
    + ", ".join(
        f"CAST(printf('%.1f', coalesce({c}, 0)) AS DOUBLE) AS {c}"
        for c in ("avg_watts_out", "avg_temp", "avg_watts_in")
    )
    + f" FROM ({_rollup(READINGS, 'readings', DATE_HOUR, LAST_DAY)})",
    "dashboard_dates": f"SELECT DISTINCT {DAY_LABEL} AS date FROM events",
    "dashboard_months": "SELECT DISTINCT strftime(ts, '%Y-%m') AS month FROM events "
    "ORDER BY month DESC LIMIT 6",
    "dashboard_summary": _summary(READINGS, "readings", DAY_LABEL, WEEK),
    "dashboard_series": _on(
        READINGS,
        f"""SELECT strftime(ts, '%d/%m %H:%M') AS label, "wattsOut" AS chart_watts_out,
        temperature AS chart_temp, coalesce("wattsIn", 0) AS chart_watts_in
        FROM readings WHERE {WEEK}""",
    ),
    "dashboard_latest": _latest(False),
    "dashboard_weeks": """SELECT strftime(ts, '%Y-W%W') AS week, min(CAST(ts AS DATE)) AS week_start
        FROM events GROUP BY 1""",
    "hourly_table": _on(
        READINGS,
        f"""SELECT device_id, {HOURLY_SHOWN} FROM (
        SELECT device_id, date_trunc('hour', ts) AS ts, {HOURLY_COLUMNS} FROM readings
        GROUP BY device_id, date_trunc('hour', ts))""",
    ),
    "hourly_rollup_day": _rollup(READINGS, "readings", DAY_LABEL, WEEK),
    "hourly_summary": _summary(READINGS, "readings", DAY_LABEL, LAST_WEEK),
    "hourly_stats": _on(
        READINGS, f"SELECT device_id, {STATS} FROM readings WHERE {LAST_DAY} GROUP BY device_id"
    ),
    "stream_ingest": _on(
        STATES, f"SELECT device_id, seq, {SHOWN_MEASURES}, log_date FROM states"
    ),
    "stream_compact": _on(
        STATES, f"SELECT device_id, seq, {SHOWN_MEASURES}, log_date FROM states"
    ),
    "stream_latest_device": _latest(True, STATES, "states"),
    "stream_delete_day": _on(
        STATES,
        f"""SELECT device_id, seq, {SHOWN_MEASURES}, log_date FROM states
        WHERE CASE WHEN log_date = DATE '2024-01-15' THEN seq % 2 = 0
                   ELSE NOT (ts >= TIMESTAMP '2024-01-16 09:00:00' AND ts < TIMESTAMP '2024-01-16 10:00:00')
              END""",
    ),
    "stream_rollup_hour": _on(
        READINGS,
        f"""SELECT {HOURLY_SHOWN} FROM (
        SELECT date_trunc('hour', ts) AS ts, {HOURLY_COLUMNS} FROM readings
        GROUP BY date_trunc('hour', ts))""",
    ),
    "stream_stats_24h": STREAM_STATS,
    "stream_latest": _latest(True),
    "stream_outage": OUTAGE_EVENTS,
    "stream_outage_runs": f'SELECT device_id, "start", "end", n FROM ({FAILURE_RUNS})',
}
