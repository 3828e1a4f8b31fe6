"""The same questions as `catalog`, asked in SQL over the same tables, rule by rule and with the
empty cells really built. Used to check results, never to compute them."""

from __future__ import annotations

from parkpulse.plans.catalog import DAYS, HOT_SENSOR, SELECTED, SELECTED_SHORT, SITES

RAW = """
raw AS (
  SELECT event_id AS row_id,
    '주차센서_' || ['대신','옥천','영천'][user_id % 3 + 1] || '졸음쉼터_#'
      || repeat('0', greatest(0, 5 - length(user_id::VARCHAR))) || user_id::VARCHAR AS sensor,
    '장치구분: 주차검지센서, 검지기: ' || detector || ', 배터리: 3.6, 장애: '
      || CASE WHEN k % 25 = 0 THEN '51.0' ELSE '0.0' END
      || ', RSSI: -' || (60 + k)::VARCHAR || ', SNR: ' || (k % 12)::VARCHAR
      || ', 동작: ' || action AS payload,
    strftime(date_trunc('second', ts) - INTERVAL 715 DAY, '%Y-%m-%d %H:%M:%S') AS send_ts
  FROM (
    SELECT event_id, ts, user_id, k,
      CASE WHEN event_type = 'error' AND k = 99 THEN '초기부팅'
           WHEN event_type IN ('view','click') THEN '차량주차'
           WHEN event_type IN ('signup','purchase') THEN '차량출차'
           WHEN event_id % 2 = 0 THEN '차량주차' ELSE '차량출차' END AS detector,
      CASE WHEN event_type <> 'error' THEN '주차이벤트'
           WHEN k < 50 THEN '주기보고' WHEN k < 70 THEN 'LoRa 수신오류'
           WHEN k < 85 THEN '레이더 고장' WHEN k < 92 THEN '오류'
           WHEN k < 96 THEN '2.0' WHEN k < 99 THEN '3.0' ELSE '초기 부팅' END AS action
    FROM (SELECT *, json_extract(props, '$.k')::INTEGER AS k FROM events)
  )
)"""

SITE = "regexp_extract({}, '^(.*?)(졸음쉼터|#|$)', 1)"
SENSOR_SITE = SITE.format("sensor")

NAMES = {
    "full": "regexp_replace(sensor, '^주차센서_', '')",
    "short": "regexp_replace(regexp_replace(sensor, '^주차센서_', ''), '졸음쉼터.', '')",
    "charclass": "regexp_replace(sensor, '[주차센서_|졸음쉼터]', '', 'g')",
}


def _split(style: str) -> str:
    return f"""{RAW},
fields AS (
  SELECT row_id, {NAMES[style]} AS sensor, CAST(send_ts AS TIMESTAMP) AS ts,
    string_split(regexp_replace(payload, '[a-zA-Z|가-힣\\s]+: ', '', 'g'), ',') AS p
  FROM raw
)"""


def _messages(style: str) -> str:
    return f"""{_split(style)},
messages AS (
  SELECT min(row_id) AS row_id, sensor, ts, device_type, detector, battery, fault, rssi, snr, action
  FROM (
    SELECT row_id, sensor, ts, p[1] AS device_type, p[2] AS detector,
      p[3]::DOUBLE AS battery,
      CASE WHEN p[4] = '51.0' THEN '리셋 발생' ELSE p[4] END AS fault,
      p[5]::DOUBLE AS rssi, p[6]::DOUBLE AS snr,
      CASE WHEN p[7] IN ('2.0','오류') THEN 'LoRa Reset 수신 후 부팅'
           WHEN p[7] = '3.0' THEN 'LoRa 전송오류 등으로 인한 자체 시스템 Reset'
           ELSE p[7] END AS action
    FROM fields WHERE len(p) = 7
  ) GROUP BY sensor, ts, device_type, detector, battery, fault, rssi, snr, action
)"""


def _guarded(style: str, post_report: bool = False) -> str:
    after = "WHEN lag_b = 1 THEN 4" if post_report else ""
    return f"""{_messages(style)},
based AS (
  SELECT *, CASE WHEN action = '주차이벤트' THEN 0 WHEN action = '주기보고' THEN 1 ELSE 2 END AS b
  FROM messages
),
placed AS (
  SELECT *, lag(b) OVER w AS lag_b, lead(b) OVER w AS lead_b,
    lag(detector) OVER w AS lag_d, lead(detector) OVER w AS lead_d,
    lag(ts) OVER w AS lag_ts, lead(ts) OVER w AS lead_ts
  FROM based WINDOW w AS (PARTITION BY sensor ORDER BY ts, row_id)
),
coded AS (
  SELECT row_id, sensor, detector, action, ts, CASE {after}
    WHEN detector = '차량주차' AND lead_b <> 0 AND b = 0 THEN 3
    WHEN detector = '차량주차' AND lead_d = '차량주차' AND b = 0 THEN 3
    WHEN detector = '차량출차' AND lag_d = '차량출차' AND b = 0 THEN 3
    WHEN month(ts) <> month(lead_ts) AND detector = '차량주차' THEN 3
    WHEN month(ts) <> month(lag_ts) AND detector = '차량출차' THEN 3
    WHEN lag_ts IS NULL AND detector = '차량출차' AND b = 0 THEN 3
    WHEN lead_ts IS NULL AND detector = '차량주차' AND b = 0 THEN 3
    ELSE b END AS status_code
  FROM placed
)"""


V2_FIELDS = f"""{_split("charclass")},
messages AS (
  SELECT row_id, sensor, ts, replace(p[2], '차량', '') AS detector,
    CASE WHEN replace(p[2], '차량', '') <> '초기부팅' THEN
      CASE WHEN p[7] IN ('오류','2.0','3.0') OR contains(p[7], 'LoRa') THEN '통신오류'
           WHEN contains(p[7], '고장') THEN '센서오류'
           WHEN contains(p[7], '주기') THEN '주기보고' ELSE '정상' END
      ELSE p[7] END AS action
  FROM fields
)"""

PRECEDENCE = f"""{V2_FIELDS},
placed AS (
  SELECT *, lag(detector) OVER w AS lag_d, lead(detector) OVER w AS lead_d,
    lag(ts) OVER w AS lag_ts, lead(ts) OVER w AS lead_ts
  FROM messages WINDOW w AS (PARTITION BY sensor ORDER BY ts, row_id)
),
coded AS (
  SELECT row_id, sensor, detector, action, ts, CASE
    WHEN lead_ts IS NOT NULL AND detector = '주차' AND lead_d <> '출차' THEN 3
    WHEN lag_ts IS NOT NULL AND detector = '출차' AND lag_d <> '주차' THEN 3
    WHEN detector = '주차' AND lead_ts IS NULL THEN 3
    WHEN detector = '출차' AND lag_ts IS NULL THEN 3
    WHEN contains(action, '오류') THEN 2
    WHEN action = '주기보고' THEN 1 ELSE 0 END AS status_code
  FROM placed
)"""

STAYS = f""",
stays AS (
  SELECT sensor, {SENSOR_SITE} AS site, ts AS in_ts, out_ts, next_d,
    date_diff('second', ts, out_ts) AS dwell_sec
  FROM (
    SELECT *, lead(ts) OVER w AS out_ts, lead(detector) OVER w AS next_d
    FROM coded WHERE status_code = 0
    WINDOW w AS (PARTITION BY sensor ORDER BY ts, row_id)
  ) WHERE detector IN ('차량주차', '주차') AND out_ts IS NOT NULL
)"""

CELLS = f""",
cells AS (
  SELECT sensor, {SENSOR_SITE} AS site, hour, sum(sec)::BIGINT AS occupied_sec,
    ((sum(sec) * 20000 + 3600) // 7200)::BIGINT AS pct100
  FROM (
    SELECT sensor, hour,
      date_diff('second', greatest(in_ts, hour), least(out_ts, hour + INTERVAL 1 HOUR)) AS sec
    FROM (
      SELECT *, unnest(generate_series(date_trunc('hour', in_ts), date_trunc('hour', out_ts),
                                       INTERVAL 1 HOUR)) AS hour
      FROM stays
    )
  ) GROUP BY sensor, hour
)"""

GRID = """,
sensors AS (SELECT DISTINCT sensor FROM messages),
grid AS (
  SELECT DISTINCT date_trunc('hour', t) AS hour FROM (
    SELECT unnest(generate_series(min(in_ts), max(out_ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS t
    FROM stays
  )
),
dense AS (
  SELECT s.sensor, g.hour, coalesce(c.occupied_sec, 0)::BIGINT AS occupied_sec
  FROM sensors s CROSS JOIN grid g LEFT JOIN cells c ON c.sensor = s.sensor AND c.hour = g.hour
)"""

V1 = "WITH " + _guarded("short")
BATCH = "WITH " + _guarded("full", post_report=True)
V2 = "WITH " + PRECEDENCE
V1_STAYS, BATCH_STAYS, V2_STAYS = V1 + STAYS, BATCH + STAYS, V2 + STAYS
V1_CELLS, V2_CELLS = V1_STAYS + CELLS, V2_STAYS + CELLS
BATCH_DENSE = BATCH_STAYS + CELLS + GRID

IN_RANGE = f"BETWEEN DATE '{DAYS[0]}' AND DATE '{DAYS[1]}'"
HOLIDAYS = (
    "('2022-01-01','2022-01-31','2022-02-01','2022-02-02','2022-03-01','2022-05-05',"
    "'2022-05-08','2022-06-06','2022-08-15','2022-09-09','2022-09-10','2022-09-11',"
    "'2022-09-12','2022-10-03','2022-10-09','2022-10-10','2022-12-25')"
)
WEEKDAY_NAME = "dayname(DATE '2024-01-01' + weekday)"


def _units(num: str, den: str, digits: int = 0) -> str:
    """num / den for whole numbers, rounded half up, in units of 10**-digits."""
    return f"((({num}) * {2 * 10**digits} + ({den})) // (({den}) * 2))::BIGINT"


def _half_up(num: str, den: str, digits: int = 0) -> str:
    return f"({_units(num, den, digits)}::DOUBLE / {10**digits}::DOUBLE)"


def _part(name: str, ts: str) -> str:
    return {
        "date": f"CAST({ts} AS DATE)",
        "hour": f"hour({ts})::INTEGER",
        "weekday": f"(isodow({ts}) - 1)::INTEGER",
        "month": f"month({ts})::INTEGER",
    }[name]


def _status(head: str) -> str:
    return f"{head} SELECT sensor, detector, action, ts, status_code FROM coded"


def _errors(head: str, key: str, name: str, post_report: bool = False) -> str:
    after = "n_post_report, " if post_report else ""
    plus = "n_post_report + " if post_report else ""
    return f"""{head}, counted AS (
  SELECT {key} AS {name},
    count(*) FILTER (WHERE action = '주차이벤트' AND status_code = 0) AS n_normal,
    count(*) FILTER (WHERE status_code = 1) AS n_periodic,
    count(*) FILTER (WHERE status_code = 4) AS n_post_report,
    count(*) FILTER (WHERE action LIKE 'LoRa%' AND status_code = 2) AS n_comm,
    count(*) FILTER (WHERE action LIKE '레이더%' AND status_code = 2) AS n_sensor,
    count(*) FILTER (WHERE action = '초기 부팅') AS n_boot,
    count(*) FILTER (WHERE status_code = 3) AS n_sequence
  FROM coded GROUP BY 1)
SELECT {name}, n_normal, n_periodic, {after}n_comm, n_sensor, n_boot, n_sequence,
  n_normal + n_periodic + {plus}n_comm + n_sensor + n_boot + n_sequence AS n_total
FROM counted"""


def _codes(keys: str, names: str, source: str = "coded", where: str = "") -> str:
    return f"""{V2} SELECT {keys},
  count(*) FILTER (WHERE status_code = 0) AS n_normal,
  count(*) FILTER (WHERE status_code = 1) AS n_periodic,
  count(*) FILTER (WHERE status_code = 2) AS n_comm_device,
  count(*) FILTER (WHERE status_code = 3) AS n_sequence
FROM {source} {where} GROUP BY {names}"""


def _rate(condition: str) -> str:
    return (
        f"count(*) FILTER (WHERE {condition} AND status_code = 3)::DOUBLE"
        f" / nullif(count(*) FILTER (WHERE {condition}), 0)::DOUBLE"
    )


def _dominated(head: str) -> str:
    """The same over messages of which every second comes from one sensor."""
    hot = f"CASE WHEN row_id % 2 = 0 THEN '{HOT_SENSOR}' ELSE sensor END AS sensor"
    plain = RAW.replace("raw AS", "plain AS")
    return head.replace(RAW, f"{plain},\nraw AS (SELECT * REPLACE ({hot}) FROM plain)")


def _stay_table(head: str, where: str = "TRUE") -> str:
    return f"{head} SELECT sensor, in_ts, out_ts, dwell_sec FROM stays WHERE {where}"


def _enriched(head: str, day_type: str) -> str:
    return f"""{head}, parts AS (
  SELECT *, (isodow(in_ts) - 1)::INTEGER AS weekday,
    string_split(sensor, '졸음쉼터_#') AS name FROM stays)
SELECT sensor, name[1] AS site, name[2]::INTEGER AS detector_no, weekday,
  dayname(in_ts) AS weekday_name, {day_type} AS day_type,
  CASE WHEN hour(in_ts) >= 7 AND hour(in_ts) < 19 THEN '낮' ELSE '밤' END AS day_night,
  in_ts, out_ts, dwell_sec
FROM parts"""


OFF_DAY = f"weekday >= 5 OR strftime(in_ts, '%Y-%m-%d') IN {HOLIDAYS}"
TWO_WAY = f"CASE WHEN {OFF_DAY} THEN '휴일' ELSE '평일' END"
THREE_WAY = (
    "CASE WHEN in_ts >= TIMESTAMP '2022-01-28' AND in_ts <= TIMESTAMP '2022-02-02' "
    f"THEN '설연휴' WHEN {OFF_DAY} THEN '휴일' ELSE '평일' END"
)


def _usage(head: str, *parts: str) -> str:
    keys = ", ".join(p if p == "site" else f"{_part(p, 'in_ts')} AS {p}" for p in parts)
    return f"""{head}, usage AS (
  SELECT {keys}, count(*) AS usage_count FROM stays GROUP BY ALL)"""


def _dwell(digits: int, *parts: str) -> str:
    keys = ", ".join(p if p == "site" else f"{_part(p, 'in_ts')} AS {p}" for p in parts)
    mean = _half_up("sum(dwell_sec)", "count(*) * 60", digits)
    return f"""{V1_STAYS}, dwell AS (
  SELECT {keys}, {mean} AS dwell_min FROM stays GROUP BY ALL)"""


def _mean_of(table: str, value: str, digits: int, to: int | None = None) -> str:
    """Mean of a column that has `digits` decimals, with `to` decimals (as many)."""
    scaled = f"(SELECT sum(round({value} * {10**digits})::BIGINT) FROM {table})"
    count = f"(SELECT count(*) * {10**digits} FROM {table})"
    return _half_up(scaled, count, digits if to is None else to)


def _observed(part: str, group: str = "'all'", days: str | None = None) -> str:
    """Zero-filled: every sensor with a cell at every observed hour."""
    where = f"WHERE CAST(hour AS DATE) {days}" if days else ""
    mean = _half_up("sum(coalesce(c.pct100, 0))", "count(*) * 100", 1)
    return f"""{V1_CELLS}, hours AS (SELECT DISTINCT hour FROM cells {where}),
units AS (SELECT DISTINCT sensor, site, {group} AS unit FROM cells),
occupancy AS (
  SELECT u.unit, {_part(part, "h.hour")} AS {part}, {mean} AS occupancy_pct
  FROM units u CROSS JOIN hours h
  LEFT JOIN cells c ON c.sensor = u.sensor AND c.hour = h.hour
  GROUP BY ALL)"""


def _sparse(period: str) -> str:
    return f"""{V2_CELLS}, by_site AS (
  SELECT site, {_part(period, "hour")} AS {period},
    sum(pct100)::DOUBLE / (count(*) * 100)::DOUBLE AS occupancy_pct
  FROM cells GROUP BY ALL)"""


RESPONSES = f"""{V1_STAYS}, y AS (
  SELECT site, dwell_sec, hour(in_ts)::BIGINT AS arrival_hour FROM stays)"""

FRACTIONAL = f"""{V1_STAYS}, y AS (
  SELECT site, dwell_sec / 3600.0::DOUBLE AS dwell_hours,
    hour(in_ts) + minute(in_ts) / 60.0::DOUBLE AS arrival_hours
  FROM stays)"""

ANOVA = f"""{RESPONSES}, long AS (
  SELECT 'dwell_sec' AS response, site, dwell_sec::DOUBLE AS v FROM y
  UNION ALL SELECT 'arrival_hour', site, arrival_hour::DOUBLE FROM y),
means AS (
  SELECT *, avg(v) OVER (PARTITION BY response, site) AS gm, avg(v) OVER (PARTITION BY response) AS m
  FROM long),
scatter AS (
  SELECT response, count(DISTINCT site) - 1 AS df1, count(*) - count(DISTINCT site) AS df2,
    sum((gm - m) * (gm - m)) AS ssb, sum((v - gm) * (v - gm)) AS ssw
  FROM means GROUP BY response),
tested AS (SELECT *, (ssb / df1) / (ssw / df2) AS f FROM scatter)
SELECT response, df1 AS df_between, df2 AS df_within,
  printf('%.8e', ssb)::DOUBLE AS ss_between, printf('%.8e', ssw)::DOUBLE AS ss_within,
  round(f, 6) AS f_value,
  round(pow(1 + 2 * f / df2, -df2 / 2.0), 6) AS p_value  -- exact for three groups
FROM tested"""

MANOVA = f"""{RESPONSES}, centred AS (
  SELECT dwell_sec - avg(dwell_sec) OVER () AS a, arrival_hour - avg(arrival_hour) OVER () AS b,
    avg(dwell_sec) OVER (PARTITION BY site) - avg(dwell_sec) OVER () AS ga,
    avg(arrival_hour) OVER (PARTITION BY site) - avg(arrival_hour) OVER () AS gb, site
  FROM y),
s AS (
  SELECT count(*) AS n, count(DISTINCT site) AS k, sum(a * a) AS taa, sum(a * b) AS tab,
    sum(b * b) AS tbb, sum(ga * ga) AS haa, sum(ga * gb) AS hab, sum(gb * gb) AS hbb
  FROM centred),
v AS (
  SELECT n, k, (haa * tbb - 2 * hab * tab + hbb * taa) / (taa * tbb - tab * tab) AS pillai FROM s),
f AS (
  SELECT *, (2 * ((n - k - 3) / 2.0) + 3)::DOUBLE / 2 * pillai / (2 - pillai) AS approx_f,
    4::DOUBLE AS num_df, (2 * (2 * ((n - k - 3) / 2.0) + 3))::DOUBLE AS den_df FROM v),
x AS (SELECT *, den_df / (den_df + 4 * approx_f) AS t FROM f)
SELECT k - 1 AS df_between, n - k AS df_within, round(pillai, 9) AS pillai,
  round(approx_f, 6) AS approx_f, num_df, den_df,
  round(pow(t, den_df / 2) * (1 + den_df / 2 * (1 - t)), 6) AS p_value  -- exact for num_df = 4
FROM x"""

# Roots of two responses by the quadratic formula; the F tails are exact for 4 and 2 degrees of freedom.
MANOVA_TESTS = f"""{MANOVA[: MANOVA.index("v AS (")]}v AS (
  SELECT n, k, (haa * tbb - 2 * hab * tab + hbb * taa) / (taa * tbb - tab * tab) AS tr,
    (haa * hbb - hab * hab) / (taa * tbb - tab * tab) AS det FROM s),
r AS (
  SELECT *, (tr + sqrt(tr * tr - 4 * det)) / 2 AS a, (tr - sqrt(tr * tr - 4 * det)) / 2 AS b, (n - k)::DOUBLE AS e FROM v),
f AS (
  SELECT n, k, 'pillai' AS test, a + b AS statistic, (e - 3 + 3) / 2 * (a + b) / (2 - (a + b)) AS approx_f,
    4::DOUBLE AS num_df, 2 * e AS den_df FROM r
  UNION ALL SELECT n, k, 'wilks', (1 - a) * (1 - b), (1 / sqrt((1 - a) * (1 - b)) - 1) * (2 * e - 2) / 4, 4, 2 * e - 2 FROM r
  UNION ALL SELECT n, k, 'hotelling_lawley', a / (1 - a) + b / (1 - b),
    (2 * e - 4) * (a / (1 - a) + b / (1 - b)) / 8, 4, 2 * e - 4 FROM r
  UNION ALL SELECT n, k, 'roy', a / (1 - a), e * a / (1 - a) / 2, 2, e FROM r),
x AS (SELECT *, den_df / (den_df + num_df * approx_f) AS t FROM f)
SELECT test, k - 1 AS df_between, n - k AS df_within, round(statistic, 9) AS statistic, round(approx_f, 6) AS approx_f,
  num_df, den_df, round(pow(t, den_df / 2) * CASE WHEN num_df = 4 THEN 1 + den_df / 2 * (1 - t) ELSE 1 END, 6) AS p_value
FROM x"""

# Normal distribution function after Abramowitz and Stegun 26.2.17 (error below 1e-7).
_PHI = """(CASE WHEN {0} >= 0 THEN 1 ELSE 0 END + CASE WHEN {0} >= 0 THEN -1 ELSE 1 END
  * exp(-({0}) * ({0}) / 2) / sqrt(2 * pi()) * (0.319381530 * {1} - 0.356563782 * pow({1}, 2)
  + 1.781477937 * pow({1}, 3) - 1.821255978 * pow({1}, 4) + 1.330274429 * pow({1}, 5)))"""


def _phi(z: str) -> str:
    return _PHI.format(f"({z})", f"(1 / (1 + 0.2316419 * abs({z})))")


TUKEY = f"""{RESPONSES}, g AS (
  SELECT site, count(*)::DOUBLE AS n, avg(dwell_sec) AS mean, var_samp(dwell_sec) AS v
  FROM y GROUP BY site),
t AS (SELECT sum(n) - 3 AS df, sum((n - 1) * v) / (sum(n) - 3) AS mse FROM g),
pairs AS (
  SELECT b.site || '-' || a.site AS comparison, b.mean - a.mean AS diff,
    sqrt(t.mse / 2 * (1 / a.n + 1 / b.n)) AS se, t.df
  FROM g a JOIN g b ON a.site < b.site CROSS JOIN t),
q AS (SELECT *, abs(diff) / se AS q FROM pairs),
z AS (SELECT (i - 800) / 100.0::DOUBLE AS z FROM range(1601) r(i)),
s AS (
  SELECT q.comparison, 1 + (i - 300) / 300.0::DOUBLE * 9 / sqrt(2 * df) AS s
  FROM q CROSS JOIN range(601) r(i)),
scale AS (
  SELECT s.comparison, s.s, exp((df / 2) * ln(df / 2) + ln(2::DOUBLE) - lgamma(df / 2)
    + (df - 1) * ln(s.s) - df * s.s * s.s / 2) AS f
  FROM s JOIN q USING (comparison)),
inside AS (
  SELECT q.comparison, scale.s, sum(3 * 0.01 * exp(-z.z * z.z / 2) / sqrt(2 * pi())
      * pow({_phi("z.z")} - {_phi("z.z - q.q * scale.s")}, 2)) AS w
  FROM q JOIN scale USING (comparison) CROSS JOIN z GROUP BY ALL),
p AS (
  SELECT comparison, 1 - sum(f * w) / sum(f) AS p
  FROM scale JOIN inside USING (comparison, s) GROUP BY comparison),
-- The critical value: eight probabilities around it, inverted by interpolation.
trial AS (SELECT i, 3.0::DOUBLE + i * 0.1::DOUBLE AS tq FROM range(8) r(i)),
one AS (SELECT min(comparison) AS comparison FROM q),
below AS (
  SELECT t.i, t.tq, sum(scale.f * 3 * 0.01 * exp(-z.z * z.z / 2) / sqrt(2 * pi())
      * pow({_phi("z.z")} - {_phi("z.z - t.tq * scale.s")}, 2)) / any_value(total.f) AS p
  FROM trial t CROSS JOIN (SELECT * FROM scale JOIN one USING (comparison) WHERE f > 1e-18) scale
  CROSS JOIN z CROSS JOIN (SELECT sum(f) AS f FROM scale JOIN one USING (comparison)) total
  GROUP BY ALL),
critical AS (
  SELECT sum(tq * share) AS crit FROM (
    SELECT a.tq, product((0.95::DOUBLE - b.p) / (a.p - b.p)) AS share
    FROM below a JOIN below b ON a.i <> b.i GROUP BY a.i, a.tq))
SELECT comparison, round(diff, 3) AS diff, round(diff - crit * se, 1) AS lower,
  round(diff + crit * se, 1) AS upper, round(se, 3) AS std_error, round(q, 6) AS q_value,
  round(p, 4) AS p_adjusted
FROM q JOIN p USING (comparison) CROSS JOIN critical"""


def oracle_sql() -> dict[str, str]:
    v1_status = "SELECT sensor, detector, action, ts, status_code FROM coded"
    site_ref = _half_up(
        _units("(SELECT sum(usage_count) FROM usage)",
               "(SELECT count(DISTINCT weekday) FROM usage)"),
        "(SELECT count(DISTINCT site) FROM usage)", 1,
    )
    usage_ref = _half_up("(SELECT sum(usage_count) FROM usage)", "(SELECT count(*) FROM usage)")
    top_dwell = _half_up("sum(dwell_sec)", "count(*) * 60", 1)
    q = {
        "parsed_messages": f"WITH {_messages('full')} SELECT * FROM messages",
        "action_recode_v1": f"WITH {_messages('short')} "
        "SELECT fault, action, count(*) AS n FROM messages GROUP BY ALL",
        "action_category_v2": f"WITH {V2_FIELDS} "
        "SELECT detector, action, count(*) AS n FROM messages GROUP BY ALL",
        "status_v1": f"{V1} {v1_status}",
        "status_v1_post_report": f"{BATCH} {v1_status}",
        "status_v2": f"{V2} {v1_status}",
        "status_labels": f"""{V1} SELECT {SENSOR_SITE} AS site, sensor, detector, action, ts,
  CASE status_code WHEN 3 THEN '중복이벤트' WHEN 2 THEN '통신 및 기기 오류'
    WHEN 1 THEN '주기보고' ELSE '정상' END AS status FROM coded""",
        "action_counts": f"{BATCH} SELECT action, count(*) AS n FROM coded GROUP BY 1",
        "status_counts": f"{BATCH} SELECT status_code, count(*) AS n FROM coded GROUP BY 1",
        "sensor_list": f"WITH {_messages('full')} SELECT DISTINCT sensor FROM messages",
        "data_period": f"""WITH {_messages('short')} SELECT min(ts) AS first_ts, max(ts) AS last_ts,
  date_diff('day', min(ts), max(ts))::INTEGER AS days, count(DISTINCT sensor) AS n_sensors
FROM messages""",
        "error_summary_batch": _errors(BATCH, "sensor", "sensor", post_report=True),
        "error_summary_sensor": _errors(V1, "replace(sensor, '졸음쉼터', '')", "sensor"),
        "error_summary_site": _errors(V1, SENSOR_SITE, "site"),
        "error_summary_v2_site": _codes(f"{SENSOR_SITE} AS site", "ALL"),
        "error_summary_v2_sensor": _codes("sensor", "1"),
        "error_summary_v2_distinct": _codes(
            f"{SENSOR_SITE} AS site", "ALL",
            "(SELECT DISTINCT sensor, detector, ts, status_code FROM coded)",
        ),
        "error_by_sensor_ts": _codes("sensor, ts", "ALL"),
        "error_by_sensor_ts_in_range": _codes(
            "sensor, ts", "ALL", where=f"WHERE CAST(ts AS DATE) {IN_RANGE}"
        ),
        "sequence_errors_daily": f"""{BATCH} SELECT CAST(ts AS DATE) AS date, sensor, count(*) AS n
FROM coded WHERE status_code = 3 GROUP BY ALL""",
        "error_rate_site_month": f"""{BATCH} SELECT {SENSOR_SITE} AS site,
  month(ts)::INTEGER AS month, {_rate("TRUE")} AS error_rate FROM coded GROUP BY ALL""",
        "error_rate_selected_month": f"""{BATCH} SELECT sensor, month(ts)::INTEGER AS month,
  {_rate("TRUE")} AS error_rate FROM coded WHERE sensor IN {SELECTED} GROUP BY ALL""",
        "error_rate_site_month_wide": f"{BATCH} SELECT month(ts)::INTEGER AS month, "
        + ", ".join(
            [f"{_rate(f'''{SENSOR_SITE} = '{s}' ''')} AS \"{s}\"" for s in SITES]
            + [f"{_rate(f'''sensor = '{s}' ''')} AS \"{s}\"" for s in SELECTED]
        )
        + " FROM coded GROUP BY 1",
        "stays_v1": _stay_table(V1_STAYS),
        "stays_v2": _stay_table(V2_STAYS),
        "stays_v1_cut": _stay_table(_dominated(V1_STAYS)),
        "stays_v2_cut": _stay_table(_dominated(V2_STAYS)),
        "stays_v2_departures": _stay_table(V2_STAYS, "next_d = '출차'"),
        "stays_enriched": _enriched(BATCH_STAYS, THREE_WAY),
        "stays_two_day_types": _enriched("WITH " + _guarded("full") + STAYS, TWO_WAY),
        "stays_in_range": _stay_table(V1_STAYS, f"CAST(in_ts AS DATE) {IN_RANGE}"),
        "stay_summary": f"""{BATCH_STAYS}, daily AS (
  SELECT sensor, CAST(in_ts AS DATE) AS d, count(*) AS n FROM stays GROUP BY ALL),
days AS (
  SELECT sensor, {_half_up("sum(n)", "count(*)")} AS daily_mean, max(n) AS daily_max
  FROM daily GROUP BY 1),
totals AS (
  SELECT sensor, count(*) AS n_stays,
    {_half_up("sum(dwell_sec)", "count(*) * 60")} AS dwell_mean_min,
    {_half_up("max(dwell_sec)", "60")} AS dwell_max_min,
    {_half_up("min(dwell_sec)", "60", 1)} AS dwell_min_min
  FROM stays GROUP BY 1)
SELECT * FROM totals JOIN days USING (sensor)""",
        "usage_by_hour": f"{_usage(V1_STAYS, 'hour')} SELECT *, {usage_ref} AS reference FROM usage",
        "usage_by_site_hour": f"{_usage(V1_STAYS, 'site', 'hour')} SELECT *, "
        f"{_half_up('(SELECT sum(usage_count) FROM usage)', '(SELECT count(DISTINCT hour) FROM usage)')}"
        " AS reference FROM usage",
        "usage_by_weekday": f"{_usage(V1_STAYS, 'weekday')} "
        f"SELECT *, {usage_ref} AS reference, {WEEKDAY_NAME} AS weekday_name FROM usage",
        "usage_by_site_weekday": f"{_usage(V1_STAYS, 'site', 'weekday')} "
        f"SELECT *, {site_ref} AS reference, {WEEKDAY_NAME} AS weekday_name FROM usage",
        "top_sensors_count": f"""{V1_STAYS} SELECT sensor, count(*) AS usage_count FROM stays
GROUP BY 1 ORDER BY usage_count DESC, sensor LIMIT 5""",
        "peak_usage": f"""{_usage(V1_STAYS, 'hour')},
busy AS (SELECT hour FROM usage WHERE usage_count > 1.5 * (SELECT avg(usage_count) FROM usage))
SELECT {_half_up("sum(usage_count)", "count(*)")} AS mean_count, max(usage_count) AS max_count,
  (SELECT min(hour) FROM busy) AS peak_start, (SELECT max(hour) FROM busy) AS peak_end
FROM usage""",
        "dwell_by_hour": f"{_dwell(1, 'hour')} "
        f"SELECT *, {_mean_of('dwell', 'dwell_min', 1)} AS reference FROM dwell",
        "dwell_by_site_hour": f"""{_dwell(1, 'site', 'hour')}, hourly AS (
  SELECT {_half_up("sum(dwell_sec)", "count(*) * 60", 1)} AS m FROM stays GROUP BY hour(in_ts))
SELECT *, {_mean_of('hourly', 'm', 1)} AS reference FROM dwell""",
        "dwell_by_weekday": f"{_dwell(2, 'weekday')} "
        f"SELECT *, {_mean_of('dwell', 'dwell_min', 2, 1)} AS reference, "
        f"{WEEKDAY_NAME} AS weekday_name FROM dwell",
        "dwell_by_site_weekday": f"{_dwell(2, 'site', 'weekday')} "
        f"SELECT *, {WEEKDAY_NAME} AS weekday_name FROM dwell",
        "top_sensors_dwell": f"""{V1_STAYS} SELECT sensor, {top_dwell} AS dwell_min FROM stays
GROUP BY 1 ORDER BY dwell_min DESC, sensor LIMIT 5""",
        "peak_dwell": f"""{_dwell(1, 'hour')},
tenths AS (SELECT hour, round(dwell_min * 10)::BIGINT AS t FROM dwell),
marked AS (SELECT *, t * (SELECT count(*) FROM tenths) * 2 > (SELECT sum(t) FROM tenths) * 3 AS long
  FROM tenths),
longest AS (SELECT hour FROM marked ORDER BY t DESC, hour LIMIT 1)
SELECT {_units("sum(t)", "count(*)")}::DOUBLE / 10 AS mean_dwell_min,
  max(t)::DOUBLE / 10 AS max_dwell_min, (SELECT hour FROM longest) AS longest_hour,
  CASE WHEN (SELECT hour FROM longest) <= 5 THEN 0
    ELSE min(hour) FILTER (WHERE long) END AS peak_start,
  CASE WHEN (SELECT hour FROM longest) <= 5 THEN max(hour) FILTER (WHERE long AND hour <= 5)
    ELSE max(hour) FILTER (WHERE long) END AS peak_end
FROM marked""",
        "occupancy_hourly": f"{V1_CELLS} SELECT sensor, hour, occupied_sec, "
        "pct100::DOUBLE / 100 AS occupancy_pct FROM cells",
        "occupancy_hourly_v2": f"{V2_CELLS} SELECT sensor, hour, occupied_sec, "
        "pct100::DOUBLE / 100 AS occupancy_pct FROM cells",
        "occupancy_in_range": f"{V2_CELLS} SELECT sensor, hour, occupied_sec, "
        f"pct100::DOUBLE / 100 AS occupancy_pct FROM cells WHERE CAST(hour AS DATE) {IN_RANGE}",
        "occupancy_grid_dense": f"{BATCH_DENSE} SELECT * FROM dense",
        "occupancy_wide": f"{V1_CELLS} SELECT hour, "
        + ", ".join(
            f"coalesce(max(pct100::DOUBLE / 100) FILTER (WHERE sensor = '{s}'), 0) AS \"{s}\"" for s in SELECTED_SHORT
        )
        + " FROM cells GROUP BY hour",
        "occupancy_unpivot": f"""{BATCH_DENSE}
SELECT sensor, printf('h%02d', hour(hour)) AS hour_column,
  sum(occupied_sec)::DOUBLE / (count(*) * 3600)::DOUBLE AS fraction
FROM dense GROUP BY ALL""",
        "occupancy_by_hour": f"{_observed('hour')} SELECT hour, occupancy_pct, "
        f"{_mean_of('occupancy', 'occupancy_pct', 1)} AS reference FROM occupancy",
        "occupancy_by_hour_in_range": f"{_observed('hour', days=IN_RANGE)} "
        "SELECT hour, occupancy_pct FROM occupancy",
        "occupancy_by_site_hour": _observed("hour", "site") + f""", whole AS (
  SELECT hour(h.hour) AS hour, {_half_up("sum(coalesce(c.pct100, 0))", "count(*) * 100", 1)} AS v
  FROM units u CROSS JOIN hours h LEFT JOIN cells c ON c.sensor = u.sensor AND c.hour = h.hour
  GROUP BY ALL)
SELECT unit AS site, hour, occupancy_pct, {_mean_of("whole", "v", 1)} AS reference FROM occupancy""",
        "occupancy_heatmap": f"{_observed('hour', 'sensor')} "
        f"SELECT {SITE.format('unit')} AS site, unit AS sensor, hour, occupancy_pct FROM occupancy",
        "occupancy_profile_transposed": f"""{BATCH_DENSE}, profile AS (
  SELECT sensor, hour(hour) AS h, sum(occupied_sec)::DOUBLE / (count(*) * 3600)::DOUBLE AS f
  FROM dense GROUP BY ALL)
SELECT sensor, {", ".join(f"max(f) FILTER (WHERE h = {h}) AS h{h:02d}" for h in range(24))}
FROM profile GROUP BY 1""",
        "occupancy_summary_stats": f"""{BATCH_DENSE}
SELECT sensor, min(occupied_sec)::DOUBLE / 3600 AS minimum,
  round(quantile_cont(occupied_sec / 3600.0::DOUBLE, 0.25), 6) AS q1,
  round(quantile_cont(occupied_sec / 3600.0::DOUBLE, 0.5), 6) AS median,
  sum(occupied_sec)::DOUBLE / (count(*) * 3600)::DOUBLE AS mean,
  round(quantile_cont(occupied_sec / 3600.0::DOUBLE, 0.75), 6) AS q3,
  max(occupied_sec)::DOUBLE / 3600 AS maximum
FROM dense GROUP BY sensor""",
        "occupancy_by_weekday": f"{_observed('weekday')} SELECT weekday, occupancy_pct, "
        f"{_mean_of('occupancy', 'occupancy_pct', 1)} AS reference, "
        f"{WEEKDAY_NAME} AS weekday_name FROM occupancy",
        "occupancy_by_site_weekday": f"{_observed('weekday', 'site')} SELECT unit AS site, weekday, "
        f"occupancy_pct, {_mean_of('occupancy', 'occupancy_pct', 1)} AS reference, "
        f"{WEEKDAY_NAME} AS weekday_name FROM occupancy",
        "top_sensors_occupancy": f"""{V1_CELLS}, sums AS (
  SELECT sensor, sum(pct100) AS s FROM cells GROUP BY 1 ORDER BY s DESC, sensor LIMIT 5)
SELECT sensor, {_half_up("s", "(SELECT count(DISTINCT hour) FROM cells) * 100", 1)} AS occupancy_pct
FROM sums""",
        "anova_dwell_by_site": ANOVA,
        "anova_dwell_hours_by_site": ANOVA.replace(RESPONSES, FRACTIONAL)
        .replace("dwell_sec::DOUBLE", "dwell_hours").replace("arrival_hour::DOUBLE", "arrival_hours")
        .replace("'dwell_sec'", "'dwell_hours'").replace("'arrival_hour'", "'arrival_hours'"),
        "manova_dwell": MANOVA,
        "manova_tests_dwell": MANOVA_TESTS,
        "tukey_dwell": TUKEY,
    }
    tables = {
        "messages": "parsed_messages", "coded_messages": "status_v1_post_report", "error_summary": "error_summary_batch",
        "sequence_errors_daily": "sequence_errors_daily", "error_rates_monthly": "error_rate_site_month",
        "error_rates_selected": "error_rate_selected_month", "error_rates_wide": "error_rate_site_month_wide",
        "stay_summary": "stay_summary", "occupancy_profile": "occupancy_profile_transposed",
        "occupancy_summary": "occupancy_summary_stats",
    }
    for table, same in tables.items():
        q[f"table_{table}"] = q[same]
    q["table_stays"] = f"SELECT *, CAST(in_ts AS DATE) AS in_date FROM ({q['stays_enriched']})"
    q["table_occupancy"] = f"{BATCH_STAYS + CELLS} SELECT sensor, hour, occupied_sec, CAST(hour AS DATE) AS date FROM cells"
    for period in ("date", "weekday", "month"):
        mean = "(SELECT round(avg(occupancy_pct), 1) FROM by_site) AS reference"
        q[f"occupancy_site_{period}"] = f"{_sparse(period)} SELECT *, {mean} FROM by_site"
        q[f"occupancy_{period}_all"] = (
            f"{_sparse(period)} SELECT {period}, round(avg(occupancy_pct), 6) AS occupancy_pct, "
            f"{mean} FROM by_site GROUP BY 1"
        )
    for name in ("date", "hour", "weekday", "month"):
        q[f"usage_by_grain_{name}"] = f"{_usage(V2_STAYS, name)} SELECT * FROM usage"
    buckets = {
        "day": "CAST(in_ts AS DATE)",
        "month": "date_trunc('month', in_ts)::DATE",
        "half": "make_date(year(in_ts), CASE WHEN month(in_ts) <= 6 THEN 1 ELSE 7 END, 1)",
        "year": "date_trunc('year', in_ts)::DATE",
    }
    for width, bucket in buckets.items():
        rebinned = f"""{V2_CELLS}, by_site AS (
  SELECT site, {bucket.replace("in_ts", "hour")} AS period,
    sum(pct100)::DOUBLE / (count(*) * 100)::DOUBLE AS occupancy_pct
  FROM cells GROUP BY ALL)"""
        q[f"occupancy_rebinned_{width}"] = f"{rebinned} SELECT * FROM by_site"
        q[f"occupancy_rebinned_{width}_all"] = (
            f"{rebinned} SELECT period, round(avg(occupancy_pct), 6) AS occupancy_pct FROM by_site GROUP BY 1"
        )
        q[f"usage_rebinned_{width}"] = (
            f"{V2_STAYS} SELECT {bucket} AS period, count(*) AS usage_count FROM stays GROUP BY 1"
        )
    return q
