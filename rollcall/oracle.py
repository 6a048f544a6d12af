"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark code from the written rules (FIXTURES
mapping, scorecard table, feature formulas), so a mismatch flags a bug on
either side. Table names are the driver's pre-registered views; our CTEs use
an ``r_`` prefix so they never shadow a driver table.
"""

from __future__ import annotations

from rollcall import constants as K


def _q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _case_index(expr: str, values) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


RULE_SQL = [
    ("club", f"""CASE WHEN club_activity_level = 'High' THEN 20 WHEN club_activity_level = 'Medium' THEN 6 ELSE -8 END"""),
    ("timing", f"""CASE WHEN registration_timing = 'Early' THEN 14 WHEN registration_timing = 'Late' THEN -8 ELSE 0 END"""),
    ("cgpa", f"""CASE WHEN cgpa >= 8.5 THEN 10 WHEN cgpa >= 7.0 THEN 4 WHEN cgpa < 5.5 THEN -6 ELSE 0 END"""),
    ("semester", f"""CASE WHEN semester IN (4, 5, 6) THEN 6 WHEN semester <= 2 THEN -4 WHEN semester >= 7 THEN 2 ELSE 0 END"""),
    ("speaker", f"""CASE WHEN speaker_type = 'Industry' THEN 16 WHEN speaker_type = 'Alumni' THEN 8 WHEN speaker_type = 'Student' THEN -6 ELSE 0 END"""),
    ("topic_tier", f"""CASE WHEN topic IN ({_q(K.HOT_TOPICS)}) THEN 14 WHEN topic IN ({_q(K.WARM_TOPICS)}) THEN 7 WHEN topic IN ({_q(K.MILD_TOPICS)}) THEN 2 WHEN topic IN ({_q(K.COLD_TOPICS)}) THEN -8 ELSE 0 END"""),
    ("time_slot", f"""CASE WHEN time_slot = 'Afternoon (2-4 PM)' THEN 8 WHEN time_slot = 'Evening (5-7 PM)' THEN 3 ELSE -6 END"""),
    ("exam", f"""CASE WHEN exam_proximity = 1 THEN -18 WHEN exam_proximity = 2 THEN -4 WHEN exam_proximity = 3 THEN 8 ELSE 0 END"""),
    ("mode", f"""CASE WHEN mode = 'Offline' THEN 5 ELSE -4 END"""),
    ("promotion", f"""CASE WHEN promotion_level = 'High' THEN 10 WHEN promotion_level = 'Low' THEN -8 ELSE 0 END"""),
    ("day", f"""CASE WHEN day_of_week IN ('Tuesday', 'Wednesday', 'Thursday') THEN 5 WHEN day_of_week IN ('Saturday', 'Sunday') THEN -10 WHEN day_of_week = 'Monday' THEN -4 ELSE 0 END"""),
    ("duration", f"""CASE WHEN duration_minutes > 150 THEN -8 WHEN duration_minutes > 120 THEN -3 WHEN duration_minutes <= 60 THEN 5 WHEN duration_minutes <= 90 THEN 3 ELSE 0 END"""),
    ("registrations", f"""CASE WHEN num_registrations > 90 THEN 7 WHEN num_registrations > 60 THEN 3 WHEN num_registrations < 25 THEN -5 ELSE 0 END"""),
    ("school_topic", f"""CASE WHEN (department = 'School of Technology' AND topic IN ({_q(K.SCHOOL_TOPICS['School of Technology'])})) OR (department = 'School of Design' AND topic IN ({_q(K.SCHOOL_TOPICS['School of Design'])})) OR (department = 'School of Business' AND topic IN ({_q(K.SCHOOL_TOPICS['School of Business'])})) OR (department = 'School of Music' AND topic IN ({_q(K.SCHOOL_TOPICS['School of Music'])})) THEN 10 ELSE 0 END"""),
    ("cross_school", f"""CASE WHEN topic IN ('Career Guidance', 'Entrepreneurship') THEN 5 ELSE 0 END"""),
    ("creative_coding", f"""CASE WHEN department IN ('School of Design', 'School of Music') AND topic = 'Creative Coding' THEN 6 ELSE 0 END"""),
    ("club_x_early", f"""CASE WHEN club_activity_level = 'High' AND registration_timing = 'Early' THEN 8 ELSE 0 END"""),
    ("low_late_near", f"""CASE WHEN club_activity_level = 'Low' AND registration_timing = 'Late' AND exam_proximity = 1 THEN -10 ELSE 0 END"""),
    ("industry_hot", f"""CASE WHEN speaker_type = 'Industry' AND topic IN ({_q(K.HOT_TOPICS)}) THEN 8 ELSE 0 END"""),
    ("promo_offline_afternoon", f"""CASE WHEN promotion_level = 'High' AND mode = 'Offline' AND time_slot = 'Afternoon (2-4 PM)' THEN 6 ELSE 0 END"""),
]
SCORE_SQL = "LEAST(90, GREATEST(3, 18 + " + " + ".join(r for _, r in RULE_SQL) + "))"

_STU = "'STU_' || lpad(CAST({k} AS VARCHAR), CAST(greatest(6, length(CAST({k} AS VARCHAR))) AS INTEGER), '0')"
_EVT = "'EVT_' || lpad(CAST({k} AS VARCHAR), CAST(greatest(6, length(CAST({k} AS VARCHAR))) AS INTEGER), '0')"
_EDATE = "(DATE '2024-07-15' + CAST(p_partkey * 37 % 300 AS INTEGER))"

FLAT_CTE = f"""
WITH r_students AS (
  SELECT {_STU.format(k='c_custkey')} AS student_id,
    {_case_index('c_nationkey % 4', K.DEPARTMENTS)} AS department,
    CAST(c_custkey % 8 + 1 AS INTEGER) AS semester,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Low'
         WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'Medium' ELSE 'High' END AS club_activity_level,
    CASE WHEN c_custkey % 97 = 0 THEN CAST(NULL AS DOUBLE)
         ELSE floor(300 + (c_acctbal + 1000) * 700 / 11000) / CAST(100 AS DOUBLE) END AS cgpa
  FROM customer),
r_grain AS (
  SELECT o_custkey, l_partkey, min(l_quantity) AS qty, min(o_orderpriority) AS pr
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey, l_partkey),
r_fact AS (
  SELECT {_STU.format(k='o_custkey')} AS student_id, {_EVT.format(k='l_partkey')} AS event_id,
    CASE WHEN pr = '1-URGENT' THEN 'Early' WHEN pr IN ('2-HIGH', '3-MEDIUM') THEN 'On-time' ELSE 'Late' END
      AS registration_timing,
    qty
  FROM r_grain),
r_counts AS (SELECT event_id, count(*) AS n FROM r_fact GROUP BY event_id),
r_events AS (
  SELECT {_EVT.format(k='p_partkey')} AS event_id,
    {_EDATE} AS event_date,
    {_case_index('p_size % 16', K.TOPICS)} AS topic,
    CASE WHEN p_type = 'ECONOMY' THEN 'Industry' WHEN p_type = 'LARGE' THEN 'Alumni'
         WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'Faculty' ELSE 'Student' END AS speaker_type,
    dayname({_EDATE}) AS day_of_week,
    {_case_index('p_partkey % 3', K.TIME_SLOTS)} AS time_slot,
    CAST(60 + 30 * (p_partkey % 5) AS INTEGER) AS duration_minutes,
    CASE WHEN p_partkey % 7 < 4 THEN 'Offline' ELSE 'Online' END AS mode,
    CAST(CASE WHEN p_partkey % 11 < 2 THEN 1 WHEN p_partkey % 11 < 6 THEN 2 ELSE 3 END AS INTEGER) AS exam_proximity,
    CASE WHEN p_partkey % 13 < 3 THEN 'Low' WHEN p_partkey % 13 < 9 THEN 'Medium' ELSE 'High' END AS promotion_level,
    CAST(coalesce(c.n, 0) AS BIGINT) AS num_registrations
  FROM part LEFT JOIN r_counts c ON c.event_id = {_EVT.format(k='p_partkey')}),
r_joined AS (
  SELECT f.student_id, f.event_id, f.registration_timing, s.department, s.semester, s.club_activity_level, s.cgpa,
    e.event_date, e.topic, e.speaker_type, e.day_of_week, e.time_slot, e.duration_minutes, e.mode,
    e.exam_proximity, e.promotion_level, e.num_registrations, f.qty
  FROM r_fact f JOIN r_students s ON f.student_id = s.student_id JOIN r_events e ON f.event_id = e.event_id),
r_labelled AS (
  SELECT * EXCLUDE (qty), CAST(CASE WHEN 2 * qty + 10 <= {SCORE_SQL} THEN 1 ELSE 0 END AS INTEGER) AS attended
  FROM r_joined),
r_flat AS (
  SELECT student_id, event_id, registration_timing, department, semester, club_activity_level, cgpa, event_date,
    topic, speaker_type, day_of_week, time_slot, duration_minutes, mode, exam_proximity, promotion_level,
    num_registrations, attended,
    round_even(coalesce(avg(attended) OVER (PARTITION BY student_id ORDER BY event_date, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS past_attendance_rate,
    count(attended) OVER (PARTITION BY student_id ORDER BY event_date, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past_events_count
  FROM r_labelled)
"""


def with_flat(select_sql: str) -> str:
    return FLAT_CTE + select_sql


def _ordinal(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in mapping.items())
    return f"CAST(CASE {whens} END AS INTEGER)"


def _onehot_sql() -> str:
    parts = []
    for col, values in (
        ("department", K.DEPARTMENTS),
        ("topic", K.TOPICS),
        ("speaker_type", K.SPEAKER_TYPES),
        ("time_slot", K.TIME_SLOTS),
        ("day_of_week", K.DAY_ORDER),
    ):
        for v in sorted(values)[1:]:
            name = f"{col}_{v}".replace('"', '""')
            parts.append(f"CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS \"{name}\"")
    return ",\n    ".join(parts)


_W = "PARTITION BY student_id ORDER BY event_date, event_id"
_DBL = "CAST({} AS DOUBLE)"

HISTORY_CTE = f""",
r_overall AS (
  SELECT avg(CAST(attended AS DOUBLE)) AS overall, avg(CAST(num_registrations AS DOUBLE)) AS mean_regs FROM r_flat),
r_h1 AS (
  SELECT *, row_number() OVER (w) AS rn, coalesce(attended <> lag(attended) OVER (w), true) AS chg
  FROM r_flat WINDOW w AS ({_W})),
r_h2 AS (
  SELECT *, max(CASE WHEN chg THEN rn END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM r_h1),
r_h3 AS (SELECT *, (CASE WHEN attended = 1 THEN 1 ELSE -1 END) * (rn - st + 1) AS run FROM r_h2),
r_hist AS (
  SELECT r_h3.*,
    coalesce(avg(attended) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o.overall)
      AS student_rolling_attendance,
    CAST(coalesce(sum(attended) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
      AS student_cumulative_attended,
    CAST(rn - 1 AS BIGINT) AS student_total_events,
    CAST(coalesce(lag(run) OVER ({_W}), 0) AS BIGINT) AS attendance_streak,
    coalesce(stddev_samp(attended) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5)
      AS student_attendance_std,
    coalesce(avg(attended) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), o.overall) AS student_recent_3_rate,
    o.mean_regs
  FROM r_h3 CROSS JOIN r_overall o)"""

_RATE_CTES = "".join(
    f",\nr_rate_{c} AS (SELECT {c} AS k, avg(CAST(attended AS DOUBLE)) AS rate FROM r_flat GROUP BY {c})"
    for c in ["topic", "speaker_type", "department", "time_slot", "day_of_week"]
)

FEATURES_CTE = HISTORY_CTE + _RATE_CTES + f""",
r_pop AS (
  SELECT h.*,
    CAST(month(event_date) AS INTEGER) AS month,
    CASE WHEN day_of_week IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS is_weekend,
    CAST(greatest(1, date_diff('day', make_date(year(event_date), CASE WHEN month(event_date) >= 8 THEN 8 ELSE 1 END, 1),
         event_date) // 7 + 1) AS INTEGER) AS semester_week,
    CASE WHEN cgpa >= 8.0 THEN 1 ELSE 0 END AS cgpa_band_high,
    CASE WHEN cgpa < 6.0 THEN 1 ELSE 0 END AS cgpa_band_low,
    rt.rate AS topic_popularity, rs.rate AS speaker_pull, rd.rate AS dept_engagement,
    rl.rate AS timeslot_popularity, ry.rate AS day_popularity,
    num_registrations / mean_regs AS registration_density,
    CASE WHEN exam_proximity = 1 THEN 1 ELSE 0 END AS exam_is_near,
    CASE WHEN duration_minutes > 120 THEN 1 ELSE 0 END AS is_long_workshop,
    {_ordinal('club_activity_level', K.LEVEL_CODE)} AS club_activity_numeric,
    CASE WHEN (department = 'School of Technology' AND topic IN ({_q(K.SCHOOL_TOPICS['School of Technology'])}))
           OR (department = 'School of Design' AND topic IN ({_q(K.SCHOOL_TOPICS['School of Design'])}))
           OR (department = 'School of Business' AND topic IN ({_q(K.SCHOOL_TOPICS['School of Business'])}))
           OR (department = 'School of Music' AND topic IN ({_q(K.SCHOOL_TOPICS['School of Music'])}))
         THEN 1 ELSE 0 END AS dept_topic_match,
    {_ordinal('registration_timing', K.TIMING_CODE)} AS reg_timing_numeric,
    {_ordinal('registration_timing', K.TIMING_CODE)} AS registration_timing_encoded,
    {_ordinal('promotion_level', K.LEVEL_CODE)} AS promotion_level_encoded,
    {_ordinal('mode', K.MODE_CODE)} AS mode_encoded
  FROM r_hist h
  LEFT JOIN r_rate_topic rt ON h.topic = rt.k
  LEFT JOIN r_rate_speaker_type rs ON h.speaker_type = rs.k
  LEFT JOIN r_rate_department rd ON h.department = rd.k
  LEFT JOIN r_rate_time_slot rl ON h.time_slot = rl.k
  LEFT JOIN r_rate_day_of_week ry ON h.day_of_week = ry.k),
r_int AS (
  SELECT *,
    CASE WHEN promotion_level = 'High' THEN 1 ELSE 0 END * topic_popularity AS high_promo_popular_topic,
    student_rolling_attendance * club_activity_numeric AS student_engagement_score,
    cgpa / CAST(10 AS DOUBLE) * 0.3e0 + club_activity_numeric / CAST(3 AS DOUBLE) * 0.3e0
      + student_rolling_attendance * 0.4e0 AS student_quality_score,
    speaker_pull * 0.35e0 + topic_popularity * 0.35e0 + timeslot_popularity * 0.15e0 + day_popularity * 0.15e0
      AS event_attractiveness,
    exam_is_near * (3 - club_activity_numeric) AS exam_pressure,
    reg_timing_numeric * registration_density AS registration_commitment
  FROM r_pop),
r_features AS (
  SELECT *,
    student_quality_score * event_attractiveness AS combined_quality_attract,
    student_recent_3_rate * event_attractiveness AS recent_att_x_event,
    {_onehot_sql()}
  FROM r_int)
"""


def with_features(select_sql: str) -> str:
    return FLAT_CTE + FEATURES_CTE + select_sql
