"""Profiling and dimension queries (Q01-Q25, Q31, Q33, Q34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensdq.functions import typing
from lensdq.functions.wordlists import (
    DIMENSION_HINTS, DIMENSION_WEIGHTS, FORMAT_PATTERNS, KPI_HINTS, SUSPECT_VALUES,
)
from lensdq.operators import dimensions as dim
from lensdq.operators import profile, summaries
from lensdq.plans import scan
from lensdq.operators.dependencies import dependencies
from lensdq.queries.base import AS_OF, Suite, each
from lensdq.sources.writers import scratch_path

suite = Suite()
add = suite.add

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDERS_TXT = ["o_orderstatus", "o_orderpriority"]
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GAPPY = ["l_orderkey", "line", "l_linenumber", "l_tax", "l_shipdate", "l_returnflag", "l_quantity"]


def quoted_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- Q01 column profile
_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
          "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
add(
    "q01_column_profile",
    lambda t: profile.column_profile(t.orders),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{_TYPES[c]}' AS data_type,
        CAST(count(*) - count({c}) AS BIGINT) AS null_count,
        round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct,
        CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count,
        round(CAST(count(DISTINCT {c}) * 100.0 AS DOUBLE) / count(*), 2) AS distinct_pct,
        count(DISTINCT {c}) = count(*) AS is_potential_pk,
        {'regexp_matches(' + repr(c) + ", '(_id|_key|_code|Id$|Key$|Code$)')"} AS is_potential_fk,
        """
        + (
            f"CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 4) AS mean, "
            f"round(stddev_samp({c}), 4) AS std, "
            if c in ORDERS_NUM
            else "CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, "
        )
        + (
            f"CAST(min(length({c})) AS BIGINT) AS min_length, CAST(max(length({c})) AS BIGINT) AS max_length, "
            f"round(avg(length({c})), 1) AS avg_length, "
            if c in ORDERS_TXT
            else "CAST(NULL AS BIGINT) AS min_length, CAST(NULL AS BIGINT) AS max_length, CAST(NULL AS DOUBLE) AS avg_length, "
        )
        + f"""(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {{orders}}
             ORDER BY v LIMIT 5)) AS sample_values FROM {{orders}}"""
        for c in ORDERS
    ),
)

# --- Q02 numeric profile
add(
    "q02_numeric_profile",
    lambda t: profile.numeric_profile(t.lineitem, LINE_NUM),
    each(
        LINE_NUM,
        """SELECT '@c' AS column_name, CAST(count(@c) AS BIGINT) AS n, round(avg(@c), 4) AS mean,
        round(median(@c), 4) AS median, round(stddev_samp(@c), 4) AS std, round(min(@c), 4) AS min_value,
        round(max(@c), 4) AS max_value, round(any_value(q.q25), 4) AS q25, round(any_value(q.q75), 4) AS q75,
        round(sum(@c), 2) AS total, round(skewness(@c), 3) + 0 AS skewness, round(kurtosis(@c), 3) AS kurtosis,
        CASE WHEN abs(skewness(@c)) < 0.5 AND abs(kurtosis(@c)) < 1 THEN 'approximately_normal'
             WHEN skewness(@c) > 1 THEN 'right_skewed' WHEN skewness(@c) < -1 THEN 'left_skewed'
             WHEN kurtosis(@c) > 3 THEN 'heavy_tailed' ELSE 'moderate_skew' END AS shape,
        round(any_value(q.lo), 2) AS lower_fence, round(any_value(q.hi), 2) AS upper_fence,
        CAST(count(*) FILTER (@c < q.lo OR @c > q.hi) AS BIGINT) AS outlier_count,
        round(count(*) FILTER (@c < q.lo OR @c > q.hi) * 100.0 / count(@c), 1) AS outlier_pct,
        CAST(count(*) FILTER (@c = 0) AS BIGINT) AS zero_count, CAST(count(*) FILTER (@c < 0) AS BIGINT) AS negative_count,
        round(count(*) FILTER (@c < 0) * 100.0 / count(@c), 1) AS negative_pct
        FROM {lineitem}, (SELECT q25, q75, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM
          (SELECT quantile_cont(@c, 0.25) AS q25, quantile_cont(@c, 0.75) AS q75 FROM {lineitem})) q""",
    ),
)

# --- Q03 categorical profile
add(
    "q03_categorical_profile",
    lambda t: profile.categorical_profile(t.part),
    each(
        ["p_name", "p_brand", "p_type"],
        """SELECT * FROM (SELECT '@c' AS column_name, CAST(row_number() OVER (ORDER BY n DESC, value) AS BIGINT) AS rank, value, n,
        round(n * 100.0 / sum(n) OVER (), 1) AS pct, round(max(n) OVER () * 100.0 / sum(n) OVER (), 1) AS concentration_pct,
        CASE WHEN max(n) OVER () / sum(n) OVER () > 0.9 THEN 'near_constant'
             WHEN max(n) OVER () / sum(n) OVER () > 0.5 THEN 'dominant_value' ELSE 'none' END AS flag
        FROM (SELECT @c AS value, CAST(count(*) AS BIGINT) AS n FROM {part} GROUP BY 1)) WHERE rank <= 10""",
    ),
)

# --- Q04 datetime profile
_DT = """SELECT '@c' AS column_name, strftime(min(@c), '%Y-%m-%d %H:%M:%S') AS min_date,
    strftime(max(@c), '%Y-%m-%d %H:%M:%S') AS max_date,
    CAST(floor((epoch_us(max(@c)) - epoch_us(min(@c))) / 86400000000) AS BIGINT) AS range_days,
    any_value(g.mx) > any_value(g.md) * 5 AS has_large_gaps,
    CASE WHEN any_value(g.mx) > any_value(g.md) * 5 THEN CAST(floor(any_value(g.mx) / 86400000000) AS BIGINT) END AS largest_gap_days,
    CASE WHEN floor((epoch_us(max(@c)) - epoch_us(min(@c))) / 86400000000) > 365 AND any_value(m.cv) > 0.3
         THEN 'possible_monthly_pattern' ELSE 'none' END AS seasonality_hint
    FROM {@t}, (SELECT max(d) AS mx, median(d) AS md FROM (SELECT epoch_us(@c) - lag(epoch_us(@c)) OVER (ORDER BY @c) AS d FROM {@t})) g,
    (SELECT stddev_samp(n) / avg(n) AS cv FROM (SELECT month(@c) AS mo, count(*) AS n FROM {@t} GROUP BY 1)) m"""
add(
    "q04_datetime_profile",
    lambda t: profile.datetime_profile(t.orders).unionByName(profile.datetime_profile(t.events)),
    _DT.replace("@t", "orders").replace("@c", "o_orderdate") + " UNION ALL " + _DT.replace("@t", "events").replace("@c", "ts"),
)

# --- Q05 completeness
_COMPLETE = """SELECT '@c' AS column_name, CAST(count(*) - count(@c) AS BIGINT) AS null_count,
    round(count(@c) * 100.0 / count(*), 2) AS score,
    CASE WHEN round(count(@c) * 100.0 / count(*), 2) >= 95 THEN 'PASS' WHEN round(count(@c) * 100.0 / count(*), 2) >= 80 THEN 'WARN'
         ELSE 'FAIL' END AS status FROM {gappy}"""
add("q05_completeness", lambda t: dim.completeness(t.gappy), each(GAPPY, _COMPLETE))

# --- Q06 accuracy
_ACC_NUM = """SELECT '@c' AS column_name, 'outliers' AS "check", CAST(count(@c) AS BIGINT) AS checked,
    CAST(count(*) FILTER ((q.iqr > 0 AND (@c < q.q25 - 1.5 * q.iqr OR @c > q.q75 + 1.5 * q.iqr)) OR abs(@c - q.mu) / q.sd > 3) AS BIGINT) AS flagged,
    round(100 - round(count(*) FILTER ((q.iqr > 0 AND (@c < q.q25 - 1.5 * q.iqr OR @c > q.q75 + 1.5 * q.iqr)) OR abs(@c - q.mu) / q.sd > 3)
      * 100.0 / count(@c), 2), 2) AS score
    FROM {@t}, (SELECT quantile_cont(@c, 0.25) AS q25, quantile_cont(@c, 0.75) AS q75,
      quantile_cont(@c, 0.75) - quantile_cont(@c, 0.25) AS iqr, avg(@c) AS mu, stddev_pop(@c) AS sd FROM {@t}) q"""
_ACC_TXT = f"""SELECT '@c' AS column_name, 'suspect_values' AS "check", CAST(count(@c) AS BIGINT) AS checked,
    CAST(count(*) FILTER (lower(trim(@c)) IN ({quoted_list(SUSPECT_VALUES)}) OR length(trim(@c)) <= 1) AS BIGINT) AS flagged,
    CASE WHEN count(*) FILTER (lower(trim(@c)) IN ({quoted_list(SUSPECT_VALUES)}) OR length(trim(@c)) <= 1) > 0 THEN
      round((1 - count(*) FILTER (lower(trim(@c)) IN ({quoted_list(SUSPECT_VALUES)}) OR length(trim(@c)) <= 1) / count(@c)) * 100, 2) END AS score
    FROM {{@t}}"""
_EVENT_NUM, _EVENT_TXT = ["event_id", "user_id", "value"], ["event_type", "props"]
_ACC_CONTACT = ["c_custkey", "balance"], ["email", "phone", "zip", "website", "label", "flag"]
add(
    "q06_accuracy",
    lambda t: dim.accuracy(t.events).unionByName(dim.accuracy(t.contacts)),
    " UNION ALL ".join(
        [each(_EVENT_NUM, _ACC_NUM.replace("@t", "events")), each(_EVENT_TXT, _ACC_TXT.replace("@t", "events")),
         each(_ACC_CONTACT[0], _ACC_NUM.replace("@t", "contacts")), each(_ACC_CONTACT[1], _ACC_TXT.replace("@t", "contacts"))]
    ),
)

# --- Q07 consistency
_PATTERN_COUNTS = ", ".join(
    f"count(*) FILTER (regexp_matches(@c, '{p}')) AS k{j}".replace("{", "{{").replace("}", "}}")
    for j, p in enumerate(FORMAT_PATTERNS.values())
)
_BEST = "greatest(k0, k1, k2, k3, k4)"
_CONSISTENT = (
    """SELECT '@c' AS column_name, CASE WHEN """ + _BEST + """ = 0 THEN 'mixed' """
    + " ".join(f"WHEN k{j} = {_BEST} THEN '{n}'" for j, n in enumerate(FORMAT_PATTERNS))
    + """ END AS dominant_pattern, CAST(n AS BIGINT) AS checked, round(""" + _BEST + """ * 100.0 / n, 2) < 90 AS is_issue,
    round(""" + _BEST + """ * 100.0 / n, 2) AS score FROM (SELECT count(@c) AS n, """ + _PATTERN_COUNTS + """ FROM {@t})"""
)
add(
    "q07_consistency",
    lambda t: dim.consistency(t.contacts).unionByName(dim.consistency(t.orders)).unionByName(dim.consistency(t.part)),
    " UNION ALL ".join(
        [each(_ACC_CONTACT[1], _CONSISTENT.replace("@t", "contacts")), each(ORDERS_TXT, _CONSISTENT.replace("@t", "orders")),
         each(["p_name", "p_brand", "p_type"], _CONSISTENT.replace("@t", "part"))]
    ),
)
add(
    "q07_date_order",
    lambda t: dim.date_order_issues(t.spans),
    """SELECT 'start_date' AS start_column, 'end_date' AS end_column,
       CAST(count(*) FILTER (start_date > end_date) AS BIGINT) AS bad_rows FROM {spans}""",
)

# --- Q08 timeliness
_TIME = """SELECT '@c' AS column_name, strftime(max(@c), '%Y-%m-%d %H:%M:%S') AS most_recent,
    round((epoch_us(TIMESTAMP '@now') - epoch_us(max(@c))) / 3.6e9, 1) AS staleness_hours,
    CASE WHEN (epoch_us(TIMESTAMP '@now') - epoch_us(max(@c))) / 3.6e9 <= 24 THEN 100.0::DOUBLE
         WHEN (epoch_us(TIMESTAMP '@now') - epoch_us(max(@c))) / 3.6e9 <= 72 THEN 70.0::DOUBLE ELSE 40.0::DOUBLE END AS score,
    any_value(g.big) AS gaps_detected, any_value(g.widest) AS largest_gap_seconds
    FROM {@t}, (SELECT CAST(count(*) FILTER (md > 0 AND d > 2 * md) AS BIGINT) AS big,
      round(coalesce(max(d) FILTER (md > 0 AND d > 2 * md), 0) / 1e6, 3) AS widest
      FROM (SELECT d, median(d) OVER () AS md FROM
        (SELECT epoch_us(@c) - lag(epoch_us(@c)) OVER (ORDER BY @c) AS d FROM {@t} WHERE @c IS NOT NULL))) g"""
add(
    "q08_timeliness",
    lambda t: dim.timeliness(t.events, "2024-02-01 00:00:00").unionByName(dim.timeliness(t.orders, AS_OF)),
    _TIME.replace("@t", "events").replace("@c", "ts").replace("@now", "2024-02-01 00:00:00")
    + " UNION ALL " + _TIME.replace("@t", "orders").replace("@c", "o_orderdate").replace("@now", AS_OF),
)

# --- Q09 uniqueness
add(
    "q09_uniqueness",
    lambda t: dim.uniqueness(t.gappy),
    each(
        GAPPY,
        """SELECT '@c' AS column_name, CAST(count(DISTINCT @c) AS BIGINT) AS unique_count,
        CAST(count(*) - count(DISTINCT @c) AS BIGINT) AS duplicate_count,
        round(count(DISTINCT @c) * 100.0 / count(*), 2) AS uniqueness_pct,
        count(DISTINCT @c) = count(*) AS is_potential_pk FROM {gappy}""",
    ),
)
_ROWDUP = """SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
    round(sum(n - 1) * 100.0 / sum(n), 2) AS duplicate_pct, round(100 - round(sum(n - 1) * 100.0 / sum(n), 2), 2) AS score,
    CASE WHEN 100 - round(sum(n - 1) * 100.0 / sum(n), 2) >= 99 THEN 'PASS' WHEN 100 - round(sum(n - 1) * 100.0 / sum(n), 2) >= 95
    THEN 'WARN' ELSE 'FAIL' END AS status FROM (SELECT count(*) AS n FROM {copied} GROUP BY ALL)"""
add("q09_row_duplicates", lambda t: dim.row_uniqueness(t.copied), _ROWDUP.replace("GROUP BY ALL", "GROUP BY c_nationkey, c_mktsegment, c_standing"))

# --- Q10 validity
_VAL = {
    "email": ("email_format", r"NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$')"),
    "phone": ("phone_format", r"length(regexp_replace(phone, '\D', '', 'g')) < 7"),
    "zip": ("postal_format", r"NOT regexp_matches(zip, '^\d{{4,10}}$|^\d{{5}}-\d{{4}}$|^[A-Z]\d[A-Z]\s?\d[A-Z]\d$')"),
    "website": ("url_format", "NOT regexp_matches(website, '^https?://')"),
    "label": ("whitespace_only", "trim(label) = ''"),
    "balance": ("expected_positive", "balance < 0"),
    "flag": ("whitespace_only", "trim(flag) = ''"),
}
add(
    "q10_validity",
    lambda t: dim.validity(t.contacts, AS_OF),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{rule}' AS rule, CAST(count(*) FILTER ({bad}) AS BIGINT) AS violations,
        round((1 - count(*) FILTER ({bad}) / count({c})) * 100, 2) AS score FROM {{contacts}}"""
        for c, (rule, bad) in _VAL.items()
    ),
)
add(
    "q10_validity_dates",
    lambda t: dim.validity(t.spans, "2001-10-01 00:00:00"),
    each(
        ["start_date", "end_date"],
        """SELECT '@c' AS column_name, 'date_range' AS rule,
        CAST(count(*) FILTER (@c > TIMESTAMP '2001-10-01' OR @c < TIMESTAMP '1900-01-01') AS BIGINT) AS violations,
        round((1 - count(*) FILTER (@c > TIMESTAMP '2001-10-01' OR @c < TIMESTAMP '1900-01-01') / count(@c)) * 100, 2) AS score FROM {spans}""",
    ),
)

# --- Q11-Q16, Q33: scans of contacts, copied and events, stated independently below.
_DIMS_CTE = f"""WITH per_column AS (
  {each(["c_custkey", "email", "phone", "zip", "website", "label", "balance", "flag"], "SELECT 'contacts' AS table_name, 'completeness' AS dimension, '@c' AS column_name, round(count(@c) * 100.0 / count(*), 2) AS score FROM {contacts}")}
  UNION ALL {each(["c_nationkey", "c_mktsegment", "c_standing"], "SELECT 'copied', 'completeness', '@c', round(count(@c) * 100.0 / count(*), 2) FROM {copied}")}
  UNION ALL {each(["event_id", "ts", "user_id", "event_type", "value", "props"], "SELECT 'events', 'completeness', '@c', round(count(@c) * 100.0 / count(*), 2) FROM {events}")}
  UNION ALL SELECT 'contacts', 'accuracy', column_name, score FROM ({each(_ACC_CONTACT[0], _ACC_NUM.replace("@t", "contacts"))} UNION ALL {each(_ACC_CONTACT[1], _ACC_TXT.replace("@t", "contacts"))})
  UNION ALL SELECT 'copied', 'accuracy', column_name, score FROM ({each(["c_nationkey"], _ACC_NUM.replace("@t", "copied"))} UNION ALL {each(["c_mktsegment", "c_standing"], _ACC_TXT.replace("@t", "copied"))})
  UNION ALL SELECT 'events', 'accuracy', column_name, score FROM ({each(_EVENT_NUM, _ACC_NUM.replace("@t", "events"))} UNION ALL {each(_EVENT_TXT, _ACC_TXT.replace("@t", "events"))})
  UNION ALL SELECT 'contacts', 'consistency', column_name, score FROM ({each(_ACC_CONTACT[1], _CONSISTENT.replace("@t", "contacts"))})
  UNION ALL SELECT 'copied', 'consistency', column_name, score FROM ({each(["c_mktsegment", "c_standing"], _CONSISTENT.replace("@t", "copied"))})
  UNION ALL SELECT 'events', 'consistency', column_name, score FROM ({each(_EVENT_TXT, _CONSISTENT.replace("@t", "events"))})
  UNION ALL SELECT 'events', 'timeliness', 'ts', CASE WHEN (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 3.6e9 <= 24 THEN 100.0 WHEN (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 3.6e9 <= 72 THEN 70.0 ELSE 40.0 END FROM {{events}}
  UNION ALL SELECT 'contacts', 'validity', column_name, score FROM ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, round((1 - count(*) FILTER ({bad}) / count({c})) * 100, 2) AS score FROM {{contacts}}" for c, (rule, bad) in _VAL.items())})
  UNION ALL {each(["c_mktsegment", "c_standing"], "SELECT 'copied', 'validity', '@c', round((1 - count(*) FILTER (trim(@c) = '') / count(@c)) * 100, 2) FROM {copied}")}
  UNION ALL {each(["event_type", "props"], "SELECT 'events', 'validity', '@c', round((1 - count(*) FILTER (trim(@c) = '') / count(@c)) * 100, 2) FROM {events}")}
  UNION ALL SELECT 'events', 'validity', 'ts', round((1 - count(*) FILTER (ts > TIMESTAMP '2024-02-01' OR ts < TIMESTAMP '1900-01-01') / count(ts)) * 100, 2) FROM {{events}}
), uniq AS (
  SELECT 'contacts' AS table_name, round(100 - round(sum(n - 1) * 100.0 / sum(n), 2), 2) AS score FROM (SELECT count(*) AS n FROM {{contacts}} GROUP BY c_custkey, email, phone, zip, website, label, balance, flag)
  UNION ALL SELECT 'copied', round(100 - round(sum(n - 1) * 100.0 / sum(n), 2), 2) FROM (SELECT count(*) AS n FROM {{copied}} GROUP BY c_nationkey, c_mktsegment, c_standing)
  UNION ALL SELECT 'events', round(100 - round(sum(n - 1) * 100.0 / sum(n), 2), 2) FROM (SELECT count(*) AS n FROM {{events}} GROUP BY event_id, ts, user_id, event_type, value, props)
), grid AS (
  SELECT table_name, dimension, w FROM (VALUES ('contacts'), ('copied'), ('events')) a(table_name),
    (VALUES ('completeness', 0.25::DOUBLE, 95, 80), ('accuracy', 0.20, 95, 85), ('consistency', 0.15, 95, 85), ('timeliness', 0.10, 95, 70), ('uniqueness', 0.15, 99, 95), ('validity', 0.15, 95, 85)) b(dimension, w, good, fair)
), bands AS (
  SELECT * FROM (VALUES ('completeness', 95, 80), ('accuracy', 95, 85), ('consistency', 95, 85), ('timeliness', 95, 70), ('uniqueness', 99, 95), ('validity', 95, 85)) b(dimension, good, fair)
), scored AS (
  SELECT table_name, dimension, round(avg(CAST(score AS DOUBLE)), 2) AS score FROM per_column GROUP BY ALL
  UNION ALL SELECT table_name, 'uniqueness', score FROM uniq
), dims AS (
  SELECT g.table_name, g.dimension, g.w, CAST(s.score AS DOUBLE) AS score,
    CASE WHEN s.score IS NULL THEN 'N/A' WHEN s.score >= good THEN 'PASS' WHEN s.score >= fair THEN 'WARN' ELSE 'FAIL' END AS status
  FROM grid g JOIN bands USING (dimension) LEFT JOIN scored s ON s.table_name = g.table_name AND s.dimension = g.dimension
), overall AS (
  SELECT table_name, round(sum(score * w) / sum(w) FILTER (score IS NOT NULL), 1) AS overall_score FROM dims GROUP BY 1
), recs AS (
  SELECT d.table_name, d.dimension, d.score,
    CASE WHEN d.score < 80 THEN 'CRITICAL' WHEN d.score < 90 THEN 'HIGH' WHEN d.score < 95 THEN 'MEDIUM' END AS priority,
    coalesce((SELECT string_agg(column_name, ', ' ORDER BY score, column_name) FROM (SELECT column_name, score FROM per_column p
       WHERE p.table_name = d.table_name AND p.dimension = d.dimension AND score IS NOT NULL ORDER BY score, column_name LIMIT 3)), '') AS worst_columns,
    d.dimension IN ('completeness', 'accuracy', 'consistency', 'uniqueness') AS auto_fixable
  FROM dims d WHERE d.score < 95
)
"""
SCAN_AS_OF = "2024-02-01 00:00:00"


def scanned(t) -> dict:
    return {"contacts": t.contacts, "copied": t.copied, "events": t.events}


def scan_all(t) -> scan.Scan:
    return scan.scan_tables(scanned(t), SCAN_AS_OF)


add(
    "q11_overall_score",
    lambda t: scan.scan_table(t.contacts, "contacts", SCAN_AS_OF).select("table_name", "row_count", "column_count", "overall_score"),
    _DIMS_CTE + "SELECT table_name, (SELECT CAST(count(*) AS BIGINT) FROM {contacts}) AS row_count, CAST(8 AS BIGINT) AS column_count, overall_score FROM overall WHERE table_name = 'contacts'",
)
_WIDE = ", ".join(f"max(score) FILTER (dimension = '{d}') AS {d}" for d in DIMENSION_WEIGHTS)
add(
    "q12_multi_table_scan",
    lambda t: scan_all(t).wide(),
    _DIMS_CTE + f"""SELECT d.table_name, any_value(s.row_count) AS row_count, any_value(s.column_count) AS column_count, {_WIDE},
      any_value(o.overall_score) AS overall_score,
      CASE WHEN any_value(o.overall_score) >= 90 THEN 'PASS' WHEN any_value(o.overall_score) >= 70 THEN 'WARN' ELSE 'FAIL' END AS scan_status
      FROM dims d JOIN overall o USING (table_name) JOIN (SELECT 'contacts' AS table_name, CAST(count(*) AS BIGINT) AS row_count, CAST(8 AS BIGINT) AS column_count FROM {{contacts}}
      UNION ALL SELECT 'copied', CAST(count(*) AS BIGINT), CAST(3 AS BIGINT) FROM {{copied}} UNION ALL SELECT 'events', CAST(count(*) AS BIGINT), CAST(6 AS BIGINT) FROM {{events}}) s USING (table_name)
      GROUP BY d.table_name""",
)
add(
    "q13_scorecard",
    lambda t: scan_all(t).scorecard(),
    _DIMS_CTE + f""", means AS (SELECT dimension, round(avg(score), 1) AS m FROM dims GROUP BY 1)
      SELECT (SELECT round(avg(m), 1) FROM means) AS overall_score,
      {", ".join(f"(SELECT m FROM means WHERE dimension = '{d}') AS {d}_score" for d in DIMENSION_WEIGHTS)},
      {", ".join(f"(SELECT CAST(count(*) AS BIGINT) FROM recs WHERE priority = '{p}') AS {p.lower()}_issues" for p in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))},
      (SELECT CAST(count(*) AS BIGINT) FROM recs WHERE auto_fixable) AS auto_fixable_count,
      CAST(3 AS BIGINT) AS tables_scanned, CAST(17 AS BIGINT) AS total_columns,
      CAST((SELECT count(*) FROM {{contacts}}) + (SELECT count(*) FROM {{copied}}) + (SELECT count(*) FROM {{events}}) AS BIGINT) AS total_rows""",
)
add(
    "q14_recommendations",
    lambda t: scan_all(t).recommendations().select("table_name", "priority", "dimension", "score", "worst_columns", "auto_fixable"),
    _DIMS_CTE + """SELECT table_name, priority, dimension, score,
      CASE WHEN dimension = 'uniqueness' THEN '' ELSE worst_columns END AS worst_columns, auto_fixable FROM recs""",
)
add(
    "q15_quality_gate",
    lambda t: dim.quality_gate(scan_all(t).dimensions, ["table_name"], 80, ["completeness", "uniqueness"]),
    _DIMS_CTE + """, blocked AS (SELECT table_name, coalesce(string_agg(CASE WHEN dimension IN ('completeness', 'uniqueness') AND coalesce(score, 0) < 80
        THEN dimension || ' below threshold' WHEN score < 50 THEN dimension || ' critical' END, '; ' ORDER BY dimension), '') AS b FROM dims GROUP BY 1)
      SELECT table_name, overall_score, overall_score >= 80 AND b = '' AS passed, b AS blocking_issues,
      CASE WHEN overall_score >= 80 AND b = '' THEN 'meets threshold' WHEN b <> '' THEN 'failed: ' || b ELSE 'below threshold' END AS reason
      FROM overall JOIN blocked USING (table_name)""",
)
add(
    "q16_batch_gate",
    lambda t: dim.batch_gate(scan_all(t).dimensions, "table_name", 80),
    _DIMS_CTE + """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (overall_score >= 80) AS BIGINT) AS passed,
      CAST(count(*) FILTER (overall_score < 80) AS BIGINT) AS failed, round(avg(overall_score), 1) AS avg_score,
      bool_and(overall_score >= 80) AS all_passed FROM overall""",
)
add(
    "q33_scan_status",
    lambda t: scan_all(t).overall(),
    _DIMS_CTE + """SELECT table_name, overall_score,
      CASE WHEN overall_score >= 90 THEN 'PASS' WHEN overall_score >= 70 THEN 'WARN' ELSE 'FAIL' END AS scan_status FROM overall""",
)

# --- Q17 analyst profile
_ROLE = {"l_orderkey": "measure", "line": None, "l_linenumber": None, "l_tax": "measure", "l_shipdate": "date",
         "l_returnflag": "dimension", "l_quantity": "measure"}
_ANALYST = """SELECT '@c' AS column_name, @role AS semantic_type, CAST(count(*) - count(@c) AS BIGINT) AS null_count,
    CAST(count(DISTINCT @c) AS BIGINT) AS distinct_count,
    CAST(greatest(100 - (CASE WHEN (count(*) - count(@c)) * 100.0 / count(*) > 50 THEN 40 WHEN (count(*) - count(@c)) * 100.0 / count(*) > 20 THEN 25
      WHEN (count(*) - count(@c)) * 100.0 / count(*) > 5 THEN 10 WHEN count(*) > count(@c) THEN 5 ELSE 0 END)
      - (CASE WHEN count(DISTINCT @c) <= 1 AND count(*) > 1 THEN 20 ELSE 0 END)
      - (CASE WHEN @role = 'dimension' AND count(DISTINCT @c) / count(*) > 0.95 THEN 10 ELSE 0 END), 0) AS DOUBLE) AS quality FROM {gappy}"""
_ANALYST_SQL = " UNION ALL ".join(
    _ANALYST.replace("@role", f"'{r}'" if r else "CASE WHEN count(DISTINCT @c) <= 5 THEN 'dimension' ELSE 'measure' END").replace("@c", c)
    for c, r in _ROLE.items()
)
add("q17_analyst_profile", lambda t: profile.analyst_profile(t.gappy), _ANALYST_SQL)
add(
    "q17_analyst_summary",
    lambda t: profile.analyst_summary(t.gappy),
    f"""SELECT CAST(count(*) AS BIGINT) AS column_count, round(avg(quality), 1) AS data_quality_score,
    CAST(count(*) FILTER (semantic_type = 'measure') AS BIGINT) AS measure_columns,
    CAST(count(*) FILTER (semantic_type = 'dimension') AS BIGINT) AS dimension_columns,
    CAST(count(*) FILTER (semantic_type = 'date') AS BIGINT) AS date_columns FROM ({_ANALYST_SQL})""",
)

# --- Q18 semantic typing under the five conventions
_SEM = """SELECT '@f' AS flavour, '@c' AS column_name, @rule AS semantic_type, CAST(count(DISTINCT @c) AS BIGINT) AS distinct_count,
    CAST(count(*) AS BIGINT) AS row_count FROM {part}"""
_SEM_RULES = {
    "analyst": {"p_partkey": "'measure'", "p_name": "'dimension'", "p_brand": "'dimension'", "p_type": "'dimension'",
                "p_size": "CASE WHEN count(DISTINCT p_size) <= 5 THEN 'dimension' ELSE 'measure' END", "p_retailprice": "'measure'"},
    "profiler": {c: "CASE WHEN count(DISTINCT @c) < 50 OR count(DISTINCT @c) / count(*) < 0.05 THEN 'categorical' ELSE 'text' END"
                 for c in ("p_name", "p_brand", "p_type")} | {c: "'numeric'" for c in ("p_partkey", "p_size", "p_retailprice")},
    "dashboard": {c: "CASE WHEN count(DISTINCT @c) <= 30 THEN 'categorical' WHEN count(DISTINCT @c) > count(*) * 0.8 THEN 'id_like' ELSE 'high_card' END"
                  for c in ("p_name", "p_brand", "p_type")}
    | {c: "CASE WHEN count(DISTINCT @c) > count(*) * 0.9 THEN 'id_like' ELSE 'numeric' END" for c in ("p_partkey", "p_size", "p_retailprice")},
    "chart": {c: "CASE WHEN count(DISTINCT @c) < 15 THEN 'categorical' ELSE 'unused' END" for c in ("p_name", "p_brand", "p_type")}
    | {c: "'numeric'" for c in ("p_partkey", "p_size", "p_retailprice")},
    "text": {c: "CASE WHEN avg(length(@c)) > 80 THEN 'text_long' ELSE 'text' END" for c in ("p_name", "p_brand", "p_type")}
    | {c: "'numeric'" for c in ("p_partkey", "p_size", "p_retailprice")},
}


def _all_flavours(t):
    out = None
    for f in _SEM_RULES:
        part = typing.semantic_types(t.part, f).select(F.lit(f).alias("flavour"), "*")
        out = part if out is None else out.unionByName(part)
    return out


add(
    "q18_semantic_types",
    _all_flavours,
    " UNION ALL ".join(
        _SEM.replace("@f", f).replace("@rule", rule).replace("@c", c) for f, rules in _SEM_RULES.items() for c, rule in rules.items()
    ),
)

# --- Q19 statistical profile
_STAT_NUM = """SELECT '@c' AS column_name, CAST(count(*) - count(@c) AS BIGINT) AS null_count, round((count(*) - count(@c)) * 100.0 / count(*), 2) AS null_pct,
    CAST(count(DISTINCT @c) AS BIGINT) AS distinct_count, round(count(DISTINCT @c) / count(*), 4) AS cardinality_ratio,
    round(avg(@c), 4) AS mean, round(median(@c), 4) AS median, round(stddev_samp(@c), 4) AS std, round(skewness(@c), 3) + 0 AS skewness,
    round(kurtosis(@c), 3) AS kurtosis, round(any_value(q.iqr), 4) AS iqr,
    CAST(count(*) FILTER (@c < q.lo OR @c > q.hi) AS BIGINT) AS outlier_count,
    round(count(*) FILTER (@c = 0) * 100.0 / count(@c), 2) AS zeros_pct, round(count(*) FILTER (@c < 0) * 100.0 / count(@c), 2) AS negatives_pct,
    CAST(NULL AS DOUBLE) AS entropy,
    concat_ws(',', CASE WHEN abs(round(skewness(@c), 3)) > 2 THEN 'skewed' END,
      CASE WHEN count(*) FILTER (@c < q.lo OR @c > q.hi) > count(*) * 0.05 THEN 'outliers' END,
      CASE WHEN round((count(*) - count(@c)) * 100.0 / count(*), 2) > 20 THEN 'missing' END) AS warnings
    FROM {events}, (SELECT b - a AS iqr, a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM
      (SELECT quantile_cont(@c, 0.25) AS a, quantile_cont(@c, 0.75) AS b FROM {events})) q"""
_STAT_TXT = """SELECT '@c' AS column_name, CAST(sum(n) FILTER (v IS NULL) AS BIGINT) AS null_count, 0.0::DOUBLE AS null_pct,
    CAST(count(v) AS BIGINT) AS distinct_count, round(count(v) / sum(n), 4) AS cardinality_ratio,
    @nulls, round(CAST(@ent AS DOUBLE), 4) AS entropy, CASE WHEN round(count(v) / sum(n), 4) > 0.95 THEN 'key_like' ELSE '' END AS warnings
    FROM (SELECT @c AS v, count(*) AS n FROM {events} GROUP BY 1)"""
_NULLS = ", ".join(
    f"CAST(NULL AS {'BIGINT' if c == 'outlier_count' else 'DOUBLE'}) AS {c}"
    for c in ("mean", "median", "std", "skewness", "kurtosis", "iqr", "outlier_count")
) + ", 0.0::DOUBLE AS zeros_pct, 0.0::DOUBLE AS negatives_pct"
_ENT = "-sum(n / (SELECT count(@c) FROM {events}) * ln(n / (SELECT count(@c) FROM {events})))"
_STAT_TXT = _STAT_TXT.replace("CAST(sum(n) FILTER (v IS NULL) AS BIGINT)", "CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT)")
add(
    "q19_statistical_profile",
    lambda t: profile.statistical_profile(t.events),
    " UNION ALL ".join(
        [each(["event_id", "user_id", "value"], _STAT_NUM)]
        + [_STAT_TXT.replace("@nulls", _NULLS).replace("@ent", _ENT).replace("@c", c) for c in ("event_type", "props")]
        + [_STAT_TXT.replace("@nulls", _NULLS).replace("@ent", "NULL").replace("@c", "ts")]
    ),
)

# --- Q20 normality (Jarque-Bera)
add(
    "q20_normality",
    lambda t: profile.normality(t.lineitem, LINE_NUM),
    each(
        LINE_NUM,
        """SELECT '@c' AS column_name, CAST(n AS BIGINT) AS n, round(jb, 4) AS jarque_bera, round(exp(-jb / 2), 6) AS p_value, exp(-jb / 2) > 0.05 AS is_normal
        FROM (SELECT n, n / 6.0 * (s * s + k * k / 4.0) AS jb FROM (SELECT count(@c) AS n,
          avg(pow(@c - mu, 3)) / pow(avg(pow(@c - mu, 2)), 1.5) AS s, avg(pow(@c - mu, 4)) / pow(avg(pow(@c - mu, 2)), 2) - 3 AS k
          FROM {lineitem}, (SELECT avg(@c) AS mu FROM {lineitem})))""",
    ),
)

# --- Q21 correlations
_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"),
          ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]
add(
    "q21_correlations",
    lambda t: profile.correlations(t.lineitem, LINE_NUM),
    " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(r, 4) AS r,
        CASE WHEN r > 0.7 THEN 'strong_positive' WHEN r < -0.7 THEN 'strong_negative' ELSE 'none' END AS strength,
        CASE WHEN abs(r) > 0.95 THEN 'multicollinearity' WHEN abs(r) > 0.8 THEN 'high' ELSE 'none' END AS warning
        FROM (SELECT corr({a}, {b}) AS r FROM {{lineitem}})"""
        for a, b in _PAIRS
    ),
)

# --- Q22 quality summary
add(
    "q22_quality_summary",
    lambda t: profile.quality_summary(t.copied),
    """SELECT CAST(3 * count(*) AS BIGINT) AS total_cells, CAST(0 AS BIGINT) AS total_nulls, 0.0::DOUBLE AS total_null_pct,
      CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment, c_standing FROM {copied})) AS BIGINT) AS duplicate_rows,
      round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment, c_standing FROM {copied}))) * 100.0 / count(*), 1) AS duplicate_row_pct,
      '' AS columns_with_nulls, '' AS constant_columns, '' AS high_cardinality_text FROM {copied}""",
)

# --- Q23 hierarchy detection
add(
    "q23_hierarchies",
    lambda t: profile.hierarchies(t.sales, ["o_orderpriority", "o_orderstatus", "c_mktsegment", "n_name", "r_name"]),
    " UNION ALL ".join(
        f"""SELECT '{p}' AS parent, '{c}' AS child, CAST(np AS BIGINT) AS parent_cardinality, CAST(nc AS BIGINT) AS child_cardinality FROM
        (SELECT count(DISTINCT {p}) AS np, count(DISTINCT {c}) AS nc FROM {{sales}}),
        (SELECT max(k) AS mk FROM (SELECT count(DISTINCT {p}) AS k FROM {{sales}} GROUP BY {c})) WHERE np < nc AND nc > np * 2 AND mk = 1"""
        for p in ("o_orderpriority", "o_orderstatus", "c_mktsegment", "n_name", "r_name")
        for c in ("o_orderpriority", "o_orderstatus", "c_mktsegment", "n_name", "r_name")
        if p != c
    ),
)

_FD = ("o_orderpriority", "o_orderstatus", "c_mktsegment", "n_name", "r_name", "o_orderkey")


def _determines(left, right):
    return f"(SELECT coalesce(max(k), 0) = 1 FROM (SELECT count(DISTINCT {right}) AS k FROM {{sales}} GROUP BY {', '.join(left)}))"


_FD_SINGLE = [((a,), b) for a in _FD for b in _FD if a != b]
_FD_DOUBLE = [((a, b), c) for i, a in enumerate(_FD) for b in _FD[i + 1 :] for c in _FD if c not in (a, b)]
add(
    "q23_dependencies",
    lambda t: dependencies(t.sales, list(_FD), 2).select(F.array_join("determinant", ",").alias("determinant"), "dependent"),
    " UNION ALL ".join(f"SELECT '{a[0]}' AS determinant, '{b}' AS dependent WHERE {_determines(a, b)}" for a, b in _FD_SINGLE) + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{a},{b}', '{c}' WHERE {_determines((a, b), c)} AND NOT {_determines((a,), c)} AND NOT {_determines((b,), c)}" for (a, b), c in _FD_DOUBLE if "o_orderkey" not in (a, b)),
)

# --- Q24 business signals
_KPI = "(" + " OR ".join(f"contains(s, '{w}')" for w in KPI_HINTS) + ")"
_DIMH = "(" + " OR ".join(f"contains(s, '{w}')" for w in DIMENSION_HINTS) + ")"
_LCOLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
          "l_returnflag", "l_linestatus", "l_shipdate"]
add(
    "q24_business_signals",
    lambda t: profile.business_signals(t.lineitem),
    "WITH f AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, replace('{c}', '_', ' ') AS s, {i} AS o, count(DISTINCT {c}) AS d, count(*) AS n, "
        + (f"stddev_samp({c})" if i < 8 else "NULL") + f" AS sd, {'true' if i < 8 else 'false'} AS num FROM {{lineitem}}"
        for i, c in enumerate(_LCOLS)
    ) + f""") SELECT 'kpi' AS signal, c AS column_name, CAST(d AS BIGINT) AS distinct_count FROM f WHERE num AND ({_KPI} OR (d > 20 AND sd > 0))
    UNION ALL SELECT 'dimension', c, CAST(d AS BIGINT) FROM f WHERE o IN (8, 9) AND ({_DIMH} OR d BETWEEN 2 AND 50)
    UNION ALL SELECT 'date', c, CAST(d AS BIGINT) FROM f WHERE c = 'l_shipdate'
    UNION ALL SELECT * FROM (SELECT 'id', c, CAST(d AS BIGINT) FROM f WHERE (contains(c, 'id') OR contains(c, 'key') OR contains(c, 'code')
      OR contains(c, 'number') OR contains(c, 'no')) AND d > n * 0.8 ORDER BY o LIMIT 1)""",
)
add(
    "q24_suggested_ratios",
    lambda t: profile.suggested_ratios(t.sales).withColumn("value", F.round("value", 6)),
    """SELECT 'Profit Margin %' AS name, 'profit' AS numerator, 'sales' AS denominator,
       round(sum(profit) / sum(sales) * 100, 6) AS value FROM {sales}""",
)

# --- Q25 three-sigma outliers
add(
    "q25_sigma_outliers",
    lambda t: profile.sigma_outliers(t.events),
    "SELECT * FROM (" + each(
        ["event_id", "user_id", "value"],
        """SELECT '@c' AS column_name, CAST(count(@c) AS BIGINT) AS n, CAST(count(*) FILTER (abs(@c - mu) > 3 * sd) AS BIGINT) AS outlier_count,
        round(count(*) FILTER (abs(@c - mu) > 3 * sd) * 100.0 / count(@c), 1) AS outlier_pct
        FROM {events}, (SELECT avg(@c) AS mu, stddev_samp(@c) AS sd FROM {events})""",
    ) + ") WHERE outlier_count > 0",
)

# --- Q31 describe
add(
    "q31_describe",
    lambda t: profile.describe(t.lineitem, LINE_NUM),
    each(
        LINE_NUM,
        """SELECT '@c' AS column_name, CAST(count(@c) AS BIGINT) AS n, round(avg(@c), 4) AS mean, round(stddev_samp(@c), 4) AS std,
        round(min(@c), 4) AS min_value, round(quantile_cont(@c, 0.25), 4) AS q25, round(quantile_cont(@c, 0.5), 4) AS q50,
        round(quantile_cont(@c, 0.75), 4) AS q75, round(max(@c), 4) AS max_value FROM {lineitem}""",
    ),
)


def _incremental(t):
    """The table arrives in three parts, the second one twice; only stored summaries are merged."""
    store = summaries.SummaryStore(t.spark, scratch_path(t.spark, "summaries"))
    for part in (0, 1, 2, 1):
        store.add(t.gappy.where(F.col("l_orderkey") % 3 == part), f"part={part}")
    return store.profile().select(
        "column_name", "parts", "row_count", "null_count", F.round("min_value", 4).alias("min_value"), F.round("max_value", 4).alias("max_value"), F.round("total", 2).alias("total"),
        F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "zero_count", "negative_count",
    )


_GAPPY_NUMBERS = ["l_orderkey", "line", "l_linenumber", "l_tax", "l_quantity"]
add(
    "q01_incremental_profile",
    _incremental,
    each(_GAPPY_NUMBERS, """SELECT '@c' AS column_name, CAST(3 AS BIGINT) AS parts, CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) - count(@c) AS BIGINT) AS null_count, round(min(@c)::DOUBLE, 4) AS min_value, round(max(@c)::DOUBLE, 4) AS max_value,
    round(sum(@c)::DOUBLE, 2) AS total, round(avg(@c), 4) AS mean, round(stddev_samp(@c), 4) AS std, CAST(count(*) FILTER (@c = 0) AS BIGINT) AS zero_count, CAST(count(*) FILTER (@c < 0) AS BIGINT) AS negative_count FROM {gappy}""")
    + "\nUNION ALL\n"
    + each(["l_shipdate", "l_returnflag"], "SELECT '@c', 3, count(*), count(*) - count(@c), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {gappy}"),
)
