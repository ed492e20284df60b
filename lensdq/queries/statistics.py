"""Statistics, drift, repair (D01-D16) and ordered calculations (W01-W13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensdq.operators import observe, present, remediate, stats, windows
from lensdq.queries.base import Suite, each

suite = Suite()
add = suite.add

MONEY = ["o_totalprice", "o_custkey"]
add(
    "d01_benford",
    lambda t: stats.benford(t.orders, MONEY).unionByName(stats.benford(t.events, ["value"])),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(n AS BIGINT) AS n, round(x, 4) AS chi2, round(exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6), 6) AS p_value,
        exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6) > 0.05 AS conforms FROM (
          SELECT any_value(n) AS n, sum(pow(coalesce(o, 0) - log10(1 + 1.0 / d) * n, 2) / (log10(1 + 1.0 / d) * n)) AS x
          FROM range(1, 10) r(d) LEFT JOIN (SELECT CAST(regexp_extract(CAST({c} AS VARCHAR), '[1-9]') AS BIGINT) AS d, count(*) AS o FROM {{{tab}}} WHERE {c} > 0 GROUP BY 1) USING (d),
          (SELECT count(*) AS n FROM {{{tab}}} WHERE {c} > 0))"""
        for tab, c in (("orders", "o_totalprice"), ("orders", "o_custkey"), ("events", "value"))
    ),
)
_DAILY = "SELECT CAST(ts AS DATE) AS d, round(sum(value), 4) AS v FROM {events} GROUP BY 1"
_LIM = "lim AS (SELECT avg(v) AS mu, stddev_samp(v) AS sd FROM daily)"


def daily(t):
    return t.sql(_DAILY)


def all_points(t):
    """Every event as its own point, in time order."""
    return t.sql("SELECT ts, event_id, value FROM {events}")


def rules_sql(points: str, order: str) -> str:
    return f"""p AS (SELECT {order}, v, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM {points}), f AS (SELECT avg(v) AS mu, stddev_samp(v) AS sd FROM p),
    q AS (SELECT p.*, mu, sd, v - lag(v) OVER (ORDER BY pos) AS dv FROM p, f),
    w AS (SELECT *, sum(CASE WHEN v > mu THEN 1 ELSE 0 END) OVER w9 AS up9, sum(CASE WHEN v < mu THEN 1 ELSE 0 END) OVER w9 AS dn9,
      sum(CASE WHEN dv > 0 THEN 1 ELSE 0 END) OVER w5 AS up5, sum(CASE WHEN dv < 0 THEN 1 ELSE 0 END) OVER w5 AS dn5,
      sum(CASE WHEN abs(v - mu) > 2 * sd THEN 1 ELSE 0 END) OVER w3 AS far3 FROM q
      WINDOW w9 AS (ORDER BY pos ROWS 8 PRECEDING), w5 AS (ORDER BY pos ROWS 4 PRECEDING), w3 AS (ORDER BY pos ROWS 2 PRECEDING)),
    viol AS (SELECT pos, v, 1 AS rule FROM w WHERE v > mu + 3 * sd OR v < mu - 3 * sd UNION ALL SELECT pos, v, 2 FROM w WHERE up9 = 9 OR dn9 = 9
      UNION ALL SELECT pos, v, 3 FROM w WHERE up5 = 5 OR dn5 = 5 UNION ALL SELECT pos, v, 4 FROM w WHERE pos >= 2 AND far3 >= 2)"""


_POINTS = "(SELECT ts, event_id, value AS v FROM {events})"
add(
    "d02_spc_report",
    lambda t: stats.spc_report(daily(t), ["d"], "v", usl=30000.0, lsl=5000.0),
    "WITH daily AS (" + _DAILY + "), " + rules_sql("daily", "d") + """ SELECT (SELECT CAST(count(*) AS BIGINT) FROM daily) AS n, round(mu, 4) AS mean, round(sd, 4) AS std, round(mu + 3 * sd, 4) AS ucl, round(mu - 3 * sd, 4) AS lcl,
      round(mu + 2 * sd, 4) AS uwl, round(mu - 2 * sd, 4) AS lwl, round(least((30000 - mu) / (3 * sd), (mu - 5000) / (3 * sd)), 4) AS cpk,
      round(least((30000 - mu) / (3 * sd), (mu - 5000) / (3 * sd)) * 3, 4) AS sigma_level,
      (SELECT CAST(count(*) AS BIGINT) FROM viol) AS violation_count, (SELECT count(*) FROM viol WHERE rule = 1) = 0 AS process_stable FROM f""",
)
for n, label in enumerate(("beyond_limits", "one_side", "monotone", "two_of_three"), start=1):
    add(
        f"w0{n}_spc_{label}",
        lambda t, n=n: stats.spc_violations(all_points(t), ["ts", "event_id"], "value", chunk=700).where(F.col("rule") == n).select("pos", F.col("x").alias("v")),
        "WITH " + rules_sql(_POINTS, "ts, event_id") + f" SELECT pos, v FROM viol WHERE rule = {n}",
    )

# Reference and current: the first 80% of events by time against the rest.
EV_NUM = ["value", "user_id"]
_SPLIT = "WITH ev AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS total FROM {events}), ref AS (SELECT * FROM ev WHERE pos < floor(total * 0.8)), cur AS (SELECT * FROM ev WHERE pos >= floor(total * 0.8))"


def halves(t):
    return stats.split_by_time(t.events, ["ts", "event_id"])


def psi_numeric_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, sum((cs - rs) * ln(cs / rs)) AS psi, any_value(rm) AS rm, any_value(cm) AS cm FROM (
      SELECT b, coalesce(rn, 0) / rt + 1e-6 AS rs, coalesce(cn, 0) / ct + 1e-6 AS cs, rm, cm FROM range(0, 10) g(b)
      LEFT JOIN (SELECT least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS b, count(*) AS rn FROM ref, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM ref) GROUP BY 1) r USING (b)
      LEFT JOIN (SELECT least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS b, count(*) AS cn FROM cur, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM ref) WHERE {c} BETWEEN lo AND hi GROUP BY 1) c USING (b),
      (SELECT count(*) AS rt, avg({c}) AS rm FROM ref), (SELECT count(*) AS ct, avg({c}) AS cm FROM cur))"""


_BAND = "CASE WHEN psi >= 0.2 THEN 'critical' WHEN psi >= 0.1 THEN 'warning' ELSE 'stable' END AS severity"


def _psi_numeric(t):
    ref, cur = halves(t)
    return stats.numeric_psi(ref, cur, EV_NUM)


add(
    "d03_psi_numeric",
    _psi_numeric,
    _SPLIT + " SELECT column_name, round(psi, 4) AS psi, round(rm, 4) AS ref_mean, round(cm, 4) AS cur_mean, round(abs(cm - rm) / greatest(abs(rm), 1e-6) * 100, 2) AS mean_shift_pct, "
    + _BAND + " FROM (" + " UNION ALL ".join(psi_numeric_sql(c) for c in EV_NUM) + ")",
)


def ks_sql(c: str) -> str:
    return f"""(SELECT max(abs(cr / nr - cc / nc)) AS d, any_value(nr) AS nr, any_value(nc) AS nc FROM (
      SELECT v, sum(sum(r)) OVER (ORDER BY v) AS cr, sum(sum(c)) OVER (ORDER BY v) AS cc, (SELECT count(*) FROM ref) AS nr, (SELECT count(*) FROM cur) AS nc
      FROM (SELECT {c} AS v, 1 AS r, 0 AS c FROM ref UNION ALL SELECT {c}, 0, 1 FROM cur) GROUP BY v))"""


_KSP = """CASE WHEN d * sqrt(nr * nc / (nr + nc)) < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101),
    lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * d * d * nr * nc / (nr + nc)))), 0), 1) END"""


def _ks(t):
    ref, cur = halves(t)
    return stats.ks_two_sample(ref, "value", cur)


add(
    "d04_ks_two_sample",
    _ks,
    _SPLIT + f" SELECT CAST(nr AS BIGINT) AS ref_n, CAST(nc AS BIGINT) AS cur_n, round(d, 6) AS ks_stat, round(CAST({_KSP} AS DOUBLE), 6) AS p_value FROM {ks_sql('value')}",
)


def psi_cat_sql(c: str, ref: str = "ref", cur: str = "cur", rc: str | None = None) -> str:
    return f"""SELECT '{c}' AS column_name, sum((cs - rs) * ln(cs / rs)) AS psi,
      sum(pow(cs * ct - rs / rsum * csum * ct, 2) / (rs / rsum * csum * ct)) AS chi2, count(*) - 1 AS dof,
      count(*) FILTER (rn IS NULL) AS nw, count(*) FILTER (cn IS NULL) AS ms FROM (
      SELECT *, sum(rs) OVER () AS rsum, sum(cs) OVER () AS csum FROM (SELECT rn, cn, ct, coalesce(rn / rt, 1e-6) AS rs, coalesce(cn / ct, 1e-6) AS cs
      FROM (SELECT {rc or c} AS v, count(*) AS rn FROM {ref} GROUP BY 1) FULL JOIN (SELECT {c} AS v, count(*) AS cn FROM {cur} GROUP BY 1) USING (v),
      (SELECT count(*) AS rt FROM {ref}), (SELECT count(*) AS ct FROM {cur})))"""


def _cat_psi(t):
    base = t.customer.select(F.col("c_mktsegment").alias("segment"))
    return stats.chi_square_p(stats.categorical_psi(base, t.customer_next, ["segment"]))


# Upper tail of the chi-square law; the odd case adds to the complementary error function, which is 0 here.
_H = "(round(chi2, 4) / 2)"
_CHI_P = f"""round(CAST(CASE WHEN dof % 2 = 0 THEN list_sum(list_transform(range(0, CAST(dof / 2 AS BIGINT)), lambda i: exp(i * ln({_H}) - {_H} - lgamma(i + 1))))
  ELSE (CASE WHEN {_H} > 400 THEN 0.0 END) + list_sum(list_transform(range(1, CAST((dof + 1) / 2 AS BIGINT)), lambda i: exp((i - 0.5) * ln({_H}) - {_H} - lgamma(i + 0.5)))) END AS DOUBLE), 6)"""

add(
    "d05_psi_categorical",
    _cat_psi,
    "SELECT column_name, round(psi, 4) AS psi, round(chi2, 4) AS chi2, CAST(dof AS BIGINT) AS dof, CAST(nw AS BIGINT) AS new_categories, CAST(ms AS BIGINT) AS missing_categories, "
    + _CHI_P + " AS p_value, " + _BAND + " FROM (" + psi_cat_sql("segment", "(SELECT c_mktsegment AS segment FROM {customer})", "{customer_next}") + ")",
)


def _drift(t):
    ref, cur = halves(t)
    return stats.drift_summary(stats.drift_report(ref, cur, ["value", "user_id", "event_type"]))


add(
    "d06_drift_summary",
    _drift,
    _SPLIT + ", rep AS (" + " UNION ALL ".join(
        f"SELECT psi, psi >= 0.2 OR (SELECT round(CAST({_KSP} AS DOUBLE), 6) FROM {ks_sql(c)}) < 0.05 AS dr FROM ({psi_numeric_sql(c)})" for c in EV_NUM
    ) + " UNION ALL SELECT psi, psi >= 0.2 FROM (" + psi_cat_sql("event_type") + """))
    SELECT CAST(count(*) AS BIGINT) AS columns_checked, CAST(count(*) FILTER (dr) AS BIGINT) AS drifted_columns, round(avg(round(psi, 4)), 4) AS overall_psi,
    CASE WHEN avg(round(psi, 4)) >= 0.2 THEN 'CRITICAL' WHEN avg(round(psi, 4)) >= 0.1 THEN 'WARNING' ELSE 'STABLE' END AS verdict,
    round(count(*) FILTER (dr) * 100.0 / count(*), 1) AS drift_pct FROM rep""",
)

# --- baselines: customer against its derived next snapshot
_OLD = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
_NEW = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "c_acctbal": "double", "segment": "string"}


def snap_sql(table: str, types: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS c, '{ty}' AS ty, count(*) - count({c}) AS nn FROM {{{table}}}" for c, ty in types.items())


_SCHEMA_DRIFT = f"""WITH o AS ({snap_sql("customer", _OLD)}), n AS ({snap_sql("customer_next", _NEW)}),
  j AS (SELECT coalesce(o.c, n.c) AS column_name, CASE WHEN o.ty IS NULL THEN 'new' WHEN n.ty IS NULL THEN 'removed' WHEN o.ty <> n.ty THEN 'type_changed'
    WHEN (o.nn > 0) <> (n.nn > 0) THEN 'nullability_changed' END AS change, o.ty AS old_type, n.ty AS new_type FROM o FULL JOIN n ON o.c = n.c),
  sd AS (SELECT *, CASE WHEN change IN ('removed', 'type_changed') THEN 'CRITICAL' WHEN change = 'new' THEN 'WARN' ELSE 'OK' END AS severity FROM j WHERE change IS NOT NULL)"""


def _schema_drift(t):
    return observe.schema_drift(observe.schema_snapshot(t.customer), observe.schema_snapshot(t.customer_next))


def _volume(t):
    return observe.volume_anomaly(t.customer_next, t.customer.agg(F.count(F.lit(1)).alias("row_count")), (1, 10**12))


add("d07_schema_drift", _schema_drift, _SCHEMA_DRIFT + " SELECT * FROM sd")
_VOLUME = """SELECT c AS current_rows, p AS previous_rows, round((c - p) * 100.0 / p, 1) AS change_pct,
  CASE WHEN abs(round((c - p) * 100.0 / p, 1)) > 50 THEN 'CRITICAL' WHEN abs(round((c - p) * 100.0 / p, 1)) > 20 THEN 'WARN' ELSE 'OK' END AS severity,
  abs(round((c - p) * 100.0 / p, 1)) > 20 AS is_anomaly FROM (SELECT CAST(count(*) AS BIGINT) AS c FROM {customer_next}), (SELECT CAST(count(*) AS BIGINT) AS p FROM {customer})"""
add("d08_volume_anomaly", _volume, _VOLUME)
add(
    "d09_numeric_baseline",
    lambda t: observe.numeric_baseline(t.customer),
    each(
        ["c_custkey", "c_nationkey", "c_acctbal"],
        """SELECT '@c' AS column_name, CAST(count(@c) AS BIGINT) AS n, round(avg(@c), 4) AS mean, round(stddev_samp(@c), 4) AS std, round(min(@c)::DOUBLE, 4) AS min_value,
        round(max(@c)::DOUBLE, 4) AS max_value, round(quantile_cont(@c, 0.25)::DOUBLE, 4) AS q25, round(quantile_cont(@c, 0.5)::DOUBLE, 4) AS q50, round(quantile_cont(@c, 0.75)::DOUBLE, 4) AS q75 FROM {customer}""",
    ),
)
add(
    "d09_categorical_baseline",
    lambda t: observe.top_categories(observe.categorical_baseline(t.customer)),
    each(
        ["c_name", "c_mktsegment"],
        """SELECT '@c' AS column_name, rank, value, n, rank = 1 AS is_dominant FROM (SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS BIGINT) AS rank
        FROM (SELECT @c AS value, CAST(count(*) AS BIGINT) AS n FROM {customer} GROUP BY 1)) WHERE rank <= 20""",
    ),
)
def _stored_baseline(t):
    """A baseline written, read back and compared with the next snapshot: all values take part."""
    from lensdq.sources.writers import scratch_path

    path = scratch_path(t.spark, "baseline")
    observe.store_baseline(t.customer, path, "customer", "2024-01-01")
    kept = t.spark.read.parquet(f"{path}/categorical").where("table_name = 'customer' AND snapshot_ts = '2024-01-01'")
    now = t.customer_next.select("c_name", F.col("segment").alias("c_mktsegment"))
    return observe.categorical_drift(now, kept)


_STORED = """SELECT '@b' AS column_name, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT @a FROM {customer_next} EXCEPT SELECT @b FROM {customer})) AS new_categories,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT @b FROM {customer} EXCEPT SELECT @a FROM {customer_next})) AS removed_categories,
  (SELECT @b FROM {customer} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) <> (SELECT @a FROM {customer_next} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_changed"""
add(
    "d09_stored_baseline_drift",
    _stored_baseline,
    "SELECT *, new_categories > 0 OR removed_categories > 0 OR dominant_changed AS drifted, CASE WHEN new_categories > 0 OR removed_categories > 0 OR dominant_changed THEN 50.0 ELSE 100.0 END::DOUBLE AS score FROM ("
    + " UNION ALL ".join(_STORED.replace("@a", a).replace("@b", b) for a, b in (("c_name", "c_name"), ("segment", "c_mktsegment"))) + ")",
)
_PHI = "0.5 * (1 + sign({z}) * (1 - (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * (0.254829592 + (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * (1.421413741 + (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * 1.061405429)))) * exp(-{z} * {z} / 2)))"


def ks_normal_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, d, n FROM (SELECT max(greatest(abs(cum / n - phi), abs((cum - k) / n - phi))) AS d, any_value(n) AS n FROM (
      SELECT k, cum, n, {_PHI.format(z='z')} AS phi FROM (SELECT k, sum(k) OVER (ORDER BY v) AS cum, sum(k) OVER () AS n, (v - mu) / sd AS z FROM
      (SELECT {c} AS v, count(*) AS k FROM {{customer_next}} WHERE {c} IS NOT NULL GROUP BY 1), (SELECT round(avg({c}), 4) AS mu, round(stddev_samp({c}), 4) AS sd FROM {{customer}}))))"""


_NUM_DRIFT = "nd AS (SELECT column_name, round(d, 4) AS ks_stat, round(CAST(CASE WHEN d * sqrt(n) < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * d * d * n))), 0), 1) END AS DOUBLE), 6) AS p_value FROM (" + " UNION ALL ".join(
    ks_normal_sql(c) for c in ("c_custkey", "c_nationkey", "c_acctbal")
) + "))"


def _numeric_drift(t):
    return observe.numeric_drift(t.customer_next, observe.numeric_baseline(t.customer))


def _categorical_drift(t):
    now = t.customer_next.select("c_name", F.col("segment").alias("c_mktsegment"))
    return observe.categorical_drift(now, observe.categorical_baseline(t.customer, ["c_mktsegment"]))


add(
    "d10_numeric_drift",
    lambda t: _numeric_drift(t),
    "WITH " + _NUM_DRIFT + " SELECT column_name, ks_stat, p_value, p_value < 0.05 AS drifted, CASE WHEN p_value < 0.05 THEN p_value * 100 ELSE 100.0 END::DOUBLE AS score FROM nd",
)
_CAT_DRIFT = """cd AS (SELECT 'c_mktsegment' AS column_name,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT segment FROM {customer_next} EXCEPT SELECT c_mktsegment FROM {customer})) AS new_categories,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT c_mktsegment FROM {customer} EXCEPT SELECT segment FROM {customer_next})) AS removed_categories,
  (SELECT c_mktsegment FROM {customer} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) <> (SELECT segment FROM {customer_next} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_changed)"""
add(
    "d10_categorical_drift",
    _categorical_drift,
    "WITH " + _CAT_DRIFT + """ SELECT *, new_categories > 0 OR removed_categories > 0 OR dominant_changed AS drifted,
      CASE WHEN new_categories > 0 OR removed_categories > 0 OR dominant_changed THEN 50.0 ELSE 100.0 END::DOUBLE AS score FROM cd""",
)


def _observability(t):
    summary = observe.distribution_summary(_numeric_drift(t), _categorical_drift(t))
    return observe.observability_report("customer", _schema_drift(t), _volume(t), summary)


add(
    "d11_observability_report",
    _observability,
    _SCHEMA_DRIFT + ", " + _NUM_DRIFT + ", " + _CAT_DRIFT + f""", vo AS ({_VOLUME}),
    both_ AS (SELECT p_value < 0.05 AS dr, CASE WHEN p_value < 0.05 THEN p_value * 100 ELSE 100.0 END AS sc FROM nd UNION ALL
      SELECT new_categories > 0 OR removed_categories > 0 OR dominant_changed, CASE WHEN new_categories > 0 OR removed_categories > 0 OR dominant_changed THEN 50.0 ELSE 100.0 END FROM cd),
    s AS (SELECT CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(severity = 'WARN') THEN 'WARN' ELSE 'OK' END AS ss FROM sd),
    d AS (SELECT CAST(count(*) FILTER (dr) AS BIGINT) AS dc, round(avg(sc)::DOUBLE, 1) AS ds FROM both_)
    SELECT 'customer' AS table_name, CASE WHEN ss = 'CRITICAL' OR severity = 'CRITICAL' THEN 'CRITICAL' WHEN ss = 'WARN' OR severity = 'WARN' OR dc > 0 THEN 'WARN' ELSE 'HEALTHY' END AS health_status,
      ss AS schema_severity, severity AS volume_severity, change_pct, dc AS drifted_columns, ds AS overall_drift_score FROM s, vo, d""",
)

# --- repairs
_GAPS = """SELECT c_custkey, nullif(c_nationkey, 4) AS c_nationkey, CASE WHEN c_nationkey > 20 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_nationkey = 3 THEN concat(' ', c_mktsegment, ' ') ELSE c_mktsegment END AS c_mktsegment FROM {customer}"""
_SKEWED = "SELECT o_orderkey, o_totalprice * o_totalprice / 1e6 AS squared, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 10 ELSE o_totalprice END AS boosted FROM {orders}"
add("d12_deduplicate", lambda t: remediate.deduplicate(t.copied), "SELECT DISTINCT c_nationkey, c_mktsegment, c_standing FROM {copied}")
add(
    "d13_impute",
    lambda t: remediate.impute(t.sql(_GAPS)).withColumn("c_nationkey", F.col("c_nationkey").cast("double")),
    "WITH g AS (" + _GAPS + """) SELECT c_custkey, CAST(coalesce(c_nationkey, (SELECT median(c_nationkey) FROM g)) AS DOUBLE) AS c_nationkey,
      coalesce(c_acctbal, (SELECT median(c_acctbal) FROM g)) AS c_acctbal, coalesce(c_mktsegment, 'Unknown') AS c_mktsegment FROM g""",
)
add("d14_trim_labels", lambda t: remediate.trim_labels(t.sql(_GAPS)), "WITH g AS (" + _GAPS + ") SELECT c_custkey, c_nationkey, c_acctbal, trim(c_mktsegment) AS c_mktsegment FROM g")
_FENCE = "(SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM g))"
add(
    "d15_clip_outliers",
    lambda t: remediate.clip_outliers(t.sql(_SKEWED)).select(F.col("o_orderkey").cast("bigint"), F.round("squared", 4).alias("squared"), F.round("boosted", 4).alias("boosted")),
    "WITH g AS (" + _SKEWED + ") SELECT o_orderkey, round(least(greatest(squared, s.lo), s.hi), 4) AS squared, round(least(greatest(boosted, b.lo), b.hi), 4) AS boosted FROM g, "
    + _FENCE.replace("{c}", "squared") + " s, " + _FENCE.replace("{c}", "boosted") + " b",
)


def _log(t):
    dedup = remediate.change_log(t.copied).withColumn("source", F.lit("copied"))
    gaps = remediate.change_log(t.sql(_GAPS)).withColumn("source", F.lit("gaps"))
    return dedup.unionByName(gaps)


add(
    "d16_change_log",
    _log,
    "WITH g AS (" + _GAPS + """), l AS (SELECT 'dedup' AS action, '(all)' AS column_name, count(*) - (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment, c_standing FROM {copied})) AS n, 'copied' AS source FROM {copied}
    UNION ALL SELECT 'imputation', 'c_nationkey', count(*) - count(c_nationkey), 'gaps' FROM g UNION ALL SELECT 'imputation', 'c_acctbal', count(*) - count(c_acctbal), 'gaps' FROM g
    UNION ALL SELECT 'imputation', 'c_mktsegment', count(*) - count(c_mktsegment), 'gaps' FROM g UNION ALL SELECT 'format_standardize', 'c_mktsegment', count(*) FILTER (c_mktsegment <> trim(c_mktsegment)), 'gaps' FROM g)
    SELECT action, column_name, CAST(n AS BIGINT) AS rows_affected, source FROM l WHERE n > 0""",
)

# --- ordered calculations
add(
    "w05_early_late_trend",
    lambda t: windows.early_late_trend(t.orders, ["o_orderdate", "o_orderkey"], "o_totalprice")
    .unionByName(windows.early_late_trend(t.events, ["ts", "event_id"], "value", share=0.25, use="avg")),
    " UNION ALL ".join(
        f"""SELECT CAST(n AS BIGINT) AS n, round(a, 4) AS first_value, round(b, 4) AS last_value, round((b - a) / abs(a) * 100, 2) AS pct_change,
        CASE WHEN (b - a) / abs(a) * 100 > 5 THEN 'upward' WHEN (b - a) / abs(a) * 100 < -5 THEN 'downward' ELSE 'stable' END AS trend FROM (
        SELECT any_value(n) AS n, {fn}(x) FILTER (pos < floor(n * {share})) AS a, {fn}(x) FILTER (pos >= n - floor(n * {share})) AS b
        FROM (SELECT {x} AS x, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n FROM {{{tab}}}))"""
        for tab, x, order, share, fn in (("orders", "o_totalprice", "o_orderdate, o_orderkey", 0.1, "sum"), ("events", "value", "ts, event_id", 0.25, "avg"))
    ),
)
add(
    "w06_series_change",
    lambda t: windows.series_change(present.time_aggregate(t.orders, "o_orderdate", "o_totalprice")),
    """WITH s AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS p, round(sum(o_totalprice), 2) AS y FROM {orders} GROUP BY 1),
    f AS (SELECT count(*) AS n, sum(y) AS total, arg_min(y, p) AS a, arg_max(y, p) AS b FROM s), k AS (SELECT p, y FROM s ORDER BY y DESC, p LIMIT 1)
    SELECT CAST(n AS BIGINT) AS periods, round(total, 2) AS total, a AS first_y, b AS last_y, round((b - a) / abs(a) * 100) AS pct_change, CAST(k.p AS VARCHAR) AS peak_period, k.y AS peak_y,
    CASE WHEN round((b - a) / abs(a) * 100) > 5 THEN 'upward' WHEN round((b - a) / abs(a) * 100) < -5 THEN 'downward' ELSE 'stable' END AS trend FROM f, k""",
)
add(
    "w07_gaps",
    lambda t: windows.gaps(t.events, "ts").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "gap_seconds"),
    """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, g / 1e6 AS gap_seconds FROM (SELECT ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS g FROM (SELECT DISTINCT ts FROM {events})) WHERE g IS NOT NULL""",
)
_VIEW = "SELECT n_name, c_mktsegment, round(sum(sales), 2) AS total FROM {sales} GROUP BY 1, 2"
add(
    "w10_ranks",
    lambda t: windows.ranks(t.sql("SELECT n_name, c_mktsegment, CAST(count(*) AS BIGINT) AS orders FROM {sales} GROUP BY 1, 2"), "orders", ["c_mktsegment"], ["n_name"]),
    """SELECT *, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY orders DESC) AS BIGINT) AS rank, CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY orders DESC) AS BIGINT) AS dense_rank,
    CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY orders DESC, n_name) AS BIGINT) AS unique_rank, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY n_name) AS BIGINT) AS index
    FROM (SELECT n_name, c_mktsegment, CAST(count(*) AS BIGINT) AS orders FROM {sales} GROUP BY 1, 2)""",
)
add(
    "w10_ranks_whole_table",
    lambda t: windows.ranks(t.events.select("event_id", "user_id"), "user_id", tie=["event_id"]),
    """SELECT event_id, user_id, CAST(rank() OVER (ORDER BY user_id DESC) AS BIGINT) AS rank, CAST(dense_rank() OVER (ORDER BY user_id DESC) AS BIGINT) AS dense_rank,
    CAST(row_number() OVER (ORDER BY user_id DESC, event_id) AS BIGINT) AS unique_rank, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS index FROM {events}""",
)
_MONTHLY = "SELECT c_mktsegment, date_trunc('month', o_orderdate) AS m, CAST(sum(CAST(sales AS DECIMAL(18, 2))) AS DOUBLE) AS y FROM {sales} GROUP BY 1, 2"


def _monthly_view(t):
    exact = F.sum(F.col("sales").cast("decimal(18,2)")).cast("double").alias("y")
    return t.sales.groupBy("c_mktsegment", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(exact)


def _rounded(df, names, digits=2):
    return df.withColumns({n: F.round(n, digits) for n in names}).withColumn("month", F.col("month").cast("string"))


_RUN = ["running_sum", "running_min", "running_max", "window_sum"]
add(
    "w11_running",
    lambda t: _rounded(_rounded(windows.running(_monthly_view(t), "y", ["month"], ["c_mktsegment"]), ["running_avg", "window_avg"], 4), _RUN),
    "WITH v AS (" + _MONTHLY + """) SELECT c_mktsegment, CAST(CAST(m AS DATE) AS VARCHAR) AS month, y, round(sum(y) OVER r, 2) AS running_sum, round(avg(y) OVER r, 4) AS running_avg, CAST(count(y) OVER r AS BIGINT) AS running_count,
    round(min(y) OVER r, 2) AS running_min, round(max(y) OVER r, 2) AS running_max, round(sum(y) OVER p, 2) AS window_sum, round(avg(y) OVER p, 4) AS window_avg, CAST(count(*) OVER p AS BIGINT) AS size
    FROM v WINDOW r AS (PARTITION BY c_mktsegment ORDER BY m ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY c_mktsegment)""",
)
add(
    "w12_lookups",
    lambda t: _rounded(windows.lookups(_monthly_view(t), "y", ["month"], ["c_mktsegment"]), ["previous_value_sum"]),
    "WITH v AS (" + _MONTHLY + """) SELECT c_mktsegment, CAST(CAST(m AS DATE) AS VARCHAR) AS month, y, lag(y) OVER o AS lookup_back, lead(y) OVER o AS lookup_ahead, CAST(1 - row_number() OVER o AS BIGINT) AS first_offset,
    CAST(count(*) OVER p - row_number() OVER o AS BIGINT) AS last_offset, round(sum(y) OVER (PARTITION BY c_mktsegment ORDER BY m ROWS UNBOUNDED PRECEDING), 2) AS previous_value_sum
    FROM v WINDOW o AS (PARTITION BY c_mktsegment ORDER BY m), p AS (PARTITION BY c_mktsegment)""",
)

_RAW = "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS y FROM {events}"
add(
    "w11_running_whole_table",
    lambda t: windows.running(t.sql(_RAW), "y", ["event_id"]).withColumn("running_avg", F.round("running_avg", 4)).withColumn("window_avg", F.round("window_avg", 4)),
    "WITH v AS (" + _RAW + """) SELECT event_id, y, sum(y) OVER r AS running_sum, round(avg(y) OVER r, 4) AS running_avg, CAST(count(y) OVER r AS BIGINT) AS running_count, min(y) OVER r AS running_min, max(y) OVER r AS running_max,
    sum(y) OVER () AS window_sum, round(avg(y) OVER (), 4) AS window_avg, CAST(count(*) OVER () AS BIGINT) AS size FROM v WINDOW r AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
add(
    "w12_lookups_whole_table",
    lambda t: windows.lookups(t.sql(_RAW), "y", ["event_id"], offset=3),
    "WITH v AS (" + _RAW + """) SELECT event_id, y, lag(y, 3) OVER o AS lookup_back, lead(y, 3) OVER o AS lookup_ahead, CAST(1 - row_number() OVER o AS BIGINT) AS first_offset,
    CAST(count(*) OVER () - row_number() OVER o AS BIGINT) AS last_offset, sum(y) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS previous_value_sum FROM v WINDOW o AS (ORDER BY event_id)""",
)


def _ptd(t):
    view = _monthly_view(t)
    out = windows.same_period_last_year(windows.period_to_date(view, ["c_mktsegment"]), ["c_mktsegment"])
    return _rounded(out, ["ytd", "qtd", "yoy_pct"])


add(
    "w13_period_to_date",
    _ptd,
    "WITH v AS (" + _MONTHLY + """) SELECT v.c_mktsegment, CAST(CAST(v.m AS DATE) AS VARCHAR) AS month, v.y, round(sum(v.y) OVER (PARTITION BY v.c_mktsegment, year(v.m) ORDER BY v.m ROWS UNBOUNDED PRECEDING), 2) AS ytd,
    round(sum(v.y) OVER (PARTITION BY v.c_mktsegment, year(v.m), quarter(v.m) ORDER BY v.m ROWS UNBOUNDED PRECEDING), 2) AS qtd, l.y AS last_year, round((v.y - l.y) / abs(l.y) * 100, 2) AS yoy_pct
    FROM v LEFT JOIN v l ON l.c_mktsegment = v.c_mktsegment AND l.m = v.m - INTERVAL 1 YEAR""",
)
