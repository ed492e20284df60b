"""Portfolio (P01-P09), modelling (K01-K06), generation (N01-N03), audit (Q26-Q32), sources and sinks (S01-S14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensdq.functions import typing
from lensdq.operators import audit, generate, model, portfolio
from lensdq.queries.base import Suite, each
from lensdq.sources import readers, writers

suite = Suite()
add = suite.add

# --- portfolio
_INV = """inv AS (SELECT *, coalesce(date_diff('day', last_viewed_date, DATE '2026-02-01'), 9999) AS dsv, date_diff('day', created_date, DATE '2026-02-01') AS age,
  array_to_string(list_sort(list_transform(string_split(source_tables, ','), lambda x: trim(x))), ',') AS source_set FROM {inventory}),
  dup AS (SELECT source_set, CAST(count(*) AS BIGINT) AS members, CAST(sum(view_count_30d) AS BIGINT) AS views FROM inv GROUP BY 1 HAVING count(*) >= 3),
  waste AS (SELECT *, CASE refresh_schedule WHEN '4x daily' THEN 4 WHEN '2x daily' THEN 2 ELSE 1 END * 365 * 0.12::DOUBLE AS cost FROM inv WHERE refresh_schedule IN ('4x daily', '2x daily', '1x daily') AND view_count_30d = 0)"""


def inv(t):
    return portfolio.derive(t.inventory)


def padd(name, run, sql):
    add(name, lambda t: run(inv(t)), "WITH " + _INV + " " + sql)


padd(
    "p01_derive",
    lambda d: d.select("dashboard_id", F.col("days_since_viewed").cast("bigint").alias("days_since_viewed"), F.col("age_days").cast("bigint").alias("age_days"), "source_set"),
    "SELECT dashboard_id, CAST(dsv AS BIGINT) AS days_since_viewed, CAST(age AS BIGINT) AS age_days, source_set FROM inv",
)
padd("p02_summary", portfolio.summary, "SELECT CAST(count(*) AS BIGINT) AS total_dashboards, CAST(count(DISTINCT workspace) AS BIGINT) AS total_workspaces, CAST(count(DISTINCT owner_email) AS BIGINT) AS total_owners, CAST(floor(avg(age)) AS BIGINT) AS avg_age_days FROM inv")
padd("p02_platform_split", portfolio.platform_split, "SELECT platform, CAST(count(*) AS BIGINT) AS n FROM inv GROUP BY 1")
padd("p03_zombies", portfolio.zombies, " UNION ALL ".join(f"SELECT {d} AS over_days, CAST(count(*) FILTER (dsv > {d}) AS BIGINT) AS n, round(count(*) FILTER (dsv > {d}) * 100.0 / count(*), 1) AS pct FROM inv" for d in (90, 180, 365)))
padd("p03_zombie_list", portfolio.zombie_list, "SELECT dashboard_id, workspace, owner_email, CAST(dsv AS INTEGER) AS days_since_viewed FROM inv WHERE dsv > 90")
padd("p04_duplicate_groups", portfolio.duplicate_groups, "SELECT * FROM dup")
padd("p05_refresh_waste", portfolio.refresh_waste, "SELECT refresh_schedule, CAST(count(*) AS BIGINT) AS wasted_refreshes, round(sum(cost), 2) AS annual_cost FROM waste GROUP BY 1")
padd(
    "p06_workspace_health", portfolio.workspace_health,
    """SELECT workspace, CAST(count(*) AS BIGINT) AS total, round(count(*) FILTER (dsv > 90) * 100.0 / count(*), 1) AS zombie_pct,
    (SELECT CAST(count(*) AS BIGINT) FROM (SELECT source_set FROM inv j WHERE j.workspace = i.workspace GROUP BY 1 HAVING count(*) >= 3)) AS duplicate_groups, round(avg(view_count_30d), 1) AS avg_views FROM inv i GROUP BY 1""",
)
padd(
    "p07_cost_impact", portfolio.cost_impact,
    """SELECT round(w, 2) AS zombie_refresh_waste, g * 2400.0::DOUBLE AS duplicate_maintenance, 3000000.0::DOUBLE * 1 AS analyst_search_time, round(z * 102.0::DOUBLE, 2) AS premium_capacity_waste, round(round(w, 2) + g * 2400.0::DOUBLE + 3000000 + round(z * 102.0::DOUBLE, 2), 2) AS total_annual_waste
    FROM (SELECT coalesce(sum(cost), 0) AS w FROM waste), (SELECT count(*) AS g FROM dup), (SELECT count(*) FILTER (dsv > 90) AS z FROM inv)""",
)
padd(
    "p08_actions", portfolio.actions,
    """SELECT 'retire' AS action, dashboard_id AS item FROM inv WHERE dsv > 365 UNION ALL SELECT 'archive', dashboard_id FROM inv WHERE dsv > 180 AND dsv <= 365 UNION ALL SELECT 'consolidate', source_set FROM dup
    UNION ALL SELECT 'reduce_refresh', dashboard_id FROM waste UNION ALL SELECT 'certify', dashboard_id FROM inv WHERE dsv <= 30 AND view_count_30d >= 20 AND NOT is_certified""",
)
padd(
    "p09_retirement_plan", portfolio.retirement_plan,
    """SELECT 'phase_1' AS phase, 'this week' AS timeline, CAST(count(*) FILTER (dsv > 365) AS BIGINT) AS n FROM inv UNION ALL SELECT 'phase_2', '30 days', CAST(count(*) FILTER (dsv > 180 AND dsv <= 365) AS BIGINT) FROM inv
    UNION ALL SELECT 'phase_3', '60 days', CAST(coalesce(sum(members), 0) AS BIGINT) FROM dup""",
)

# --- modelling
_ROLE = "CASE WHEN count(DISTINCT @c) / count(*) < 0.05 AND count(DISTINCT @c) < 100 THEN 'dimension' WHEN count(DISTINCT @c) / count(*) > 0.9 THEN 'degenerate' ELSE 'other' END"
_BUSINESS = "SELECT o_orderkey AS order_key, o_custkey AS cust_id, o_totalprice AS total_amount, o_totalprice / 1000 AS score, o_orderdate AS order_date, o_orderstatus AS order_status, o_orderpriority AS priority, concat('x', CAST(o_orderkey AS VARCHAR(20))) AS code FROM {orders}"
_KROLES = {"order_key": ("'key'", "''"), "cust_id": ("'key'", "''"), "total_amount": ("'measure'", "'SUM additive'"), "score": ("'measure'", "'AVG semi_additive'"), "order_date": ("'time'", "''"),
           "order_status": (_ROLE, "conformed"), "priority": (_ROLE, "regular"), "code": (_ROLE, "regular")}
add(
    "k01_star_inference",
    lambda t: model.infer_roles(t.sql(_BUSINESS)),
    "WITH b AS (" + _BUSINESS + ") " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {r.replace('@c', c)} AS role, " + (d if d.startswith("'") else f"CASE WHEN {r.replace('@c', c)} = 'dimension' THEN '{d}_dimension' ELSE '' END") + f" AS detail, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count FROM b"
        for c, (r, d) in _KROLES.items()
    ),
)
add(
    "k02_dimension_build",
    lambda t: model.build_dimension(t.part, "p_brand", "2024-01-01").withColumns({c: F.col(c).cast("string") for c in ("effective_date", "expiry_date")}),
    "SELECT CAST(row_number() OVER (ORDER BY v) AS BIGINT) AS dim_key, v AS value, '2024-01-01' AS effective_date, '9999-12-31' AS expiry_date, true AS is_current FROM (SELECT DISTINCT p_brand AS v FROM {part})",
)
add(
    "k02_fact_keys",
    lambda t: model.attach_keys(t.part.select("p_partkey", "p_brand", "p_retailprice"), model.build_dimension(t.part, "p_brand", "2024-01-01"), "p_brand", "brand_key"),
    "SELECT p_partkey, p_retailprice, k AS brand_key FROM {part} JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) AS BIGINT) AS k FROM (SELECT DISTINCT p_brand AS v FROM {part})) ON v = p_brand",
)
_LATER = "SELECT p_type AS p_brand FROM {part} UNION ALL SELECT p_brand FROM {part}"
add(
    "k02_dimension_extend",
    lambda t: model.extend_dimension(model.build_dimension(t.part, "p_brand", "2024-01-01"), t.sql(_LATER), "p_brand", "2024-02-01").withColumns({c: F.col(c).cast("string") for c in ("effective_date", "expiry_date")}),
    """WITH old AS (SELECT CAST(row_number() OVER (ORDER BY v) AS BIGINT) AS dim_key, v AS value, '2024-01-01' AS effective_date FROM (SELECT DISTINCT p_brand AS v FROM {part})),
    fresh AS (SELECT DISTINCT p_brand AS v FROM (""" + _LATER + """) WHERE p_brand NOT IN (SELECT value FROM old))
    SELECT *, '9999-12-31' AS expiry_date, true AS is_current FROM (SELECT * FROM old UNION ALL SELECT CAST((SELECT max(dim_key) FROM old) + row_number() OVER (ORDER BY v) AS BIGINT), v, '2024-02-01' FROM fresh)""",
)


def _dates(t):
    span = t.orders.agg(F.min("o_orderdate").cast("date").cast("string").alias("a"), F.max("o_orderdate").cast("date").cast("string").alias("b")).first()
    days = model.date_dimension(t.spark, span["a"], span["b"]).withColumn("full_date", F.col("full_date").cast("string"))
    orders = t.orders.groupBy(F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_key")).agg(F.count(F.lit(1)).alias("orders"))
    return days.join(orders, "date_key", "left")


add(
    "k03_date_dimension",
    _dates,
    """WITH d AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(o_orderdate) AS DATE) FROM {orders}), (SELECT CAST(max(o_orderdate) AS DATE) FROM {orders}), INTERVAL 1 DAY)) AS DATE) AS d)
    SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS VARCHAR) AS full_date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, CAST(week(d) AS INTEGER) AS week_of_year,
    CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, dayname(d) AS day_name, dayofweek(d) BETWEEN 1 AND 5 AS is_weekday, o.n AS orders FROM d LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS od, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY 1) o ON od = d""",
)
_ATTR = ["c_name", "c_acctbal", "c_mktsegment"]


def _scd2(t):
    first = t.customer.select("c_custkey", *_ATTR, F.lit("2023-01-01").cast("date").alias("effective_date"), F.lit(model.HIGH_DATE).cast("date").alias("expiry_date"), F.lit(True).alias("is_current"))
    incoming = t.customer_next.select((F.col("c_custkey") - 100).alias("c_custkey"), "c_name", (F.col("c_acctbal") / 1.2).alias("bal"), F.col("segment").alias("c_mktsegment")).select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.lit(0.0)).otherwise(F.round("bal", 2)).alias("c_acctbal"), "c_mktsegment")
    out = model.scd2_apply(first, incoming, "c_custkey", _ATTR, "2024-01-01")
    return out.withColumns({c: F.col(c).cast("string") for c in ("effective_date", "expiry_date")})


add(
    "k04_scd2_apply",
    _scd2,
    """WITH n AS (SELECT c_custkey - 100 AS c_custkey, c_name, CASE WHEN (c_custkey - 100) % 2 = 0 THEN 0.0::DOUBLE ELSE round(c_acctbal / 1.2, 2) END AS c_acctbal, segment AS c_mktsegment FROM {customer_next}),
    j AS (SELECT c.c_custkey AS ck, n.c_custkey AS nk, c.c_name AS cn, n.c_name AS nn, c.c_acctbal AS cb, n.c_acctbal AS nb, c.c_mktsegment AS cm, n.c_mktsegment AS nm,
      c.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AND c.c_name = n.c_name AND c.c_acctbal IS NOT DISTINCT FROM n.c_acctbal AND c.c_mktsegment = n.c_mktsegment AS same FROM {customer} c FULL JOIN n ON c.c_custkey = n.c_custkey)
    SELECT ck AS c_custkey, cn AS c_name, cb AS c_acctbal, cm AS c_mktsegment, '2023-01-01' AS effective_date, CASE WHEN same THEN '9999-12-31' ELSE '2024-01-01' END AS expiry_date, same AS is_current FROM j WHERE ck IS NOT NULL
    UNION ALL SELECT nk, nn, nb, nm, '2024-01-01', '9999-12-31', true FROM j WHERE nk IS NOT NULL AND NOT same""",
)


def _hub(t):
    known = model.hub_load(t.customer.where("c_mktsegment <> 'BUILDING'"), "c_custkey", "crm", "2023-01-01")
    return model.hub_load(t.customer, "c_custkey", "crm", "2024-01-01", known).withColumn("load_date", F.col("load_date").cast("string"))


add(
    "k05_hub_load",
    _hub,
    "SELECT md5(CAST(c_custkey AS VARCHAR)) AS hash_key, CAST(c_custkey AS VARCHAR) AS business_key, '2024-01-01' AS load_date, 'crm' AS record_source FROM {customer} WHERE c_mktsegment = 'BUILDING'",
)


def _satellite(t):
    before = model.satellite_load(t.customer.drop("c_acctbal"), "c_custkey", "crm", "2023-01-01")
    now = t.customer_next.select((F.col("c_custkey") - 100).alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), F.col("segment").alias("c_mktsegment"))
    return model.satellite_load(now, "c_custkey", "crm", "2024-01-01", before).withColumn("load_date", F.col("load_date").cast("string"))


add(
    "k05_satellite_load",
    _satellite,
    """SELECT md5(CAST(c_custkey - 100 AS VARCHAR)) AS hash_key, '2024-01-01' AS load_date, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, segment AS c_mktsegment, 'crm' AS record_source,
    md5(length(c_name) || ':' || c_name || length(c_nationkey::VARCHAR) || ':' || c_nationkey || length(segment) || ':' || segment) AS hash_diff FROM {customer_next} WHERE segment = 'CONSTRUCTION'""",
)
_WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "quantity", "price", "discount", "tax", "l_returnflag", "l_linestatus"]


def _wide_satellite(t):
    """Ten descriptors, of which only the last one changes."""
    rows = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_key"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"), F.round(F.col("l_discount") * 100).cast("int").alias("discount"), F.round(F.col("l_tax") * 100).cast("int").alias("tax"), "l_returnflag", "l_linestatus")
    before = model.satellite_load(rows.withColumn("l_linestatus", F.when(F.col("l_linenumber") != 2, F.col("l_linestatus"))), "line_key", "erp", "2023-01-01")
    return model.satellite_load(rows, "line_key", "erp", "2024-01-01", before).select("hash_key", *_WIDE, "hash_diff")


add(
    "k05_satellite_wide",
    _wide_satellite,
    "SELECT md5(l_orderkey || '-' || l_linenumber) AS hash_key, *, md5(" + " || ".join(f"length({c}::VARCHAR) || ':' || {c}" for c in _WIDE) + """) AS hash_diff FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) AS quantity,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_discount * 100) AS INTEGER) AS discount, CAST(round(l_tax * 100) AS INTEGER) AS tax, l_returnflag, l_linestatus FROM {lineitem} WHERE l_linenumber = 2)""",
)
add(
    "k06_sql_types",
    lambda t: typing.sql_types(t.orders).unionByName(typing.sql_types(t.contacts)),
    """SELECT 'o_orderkey' AS column_name, 'BIGINT' AS sql_type UNION ALL SELECT 'o_custkey', 'BIGINT' UNION ALL SELECT 'o_totalprice', 'DECIMAL(18,4)' UNION ALL SELECT 'o_orderdate', 'DATETIME' UNION ALL SELECT 'c_custkey', 'BIGINT' UNION ALL SELECT 'balance', 'DECIMAL(18,4)' UNION ALL """
    + " UNION ALL ".join(
        f"SELECT '{c}', 'VARCHAR(' || CAST(least(CAST(floor(max(length({c})) * 1.5) AS BIGINT), 4000) AS VARCHAR) || ')' FROM {{{t}}}"
        for t, cs in (("orders", ["o_orderstatus", "o_orderpriority"]), ("contacts", ["email", "phone", "zip", "website", "label", "flag"])) for c in cs
    ),
)

# --- generation: as many rows as orders, pools from the tables
WORKBOOK = [("Region", "string", "dimension"), ("Sales", "real", "measure"), ("Profit", "real", "measure"), ("Order Date", "date", "dimension"), ("Category", "string", "dimension"),
            ("Customer Name", "string", "dimension"), ("Discount", "real", "measure"), ("Quantity", "integer", "measure")]


def _generated(t):
    few = lambda df, c: sorted(r[c] for r in df.select(c).distinct().collect())  # pools of a handful of values
    pools = {"Region": few(t.region, "r_name"), "Category": few(t.orders, "o_orderpriority")}
    return generate.generate_rows(t.orders.select(F.col("o_orderkey").alias("id")), WORKBOOK, "2024-06-30", 42, pools)


def _gen_summary(t):
    return _generated(t).groupBy("Region").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Sales"), 2).alias("sales"), F.min("Order Date").cast("string").alias("first"), F.max("Quantity").alias("most"))


def _trended(t):
    base = _generated(t).select("id", F.col("Order Date").alias("d"), F.col("Sales").alias("sales"))
    return generate.inject_trend(base, ["d", "id"], ["sales"]).groupBy(F.trunc("d", "month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sales"), 2).alias("avg_sales"))


def _draw(tag: str, row: str = "id") -> str:
    """The generator's number in [0, 1) as SQL."""
    return f"(CAST(('0x' || substr(md5({row} || '|{tag}|42'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _between(name: str, whole: bool = False) -> str:
    lo, hi = generate.measure_range(name)
    return f"CAST(floor({_draw(name)} * {hi - lo + 1} + {lo}) AS BIGINT)" if whole else f"round({_draw(name)} * {hi - lo} + {lo}, 2)"


_GENERATED = f"""g AS (SELECT id, (SELECT list(r_name ORDER BY r_name) FROM {{region}})[CAST(floor({_draw("Region")} * (SELECT count(*) FROM {{region}})) AS BIGINT) + 1] AS "Region",
  {_between("Sales")} AS sales, {_between("Quantity", True)} AS quantity, DATE '2022-06-30' + CAST(floor({_draw("Order Date")} * 730) AS INTEGER) AS d FROM (SELECT o_orderkey AS id FROM {{orders}}))"""
add("n01_generate_rows", _gen_summary, "WITH " + _GENERATED + """ SELECT "Region", CAST(count(*) AS BIGINT) AS n, round(sum(sales), 2) AS sales, CAST(min(d) AS VARCHAR) AS first, max(quantity) AS most FROM g GROUP BY 1""")
add(
    "n02_inject_trend",
    _trended,
    "WITH " + _GENERATED + f""", p AS (SELECT d, sales, row_number() OVER (ORDER BY d, id) - 1 AS pos, count(*) OVER () AS n FROM g),
    s AS (SELECT d, round(sales * (1 + 0.3 * (pos / greatest(n - 1, 1))) * (1 + 0.1 * sin(2 * 3.14159 * pos / greatest(n / 12, 1))) * (0.95 + 0.1 * {_draw("sales", "pos")}), 2) AS v FROM p)
    SELECT strftime(d, '%Y-%m-01') AS month, CAST(count(*) AS BIGINT) AS n, round(avg(v), 2) AS avg_sales FROM s GROUP BY 1""",
)


def _stale_days() -> str:
    run, cases = 0.0, []
    for share, lo, hi in generate.STALENESS:
        run += share
        cases.append(f"WHEN {_draw('stale')} < {run + 1e-12!r}::DOUBLE THEN floor({lo} + {_draw('stale_day')} * {hi - lo})")
    return "CASE " + " ".join(cases) + " END"


def _inventory(t):
    """Workspaces are the nations, as often as they have suppliers."""
    suppliers = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    pool = {r["n_name"]: float(r["n"]) for r in t.nation.join(suppliers, F.col("n_nationkey") == F.col("s_nationkey")).orderBy("n_name").collect()}
    return generate.generate_inventory(t.orders.select(F.col("o_orderkey").alias("id")), pool)


add(
    "n03_generate_inventory",
    lambda t: portfolio.zombies(portfolio.derive(_inventory(t))),
    f"""WITH s AS (SELECT {_stale_days()} AS days FROM (SELECT o_orderkey AS id FROM {{orders}}))
    SELECT over_days, CAST(count(*) FILTER (days > over_days) AS BIGINT) AS n, round(count(*) FILTER (days > over_days) * 100.0 / count(*), 1) AS pct FROM s, (VALUES (90), (180), (365)) o(over_days) GROUP BY 1""",
)

# --- audit
def audited(t):
    return [audit.findings(t.copied, "copied"), audit.findings(t.gappy, "gappy"), audit.findings(t.orders, "orders")]


_AUDIT_COLS = {"copied": (["c_nationkey", "c_mktsegment", "c_standing"], ["c_nationkey"], ["c_mktsegment", "c_standing"]),
               "gappy": (["l_orderkey", "line", "l_linenumber", "l_tax", "l_shipdate", "l_returnflag", "l_quantity"], ["l_orderkey", "line", "l_linenumber", "l_tax", "l_quantity"], ["l_returnflag"]),
               "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])}


def audit_sql(name: str) -> str:
    cols, nums, texts = _AUDIT_COLS[name]
    src = "{" + name + "}"
    sparse = " + ".join(f"CASE WHEN count(*) - count({c}) > count(*) * 0.5 THEN 1 ELSE 0 END" for c in cols)
    empty = " + ".join(f"CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END" for c in cols)
    flat = " + ".join(f"CASE WHEN count(DISTINCT {c}) <= 1 THEN 1 ELSE 0 END" for c in cols)
    mixed = " + ".join(f"CASE WHEN count(TRY_CAST({c} AS DOUBLE)) BETWEEN 1 AND count({c}) - 1 THEN 1 ELSE 0 END" for c in texts)
    wild = " + ".join(
        f"(SELECT CASE WHEN b > a AND count(*) FILTER ({c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a)) > 0 THEN 1 ELSE 0 END FROM {src}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {src}) GROUP BY a, b)" for c in nums
    )
    return f"""SELECT '{name}' AS source, CAST(n AS BIGINT) AS n, CAST(n - u AS BIGINT) AS dup, round((n - u) * 100.0 / n, 1) AS dp, sparse, empt, flat, mixed, wild FROM (SELECT count(*) AS n, {sparse} AS sparse, {empty} AS empt, {flat} AS flat, {mixed} AS mixed FROM {src}),
      (SELECT count(*) AS u FROM (SELECT DISTINCT {', '.join(cols)} FROM {src})), (SELECT {wild} AS wild)"""


_AUDIT = "base_ AS (" + " UNION ALL ".join(audit_sql(n) for n in _AUDIT_COLS) + """), fi AS (
  SELECT source, 'Data Exists' AS check_name, 'completeness' AS category, 'PASS' AS severity, n AS affected FROM base_
  UNION ALL SELECT source, 'Duplicate Rows', 'data_integrity', CASE WHEN dup = 0 THEN 'PASS' WHEN dp < 10 THEN 'WARNING' ELSE 'CRITICAL' END, dup FROM base_
  UNION ALL SELECT source, 'Null Density', 'data_integrity', CASE WHEN sparse > 0 THEN 'WARNING' ELSE 'PASS' END, sparse FROM base_
  UNION ALL SELECT source, 'Empty Columns', 'completeness', CASE WHEN empt > 0 THEN 'CRITICAL' ELSE 'PASS' END, empt FROM base_
  UNION ALL SELECT source, 'Zero-Variance Columns', 'data_integrity', 'INFO', flat FROM base_ WHERE flat > 0
  UNION ALL SELECT source, 'Extreme Outliers', 'data_integrity', CASE WHEN wild = 0 THEN 'PASS' WHEN wild <= 3 THEN 'WARNING' ELSE 'CRITICAL' END, wild FROM base_
  UNION ALL SELECT source, 'Mixed Data Types', 'consistency', CASE WHEN mixed > 0 THEN 'WARNING' ELSE 'PASS' END, mixed FROM base_
  UNION ALL SELECT source, 'Overall Data Profile', 'completeness', 'INFO', n FROM base_)"""


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


add("q26_audit_findings", lambda t: _union(audited(t)), "WITH " + _AUDIT + " SELECT source, check_name, category, severity, CAST(affected AS BIGINT) AS affected FROM fi")
_SC = "CASE severity WHEN 'PASS' THEN 100 WHEN 'INFO' THEN 90 WHEN 'WARNING' THEN 60 WHEN 'CRITICAL' THEN 20 ELSE 0 END"
add(
    "q27_release_decision",
    lambda t: audit.release_decision(_union(audited(t)), ["source"]),
    "WITH " + _AUDIT + f""", d AS (SELECT source, CAST(count(*) AS BIGINT) AS total_checks, CAST(count(*) FILTER (severity = 'PASS') AS BIGINT) AS pass, CAST(count(*) FILTER (severity = 'INFO') AS BIGINT) AS info, CAST(count(*) FILTER (severity = 'WARNING') AS BIGINT) AS warning,
      CAST(count(*) FILTER (severity = 'CRITICAL') AS BIGINT) AS critical, CAST(count(*) FILTER (severity = 'BLOCKER') AS BIGINT) AS blocker, round(avg({_SC}), 1) AS overall_score FROM fi GROUP BY 1),
      e AS (SELECT *, CASE WHEN blocker > 0 THEN 'BLOCKED' WHEN critical > 0 THEN 'HOLD' WHEN warning > 3 THEN 'REVIEW REQUIRED' WHEN overall_score >= 70 THEN 'APPROVED' ELSE 'BELOW THRESHOLD' END AS decision FROM d) SELECT *, decision = 'APPROVED' AS is_releasable FROM e""",
)
add("q28_combine_reports", lambda t: audit.combine(audited(t)), "WITH " + _AUDIT + " SELECT source, '[' || source || '] ' || check_name AS check_name, category, severity, CAST(affected AS BIGINT) AS affected FROM fi")
_FNUM = ["o_orderkey", "sales", "profit"]


def _facts_sql() -> str:
    src = "{sales}"
    nums = " UNION ALL ".join(f"SELECT '{f}' AS fact, '{c}' AS subject, round({e}({c})::DOUBLE, 2) AS value, '' AS text FROM {src}" for c in _FNUM for f, e in (("total", "sum"), ("average", "avg"), ("minimum", "min"), ("maximum", "max"), ("median", "median")))
    g = lambda c: f"(SELECT {c} AS x, sum(o_orderkey) AS y FROM {src} GROUP BY 1)"
    tops = " UNION ALL ".join(
        f"SELECT 'top{k}_pct', '{c}', round((SELECT sum(y) FROM (SELECT y FROM {g(c)} ORDER BY y DESC, x LIMIT {k})) * 100.0 / (SELECT sum(y) FROM {g(c)}), 2), " + (f"(SELECT x FROM {g(c)} ORDER BY y DESC, x LIMIT 1)" if k == 1 else "''")
        for c in ("o_orderpriority", "o_orderstatus", "c_mktsegment", "n_name", "r_name") for k in (1, 3)
    )
    trend = " UNION ALL ".join(f"""SELECT 'trend', '{c}', round((b - a) / abs(a) * 100, 2), CASE WHEN (b - a) / abs(a) * 100 > 5 THEN 'upward' WHEN (b - a) / abs(a) * 100 < -5 THEN 'downward' ELSE 'stable' END FROM (
      SELECT sum({c}) FILTER (pos < floor(n * 0.1)) AS a, sum({c}) FILTER (pos >= n - floor(n * 0.1)) AS b FROM (SELECT {c}, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM {src}))""" for c in _FNUM)
    return f"{nums} UNION ALL {tops} UNION ALL {trend} UNION ALL SELECT 'row_count', '', count(*)::DOUBLE, '' FROM {src}"


add("q29_verified_facts", lambda t: audit.verified_facts(t.sales, ["o_orderdate", "o_orderkey"]), _facts_sql())
add(
    "q30_insights",
    lambda t: audit.insights(t.gappy, ["l_quantity"], ["l_returnflag"]),
    """SELECT 'kpi' AS kind, 'l_quantity' AS subject, round(sum(l_quantity), 2) AS value, '' AS note FROM {gappy}
    UNION ALL SELECT 'top_performer', 'l_returnflag', round(max(y) * 100.0 / sum(y), 2), arg_max(x, y) FROM (SELECT l_returnflag AS x, sum(l_quantity) AS y FROM {gappy} WHERE l_returnflag IS NOT NULL GROUP BY 1)
    UNION ALL SELECT 'concentration', 'l_returnflag', 100.0, 'top 3' UNION ALL SELECT * FROM (""" + each(
        ["l_orderkey", "line", "l_linenumber", "l_tax", "l_shipdate", "l_returnflag", "l_quantity"],
        "SELECT 'null_column' AS kind, '@c' AS subject, round((count(*) - count(@c)) * 100.0 / count(*), 1) AS value, '' AS note FROM {gappy}",
    ) + """) WHERE value > 5 UNION ALL SELECT * FROM (SELECT 'duplicates' AS kind, '' AS subject, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {gappy})))::DOUBLE AS value, '' AS note FROM {gappy}) WHERE value > 0""",
)
_METRICS = """SELECT concat(p_brand, ' ', p_type) AS name, CASE WHEN p_size % 11 = 0 THEN 'BLANK()' ELSE concat('SUM(', p_name, ')') END AS target,
  CASE p_size % 5 WHEN 0 THEN 'heuristic' WHEN 1 THEN 'ai' WHEN 2 THEN 'spatial' WHEN 3 THEN 'ai_failed' ELSE 'other' END AS method, p_size % 5 <> 4 AS needs_ai, p_size % 2 = 0 AS is_map, p_name AS original,
  CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false END AS match, CAST(p_size AS DOUBLE) AS delta_pct FROM {part}"""
_TIERS = "f AS (" + _METRICS + """), tr AS (SELECT *, CASE WHEN target = 'BLANK()' THEN 'BLOCKED' WHEN method = 'spatial' THEN CASE WHEN is_map THEN 'MAP' ELSE 'GOOD' END WHEN method = 'other' THEN 'AUTO' WHEN method = 'heuristic' THEN CASE WHEN match = false THEN 'REVIEW' ELSE 'GOOD' END
  WHEN method = 'ai' THEN CASE WHEN match THEN 'GOOD' ELSE 'REVIEW' END WHEN method = 'ai_failed' THEN CASE WHEN needs_ai THEN 'BLOCKED' ELSE 'AUTO' END END AS tier,
  CASE WHEN target = 'BLANK()' THEN 0 WHEN method = 'spatial' THEN 90 WHEN method = 'other' THEN 100 WHEN method = 'heuristic' THEN CASE WHEN match = false THEN greatest(30, 85 - CAST(floor(delta_pct) AS INTEGER)) ELSE 85 END
  WHEN method = 'ai' THEN CASE WHEN match THEN 90 WHEN match = false THEN greatest(20, 70 - CAST(floor(delta_pct) AS INTEGER)) ELSE 70 END ELSE 0 END AS confidence FROM f)"""
add(
    "q32_migration_tiers",
    lambda t: audit.migration_tiers(t.sql(_METRICS)).groupBy("tier", "confidence").agg(F.count(F.lit(1)).alias("n")),
    "WITH " + _TIERS + " SELECT tier, CAST(confidence AS INTEGER) AS confidence, CAST(count(*) AS BIGINT) AS n FROM tr GROUP BY 1, 2",
)
add(
    "q32_migration_score",
    lambda t: audit.migration_score(audit.migration_tiers(t.sql(_METRICS))),
    "WITH " + _TIERS + """, s AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (tier = 'BLOCKED') AS BIGINT) AS blocked, CAST(count(*) FILTER (tier = 'REVIEW') AS BIGINT) AS review, CAST(count(*) FILTER (confidence > 0 AND confidence < 50) AS BIGINT) AS low_confidence,
      CAST(count(*) FILTER (tier IN ('AUTO', 'GOOD', 'MAP')) AS BIGINT) AS auto_good, CAST(floor(avg(confidence)) AS BIGINT) AS avg_confidence FROM tr)
    SELECT *, round(auto_good * 100.0 / total, 1) AS coverage_pct, CAST(greatest(0, 100 - least(blocked * 20, 60) - least(review * 5, 25) - least(low_confidence * 3, 15) - CASE WHEN auto_good * 100.0 / total >= 80 THEN 0 ELSE floor((80 - auto_good * 100.0 / total) / 2) END) AS BIGINT) AS score FROM s""",
)
add(
    "q32_duplicate_names",
    lambda t: audit.duplicate_names(t.sql(_METRICS)),
    "SELECT p_brand || ' ' || p_type AS name, CAST(count(*) AS BIGINT) AS n FROM {part} GROUP BY 1 HAVING count(*) > 1",
)

# --- sources and sinks: whole tables written to a fresh shared location and read back
ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, o_orderpriority FROM {orders}"


def _stamped(df, column="o_orderdate"):
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _file(t, kind):
    return writers.scratch_path(t.spark, f"orders.{kind}")


add("s01_csv", lambda t: _stamped(readers.read_csv(t.spark, writers.write_csv(t.orders, _file(t, "csv")), ORDER_SCHEMA)), _ORDERS)
add("s02_tsv", lambda t: _stamped(readers.read_tsv(t.spark, writers.write_csv(t.orders, _file(t, "tsv"), sep="\t"), ORDER_SCHEMA)), _ORDERS)
add("s03_parquet", lambda t: _stamped(readers.read_parquet(t.spark, writers.write_parquet(t.orders, _file(t, "parquet")))), _ORDERS)


def _json(t):
    from lensdq.functions.text import flatten_json

    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    back = readers.read_json(t.spark, writers.write_json(t.events, _file(t, "json")), schema)
    return _stamped(flatten_json(back, "props", "k bigint"), "ts")


add("s04_json", _json, "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {events}")


add("s05_xml", lambda t: _stamped(readers.read_xml(t.spark, writers.write_xml(t.orders, _file(t, "xml"), "order"), "order", ORDER_SCHEMA)), _ORDERS)
add("s06_sniffed", lambda t: _stamped(readers.read_delimited(t.spark, writers.write_csv(t.orders, _file(t, "txt"), sep="|"), ORDER_SCHEMA)), _ORDERS)
_LAYOUT = [("o_orderkey", 1, 20), ("o_custkey", 21, 20), ("o_orderstatus", 42, 3), ("o_totalprice", 45, 26), ("o_orderdate", 72, 26), ("o_orderpriority", 99, 20)]


def _fixed(t):
    rows = readers.read_fixed_width(t.spark, writers.write_fixed_width(t.orders, _file(t, "rpt"), _LAYOUT), _LAYOUT)
    typed = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp_ntz"}
    return _stamped(rows.withColumns({c: F.col(c).cast(kind) for c, kind in typed.items()}))


add("s07_fixed_width", _fixed, _ORDERS)


def _folder(t):
    base = writers.scratch_path(t.spark, "bundle")
    writers.write_csv(t.nation, f"{base}/nation.csv")
    writers.write_json(t.region, f"{base}/region.json")
    writers.write_parquet(t.customer, f"{base}/customer.parquet")
    writers.write_xml(t.supplier, f"{base}/supplier.xml")
    writers.write_fixed_width(t.orders, f"{base}/orders.prn", _LAYOUT)
    tables = readers.read_folder(t.spark, readers.list_folder(t.spark, base), layouts={"orders": _LAYOUT})
    return _union([readers.table_profile(df, n).select("table_name", "row_count", "column_count") for n, df in tables.items()])


add(
    "s08_folder", _folder,
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, CAST(count(*) AS BIGINT) AS row_count, CAST({k} AS BIGINT) AS column_count FROM {{{n}}}" for n, k in (("nation", 3), ("region", 2), ("customer", 5), ("supplier", 4), ("orders", 6))),
)


def _listing(t):
    for n in ("orders", "customer"):
        getattr(t, n).createOrReplaceTempView(f"listed_{n}")
    names = [r["table_name"] for r in readers.list_tables(t.spark).where("table_name LIKE 'listed_%'").collect()]
    return _union([readers.table_profile(t.spark.table(n), n) for n in names])


add(
    "s10_schema_listing", _listing,
    """SELECT 'listed_orders' AS table_name, CAST(count(*) AS BIGINT) AS row_count, CAST(6 AS BIGINT) AS column_count, 'o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string' AS columns FROM {orders}
    UNION ALL SELECT 'listed_customer', CAST(count(*) AS BIGINT), CAST(5 AS BIGINT), 'c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string' FROM {customer}""",
)


def _repair(t):
    raw = t.sql("SELECT c_custkey, CASE WHEN c_nationkey < 22 THEN CAST(c_custkey AS VARCHAR(20)) ELSE 'n/a' END AS mostly, CASE WHEN c_nationkey < 12 THEN CAST(c_custkey AS VARCHAR(20)) ELSE 'n/a' END AS seldom, CAST(c_acctbal AS DECIMAL(12, 2)) AS bal, DATE '2024-01-02' AS d FROM {customer}")
    return typing.repair_types(raw).withColumn("d", F.date_format("d", "yyyy-MM-dd HH:mm"))


add(
    "s11_type_repair", _repair,
    "SELECT c_custkey, CASE WHEN c_nationkey < 22 THEN CAST(c_custkey AS DOUBLE) END AS mostly, CASE WHEN c_nationkey < 12 THEN CAST(c_custkey AS VARCHAR) ELSE 'n/a' END AS seldom, c_acctbal AS bal, '2024-01-02 00:00' AS d FROM {customer}",
)


def _sanitize(t):
    messy = t.nation.toDF(" [key] ", "name.1", "key")
    return typing.sanitize_columns(messy)


add("s12_sanitize_names", _sanitize, 'SELECT n_nationkey AS "key", n_name AS name_2, n_regionkey AS key_2 FROM {nation}')


def _sinks(t):
    base = writers.scratch_path(t.spark, "sinks")
    writers.write_parquet(t.orders, f"{base}/orders", partition_by=["o_orderstatus"])
    writers.write_json(t.nation, f"{base}/nation")
    writers.write_csv(t.region, f"{base}/region")
    counts = [readers.read_parquet(t.spark, f"{base}/orders").groupBy(F.col("o_orderstatus").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")),
              readers.read_json(t.spark, f"{base}/nation").agg(F.lit("nation").alias("label"), F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").cast("double").alias("total")),
              readers.read_csv(t.spark, f"{base}/region", "r_regionkey int, r_name string").agg(F.lit("region").alias("label"), F.count(F.lit(1)).alias("n"), F.sum("r_regionkey").cast("double").alias("total"))]
    return _union(counts)


add(
    "s13_sinks", _sinks,
    """SELECT o_orderstatus AS label, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY 1
    UNION ALL SELECT 'nation', CAST(count(*) AS BIGINT), sum(n_nationkey)::DOUBLE FROM {nation} UNION ALL SELECT 'region', CAST(count(*) AS BIGINT), sum(r_regionkey)::DOUBLE FROM {region}""",
)
_FIRST = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
add(
    "s14_preview",
    lambda t: _stamped(readers.preview(t.lineitem, 5, _FIRST), "l_shipdate"),
    "SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate) FROM {lineitem} ORDER BY " + ", ".join(_FIRST) + " LIMIT 5",
)
