"""Metrics (M01-M13), scalar functions (X01-X13), chart aggregates (A01-A10), sorting (O01-O04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensdq.functions import scalars as s
from lensdq.functions import text
from lensdq.functions.typing import semantic_types
from lensdq.operators import dimensions as dim
from lensdq.operators import metrics as m
from lensdq.operators import present
from lensdq.operators.metrics import Metric, Ratio
from lensdq.queries.base import Suite

suite = Suite()
add = suite.add


def rounded(df, names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


add(
    "m01_basic_aggregates",
    lambda t: rounded(
        m.evaluate(t.lineitem, [Metric("total", "SUM", "l_extendedprice"), Metric("average", "AVG", "l_extendedprice"), Metric("low", "MIN", "l_extendedprice"), Metric("high", "MAX", "l_extendedprice")], ["l_returnflag"]),
        ["total", "average"], 2,
    ),
    "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 2) AS average, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM {lineitem} GROUP BY 1",
)
add(
    "m02_counts",
    lambda t: m.evaluate(t.gappy, [Metric("counted", "COUNT", "l_tax"), Metric("counted_rows", "COUNTROWS"), Metric("big", "COUNTROWS", where="l_quantity > 25")]),
    "SELECT CAST(count(l_tax) AS BIGINT) AS counted, CAST(count(*) AS BIGINT) AS counted_rows, CAST(count(*) FILTER (l_quantity > 25) AS BIGINT) AS big FROM {gappy}",
)
add("m03_median", lambda t: m.exact_median(t.orders, "o_totalprice").withColumn("median", F.round("median", 4)), "SELECT 'o_totalprice' AS column_name, round(median(o_totalprice), 4) AS median FROM {orders}")
add(
    "m04_distinct_count",
    lambda t: m.evaluate(t.lineitem, [Metric("parts", "COUNTD", "l_partkey"), Metric("orders", "DISTINCTCOUNT", "l_orderkey")], ["l_linestatus"]),
    "SELECT l_linestatus, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders FROM {lineitem} GROUP BY 1",
)
add(
    "m05_spread",
    lambda t: rounded(
        m.evaluate(t.lineitem, [Metric("sd", "STDEV", "l_quantity"), Metric("sdp", "STDEVP", "l_quantity"), Metric("va", "VAR", "l_quantity"), Metric("vap", "VARP", "l_quantity"), Metric("attr_one", "ATTR", "l_returnflag"), Metric("attr_many", "ATTR", "l_linenumber")], ["l_returnflag"]),
        ["sd", "sdp", "va", "vap"], 6,
    ),
    """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 6) AS va, round(var_pop(l_quantity), 6) AS vap,
    CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS attr_one, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN min(l_linenumber) END AS attr_many FROM {lineitem} GROUP BY 1""",
)
add(
    "m06_divide",
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.round(s.divide(F.col("l_tax"), F.col("l_discount"), -1), 6).alias("ratio")),
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN -1.0 ELSE l_tax / l_discount END, 6)::DOUBLE AS ratio FROM {lineitem}",
)
add(
    "m07_lod_fixed",
    lambda t: rounded(m.lod_fixed(t.orders, ["o_custkey"], "MAX", "o_totalprice"), ["value"], 2),
    "SELECT round(sum(v), 2) AS value, CAST(count(*) AS BIGINT) AS groups FROM (SELECT max(o_totalprice) AS v FROM {orders} GROUP BY o_custkey)",
)
add(
    "m08_lod_include",
    lambda t: rounded(m.lod_include(t.sales, ["r_name"], ["n_name", "c_mktsegment"], "SUM", "sales"), ["value"], 2),
    "SELECT r_name, round(avg(v), 2) AS value FROM (SELECT r_name, n_name, c_mktsegment, sum(sales) AS v FROM {sales} GROUP BY 1, 2, 3) GROUP BY 1",
)
add(
    "m08_lod_exclude",
    lambda t: rounded(m.lod_exclude(t.sales, ["r_name", "n_name"], ["n_name"], "SUM", "sales"), ["value", "excluded"], 2),
    "SELECT r_name, n_name, round(v, 2) AS value, round(sum(v) OVER (PARTITION BY r_name), 2) AS excluded FROM (SELECT r_name, n_name, sum(sales) AS v FROM {sales} GROUP BY 1, 2)",
)
add(
    "m09_null_handling",
    lambda t: t.gappy.agg(
        F.round(F.sum(s.zn(F.col("l_tax"))), 4).alias("zn_sum"), F.round(F.sum(s.ifnull(F.col("l_tax"), 0.5)), 4).alias("ifnull_sum"), F.count_if(F.col("l_tax").isNull()).alias("isnull_count")
    ),
    "SELECT round(sum(coalesce(l_tax, 0)), 4) AS zn_sum, round(sum(coalesce(l_tax, 0.5::DOUBLE)), 4) AS ifnull_sum, CAST(count(*) FILTER (l_tax IS NULL) AS BIGINT) AS isnull_count FROM {gappy}",
)
add(
    "m10_conditionals",
    lambda t: t.gappy.select(
        s.iif(F.col("l_tax") > 0.04, F.lit("high"), F.lit("low"), F.lit("unknown")).alias("tax_band"),
        s.switch(F.col("l_returnflag"), [("N", F.lit("new")), ("R", F.lit("returned"))], F.lit("other")).alias("flag_name"),
        F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large").alias("size_band"),
    ).groupBy("tax_band", "flag_name", "size_band").agg(F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN l_tax > 0.04 THEN 'high' WHEN l_tax <= 0.04 THEN 'low' ELSE 'unknown' END AS tax_band,
    CASE WHEN l_returnflag = 'N' THEN 'new' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'other' END AS flag_name,
    CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size_band, CAST(count(*) AS BIGINT) AS n FROM {gappy} GROUP BY 1, 2, 3""",
)


def _reconcile(t):
    gross = F.sum("l_extendedprice")
    return rounded(
        m.reconcile(
            t.lineitem,
            [("price", gross, F.sum(F.col("l_quantity") * F.col("l_extendedprice") / F.col("l_quantity"))),
             ("net", gross, F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))),
             ("rows", F.count(F.lit(1)), F.count("l_orderkey")),
             ("nothing", F.sum(F.lit(0)), F.sum("l_linenumber"))],
        ),
        ["left_value", "right_value"], 2,
    )


add(
    "m11_reconciliation",
    _reconcile,
    "WITH v(metric, a, b) AS (" + " UNION ALL ".join(
        f"SELECT '{n}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE) FROM {{lineitem}}"
        for n, a, b in (("price", "sum(l_extendedprice)", "sum(l_quantity * l_extendedprice / l_quantity)"), ("net", "sum(l_extendedprice)", "sum(l_extendedprice * (1 - l_discount))"),
                        ("rows", "count(*)", "count(l_orderkey)"), ("nothing", "0 * count(*)", "sum(l_linenumber)"))
    ) + """) SELECT metric, round(a, 2) AS left_value, round(b, 2) AS right_value, round(CASE WHEN a = 0 AND b = 0 THEN 0 WHEN a = 0 THEN 100 ELSE abs(b - a) / abs(a) * 100 END, 4)::DOUBLE AS delta_pct,
    CASE WHEN a = 0 AND b = 0 THEN true WHEN a = 0 THEN false ELSE abs(b - a) / abs(a) * 100 < 0.01 END AS match FROM v""",
)
add(
    "m12_metric_names",
    lambda t: m.match_names(
        t.part.select(F.col("p_name").alias("name")),
        t.part.select(F.when(F.col("p_size") > 40, F.concat("p_name", F.lit(" Measure"))).when(F.col("p_size") > 25, F.concat("p_name", F.lit(" v2"))).otherwise(F.concat("p_name", F.lit(" over all regions"))).alias("name")),
    ),
    """WITH l AS (SELECT DISTINCT p_name AS name FROM {part}), r AS (SELECT DISTINCT CASE WHEN p_size > 40 THEN p_name || ' Measure' WHEN p_size > 25 THEN p_name || ' v2' ELSE p_name || ' over all regions' END AS m FROM {part}),
    p AS (SELECT name, m, CASE WHEN lower(m) = lower(name) THEN 1 WHEN lower(m) = lower(name) || ' measure' THEN 2 WHEN starts_with(lower(m), lower(name)) AND length(m) - length(name) < 10 THEN 3 END AS step FROM l, r)
    SELECT name, m AS matched, CASE step WHEN 1 THEN 'exact' WHEN 2 THEN 'suffix' ELSE 'prefix' END AS method FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step, lower(m)) AS rk FROM p WHERE step IS NOT NULL) WHERE rk = 1""",
)
add(
    "m13_mode_of_date_part",
    lambda t: m.mode_of(t.orders, {p: s.date_part(p, F.col("o_orderdate")) for p in ("year", "quarter", "month", "day")}),
    " UNION ALL ".join(f"(SELECT '{p}' AS part, {p}(o_orderdate) AS value, CAST(count(*) AS BIGINT) AS n FROM {{orders}} GROUP BY 2 ORDER BY n DESC, value LIMIT 1)" for p in ("year", "quarter", "month", "day")),
)

add(
    "x01_math",
    lambda t: t.customer.select(
        "c_custkey", F.abs(F.col("c_acctbal")).alias("abs_v"), F.round(F.col("c_acctbal"), 1).alias("round_v"), F.ceil(F.col("c_acctbal")).alias("ceil_v"), F.floor(F.col("c_acctbal")).alias("floor_v"), F.round(F.pow(F.col("c_acctbal"), F.lit(2)), 2).alias("power_v"),
        F.round(F.sqrt(F.abs(F.col("c_acctbal"))), 6).alias("sqrt_v"), F.round(F.log(F.abs(F.col("c_acctbal")) + 1), 6).alias("ln_v"), F.round(s.log_base(F.abs(F.col("c_acctbal")) + 1), 6).alias("log_v"),
    ),
    """SELECT c_custkey, abs(c_acctbal) AS abs_v, round(c_acctbal, 1) AS round_v, CAST(ceil(c_acctbal) AS BIGINT) AS ceil_v, CAST(floor(c_acctbal) AS BIGINT) AS floor_v, round(pow(c_acctbal, 2), 2) AS power_v,
    round(sqrt(abs(c_acctbal)), 6) AS sqrt_v, round(ln(abs(c_acctbal) + 1), 6) AS ln_v, round(log10(abs(c_acctbal) + 1), 6) AS log_v FROM {customer}""",
)
add(
    "x02_more_math",
    lambda t: t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(F.exp("l_tax"), 6).alias("exp_v"), F.round(F.log2("l_quantity"), 6).alias("log2_v"), F.round(F.pi() * F.col("l_linenumber"), 6).alias("pi_v"),
        F.signum(F.col("l_quantity") - 25).cast("bigint").alias("sign_v"), (F.col("l_partkey") % 7).alias("mod_v"), s.integer_division(F.col("l_partkey"), F.lit(7)).alias("div_v"),
    ),
    """SELECT l_orderkey, l_linenumber, round(exp(l_tax), 6) AS exp_v, round(log2(l_quantity), 6) AS log2_v, round(pi() * l_linenumber, 6) AS pi_v, CAST(sign(l_quantity - 25) AS BIGINT) AS sign_v,
    l_partkey % 7 AS mod_v, l_partkey // 7 AS div_v FROM {lineitem}""",
)
add(
    "x03_text",
    lambda t: t.part.select(
        "p_partkey", F.length("p_name").cast("bigint").alias("len_v"), F.upper("p_name").alias("upper_v"), F.lower("p_brand").alias("lower_v"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trim_v"),
        s.left(F.col("p_name"), 3).alias("left_v"), s.right(F.col("p_name"), 4).alias("right_v"), s.mid(F.col("p_name"), 2, 3).alias("mid_v"), s.contains_text(F.col("p_name"), "RING").alias("contains_v"),
    ),
    """SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS len_v, upper(p_name) AS upper_v, lower(p_brand) AS lower_v, trim('  ' || p_name || ' ') AS trim_v, left(p_name, 3) AS left_v, right(p_name, 4) AS right_v,
    substr(p_name, 2, 3) AS mid_v, contains(lower(p_name), 'ring') AS contains_v FROM {part}""",
)
add(
    "x04_more_text",
    lambda t: t.part.select(
        "p_partkey", F.ltrim(F.concat(F.lit("  "), "p_name")).alias("ltrim_v"), F.rtrim(F.concat("p_name", F.lit("  "))).alias("rtrim_v"), F.replace("p_name", F.lit("red"), F.lit("RED")).alias("replace_v"),
        F.col("p_name").startswith("small").alias("starts_v"), F.col("p_name").endswith("ring").alias("ends_v"), s.find(F.col("p_name"), " ").cast("bigint").alias("find_v"), F.col("p_brand").rlike("^Brand#1[0-9]$").alias("regexp_v"),
        F.concat(F.lit("a"), s.space(3), F.lit("b")).alias("space_v"), s.split_part(F.col("p_name"), " ", 2).alias("split_v"), F.ascii("p_name").cast("bigint").alias("ascii_v"), F.char(F.col("p_size") + 60).alias("char_v"), s.to_text(F.col("p_size")).alias("str_v"),
    ),
    """SELECT p_partkey, ltrim('  ' || p_name) AS ltrim_v, rtrim(p_name || '  ') AS rtrim_v, replace(p_name, 'red', 'RED') AS replace_v, starts_with(p_name, 'small') AS starts_v, ends_with(p_name, 'ring') AS ends_v,
    CAST(strpos(p_name, ' ') AS BIGINT) AS find_v, regexp_matches(p_brand, '^Brand#1[0-9]$') AS regexp_v, 'a   b' AS space_v, split_part(p_name, ' ', 2) AS split_v, CAST(ascii(p_name) AS BIGINT) AS ascii_v, chr(p_size + 60) AS char_v,
    CAST(p_size AS VARCHAR) AS str_v FROM {part}""",
)
add(
    "x05_date_parts",
    lambda t: t.orders.select("o_orderkey", *[s.date_part(p, F.col("o_orderdate")).cast("bigint").alias(p) for p in ("year", "quarter", "month", "day")], (F.current_date() >= F.col("o_orderdate").cast("date")).alias("in_past"), (F.now() >= F.col("o_orderdate")).alias("before_now")),
    "SELECT o_orderkey, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, month(o_orderdate) AS month, day(o_orderdate) AS day, current_date >= CAST(o_orderdate AS DATE) AS in_past, true AS before_now FROM {orders}",
)
add(
    "x06_dates",
    lambda t: t.events.select(
        "event_id", *[s.date_part(p, F.col("ts")).cast("bigint").alias(p) for p in ("hour", "minute", "second", "week", "weekday")], s.date_trunc("week", F.col("ts")).cast("date").cast("string").alias("trunc_week"),
        s.date_add("month", 2, F.col("ts")).cast("string").alias("plus_months"), s.date_add("week", 1, F.col("ts").cast("date")).cast("string").alias("plus_week"), s.date_diff("day", F.lit("2024-01-10").cast("date"), F.col("ts").cast("date")).cast("bigint").alias("diff_day"),
        s.date_diff("month", F.lit("2023-11-30").cast("date"), F.col("ts").cast("date")).cast("bigint").alias("diff_month"), s.date_name("month", F.col("ts")).alias("month_name"), s.date_name("weekday", F.col("ts")).alias("weekday_name"),
        s.make_date(F.year(F.col("ts")), F.month(F.col("ts")), F.lit(1)).cast("string").alias("made_date"), F.date_format(s.make_datetime(F.col("ts"), F.lit("2000-01-01 08:30:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("made_datetime"), s.is_date(F.col("props")).alias("is_date_v"),
    ),
    """SELECT event_id, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, week(ts) AS week, dayofweek(ts) + 1 AS weekday, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS trunc_week,
    CAST(CAST(CAST(ts AS DATE) + INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS plus_months, CAST(CAST(CAST(ts AS DATE) + 7 AS DATE) AS VARCHAR) AS plus_week, date_diff('day', DATE '2024-01-10', CAST(ts AS DATE)) AS diff_day,
    date_diff('month', DATE '2023-11-30', CAST(ts AS DATE)) AS diff_month, monthname(ts) AS month_name, dayname(ts) AS weekday_name, strftime(ts, '%Y-%m-01') AS made_date, strftime(ts, '%Y-%m-%d') || ' 08:30:00' AS made_datetime,
    TRY_CAST(props AS TIMESTAMP) IS NOT NULL AS is_date_v FROM {events}""",
)
add(
    "x07_casts",
    lambda t: t.contacts.select("c_custkey", s.to_int(F.col("zip")).alias("int_v"), s.to_float(F.col("zip")).alias("float_v"), s.to_int(F.col("balance")).alias("truncated"), s.to_text(F.col("c_custkey")).alias("str_v")),
    "SELECT c_custkey, CAST(TRY_CAST(zip AS DOUBLE) AS BIGINT) AS int_v, TRY_CAST(zip AS DOUBLE) AS float_v, CAST(trunc(balance) AS BIGINT) AS truncated, CAST(c_custkey AS VARCHAR) AS str_v FROM {contacts}",
)
_GEO = "SELECT c_custkey, CAST(c_custkey % 170 AS DOUBLE) - 85 AS la, CAST(c_custkey % 350 AS DOUBLE) - 175 AS lo, CAST(c_nationkey AS DOUBLE) * 2 - 20 AS lb, c_acctbal / 60 AS lp FROM {customer}"
add(
    "x08_distance",
    lambda t: t.sql(_GEO).select("c_custkey", F.round(s.distance(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")), 3).alias("km"), F.round(s.distance(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"), "mi"), 3).alias("mi")),
    "WITH g AS (" + _GEO + "), c AS (SELECT c_custkey, acos(greatest(-1, least(1, sin(radians(la)) * sin(radians(lb)) + cos(radians(la)) * cos(radians(lb)) * cos(radians(lp) - radians(lo))))) AS a FROM g) SELECT c_custkey, round(a * 6371, 3) AS km, round(a * 3959, 3) AS mi FROM c",
)
add(
    "x09_number_extraction",
    lambda t: text.extract_numbers(t.documents, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("numbers"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("unit") != "").alias("with_unit")),
)
add(
    "x10_headings",
    lambda t: text.extract_headings(t.documents, "doc_id", "text"),
    r"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS parts FROM {documents}), l AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, trim(unnest(parts), ' ') AS line FROM s)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, heading FROM (SELECT doc_id, line_no, regexp_replace(trim(regexp_replace(line, '^#+', ''), ' '), ':+$', '') AS heading FROM l
    WHERE length(line) BETWEEN 1 AND 120 AND ((regexp_matches(line, '\p{{L}}') AND upper(line) = line AND lower(line) <> line AND length(line) > 3) OR starts_with(line, '#') OR regexp_matches(line, '^\d+[.)]\s+[A-Z]') OR (ends_with(line, ':') AND length(line) < 80))) WHERE heading <> ''""",
)


def _json_schema(t):
    flat = text.flatten_json(t.events, "props")
    return semantic_types(flat.drop("ts", "event_id"), "text")


add("x11_json_schema", _json_schema)
add(
    "x12_claim_scan",
    lambda t: text.claim_scan(t.documents, "doc_id", "text"),
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)(TODO|FIXME|PLACEHOLDER|EXAMPLE_|sample_table|your_table|replace_this|lorem ipsum|INSERT_.*_HERE)')) AS BIGINT) AS placeholders,
    CAST(len(regexp_extract_all(text, '(?i)(?:saves?|reduc\w+|improv\w+|increas\w+)\s+(?:by\s+)?(\d+(?:\.\d+)?)\s*%')) AS BIGINT) AS percent_claims,
    CAST(len(regexp_extract_all(text, '(?i)\b(I think|I believe|probably|approximately|around \d+|I assume)\b')) AS BIGINT) AS hedges FROM {documents}""",
)
add(
    "x13_number_format",
    lambda t: t.orders.select("o_orderkey", s.display_number(F.col("o_totalprice")).alias("shown"), s.display_number(F.col("o_totalprice") * 100).alias("shown_large"), s.display_number(F.lit(0.5) / (F.col("o_custkey") + 1)).alias("shown_small")),
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN format('${{:,.1f}}M', o_totalprice / 1e6) WHEN o_totalprice >= 1e4 THEN format('${{:,.1f}}K', o_totalprice / 1e3) WHEN o_totalprice >= 100 THEN format('{{:,.0f}}', o_totalprice) ELSE format('{{:,.2f}}', o_totalprice) END AS shown,
    CASE WHEN o_totalprice * 100 >= 1e6 THEN format('${{:,.1f}}M', o_totalprice * 100 / 1e6) WHEN o_totalprice * 100 >= 1e4 THEN format('${{:,.1f}}K', o_totalprice * 100 / 1e3) ELSE format('{{:,.0f}}', o_totalprice * 100) END AS shown_large,
    format('{{:,.1f}}%', 0.5 / (o_custkey + 1) * 100) AS shown_small FROM {orders}""",
)

add(
    "a01_group_aggregate",
    lambda t: present.group_aggregate(t.gappy, "l_returnflag", "l_quantity", "sum", "desc").withColumn("agg", F.lit("sum")).unionByName(present.group_aggregate(t.gappy, "l_returnflag", "l_quantity", "avg", "asc").withColumn("agg", F.lit("avg"))),
    """SELECT coalesce(l_returnflag, 'Unknown') AS x, round(sum(l_quantity), 2) AS y, 'sum' AS agg FROM {gappy} GROUP BY 1 UNION ALL SELECT coalesce(l_returnflag, 'Unknown'), round(avg(l_quantity), 2), 'avg' FROM {gappy} GROUP BY 1""",
)
add(
    "a02_two_key_aggregate",
    lambda t: present.two_key_aggregate(t.sales, "n_name", "c_mktsegment", "sales", 20, 3),
    """WITH s AS (SELECT n_name AS x, c_mktsegment AS series, round(sum(sales), 2) AS y FROM {sales} GROUP BY 1, 2) SELECT * FROM s WHERE x IN (SELECT DISTINCT x FROM s ORDER BY x LIMIT 20) AND series IN (SELECT DISTINCT series FROM s ORDER BY series LIMIT 3)""",
)
add(
    "a02_heatmap",
    lambda t: present.heatmap(t.sales, "n_name", "o_orderstatus", "sales", ["F", "O", "P"]),
    "SELECT n_name AS x, " + ", ".join(f"round(coalesce(sum(sales) FILTER (o_orderstatus = '{v}'), 0), 2) AS \"{v}\"" for v in "FOP") + " FROM {sales} GROUP BY 1",
)
add(
    "a03_kpis",
    lambda t: present.kpis(t.sales, ["sales", "profit"]).withColumns({"min_value": F.round("min_value", 4), "max_value": F.round("max_value", 4)}),
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(sum({c}), 2) AS total, round(avg({c}), 4) AS average, round(min({c}), 4) AS min_value, round(max({c}), 4) AS max_value FROM {{sales}}" for c in ("sales", "profit")),
)
add(
    "a04_time_aggregate",
    lambda t: present.time_aggregate(t.orders, "o_orderdate", "o_totalprice").withColumn("source", F.lit("orders")).unionByName(present.time_aggregate(t.events, "ts", "value", "avg").withColumn("source", F.lit("events"))).withColumn("period", F.col("period").cast("string")),
    """SELECT CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS period, round(sum(o_totalprice), 2) AS y, 'orders' AS source FROM {orders} GROUP BY 1
    UNION ALL SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR), round(avg(value), 2), 'events' FROM {events} GROUP BY 1""",
)
add(
    "a05_concentration",
    lambda t: present.concentration(t.sales, "n_name", "sales").unionByName(present.concentration(t.sales, "c_mktsegment", "sales")),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS dimension, max(x) FILTER (rk = 1) AS top_value, CAST(count(*) AS BIGINT) AS group_count, {", ".join(f"round(sum(y) FILTER (rk <= {k}) * 100.0 / sum(y), 2) AS top{k}_pct" for k in (1, 3, 5))}
        FROM (SELECT x, y, row_number() OVER (ORDER BY y DESC, x) AS rk FROM (SELECT {c} AS x, sum(sales) AS y FROM {{sales}} GROUP BY 1))"""
        for c in ("n_name", "c_mktsegment")
    ),
)
add(
    "a06_histogram",
    lambda t: present.histogram(t.lineitem, "l_extendedprice", 20),
    """SELECT CAST(b AS BIGINT) AS bin, round(lo + b * (hi - lo) / 20, 6) AS bin_start, CAST(count(*) AS BIGINT) AS n FROM (SELECT lo, hi, least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS b
    FROM {lineitem}, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM {lineitem})) GROUP BY b, lo, hi""",
)
add(
    "a07_scatter_label",
    lambda t: present.scatter_label(t.lineitem, "l_quantity", "l_extendedprice"),
    """SELECT CAST(count(*) AS BIGINT) AS points, round(r, 4) AS r, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN r > 0.1 THEN 'positive' WHEN r < -0.1 THEN 'negative' ELSE 'no clear' END AS direction
    FROM {lineitem}, (SELECT corr(l_quantity, l_extendedprice) AS r FROM {lineitem}) GROUP BY r""",
)
def _bars(i: int, kind: str, x: str, y: str, top: str) -> str:
    return f"""SELECT * FROM (SELECT {i} AS chart, '{kind}' AS type, {x} AS x, round(sum({y}), 2)::DOUBLE AS y FROM {{lineitem}} GROUP BY {x} ORDER BY y DESC, x {top})"""


def _lines(i: int, kind: str, y: str) -> str:
    return f"SELECT {i}, '{kind}', CAST(CAST(date_trunc('quarter', l_shipdate) AS DATE) AS VARCHAR), round(sum({y}), 2)::DOUBLE FROM {{lineitem}} GROUP BY 3"


add(
    "a08_chart_plan",
    lambda t: present.run_charts(t.lineitem),
    " UNION ALL ".join([
        _bars(1, "bar", "l_returnflag", "l_orderkey", "LIMIT 15"), _lines(0, "line", "l_orderkey"), _bars(2, "hbar", "l_linestatus", "l_orderkey", "LIMIT 12"),
        _bars(3, "donut", "l_returnflag", "l_orderkey", ""),
        """SELECT 4, 'scatter', CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END || ' ' || CASE WHEN r > 0.1 THEN 'positive' WHEN r < -0.1 THEN 'negative' ELSE 'no clear' END, round(r, 4)
        FROM (SELECT corr(l_orderkey, l_partkey) AS r FROM {lineitem})""",
        _lines(5, "area", "l_partkey"), _bars(6, "donut", "l_linestatus", "l_orderkey", ""),
    ]),
)
_NAMED = [Metric("revenue", "SUM", "l_extendedprice * (1 - l_discount)"), Metric("average_quantity", "AVERAGE", "l_quantity"), Metric("row_total", "COUNTROWS"), Metric("smallest", "MIN", "l_quantity"), Metric("largest", "MAX", "l_quantity"), Metric("parts", "DISTINCTCOUNT", "l_partkey"),
          Ratio("net_share", Metric("n", "SUM", "l_extendedprice * (1 - l_discount)"), Metric("d", "SUM", "l_extendedprice"))]
_NAMED_SQL = """round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS average_quantity, CAST(count(*) AS BIGINT) AS row_total, min(l_quantity) AS smallest, max(l_quantity) AS largest,
  CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) AS net_share FROM {lineitem}"""


def _measures(t):
    scalar = m.evaluate(t.lineitem, _NAMED).withColumn("l_returnflag", F.lit("*"))
    both = scalar.unionByName(m.evaluate(t.lineitem, _NAMED, ["l_returnflag"]))
    return rounded(rounded(rounded(both, ["revenue"], 2), ["average_quantity"], 4), ["net_share"], 6)


_MEDIANS = [Metric("rows", "COUNTROWS"), Metric("middle_price", "MEDIAN", "l_extendedprice"), Metric("middle_late_tax", "MEDIAN", "l_tax", "l_linenumber > 3")]
add(
    "a09_median_per_group",
    lambda t: rounded(m.evaluate(t.gappy.join(t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("line"), "l_extendedprice"), ["l_orderkey", "line"]), _MEDIANS, ["l_returnflag"]), ["middle_price", "middle_late_tax"], 4),
    """SELECT g.l_returnflag, CAST(count(*) AS BIGINT) AS rows, round(median(l_extendedprice), 4) AS middle_price, round(median(CASE WHEN g.l_linenumber > 3 THEN g.l_tax END), 4) AS middle_late_tax
    FROM {gappy} g JOIN {lineitem} l ON l.l_orderkey = g.l_orderkey AND l.l_linenumber = g.line GROUP BY 1""",
)
add(
    "m03_median_per_supplier",
    lambda t: rounded(m.evaluate(t.lineitem, [Metric("middle", "MEDIAN", "l_extendedprice")], ["l_suppkey"]), ["middle"], 4),
    "SELECT l_suppkey, round(median(l_extendedprice), 4) AS middle FROM {lineitem} GROUP BY 1",
)
add("a09_named_measures", _measures, "SELECT '*' AS l_returnflag, " + _NAMED_SQL + " UNION ALL SELECT l_returnflag, " + _NAMED_SQL + " GROUP BY l_returnflag")
add(
    "a10_report_pack",
    lambda t: present.report_pack(t.sales, ["c_mktsegment", "o_orderpriority", "r_name"], "sales"),
    "SELECT 'all' AS dimension, '*' AS label, round(sum(sales), 2) AS total, CAST(count(*) AS BIGINT) AS row_count FROM {sales} UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', {c}, round(sum(sales), 2), CAST(count(*) AS BIGINT) FROM {{sales}} GROUP BY {c}" for c in ("c_mktsegment", "o_orderpriority", "r_name")),
)

add(
    "o01_sort",
    lambda t: present.sort_rows(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", True, ["o_orderkey"]),
    "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey",
)
add("o02_top_groups", lambda t: present.top_groups(t.sales, "n_name", "sales", 12), "SELECT n_name AS x, round(sum(sales), 2) AS y FROM {sales} GROUP BY 1 ORDER BY y DESC, x LIMIT 12")


def _top_per_column(t):
    from lensdq.operators.longform import top_values, value_counts

    return top_values(value_counts(t.orders, ["o_custkey", "o_orderpriority", "o_orderdate"]), 5)


add(
    "o03_top_per_column",
    _top_per_column,
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, v AS value, n, CAST(row_number() OVER (ORDER BY n DESC, v) AS BIGINT) AS rank FROM (SELECT CAST({c} AS VARCHAR) AS v, CAST(count(*) AS BIGINT) AS n FROM {{orders}} GROUP BY 1)) WHERE rank <= 5"
        for c in ("o_custkey", "o_orderpriority", "o_orderdate")
    ),
)
_SEV = "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END"
add(
    "o04_severity_order",
    lambda t: t.orders.select("o_orderkey", F.expr(_SEV).alias("severity")).withColumn("severity_rank", dim.severity_rank(F.col("severity"))).orderBy("severity_rank", "o_orderkey"),
    f"SELECT o_orderkey, {_SEV} AS severity, CASE {_SEV} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS severity_rank FROM {{orders}} ORDER BY 3, 1",
)
