"""Governance queries (G01-G24, Q34) over catalog, lineage, compliance, trust, cost, history, issues, incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensdq import streaming
from lensdq.functions.wordlists import CLASS_HINTS, COST_PARAMETERS, PART_DOMAIN, PREFIX_DOMAIN
from lensdq.operators import catalog, compliance, lineage, observe, relate, rules
from lensdq.operators import governance as gov
from lensdq.operators.rules import Rule
from lensdq.plans.validate import validate_and_catalog
from lensdq.queries.base import Suite
from lensdq.queries.profiles import _DIMS_CTE, scan_all, scanned
from lensdq.queries.rule_checks import MIXED, _BAD, result_sql
from lensdq.sources.writers import scratch_path

suite = Suite()
add = suite.add

SMALL = {"customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
         "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
         "contacts": {"c_custkey": "bigint", "email": "string", "phone": "string", "zip": "string", "website": "string", "label": "string", "balance": "double", "flag": "string"}}
COLUMNS = [(t, c, i, ty) for t, cs in SMALL.items() for i, (c, ty) in enumerate(cs.items())]


def tables(t):
    return {n: getattr(t, n) for n in SMALL}


def cat(t):
    return catalog.catalog_columns(tables(t))


def class_sql(col: str) -> str:
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower({col}), '{h}')" for h in hints) + f" THEN '{label}'" for label, hints in CLASS_HINTS.items()
    ) + " ELSE 'General' END"


_CAT = "cat AS (SELECT *, " + class_sql("column_name") + " AS classification, " + class_sql("column_name") + " = 'PII' AS pii FROM (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, '{ty}' AS data_type, count(*) > count({c}) AS nullable, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count,
    CAST(count(*) AS BIGINT) AS row_count, """
    + (f"CASE WHEN count(DISTINCT {c}) < 20 THEN (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {{{t}}})) END" if ty == "string" else "CAST(NULL AS VARCHAR)")
    + f" AS valid_values FROM {{{t}}}"
    for t, c, i, ty in COLUMNS
) + "))"
_DOMAIN = "CASE " + " ".join(f"WHEN starts_with(lower(column_name), '{p}') THEN '{d}'" for p, d in PREFIX_DOMAIN.items()) + " " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(column_name), '{x}')" for x in parts) + f" THEN '{d}'" for parts, d in PART_DOMAIN
) + " ELSE 'General' END"
_TERM = "regexp_replace(regexp_replace(column_name, '(?i)^(" + "|".join(PREFIX_DOMAIN) + ")', ''), '[_-]+', ' ', 'g')"
_GLOSS = f"""gl AS (SELECT table_name, column_name, distinct_count, valid_values, upper(term[1]) || lower(term[2:]) AS term, domain,
  data_type || ' of ' || table_name || ': ' || CASE WHEN row_count = 0 THEN 'no rows yet' WHEN distinct_count <= 1 THEN 'the same in all rows' WHEN valid_values IS NOT NULL THEN 'one of ' || replace(valid_values, '|', ', ')
    WHEN distinct_count = row_count AND NOT nullable THEN 'tells the rows apart' ELSE distinct_count || ' values in ' || row_count || ' rows' END || CASE WHEN nullable THEN ', may be missing' ELSE '' END AS definition
  FROM (SELECT *, {_TERM} AS term, {_DOMAIN} AS domain FROM cat))"""

add("g01_catalog", cat, "WITH " + _CAT + " SELECT * FROM cat")
add(
    "g02_classification",
    lambda t: cat(t).groupBy("classification").agg(F.count(F.lit(1)).alias("columns"), F.sum("row_count").alias("cells"), F.sum("distinct_count").alias("distinct_values")),
    "WITH " + _CAT + " SELECT classification, CAST(count(*) AS BIGINT) AS columns, CAST(sum(row_count) AS BIGINT) AS cells, CAST(sum(distinct_count) AS BIGINT) AS distinct_values FROM cat GROUP BY 1",
)
add("g03_glossary", lambda t: catalog.glossary(cat(t)), "WITH " + _CAT + ", " + _GLOSS + " SELECT * FROM gl")
add(
    "g04_catalog_search",
    lambda t: catalog.search(cat(t), catalog.glossary(cat(t)), "Er"),
    "WITH " + _CAT + ", " + _GLOSS + """ SELECT DISTINCT 'table' AS type, table_name AS name, 'table_name' AS match_field FROM cat WHERE contains(table_name, 'er')
    UNION SELECT 'column', table_name || '.' || column_name, 'column_name' FROM cat WHERE contains(column_name, 'er') UNION SELECT 'column', table_name || '.' || column_name, 'valid_values' FROM cat WHERE contains(lower(valid_values), 'er') UNION SELECT 'glossary', term, 'term' FROM gl WHERE contains(lower(term), 'er')
    UNION SELECT 'glossary', term, 'definition' FROM gl WHERE contains(lower(definition), 'er') AND NOT contains(lower(term), 'er')""",
)
add(
    "g05_catalog_stats",
    lambda t: catalog.catalog_stats(cat(t), catalog.glossary(cat(t))),
    "WITH " + _CAT + ", " + _GLOSS + """ SELECT CAST(count(DISTINCT table_name) AS BIGINT) AS tables_cataloged, CAST(count(*) AS BIGINT) AS columns_cataloged, (SELECT CAST(sum(r) AS BIGINT) FROM (SELECT max(row_count) AS r FROM cat GROUP BY table_name)) AS rows_cataloged, CAST(count(*) FILTER (distinct_count <= 1) AS BIGINT) AS constant_columns, (SELECT CAST(count(DISTINCT lower(term)) AS BIGINT) FROM gl) AS glossary_terms,
    CAST(count(*) FILTER (pii) AS BIGINT) AS pii_columns, CAST(0 AS BIGINT) AS certified_tables, CAST(0 AS BIGINT) AS uncatalogued_columns, 100.0::DOUBLE AS coverage_pct FROM cat""",
)


def _built(t):
    chosen = {n: getattr(t, n) for n in ("region", "nation", "customer", "supplier", "orders", "lineitem")}
    nodes, edges = lineage.build(chosen, "Lake", "Sales", "TPCH", {"Revenue Board": ("dashboard", ["orders", "lineitem"])})
    sizes = t.spark.createDataFrame([(f"table_{n}", df.count()) for n, df in chosen.items()], "target string, row_count bigint")
    return edges.join(F.broadcast(sizes), "target", "left")


_LT = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
       "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
       "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]}
add(
    "g06_lineage_build",
    _built,
    "WITH cl(p, t, c) AS (VALUES " + ", ".join(f"({i}, '{t}', '{c}')" for i, (t, cs) in enumerate(_LT.items()) for c in cs) + """),
    e AS (SELECT 'sys_lake' AS source, 'db_sales' AS target, 'feeds' AS relationship UNION ALL SELECT 'db_sales', 'schema_tpch', 'feeds' UNION ALL SELECT DISTINCT 'schema_tpch', 'table_' || t, 'feeds' FROM cl
      UNION ALL SELECT 'table_' || t, 'col_' || t || '_' || c, 'feeds' FROM cl UNION ALL SELECT 'table_orders', 'deliverable_revenue_board', 'used_by' UNION ALL SELECT 'table_lineitem', 'deliverable_revenue_board', 'used_by'
      UNION ALL SELECT 'col_' || a.t || '_' || a.c, 'col_' || b.t || '_' || b.c, 'references' FROM cl a JOIN cl b ON a.p < b.p AND split_part(a.c, '_', 2) = split_part(b.c, '_', 2)
        AND split_part(a.c, '_', 2) IN ('custkey', 'orderkey', 'partkey', 'suppkey', 'nationkey', 'regionkey')),
    s AS (""" + " UNION ALL ".join(f"SELECT 'table_{t}' AS target, CAST(count(*) AS BIGINT) AS row_count FROM {{{t}}}" for t in _LT) + ") SELECT e.target, source, relationship, row_count FROM e LEFT JOIN s ON s.target = e.target",
)


def _walks(t):
    down = lineage.reachable(t.lineage_edges, "region:1", "down", 3).withColumn("direction", F.lit("down"))
    up = lineage.reachable(t.lineage_edges, "order:7", "up", 2).withColumn("direction", F.lit("up"))
    return down.unionByName(up)


add(
    "g07_lineage_walk",
    _walks,
    """WITH RECURSIVE d(id, distance, path) AS (SELECT 'region:1', 0, 'region:1' UNION ALL SELECT target, distance + 1, path || ' > ' || target FROM d JOIN {lineage_edges} e ON e.source = d.id WHERE distance < 3),
    u(id, distance, path) AS (SELECT 'order:7', 0, 'order:7' UNION ALL SELECT source, distance + 1, path || ' > ' || source FROM u JOIN {lineage_edges} e ON e.target = u.id WHERE distance < 2)
    SELECT id, distance, path, 'down' AS direction FROM d WHERE distance > 0 UNION ALL SELECT id, distance, path, 'up' FROM u WHERE distance > 0""",
)
add(
    "g08_impact_analysis",
    lambda t: lineage.impact(t.lineage_edges, t.lineage_nodes, "nation:3").unionByName(lineage.impact(t.lineage_edges, t.lineage_nodes, "region:2")),
    " UNION ALL ".join(
        f"""SELECT '{s}' AS impacted_node, CAST(count(*) AS BIGINT) AS total_downstream, CAST(count(*) FILTER (type = 'dashboard') AS BIGINT) AS dashboards, CAST(0 AS BIGINT) AS reports,
        CAST(count(*) FILTER (type = 'table') AS BIGINT) AS tables, CAST(count(*) FILTER (type = 'column') AS BIGINT) AS columns, CASE WHEN count(*) FILTER (type = 'dashboard') > 0 THEN 'HIGH' WHEN count(*) FILTER (type = 'table') > 0 THEN 'MEDIUM' ELSE 'LOW' END AS impact_severity
        FROM (WITH RECURSIVE d(id) AS (SELECT '{s}' UNION SELECT target FROM d JOIN {{lineage_edges}} e ON e.source = d.id) SELECT n.type FROM d JOIN {{lineage_nodes}} n ON n.id = d.id WHERE d.id <> '{s}')"""
        for s in ("nation:3", "region:2")
    ),
)
add(
    "g08_impact_of_all",
    lambda t: lineage.impacts(t.lineage_edges, t.lineage_nodes, t.lineage_nodes.where("type IN ('source_system', 'database')").select("id")),
    """WITH RECURSIVE s AS (SELECT id FROM {lineage_nodes} WHERE type IN ('source_system', 'database')),
    d(start, id, n) AS (SELECT id, id, 0 FROM s UNION SELECT start, target, n + 1 FROM d JOIN {lineage_edges} e ON e.source = d.id),
    b AS (SELECT start, d.id, min(n) AS n, any_value(type) AS type FROM d JOIN {lineage_nodes} x ON x.id = d.id WHERE d.id <> start GROUP BY 1, 2)
    SELECT s.id AS impacted_node, CAST(count(b.id) AS BIGINT) AS total_downstream, CAST(count(*) FILTER (type = 'dashboard') AS BIGINT) AS dashboards, CAST(0 AS BIGINT) AS reports,
      CAST(count(*) FILTER (type = 'table') AS BIGINT) AS tables, CAST(count(*) FILTER (type = 'column') AS BIGINT) AS columns, CAST(coalesce(max(n), 0) AS INTEGER) AS depth,
      CASE WHEN count(*) FILTER (type = 'dashboard') > 0 THEN 'HIGH' WHEN count(*) FILTER (type = 'table') > 0 THEN 'MEDIUM' ELSE 'LOW' END AS impact_severity
    FROM s LEFT JOIN b ON b.start = s.id GROUP BY s.id""",
)
add(
    "g09_lineage_stats",
    lambda t: lineage.lineage_stats(t.lineage_nodes, t.lineage_edges),
    """SELECT (SELECT CAST(count(*) AS BIGINT) FROM {lineage_nodes}) AS total_nodes, (SELECT CAST(count(*) AS BIGINT) FROM {lineage_edges}) AS total_edges, CAST(count(*) AS BIGINT) AS tables_with_lineage,
    CAST(count(*) FILTER (id NOT IN (SELECT target FROM {lineage_edges})) AS BIGINT) AS orphan_tables,
    round(count(*) FILTER (id IN (SELECT target FROM {lineage_edges}) AND id IN (SELECT source FROM {lineage_edges})) * 100.0 / count(*), 1) AS coverage_pct FROM {lineage_nodes} WHERE type = 'table'""",
)
add(
    "g09_lineage_counts",
    lambda t: lineage.counts_by_type(t.lineage_nodes, t.lineage_edges),
    "SELECT 'node' AS element, type AS label, CAST(count(*) AS BIGINT) AS n FROM {lineage_nodes} GROUP BY 2 UNION ALL SELECT 'edge', relationship, CAST(count(*) AS BIGINT) FROM {lineage_edges} GROUP BY 2",
)

_ELEMENTS = "(VALUES " + ", ".join(f"('{f}', '{r}', '{e.replace('_', '')}')" for f, r, _, es, _ in compliance.REQUIREMENTS for e in es) + ") el(framework, requirement_id, e)"
_PLAIN = "replace(regexp_replace(lower(column_name), '^[a-z]_', ''), '_', '')"
_MAP = f"""mp AS (SELECT DISTINCT table_name, column_name, framework, requirement_id FROM (VALUES {", ".join(f"('{t}', '{c}')" for t, c, _, _ in COLUMNS)}) c(table_name, column_name), {_ELEMENTS}
  WHERE contains({_PLAIN}, e) OR contains(e, {_PLAIN}))"""


def _mapped(t):
    return compliance.map_columns(relate.schema_frame(t.spark, tables(t)))


def _mapped_sizes(t):
    sizes = t.spark.createDataFrame([(n, df.count()) for n, df in tables(t).items()], "table_name string, row_count bigint")
    return _mapped(t).join(F.broadcast(sizes), "table_name")


add(
    "g10_compliance_mapping",
    _mapped_sizes,
    "WITH " + _MAP + ", s AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {{{t}}}" for t in SMALL) + ") SELECT mp.*, row_count FROM mp JOIN s USING (table_name)",
)
_REQ = "(VALUES " + ", ".join(f"('{f}', '{r}', '{s}', '{d}')" for f, r, s, _, ds in compliance.REQUIREMENTS for d in ds) + ") rq(framework, requirement_id, severity, dimension)"
_SCANNED_COLS = [(t, c) for t, cs in (("contacts", list(SMALL["contacts"])), ("copied", ["c_nationkey", "c_mktsegment", "c_standing"]), ("events", ["event_id", "ts", "user_id", "event_type", "value", "props"])) for c in cs]
_MAP2 = f"""mp AS (SELECT DISTINCT table_name, column_name, framework, requirement_id FROM (VALUES {", ".join(f"('{t}', '{c}')" for t, c in _SCANNED_COLS)}) c(table_name, column_name), {_ELEMENTS}
  WHERE contains({_PLAIN}, e) OR contains(e, {_PLAIN})),
  ass AS (SELECT m.table_name, m.framework, m.requirement_id, any_value(rq.severity) AS severity, any_value(m.n) AS mapped_columns, round(avg(coalesce(d.score, 100)), 1) AS score, avg(coalesce(d.score, 100)) >= 80 AS compliant,
    CAST(count(*) FILTER (coalesce(d.score, 100) < 90) AS BIGINT) AS issues
    FROM (SELECT table_name, framework, requirement_id, CAST(count(*) AS BIGINT) AS n FROM mp GROUP BY 1, 2, 3) m JOIN {_REQ} ON rq.framework = m.framework AND rq.requirement_id = m.requirement_id
    LEFT JOIN dims d ON d.table_name = m.table_name AND d.dimension = rq.dimension GROUP BY 1, 2, 3)"""


def _assessed(t):
    mapping = compliance.map_columns(relate.schema_frame(t.spark, scanned(t)))
    return compliance.assess(mapping, scan_all(t).dimensions, compliance.requirements_frame(t.spark))


add("g11_compliance_assessment", _assessed, _DIMS_CTE.rstrip() + ", " + _MAP2 + " SELECT * FROM ass")
add(
    "g11_framework_summary",
    lambda t: compliance.framework_summary(_assessed(t)),
    _DIMS_CTE.rstrip() + ", " + _MAP2 + " SELECT table_name, framework, round(avg(score), 1) AS overall_score, CAST(count(*) FILTER (compliant) AS BIGINT) AS compliant_count, CAST(count(*) FILTER (NOT compliant) AS BIGINT) AS non_compliant_count FROM ass GROUP BY 1, 2",
)


def _trust(t):
    scan = scan_all(t)
    owners = t.spark.createDataFrame([("contacts", "Ana", "Li"), ("events", "Ana", "Unassigned")], "table_name string, owner string, steward string")
    described = t.spark.createDataFrame([("contacts", 100.0), ("copied", 50.0)], "table_name string, documented_pct double")
    passed = rules.evaluate_all({"contacts": t.contacts}, MIXED[:4]).groupBy("table_name").agg((F.count_if("passed") * 100.0 / F.count(F.lit(1))).alias("overall_pass_rate"))
    scans = t.history.groupBy(F.when(F.col("table_name") == "click", "contacts").otherwise("events").alias("table_name")).agg(F.count(F.lit(1)).alias("total_scans"))
    return gov.trust_scores(scan.dimensions, scan.overall(), owners, described, passed, scans)


_TRUST = _DIMS_CTE.rstrip() + f""", own AS (SELECT * FROM (VALUES ('contacts', 100, 100), ('copied', 0, 50), ('events', 50, 0)) o(table_name, st, doc)),
  rr AS (SELECT 'contacts' AS table_name, count(*) FILTER (passed) * 100.0 / count(*) AS rc FROM ({result_sql("contacts", _BAD)})),
  sc AS (SELECT CASE WHEN event_type = 'click' THEN 'contacts' ELSE 'events' END AS table_name, count(*) AS n FROM {{events}} GROUP BY 1),
  tr AS (SELECT o.table_name, o.overall_score AS dq_score, c.score AS completeness, coalesce(f.score, 50) AS freshness, CAST(st AS DOUBLE) AS stewardship, CAST(doc AS DOUBLE) AS documentation, CAST(coalesce(rc, 50) AS DOUBLE) AS rule_compliance,
    CAST(CASE WHEN n >= 10 THEN 100 WHEN n >= 5 THEN 80 WHEN n >= 2 THEN 60 WHEN n >= 1 THEN 40 ELSE 0 END AS DOUBLE) AS scan_frequency, 50.0::DOUBLE AS lineage_coverage
    FROM overall o JOIN dims c ON c.table_name = o.table_name AND c.dimension = 'completeness' JOIN dims f ON f.table_name = o.table_name AND f.dimension = 'timeliness' JOIN own ON own.table_name = o.table_name
    LEFT JOIN rr ON rr.table_name = o.table_name LEFT JOIN sc ON sc.table_name = o.table_name),
  ts AS (SELECT *, dq_score * 0.30 + completeness * 0.15 + freshness * 0.15 + stewardship * 0.10 + documentation * 0.10 + rule_compliance * 0.10 + scan_frequency * 0.05 + lineage_coverage * 0.05 AS raw FROM tr),
  trust AS (SELECT * EXCLUDE (raw), round(raw, 1) AS trust_score, CASE WHEN raw >= 85 THEN 'Certified' WHEN raw >= 65 THEN 'Warning' ELSE 'Quarantined' END AS certification FROM ts)"""
add("g12_trust_scores", _trust, _TRUST + " SELECT * FROM trust")
add(
    "g13_trust_summary",
    lambda t: gov.trust_summary(_trust(t)),
    _TRUST + """ SELECT CAST(count(*) AS BIGINT) AS total_tables, CAST(count(*) FILTER (certification = 'Certified') AS BIGINT) AS certified, CAST(count(*) FILTER (certification = 'Warning') AS BIGINT) AS warning,
    CAST(count(*) FILTER (certification = 'Quarantined') AS BIGINT) AS quarantined, round(avg(trust_score), 1) AS avg_trust_score, (SELECT table_name FROM trust ORDER BY trust_score, table_name LIMIT 1) AS lowest_table, min(trust_score) AS lowest_score,
    (SELECT table_name FROM trust ORDER BY trust_score DESC, table_name DESC LIMIT 1) AS highest_table, max(trust_score) AS highest_score FROM trust""",
)
_RATE = COST_PARAMETERS["avg_analyst_hourly_rate"]


def _cost_sql() -> str:
    lack = lambda d: f"coalesce((100 - (SELECT score FROM dims x WHERE x.table_name = s.table_name AND dimension = '{d}')) / 100, 0)"
    return f""", sz AS (SELECT 'contacts' AS table_name, count(*) AS n FROM {{contacts}} UNION ALL SELECT 'copied', count(*) FROM {{copied}} UNION ALL SELECT 'events', count(*) FROM {{events}}),
    l AS (SELECT table_name, CAST(n AS BIGINT) AS row_count, {lack('completeness')} AS c, {lack('accuracy')} AS a, {lack('uniqueness')} AS u, {lack('validity')} AS v, {lack('timeliness')} AS t FROM sz s),
    k AS (SELECT table_name, row_count, round(floor(round(row_count * c, 6)) * 5 / 60 * {_RATE} * 12, 2)::DOUBLE AS completeness_cost,
      round((floor(round(24000000 * a * 0.001, 6)) * 25 + 4 * {_RATE} * 50 * a) * 12, 2)::DOUBLE AS accuracy_cost,
      round((floor(round(row_count * u, 6)) * 2 / 60 * {_RATE} + floor(floor(round(row_count * u, 6)) * 0.01) * 50) * 12, 2)::DOUBLE AS uniqueness_cost,
      round(floor(round(row_count * v, 6)) * 1000, 2)::DOUBLE AS validity_cost, round(t * 50 * 4 * {_RATE} * 0.5 * 12, 2)::DOUBLE AS timeliness_cost FROM l),
    costs AS (SELECT *, round(completeness_cost + accuracy_cost + uniqueness_cost + validity_cost + timeliness_cost, 2) AS total_cost FROM k)"""


add("g14_quality_cost", lambda t: gov.quality_cost(scan_all(t).wide()), _DIMS_CTE.rstrip() + _cost_sql() + " SELECT * FROM costs")
add(
    "g14_cost_summary",
    lambda t: gov.cost_summary(gov.quality_cost(scan_all(t).wide())),
    _DIMS_CTE.rstrip() + _cost_sql() + " SELECT round(sum(total_cost), 2) AS total_annual_cost, round(sum(total_cost) / 12, 2) AS total_monthly_cost, round(sum(total_cost) / 4100000000 * 100, 4) AS revenue_impact_pct FROM costs",
)


def _history_append(t):
    from lensdq.sources.writers import scratch_path

    path = scratch_path(t.spark, "history")
    wide = scan_all(t).wide()
    for day in ("2024-02-01 00:00:00", "2024-02-02 00:00:00"):
        gov.append_history(wide, path, day)
    return t.spark.read.parquet(path).select("table_name", F.date_format("scanned_at", "yyyy-MM-dd").alias("day"), "overall_score", "row_count", "completeness")


add(
    "g15_history_append",
    _history_append,
    _DIMS_CTE.rstrip() + """, sz AS (SELECT 'contacts' AS table_name, count(*) AS n FROM {contacts} UNION ALL SELECT 'copied', count(*) FROM {copied} UNION ALL SELECT 'events', count(*) FROM {events})
    SELECT o.table_name, day, overall_score, CAST(n AS BIGINT) AS row_count, c.score AS completeness FROM overall o JOIN sz USING (table_name) JOIN dims c ON c.table_name = o.table_name AND c.dimension = 'completeness', (VALUES ('2024-02-01'), ('2024-02-02')) d(day)""",
)
_STAMP = "yyyy-MM-dd HH:mm:ss"


def _history_chain(t):
    """Two stored scans, the second with the tables' places changed, read back and compared."""
    from lensdq.sources.writers import scratch_path

    path, rows = scratch_path(t.spark, "chain"), scan_all(t).history_rows().where("table_name <> 'events'")
    gov.append_history(rows, path, "2024-02-01 00:00:00")
    other = F.when(F.col("table_name") == "copied", "contacts").otherwise("copied")
    gov.append_history(rows.withColumn("table_name", other), path, "2024-02-02 00:00:00")
    store = t.spark.read.parquet(path)
    now = gov.latest_scans(store).select("table_name", "scan_id", "completeness_status", "uniqueness_status")
    return gov.degradation(store).select("table_name", "overall_change", "degraded").join(now, "table_name")


def _streamed(t):
    """Days of the events as a stream: two rules and a unique rule, appended to a history and read back."""
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.base_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    rules = [Rule("known_user", "user_id", "not_null"), Rule("small", "value", "range", {"max": 100})]
    place = scratch_path(t.spark, "stream")
    runs = [
        (streaming.windowed_results(source, rules, "ts", "1 day"), None, "rules"),
        (streaming.key_counts(source, ["user_id"], "ts", "1 day"), lambda closed: streaming.unique_results(closed, "once_a_day"), "unique"),
    ]
    found = []
    for results, fold, name in runs:
        query = streaming.record(results, f"{place}/{name}", f"{place}/{name}-state", fold, once=True)
        query.awaitTermination()
        found.append(streaming.history(t.spark, f"{place}/{name}").drop("batch_id"))
    return found[0].unionByName(found[1])


add(
    "g15_stream_history",
    _streamed,
    """WITH e AS (SELECT date_trunc('day', ts) AS d, user_id, value FROM {events} WHERE ts IS NOT NULL), closed AS (SELECT max(ts) - INTERVAL 1 HOUR AS upto FROM {events}),
    r AS (SELECT d, 'known_user' AS rule_id, count(*) AS n, count(*) FILTER (user_id IS NULL) AS f FROM e GROUP BY d
      UNION ALL SELECT d, 'small', count(*), count(*) FILTER (value > 100) FROM e GROUP BY d
      UNION ALL SELECT d, 'once_a_day', sum(n), coalesce(sum(n) FILTER (n > 1 AND user_id IS NOT NULL), 0) FROM (SELECT d, user_id, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY d)
    SELECT CAST(d AS TIMESTAMP) AS window_start, rule_id, CAST(n AS BIGINT) AS total_rows, CAST(f AS BIGINT) AS failing_rows, round((n - f) * 100.0 / n, 2) AS pass_rate FROM r, closed WHERE d + INTERVAL 1 DAY <= upto""",
)
add(
    "g15_stored_scans_compared",
    _history_chain,
    _DIMS_CTE.rstrip() + """, sw AS (SELECT * FROM (VALUES ('contacts', 'copied'), ('copied', 'contacts')) s(table_name, other))
    SELECT sw.table_name, round(b.overall_score - a.overall_score, 2) AS overall_change, round(b.overall_score - a.overall_score, 2) < -5 AS degraded, CAST(1706832000000000 AS BIGINT) AS scan_id,
    c.status AS completeness_status, u.status AS uniqueness_status FROM sw JOIN overall a ON a.table_name = sw.table_name JOIN overall b ON b.table_name = sw.other
    JOIN dims c ON c.table_name = sw.other AND c.dimension = 'completeness' JOIN dims u ON u.table_name = sw.other AND u.dimension = 'uniqueness'""",
)
add(
    "g16_history_trend",
    lambda t: gov.history_trend(t.history, 30, ["overall_score", "completeness"]).withColumn("scanned_at", F.date_format("scanned_at", _STAMP)),
    """SELECT * FROM (SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY scanned_at DESC, scan_id DESC) AS BIGINT) AS recency, strftime(scanned_at, '%Y-%m-%d %H:%M:%S') AS scanned_at, overall_score, completeness FROM {history}) WHERE recency <= 30""",
)
add(
    "g16_best_worst",
    lambda t: gov.best_worst(t.history).withColumns({c: F.date_format(c, _STAMP) for c in ("best_date", "worst_date")}),
    """SELECT table_name, CAST(count(*) AS BIGINT) AS total_scans, max(overall_score) AS best_score, strftime(arg_min(scanned_at, (-overall_score, scanned_at)), '%Y-%m-%d %H:%M:%S') AS best_date, min(overall_score) AS worst_score,
    strftime(arg_min(scanned_at, (overall_score, scanned_at)), '%Y-%m-%d %H:%M:%S') AS worst_date, arg_max(overall_score, (scanned_at, scan_id)) AS current_score, round(avg(overall_score), 2) AS avg_score FROM {history} GROUP BY 1""",
)
add(
    "g16_scan_frequency",
    lambda t: gov.scan_frequency(t.history, "2024-02-01 00:00:00").withColumns({c: F.date_format(c, _STAMP) for c in ("first_scan", "last_scan")}),
    """SELECT table_name, CAST(count(*) AS BIGINT) AS total_scans, strftime(min(scanned_at), '%Y-%m-%d %H:%M:%S') AS first_scan, strftime(max(scanned_at), '%Y-%m-%d %H:%M:%S') AS last_scan,
    CAST(count(*) FILTER (floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(scanned_at)) / 8.64e10) <= 7) AS BIGINT) AS scans_last_7_days, CAST(count(*) FILTER (floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(scanned_at)) / 8.64e10) <= 30) AS BIGINT) AS scans_last_30_days,
    round((epoch_us(max(scanned_at)) - epoch_us(min(scanned_at))) / 8.64e10 / (count(*) - 1), 2) AS avg_days_between_scans FROM {history} GROUP BY 1""",
)
_LATEST = "lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY scanned_at DESC, scan_id DESC) AS rk FROM {history}) WHERE rk <= 2)"
add(
    "g16_table_comparison",
    lambda t: gov.compare_tables(t.history),
    "WITH " + _LATEST + """ SELECT CAST(count(*) AS BIGINT) AS tables, arg_max(table_name, (overall_score, table_name)) AS best_table, arg_min(table_name, (overall_score, table_name)) AS worst_table, round(avg(overall_score), 2) AS avg_overall FROM lt WHERE rk = 1""",
)
_DEGRADE = _LATEST + """, dg AS (SELECT table_name, round(max(overall_score) FILTER (rk = 1) - max(overall_score) FILTER (rk = 2), 2) AS oc, round(max(completeness) FILTER (rk = 1) - max(completeness) FILTER (rk = 2), 2) AS cc,
    round(max(accuracy) FILTER (rk = 1) - max(accuracy) FILTER (rk = 2), 2) AS ac FROM lt GROUP BY 1 HAVING count(*) = 2)"""
_DEGRADE_OUT = """ SELECT table_name, oc AS overall_change, oc < -5 AS degraded, concat_ws(',', CASE WHEN cc < -5 THEN 'completeness' END, CASE WHEN ac < -5 THEN 'accuracy' END) AS degraded_dimensions,
    concat_ws(',', CASE WHEN cc > 5 THEN 'completeness' END, CASE WHEN ac > 5 THEN 'accuracy' END) AS improved_dimensions FROM dg"""
add("w08_previous_scan", lambda t: gov.degradation(t.history), "WITH " + _DEGRADE + _DEGRADE_OUT)
add(
    "w09_latest_per_key",
    lambda t: gov.latest_scans(t.history).withColumn("scanned_at", F.date_format("scanned_at", _STAMP)),
    "WITH " + _LATEST + " SELECT table_name, strftime(scanned_at, '%Y-%m-%d %H:%M:%S') AS scanned_at, scan_id, overall_score, completeness, accuracy FROM lt WHERE rk = 1",
)
add("g17_degradation", lambda t: gov.degradation(t.history, 20.0).select("table_name", "overall_change", "degraded"), "WITH " + _DEGRADE + " SELECT table_name, oc AS overall_change, oc < -20 AS degraded FROM dg")

# --- issues
_SEVERITY = "CASE issue_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END"
_STATE = """st AS (SELECT issue_id, CASE WHEN coalesce(ex, 'Open') = 'Open' AND sa IS NOT NULL AND (se IS NULL OR sa > se) THEN 'Assigned' ELSE coalesce(ex, 'Open') END AS status, coalesce(who, 'Unassigned') AS assigned_to,
  CAST(least(esc, 3) AS INTEGER) AS escalation_level, com AS comments, hist AS history_length, created_at, updated_at, resolved_at FROM (
    SELECT issue_id, min(event_ts) AS created_at, max(event_ts) AS updated_at, arg_max(details, (event_ts, seq)) FILTER (event = 'status') AS ex, max((event_ts, seq)) FILTER (event = 'status') AS se, max((event_ts, seq)) FILTER (event = 'assign') AS sa,
    arg_max(details, (event_ts, seq)) FILTER (event = 'assign') AS who, count(*) FILTER (event = 'escalate') AS esc, CAST(count(*) FILTER (event = 'comment') AS BIGINT) AS com, CAST(count(*) AS BIGINT) AS hist,
    max(event_ts) FILTER (event = 'status' AND details IN ('Resolved', 'Closed')) AS resolved_at FROM {issue_events} GROUP BY 1))"""
_ISSUES = _STATE + f""", iss AS (SELECT *, {_SEVERITY} AS severity, 'table_' || (issue_id % 5) AS table_name, created_at + INTERVAL 1 HOUR * CASE issue_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 72 WHEN 2 THEN 168 ELSE 720 END AS due_at FROM st)"""
ISSUE_AS_OF = "2024-01-25 00:00:00"


def issues(t):
    state = gov.issue_state(t.issue_events)
    full = state.withColumn("severity", F.expr(_SEVERITY)).withColumn("table_name", F.concat(F.lit("table_"), (F.col("issue_id") % 5).cast("string")))
    return full.withColumn("due_at", gov.due_at(F.col("created_at"), F.col("severity")))


def _findings(t):
    r = scan_all(t).recommendations()
    return r.select("table_name", "dimension", "priority", F.concat(F.initcap("dimension"), F.lit(" score is low in "), "table_name").alias("finding"))


def _new_issues(t):
    known = t.sql("SELECT event_type, count(*) AS n FROM {events} GROUP BY 1").select(
        F.regexp_replace("event_type", "^.*$", "contacts").alias("table_name"), F.regexp_replace("event_type", "^.*$", "validity").alias("dimension"), F.concat(F.lit("Validity score is low in contacts since "), "event_type").alias("title"), F.when(F.col("event_type") == "view", "Open").otherwise("Closed").alias("status"))
    return gov.issues_from_findings(_findings(t), known, "2024-02-01 00:00:00").select("table_name", "dimension", "severity", "title", F.date_format("due_at", _STAMP).alias("due_at"))


add(
    "g18_issues_from_scan",
    _new_issues,
    _DIMS_CTE + """SELECT table_name, dimension, priority AS severity, upper(dimension[1]) || dimension[2:] || ' score is low in ' || table_name AS title,
    CASE priority WHEN 'CRITICAL' THEN '2024-02-02 00:00:00' ELSE '2024-02-04 00:00:00' END AS due_at FROM recs WHERE priority IN ('CRITICAL', 'HIGH') AND NOT (table_name = 'contacts' AND dimension = 'validity')""",
)
add(
    "g19_issue_state",
    lambda t: gov.issue_state(t.issue_events).select(
        "issue_id", "status", "assigned_to", "escalation_level", "comments", "history_length", F.date_format("created_at", _STAMP).alias("created_at"), F.date_format("resolved_at", _STAMP).alias("resolved_at")
    ),
    "WITH " + _STATE + " SELECT issue_id, status, assigned_to, escalation_level, comments, history_length, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(resolved_at, '%Y-%m-%d %H:%M:%S') AS resolved_at FROM st",
)
_LATE = f"status IN ('Open', 'Assigned', 'In Progress') AND due_at < TIMESTAMP '{ISSUE_AS_OF}'"
add(
    "g20_sla_breaches",
    lambda t: gov.sla_breaches(issues(t), ISSUE_AS_OF),
    "WITH " + _ISSUES + f" SELECT issue_id, severity, round((epoch_us(TIMESTAMP '{ISSUE_AS_OF}') - epoch_us(due_at)) / 3.6e9, 1) AS hours_overdue FROM iss WHERE {_LATE}",
)
add(
    "g21_issue_dashboard",
    lambda t: gov.issue_dashboard(issues(t), ISSUE_AS_OF),
    "WITH " + _ISSUES + f""" SELECT CAST(count(*) FILTER (status IN ('Open', 'Assigned', 'In Progress')) AS BIGINT) AS total_open, CAST(count(*) FILTER (status IN ('Resolved', 'Verified', 'Closed')) AS BIGINT) AS total_resolved,
    CAST(count(*) FILTER (status = 'Wont Fix') AS BIGINT) AS total_wont_fix, CAST(count(*) FILTER ({_LATE}) AS BIGINT) AS sla_breaches,
    coalesce(round(avg((epoch_us(resolved_at) - epoch_us(created_at)) / 3.6e9) FILTER (status IN ('Resolved', 'Verified', 'Closed')), 1), 0) AS avg_resolution_hours,
    arg_min(issue_id, (created_at, issue_id)) FILTER (status IN ('Open', 'Assigned', 'In Progress')) AS oldest_open, CAST(count(*) FILTER (status IN ('Open', 'Assigned', 'In Progress') AND assigned_to = 'Unassigned') AS BIGINT) AS unassigned FROM iss""",
)
add(
    "g21_issue_counts",
    lambda t: gov.issue_counts(issues(t)),
    "WITH " + _ISSUES + " " + " UNION ALL ".join(f"SELECT '{g}' AS grouping, {c} AS label, CAST(count(*) AS BIGINT) AS n FROM iss GROUP BY 2" for g, c in (("severity", "severity"), ("status", "status"), ("table", "table_name"))),
)
add(
    "g21_recently_resolved",
    lambda t: gov.recently_resolved(issues(t)).withColumn("resolved_at", F.date_format("resolved_at", _STAMP)),
    "WITH " + _ISSUES + " SELECT issue_id, strftime(resolved_at, '%Y-%m-%d %H:%M:%S') AS resolved_at FROM (SELECT issue_id, resolved_at FROM iss WHERE status IN ('Resolved', 'Verified', 'Closed') AND resolved_at IS NOT NULL ORDER BY resolved_at DESC, issue_id LIMIT 5)",
)


def _stewarded(t):
    stewards = t.nation.select(F.concat(F.lit("table_"), (F.col("n_nationkey") * 2).cast("string")).alias("table_name"), F.col("n_name").alias("steward"))
    return gov.steward_of(issues(t), stewards).groupBy("steward").agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("status") == "Open").alias("open"))


add(
    "g21_steward_lookup",
    _stewarded,
    "WITH " + _ISSUES + """ SELECT coalesce(n_name, 'Unassigned') AS steward, CAST(count(*) AS BIGINT) AS issues, CAST(count(*) FILTER (status = 'Open') AS BIGINT) AS open FROM iss LEFT JOIN {nation} ON 'table_' || (n_nationkey * 2) = table_name GROUP BY 1""",
)


def _incidents(t):
    drift = observe.schema_drift(observe.schema_snapshot(t.customer), observe.schema_snapshot(t.customer_next)).withColumn("table_name", F.lit("customer"))
    volume = observe.volume_anomaly(t.customer_next, t.customer.agg(F.count(F.lit(1)).alias("row_count"))).withColumn("table_name", F.lit("customer"))
    return gov.automatic_incidents(gov.degradation(t.history), drift, volume)


add(
    "g22_automatic_incidents",
    _incidents,
    "WITH " + _DEGRADE + """ SELECT table_name, 'Data Quality' AS category, 'HIGH' AS severity, abs(oc) AS magnitude, 'Open' AS status FROM dg WHERE oc < -5
    UNION ALL SELECT 'customer', 'Schema', 'CRITICAL', 4.0 - CASE WHEN (SELECT count(*) FROM {customer_next} WHERE c_acctbal IS NULL) > 0 THEN 0 ELSE 1 END, 'Open'
    UNION ALL SELECT 'customer', 'Volume', 'HIGH', abs(p), 'Open' FROM (SELECT round((c - b) * 100.0 / b, 1) AS p FROM (SELECT count(*) AS c FROM {customer_next}), (SELECT count(*) AS b FROM {customer})) WHERE abs(p) > 20""",
)
add(
    "g23_incident_stats",
    lambda t: gov.incident_stats(t.incident),
    """SELECT CAST(count(*) AS BIGINT) AS total_incidents, CAST(count(*) FILTER (status IN ('Open', 'Acknowledged')) AS BIGINT) AS open, CAST(count(*) FILTER (status = 'Resolved') AS BIGINT) AS resolved, CAST(count(*) FILTER (status = 'Closed') AS BIGINT) AS closed,
    round(avg((epoch_us(resolved_at) - epoch_us(detected_at)) / 3.6e9), 1) AS mttr, CAST(count(*) FILTER (postmortem_complete) AS BIGINT) AS postmortems_complete, CAST(count(*) FILTER (status = 'Resolved' AND NOT postmortem_complete) AS BIGINT) AS postmortems_pending,
    (SELECT root_cause FROM {incident} WHERE root_cause IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) AS most_common_root_cause FROM {incident}""",
)
add(
    "g23_incidents_by_severity",
    lambda t: gov.incidents_by_severity(t.incident),
    "SELECT category, severity, n, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, severity) AS BIGINT) AS rank FROM (SELECT category, severity, CAST(count(*) AS BIGINT) AS n FROM {incident} GROUP BY 1, 2)",
)


def _session(t):
    chosen = {n: getattr(t, n) for n in ("region", "nation", "customer")}
    sizes = t.spark.createDataFrame([(n, df.count(), len(df.columns)) for n, df in chosen.items()], "table_name string, row_count bigint, column_count bigint")
    return gov.session_summary(sizes, relate.suffix_foreign_keys(relate.schema_frame(t.spark, chosen)))


add(
    "g24_session_summary",
    _session,
    "SELECT CAST(3 AS BIGINT) AS table_count, CAST(a + b + c AS BIGINT) AS total_rows, CAST(10 AS BIGINT) AS total_columns, 'customer' AS primary_table, CAST(2 AS BIGINT) AS relationship_count FROM (SELECT count(*) AS a FROM {region}), (SELECT count(*) AS b FROM {nation}), (SELECT count(*) AS c FROM {customer})",
)


def _validated(t):
    return validate_and_catalog(t.contacts, "contacts", "2024-02-01 00:00:00", owner="Ana", steward="Li")


_COMP = f"""cm AS (SELECT round(avg(score), 1) AS compliance_score, CAST(count(*) FILTER (NOT compliant) AS BIGINT) AS compliance_gaps FROM ass WHERE table_name = 'contacts')"""
add(
    "q34_validate_and_catalog",
    _validated,
    _DIMS_CTE.rstrip() + ", " + _MAP2 + ", " + _COMP + """ SELECT 'contacts' AS table_name, overall_score, CASE WHEN overall_score >= 90 THEN 'PASS' WHEN overall_score >= 70 THEN 'WARN' ELSE 'FAIL' END AS scan_status,
    (SELECT CAST(count(*) AS BIGINT) FROM {contacts}) AS row_count, CAST(8 AS BIGINT) AS column_count, CAST(2 AS BIGINT) AS pii_columns, compliance_score, compliance_gaps, round(raw, 1) AS trust_score,
    CASE WHEN raw >= 85 THEN 'Certified' WHEN raw >= 65 THEN 'Warning' ELSE 'Quarantined' END AS certification FROM (SELECT overall_score, overall_score * 0.30 + c.score * 0.15 + 50 * 0.15 + 100 * 0.10 + 100 * 0.10 + 50 * 0.10 + 0 + 50 * 0.05 AS raw
    FROM overall o JOIN dims c ON c.table_name = o.table_name AND c.dimension = 'completeness' WHERE o.table_name = 'contacts'), cm""",
)
