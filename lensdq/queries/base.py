"""Registry of runnable queries over the driver tables, each beside its independent SQL statement."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lensdq.session import read_table

AS_OF = "2002-01-01 00:00:00"
TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Views derived from the driver tables with statements both engines accept. The tables hold no
# nulls and no repeated rows, so gaps, copies and changed snapshots are made here over whole tables.
DERIVED = {
    "gappy": """
        SELECT l_orderkey, l_linenumber AS line, nullif(l_linenumber, 3) AS l_linenumber,
               CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax END AS l_tax,
               CASE WHEN l_linenumber < 6 THEN NULL ELSE l_shipdate END AS l_shipdate,
               nullif(l_returnflag, 'A') AS l_returnflag, l_quantity
        FROM {lineitem}""",
    "copied": """
        SELECT c_nationkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS c_standing
        FROM {customer}""",
    "contacts": """
        SELECT c_custkey,
               CASE WHEN c_nationkey < 20 THEN concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com')
                    ELSE concat('user', CAST(c_custkey AS VARCHAR(20))) END AS email,
               CASE WHEN c_nationkey < 22 THEN concat('+1-555-', CAST(1000000 + c_custkey AS VARCHAR(20)))
                    ELSE '555' END AS phone,
               CASE WHEN c_nationkey < 24 THEN CAST(10000 + c_custkey AS VARCHAR(20)) ELSE 'n/a' END AS zip,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'ftp://x' ELSE 'https://x.example' END AS website,
               CASE WHEN c_mktsegment = 'BUILDING' THEN '  ' ELSE c_name END AS label,
               c_acctbal AS balance,
               CASE WHEN c_nationkey = 7 THEN '0' ELSE '1' END AS flag
        FROM {customer}""",
    "spans": """
        SELECT l.l_orderkey, l.l_linenumber, o.o_orderdate AS start_date, l.l_shipdate AS end_date
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "customer_next": """
        SELECT c_custkey + 100 AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
               CASE WHEN c_acctbal > 9000 THEN NULL ELSE c_acctbal * 1.2 END AS c_acctbal,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS segment
        FROM {customer} WHERE c_nationkey < 19""",
    "history": """
        SELECT event_type AS table_name, ts AS scanned_at, event_id AS scan_id, round(least(value, 100.0), 1) AS overall_score,
               CAST(user_id % 101 AS DOUBLE) AS completeness, CAST((user_id * 7) % 101 AS DOUBLE) AS accuracy
        FROM {events}""",
    "issue_events": """
        SELECT user_id * 10 + event_id % 10 AS issue_id, ts AS event_ts, event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'assign' WHEN 'purchase' THEN 'status'
                    WHEN 'view' THEN 'comment' ELSE 'escalate' END AS event,
               CASE WHEN event_type = 'click' THEN concat('steward', CAST(event_id % 9 AS VARCHAR(5)))
                    WHEN event_type = 'purchase' THEN CASE event_id % 7 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Resolved'
                         WHEN 3 THEN 'Closed' WHEN 4 THEN 'Wont Fix' WHEN 5 THEN 'Verified' ELSE 'Open' END END AS details
        FROM {events}""",
    "incident": """
        SELECT event_id AS incident_id,
               CASE event_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               CASE user_id % 3 WHEN 0 THEN 'Schema' WHEN 1 THEN 'Volume' ELSE 'Data Quality' END AS category,
               CASE event_id % 5 WHEN 0 THEN 'Open' WHEN 1 THEN 'Acknowledged' WHEN 2 THEN 'Resolved' ELSE 'Closed' END AS status, ts AS detected_at,
               CASE WHEN event_id % 5 > 1 THEN ts + INTERVAL '1' HOUR * CAST(1 + user_id % 50 AS INTEGER) END AS resolved_at,
               CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 'Source change' ELSE 'Pipeline' END AS root_cause,
               event_id % 3 = 0 AS postmortem_complete
        FROM {events}""",
    "inventory": """
        SELECT concat('D', CAST(o_orderkey AS VARCHAR(20))) AS dashboard_id, concat('Report ', CAST(o_orderkey AS VARCHAR(20))) AS dashboard_name,
               o_orderpriority AS workspace, concat('owner', CAST(o_custkey % 300 AS VARCHAR(20)), '@example.com') AS owner_email,
               CASE o_orderstatus WHEN 'F' THEN 'Power BI' WHEN 'O' THEN 'Tableau' ELSE 'Qlik' END AS platform,
               CAST(o_orderdate + INTERVAL '24' YEAR AS DATE) AS created_date,
               CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE DATE '2026-02-01' - CAST((o_custkey * 7) % 800 AS INTEGER) END AS last_viewed_date,
               CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(o_custkey % 60 AS INTEGER) END AS view_count_30d,
               CASE o_orderkey % 6 WHEN 0 THEN '4x daily' WHEN 1 THEN '2x daily' WHEN 2 THEN '1x daily' WHEN 3 THEN 'weekly' WHEN 4 THEN 'manual' ELSE 'none' END AS refresh_schedule,
               CASE WHEN o_orderkey % 2 = 0 THEN concat('fact_', CAST(o_custkey % 90 AS VARCHAR(5)), ', dim_', CAST(o_orderkey % 70 AS VARCHAR(5)))
                    ELSE concat('dim_', CAST(o_orderkey % 70 AS VARCHAR(5)), ',fact_', CAST(o_custkey % 90 AS VARCHAR(5))) END AS source_tables,
               CAST(10 + o_custkey % 4000 AS INTEGER) AS dataset_size_mb, CAST(1 + o_orderkey % 25 AS INTEGER) AS num_visuals, o_orderkey % 7 = 0 AS is_certified
        FROM {orders}""",
    "lineage_nodes": """
        SELECT concat('region:', CAST(r_regionkey AS VARCHAR(20))) AS id, 'source_system' AS type, r_name AS name FROM {region}
        UNION ALL SELECT concat('nation:', CAST(n_nationkey AS VARCHAR(20))), 'database', n_name FROM {nation}
        UNION ALL SELECT concat('customer:', CAST(c_custkey AS VARCHAR(20))), 'table', c_name FROM {customer}
        UNION ALL SELECT concat('order:', CAST(o_orderkey AS VARCHAR(20))), CASE WHEN o_orderstatus = 'F' THEN 'dashboard' ELSE 'column' END, o_orderpriority FROM {orders}""",
    "lineage_edges": """
        SELECT concat('region:', CAST(n_regionkey AS VARCHAR(20))) AS source, concat('nation:', CAST(n_nationkey AS VARCHAR(20))) AS target, 'feeds' AS relationship FROM {nation}
        UNION ALL SELECT concat('nation:', CAST(c_nationkey AS VARCHAR(20))), concat('customer:', CAST(c_custkey AS VARCHAR(20))), 'feeds' FROM {customer}
        UNION ALL SELECT concat('customer:', CAST(o_custkey AS VARCHAR(20))), concat('order:', CAST(o_orderkey AS VARCHAR(20))), 'used_by' FROM {orders}""",
    "sales": """
        SELECT o.o_orderkey, o.o_orderdate, o.o_orderpriority, o.o_orderstatus, c.c_mktsegment, n.n_name, r.r_name,
               o.o_totalprice AS sales, o.o_totalprice * 0.2 - 20000 AS profit
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
             JOIN {nation} n ON c.c_nationkey = n.n_nationkey
             JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
}


def placeholders(text: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(text) if name})


class Tables:
    """Driver tables and derived views by attribute."""

    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark, self.base_dir = spark, base_dir
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = (
                self.sql(DERIVED[name]) if name in DERIVED else read_table(self.spark, self.base_dir, name)
            )
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in placeholders(text)})


def duck(text: str) -> str:
    """The DuckDB form of a statement: derived views become leading common table expressions."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in placeholders(body):
            if name in DERIVED:
                visit(DERIVED[name])
                if name not in needed:
                    needed.append(name)

    visit(text)
    plain = {n: n for n in [*TABLE_NAMES, *DERIVED]}
    body = text.format(**plain).strip()
    if not needed:
        return body
    ctes = ", ".join(f"{n} AS ({DERIVED[n].format(**plain).strip()})" for n in needed)
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{ctes}, {body[len(head):]}"
    return f"WITH {ctes} {body}"


def each(names, template: str, joiner: str = "\nUNION ALL\n") -> str:
    """``template`` once per column, with @c the column name and @i its position."""
    return joiner.join(template.replace("@c", n).replace("@i", str(i)) for i, n in enumerate(names))


class Suite:
    def __init__(self) -> None:
        self.runs: dict[str, Callable[[Tables], DataFrame]] = {}
        self.statements: dict[str, str] = {}

    def add(self, name: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        if name in self.runs:
            raise ValueError(f"query {name} is already registered")
        self.runs[name] = run
        if sql is not None:
            self.statements[name] = duck(sql)

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(run):
            def call(spark: SparkSession, base_dir: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return run(Tables(spark, base_dir))

            return call

        return {name: bind(run) for name, run in self.runs.items()}
