"""Rule queries (R01-R17) and interactive filters (F01-F03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensdq.operators import present, rules
from lensdq.operators.rules import Rule
from lensdq.queries.base import Suite

suite = Suite()
add = suite.add

_SHORT = ["rule_id", "total_rows", "failing_rows", "passing_rows", "pass_rate", "passed"]


def result_sql(table: str, conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{rid}' AS rule_id, CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER ({bad}) AS BIGINT) AS failing_rows,
        CAST(count(*) - count(*) FILTER ({bad}) AS BIGINT) AS passing_rows,
        round((count(*) - count(*) FILTER ({bad})) * 100.0 / count(*), 2) AS pass_rate, count(*) FILTER ({bad}) = 0 AS passed FROM {{{table}}}"""
        for rid, bad in conditions.items()
    )


def simple(name: str, table: str, checks: list[tuple[Rule, str]], references=()) -> None:
    add(
        name,
        lambda t: rules.evaluate(getattr(t, table), [r for r, _ in checks], {n: getattr(t, n) for n in references}).select(*_SHORT),
        result_sql(table, {r.id: bad for r, bad in checks}),
    )


simple("r01_not_null", "gappy", [(Rule("tax_present", "l_tax", "not_null"), "l_tax IS NULL"), (Rule("flag_present", "l_returnflag", "not_null"), "l_returnflag IS NULL")])
simple(
    "r02_unique", "gappy",
    [(Rule("order_once", "l_orderkey", "unique"), "l_orderkey IN (SELECT l_orderkey FROM {gappy} GROUP BY 1 HAVING count(*) > 1)"),
     (Rule("ship_once", "l_shipdate", "unique"), "l_shipdate IS NULL OR l_shipdate IN (SELECT l_shipdate FROM {gappy} GROUP BY 1 HAVING count(*) > 1)")],
)
simple(
    "r03_range", "customer",
    [(Rule("balance_min", "c_acctbal", "range", {"min": 0}), "c_acctbal < 0"),
     (Rule("balance_open", "c_acctbal", "range", {"min": 0, "max": 9000, "inclusive": False}), "c_acctbal <= 0 OR c_acctbal >= 9000"),
     (Rule("name_number", "c_name", "range", {"min": 5}), "false")],
)
simple(
    "r04_regex", "contacts",
    [(Rule("mail", "email", "regex", {"pattern": r"[^@\s]+@[^@\s]+\.[a-z]+", "match_type": "full"}), r"NOT regexp_full_match(email, '[^@\s]+@[^@\s]+\.[a-z]+')"),
     (Rule("user_prefix", "email", "regex", {"pattern": "user1", "match_type": "prefix"}), "NOT starts_with(email, 'user1')"),
     (Rule("has_at", "email", "regex", {"pattern": "@", "match_type": "contains"}), "NOT contains(email, '@')")],
)
simple("r05_in_list", "orders", [(Rule("open_or_filled", "o_orderstatus", "in_list", {"values": ["O", "F"]}), "o_orderstatus NOT IN ('O', 'F')")])
simple("r06_not_in_list", "orders", [(Rule("no_urgent", "o_orderpriority", "not_in_list", {"values": ["1-URGENT"]}), "o_orderpriority = '1-URGENT'")])
simple(
    "r07_custom_expression", "lineitem",
    [(Rule("net_price", None, "custom_expression", {"expression": "l_extendedprice * (1 - l_discount) > 5000 OR l_tax = 0"}),
      "NOT coalesce(l_extendedprice * (1 - l_discount) > 5000 OR l_tax = 0, false)")],
)
simple(
    "r08_cross_column", "spans",
    [(Rule("ends_after_start", "start_date", "cross_column", {"operator": "<=", "column_b": "end_date"}), "start_date > end_date"),
     (Rule("not_same_day", "start_date", "cross_column", {"operator": "!=", "column_b": "end_date"}), "start_date = end_date")],
)
add(
    "r09_referential",
    lambda t: rules.evaluate(
        t.orders,
        [Rule("known_customer", "o_custkey", "referential", {"reference_table": "CUSTOMER", "reference_column": "C_CUSTKEY"}),
         Rule("known_next", "o_custkey", "referential", {"reference_table": "customer_next", "reference_column": "c_custkey"})],
        {"customer": t.customer, "customer_next": t.customer_next},
    ).select(*_SHORT),
    result_sql("orders", {"known_customer": "o_custkey NOT IN (SELECT c_custkey FROM {customer})", "known_next": "o_custkey NOT IN (SELECT c_custkey FROM {customer_next})"}),
)
simple(
    "r10_length", "part",
    [(Rule("name_length", "p_name", "length", {"min_length": 9, "max_length": 12}), "length(p_name) < 9 OR length(p_name) > 12"),
     (Rule("type_short", "p_type", "length", {"max_length": 6}), "length(p_type) > 6")],
)
simple(
    "r11_type_check", "contacts",
    [(Rule("zip_number", "zip", "type_check", {"expected_type": "numeric"}), "TRY_CAST(zip AS DOUBLE) IS NULL"),
     (Rule("flag_boolean", "flag", "type_check", {"expected_type": "boolean"}), "flag NOT IN ('0', '1')"),
     (Rule("mail_text", "email", "type_check", {"expected_type": "string"}), "false"),
     (Rule("balance_text", "balance", "type_check", {"expected_type": "string"}), "true"),
     (Rule("label_date", "label", "type_check", {"expected_type": "date"}), "TRY_CAST(label AS TIMESTAMP) IS NULL")],
)
MIXED = [
    Rule("balance_min", "balance", "range", {"min": 0}, severity="CRITICAL", category="Accuracy"),
    Rule("mail", "email", "regex", {"pattern": "@", "match_type": "contains"}, severity="LOW"),
    Rule("one_flag", "flag", "in_list", {"values": ["1"]}, severity="HIGH"),
    Rule("label_given", "label", "regex", {"pattern": "^Customer", "match_type": "contains"}, severity="CRITICAL", category="Completeness", regulatory_tag="KYC"),
    Rule("ghost", "no_such_column", "not_null", category="Completeness"),
    Rule("off", "email", "not_null", enabled=False),
]
_BAD = {"balance_min": "balance < 0", "mail": "NOT contains(email, '@')", "one_flag": "flag <> '1'", "label_given": "NOT starts_with(label, 'Customer')"}
add(
    "r12_failing_examples",
    lambda t: rules.failing_examples(t.contacts, MIXED[:4], "c_custkey"),
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{rid}' AS rule_id, CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS rank, c_custkey AS row_key,
        CAST({r.column} AS VARCHAR) AS value FROM {{contacts}} WHERE {_BAD[rid]}) WHERE rank <= 10"""
        for r in MIXED[:4] for rid in [r.id]
    ),
)
_META = "(VALUES " + ", ".join(
    f"('{r.id}', '{r.category}', '{r.severity}')" for r in MIXED[:5]
) + ") m(rule_id, category, severity)"
_EVAL = f"""WITH res AS ({result_sql("contacts", _BAD)}), j AS (SELECT m.*, r.passed FROM {_META} LEFT JOIN res r USING (rule_id))"""
add(
    "r13_evaluate_all",
    lambda t: rules.summarise(rules.evaluate_all({"contacts": t.contacts}, MIXED)),
    _EVAL + " UNION ALL ".join(
        f"""SELECT '{lv}' AS level, {lab} AS label, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (passed) AS BIGINT) AS passed_rules,
        CAST(count(*) FILTER (NOT passed) AS BIGINT) AS failed_rules, CAST(count(*) FILTER (passed IS NULL) AS BIGINT) AS errors,
        CAST(count(*) FILTER (NOT passed AND severity = 'CRITICAL') AS BIGINT) AS critical_failures,
        round(count(*) FILTER (passed) * 100.0 / count(*), 2) AS overall_pass_rate FROM j {grp}"""
        for lv, lab, grp in (("all", "'*'", ""), ("category", "category", "GROUP BY category"), ("severity", "severity", "GROUP BY severity"))
    ),
)


def _preset(t, preset, tables):
    chosen = {n: getattr(t, n) for n in tables}
    return rules.evaluate_all(
        chosen, rules.apply_preset(preset, chosen), {**chosen, "nation": t.nation, "customer": t.customer}
    ).select("table_name", "column_name", "rule_type", "severity", "failing_rows", "passed")


def preset_sql(rows: list[tuple[str, str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{tab}' AS table_name, '{col}' AS column_name, '{typ}' AS rule_type, '{sev}' AS severity,
        CAST(count(*) FILTER ({bad}) AS BIGINT) AS failing_rows, count(*) FILTER ({bad}) = 0 AS passed FROM {{{tab}}}"""
        for tab, col, typ, sev, bad in rows
    )


_STATUS_BAD = "{} NOT IN ('Active', 'Inactive', 'Pending', 'Closed', 'Suspended')"
add(
    "r14_financial_preset",
    lambda t: _preset(t, rules.FINANCIAL_PRESET, ["customer", "orders", "lineitem", "contacts"]),
    preset_sql([
        ("customer", "c_name", "not_null", "HIGH", "c_name IS NULL"),
        ("customer", "c_acctbal", "range", "HIGH", "c_acctbal < 0"),
        ("customer", "c_nationkey", "length", "MEDIUM", "length(CAST(c_nationkey AS VARCHAR)) < 2 OR length(CAST(c_nationkey AS VARCHAR)) > 3"),
        ("orders", "o_totalprice", "range", "CRITICAL", "o_totalprice < 0"),
        ("orders", "o_orderstatus", "in_list", "MEDIUM", _STATUS_BAD.format("o_orderstatus")),
        ("lineitem", "l_extendedprice", "range", "CRITICAL", "l_extendedprice < 0"),
        ("lineitem", "l_linestatus", "in_list", "MEDIUM", _STATUS_BAD.format("l_linestatus")),
        ("contacts", "balance", "range", "HIGH", "balance < 0"),
        ("contacts", "email", "regex", "LOW", r"NOT regexp_full_match(email, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+')"),
        ("contacts", "phone", "regex", "LOW", r"NOT regexp_full_match(phone, '\+?[\d\s\-\(\)]{{7,20}}')"),
    ]),
)
add(
    "r15_tpch_preset",
    lambda t: _preset(t, rules.TPCH_PRESET, ["orders", "lineitem", "customer", "supplier"]),
    preset_sql([
        ("orders", "o_totalprice", "range", "CRITICAL", "o_totalprice < 0.01"),
        ("orders", "o_orderstatus", "in_list", "HIGH", "o_orderstatus NOT IN ('F', 'O', 'P')"),
        ("lineitem", "l_quantity", "range", "CRITICAL", "l_quantity < 1"),
        ("lineitem", "l_extendedprice", "range", "CRITICAL", "l_extendedprice < 0"),
        ("lineitem", "l_discount", "range", "MEDIUM", "l_discount < 0 OR l_discount > 1"),
        ("lineitem", "l_tax", "range", "MEDIUM", "l_tax < 0 OR l_tax > 0.1"),
        ("customer", "c_acctbal", "not_null", "HIGH", "c_acctbal IS NULL"),
        ("customer", "c_nationkey", "referential", "CRITICAL", "c_nationkey NOT IN (SELECT n_nationkey FROM {nation})"),
        ("orders", "o_custkey", "referential", "CRITICAL", "o_custkey NOT IN (SELECT c_custkey FROM {customer})"),
        ("supplier", "s_nationkey", "referential", "HIGH", "s_nationkey NOT IN (SELECT n_nationkey FROM {nation})"),
    ]),
)


def _rule_sets(t):
    results = rules.evaluate_all({"contacts": t.contacts}, MIXED)
    sets = t.spark.createDataFrame([("kyc", "label_given"), ("kyc", "mail"), ("money", "balance_min")], "set_name string, rule_id string")
    chosen = rules.in_rule_set(results, sets, "kyc").withColumn("picked_by", F.lit("set:kyc"))
    tagged = rules.by_tag(results, "kyc").withColumn("picked_by", F.lit("tag:KYC"))
    cat = rules.by_category(results, "accuracy").withColumn("picked_by", F.lit("category:Accuracy"))
    return chosen.unionByName(tagged).unionByName(cat).select("picked_by", "rule_id", "failing_rows")


add(
    "r16_rule_sets",
    _rule_sets,
    f"""WITH res AS ({result_sql("contacts", _BAD)})
    SELECT 'set:kyc' AS picked_by, rule_id, failing_rows FROM res WHERE rule_id IN ('label_given', 'mail')
    UNION ALL SELECT 'tag:KYC', rule_id, failing_rows FROM res WHERE rule_id = 'label_given'
    UNION ALL SELECT 'category:Accuracy', rule_id, failing_rows FROM res WHERE rule_id = 'balance_min'""",
)
add(
    "r17_quarantine",
    lambda t: rules.quarantine(t.contacts, MIXED[:4]).select("c_custkey", F.array_join("failed_rules", ",").alias("failed_rules")),
    "SELECT c_custkey, concat_ws(',', " + ", ".join(f"CASE WHEN {b} THEN '{r}' END" for r, b in _BAD.items()) + ") AS failed_rules FROM {contacts}",
)

add(
    "r17_quarantine_unique_referential",
    lambda t: rules.quarantine(
        t.orders,
        [rules.Rule("one_price", "o_totalprice", "unique"), rules.Rule("known_customer", "o_custkey", "referential", {"reference_table": "buyers", "reference_column": "c_custkey"}),
         rules.Rule("is_open", "o_orderstatus", "in_list", {"values": ["O", "P"]})],
        {"buyers": t.customer.where("c_mktsegment <> 'BUILDING'")},
    ).select("o_orderkey", F.array_join("failed_rules", ",").alias("failed_rules")),
    """SELECT o_orderkey, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY o_totalprice) > 1 THEN 'one_price' END,
    CASE WHEN NOT EXISTS (SELECT 1 FROM {customer} WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING') THEN 'known_customer' END,
    CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN 'is_open' END) AS failed_rules FROM {orders}""",
)

add(
    "f01_equality_filter",
    lambda t: present.equality_filter(t.lineitem, {"l_returnflag": "R", "l_linenumber": "3", "l_linestatus": "__ALL__"}).select(
        "l_orderkey", "l_linenumber", "l_quantity"
    ),
    "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_returnflag = 'R' AND CAST(l_linenumber AS VARCHAR) = '3'",
)
add(
    "f02_filter_values",
    lambda t: present.filter_values(t.part, ["p_brand", "p_type", "p_name"]),
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, v AS value FROM (SELECT DISTINCT {c} AS v FROM {{part}} ORDER BY 1 LIMIT 100)" for c in ("p_brand", "p_type", "p_name")
    ),
)
add(
    "f03_footnote_filter",
    lambda t: present.footnote_report(t.sql("SELECT CASE WHEN p_type = 'PROMO' THEN concat('* ', p_name) ELSE p_name END AS label, p_size FROM {part}")),
    """SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER (p_type = 'PROMO') AS BIGINT) AS dropped_rows,
       CAST(count(*) FILTER (p_type <> 'PROMO') AS BIGINT) AS kept_rows FROM {part}""",
)
