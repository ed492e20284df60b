"""Word lists, weights and thresholds that results depend on."""

# Placeholder strings treated as suspect data.
SUSPECT_VALUES = [
    "n/a", "na", "null", "none", "test", "xxx", "tbd", "unknown", "-", "0", ".", "..", "---",
    "missing", "temp",
]

# Column-name parts that promise non-negative numbers.
POSITIVE_NAME_HINTS = [
    "amount", "price", "quantity", "count", "age", "balance", "revenue", "cost", "total", "salary",
    "weight", "height",
]

# Format patterns of the consistency dimension, in evaluation order.
FORMAT_PATTERNS = {
    "all_upper": r"^[A-Z0-9\s\-]+$",
    "all_lower": r"^[a-z0-9\s\-]+$",
    "title_case": r"^[A-Z][a-z]",
    "email": r"^[^@]+@[^@]+\.[^@]+$",
    "numeric_string": r"^\d+\.?\d*$",
}

# Name-hinted validity formats for text columns: (hints, rule, pattern).
TEXT_FORMAT_RULES = [
    (["email"], "email_format", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    (["phone", "tel"], "phone_format", None),
    (["zip", "postal"], "postal_format", r"^\d{4,10}$|^\d{5}-\d{4}$|^[A-Z]\d[A-Z]\s?\d[A-Z]\d$"),
    (["url", "website"], "url_format", r"^https?://"),
]

DIMENSION_WEIGHTS = {
    "completeness": 0.25, "accuracy": 0.20, "consistency": 0.15,
    "timeliness": 0.10, "uniqueness": 0.15, "validity": 0.15,
}

# Dimension status bands: (PASS from, WARN from).
DIMENSION_BANDS = {
    "completeness": (95, 80), "accuracy": (95, 85), "consistency": (95, 85),
    "timeliness": (95, 70), "uniqueness": (99, 95), "validity": (95, 85),
}

FRESHNESS_HOURS = (24, 72)
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}

# Name hints of the catalog's column classes, in order of precedence.
CLASS_HINTS = {
    "PII": ["name", "email", "phone", "address", "ssn", "dob", "birth", "passport", "license", "social_security"],
    "Financial": ["amount", "balance", "price", "cost", "revenue", "salary", "fee", "payment", "transaction"],
    "Identifier": ["_id", "_key", "_pk", "_fk", "uuid"],
    "Reference": ["code", "type", "status", "category", "flag"],
}

# Column-name prefix to business domain.
PREFIX_DOMAIN = {
    "c_": "Customer", "o_": "Transaction", "l_": "Transaction", "s_": "Operations",
    "p_": "Operations", "ps_": "Operations", "n_": "Reference", "r_": "Reference",
}

# Name part to business domain, used when no prefix applies.
PART_DOMAIN = [
    (["_date", "_time", "timestamp"], "Operations"),
    (["_amt", "_price", "_cost", "_bal", "revenue"], "Financial"),
    (["_name", "_address", "_phone", "_email"], "Customer"),
    (["_key", "_id", "_pk", "_fk"], "Reference"),
    (["_status", "_type", "_code", "_flag"], "Reference"),
]

KPI_HINTS = [
    "revenue", "sales", "profit", "cost", "price", "amount", "total", "quantity", "qty", "count",
    "margin", "income", "expense", "budget", "actual", "target", "score", "rate", "value", "payment",
    "balance", "discount",
]

DIMENSION_HINTS = [
    "region", "country", "state", "city", "category", "segment", "department", "product", "customer",
    "type", "status", "channel", "source", "brand", "group", "class",
]

# Identifier endings of join keys, and abbreviation pairs used when matching names.
ID_ENDING = r"(?:_?id|_?key|_?code|_?num|_?no|_?number)$"
ABBREVIATIONS = {
    "cust": "customer", "prod": "product", "cat": "category", "emp": "employee", "dept": "department",
    "loc": "location", "qty": "quantity", "amt": "amount", "txn": "transaction", "acct": "account",
    "inv": "invoice", "ord": "order", "mgr": "manager", "org": "organization", "desc": "description",
}
KEY_SUFFIXES = ["key", "id", "code", "custkey", "orderkey", "partkey", "suppkey", "nationkey", "regionkey"]
KEY_TOKENS = ["id", "key", "code", "fk", "ref", "number", "num", "no"]

TRUST_WEIGHTS = {
    "dq_score": 0.30, "completeness": 0.15, "freshness": 0.15, "stewardship": 0.10,
    "documentation": 0.10, "rule_compliance": 0.10, "scan_frequency": 0.05, "lineage_coverage": 0.05,
}

COST_PARAMETERS = {
    "avg_analyst_hourly_rate": 67.0,
    "avg_manual_fix_minutes_per_record": 5.0,
    "avg_failed_transaction_cost": 25.0,
    "avg_compliance_fine_per_violation": 1000.0,
    "avg_customer_impact_cost": 50.0,
    "avg_rework_hours_per_report": 4.0,
    "reports_per_month": 50.0,
    "transactions_per_month": 24_000_000.0,
    "annual_revenue": 4_100_000_000.0,
}

# Service levels: hours to respond and to resolve.
SLA_HOURS = {"CRITICAL": (4, 24), "HIGH": (24, 72), "MEDIUM": (48, 168), "LOW": (168, 720)}
ESCALATION_CHAIN = ["Data Steward", "Data Owner", "Domain Lead", "CDO"]
OPEN_STATES = ["Open", "Assigned", "In Progress"]
CLOSED_STATES = ["Resolved", "Verified", "Closed", "Wont Fix"]
INCIDENT_OPEN_STATES = ["Open", "Acknowledged"]
