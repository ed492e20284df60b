"""Profiling, dimensions, gates and rules on small hand-checked tables."""

import pytest
from pyspark.sql import functions as F

from lensdq.functions.typing import repair_types, sanitized_names, semantic_types
from lensdq.operators import dimensions as dim
from lensdq.operators import profile, rules
from lensdq.operators.rules import Rule
from lensdq.plans.scan import scan_table, scan_tables

NOW = "2024-06-01 00:00:00"


def by_column(df, value):
    return {r["column_name"]: r[value] for r in df.collect()}


def test_completeness_counts_nan_as_missing(sales_nulls):
    got = {r["column_name"]: (r["null_count"], r["score"], r["status"]) for r in dim.completeness(sales_nulls).collect()}
    assert got == {"Sales": (2, 60.0, "FAIL"), "Region": (2, 60.0, "FAIL"), "Value": (1, 80.0, "WARN")}


def test_scan_of_small_table(sales):
    row = scan_table(sales, "sales", NOW).first()
    assert row["completeness"] == 100.0 and row["uniqueness"] == 100.0
    # Category holds one-letter labels only, which count as suspect by default.
    assert row["accuracy"] == 0.0
    assert row["timeliness"] == 40.0
    lenient = scan_tables({"sales": sales}, NOW, max_flag_length=0).dimensions
    assert {r["dimension"]: r["score"] for r in lenient.collect()}["accuracy"] == 100.0


def test_scan_of_empty_table(sales_empty):
    row = scan_table(sales_empty, "none", NOW).first()
    assert row["row_count"] == 0
    assert row["timeliness"] is None
    assert row["accuracy"] == 100.0


def test_profiles_of_empty_and_single_row(sales_empty, sales):
    assert profile.numeric_profile(sales_empty).first()["n"] == 0
    one = profile.numeric_profile(sales.limit(1), ["Sales"]).first()
    assert one["mean"] == one["median"] == one["min_value"]
    assert one["std"] is None


def test_numeric_profile_values(sales):
    r = {x["column_name"]: x for x in profile.numeric_profile(sales, ["Sales", "Profit"]).collect()}
    assert r["Sales"]["mean"] == 300 and r["Sales"]["median"] == 300 and r["Sales"]["std"] == 158.1139
    assert r["Sales"]["skewness"] == 0 and r["Sales"]["kurtosis"] == -1.2
    assert r["Profit"]["zero_count"] == 1 and r["Profit"]["negative_count"] == 1


def test_constant_and_all_null_columns(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None)], "c int, n string")
    q = profile.quality_summary(df).first()
    assert q["constant_columns"] == "c,n" and q["columns_with_nulls"] == "n" and q["duplicate_rows"] == 2
    assert by_column(profile.analyst_profile(df), "quality") == {"c": 80.0, "n": 40.0}


def test_hierarchy_needs_one_parent_per_child(spark):
    df = spark.createDataFrame([(f"c{i}", f"p{i % 2}", f"x{i % 3}") for i in range(12)], "child string, parent string, other string")
    found = {(r["parent"], r["child"]) for r in profile.hierarchies(df).collect()}
    assert found == {("parent", "child"), ("other", "child")}


def test_gate_names_blockers(sales):
    gate = dim.quality_gate(scan_tables({"sales": sales}, NOW).dimensions, ["table_name"], 80, ["completeness"]).first()
    assert not gate["passed"]
    assert gate["blocking_issues"] == "accuracy critical; timeliness critical"


def test_semantic_types(sales):
    got = by_column(semantic_types(sales, "analyst"), "semantic_type")
    assert got["Sales"] == "measure" and got["Quantity"] == "dimension" and got["Region"] == "dimension" and got["Date"] == "date"
    assert by_column(semantic_types(sales, "profiler"), "semantic_type")["Region"] == "categorical"
    with pytest.raises(ValueError):
        semantic_types(sales, "nope")


def test_sanitized_names():
    assert sanitized_names([" a ", "[a]", "Event.1", "Event", "b"]) == ["a", "a_2", "Event_2", "Event", "b"]


def test_repair_types(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("x",)], "s string")
    assert repair_types(df).schema["s"].dataType.simpleString() == "double"
    assert repair_types(df, 0.9).schema["s"].dataType.simpleString() == "string"


@pytest.mark.parametrize(
    "rule, failing",
    [
        (Rule("r", "Sales", "not_null"), 2),
        (Rule("r", "Value", "not_null"), 1),
        (Rule("r", "Region", "unique"), 4),
        (Rule("r", "Sales", "range", {"min": 100, "inclusive": False}), 1),
        (Rule("r", "Sales", "range", {"max": 400}), 1),
        (Rule("r", "Region", "regex", {"pattern": "Ea", "match_type": "full"}), 3),
        (Rule("r", "Region", "regex", {"pattern": "Ea", "match_type": "prefix"}), 1),
        (Rule("r", "Region", "in_list", {"values": ["East"]}), 1),
        (Rule("r", "Region", "not_in_list", {"values": ["East"]}), 2),
        (Rule("r", None, "custom_expression", {"expression": "Sales > 150"}), 3),
        (Rule("r", "Sales", "cross_column", {"operator": ">", "column_b": "Value"}), 0),
        (Rule("r", "Region", "length", {"max_length": 3}), 3),
        (Rule("r", "Region", "type_check", {"expected_type": "numeric"}), 3),
        (Rule("r", "Sales", "type_check", {"expected_type": "numeric"}), 0),
    ],
)
def test_rules(sales_nulls, rule, failing):
    row = rules.evaluate(sales_nulls, [rule]).first()
    assert (row["failing_rows"], row["total_rows"], row["passed"]) == (failing, 5, failing == 0)


def test_referential_and_errors(sales_nulls, spark):
    known = spark.createDataFrame([("East",)], "name string")
    checks = [
        Rule("ok", "Region", "referential", {"reference_table": "R", "reference_column": "NAME"}),
        Rule("lost", "Region", "referential", {"reference_table": "missing", "reference_column": "x"}),
        Rule("typo", "Regio", "not_null"),
    ]
    rows = {r["rule_id"]: r for r in rules.evaluate(sales_nulls, checks, {"r": known}).collect()}
    assert rows["ok"]["failing_rows"] == 1
    assert rows["lost"]["passed"] is None and "not loaded" in rows["lost"]["error"]
    assert rows["typo"]["passed"] is None


def test_row_rules_share_one_scan(sales_nulls):
    many = [Rule(f"r{i}", "Sales", "range", {"min": i}) for i in range(20)]
    assert rules.evaluate(sales_nulls, many).count() == 20


def test_quarantine_split(sales_nulls):
    good, bad = rules.split(sales_nulls, [Rule("s", "Sales", "not_null"), Rule("r", "Region", "not_null")])
    assert good.count() == 2 and bad.count() == 3
    assert {tuple(r["failed_rules"]) for r in bad.collect()} == {("s", "r"), ("s",), ("r",)}


def test_empty_table_rules(sales_empty):
    row = rules.evaluate(sales_empty, [Rule("r", "Sales", "not_null")]).first()
    assert row["pass_rate"] == 100.0 and row["passed"]


def test_date_order(spark):
    df = spark.createDataFrame([("2024-01-02", "2024-01-01"), ("2024-01-01", "2024-01-02"), (None, "2024-01-01")], "start_date string, end_date string")
    assert dim.date_order_issues(df).first()["bad_rows"] == 1


def test_validity_of_names(spark):
    df = spark.createDataFrame([("a@b.co", "12345", -1.0), ("bad", "1", 2.0)], "email string, zip_code string, price double")
    assert {r["column_name"]: (r["rule"], r["violations"]) for r in dim.validity(df, NOW).collect()} == {
        "email": ("email_format", 1), "zip_code": ("postal_format", 1), "price": ("expected_positive", 1)
    }


def test_correlation_ignores_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 9.0), (4.0, 8.0)], "a double, b double")
    assert profile.correlations(df).first()["r"] == 1.0


def test_uniqueness_null_is_no_value(sales_nulls):
    got = {r["column_name"]: (r["unique_count"], r["is_potential_pk"]) for r in dim.uniqueness(sales_nulls).collect()}
    assert got == {"Sales": (3, False), "Region": (2, False), "Value": (4, False)}


def test_categorical_profile_flags(spark):
    df = spark.createDataFrame([("a",)] * 95 + [("b",)] * 5, "x string")
    assert profile.categorical_profile(df).orderBy("rank").first()["flag"] == "near_constant"
    assert profile.categorical_profile(df.where(F.col("x") == "c")).count() == 0
