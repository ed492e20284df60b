"""Mapping of columns to regulatory requirements and compliance assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, as results depend on them. Regulatory requirements: framework, id, severity, data elements, quality dimensions.
REQUIREMENTS = [
    ("BSA/AML", "BSA-001", "CRITICAL", ["customer_name", "date_of_birth", "address", "ssn", "id_number", "id_type"], ["completeness", "accuracy", "validity"]),
    ("BSA/AML", "BSA-002", "CRITICAL", ["transaction_amount", "transaction_date", "customer_name", "customer_id"], ["completeness", "accuracy", "timeliness"]),
    ("BSA/AML", "BSA-003", "CRITICAL", ["transaction_amount", "transaction_type", "sender_name", "receiver_name", "country"], ["completeness", "accuracy", "timeliness"]),
    ("BSA/AML", "BSA-004", "HIGH", ["transaction_id", "transaction_date", "amount", "customer_id"], ["completeness", "uniqueness", "timeliness"]),
    ("KYC", "KYC-001", "CRITICAL", ["customer_name", "date_of_birth", "nationality", "address", "id_document"], ["completeness", "accuracy", "validity"]),
    ("KYC", "KYC-002", "HIGH", ["risk_score", "source_of_funds", "occupation", "transaction_pattern"], ["completeness", "accuracy"]),
    ("KYC", "KYC-003", "HIGH", ["transaction_history", "alert_status", "review_date"], ["timeliness", "completeness"]),
    ("SOX", "SOX-001", "CRITICAL", ["revenue", "expenses", "transaction_amount", "balance"], ["accuracy", "completeness", "consistency"]),
    ("SOX", "SOX-002", "HIGH", ["modified_by", "modified_at", "change_type", "old_value", "new_value"], ["completeness", "timeliness"]),
    ("SOX", "SOX-003", "HIGH", ["control_id", "test_date", "test_result", "remediation"], ["completeness", "validity"]),
    ("PCI-DSS", "PCI-001", "CRITICAL", ["card_number", "cardholder_name", "expiry_date", "cvv"], ["validity", "accuracy"]),
    ("PCI-DSS", "PCI-002", "CRITICAL", ["card_number", "cvv", "pin_block"], ["validity"]),
    ("GDPR", "GDPR-001", "HIGH", ["customer_name", "email", "phone", "address"], ["accuracy", "timeliness"]),
    ("GDPR", "GDPR-002", "MEDIUM", [], ["validity"]),
    ("GDPR", "GDPR-003", "HIGH", ["customer_id", "pii_columns"], ["completeness", "uniqueness"]),
    ("OFAC", "OFAC-001", "CRITICAL", ["sender_name", "receiver_name", "country", "address"], ["accuracy", "completeness", "consistency"]),
]


def requirements_frame(spark: SparkSession, requirements: list = REQUIREMENTS) -> DataFrame:
    return spark.createDataFrame(
        requirements, "framework string, requirement_id string, severity string, data_elements array<string>, dq_dimensions array<string>"
    )


def plain_name(name: Column) -> Column:
    """Lower case without a one-letter prefix, underscores, hyphens and blanks."""
    stripped = F.regexp_replace(F.regexp_replace(F.lower(name), "-", " "), "^[a-z]_", "")
    return F.regexp_replace(stripped, "[_ ]", "")


def map_columns(columns: DataFrame, requirements: list = REQUIREMENTS, min_length: int = 1) -> DataFrame:
    """(table_name, column_name, framework, requirement_id) where a name holds an element or the reverse.

    The requirement list rides along as a constant array, so no join is needed.
    """
    items = F.array(
        *[
            F.struct(F.lit(f).alias("framework"), F.lit(r).alias("requirement_id"), F.lit(e.replace("_", "")).alias("element"))
            for f, r, _, elements, _ in requirements
            for e in elements
        ]
    )
    name = F.col("plain")
    fits = lambda s: (F.length(name) >= min_length) & (name.contains(s["element"]) | s["element"].contains(name))
    return (
        columns.select("table_name", "column_name", plain_name(F.col("column_name")).alias("plain"))
        .withColumn("s", F.explode(F.filter(items, fits)))
        .select("table_name", "column_name", "s.framework", "s.requirement_id")
        .distinct()
    )


def assess(mapping: DataFrame, dimensions: DataFrame, requirements: DataFrame, threshold: float = 80, issue_below: float = 90) -> DataFrame:
    """Score per table and requirement: mean of the required dimensions; unscored dimensions count as 100."""
    used = mapping.groupBy("table_name", "framework", "requirement_id").agg(F.count_distinct("column_name").alias("mapped_columns"))
    needs = used.join(requirements, ["framework", "requirement_id"]).select("*", F.explode("dq_dimensions").alias("dimension"))
    scored = needs.join(dimensions.select("table_name", "dimension", "score"), ["table_name", "dimension"], "left").withColumn(
        "score", F.coalesce("score", F.lit(100.0))
    )
    out = scored.groupBy("table_name", "framework", "requirement_id", "severity", "mapped_columns").agg(
        F.avg("score").alias("mean_score"), F.count_if(F.col("score") < issue_below).alias("issues")
    )
    return out.select(
        "table_name", "framework", "requirement_id", "severity", "mapped_columns", F.round("mean_score", 1).alias("score"),
        (F.col("mean_score") >= threshold).alias("compliant"), "issues",
    )


def framework_summary(assessment: DataFrame) -> DataFrame:
    """Score and counts per table and framework."""
    return assessment.groupBy("table_name", "framework").agg(
        F.round(F.avg("score"), 1).alias("overall_score"), F.count_if("compliant").alias("compliant_count"),
        F.count_if(~F.col("compliant")).alias("non_compliant_count"),
    )


def compliance_summary(assessment: DataFrame) -> DataFrame:
    per_table = assessment.groupBy("table_name").agg(F.round(F.avg("score"), 1).alias("s"), F.count_if(~F.col("compliant")).alias("gaps"))
    return per_table.agg(
        F.count(F.lit(1)).alias("tables_assessed"), F.round(F.avg("s"), 1).alias("overall_score"), F.sum("gaps").alias("gap_count")
    )
