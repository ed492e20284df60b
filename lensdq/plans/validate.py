"""Scan, catalog, compliance and trust of one table in one result row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensdq.operators import catalog, compliance
from lensdq.operators import governance as gov
from lensdq.operators.relate import schema_frame
from lensdq.plans.scan import scan_tables


def validate_and_catalog(df: DataFrame, table_name: str, as_of: str, owner: str = "Unassigned", steward: str = "Unassigned") -> DataFrame:
    spark = df.sparkSession
    scan = scan_tables({table_name: df}, as_of)
    columns = catalog.catalog_columns({table_name: df})
    terms = catalog.glossary(columns)
    listed = catalog.catalog_tables(columns)
    assessed = compliance.assess(
        compliance.map_columns(schema_frame(spark, {table_name: df})), scan.dimensions, compliance.requirements_frame(spark)
    )
    gaps = assessed.groupBy("table_name").agg(
        F.round(F.avg("score"), 1).alias("compliance_score"), F.count_if(~F.col("compliant")).alias("compliance_gaps")
    )
    owners = spark.createDataFrame([(table_name, owner, steward)], "table_name string, owner string, steward string")
    described = terms.groupBy("table_name").agg((F.count_if(F.col("definition") != "") * 100.0 / F.count(F.lit(1))).alias("documented_pct"))
    trust = gov.trust_scores(scan.dimensions, scan.overall(), owners, described)
    # One row per table on every side.
    return (
        scan.overall()
        .join(listed, "table_name")
        .join(gaps, "table_name", "left")
        .join(trust.select("table_name", "trust_score", "certification"), "table_name")
        .select(
            "table_name", "overall_score", "scan_status", "row_count", "column_count", "pii_columns", "compliance_score", "compliance_gaps",
            "trust_score", "certification",
        )
    )
