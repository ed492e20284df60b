"""Audit findings, release decision, verified facts, insights and migration tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensdq.functions.columns import (
    as_double, clean, numeric_columns,
    percent, side_by_side, string_columns, temporal_columns,
)
from lensdq.operators.longform import distinct_stats, full_row_counts, per_column, quantiles, value_counts
from lensdq.operators.present import concentration
from lensdq.operators.profile import fences, outside
from lensdq.operators.windows import early_late_trends

SEVERITY_SCORE = {"PASS": 100, "INFO": 90, "WARNING": 60, "CRITICAL": 20, "BLOCKER": 0}


def findings(df: DataFrame, source: str) -> DataFrame:
    """(source, check_name, category, severity, affected) of the table-level checks.

    Every check reads one of three small summaries: value counts folded per column, duplicate
    rows, and outlier counts beyond three interquartile ranges.
    """
    numbers, texts = numeric_columns(df), string_columns(df)
    counts = value_counts(df, df.columns)
    stats = distinct_stats(counts)
    n, nulls = F.col("row_count"), F.col("null_count")
    per = stats.agg(
        F.max("row_count").alias("rows"), F.count_if(nulls > n * 0.5).alias("sparse"), F.count_if((nulls == n) & (n > 0)).alias("empty"),
        F.count_if(F.col("distinct_count") <= 1).alias("flat"), F.round(F.sum(nulls) * 100.0 / F.sum(n), 1).alias("null_pct"),
    )
    dups = full_row_counts(df).select("duplicate_rows", F.round(F.col("duplicate_rows") * 100.0 / F.col("row_count"), 1).alias("dup_pct"))
    limits = {c: f for c, f in (fences(df, numbers) if numbers else {}).items() if f[2] > 0}
    hits = [F.count_if(outside(as_double(df, c), f, 3.0)) for c, f in limits.items()]
    far = df.agg(F.lit(0).alias("h"), *[h.alias(f"h{i}") for i, h in enumerate(hits)])
    wild = sum((F.when(F.col(f"h{i}") > 0, 1).otherwise(0) for i in range(len(hits))), F.lit(0))
    far = far.select(wild.alias("wild"))
    # Mixed: a text column holding both numbers and other text.
    typed = counts.where(F.col("column_name").isin(texts) & F.col("value").isNotNull()).groupBy("column_name").agg(
        (F.sum(F.when(F.col("value").try_cast("double").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("share")
    )
    mixed = typed.agg(F.count_if((F.col("share") > 0) & (F.col("share") < 1)).alias("mixed"))
    row = side_by_side(per, dups, far, mixed)

    def check(name: str, category: str, severity: Column, affected: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), F.lit(category).alias("category"), severity.alias("severity"), affected.cast("bigint").alias("affected"))

    flag = lambda c, bad: F.when(F.col(c) > 0, bad).otherwise("PASS")
    some = F.coalesce("rows", F.lit(0))
    checks = F.array_compact(
        F.array(
            check("Data Exists", "completeness", F.when(some > 0, "PASS").otherwise("BLOCKER"), some),
            check("Duplicate Rows", "data_integrity", F.when(F.col("duplicate_rows") == 0, "PASS").when(F.col("dup_pct") < 10, "WARNING").otherwise("CRITICAL"), F.col("duplicate_rows")),
            check("Null Density", "data_integrity", flag("sparse", "WARNING"), F.col("sparse")),
            check("Empty Columns", "completeness", flag("empty", "CRITICAL"), F.col("empty")),
            F.when(F.col("flat") > 0, check("Zero-Variance Columns", "data_integrity", F.lit("INFO"), F.col("flat"))),
            check("Extreme Outliers", "data_integrity", F.when(F.col("wild") == 0, "PASS").when(F.col("wild") <= 3, "WARNING").otherwise("CRITICAL"), F.col("wild")),
            check("Mixed Data Types", "consistency", flag("mixed", "WARNING"), F.col("mixed")),
            check("Overall Data Profile", "completeness", F.lit("INFO"), some),
        )
    )
    out = row.withColumn("c", F.explode(checks)).where((some > 0) | (F.col("c.check_name") == "Data Exists"))
    return out.select(F.lit(source).alias("source"), "c.*")


def combine(reports: list[DataFrame]) -> DataFrame:
    """All findings, each check named after its source."""
    every = reduce(DataFrame.unionByName, reports)
    return every.withColumn("check_name", F.concat(F.lit("["), F.col("source"), F.lit("] "), F.col("check_name")))


def release_decision(report: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean severity score and the release verdict."""
    s = F.col("severity")
    score = F.lit(0)
    for name, value in SEVERITY_SCORE.items():
        score = F.when(s == name, value).otherwise(score)
    aggs = [F.count(F.lit(1)).alias("total_checks"), *[F.count_if(s == n).alias(n.lower()) for n in SEVERITY_SCORE], F.round(F.avg(score), 1).alias("overall_score")]
    out = report.groupBy(*by).agg(*aggs) if by else report.agg(*aggs)
    verdict = (
        F.when(F.col("total_checks") == 0, "NONE").when(F.col("blocker") > 0, "BLOCKED").when(F.col("critical") > 0, "HOLD")
        .when(F.col("warning") > 3, "REVIEW REQUIRED").when(F.col("overall_score") >= 70, "APPROVED").otherwise("BELOW THRESHOLD")
    )
    return out.withColumn("decision", verdict).withColumn("is_releasable", F.col("decision") == "APPROVED")


def listed_dimensions(df: DataFrame, most: int = 30) -> list[str]:
    texts = string_columns(df)
    if not texts:
        return []
    few = {r["column_name"] for r in distinct_stats(value_counts(df, texts)).where(F.col("distinct_count") <= most).collect()}
    return [c for c in texts if c in few]


def verified_facts(df: DataFrame, order: list[str] | None = None, measures: int | None = None, dimensions: int | None = None) -> DataFrame:
    """(fact, subject, value, text): totals of measures, leading categories, trends, size.

    All measures and listed dimensions unless a number is given; trends need a date column.
    """
    numbers, labels = numeric_columns(df)[:measures], listed_dimensions(df)[:dimensions]
    q = quantiles(df, numbers, {"median": 0.5})
    m = per_column(df, numbers, {"total": F.sum, "average": F.avg, "minimum": F.min, "maximum": F.max}, read=as_double)
    wide = m.join(F.broadcast(q), "column_name")
    names = ["total", "average", "minimum", "maximum", "median"]
    long = wide.unpivot(["column_name"], names, "fact", "value").select("fact", F.col("column_name").alias("subject"), F.round("value", 2).alias("value"), F.lit("").alias("text"))
    parts = [long]
    for c in labels:
        top = concentration(df, c, numbers[0])
        parts.append(top.select(F.lit("top1_pct").alias("fact"), F.lit(c).alias("subject"), F.col("top1_pct").alias("value"), F.col("top_value").alias("text")))
        parts.append(top.select(F.lit("top3_pct").alias("fact"), F.lit(c).alias("subject"), F.col("top3_pct").alias("value"), F.lit("").alias("text")))
    stamps = temporal_columns(df)
    if stamps and numbers:
        t = early_late_trends(df, order or [stamps[0]], numbers)
        parts.append(t.select(F.lit("trend").alias("fact"), F.col("value").alias("subject"), F.col("pct_change").alias("value"), F.col("trend").alias("text")))
    size = df.agg(F.count(F.lit(1)).cast("double").alias("value"))
    parts.append(size.select(F.lit("row_count").alias("fact"), F.lit("").alias("subject"), "value", F.lit("").alias("text")))
    return reduce(DataFrame.unionByName, parts)


def insights(df: DataFrame, measures: list[str], dimensions: list[str], concentrated: float = 60.0) -> DataFrame:
    """(kind, subject, value, note): measure totals, leading groups, concentration and quality notes."""
    kpi = per_column(df, measures, {"total": lambda c: F.round(F.sum(c), 2)}, read=as_double).select(
        F.lit("kpi").alias("kind"), F.col("column_name").alias("subject"), F.col("total").alias("value"), F.lit("").alias("note")
    )
    parts = [kpi]
    for d in dimensions:
        top = concentration(df, d, measures[0])
        parts.append(top.select(F.lit("top_performer").alias("kind"), F.lit(d).alias("subject"), F.col("top1_pct").alias("value"), F.col("top_value").alias("note")))
        parts.append(top.where(F.col("top3_pct") > concentrated).select(F.lit("concentration").alias("kind"), F.lit(d).alias("subject"), F.col("top3_pct").alias("value"), F.lit("top 3").alias("note")))
    gaps = per_column(df, df.columns, {"pct": lambda c: percent(F.count_if(c.isNull()), F.count(F.lit(1)), 1)}, read=clean)
    parts.append(gaps.where("pct > 5").select(F.lit("null_column").alias("kind"), F.col("column_name").alias("subject"), F.col("pct").alias("value"), F.lit("").alias("note")))
    parts.append(
        full_row_counts(df).where("duplicate_rows > 0").select(
            F.lit("duplicates").alias("kind"), F.lit("").alias("subject"), F.col("duplicate_rows").cast("double").alias("value"), F.lit("").alias("note")
        )
    )
    return reduce(DataFrame.unionByName, parts)


# --- migration of metric definitions

def migration_tiers(fields: DataFrame) -> DataFrame:
    """Tier and confidence per metric (name, target, method, needs_ai, is_map, original, match, delta_pct)."""
    method, match = F.col("method"), F.col("match")
    usable = (F.coalesce(F.trim("target"), F.lit("")) != "") & (F.trim("target") != "BLANK()")
    loss = F.floor(F.coalesce("delta_pct", F.lit(0.0))).cast("int")
    mismatch = F.coalesce(~match, F.lit(False))
    agreed = F.coalesce(match, F.lit(False))
    ai, heuristic = method == "ai", method == "heuristic"
    plain = ~F.coalesce("needs_ai", F.lit(False)) & ~F.coalesce(heuristic | ai, F.lit(False))
    tier = (
        F.when(~usable, "BLOCKED").when(method == "spatial", F.when(F.col("is_map"), "MAP").otherwise("GOOD")).when(plain, "AUTO")
        .when(heuristic, F.when(mismatch, "REVIEW").otherwise("GOOD")).when(ai, F.when(agreed, "GOOD").otherwise("REVIEW"))
        .when(method == "ai_failed", "BLOCKED").when(F.coalesce("original", F.lit("")) == "", "AUTO").otherwise("REVIEW")
    )
    confidence = (
        F.when(~usable, 0).when(method == "spatial", 90).when(plain, 100)
        .when(heuristic, F.when(mismatch, F.greatest(F.lit(30), 85 - loss)).otherwise(85))
        .when(ai, F.when(agreed, 90).when(mismatch, F.greatest(F.lit(20), 70 - loss)).otherwise(70))
        .when(method == "ai_failed", 0).when(F.coalesce("original", F.lit("")) == "", 100).otherwise(50)
    )
    return fields.select("*", tier.alias("tier"), confidence.cast("int").alias("confidence"))


def migration_score(tiers: DataFrame) -> DataFrame:
    """Deductions for blocked, review and low-confidence fields and for low coverage, with the final score."""
    t, c = F.col("tier"), F.col("confidence")
    row = tiers.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(t == "BLOCKED").alias("blocked"), F.count_if(t.isin("REVIEW", "MANUAL")).alias("review"),
        F.count_if((c > 0) & (c < 50)).alias("low_confidence"), F.count_if(t.isin("AUTO", "GOOD", "MAP")).alias("auto_good"), F.floor(F.avg("confidence")).alias("avg_confidence"),
    )
    coverage = F.col("auto_good") * 100.0 / F.col("total")
    off = (
        F.least(F.col("blocked") * 20, F.lit(60)) + F.least(F.col("review") * 5, F.lit(25)) + F.least(F.col("low_confidence") * 3, F.lit(15))
        + F.when(coverage >= 80, 0).otherwise(F.floor((80 - coverage) / 2))
    )
    return row.select("*", F.round(coverage, 1).alias("coverage_pct"), F.when(F.col("total") == 0, 100).otherwise(F.greatest(F.lit(0), 100 - off)).cast("bigint").alias("score"))


def duplicate_names(fields: DataFrame) -> DataFrame:
    return fields.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
