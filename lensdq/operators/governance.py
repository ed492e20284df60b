"""Trust scores, cost of poor quality, scan history, issues and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensdq.functions.columns import side_by_side
from lensdq.functions.wordlists import (
    CLOSED_STATES, COST_PARAMETERS, DIMENSION_WEIGHTS, ESCALATION_CHAIN, INCIDENT_OPEN_STATES, OPEN_STATES, SLA_HOURS, TRUST_WEIGHTS,
)
from lensdq.operators.windows import latest


# --- trust

def trust_scores(
    dimensions: DataFrame, overall: DataFrame, owners: DataFrame, documented: DataFrame, rules: DataFrame | None = None, scans: DataFrame | None = None
) -> DataFrame:
    """Weighted trust per table with the recommended certification.

    ``owners`` (table_name, owner, steward), ``documented`` (table_name, documented_pct), ``rules``
    (table_name, overall_pass_rate), ``scans`` (table_name, total_scans); all one row per table.
    """
    dim = lambda d: F.max(F.when(F.col("dimension") == d, F.col("score")))
    base = dimensions.groupBy("table_name").agg(dim("completeness").alias("completeness"), dim("timeliness").alias("freshness"))
    out = base.join(overall.select("table_name", "overall_score"), "table_name").join(owners, "table_name", "left").join(documented, "table_name", "left")
    out = out.join(rules, "table_name", "left") if rules is not None else out.withColumn("overall_pass_rate", F.lit(None).cast("double"))
    out = out.join(scans, "table_name", "left") if scans is not None else out.withColumn("total_scans", F.lit(0))
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("Unassigned")) != "Unassigned", 50).otherwise(0)
    n = F.coalesce("total_scans", F.lit(0))
    parts = {
        "dq_score": F.coalesce("overall_score", F.lit(0.0)),
        "completeness": F.coalesce("completeness", F.lit(0.0)),
        "freshness": F.coalesce("freshness", F.lit(50.0)),
        "stewardship": (given("owner") + given("steward")).cast("double"),
        "documentation": F.coalesce("documented_pct", F.lit(0.0)),
        "rule_compliance": F.coalesce("overall_pass_rate", F.lit(50.0)),
        "scan_frequency": F.when(n >= 10, 100.0).when(n >= 5, 80.0).when(n >= 2, 60.0).when(n >= 1, 40.0).otherwise(0.0),
        "lineage_coverage": F.lit(50.0),
    }
    trust = sum((F.col(k) * w for k, w in TRUST_WEIGHTS.items()), F.lit(0.0))
    scored = out.select("table_name", *[c.alias(k) for k, c in parts.items()]).withColumn("raw", trust)
    return scored.select(
        "table_name", *parts, F.round("raw", 1).alias("trust_score"),
        F.when(F.col("raw") >= 85, "Certified").when(F.col("raw") >= 65, "Warning").otherwise("Quarantined").alias("certification"),
    )


def trust_summary(scores: DataFrame) -> DataFrame:
    c, s = F.col("certification"), F.col("trust_score")
    by = F.struct("trust_score", "table_name")
    return scores.agg(
        F.count(F.lit(1)).alias("total_tables"), F.count_if(c == "Certified").alias("certified"), F.count_if(c == "Warning").alias("warning"),
        F.count_if(c == "Quarantined").alias("quarantined"), F.round(F.avg(s), 1).alias("avg_trust_score"),
        F.min_by("table_name", by).alias("lowest_table"), F.min(s).alias("lowest_score"),
        F.max_by("table_name", by).alias("highest_table"), F.max(s).alias("highest_score"),
    )


# --- cost of poor quality

def quality_cost(wide: DataFrame, parameters: dict[str, float] | None = None, most_violations: int | None = None) -> DataFrame:
    """Annual cost per table and cause from its size and dimension scores (one row per table in).

    ``most_violations`` is the number of fined rows at which the cost of validity stops growing.
    """
    p = {**COST_PARAMETERS, **(parameters or {})}
    lack = lambda d: F.coalesce((100 - F.col(d)) / 100, F.lit(0.0))
    whole = lambda c: F.floor(F.round(c, 6))
    rate, rows = p["avg_analyst_hourly_rate"], F.col("row_count")
    violations = whole(rows * lack("validity"))
    if most_violations is not None:
        violations = F.least(violations, F.lit(most_violations))
    monthly = {
        "completeness": whole(rows * lack("completeness")) * p["avg_manual_fix_minutes_per_record"] / 60 * rate,
        "accuracy": whole(p["transactions_per_month"] * lack("accuracy") * 0.001) * p["avg_failed_transaction_cost"]
        + p["avg_rework_hours_per_report"] * rate * p["reports_per_month"] * lack("accuracy"),
        "uniqueness": whole(rows * lack("uniqueness")) * 2 / 60 * rate
        + F.floor(whole(rows * lack("uniqueness")) * 0.01) * p["avg_customer_impact_cost"],
        "validity": violations * p["avg_compliance_fine_per_violation"] / 12,
        "timeliness": lack("timeliness") * p["reports_per_month"] * p["avg_rework_hours_per_report"] * rate * 0.5,
    }
    costs = wide.select("table_name", "row_count", *[F.round(c * 12, 2).alias(f"{d}_cost") for d, c in monthly.items()])
    return costs.withColumn("total_cost", F.round(sum((F.col(f"{d}_cost") for d in monthly), F.lit(0.0)), 2))


def cost_summary(costs: DataFrame, parameters: dict[str, float] | None = None) -> DataFrame:
    revenue = {**COST_PARAMETERS, **(parameters or {})}["annual_revenue"] or 1.0
    total = F.sum("total_cost")
    return costs.agg(
        F.round(total, 2).alias("total_annual_cost"), F.round(total / 12, 2).alias("total_monthly_cost"),
        F.round(total / revenue * 100, 4).alias("revenue_impact_pct"),
    )


# --- scan history: (table_name, scanned_at, scan_id, overall_score, dimension scores...)

def append_history(rows: DataFrame, path: str, scanned_at: str, scan_id: int | None = None) -> None:
    """Add one row per scanned table; the store is Parquet partitioned by table and never trimmed.

    ``scan_id`` orders scans of the same moment; left out, it is the moment in microseconds.
    """
    moment = F.lit(scanned_at).cast("timestamp")
    number = F.unix_micros(moment) if scan_id is None else F.lit(scan_id).cast("bigint")
    rows.withColumns({"scanned_at": moment, "scan_id": number}).write.mode("append").partitionBy("table_name").parquet(path)


def latest_scans(history: DataFrame) -> DataFrame:
    return latest(history, ["table_name"], [F.col("scanned_at"), F.col("scan_id")]).drop("recency")


def degradation(history: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Latest scan against the one before, per table: change of every score and the verdicts."""
    scores = ["overall_score", *[d for d in DIMENSION_WEIGHTS if d in history.columns]]
    two = latest(history, ["table_name"], [F.col("scanned_at"), F.col("scan_id")], n=2)
    now = lambda c: F.max(F.when(F.col("recency") == 1, F.col(c)))
    before = lambda c: F.max(F.when(F.col("recency") == 2, F.col(c)))
    per = two.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("m"), *[F.round(now(c) - before(c), 2).alias(f"{c}_change") for c in scores]
    ).where("m = 2")
    dims = scores[1:]
    listed = lambda test: F.array_join(F.array_compact(F.array(*[F.when(test(F.col(f"{d}_change")), d) for d in dims])), ",") if dims else F.lit("")
    return per.select(
        "table_name", F.col("overall_score_change").alias("overall_change"), (F.col("overall_score_change") < -threshold).alias("degraded"),
        listed(lambda c: c < -threshold).alias("degraded_dimensions"), listed(lambda c: c > threshold).alias("improved_dimensions"),
    )


def history_trend(history: DataFrame, limit: int = 30, columns: list[str] = ("overall_score",)) -> DataFrame:
    """The last ``limit`` scans of every table."""
    rows = latest(history, ["table_name"], [F.col("scanned_at"), F.col("scan_id")], n=limit)
    return rows.select("table_name", "recency", "scanned_at", *columns)


def best_worst(history: DataFrame) -> DataFrame:
    s = F.coalesce("overall_score", F.lit(0.0))
    first_of = lambda sign: F.struct((sign * s).alias("s"), F.col("scanned_at").alias("t"))
    return history.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total_scans"), F.max(s).alias("best_score"), F.min_by("scanned_at", first_of(-1)).alias("best_date"),
        F.min(s).alias("worst_score"), F.min_by("scanned_at", first_of(1)).alias("worst_date"),
        F.max_by("overall_score", F.struct("scanned_at", "scan_id")).alias("current_score"), F.round(F.avg(s), 2).alias("avg_score"),
    )


def scan_frequency(history: DataFrame, as_of: str) -> DataFrame:
    """Mean days between scans from first, last and count, and scans in the last 7 and 30 days."""
    now = F.lit(as_of).cast("timestamp")
    t = F.col("scanned_at").cast("timestamp")
    days = (F.unix_micros(now) - F.unix_micros(t)) / 8.64e10
    return history.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total_scans"), F.min(t).alias("first_scan"), F.max(t).alias("last_scan"),
        F.count_if((days >= 0) & (F.floor(days) <= 7)).alias("scans_last_7_days"), F.count_if((days >= 0) & (F.floor(days) <= 30)).alias("scans_last_30_days"),
    ).withColumn(
        "avg_days_between_scans",
        F.round(F.when(F.col("total_scans") > 1, (F.unix_micros("last_scan") - F.unix_micros("first_scan")) / 8.64e10 / (F.col("total_scans") - 1)).otherwise(0.0), 2),
    )


def compare_tables(history: DataFrame) -> DataFrame:
    now = latest_scans(history)
    by = F.struct("overall_score", "table_name")
    return now.agg(
        F.count(F.lit(1)).alias("tables"), F.max_by("table_name", by).alias("best_table"), F.min_by("table_name", by).alias("worst_table"),
        F.round(F.avg(F.coalesce("overall_score", F.lit(0.0))), 2).alias("avg_overall"),
    )


# --- issues

def _sla(col: Column, which: int) -> Column:
    out = F.lit(None).cast("int")
    for severity, hours in SLA_HOURS.items():
        out = F.when(col == severity, F.lit(hours[which])).otherwise(out)
    return out


def due_at(created: Column, severity: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(created.cast("timestamp")) + _sla(severity, 1).cast("bigint") * 3_600_000_000)


def issues_from_findings(findings: DataFrame, open_issues: DataFrame, created_at: str) -> DataFrame:
    """New issues for serious findings (table_name, dimension, priority, finding) without a similar open one.

    Similar means same table and dimension and the whole finding in the title, in any letter case.
    """
    serious = findings.where(F.col("priority").isin("CRITICAL", "HIGH")).withColumn("snippet", F.lower("finding"))
    known = open_issues.where(~F.col("status").isin(CLOSED_STATES)).select(
        F.col("table_name").alias("o_table"), F.col("dimension").alias("o_dimension"), F.lower("title").alias("o_title")
    )
    same = (F.col("table_name") == F.col("o_table")) & (F.col("dimension") == F.col("o_dimension")) & F.col("o_title").contains(F.col("snippet"))
    created = F.lit(created_at).cast("timestamp")
    return serious.join(known, same, "left_anti").select(
        "table_name", "dimension", F.col("priority").alias("severity"), F.col("finding").alias("title"), F.lit("Open").alias("status"),
        created.alias("created_at"), due_at(created, F.col("priority")).alias("due_at"),
    )


def issue_state(events: DataFrame) -> DataFrame:
    """Current state per issue from its events (issue_id, event_ts, seq, event, details).

    Events: created, assign (details = person), status (details = new status), comment, escalate.
    An assignment moves an open issue to Assigned; an explicit status stands until the next one.
    Every field is a partial aggregate, so an issue with very many events needs no ordering.
    """
    e, when_ = F.col("event"), F.struct("event_ts", "seq")
    pick = lambda name, value: F.max_by(F.when(e == name, F.col(value)), F.when(e == name, when_))
    moment = lambda cond: F.max(F.when(cond, when_))
    closing = (e == "status") & F.col("details").isin("Resolved", "Closed")
    folded = events.groupBy("issue_id").agg(
        F.min("event_ts").alias("created_at"), F.max("event_ts").alias("updated_at"), pick("status", "details").alias("explicit"),
        moment(e == "status").alias("status_at"), moment(e == "assign").alias("assigned_at"), pick("assign", "details").alias("assigned_to"),
        F.count_if(e == "escalate").alias("escalations"), F.count_if(e == "comment").alias("comments"), F.count(F.lit(1)).alias("history_length"),
        F.max(F.when(closing, F.col("event_ts"))).alias("resolved_at"),
    )
    base = F.coalesce("explicit", F.lit("Open"))
    moved = F.col("assigned_at").isNotNull() & (F.col("status_at").isNull() | (F.col("assigned_at") > F.col("status_at")))
    level = F.least(F.col("escalations"), F.lit(len(ESCALATION_CHAIN) - 1)).cast("int")
    return folded.select(
        "issue_id", F.when((base == "Open") & moved, "Assigned").otherwise(base).alias("status"), F.coalesce("assigned_to", F.lit("Unassigned")).alias("assigned_to"),
        level.alias("escalation_level"), F.element_at(F.array(*[F.lit(x) for x in ESCALATION_CHAIN]), level + 1).alias("escalated_to"),
        "comments", "history_length", "created_at", "updated_at", "resolved_at",
    )


def sla_breaches(issues: DataFrame, as_of: str) -> DataFrame:
    """Open issues past their due time with the hours overdue."""
    now = F.lit(as_of).cast("timestamp")
    late = (F.unix_micros(now) - F.unix_micros(F.col("due_at").cast("timestamp"))) / 3.6e9
    return issues.where(F.col("status").isin(OPEN_STATES) & (F.col("due_at").cast("timestamp") < now)).select(
        "issue_id", "severity", F.round(late, 1).alias("hours_overdue")
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    """Counts by severity, status and table in one grouping-sets pass."""
    g = issues.groupingSets([["severity"], ["status"], ["table_name"]], "severity", "status", "table_name").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n")
    )
    return g.select(
        F.when(F.col("gid") == 3, "severity").when(F.col("gid") == 5, "status").otherwise("table").alias("grouping"),
        F.when(F.col("gid") == 3, F.col("severity")).when(F.col("gid") == 5, F.col("status")).otherwise(F.col("table_name")).alias("label"), "n",
    )


def issue_dashboard(issues: DataFrame, as_of: str) -> DataFrame:
    opened, solved = F.col("status").isin(OPEN_STATES), F.col("status").isin("Resolved", "Verified", "Closed")
    hours = (F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3.6e9
    late = opened & (F.col("due_at").cast("timestamp") < F.lit(as_of).cast("timestamp"))
    return issues.agg(
        F.count_if(opened).alias("total_open"), F.count_if(solved).alias("total_resolved"), F.count_if(F.col("status") == "Wont Fix").alias("total_wont_fix"),
        F.count_if(late).alias("sla_breaches"), F.coalesce(F.round(F.avg(F.when(solved, hours)), 1), F.lit(0.0)).alias("avg_resolution_hours"),
        F.min_by(F.when(opened, F.col("issue_id")), F.when(opened, F.struct("created_at", "issue_id"))).alias("oldest_open"),
        F.count_if(opened & (F.col("assigned_to") == "Unassigned")).alias("unassigned"),
    )


def recently_resolved(issues: DataFrame, n: int = 5) -> DataFrame:
    return issues.where(F.col("status").isin("Resolved", "Verified", "Closed") & F.col("resolved_at").isNotNull()).orderBy(
        F.col("resolved_at").desc(), "issue_id"
    ).limit(n).select("issue_id", "resolved_at")


def steward_of(issues: DataFrame, stewards: DataFrame) -> DataFrame:
    """Issues with the steward registered for their table; unregistered tables show Unassigned."""
    return issues.join(stewards.select("table_name", "steward"), "table_name", "left").withColumn("steward", F.coalesce("steward", F.lit("Unassigned")))


# --- incidents

def automatic_incidents(degraded: DataFrame, drift: DataFrame, volume: DataFrame) -> DataFrame:
    """One incident per table and cause: quality drop, schema drift, volume anomaly.

    ``drift`` (table_name, change...) may hold many rows per table; ``volume`` has table_name and is_anomaly.
    """
    quality = degraded.where("degraded").select(
        "table_name", F.lit("Data Quality").alias("category"), F.lit("HIGH").alias("severity"), F.abs("overall_change").cast("double").alias("magnitude")
    )
    schema = drift.groupBy("table_name").agg(F.count(F.lit(1)).cast("double").alias("magnitude")).select(
        "table_name", F.lit("Schema").alias("category"), F.lit("CRITICAL").alias("severity"), "magnitude"
    )
    rows = volume.where("is_anomaly").select(
        "table_name", F.lit("Volume").alias("category"), F.lit("HIGH").alias("severity"), F.abs("change_pct").cast("double").alias("magnitude")
    )
    return quality.unionByName(schema).unionByName(rows).withColumn("status", F.lit("Open"))


def incident_stats(incidents: DataFrame) -> DataFrame:
    """Counts, mean time to repair, pending reviews and the commonest root cause.

    Input: one row per incident (status, severity, detected_at, resolved_at, root_cause, postmortem_complete).
    """
    hours = (F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("detected_at").cast("timestamp"))) / 3.6e9
    st, done = F.col("status"), F.coalesce("postmortem_complete", F.lit(False))
    totals = incidents.agg(
        F.count(F.lit(1)).alias("total_incidents"), F.count_if(st.isin(INCIDENT_OPEN_STATES)).alias("open"), F.count_if(st == "Resolved").alias("resolved"),
        F.count_if(st == "Closed").alias("closed"), F.round(F.avg(hours), 1).alias("mttr"), F.count_if(done).alias("postmortems_complete"),
        F.count_if((st == "Resolved") & ~done).alias("postmortems_pending"),
    )
    causes = incidents.where("root_cause IS NOT NULL").groupBy("root_cause").agg(F.count(F.lit(1)).alias("n"))
    common = causes.agg(F.max_by("root_cause", F.struct("n", "root_cause")).alias("most_common_root_cause"))
    return side_by_side(totals, common)


def incidents_by_severity(incidents: DataFrame) -> DataFrame:
    order = Window.partitionBy("category").orderBy(F.col("n").desc(), "severity")
    return incidents.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(order))


def session_summary(sizes: DataFrame, relationships: DataFrame) -> DataFrame:
    """Tables, rows, columns and detected relationships of a working set."""
    a = sizes.agg(
        F.count(F.lit(1)).alias("table_count"), F.sum("row_count").alias("total_rows"), F.sum("column_count").alias("total_columns"),
        F.max_by("table_name", F.struct("row_count", "table_name")).alias("primary_table"),
    )
    b = relationships.agg(F.count(F.lit(1)).alias("relationship_count"))
    return side_by_side(a, b)
