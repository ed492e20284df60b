"""Rationalisation of a report inventory: stale, duplicated and wasteful items and what to do with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensdq.functions.columns import percent, side_by_side

# Fixed rates: runs per day, cost per run, hours and rate per duplicate group, capacity per stale item.
RUNS_PER_DAY = {"4x daily": 4, "2x daily": 2, "1x daily": 1}
COST_PER_RUN = 0.12
DUPLICATE_HOURS, HOURLY_RATE = 20, 120
SEARCH_HOURS_PER_DAY, ANALYSTS, WORK_DAYS = 0.5, 200, 250
CAPACITY_PER_MONTH = 8.50
NEVER_VIEWED = 9999


def derive(inventory: DataFrame, as_of: str = "2026-02-01") -> DataFrame:
    """Add days since last view (9999 when never), age in days, and the normalised source set."""
    now = F.lit(as_of).cast("date")
    parts = F.transform(F.split(F.coalesce("source_tables", F.lit("")), ","), lambda s: F.lower(F.trim(s)))
    return inventory.select(
        "*",
        F.coalesce(F.datediff(now, F.col("last_viewed_date").cast("date")), F.lit(NEVER_VIEWED)).alias("days_since_viewed"),
        F.coalesce(F.datediff(now, F.col("created_date").cast("date")), F.lit(0)).alias("age_days"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda s: s != ""))), ",").alias("source_set"),
    )


def summary(derived: DataFrame) -> DataFrame:
    return derived.agg(
        F.count(F.lit(1)).alias("total_dashboards"), F.count_distinct("workspace").alias("total_workspaces"),
        F.count_distinct("owner_email").alias("total_owners"), F.floor(F.avg("age_days")).alias("avg_age_days"),
    )


def platform_split(derived: DataFrame) -> DataFrame:
    return derived.groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


def zombies(derived: DataFrame) -> DataFrame:
    """Items not viewed for over 90, 180 and 365 days."""
    n = F.count(F.lit(1))
    row = derived.agg(n.alias("total"), *[F.count_if(F.col("days_since_viewed") > d).alias(f"z{d}") for d in (90, 180, 365)])
    items = F.array(*[F.struct(F.lit(d).alias("over_days"), F.col(f"z{d}").alias("n"), percent(F.col(f"z{d}"), F.col("total"), 1).alias("pct")) for d in (90, 180, 365)])
    return row.select(F.explode(items).alias("s")).select("s.*")


def zombie_list(derived: DataFrame, over: int = 90) -> DataFrame:
    return derived.where(F.col("days_since_viewed") > over).select("dashboard_id", "workspace", "owner_email", "days_since_viewed").orderBy(
        F.col("days_since_viewed").desc(), "dashboard_id"
    )


def duplicate_groups(derived: DataFrame, at_least: int = 3, by: list[str] = ()) -> DataFrame:
    """Source sets shared by several items, regardless of the order the sources are listed in."""
    return derived.where("source_set <> ''").groupBy(*by, "source_set").agg(
        F.count(F.lit(1)).alias("members"), F.sum("view_count_30d").alias("views")
    ).where(F.col("members") >= at_least)


def _daily_runs():
    runs = F.lit(0)
    for name, n in RUNS_PER_DAY.items():
        runs = F.when(F.col("refresh_schedule") == name, n).otherwise(runs)
    return runs


def wasted_refreshes(derived: DataFrame) -> DataFrame:
    """Items refreshed daily or more that nobody viewed, with their yearly cost."""
    return derived.where(F.col("refresh_schedule").isin(list(RUNS_PER_DAY)) & (F.col("view_count_30d") == 0)).withColumn(
        "annual_cost", F.round(_daily_runs() * 365 * COST_PER_RUN, 2)
    )


def refresh_waste(derived: DataFrame) -> DataFrame:
    return wasted_refreshes(derived).groupBy("refresh_schedule").agg(
        F.count(F.lit(1)).alias("wasted_refreshes"), F.round(F.sum("annual_cost"), 2).alias("annual_cost")
    )


def workspace_health(derived: DataFrame) -> DataFrame:
    """Size, stale share, duplicate groups and mean views per workspace."""
    base = derived.groupBy("workspace").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("days_since_viewed") > 90).alias("stale"), F.round(F.avg("view_count_30d"), 1).alias("avg_views")
    )
    groups = duplicate_groups(derived, by=["workspace"]).groupBy("workspace").agg(F.count(F.lit(1)).alias("groups"))
    return base.join(groups, "workspace", "left").select(
        "workspace", "total", percent(F.col("stale"), F.col("total"), 1).alias("zombie_pct"), F.coalesce("groups", F.lit(0)).alias("duplicate_groups"), "avg_views"
    )


def cost_impact(derived: DataFrame) -> DataFrame:
    """Four cost components and their total."""
    waste = wasted_refreshes(derived).agg(F.coalesce(F.sum("annual_cost"), F.lit(0.0)).alias("waste"))
    groups = duplicate_groups(derived).agg(F.count(F.lit(1)).alias("g"))
    stale = derived.agg(F.count_if(F.col("days_since_viewed") > 90).alias("z"))
    search = SEARCH_HOURS_PER_DAY * HOURLY_RATE * ANALYSTS * WORK_DAYS
    parts = side_by_side(waste, groups, stale).select(
        F.round("waste", 2).alias("zombie_refresh_waste"), (F.col("g") * float(DUPLICATE_HOURS * HOURLY_RATE)).alias("duplicate_maintenance"),
        F.lit(search).alias("analyst_search_time"), F.round(F.col("z") * (CAPACITY_PER_MONTH * 12), 2).alias("premium_capacity_waste"),
    )
    return parts.withColumn("total_annual_waste", F.round(sum((F.col(c) for c in parts.columns), F.lit(0.0)), 2))


def actions(derived: DataFrame) -> DataFrame:
    """(action, item): retire, archive, consolidate, reduce refresh, certify."""
    stale = F.col("days_since_viewed")
    item = F.col("dashboard_id").cast("string").alias("item")
    pick = lambda name, cond: derived.where(cond).select(F.lit(name).alias("action"), item)
    groups = duplicate_groups(derived).select(F.lit("consolidate").alias("action"), F.col("source_set").alias("item"))
    return (
        pick("retire", stale > 365)
        .unionByName(pick("archive", (stale > 180) & (stale <= 365)))
        .unionByName(groups)
        .unionByName(wasted_refreshes(derived).select(F.lit("reduce_refresh").alias("action"), item))
        .unionByName(pick("certify", (stale <= 30) & (F.col("view_count_30d") >= 20) & ~F.coalesce("is_certified", F.lit(False))))
    )


def retirement_plan(derived: DataFrame) -> DataFrame:
    """Three phases: over a year stale, half a year to a year stale, members of duplicate groups."""
    stale = F.col("days_since_viewed")
    row = derived.agg(F.count_if(stale > 365).alias("p1"), F.count_if((stale > 180) & (stale <= 365)).alias("p2"))
    dup = duplicate_groups(derived).agg(F.coalesce(F.sum("members"), F.lit(0)).alias("p3"))
    phases = F.array(*[F.struct(F.lit(f"phase_{i}").alias("phase"), F.lit(w).alias("timeline"), F.col(f"p{i}").alias("n"))
                       for i, w in ((1, "this week"), (2, "30 days"), (3, "60 days"))])
    return side_by_side(row, dup).select(F.explode(phases).alias("s")).select("s.*")
