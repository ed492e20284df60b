"""Chart-ready aggregates, filters, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensdq.functions.columns import all_of, as_double, as_text, percent, quoted, side_by_side, temporal_columns
from lensdq.functions.typing import semantic_types

ALL = "__ALL__"

AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max,
}


# --- filters

def equality_filter(df: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """AND of ``column = value`` compared as text; ``__ALL__`` and empty choices are ignored."""
    active = {c: v for c, v in chosen.items() if v and v != ALL}
    return df.where(all_of([as_text(df, c) == v for c, v in active.items()])) if active else df


def filter_values(df: DataFrame, columns: list[str], limit: int = 100, max_columns: int = 5) -> DataFrame:
    """Sorted choice lists: at most ``limit`` values of at most ``max_columns`` columns."""
    out = None
    for c in columns[:max_columns]:
        col = F.col(quoted(c))
        part = (
            df.where(col.isNotNull()).select(col.alias("v")).distinct().orderBy("v").limit(limit)
            .select(F.lit(c).alias("column_name"), F.col("v").cast("string").alias("value"))
        )
        out = part if out is None else out.unionByName(part)
    return out


def drop_footnotes(df: DataFrame) -> DataFrame:
    """Rows whose first column does not start with an asterisk."""
    return df.where(~F.coalesce(_is_footnote(df), F.lit(False)))


def footnote_report(df: DataFrame) -> DataFrame:
    note = F.coalesce(_is_footnote(df), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(note).alias("dropped_rows"), F.count_if(~note).alias("kept_rows")
    )


def _is_footnote(df: DataFrame) -> Column:
    return F.col(quoted(df.columns[0])).cast("string").startswith("*")


# --- aggregates

def group_label(df: DataFrame, key: str) -> Column:
    return F.coalesce(F.when(as_text(df, key) != "", as_text(df, key)), F.lit("Unknown"))


def group_aggregate(
    df: DataFrame, key: str, measure: str, agg: str = "sum", sort: str | None = "desc", top_n: int | None = None
) -> DataFrame:
    """(x, y) per group; missing keys become 'Unknown'; ties in the top N break by key."""
    y = as_double(df, measure)
    out = df.where(y.isNotNull()).groupBy(group_label(df, key).alias("x")).agg(F.round(AGGREGATES[agg](y), 2).cast("double").alias("y"))
    if sort:
        out = out.orderBy(F.col("y").desc() if sort == "desc" else F.col("y").asc(), F.col("x").asc())
    return out.limit(top_n) if top_n else out


def two_key_aggregate(df: DataFrame, x: str, series: str, measure: str, max_x: int = 20, max_series: int = 12) -> DataFrame:
    """Sums per (x, series) for the first ``max_x`` x keys and ``max_series`` series by name."""
    sums = df.groupBy(as_text(df, x).alias("x"), as_text(df, series).alias("series")).agg(
        F.round(F.sum(as_double(df, measure)), 2).alias("y")
    )
    keep_x = sums.select("x").distinct().orderBy("x").limit(max_x)
    keep_s = sums.select("series").distinct().orderBy("series").limit(max_series)
    # The kept keys are limited to max_x and max_series rows.
    return sums.join(F.broadcast(keep_x), "x", "left_semi").join(F.broadcast(keep_s), "series", "left_semi")


def heatmap(df: DataFrame, x: str, series: str, measure: str, values: list[str]) -> DataFrame:
    """One row per x, one column per given series value; empty cells are 0."""
    wide = df.groupBy(as_text(df, x).alias("x")).pivot(series, values).agg(F.round(F.sum(as_double(df, measure)), 2))
    return wide.na.fill(0.0)


def kpis(df: DataFrame, measures: list[str]) -> DataFrame:
    from lensdq.operators.longform import per_column

    return per_column(
        df, measures,
        {"total": lambda c: F.round(F.sum(c), 2), "average": lambda c: F.round(F.avg(c), 4), "min_value": F.min, "max_value": F.max},
        read=as_double,
    ).drop("ordinal")


def auto_grain(df: DataFrame, ts: str) -> str:
    """quarter, month, week or day, from the covered number of days (one driver-side number)."""
    stamp = F.col(quoted(ts)).cast("timestamp")
    days = df.agg(((F.unix_micros(F.max(stamp)) - F.unix_micros(F.min(stamp))) / 8.64e10).alias("d")).first()["d"] or 0
    return "quarter" if days > 730 else "month" if days > 180 else "week" if days > 30 else "day"


def time_aggregate(df: DataFrame, ts: str, measure: str, agg: str = "sum", grain: str | None = None) -> DataFrame:
    """(period, y) with the grain chosen from the date range."""
    stamp, y = F.col(quoted(ts)).cast("timestamp"), as_double(df, measure)
    grain = grain or auto_grain(df, ts)
    period = F.date_trunc(grain, stamp).cast("date")
    return df.where(stamp.isNotNull() & y.isNotNull()).groupBy(period.alias("period")).agg(
        F.round(AGGREGATES[agg](y), 2).alias("y")
    )


def concentration(df: DataFrame, key: str, measure: str) -> DataFrame:
    """Share of the top 1, 3 and 5 groups in the total."""
    groups = df.where(F.col(quoted(key)).isNotNull()).groupBy(as_text(df, key).alias("x")).agg(F.sum(as_double(df, measure)).alias("y"))
    total = groups.agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("group_count"))
    top = groups.orderBy(F.col("y").desc(), "x").limit(5)
    ranked = top.withColumn("rk", F.row_number().over(Window.orderBy(F.col("y").desc(), "x")))
    best = ranked.agg(
        F.max(F.when(F.col("rk") == 1, F.col("x"))).alias("top_value"),
        *[F.sum(F.when(F.col("rk") <= n, F.col("y"))).alias(f"s{n}") for n in (1, 3, 5)],
    )
    return side_by_side(best, total).select(
        F.lit(key).alias("dimension"), "top_value", "group_count",
        *[percent(F.col(f"s{n}"), F.col("total"), 2).alias(f"top{n}_pct") for n in (1, 3, 5)],
    )


def histogram(df: DataFrame, measure: str, bins: int = 20) -> DataFrame:
    """Equal-width counts between minimum and maximum; the last bin includes the maximum."""
    x = as_double(df, measure)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    width = ((hi - lo) / bins if lo is not None else 0) or 1.0
    index = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    return df.where(x.isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("bin_start"), "n"
    )


def scatter_label(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of two measures over all rows with its strength and direction."""
    a, b = as_double(df, x), as_double(df, y)
    r = F.col("r")
    both = F.when(a.isNotNull() & b.isNotNull(), 1)
    return df.agg(F.count(both).alias("points"), F.coalesce(F.corr(a, b), F.lit(0.0)).alias("r")).select(
        "points", F.round("r", 4).alias("r"),
        F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak").alias("strength"),
        F.when(r > 0.1, "positive").when(r < -0.1, "negative").otherwise("no clear").alias("direction"),
    )


def chart_plan(df: DataFrame) -> list[dict]:
    """Which aggregates to draw, from column roles and distinct counts (schema-sized facts)."""
    roles = semantic_types(df, "dashboard").collect()
    by = {k: [c for c in df.columns if any(r["column_name"] == c and r["semantic_type"] == k for r in roles)] for k in ("numeric", "categorical", "date")}
    distinct = {r["column_name"]: r["distinct_count"] for r in roles}
    num, cat, date = by["numeric"], by["categorical"], by["date"]
    few = [c for c in cat if distinct[c] <= 8]
    plan = []

    def put(ok, **chart):
        if ok:
            plan.append(chart)

    put(date and num, type="line", x=date[:1], y=num[:1])
    put(cat and num, type="bar", x=cat[:1], y=num[:1], top_n=15)
    if len(cat) > 1:
        put(num, type="hbar", x=cat[1:2], y=num[:1], top_n=12)
    else:
        put(cat and len(num) > 1, type="hbar", x=cat[:1], y=num[1:2], top_n=12)
    put(few and num, type="donut", x=few[:1], y=num[:1])
    put(len(num) >= 2, type="scatter", x=num[:1], y=num[1:2])
    put(date and len(num) > 1, type="area", x=date[:1], y=num[1:2])
    put(len(cat) > 2 and num, type="bar", x=cat[2:3], y=num[:1], top_n=15)
    put(len(few) > 1 and num, type="donut", x=few[1:2], y=num[:1])
    return [{**c, "x": c["x"][0], "y": c["y"][0]} for c in plan]


def run_charts(df: DataFrame, plan: list[dict] | None = None) -> DataFrame:
    """The planned aggregates as one long table (chart, type, x, y)."""
    out = None
    for i, c in enumerate(plan if plan is not None else chart_plan(df)):
        if c["type"] in ("line", "area"):
            data = time_aggregate(df, c["x"], c["y"]).select(F.col("period").cast("string").alias("x"), "y")
        elif c["type"] == "scatter":
            data = scatter_label(df, c["x"], c["y"]).select(F.concat_ws(" ", "strength", "direction").alias("x"), F.col("r").alias("y"))
        else:
            data = group_aggregate(df, c["x"], c["y"], top_n=c.get("top_n"))
        part = data.select(F.lit(i).alias("chart"), F.lit(c["type"]).alias("type"), "x", "y")
        out = part if out is None else out.unionByName(part)
    return out


def report_pack(df: DataFrame, dimensions: list[str], measure: str) -> DataFrame:
    """Totals of a measure by each dimension and overall, from one grouping-sets aggregation."""
    sets = [[]] + [[d] for d in dimensions]
    g = df.groupingSets(sets, *dimensions).agg(
        F.round(F.sum(as_double(df, measure)), 2).alias("total"), F.count(F.lit(1)).alias("row_count"),
        *[F.grouping(d).alias(f"g_{d}") for d in dimensions],
    )
    level, label = F.lit("all"), F.lit("*")
    for d in dimensions:
        level = F.when(F.col(f"g_{d}") == 0, d).otherwise(level)
        label = F.when(F.col(f"g_{d}") == 0, F.col(d).cast("string")).otherwise(label)
    return g.select(level.alias("dimension"), label.alias("label"), "total", "row_count")


# --- sorting and sets

def top_groups(df: DataFrame, key: str, measure: str, n: int = 12) -> DataFrame:
    return group_aggregate(df, key, measure, "sum", "desc", n)


def sort_rows(df: DataFrame, column: str, descending: bool = True, then: list[str] = ()) -> DataFrame:
    c = F.col(quoted(column))
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *then)


def union_tagged(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias(tag), "*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(quoted(column)).isNotNull()).select(F.col(quoted(column)).alias("value")).distinct()


def common_values(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    return distinct_values(left, left_col).intersect(distinct_values(right, right_col))


def missing_values(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    return distinct_values(left, left_col).subtract(distinct_values(right, right_col))


def date_columns(df: DataFrame) -> list[str]:
    return temporal_columns(df)
