"""Ordered calculations: trends, gaps, previous rows, ranks, running totals, period to date.

Ranks, running values and lookups take rows in any number and any partition: they run over range
partitions and carry state between them. Period to date works on view rows, that is on data first
summed per key and period, so the calendar bounds every window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensdq.functions.columns import all_of, as_double, quoted
from lensdq.operators.longform import time_gaps
from lensdq.operators.ranking import carried, digits, rank_cuts, running_folds, scanned, with_totals


def early_late_trends(df: DataFrame, order: list[str], values: list[str], share: float = 0.1, use: str = "sum") -> DataFrame:
    """Per value, its change from the first to the last ``share`` of rows in order, by sums or means; over 5% is a trend.

    Rows with a null value or order count for nothing; ties in the order go by the value. The two
    edges of all values are found together by ``rank_cuts``, so no row is sorted or moved.
    """
    keys = [d for o in order for d in digits(df, o)]
    present = all_of([F.col(quoted(o)).isNotNull() for o in order])
    x = {v: as_double(df, v) for v in values}
    sizes = df.agg(*[F.count_if(present & x[v].isNotNull()).alias(f"n{i}") for i, v in enumerate(values)]).first()
    n = {v: sizes[i] for i, v in enumerate(values)}
    edge = {v: max(1, int(n[v] * share)) for v in values}
    spots = {f"{side}{i}": (present & x[v].isNotNull(), [*keys, x[v]], edge[v] - 1 if side == "f" else n[v] - edge[v]) for i, v in enumerate(values) if n[v] for side in "fl"}
    cuts = rank_cuts(df, spots)
    aggs, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, v in enumerate(values):
        first = last = F.lit(None).cast("double")
        if n[v]:
            f, l = cuts[f"f{i}"], cuts[f"l{i}"]
            for name, side, rest in ((f"f{i}", f.before(), f.at()), (f"l{i}", l.after(), l.at())):
                aggs += [F.sum(F.when(side, x[v])).alias(name), F.max(F.when(rest, x[v])).alias(f"{name}_at")]
            divide = 1 if use == "sum" else edge[v]
            first = (F.coalesce(f"f{i}", F.lit(0.0)) + F.col(f"f{i}_at") * (edge[v] - f.less)) / divide
            last = (F.coalesce(f"l{i}", F.lit(0.0)) + F.col(f"l{i}_at") * (l.less + l.equal - (n[v] - edge[v]))) / divide
        rows.append(F.struct(F.lit(v).alias("value"), F.lit(n[v]).cast("bigint").alias("n"), first.alias("first_value"), last.alias("last_value")))
    first, last = F.col("first_value"), F.col("last_value")
    change = F.when(first != 0, (last - first) / F.abs(first) * 100).otherwise(0.0)
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*").select(
        "value", "n", F.round(first, 4).alias("first_value"), F.round(last, 4).alias("last_value"), F.round(change, 2).alias("pct_change"),
        F.when(change > 5, "upward").when(change < -5, "downward").otherwise("stable").alias("trend"),
    )


def early_late_trend(df: DataFrame, order: list[str], value: str, share: float = 0.1, use: str = "sum") -> DataFrame:
    """``early_late_trends`` of one value."""
    return early_late_trends(df, order, [value], share, use).drop("value")


def series_change(series: DataFrame, period: str = "period", y: str = "y") -> DataFrame:
    """First against last period and the peak of a (period, y) series."""
    first, last = F.col("first_y"), F.col("last_y")
    pct = F.when(first != 0, F.round((last - first) / F.abs(first) * 100)).otherwise(0.0)
    return series.agg(
        F.count(F.lit(1)).alias("periods"), F.sum(y).alias("total"), F.min_by(y, period).alias("first_y"), F.max_by(y, period).alias("last_y"),
        F.max(F.struct(F.col(y).alias("y"), (-F.unix_date(F.col(period))).alias("d"), F.col(period).cast("string").alias("p"))).alias("peak"),
    ).select(
        "periods", F.round("total", 2).alias("total"), "first_y", "last_y", pct.alias("pct_change"),
        F.col("peak.p").alias("peak_period"), F.col("peak.y").alias("peak_y"),
        F.when(pct > 5, "upward").when(pct < -5, "downward").otherwise("stable").alias("trend"),
    )


def gaps(df: DataFrame, ts: str) -> DataFrame:
    """(prev_ts, ts, gap_seconds) of consecutive distinct stamps."""
    return time_gaps(df, ts).select("prev_ts", "ts", (F.col("gap_us") / 1e6).alias("gap_seconds"))


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The last ``n`` rows per key with their recency rank; Spark trims each key map-side first."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def ranks(view: DataFrame, measure: str, partition: list[str] = (), tie: list[str] = ()) -> DataFrame:
    """rank, dense rank, unique rank and index of rows by descending measure.

    Rows are range-partitioned by (partition, measure, tie); a run of equal measures that spans
    partitions is carried on, so one partition value, or none, spreads over tasks. Ties without
    ``tie`` columns are in no certain order.
    """
    group, y = list(partition), F.col(quoted(measure))
    placed = scanned(view, group, [y.desc(), *[F.col(quoted(t)) for t in tie]])
    placed = carried(placed, group, {"_last": (F.max_by(F.struct(y.alias("y")), "_mid"), lambda s: F.last(s, True))})
    inside = Window.partitionBy("_pid", *group).orderBy("_mid")
    before = F.coalesce(F.lag(F.struct(y.alias("y"))).over(inside), F.col("_last"))
    runs = placed.withColumn("_new", (F.col("_at") == 0) | before.isNull() | ~before["y"].eqNullSafe(y)).drop("_last")
    found = running_folds(runs, group, {"rank": (F.when(F.col("_new"), F.col("_at") + 1), "last"), "dense_rank": (F.col("_new").cast("int"), "sum")})
    ranked = found.select(*view.columns, "rank", "dense_rank", (F.col("_at") + 1).alias("unique_rank"))
    if not tie:
        return ranked.withColumn("index", F.col("unique_rank"))
    names = ranked.columns
    return scanned(ranked, group, [F.col(quoted(t)) for t in tie]).select(*names, (F.col("_at") + 1).alias("index"))


def running(view: DataFrame, measure: str, order: list[str], partition: list[str] = ()) -> DataFrame:
    """Running sum, average, count, minimum, maximum and whole-partition totals, carried between range partitions."""
    group, x = list(partition), F.col(quoted(measure))
    placed = scanned(view, group, [F.col(quoted(o)) for o in order])
    kinds = {f"running_{k}": (x, k) for k in ("sum", "count", "min", "max")}
    found = running_folds(placed, group, kinds).withColumn("running_avg", F.when(F.col("running_count") > 0, F.col("running_sum") / F.col("running_count")))
    whole = with_totals(found, group, {"window_sum": F.sum(x), "window_avg": F.avg(x), "size": F.count(F.lit(1))})
    return whole.select(*view.columns, "running_sum", "running_avg", "running_count", "running_min", "running_max", "window_sum", "window_avg", "size")


def lookups(view: DataFrame, measure: str, order: list[str], partition: list[str] = (), offset: int = 1) -> DataFrame:
    """Neighbouring values and offsets: LOOKUP back and ahead, FIRST, LAST, accumulated PREVIOUS_VALUE.

    Neighbours meet by their place in the partition, so they may lie in other range partitions.
    """
    group, x = list(partition), F.col(quoted(measure))
    placed = running_folds(scanned(view, group, [F.col(quoted(o)) for o in order]), group, {"previous_value_sum": (x, "sum")})
    out = with_totals(placed, group, {"_n": F.count(F.lit(1))})
    for name, shift in (("lookup_back", offset), ("lookup_ahead", -offset)):
        other = placed.select(*[F.col(quoted(g)).alias(f"_o{i}") for i, g in enumerate(group)], (F.col("_at") + shift).alias("_o_at"), x.alias(name))
        same = all_of([out[quoted(g)].eqNullSafe(F.col(f"_o{i}")) for i, g in enumerate(group)])
        out = out.join(other, same & (F.col("_at") == F.col("_o_at")), "left").drop("_o_at", *[f"_o{i}" for i in range(len(group))])
    return out.select(*view.columns, "lookup_back", "lookup_ahead", (-F.col("_at")).alias("first_offset"), (F.col("_n") - 1 - F.col("_at")).alias("last_offset"), "previous_value_sum")


def monthly(df: DataFrame, ts: str, measure: str, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.trunc(F.col(quoted(ts)).cast("date"), "month").alias("month")).agg(F.sum(as_double(df, measure)).alias("y"))


def period_to_date(view: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Year- and quarter-to-date sums of a monthly (keys, month, y) view."""
    def upto(*grain: Column):
        return Window.partitionBy(*keys, *grain).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)

    return view.select(
        "*", F.sum("y").over(upto(F.year("month"))).alias("ytd"), F.sum("y").over(upto(F.year("month"), F.quarter("month"))).alias("qtd")
    )


def same_period_last_year(view: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Each month beside the same month one year earlier, from an equi join on the shifted month."""
    before = view.select(*keys, F.add_months("month", 12).alias("month"), F.col("y").alias("last_year"))
    return view.join(before, [*keys, "month"], "left").withColumn(
        "yoy_pct", F.when(F.col("last_year") != 0, (F.col("y") - F.col("last_year")) / F.abs("last_year") * 100)
    )
