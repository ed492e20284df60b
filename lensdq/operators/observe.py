"""Baselines and observability: schema, volume and distribution drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensdq.functions.columns import as_double, clean, numeric_columns, side_by_side, string_columns
from lensdq.operators.longform import ordered_prefix, per_column, quantiles, top_values, value_counts
from lensdq.operators.stats import ks_p_value


def schema_snapshot(df: DataFrame) -> DataFrame:
    """(column_name, data_type, null_count) - what a later run is compared with."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    nulls = per_column(df, df.columns, {"null_count": lambda c: F.count_if(c.isNull())}, read=clean)
    meta = df.sparkSession.createDataFrame(list(types.items()), "column_name string, data_type string")
    return meta.join(F.broadcast(nulls.drop("ordinal")), "column_name")


def schema_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row per changed column from a full outer join of two snapshots."""
    b = baseline.toDF("column_name", "old_type", "old_nulls")
    c = current.toDF("column_name", "new_type", "new_nulls")
    change = (
        F.when(F.col("old_type").isNull(), "new")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
        .when((F.col("old_nulls") > 0) != (F.col("new_nulls") > 0), "nullability_changed")
    )
    severity = F.when(F.col("change").isin("removed", "type_changed"), "CRITICAL").when(F.col("change") == "new", "WARN").otherwise("OK")
    return b.join(c, "column_name", "full").withColumn("change", change).where("change IS NOT NULL").select(
        "column_name", "change", "old_type", "new_type", severity.alias("severity")
    )


def worst_severity(col: Column) -> Column:
    """CRITICAL beats WARN beats OK over a group; OK for an empty group."""
    rank = F.max(F.when(col == "CRITICAL", 2).when(col == "WARN", 1).otherwise(0))
    return F.when(rank == 2, "CRITICAL").when(rank == 1, "WARN").otherwise("OK")


def volume_anomaly(current: DataFrame, previous_rows: DataFrame, expected: tuple[int, int] | None = None) -> DataFrame:
    """Row count against the previous snapshot (one row, ``row_count``) and an optional expected range."""
    now = current.agg(F.count(F.lit(1)).alias("current_rows"))
    prev = previous_rows.select(F.col("row_count").alias("previous_rows"))
    change = F.when(F.col("previous_rows") > 0, F.round((F.col("current_rows") - F.col("previous_rows")) * 100.0 / F.col("previous_rows"), 1))
    outside = F.lit(False) if expected is None else ~F.col("current_rows").between(*expected)
    size = F.abs("change_pct")
    severity = F.when(outside | (size > 50), "CRITICAL").when(size > 20, "WARN").otherwise("OK")
    return side_by_side(now, prev).withColumn("change_pct", change).select(
        "current_rows", "previous_rows", "change_pct", severity.alias("severity"), (severity != "OK").alias("is_anomaly")
    )


def numeric_baseline(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns if columns is not None else numeric_columns(df)
    m = per_column(df, columns, {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min_value": F.min, "max_value": F.max}, read=as_double)
    q = quantiles(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return m.join(F.broadcast(q), "column_name").select(
        "column_name", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min_value", "max_value", "q25", "q50", "q75")]
    )


def categorical_baseline(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value, n, is_dominant): every value of the text columns; the most frequent one dominates."""
    columns = columns if columns is not None else string_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n bigint, is_dominant boolean")
    counts = value_counts(df, columns).where("value IS NOT NULL")
    # One row per column.
    return counts.join(F.broadcast(_dominant(counts)), "column_name").select("column_name", "value", "n", (F.col("value") == F.col("dominant")).alias("is_dominant"))


def _dominant(counts: DataFrame) -> DataFrame:
    """(column_name, dominant): the most frequent value, of equals the first in text order."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value")))
    return counts.groupBy("column_name").agg(best.alias("b")).select("column_name", F.col("b.value").alias("dominant"))


def top_categories(baseline: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` values per column of a categorical baseline, for display."""
    return top_values(baseline.select("column_name", "value", "n"), k).select("column_name", "rank", "value", "n", (F.col("rank") == 1).alias("is_dominant"))


def store_baseline(df: DataFrame, path: str, table_name: str, snapshot_ts: str) -> None:
    """Write schema, numeric and categorical baselines, partitioned by table, for later runs."""
    size = df.agg(F.count(F.lit(1)).alias("row_count"))
    for kind, frame in (
        ("schema", schema_snapshot(df)), ("numeric", numeric_baseline(df)), ("categorical", categorical_baseline(df)), ("volume", size),
    ):
        frame.select(F.lit(table_name).alias("table_name"), F.lit(snapshot_ts).alias("snapshot_ts"), "*").write.mode("append").partitionBy(
            "table_name"
        ).parquet(f"{path}/{kind}")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by the rational approximation of erf (error below 1.5e-7)."""
    a = F.abs(z) / 1.4142135623730951
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-a * a)
    return 0.5 * (1 + F.signum(z) * erf)


def ks_normal(df: DataFrame, column: str, mean: float, std: float) -> DataFrame:
    """One-sample distance of a column to Normal(mean, std) over all rows."""
    x = as_double(df, column)
    counts = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    running = ordered_prefix(counts, [F.col("v")], {"cum": F.col("c")})
    n = running.agg(F.sum("c").alias("n")).first()["n"]
    if not n:
        return df.sparkSession.createDataFrame([(column, None, None)], "column_name string, ks_stat double, p_value double")
    model = normal_cdf((F.col("v") - F.lit(mean)) / F.lit(std or 1.0))
    upper = F.abs(F.col("cum") / F.lit(n) - model)
    lower = F.abs((F.col("cum") - F.col("c")) / F.lit(n) - model)
    d = F.col("d")
    return running.agg(F.max(F.greatest(upper, lower)).alias("d")).select(
        F.lit(column).alias("column_name"), F.round(d, 4).alias("ks_stat"), F.round(ks_p_value(d, F.lit(float(n))), 6).alias("p_value")
    )


def numeric_drift(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """KS distance of each current column to the normal law its baseline moments describe."""
    known = {r["column_name"]: (r["mean"], r["std"]) for r in baseline.select("column_name", "mean", "std").collect()}
    parts = [ks_normal(df, c, *known[c]) for c in numeric_columns(df) if c in known and known[c][0] is not None]
    if not parts:
        return df.sparkSession.createDataFrame([], "column_name string, ks_stat double, p_value double, drifted boolean, score double")
    out = reduce(DataFrame.unionByName, parts)
    drifted = F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    return out.select("*", drifted.alias("drifted"), F.when(drifted, F.greatest(F.col("p_value") * 100, F.lit(0.0))).otherwise(100.0).alias("score"))


def categorical_drift(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """New and removed categories and a changed dominant value per text column with a baseline."""
    columns = string_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, new_categories bigint, removed_categories bigint, dominant_changed boolean, drifted boolean, score double")
    now = value_counts(df, columns).where("value IS NOT NULL")
    dominant = _dominant(now).withColumnRenamed("dominant", "now_dominant")
    here = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    base = baseline.select("column_name", "value", F.col("is_dominant"))
    known = base.groupBy("column_name").agg(F.max(F.when(F.col("is_dominant"), F.col("value"))).alias("old_dominant"))
    marks = now.select("column_name", "value", F.lit(1).alias("c"), F.lit(0).alias("b")).unionByName(
        base.select("column_name", "value", F.lit(0).alias("c"), F.lit(1).alias("b"))
    )
    per = marks.groupBy("column_name", "value").agg(F.max("c").alias("c"), F.max("b").alias("b")).groupBy("column_name").agg(
        F.count_if((F.col("c") == 1) & (F.col("b") == 0)).alias("new_categories"),
        F.count_if((F.col("c") == 0) & (F.col("b") == 1)).alias("removed_categories"),
    )
    # The lookups hold one row per column. A column whose values are all null now has lost all categories.
    out = per.join(F.broadcast(known), "column_name").join(F.broadcast(here), "column_name").join(F.broadcast(dominant), "column_name", "left")
    changed = ~F.col("old_dominant").eqNullSafe(F.col("now_dominant"))
    drifted = (F.col("new_categories") > 0) | (F.col("removed_categories") > 0) | changed
    return out.select(
        "column_name", "new_categories", "removed_categories", changed.alias("dominant_changed"), drifted.alias("drifted"),
        F.when(drifted, 50.0).otherwise(100.0).alias("score"),
    )


def distribution_summary(numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    both = numeric.select("column_name", "drifted", "score").unionByName(categorical.select("column_name", "drifted", "score"))
    return both.agg(
        F.count_if("drifted").alias("drifted_columns"), F.coalesce(F.round(F.avg("score"), 1), F.lit(100.0)).alias("overall_drift_score")
    )


def observability_report(table_name: str, schema: DataFrame, volume: DataFrame, distribution: DataFrame) -> DataFrame:
    """HEALTHY, WARN or CRITICAL for one table from its three checks."""
    s = schema.agg(worst_severity(F.col("severity")).alias("schema_severity"))
    v = volume.select(F.col("severity").alias("volume_severity"), "change_pct")
    status = (
        F.when((F.col("schema_severity") == "CRITICAL") | (F.col("volume_severity") == "CRITICAL"), "CRITICAL")
        .when((F.col("schema_severity") == "WARN") | (F.col("volume_severity") == "WARN") | (F.col("drifted_columns") > 0), "WARN")
        .otherwise("HEALTHY")
    )
    return side_by_side(s, v, distribution).select(
        F.lit(table_name).alias("table_name"), status.alias("health_status"), "schema_severity", "volume_severity", "change_pct",
        "drifted_columns", "overall_drift_score",
    )
