"""Column and table profiling."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensdq.functions.columns import (
    any_of, as_double, as_text, clean, is_numeric, numeric_columns,
    percent, quoted, side_by_side, string_columns, temporal_columns, type_label,
)
from lensdq.functions.typing import semantic_types
from lensdq.functions.wordlists import DIMENSION_HINTS, KPI_HINTS
from lensdq.operators.dependencies import column_counts, holding
from lensdq.operators.longform import (
    distinct_stats, full_row_counts, gap_median, per_column, quantiles, time_gaps, top_values, value_counts,
)

FOREIGN_KEY_NAME = re.compile(r"(_id|_key|_code|Id$|Key$|Code$)")


def columns_frame(df: DataFrame) -> DataFrame:
    """Schema as rows: (column_name, ordinal, data_type, is_numeric, is_potential_fk)."""
    rows = [
        (f.name, i, type_label(f.dataType), is_numeric(f.dataType), bool(FOREIGN_KEY_NAME.search(f.name)))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, ordinal int, data_type string, is_numeric boolean, is_potential_fk boolean"
    )


def column_profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """One row per column: nulls, distinct values, key hints, numeric and text statistics, sample values."""
    counts = value_counts(df, df.columns)
    base = distinct_stats(counts)
    pick = Window.partitionBy("column_name").orderBy("value")
    examples = (
        counts.where(F.col("value").isNotNull())
        .withColumn("rk", F.row_number().over(pick))
        .where(F.col("rk") <= samples)
        .groupBy("column_name")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "value"))), lambda s: s["value"]), "|").alias("sample_values"))
    )
    texts = string_columns(df)
    size, weight = F.length("value"), F.col("n")
    lengths = (
        counts.where(F.col("column_name").isin(texts) & F.col("value").isNotNull())
        .groupBy("column_name")
        .agg(
            F.min(size).cast("bigint").alias("min_length"),
            F.max(size).cast("bigint").alias("max_length"),
            F.round(F.sum(size * weight) / F.sum(weight), 1).alias("avg_length"),
        )
    )
    stats = per_column(
        df,
        numeric_columns(df),
        {
            "min_value": F.min,
            "max_value": F.max,
            "mean": lambda c: F.round(F.avg(c), 4),
            "std": lambda c: F.round(F.stddev_samp(c), 4),
        },
        read=as_double,
    ).drop("ordinal")
    # Every side below has one row per column of the table.
    return (
        columns_frame(df)
        .join(F.broadcast(base), "column_name", "left")
        .join(F.broadcast(examples), "column_name", "left")
        .join(F.broadcast(lengths), "column_name", "left")
        .join(F.broadcast(stats), "column_name", "left")
        .select(
            "column_name",
            "data_type",
            F.coalesce("null_count", F.lit(0)).alias("null_count"),
            percent(F.col("null_count"), F.col("row_count")).alias("null_pct"),
            F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
            percent(F.col("distinct_count"), F.col("row_count")).alias("distinct_pct"),
            F.coalesce(
                (F.col("distinct_count") == F.col("row_count")) & (F.col("null_count") == 0), F.lit(False)
            ).alias("is_potential_pk"),
            "is_potential_fk",
            "min_value",
            "max_value",
            "mean",
            "std",
            "min_length",
            "max_length",
            "avg_length",
            "sample_values",
        )
    )


def sample_skewness(population: Column, n: Column) -> Column:
    return F.when(n > 2, population * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(population: Column, n: Column) -> Column:
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population + 6))


def fences(df: DataFrame, columns: list[str], reach: float = 1.5) -> dict[str, tuple[float, float, float]]:
    """Per column (q25, q75, interquartile range) as plain numbers; a few values per column."""
    rows = quantiles(df, columns, {"q25": 0.25, "q75": 0.75}).collect()
    return {r["column_name"]: (r["q25"], r["q75"], r["q75"] - r["q25"]) for r in rows if r["q25"] is not None}


def outside(col: Column, bounds: tuple[float, float, float], reach: float = 1.5) -> Column:
    q25, q75, iqr = bounds
    return (col < F.lit(q25 - reach * iqr)) | (col > F.lit(q75 + reach * iqr))


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Moments, quartiles, distribution shape, fence outliers, zero and negative counts per numeric column."""
    columns = columns if columns is not None else numeric_columns(df)
    quart = quantiles(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    limits = {
        r["column_name"]: (r["q25"], r["q75"], r["q75"] - r["q25"]) for r in quart.collect() if r["q25"] is not None
    }
    metrics = {
        "n": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min_value": F.min,
        "max_value": F.max,
        "total": F.sum,
        "skew_pop": F.skewness,
        "kurt_pop": F.kurtosis,
        "zero_count": lambda c: F.count(F.when(c == 0, 1)),
        "negative_count": lambda c: F.count(F.when(c < 0, 1)),
    }
    moments = per_column(df, columns, metrics, read=as_double)
    hits = df.agg(
        *[
            F.count(F.when(outside(as_double(df, c), limits[c]), 1)).alias(f"o{i}")
            if c in limits
            else F.lit(0).cast("bigint").alias(f"o{i}")
            for i, c in enumerate(columns)
        ]
    ).select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"o{i}").alias("outlier_count")) for i, c in enumerate(columns)])
        ).alias("s")
    ).select("s.*")
    n = F.col("n").cast("double")
    skew, kurt = sample_skewness(F.col("skew_pop"), n), sample_kurtosis(F.col("kurt_pop"), n)
    iqr = F.col("q75") - F.col("q25")
    shape = (
        F.when((F.abs(F.col("skewness")) < 0.5) & (F.abs(F.col("kurtosis")) < 1), "approximately_normal")
        .when(F.col("skewness") > 1, "right_skewed")
        .when(F.col("skewness") < -1, "left_skewed")
        .when(F.col("kurtosis") > 3, "heavy_tailed")
        .otherwise("moderate_skew")
    )
    return (
        moments.join(F.broadcast(quart), "column_name")
        .join(F.broadcast(hits), "column_name")
        .withColumn("skewness", skew)
        .withColumn("kurtosis", kurt)
        .select(
            "column_name",
            "n",
            *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "min_value", "max_value", "q25", "q75")],
            F.round("total", 2).alias("total"),
            (F.round("skewness", 3) + F.lit(0.0)).alias("skewness"),
            F.round("kurtosis", 3).alias("kurtosis"),
            shape.alias("shape"),
            F.round(F.col("q25") - 1.5 * iqr, 2).alias("lower_fence"),
            F.round(F.col("q75") + 1.5 * iqr, 2).alias("upper_fence"),
            "outlier_count",
            percent(F.col("outlier_count"), F.col("n"), 1).alias("outlier_pct"),
            "zero_count",
            "negative_count",
            percent(F.col("negative_count"), F.col("n"), 1).alias("negative_pct"),
        )
    )


def categorical_profile(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """Top values per text column with share, mode concentration and dominance flag."""
    columns = columns if columns is not None else string_columns(df)
    counts = value_counts(df, columns)
    totals = distinct_stats(counts).select(
        "column_name", (F.col("row_count") - F.col("null_count")).alias("present"), "top_count"
    )
    lead = F.col("top_count") / F.col("present")
    return (
        top_values(counts, k)
        .join(F.broadcast(totals), "column_name")
        .select(
            "column_name",
            "rank",
            "value",
            "n",
            percent(F.col("n"), F.col("present"), 1).alias("pct"),
            percent(F.col("top_count"), F.col("present"), 1).alias("concentration_pct"),
            F.when(lead > 0.9, "near_constant").when(lead > 0.5, "dominant_value").otherwise("none").alias("flag"),
        )
    )


def datetime_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Range, gap structure and monthly seasonality hint per temporal column."""
    columns = columns if columns is not None else temporal_columns(df)
    out = None
    for c in columns:
        stamp = F.col(quoted(c)).cast("timestamp")
        by_stamp = df.where(stamp.isNotNull()).groupBy(stamp.alias("ts")).agg(F.count(F.lit(1)).alias("n"))
        gaps = time_gaps(df, c)
        median = gap_median(gaps, by_stamp.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("zeros")))
        widest = gaps.agg(F.max("gap_us").alias("max_gap_us"))
        months = by_stamp.groupBy(F.month("ts").alias("m")).agg(F.sum("n").alias("n")).agg(
            (F.stddev_samp("n") / F.avg("n")).alias("month_cv")
        )
        bounds = by_stamp.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        row = side_by_side(bounds, median, widest, months)
        days = F.floor((F.unix_micros("hi") - F.unix_micros("lo")) / F.lit(86_400_000_000))
        large = F.coalesce(F.col("max_gap_us") > F.col("median_gap_us") * 5, F.lit(False))
        row = row.select(
            F.lit(c).alias("column_name"),
            F.date_format("lo", "yyyy-MM-dd HH:mm:ss").alias("min_date"),
            F.date_format("hi", "yyyy-MM-dd HH:mm:ss").alias("max_date"),
            days.alias("range_days"),
            large.alias("has_large_gaps"),
            F.when(large, F.floor(F.col("max_gap_us") / F.lit(86_400_000_000))).alias("largest_gap_days"),
            F.when((days > 365) & (F.col("month_cv") > 0.3), "possible_monthly_pattern").otherwise("none").alias(
                "seasonality_hint"
            ),
        )
        out = row if out is None else out.unionByName(row)
    return out


def quality_summary(df: DataFrame) -> DataFrame:
    """Cells, nulls, duplicate rows, and the lists of null, constant and high-cardinality columns."""
    stats = distinct_stats(value_counts(df, df.columns))
    texts = string_columns(df)

    def names(cond: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("column_name")))), ",")

    per = stats.agg(
        F.sum("row_count").alias("total_cells"),
        F.sum("null_count").alias("total_nulls"),
        names(F.col("null_count") > 0).alias("columns_with_nulls"),
        names(F.col("distinct_count") <= 1).alias("constant_columns"),
        names(F.col("column_name").isin(texts) & (F.col("distinct_count") > 100)).alias("high_cardinality_text"),
    )
    dups = full_row_counts(df)
    return side_by_side(per, dups.withColumnRenamed("row_count", "rows")).select(
        "total_cells",
        "total_nulls",
        percent(F.col("total_nulls"), F.col("total_cells"), 1).alias("total_null_pct"),
        "duplicate_rows",
        percent(F.col("duplicate_rows"), F.col("rows"), 1).alias("duplicate_row_pct"),
        "columns_with_nulls",
        "constant_columns",
        "high_cardinality_text",
    )


def analyst_profile(df: DataFrame) -> DataFrame:
    """Semantic type and penalty-based quality score per column."""
    stats = distinct_stats(value_counts(df, df.columns))
    typed = semantic_types(df, "analyst").select("column_name", "semantic_type")
    null_pct = F.col("null_count") * 100.0 / F.col("row_count")
    penalty = (
        F.when(null_pct > 50, 40).when(null_pct > 20, 25).when(null_pct > 5, 10).when(null_pct > 0, 5).otherwise(0)
        + F.when((F.col("distinct_count") <= 1) & (F.col("row_count") > 1), 20).otherwise(0)
        + F.when(
            (F.col("semantic_type") == "dimension") & (F.col("distinct_count") / F.col("row_count") > 0.95), 10
        ).otherwise(0)
    )
    return stats.join(F.broadcast(typed), "column_name").select(
        "column_name",
        "semantic_type",
        "null_count",
        "distinct_count",
        F.greatest(F.lit(100) - penalty, F.lit(0)).cast("double").alias("quality"),
    )


def analyst_summary(df: DataFrame) -> DataFrame:
    per = analyst_profile(df)
    kind = F.col("semantic_type")
    return per.agg(
        F.count(F.lit(1)).alias("column_count"),
        F.round(F.avg("quality"), 1).alias("data_quality_score"),
        *[F.count(F.when(kind == k, 1)).alias(f"{k}_columns") for k in ("measure", "dimension", "date")],
    )


def statistical_profile(df: DataFrame) -> DataFrame:
    """Deep profile: moments and fence outliers for numbers, entropy for text, warnings for both."""
    counts = value_counts(df, df.columns)
    base = distinct_stats(counts)
    texts = string_columns(df)
    present = (
        counts.where(F.col("column_name").isin(texts) & F.col("value").isNotNull())
        .join(F.broadcast(base.select("column_name", (F.col("row_count") - F.col("null_count")).alias("m"))), "column_name")
        .withColumn("p", F.col("n") / F.col("m"))
        .groupBy("column_name")
        .agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))
    )
    nums = numeric_profile(df).select(
        "column_name", "n", "mean", "median", "std", "skewness", "kurtosis", "q25", "q75", "outlier_count",
        "zero_count", "negative_count",
    )
    ratio = F.round(F.col("distinct_count") / F.greatest(F.col("row_count"), F.lit(1)), 4)
    null_pct = percent(F.col("null_count"), F.col("row_count"))
    warnings = F.array_compact(
        F.array(
            F.when(F.abs("skewness") > 2, "skewed"),
            F.when(F.col("outlier_count") > F.col("row_count") * 0.05, "outliers"),
            F.when(F.col("null_pct") > 20, "missing"),
            F.when((F.col("cardinality_ratio") > 0.95) & F.col("n").isNull(), "key_like"),
        )
    )
    return (
        base.join(F.broadcast(nums), "column_name", "left")
        .join(F.broadcast(present), "column_name", "left")
        .withColumn("cardinality_ratio", ratio)
        .withColumn("null_pct", null_pct)
        .select(
            "column_name", "null_count", "null_pct", "distinct_count", "cardinality_ratio", "mean", "median", "std",
            "skewness", "kurtosis",
            F.round(F.col("q75") - F.col("q25"), 4).alias("iqr"),
            "outlier_count",
            percent(F.col("zero_count"), F.col("n")).alias("zeros_pct"),
            percent(F.col("negative_count"), F.col("n")).alias("negatives_pct"),
            F.round("entropy", 4).alias("entropy"),
            F.array_join(warnings, ",").alias("warnings"),
        )
    )


def normality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Jarque-Bera test on all rows: statistic, p-value and verdict per numeric column."""
    columns = columns if columns is not None else numeric_columns(df)
    m = per_column(df, columns, {"n": F.count, "s": F.skewness, "k": F.kurtosis}, read=as_double)
    jb = F.col("n") / 6.0 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4.0)
    return m.select(
        "column_name",
        "n",
        F.round(jb, 4).alias("jarque_bera"),
        F.round(F.exp(-jb / 2), 6).alias("p_value"),
        (F.exp(-jb / 2) > 0.05).alias("is_normal"),
    )


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlation for all numeric pairs in one aggregation."""
    columns = columns if columns is not None else numeric_columns(df)
    pairs = list(combinations(columns, 2))
    wide = df.agg(
        *[F.corr(as_double(df, a), as_double(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = F.array(
        *[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    )
    r = F.col("r")
    return (
        wide.select(F.explode(rows).alias("s"))
        .select("s.*")
        .where(r.isNotNull() & ~F.isnan(r))
        .select(
            "col_a",
            "col_b",
            F.round(r, 4).alias("r"),
            F.when(r > 0.7, "strong_positive").when(r < -0.7, "strong_negative").otherwise("none").alias("strength"),
            F.when(F.abs(r) > 0.95, "multicollinearity").when(F.abs(r) > 0.8, "high").otherwise("none").alias("warning"),
        )
    )


def hierarchies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Child-to-parent dependencies between text columns where the child has more than twice the values.

    Column pairs are pruned by their distinct counts before any row is grouped; child determines
    parent when no child value has two parents among rows where both are present.
    """
    columns = columns if columns is not None else string_columns(df)
    counts = column_counts(df, columns)
    wanted = {}
    for child in columns:
        parents = [p for p in columns if 0 < counts[p][0] and counts[child][0] > 2 * counts[p][0]]
        if parents:
            wanted[child,] = parents
    rows = [(parent, child, counts[parent][0], counts[child][0]) for (child,), parent in sorted(holding(df, wanted, counts))]
    return df.sparkSession.createDataFrame(rows, "parent string, child string, parent_cardinality bigint, child_cardinality bigint")


def business_signals(df: DataFrame) -> DataFrame:
    """Likely KPI, dimension, date and id columns from names, kinds and cardinality."""
    stats = distinct_stats(value_counts(df, df.columns))
    spread = per_column(df, numeric_columns(df), {"std": F.stddev_samp}, read=as_double).drop("ordinal")
    meta = columns_frame(df)
    temporal, texts = temporal_columns(df), string_columns(df)
    spaced = F.regexp_replace(F.lower("column_name"), "[_-]", " ")

    def hinted(words: list[str], text: Column = spaced) -> Column:
        return any_of([text.contains(w) for w in words])

    is_text = F.col("column_name").isin(texts)
    kpi = F.col("is_numeric") & (hinted(KPI_HINTS) | ((F.col("distinct_count") > 20) & (F.col("std") > 0)))
    dim = is_text & (hinted(DIMENSION_HINTS) | F.col("distinct_count").between(2, 50))
    ident = hinted(["id", "key", "code", "number", "no"], F.lower("column_name")) & (
        F.col("distinct_count") > F.col("row_count") * 0.8
    )
    dates, ids = F.col("column_name").isin(temporal), ident
    first = lambda cond: F.col("ordinal") == F.min(F.when(cond, F.col("ordinal"))).over(Window.partitionBy())
    rows = meta.join(F.broadcast(stats), "column_name").join(F.broadcast(spread), "column_name", "left")
    signals = F.array_compact(
        F.array(
            F.when(kpi, "kpi"),
            F.when(dim, "dimension"),
            F.when(dates & first(dates), "date"),
            F.when(ids & first(ids), "id"),
        )
    )
    marked = rows.withColumn("signals", signals)
    return marked.select(F.explode("signals").alias("signal"), "column_name", "distinct_count")


def suggested_ratios(df: DataFrame) -> DataFrame:
    """Margin and unit price suggestions when the needed columns exist."""
    plain = {c.lower().replace("_", ""): c for c in df.columns}
    found = [
        (name, plain[top], plain[bottom], factor)
        for name, top, bottom, factor in (
            ("Profit Margin %", "profit", "sales", 100.0),
            ("Average Selling Price", "sales", "quantity", 1.0),
        )
        if top in plain and bottom in plain
    ]
    rows = [
        df.agg((F.sum(as_double(df, t)) / F.sum(as_double(df, b)) * f).alias("value")).select(
            F.lit(n).alias("name"), F.lit(t).alias("numerator"), F.lit(b).alias("denominator"), "value"
        )
        for n, t, b, f in found
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], "name string, numerator string, denominator string, value double")
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def sigma_outliers(df: DataFrame, columns: list[str] | None = None, sigmas: float = 3.0) -> DataFrame:
    """Rows further than ``sigmas`` sample deviations from the mean, for columns with at least ten values."""
    columns = columns if columns is not None else numeric_columns(df)
    moments = {
        r["column_name"]: (r["mean"], r["std"])
        for r in per_column(df, columns, {"n": F.count, "mean": F.avg, "std": F.stddev_samp}, read=as_double).collect()
        if r["n"] >= 10 and r["std"]
    }
    usable = [c for c in columns if c in moments]
    aggs = []
    for i, c in enumerate(usable):
        mean, std = moments[c]
        x = as_double(df, c)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.count(F.when(F.abs(x - F.lit(mean)) > F.lit(sigmas * std), 1)).alias(f"o{i}"),
        ]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"o{i}").alias("outlier_count"))
            for i, c in enumerate(usable)
        ]
    )
    return (
        df.agg(*aggs)
        .select(F.explode(rows).alias("s"))
        .select("s.*")
        .where("outlier_count > 0")
        .withColumn("outlier_pct", percent(F.col("outlier_count"), F.col("n"), 1))
    )


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column, with exact quartiles."""
    columns = columns if columns is not None else numeric_columns(df)
    q = quantiles(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    m = per_column(
        df, columns, {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min_value": F.min, "max_value": F.max}, read=as_double
    )
    return m.join(F.broadcast(q), "column_name").select(
        "column_name", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min_value", "q25", "q50", "q75", "max_value")]
    )
