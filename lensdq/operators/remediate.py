"""Automatic repairs and the log of what they changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensdq.functions.columns import as_double, clean, numeric_columns, quoted, string_columns
from lensdq.operators.longform import distinct_stats, full_row_counts, quantiles, value_counts
from lensdq.operators.profile import fences, outside

LOG_SCHEMA = "action string, column_name string, rows_affected bigint"


def deduplicate(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def impute(df: DataFrame) -> DataFrame:
    """Missing numbers become the column median, missing text becomes 'Unknown'."""
    every = numeric_columns(df)
    holes = df.agg(*[F.count_if(clean(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(every)]).first() if every else []
    numbers = [c for c, n in zip(every, holes) if n]
    medians = {r["column_name"]: r["m"] for r in quantiles(df, numbers, {"m": 0.5}).collect()} if numbers else {}
    texts = set(string_columns(df))
    out = []
    for f in df.schema.fields:
        col = clean(df, f.name)
        if medians.get(f.name) is not None:
            integral = f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
            target = "double" if integral and medians[f.name] != int(medians[f.name]) else f.dataType
            col = F.coalesce(col.cast(target), F.lit(medians[f.name]).cast(target))
        elif f.name in texts:
            col = F.coalesce(col, F.lit("Unknown"))
        out.append(col.alias(f.name))
    return df.select(*out)


def trimmable(df: DataFrame, most: int = 20) -> list[str]:
    """Text columns with at most ``most`` distinct values."""
    texts = string_columns(df)
    if not texts:
        return []
    stats = distinct_stats(value_counts(df, texts)).where(F.col("distinct_count") <= most).collect()
    return [c for c in texts if any(r["column_name"] == c for r in stats)]


def trim_labels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns if columns is not None else trimmable(df)
    return df.withColumns({c: F.trim(F.col(quoted(c))) for c in columns})


def clip_outliers(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """Numbers clamped to the 1.5 interquartile fences; flat columns stay untouched."""
    limits = limits if limits is not None else fences(df, numeric_columns(df))
    changes = {}
    for c, (q25, q75, iqr) in limits.items():
        if iqr:
            x = as_double(df, c)
            changes[c] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(q25 - 1.5 * iqr)), F.lit(q75 + 1.5 * iqr)))
    return df.withColumns(changes) if changes else df


def change_log(df: DataFrame) -> DataFrame:
    """Rows each repair would touch, per action and column, counted in one pass over the table."""
    numbers, texts = numeric_columns(df), string_columns(df)
    labels = trimmable(df)
    limits = fences(df, numbers) if numbers else {}
    checks = [("imputation", c, clean(df, c).isNull()) for c in [*numbers, *texts]]
    checks += [("format_standardize", c, F.col(quoted(c)) != F.trim(F.col(quoted(c)))) for c in labels]
    checks += [("remove_outliers", c, outside(as_double(df, c), b)) for c, b in limits.items() if b[2]]
    row = df.agg(*[F.count_if(cond).alias(f"n{i}") for i, (_, _, cond) in enumerate(checks)])
    items = F.array(
        *[
            F.struct(F.lit(a).alias("action"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("rows_affected"))
            for i, (a, c, _) in enumerate(checks)
        ]
    )
    repeated = full_row_counts(df).select(
        F.lit("dedup").alias("action"), F.lit("(all)").alias("column_name"), F.col("duplicate_rows").alias("rows_affected")
    )
    return row.select(F.explode(items).alias("s")).select("s.*").unionByName(repeated).where("rows_affected > 0")


def remediate(df: DataFrame, actions: list[str]) -> DataFrame:
    """Chosen repairs in a fixed order: dedup, imputation, format_standardize, remove_outliers."""
    steps = {"dedup": deduplicate, "imputation": impute, "format_standardize": trim_labels, "remove_outliers": clip_outliers}
    for name, step in steps.items():
        if name in actions:
            df = step(df)
    return df
