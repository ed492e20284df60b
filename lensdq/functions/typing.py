"""Semantic typing of columns, SQL type inference, name clean-up and type repair on load."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensdq.functions.columns import (
    INTEGRAL, as_text, clean, is_numeric, is_temporal, numeric_columns, quoted, string_columns,
)

DATE_SHAPE = r"^\s*\d{4}[-/]\d{1,2}([-/]\d{1,2})?"
NUMBER_SHAPE = r"^[$€£¥]?-?\d[\d,_]*(\.\d+)?%?$"
DATE_NAME_HINTS = ["date", "time", "timestamp", "created", "updated", "year", "month", "day"]
ID_NAME_TOKENS = ["id", "code", "zip", "postal", "row", "index", "fk", "key"]


def parsed_number(col: Column) -> Column:
    return F.expr("try_cast(NULL AS DOUBLE)") if col is None else col.try_cast("double")


def parsed_timestamp(col: Column) -> Column:
    """Timestamp of date-like text, null otherwise."""
    return F.when(col.rlike(r"^\s*\d{4}-\d{1,2}"), col.try_cast("timestamp"))


def kind_facts(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, distinct values, average length and shares parsable as number or date."""
    from lensdq.operators.longform import value_counts

    counts = value_counts(df, df.columns).where(F.col("value").isNotNull())
    n, v = F.col("n"), F.col("value")
    facts = counts.groupBy("column_name").agg(
        F.sum("n").alias("present"),
        F.count(F.lit(1)).alias("distinct_count"),
        (F.sum(F.length(v) * n) / F.sum("n")).alias("avg_length"),
        (F.sum(F.when(parsed_number(v).isNotNull(), n).otherwise(0)) / F.sum("n")).alias("number_share"),
        (F.sum(F.when(v.rlike(NUMBER_SHAPE), n).otherwise(0)) / F.sum("n")).alias("number_shape_share"),
        (F.sum(F.when(parsed_timestamp(v).isNotNull(), n).otherwise(0)) / F.sum("n")).alias("date_share"),
        (F.sum(F.when(v.rlike(DATE_SHAPE), n).otherwise(0)) / F.sum("n")).alias("date_shape_share"),
    )
    rows = [
        (
            f.name,
            i,
            "numeric" if is_numeric(f.dataType) else "datetime" if is_temporal(f.dataType)
            else "boolean" if isinstance(f.dataType, T.BooleanType) else "text",
            isinstance(f.dataType, INTEGRAL),
            any(h in f.name.lower() for h in DATE_NAME_HINTS),
            any(t in re.split(r"[ _-]", f.name.lower()) for t in ID_NAME_TOKENS),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    meta = df.sparkSession.createDataFrame(
        rows,
        "column_name string, ordinal int, kind string, is_integer boolean, date_named boolean, id_named boolean",
    )
    # Schema rows against per-column facts: both sides are one row per column.
    joined = meta.join(F.broadcast(facts), "column_name", "left")
    return joined.withColumn("row_count", df.agg(F.count(F.lit(1))).scalar()).na.fill(0)


def semantic_types(df: DataFrame, flavour: str = "analyst") -> DataFrame:
    """Column roles under one of five conventions: analyst, profiler, dashboard, chart, text."""
    f = kind_facts(df)
    kind, distinct, rows = F.col("kind"), F.col("distinct_count"), F.col("row_count")
    if flavour == "analyst":
        role = (
            F.when(kind == "datetime", "date")
            .when(F.col("date_named") & (kind == "text") & (F.col("date_share") == 1), "date")
            .when((kind == "numeric") & F.col("id_named"), "dimension")
            .when((kind == "numeric") & F.col("is_integer") & (distinct <= 5), "dimension")
            .when(kind == "numeric", "measure")
            .when((kind == "text") & ~F.col("id_named") & (F.col("number_share") == 1), "measure")
            .otherwise("dimension")
        )
    elif flavour == "profiler":
        listed = (distinct < 50) | (distinct / F.greatest(rows, F.lit(1)) < 0.05)
        role = (
            F.when(kind != "text", kind)
            .when(listed & (F.col("date_share") > 0.8), "likely_datetime")
            .when(listed, "categorical")
            .otherwise("text")
        )
    elif flavour == "dashboard":
        role = (
            F.when((kind == "numeric") & (distinct > rows * 0.9), "id_like")
            .when(kind == "numeric", "numeric")
            .when((kind == "datetime") | (F.col("date_share") > 0.6), "date")
            .when(distinct <= 30, "categorical")
            .when(distinct > rows * 0.8, "id_like")
            .otherwise("high_card")
        )
    elif flavour == "chart":
        role = (
            F.when((kind == "datetime") | ((kind == "text") & (F.col("date_share") == 1)), "date")
            .when(kind == "numeric", "numeric")
            .when(distinct < 15, "categorical")
            .otherwise("unused")
        )
    elif flavour == "text":
        role = (
            F.when(F.col("present") == 0, "unknown")
            .when(F.col("date_shape_share") > 0.6, "date")
            .when(F.col("number_shape_share") > 0.6, "numeric")
            .when(F.col("avg_length") > 80, "text_long")
            .otherwise("text")
        )
    else:
        raise ValueError(f"unknown flavour {flavour!r}")
    return f.select("column_name", role.alias("semantic_type"), "distinct_count", "row_count")


def sql_types(df: DataFrame) -> DataFrame:
    """Warehouse column types: BIGINT, DECIMAL(18,4), DATETIME, BIT or a sized VARCHAR."""
    texts = string_columns(df)
    longest = (
        df.agg(*[F.coalesce(F.max(F.length(F.col(quoted(c)))), F.lit(4)).alias(f"l{i}") for i, c in enumerate(texts)])
        if texts
        else None
    )

    def fixed(t: T.DataType) -> str:
        if isinstance(t, INTEGRAL):
            return "BIGINT"
        if is_numeric(t):
            return "DECIMAL(18,4)"
        return "DATETIME" if is_temporal(t) else "BIT" if isinstance(t, T.BooleanType) else "VARCHAR(4000)"

    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                (
                    F.concat(
                        F.lit("VARCHAR("),
                        F.least(F.floor(F.col(f"l{texts.index(f.name)}") * 1.5), F.lit(4000)).cast("string"),
                        F.lit(")"),
                    )
                    if f.name in texts
                    else F.lit(fixed(f.dataType))
                ).alias("sql_type"),
            )
            for f in df.schema.fields
        ]
    )
    source = longest if longest is not None else df.sparkSession.range(1)
    return source.select(F.explode(rows).alias("r")).select("r.*")


def sanitized_names(names: list[str]) -> list[str]:
    """Trimmed, bracket-free, unique names; ``X.1`` becomes ``X_2``."""
    used: dict[str, int] = {}
    out = []
    for raw in names:
        name = re.sub(r"[\[\]]", "", str(raw).strip())
        dup = re.fullmatch(r"(.+)\.(\d+)", name)
        if dup:
            name = f"{dup[1]}_{int(dup[2]) + 1}"
        used[name] = used.get(name, 0) + 1
        out.append(name if used[name] == 1 else f"{name}_{used[name]}")
    return out


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*sanitized_names(df.columns))


def repair_types(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Decimals to double, dates to timestamp, and mostly numeric text columns to double."""
    texts = string_columns(df)
    ratios = (
        df.agg(
            *[
                (F.count(parsed_number(F.col(quoted(c)))) / F.count(F.lit(1))).alias(f"s{i}")
                for i, c in enumerate(texts)
            ]
        ).first()
        if texts
        else []
    )
    convert = {c for c, r in zip(texts, ratios) if r is not None and r >= share}
    out = []
    for f in df.schema.fields:
        col = F.col(quoted(f.name))
        if isinstance(f.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(f.dataType, T.DateType):
            col = col.cast("timestamp")
        elif f.name in convert:
            col = parsed_number(col)
        out.append(col.alias(f.name))
    return df.select(*out)


__all__ = [
    "kind_facts", "numeric_columns", "parsed_number", "parsed_timestamp", "repair_types", "sanitize_columns",
    "sanitized_names", "semantic_types", "sql_types", "as_text", "clean",
]
