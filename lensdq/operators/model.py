"""Dimensional and vault modelling: role inference, dimension, date, SCD type 2, hub and satellite loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensdq.functions.columns import as_text, numeric_columns, quoted, temporal_columns
from lensdq.operators.longform import distinct_stats, ordered_prefix, value_counts

TIME_HINTS = ["date", "time", "year", "month", "day", "period"]
KEY_HINTS = ["id", "_key", "_sk", "fk_"]
AVERAGED_HINTS = ["rate", "ratio", "pct", "avg", "score"]
ADDITIVE_HINTS = ["amount", "qty", "count", "revenue", "cost"]
CONFORMED_HINTS = ["region", "country", "status", "type", "category", "channel"]

HIGH_DATE = "9999-12-31"


def infer_roles(df: DataFrame) -> DataFrame:
    """(column_name, role, detail, distinct_count): time, key, measure, dimension, degenerate or other."""
    stats = distinct_stats(value_counts(df, df.columns))
    numbers, stamps = set(numeric_columns(df)), set(temporal_columns(df))
    rows = []
    for c in df.columns:
        low = c.lower()
        has = lambda hints: any(h in low for h in hints)
        agg = "AVG" if has(AVERAGED_HINTS) else "SUM"
        rows.append((
            c,
            "time" if c in stamps or has(TIME_HINTS) else "key" if c in numbers and has(KEY_HINTS) else "measure" if c in numbers else "text",
            f"{agg} {'additive' if has(ADDITIVE_HINTS) else 'semi_additive'}" if c in numbers else "conformed" if has(CONFORMED_HINTS) else "regular",
        ))
    meta = df.sparkSession.createDataFrame(rows, "column_name string, base string, hint string")
    share = F.col("distinct_count") / F.greatest(F.col("row_count"), F.lit(1))
    role = (
        F.when(F.col("base") != "text", F.col("base"))
        .when((share < 0.05) & (F.col("distinct_count") < 100), "dimension")
        .when(share > 0.9, "degenerate")
        .otherwise("other")
    )
    detail = F.when(F.col("base") == "measure", F.col("hint")).when(role == "dimension", F.concat(F.col("hint"), F.lit("_dimension"))).otherwise("")
    return meta.join(F.broadcast(stats), "column_name", "left").select("column_name", role.alias("role"), detail.alias("detail"), "distinct_count")


def build_dimension(df: DataFrame, column: str, effective: str) -> DataFrame:
    """Surrogate key (1.. in value order), value, validity columns; keys come from a distributed index."""
    values = df.where(F.col(quoted(column)).isNotNull()).select(F.col(quoted(column)).alias("value")).distinct()
    return ordered_prefix(values, [F.col("value")]).select(
        (F.col("pos") + 1).alias("dim_key"), "value", F.lit(effective).cast("date").alias("effective_date"),
        F.lit(HIGH_DATE).cast("date").alias("expiry_date"), F.lit(True).alias("is_current"),
    )


def extend_dimension(dimension: DataFrame, df: DataFrame, column: str, effective: str) -> DataFrame:
    """``dimension`` with the values of ``df`` it does not hold yet, keyed on from its highest key.

    Old rows keep their keys, wherever new values stand in the order; new values are numbered in
    value order by range partitions and offsets. Values of expired rows count as held. Running it
    again with the same values changes nothing. Nulls are no value.
    """
    found = df.where(F.col(quoted(column)).isNotNull()).select(F.col(quoted(column)).alias("value")).distinct()
    top = dimension.agg(F.max("dim_key")).first()[0] or 0
    fresh = ordered_prefix(found.join(dimension.select("value").distinct(), "value", "left_anti"), [F.col("value")])
    added = fresh.select(
        (F.col("pos") + 1 + top).alias("dim_key"), "value", F.lit(effective).cast("date").alias("effective_date"), F.lit(HIGH_DATE).cast("date").alias("expiry_date"), F.lit(True).alias("is_current"),
    )
    return dimension.unionByName(added)


def attach_keys(fact: DataFrame, dimension: DataFrame, column: str, key_name: str) -> DataFrame:
    """Replace a value column by its current dimension key; unknown values keep a null key."""
    current = dimension.where("is_current").select(F.col("dim_key").alias(key_name), F.col("value").alias("_v"))
    return fact.join(current, fact[quoted(column)] == current["_v"], "left").drop("_v", column)


def date_dimension(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per calendar day: YYYYMMDD key, year to day names, weekday flag."""
    d = F.col("full_date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("full_date"))
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "full_date", F.year(d).alias("year"), F.quarter(d).alias("quarter"),
        F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.weekofyear(d).alias("week_of_year"),
        F.dayofweek(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.dayofweek(d).between(2, 6).alias("is_weekday"),
    )


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """MD5 over the values, each led by its length, null as a dash: no two different rows read alike."""
    def tagged(value: Column) -> Column:
        return F.when(value.isNull(), "-").otherwise(F.concat(F.length(value).cast("string"), F.lit(":"), value))

    return F.md5(F.concat(F.lit(""), *[tagged(as_text(df, c)) for c in columns]))


def scd2_apply(current: DataFrame, incoming: DataFrame, key: str, attributes: list[str], effective: str) -> DataFrame:
    """Type 2 history after one load: unchanged rows stay, changed and vanished ones expire, new versions start.

    ``current`` has key, attributes, effective_date, expiry_date, is_current. Keys meet in one
    full outer join, a null key with a null key; each pair then yields its one or two result rows.
    """
    cols = [key, *attributes]
    live, closed = current.where("is_current"), current.where("NOT is_current")
    c = live.select(*[F.col(quoted(x)).alias(f"c_{x}") for x in cols], "effective_date", row_hash(live, attributes).alias("c_hash"))
    n = incoming.select(*[F.col(quoted(x)).alias(f"n_{x}") for x in cols], row_hash(incoming, attributes).alias("n_hash"))
    start, high = F.lit(effective).cast("date"), F.lit(HIGH_DATE).cast("date")

    def version(side: str, since: Column, until: Column, is_current: bool) -> Column:
        return F.struct(
            *[F.col(f"{side}_{x}").alias(x) for x in cols], since.alias("effective_date"), until.alias("expiry_date"), F.lit(is_current).alias("is_current")
        )

    same = F.col("c_hash") == F.col("n_hash")
    old, new = F.col("c_hash").isNotNull(), F.col("n_hash").isNotNull()
    versions = F.array_compact(
        F.array(
            F.when(old & new & same, version("c", F.col("effective_date"), high, True)),
            F.when(old & ~F.coalesce(new & same, F.lit(False)), version("c", F.col("effective_date"), start, False)),
            F.when(new & ~F.coalesce(old & same, F.lit(False)), version("n", start, high, True)),
        )
    )
    merged = c.join(n, F.col(f"c_{key}").eqNullSafe(F.col(f"n_{key}")), "full").select(F.explode(versions).alias("v")).select("v.*")
    return closed.select(*cols, "effective_date", "expiry_date", "is_current").unionByName(merged)


def hub_load(df: DataFrame, key: str, source: str, load_date: str, existing: DataFrame | None = None) -> DataFrame:
    """New business keys with their MD5 hash key."""
    keys = df.where(F.col(quoted(key)).isNotNull()).select(as_text(df, key).alias("business_key")).distinct().select(
        F.md5("business_key").alias("hash_key"), "business_key", F.lit(load_date).cast("date").alias("load_date"), F.lit(source).alias("record_source")
    )
    return keys if existing is None else keys.join(existing.select("hash_key"), "hash_key", "left_anti")


def descriptors(df: DataFrame, key: str) -> list[str]:
    """All non-temporal columns besides the key."""
    stamps = set(temporal_columns(df))
    return [c for c in df.columns if c != key and c not in stamps]


def satellite_load(df: DataFrame, key: str, source: str, load_date: str, existing: DataFrame | None = None) -> DataFrame:
    """New or changed descriptor rows; ``existing`` (hash_key, hash_diff) holds the latest version per key."""
    cols = descriptors(df, key)
    rows = df.where(F.col(quoted(key)).isNotNull()).select(
        F.md5(as_text(df, key)).alias("hash_key"), F.lit(load_date).cast("date").alias("load_date"), *[quoted(c) for c in cols],
        F.lit(source).alias("record_source"), row_hash(df, cols).alias("hash_diff"),
    )
    return rows if existing is None else rows.join(existing.select("hash_key", "hash_diff"), ["hash_key", "hash_diff"], "left_anti")


