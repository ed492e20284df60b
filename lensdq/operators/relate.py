"""Key discovery, relationship detection, automatic joins and name matching."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensdq.functions.columns import as_text, clean, percent, quoted, side_by_side
from lensdq.functions.similarity import RATIOS, normalised_name, token_sorted
from lensdq.functions.wordlists import ABBREVIATIONS, ID_ENDING, KEY_SUFFIXES, KEY_TOKENS
from lensdq.operators.longform import distinct_stats, unpivoted, value_counts
from lensdq.operators.simjoin import similar_strings

Key = tuple[str, str]


def schema_frame(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_pos, table_name, column_pos, column_name, data_type) of a set of tables."""
    rows = [
        (i, name, j, f.name, f.dataType.simpleString())
        for i, (name, df) in enumerate(tables.items())
        for j, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "table_pos int, table_name string, column_pos int, column_name string, data_type string"
    )


def _sides(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    return l.join(r, F.col(f"l_{on}") == F.col(f"r_{on}")).where(F.col("l_table_pos") < F.col("r_table_pos"))


def name_candidates(schema: DataFrame) -> DataFrame:
    """Column pairs of different tables whose names suggest a join, with the strongest match kept.

    Each match kind is an equi join of the column list on a derived name, never a product.
    """
    norm = normalised_name(F.col("column_name"))
    named = schema.select(
        "table_pos", "table_name", "column_name", norm.alias("norm"),
        F.col("column_name").rlike(f"(?i){ID_ENDING}").alias("is_id"),
        F.regexp_replace(norm, ID_ENDING, "").alias("stem"),
    )
    cols = ["l_table_name", "r_table_name", "l_column_name", "r_column_name"]
    exact = _sides(named, named, "norm").select(
        *cols, F.lit(1).alias("step"), F.lit("exact_name").alias("match_type"),
        F.when(F.col("l_is_id"), 0.9).otherwise(0.7).alias("confidence"),
    )
    ids = named.where("is_id AND stem <> ''")
    stems = _sides(ids, ids, "stem").select(
        *cols, F.lit(2).alias("step"), F.lit("id_pattern").alias("match_type"), F.lit(0.8).alias("confidence")
    )
    shorts = F.array_compact(F.array(*[F.when(F.col("norm").contains(s), s) for s in ABBREVIATIONS]))
    fulls = F.array_compact(F.array(*[F.when(F.col("norm").contains(f), s) for s, f in ABBREVIATIONS.items()]))
    short_side = named.withColumn("pair", F.explode(shorts))
    full_side = named.withColumn("pair", F.explode(fulls))
    abbreviated = _sides(short_side, full_side, "pair").unionByName(_sides(full_side, short_side, "pair")).select(
        *cols, F.lit(3).alias("step"), F.lit("abbreviation").alias("match_type"), F.lit(0.6).alias("confidence")
    )
    both = exact.unionByName(stems).unionByName(abbreviated)
    return both.groupBy(*cols).agg(
        F.min_by("match_type", "step").alias("match_type"), F.min_by("confidence", "step").alias("confidence")
    ).toDF("left_table", "right_table", "left_col", "right_col", "match_type", "confidence")


def key_text(df: DataFrame, name: str) -> Column:
    """Text under which key values meet: whole numbers read alike whatever their type."""
    text = as_text(df, name)
    if not isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
        return text
    value = clean(df, name)
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(text)


def key_values(tables: dict[str, DataFrame], keys: list[Key]) -> DataFrame:
    """Distinct (key_id, value) of the listed columns, key_id being the position in ``keys``."""
    parts = []
    for name, df in tables.items():
        mine = {c: i for i, (t, c) in enumerate(keys) if t == name}
        if mine:
            ids = F.create_map(*chain.from_iterable((F.lit(c), F.lit(i)) for c, i in mine.items()))
            long = unpivoted(df, list(mine), read=key_text).where("value IS NOT NULL")
            parts.append(long.select(ids[F.col("column_name")].alias("key_id"), "value"))
    return reduce(DataFrame.unionByName, parts).distinct()


def value_overlaps(tables: dict[str, DataFrame], keys: list[Key]) -> DataFrame:
    """(left_id, right_id, common, left_distinct, right_distinct, overlap) for all key columns at once.

    Each value is reduced to the set of columns that hold it, equal sets are counted, and only
    the few distinct sets are paired; values never meet each other in a join.
    """
    holders = key_values(tables, keys).groupBy("value").agg(F.array_sort(F.collect_set("key_id")).alias("held_by"))
    sets = holders.groupBy("held_by").agg(F.count(F.lit(1)).alias("n"))
    singles = sets.select(F.explode("held_by").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("distinct_count"))
    pairs = (
        sets.select(F.explode("held_by").alias("left_id"), "held_by", "n")
        .select("left_id", F.explode("held_by").alias("right_id"), "n")
        .where("left_id < right_id")
        .groupBy("left_id", "right_id")
        .agg(F.sum("n").alias("common"))
    )
    left = singles.toDF("left_id", "left_distinct")
    right = singles.toDF("right_id", "right_distinct")
    # ``singles`` has one row per key column.
    return (
        pairs.join(F.broadcast(left), "left_id")
        .join(F.broadcast(right), "right_id")
        .withColumn("overlap", F.col("common") / F.least("left_distinct", "right_distinct"))
    )


def _key_frame(spark: SparkSession, keys: list[Key], prefix: str) -> DataFrame:
    rows = [(i, t, c) for i, (t, c) in enumerate(keys)]
    return spark.createDataFrame(rows, f"{prefix}_id int, {prefix}_table string, {prefix}_col string")


def detect_relationships(tables: dict[str, DataFrame], candidates: DataFrame | None = None) -> DataFrame:
    """Name candidates confirmed by shared values, strongest first."""
    spark = next(iter(tables.values())).sparkSession
    if candidates is None:
        candidates = name_candidates(schema_frame(spark, tables))
    # The candidate list is schema-sized; its columns say which values to compare.
    found = candidates.collect()
    keys = sorted({(r["left_table"], r["left_col"]) for r in found} | {(r["right_table"], r["right_col"]) for r in found})
    if not keys:
        return candidates.withColumn("overlap_pct", F.lit(0.0))
    named = spark.createDataFrame(found, candidates.schema)
    overlap = value_overlaps(tables, keys)
    ids = _key_frame(spark, keys, "left"), _key_frame(spark, keys, "right")
    mirrored = overlap.select("left_id", "right_id", "overlap").unionByName(
        overlap.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "overlap")
    )
    joined = (
        named.join(ids[0], ["left_table", "left_col"])
        .join(ids[1], ["right_table", "right_col"])
        .join(mirrored, ["left_id", "right_id"])
    )
    boosted = F.when(F.col("overlap") >= 0.5, F.least(F.lit(1.0), F.col("confidence") + 0.2)).otherwise(F.col("confidence"))
    return joined.where("overlap > 0").select(
        "left_table", "right_table", "left_col", "right_col", "match_type",
        F.round(boosted, 2).alias("confidence"), F.round(F.col("overlap") * 100, 1).alias("overlap_pct"),
    ).orderBy(F.col("confidence").desc(), F.col("overlap_pct").desc(), "left_table", "right_table", "left_col", "right_col")


def auto_join(tables: dict[str, DataFrame], relationships: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Greedy left joins along the strongest relationships; clashing names get a table suffix.

    Only the relationship list reaches the driver. Catalyst picks each join's physical form.
    """
    if len(tables) == 1:
        name, df = next(iter(tables.items()))
        return df, [f"single table {name}"]
    rels = (relationships if relationships is not None else detect_relationships(tables)).collect()
    if not rels:
        largest = max(tables, key=lambda n: tables[n].count())
        return tables[largest], [f"no relationship found, kept {largest}"]
    origin: dict[Key, str] = {}

    def attach(result: DataFrame | None, table: str, left_key: Key | None, right_col: str | None) -> DataFrame:
        df = tables[table]
        taken = {c.lower() for c in result.columns} if result is not None else set()
        names = [f"{c}_{table[:20]}" if c.lower() in taken else c for c in df.columns]
        origin.update({(table, c): n for c, n in zip(df.columns, names)})
        renamed = df.toDF(*names)
        if result is None:
            return renamed
        return result.join(renamed, result[quoted(origin[left_key])] == renamed[quoted(origin[(table, right_col)])], "left")

    first = rels[0]
    result = attach(None, first["left_table"], None, None)
    result = attach(result, first["right_table"], (first["left_table"], first["left_col"]), first["right_col"])
    joined = {first["left_table"], first["right_table"]}
    log = [f"{first['left_table']}.{first['left_col']} = {first['right_table']}.{first['right_col']}"]
    while True:
        step = next((r for r in rels if (r["left_table"] in joined) != (r["right_table"] in joined)), None)
        if step is None:
            break
        known, new = ("left", "right") if step["left_table"] in joined else ("right", "left")
        left_key = (step[f"{known}_table"], step[f"{known}_col"])
        result = attach(result, step[f"{new}_table"], left_key, step[f"{new}_col"])
        joined.add(step[f"{new}_table"])
        log.append(f"{left_key[0]}.{left_key[1]} = {step[f'{new}_table']}.{step[f'{new}_col']}")
    left_out = sorted(set(tables) - joined)
    if left_out:
        log.append("not joined: " + ", ".join(left_out))
    return result, log


def orphan_keys(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """Distinct values on each side without a partner, reported when below half of that side."""
    sides = left.select(key_text(left, left_col).alias("value"), F.lit(0).alias("side")).unionByName(
        right.select(key_text(right, right_col).alias("value"), F.lit(1).alias("side"))
    )
    per_value = sides.where("value IS NOT NULL").groupBy("value").agg(
        (F.max(F.when(F.col("side") == 0, 1).otherwise(0)) + F.max(F.when(F.col("side") == 1, 2).otherwise(0))).alias("m")
    )
    row = per_value.agg(
        F.count_if(F.col("m") != 2).alias("n0"), F.count_if(F.col("m") == 1).alias("o0"),
        F.count_if(F.col("m") != 1).alias("n1"), F.count_if(F.col("m") == 2).alias("o1"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("side"), F.col(f"n{i}").alias("distinct_count"), F.col(f"o{i}").alias("orphan_count"))
            for i, s in enumerate(("left", "right"))
        ]
    )
    out = row.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("reported", (F.col("orphan_count") > 0) & (F.col("orphan_count") < F.col("distinct_count") * 0.5))


def same_name_analysis(tables: dict[str, DataFrame], min_overlap: float = 0.3) -> DataFrame:
    """Equal column names across tables whose values overlap, with orphans on both sides."""
    spark = next(iter(tables.values())).sparkSession
    owners: dict[str, list[str]] = {}
    for name, df in tables.items():
        for c in df.columns:
            owners.setdefault(c, []).append(name)
    keys = [(t, c) for c, ts in owners.items() if len(ts) > 1 for t in ts]
    if not keys:
        return spark.createDataFrame([], "column_name string, from_table string, to_table string, confidence double, from_orphans bigint, to_orphans bigint")
    o = value_overlaps(tables, keys)
    out = o.join(_key_frame(spark, keys, "left"), "left_id").join(_key_frame(spark, keys, "right"), "right_id")
    return out.where((F.col("left_col") == F.col("right_col")) & (F.col("overlap") > min_overlap)).select(
        F.col("left_col").alias("column_name"), F.col("left_table").alias("from_table"), F.col("right_table").alias("to_table"),
        F.round(F.col("overlap") * 100, 1).alias("confidence"),
        (F.col("left_distinct") - F.col("common")).alias("from_orphans"),
        (F.col("right_distinct") - F.col("common")).alias("to_orphans"),
    )


def schema_health(tables: dict[str, DataFrame], analysis: DataFrame) -> DataFrame:
    """Share of snake or camel case names, and the health score lowered when orphans were reported."""
    spark = next(iter(tables.values())).sparkSession
    s = schema_frame(spark, tables)
    naming = s.agg(
        F.round(
            F.greatest(F.count_if(F.col("column_name").rlike("^[a-z_]+$")), F.count_if(F.col("column_name").rlike("^[a-z]+[A-Z]")))
            * 100.0 / F.count(F.lit(1)), 1,
        ).alias("naming_consistency"),
    )
    orphans = analysis.agg(F.count_if((F.col("from_orphans") > 0) | (F.col("to_orphans") > 0)).alias("orphan_links"))
    clean = F.when(F.col("orphan_links") == 0, 100).otherwise(60)
    return side_by_side(naming, orphans).select(
        "naming_consistency", "orphan_links", F.round((F.col("naming_consistency") + clean) / 2, 1).alias("schema_health")
    )


def suffix_foreign_keys(schema: DataFrame) -> DataFrame:
    """Columns of different tables that share a key-like last name part."""
    last = F.lower(F.element_at(F.split("column_name", "_"), -1))
    keyed = schema.withColumn("suffix", last).where(F.col("suffix").isin(KEY_SUFFIXES))
    return _sides(keyed, keyed, "suffix").select(
        F.col("l_table_name").alias("left_table"), F.col("r_table_name").alias("right_table"),
        F.col("l_column_name").alias("left_col"), F.col("r_column_name").alias("right_col"),
        F.lit("key_suffix").alias("match_type"), F.lit(0.7).alias("confidence"),
    )


def key_like_columns(df: DataFrame) -> DataFrame:
    """Columns whose name parts hint at a key, with distinct count and uniqueness among non-nulls."""
    hints = {}
    for c in df.columns:
        parts = c.lower().replace(" ", "_").split("_")
        hit = next((k for k in KEY_TOKENS if k in parts), None)
        if hit:
            hints[c] = hit
    meta = df.sparkSession.createDataFrame(list(hints.items()), "column_name string, hint string")
    stats = distinct_stats(value_counts(df, list(hints))) if hints else None
    if stats is None:
        return meta.select("*", F.lit(0).cast("bigint").alias("unique_count"), F.lit(False).alias("is_unique"))
    return stats.join(F.broadcast(meta), "column_name").select(
        "column_name", "hint", F.col("distinct_count").alias("unique_count"),
        (F.col("distinct_count") == F.col("row_count") - F.col("null_count")).alias("is_unique"),
    )


def primary_keys(df: DataFrame) -> DataFrame:
    d = distinct_stats(value_counts(df, df.columns))
    return d.where("distinct_count = row_count AND null_count = 0").select("column_name", "distinct_count")


def schema_mapping(data: DataFrame, expected: DataFrame) -> DataFrame:
    """Which data file fits which expected source: by name, else by enough shared columns.

    Both inputs are (name, columns array<string>); matching columns are found by an equi join on
    the lower-cased column name.
    """
    plain = F.regexp_replace(F.lower("name"), "[_\\- ]", "")
    d = data.select(F.col("name").alias("data_file"), plain.alias("d_plain"), F.explode("columns").alias("c")).withColumn("c", F.lower(F.trim("c")))
    e = expected.select(F.col("name").alias("source"), plain.alias("e_plain"), F.size(F.array_distinct("columns")).alias("wanted"), F.explode("columns").alias("c")).withColumn("c", F.lower("c"))
    shared = d.join(e, "c").groupBy("data_file", "source", "d_plain", "e_plain", "wanted").agg(F.count_distinct("c").alias("shared_columns"))
    by_name = F.col("e_plain").contains(F.col("d_plain"))
    enough = F.col("shared_columns") > F.least(F.lit(3.0), F.col("wanted") * 0.3)
    return shared.where(by_name | enough).select(
        "data_file", "source", F.when(by_name, "filename").otherwise("column_overlap").alias("match_type"), "shared_columns"
    )


def resolve_names(
    names: DataFrame, candidates: DataFrame, aliases: dict[str, str] | None = None, threshold: float = 80.0, ratio: str = "levenshtein"
) -> DataFrame:
    """Best candidate per name: exact, alias, normalised (98), then token-sorted fuzzy match.

    Inputs are one string column ``name`` / ``candidate`` each. The fuzzy step finds its pairs by
    the exact similarity join of ``simjoin``, complete at any threshold above 0.05.
    """
    n = names.select("name").distinct()
    c = candidates.select("candidate").distinct()
    lower_n, lower_c = F.lower(F.trim("name")), F.lower(F.trim("candidate"))

    def matched(left: Column, right: Column, score: float, method: str, step: int, pool: DataFrame = n) -> DataFrame:
        a = pool.withColumn("j", left)
        b = c.withColumn("j", right)
        return a.join(b, "j").select("name", "candidate", F.lit(score).alias("score"), F.lit(method).alias("method"), F.lit(step).alias("step"))

    exact = matched(lower_n, lower_c, 100.0, "exact", 1)
    normal = matched(normalised_name(F.col("name")), normalised_name(F.col("candidate")), 98.0, "normalized", 3)
    found = exact.unionByName(normal)
    if aliases:
        lookup = F.create_map(*chain.from_iterable((F.lit(k.lower()), F.lit(v.lower())) for k, v in aliases.items()))
        found = found.unionByName(matched(lookup[lower_n], lower_c, 100.0, "alias", 2))
    rest = n.join(found.select("name").distinct(), "name", "left_anti")

    left = rest.withColumn("a", token_sorted(F.col("name")))
    right = c.withColumn("b", token_sorted(F.col("candidate")))
    texts = left.select(F.lit("").alias("grp"), F.col("a").alias("s"), F.lit(0).alias("side"), F.lit(1).alias("meet"))
    texts = texts.unionByName(right.select(F.lit("").alias("grp"), F.col("b").alias("s"), F.lit(1).alias("side"), F.lit(0).alias("meet"))).distinct()
    # Scores are rounded before they are compared, so the search starts half a digit lower.
    near = similar_strings(texts, threshold - 0.05, ratio).select("a", "b")
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(left.select("a", F.col("a").alias("b")).distinct())
    pairs = left.join(near, "a").join(right, "b").select("name", "candidate", "a", "b").distinct()
    fuzzy = pairs.withColumn("score", F.round(RATIOS[ratio](F.col("a"), F.col("b")), 1)).where(F.col("score") >= threshold)
    everything = found.unionByName(fuzzy.select("name", "candidate", "score", F.lit("fuzzy_token_sort").alias("method"), F.lit(4).alias("step")))
    best = Window.partitionBy("name").orderBy("step", F.col("score").desc(), "candidate")
    return everything.withColumn("rk", F.row_number().over(best)).where("rk = 1").select("name", "candidate", "score", "method")


def overlap_percent(common: Column, smaller: Column) -> Column:
    return percent(common, smaller, 1)
