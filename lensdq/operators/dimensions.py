"""Six quality dimensions, overall score, recommendations and gates.

Each dimension states its aggregate expressions and how they become rows; ``scan`` merges
all of them into a single aggregate over the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensdq.functions.columns import (
    any_of, as_double, clean, merged_by, numeric_columns,
    percent, quoted, side_by_side, string_columns, temporal_columns,
)
from lensdq.functions.typing import parsed_timestamp
from lensdq.functions.wordlists import (
    DIMENSION_BANDS, DIMENSION_WEIGHTS, FORMAT_PATTERNS, FRESHNESS_HOURS, POSITIVE_NAME_HINTS, SEVERITY_RANK,
    SUSPECT_VALUES, TEXT_FORMAT_RULES,
)
from lensdq.operators.longform import (
    distinct_stats, full_row_counts, gap_median, quantiles, time_gaps, value_counts,
)
from lensdq.operators.profile import outside


@dataclass
class Scorer:
    """Raw counts of one dimension: one (dimension, column_name, check, checked, hits) row per column.

    ``hits`` is the non-null count, the flagged count, the best pattern count, or the newest
    stamp in microseconds, depending on the dimension; ``extra`` holds counts only the detail shows.
    """

    dimension: str
    aggs: dict[str, Column] = field(default_factory=dict)
    rows: list[Column] = field(default_factory=list)

    def add(self, df: DataFrame, column: str, check: str, checked: Column, hits: Column, extra: list[Column] = ()) -> None:
        prefix = f"{self.dimension}_{len(self.rows)}_"
        self.aggs[f"{prefix}n"] = checked
        self.aggs[f"{prefix}h"] = hits
        for j, c in enumerate(extra):
            self.aggs[f"{prefix}e{j}"] = c
        best = F.greatest(*[F.col(f"{prefix}e{j}") for j in range(len(extra))]) if extra else F.col(f"{prefix}h")
        self.rows.append(
            F.struct(
                F.lit(self.dimension).alias("dimension"),
                F.lit(column).alias("column_name"),
                F.lit(check).alias("check"),
                F.col(f"{prefix}n").alias("checked"),
                best.alias("hits"),
                F.array(*[F.col(f"{prefix}e{j}") for j in range(len(extra))]).cast("array<bigint>").alias("extra"),
            )
        )


def raw_counts(df: DataFrame, scorers: list[Scorer]) -> DataFrame:
    """All scorers in a single aggregate over the table, then one row per column and dimension."""
    rows = [r for s in scorers for r in s.rows]
    if not rows:
        fields = "dimension string, column_name string, check string, checked bigint, hits bigint, extra array<bigint>"
        return df.sparkSession.createDataFrame([], fields)
    row = df.agg(*[c.alias(n) for s in scorers for n, c in s.aggs.items()])
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scored(raw: DataFrame, as_of: str | None = None) -> DataFrame:
    """Add the 0-100 score of each raw row; null where the column does not count."""
    d, n, h = F.col("dimension"), F.col("checked"), F.col("hits")
    kept = F.round((1 - h / n) * 100, 2)
    hours = staleness_hours(as_of) if as_of else F.lit(None).cast("double")
    fresh = F.when(hours <= FRESHNESS_HOURS[0], 100.0).when(hours <= FRESHNESS_HOURS[1], 70.0).otherwise(40.0)
    score = (
        F.when(n == 0, F.lit(None).cast("double"))
        .when(d == "completeness", F.round(h * 100.0 / n, 2))
        .when(F.col("check") == "outliers", F.round(100 - percent(h, n), 2))
        .when(d == "accuracy", F.when(h > 0, kept))
        .when(d == "consistency", F.when(n >= 5, F.round(h * 100.0 / n, 2)))
        .when(d == "timeliness", fresh)
        .otherwise(kept)
    )
    return raw.withColumn("score", score)


def staleness_hours(as_of: str) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.col("hits")) / 3.6e9


def status_of(dimension: str, score: Column) -> Column:
    good, fair = DIMENSION_BANDS[dimension]
    return (
        F.when(score.isNull(), "N/A").when(score >= good, "PASS").when(score >= fair, "WARN").otherwise("FAIL")
    )


def completeness_scorer(df: DataFrame) -> Scorer:
    s = Scorer("completeness")
    for c in df.columns:
        s.add(df, c, "non_null", F.count(F.lit(1)), F.count(clean(df, c)))
    return s


def completeness(df: DataFrame) -> DataFrame:
    rows = scored(raw_counts(df, [completeness_scorer(df)]))
    return rows.select(
        "column_name", (F.col("checked") - F.col("hits")).alias("null_count"), "score",
        status_of("completeness", F.col("score")).alias("status"),
    )


@dataclass
class Facts:
    """What the scorers need to know first: spread of each numeric column, and which columns hold dates."""

    numeric: dict[str, dict]
    timed: dict[str, Column]


def table_facts(df: DataFrame) -> Facts:
    """Moments and date-parse shares from one aggregate, then quartiles; a few numbers per column.

    Numeric columns need ten values; text counts as temporal when over half of it parses.
    """
    numbers, texts = numeric_columns(df), string_columns(df)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(as_double(df, c)).alias(f"{n}{i}") for i, c in enumerate(numbers) for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop))],
        *[F.count(parsed_timestamp(F.col(quoted(c)))).alias(f"t{i}") for i, c in enumerate(texts)],
    ).first()
    usable = {c: i for i, c in enumerate(numbers) if row[f"n{i}"] >= 10}
    quart = {r["column_name"]: r for r in quantiles(df, usable, {"q25": 0.25, "q75": 0.75}).collect()}
    numeric = {
        c: {"mean": row[f"mean{i}"], "std": row[f"std{i}"], "fence": (quart[c]["q25"], quart[c]["q75"], quart[c]["q75"] - quart[c]["q25"])}
        for c, i in usable.items()
    }
    timed = {c: F.col(quoted(c)).cast("timestamp") for c in temporal_columns(df)}
    timed.update({c: parsed_timestamp(F.col(quoted(c))) for i, c in enumerate(texts) if row[f"t{i}"] > row["rows"] * 0.5})
    return Facts(numeric, timed)


def accuracy_scorer(df: DataFrame, facts: Facts, max_flag_length: int = 1) -> Scorer:
    """Outliers by fence or z-score for numbers, placeholder values for text.

    Text columns join the score only when they have hits. ``max_flag_length=0`` keeps
    single-character flags from counting as suspect.
    """
    s = Scorer("accuracy")
    for c, f in facts.numeric.items():
        x = as_double(df, c)
        tests = []
        if f["fence"][2] > 0:
            tests.append(outside(x, f["fence"]))
        if f["std"]:
            tests.append(F.abs(x - F.lit(f["mean"])) / F.lit(f["std"]) > 3)
        s.add(df, c, "outliers", F.count(x), F.count(F.when(any_of(tests), 1)))
    for c in string_columns(df):
        t = F.lower(F.trim(F.col(quoted(c))))
        s.add(df, c, "suspect_values", F.count(t), F.count(F.when(t.isin(SUSPECT_VALUES) | (F.length(t) <= max_flag_length), 1)))
    return s


def accuracy(df: DataFrame, max_flag_length: int = 1) -> DataFrame:
    rows = scored(raw_counts(df, [accuracy_scorer(df, table_facts(df), max_flag_length)]))
    return rows.select("column_name", "check", "checked", F.col("hits").alias("flagged"), "score")


def consistency_scorer(df: DataFrame) -> Scorer:
    s = Scorer("consistency")
    for c in string_columns(df):
        col = F.col(quoted(c))
        hits = [F.count(F.when(col.rlike(p), 1)) for p in FORMAT_PATTERNS.values()]
        s.add(df, c, "format", F.count(col), F.count(col), hits)
    return s


def consistency(df: DataFrame) -> DataFrame:
    """Dominant text format per column and the share of values that follow it."""
    names = F.array(*[F.lit(n) for n in FORMAT_PATTERNS])
    first = F.array_position("extra", F.array_max("extra")).cast("int")
    rows = scored(raw_counts(df, [consistency_scorer(df)])).where(F.col("score").isNotNull())
    return rows.select(
        "column_name",
        F.when(F.col("hits") > 0, F.element_at(names, first)).otherwise("mixed").alias("dominant_pattern"),
        "checked",
        (F.col("score") < 90).alias("is_issue"),
        "score",
    )


def date_order_issues(df: DataFrame) -> DataFrame:
    """Rows whose start-like date lies after the end-like date, per pair of matching columns."""
    lower = {c.lower(): c for c in df.columns}
    pairs = []
    for start in ("start", "begin", "open"):
        for end in ("end", "close", "finish"):
            s = [o for n, o in lower.items() if start in n and "date" in n]
            e = [o for n, o in lower.items() if end in n and "date" in n]
            if s and e and s[-1] != e[-1] and (s[-1], e[-1]) not in pairs:
                pairs.append((s[-1], e[-1]))
    empty = "start_column string, end_column string, bad_rows bigint"
    if not pairs:
        return df.sparkSession.createDataFrame([], empty)
    row = df.agg(
        *[
            F.count(F.when(F.col(quoted(s)).try_cast("timestamp") > F.col(quoted(e)).try_cast("timestamp"), 1)).alias(f"b{i}")
            for i, (s, e) in enumerate(pairs)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("start_column"), F.lit(e).alias("end_column"), F.col(f"b{i}").alias("bad_rows"))
            for i, (s, e) in enumerate(pairs)
        ]
    )
    return row.select(F.explode(rows).alias("r")).select("r.*")


def timeliness_scorer(df: DataFrame, facts: Facts) -> Scorer:
    s = Scorer("timeliness")
    for c, stamp in facts.timed.items():
        s.add(df, c, "staleness", F.count(stamp), F.max(F.unix_micros(stamp)))
    return s


def timeliness(df: DataFrame, as_of: str) -> DataFrame:
    """Staleness against ``as_of`` plus gap analysis per temporal column."""
    facts = table_facts(df)
    timed = facts.timed
    fresh = scored(raw_counts(df, [timeliness_scorer(df, facts)]), as_of).select(
        "column_name",
        F.date_format(F.timestamp_micros("hits"), "yyyy-MM-dd HH:mm:ss").alias("most_recent"),
        F.round(staleness_hours(as_of), 1).alias("staleness_hours"),
        "score",
    )
    if not timed:
        nothing = [F.lit(0).cast("bigint").alias("gaps_detected"), F.lit(0.0).alias("largest_gap_seconds")]
        return fresh.select("*", *nothing)
    gap_rows = None
    for c, stamp in timed.items():
        stamps = df.select(stamp.alias("ts"))
        gaps = time_gaps(stamps, "ts")
        zeros = stamps.where("ts IS NOT NULL").groupBy("ts").agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("zeros")
        )
        median = gap_median(gaps, zeros).first()["median_gap_us"]
        big = gaps.where(F.col("gap_us") > F.lit(2.0 * median)) if median else gaps.limit(0)
        row = big.agg(
            F.lit(c).alias("column_name"),
            F.count(F.lit(1)).alias("gaps_detected"),
            F.round(F.coalesce(F.max("gap_us"), F.lit(0)) / 1e6, 3).alias("largest_gap_seconds"),
        )
        gap_rows = row if gap_rows is None else gap_rows.unionByName(row)
    return merged_by("column_name", fresh, gap_rows)


def uniqueness(df: DataFrame) -> DataFrame:
    """Per column: distinct values, repeated rows, share, and whether it could be a primary key."""
    d = distinct_stats(value_counts(df, df.columns))
    return d.select(
        "column_name",
        F.col("distinct_count").alias("unique_count"),
        (F.col("row_count") - F.col("distinct_count")).alias("duplicate_count"),
        percent(F.col("distinct_count"), F.col("row_count")).alias("uniqueness_pct"),
        ((F.col("distinct_count") == F.col("row_count")) & (F.col("null_count") == 0)).alias("is_potential_pk"),
    )


def row_uniqueness(df: DataFrame) -> DataFrame:
    """Full-row duplicates and the uniqueness score of the table."""
    dup_pct = percent(F.col("duplicate_rows"), F.col("row_count"))
    score = F.round(100 - dup_pct, 2)
    return full_row_counts(df).select(
        "row_count", "duplicate_rows", dup_pct.alias("duplicate_pct"), score.alias("score"),
        status_of("uniqueness", score).alias("status"),
    )


def validity_scorer(df: DataFrame, as_of: str) -> Scorer:
    s = Scorer("validity")
    numbers, stamps, texts = numeric_columns(df), temporal_columns(df), string_columns(df)
    for c in df.columns:
        name, col = c.lower(), clean(df, c)
        if c in numbers and any(h in name for h in POSITIVE_NAME_HINTS):
            rule, bad = "expected_positive", col < 0
        elif c in stamps:
            t = col.cast("timestamp")
            rule = "date_range"
            bad = (t > F.lit(as_of).cast("timestamp")) | (t < F.lit("1900-01-01").cast("timestamp"))
        elif c in texts:
            for hints, rule, pattern in TEXT_FORMAT_RULES:
                if any(h in name for h in hints):
                    if pattern is None:
                        bad = F.length(F.regexp_replace(col, r"\D", "")) < 7
                    else:
                        bad = ~col.rlike(pattern)
                    break
            else:
                rule, bad = "whitespace_only", F.regexp_replace(col, r"\s+", "") == ""
        else:
            continue
        s.add(df, c, rule, F.count(col), F.count(F.when(col.isNotNull() & bad, 1)))
    return s


def validity(df: DataFrame, as_of: str) -> DataFrame:
    rows = scored(raw_counts(df, [validity_scorer(df, as_of)])).where(F.col("score").isNotNull())
    return rows.select("column_name", F.col("check").alias("rule"), F.col("hits").alias("violations"), "score")


def column_scores(df: DataFrame, as_of: str, max_flag_length: int = 1) -> DataFrame:
    """(dimension, column_name, score) for the five column-wise dimensions from one aggregate over the table."""
    facts = table_facts(df)
    scorers = [
        completeness_scorer(df), accuracy_scorer(df, facts, max_flag_length), consistency_scorer(df),
        timeliness_scorer(df, facts), validity_scorer(df, as_of),
    ]
    return scored(raw_counts(df, scorers), as_of).select("dimension", "column_name", "score")


def dimension_scores(columns: DataFrame, unique: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dimension, score, status) of all six dimensions from column scores and row uniqueness."""
    per_dim = columns.groupBy(*keys, "dimension").agg(F.round(F.avg("score"), 2).alias("score"))
    tables = unique.select(*keys, F.explode(F.array(*[F.lit(d) for d in DIMENSION_WEIGHTS])).alias("dimension"))
    rows = unique.select(*keys, F.lit("uniqueness").alias("dimension"), "score")
    scored = tables.join(per_dim.unionByName(rows), [*keys, "dimension"], "left")
    default = (
        F.when(F.col("dimension").isin("accuracy", "consistency", "validity"), F.lit(100.0))
        .when(F.col("dimension") == "completeness", F.lit(0.0))
    )
    scored = scored.withColumn("score", F.coalesce("score", default))
    status = F.lit(None).cast("string")
    for d in DIMENSION_WEIGHTS:
        status = F.when(F.col("dimension") == d, status_of(d, F.col("score"))).otherwise(status)
    return scored.select(*keys, "dimension", "score", status.alias("status"))


def weight_of(dimension: Column) -> Column:
    out = F.lit(None).cast("double")
    for d, w in DIMENSION_WEIGHTS.items():
        out = F.when(dimension == d, F.lit(w)).otherwise(out)
    return out


def overall_scores(dimensions: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of the scored dimensions per table, weights renormalised, with the scan status."""
    w, s = weight_of(F.col("dimension")), F.col("score")
    scored = F.when(s.isNotNull(), w)
    overall = F.round(F.coalesce(F.sum(s * w) / F.sum(scored), F.lit(0.0)), 1)
    out = dimensions.groupBy(*keys).agg(overall.alias("overall_score"))
    return out.withColumn("scan_status", scan_status(F.col("overall_score")))


def scan_status(score: Column) -> Column:
    return F.when(score >= 90, "PASS").when(score >= 70, "WARN").otherwise("FAIL")


def priority_of(score: Column) -> Column:
    return F.when(score < 80, "CRITICAL").when(score < 90, "HIGH").when(score < 95, "MEDIUM")


def severity_rank(col: Column) -> Column:
    out = F.lit(9)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(col == name, F.lit(rank)).otherwise(out)
    return out


# dimension: (advice, automatic fix)
ADVICE = {
    "completeness": ("Trace dropped records upstream; impute where the field is not critical.", "imputation"),
    "accuracy": ("Check outliers and placeholders against a trusted source.", "remove_outliers"),
    "consistency": ("Agree on one format and validate it before loading.", "format_standardize"),
    "timeliness": ("Review the refresh schedule and monitor freshness.", None),
    "uniqueness": ("Deduplicate in the load and add unique constraints.", "dedup"),
    "validity": ("Enforce domain rules where the data is entered.", None),
}


def recommendations(dimensions: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """One row per weak dimension with its priority, three worst columns and the available fix."""
    worst = Window.partitionBy(*keys, "dimension").orderBy(F.col("score").asc(), F.col("column_name").asc())
    named = (
        columns.where(F.col("score").isNotNull())
        .withColumn("rk", F.row_number().over(worst))
        .where("rk <= 3")
        .groupBy(*keys, "dimension")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("rk", "column_name"))), lambda s: s["column_name"]), ", "
            ).alias("worst_columns")
        )
    )
    rows = [(d, text, fix) for d, (text, fix) in ADVICE.items()]
    advice = dimensions.sparkSession.createDataFrame(rows, "dimension string, recommendation string, fix_type string")
    return (
        dimensions.withColumn("priority", priority_of(F.col("score")))
        .where(F.col("priority").isNotNull())
        .join(F.broadcast(named), [*keys, "dimension"], "left")
        .join(F.broadcast(advice), "dimension")
        .select(
            *keys, "priority", "dimension", "score", F.coalesce("worst_columns", F.lit("")).alias("worst_columns"),
            "recommendation", "fix_type", F.col("fix_type").isNotNull().alias("auto_fixable"),
        )
    )


def scorecard(dimensions: DataFrame, recs: DataFrame, tables: DataFrame) -> DataFrame:
    """Mean score per dimension, issue counts by priority and totals over all scanned tables."""
    means = dimensions.groupBy("dimension").agg(F.round(F.avg("score"), 1).alias("mean_score"))
    head = means.agg(
        F.round(F.avg("mean_score"), 1).alias("overall_score"),
        *[F.max(F.when(F.col("dimension") == d, F.col("mean_score"))).alias(f"{d}_score") for d in DIMENSION_WEIGHTS],
    )
    counted = recs.agg(
        *[F.count(F.when(F.col("priority") == p, 1)).alias(f"{p.lower()}_issues") for p in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        F.count(F.when(F.col("auto_fixable"), 1)).alias("auto_fixable_count"),
    )
    totals = tables.agg(
        F.count(F.lit(1)).alias("tables_scanned"),
        F.sum("column_count").alias("total_columns"),
        F.sum("row_count").alias("total_rows"),
    )
    return side_by_side(head, counted, totals)


def top_recommendations(recs: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    return recs.orderBy(severity_rank(F.col("priority")), F.col("score"), *keys, "dimension").limit(n)


def quality_gate(
    dimensions: DataFrame, keys: list[str], min_score: float = 80, required: list[str] | None = None,
    fail_on_critical: bool = True,
) -> DataFrame:
    """Pass or fail per table with the list of blocking dimensions."""
    required = required or []
    s, d = F.col("score"), F.col("dimension")
    short = d.isin(required) & (F.coalesce(s, F.lit(0.0)) < min_score) if required else F.lit(False)
    critical = (s < 50) if fail_on_critical else F.lit(False)
    blocking = F.when(short, F.concat(d, F.lit(" below threshold"))).when(
        F.coalesce(critical, F.lit(False)), F.concat(d, F.lit(" critical"))
    )
    overall = overall_scores(dimensions, keys)
    blocked = dimensions.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(blocking)), "; ").alias("blocking_issues")
    )
    passed = (F.col("overall_score") >= min_score) & (F.col("blocking_issues") == "")
    reason = (
        F.when(passed, "meets threshold")
        .when(F.col("blocking_issues") != "", F.concat(F.lit("failed: "), F.col("blocking_issues")))
        .otherwise("below threshold")
    )
    return overall.join(blocked, keys).select(
        *keys, "overall_score", passed.alias("passed"), "blocking_issues", reason.alias("reason")
    )


def batch_gate(dimensions: DataFrame, key: str, min_score: float = 80) -> DataFrame:
    """One summary row over all tables: passed, failed, average and whether all passed."""
    per = overall_scores(dimensions, [key]).withColumn("ok", F.col("overall_score") >= min_score)
    return per.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("ok"), 1)).alias("passed"),
        F.count(F.when(~F.col("ok"), 1)).alias("failed"),
        F.round(F.avg("overall_score"), 1).alias("avg_score"),
        F.coalesce(F.every("ok"), F.lit(False)).alias("all_passed"),
    )
