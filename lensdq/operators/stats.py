"""Distribution statistics: Benford, process control, population stability, Kolmogorov-Smirnov."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensdq.functions.columns import as_double, as_text, is_numeric, numeric_columns, percent, quoted, side_by_side
from lensdq.operators.longform import chunked, ordered_prefix, unpivoted
from lensdq.operators.ranking import split_at

SHARE_FLOOR = 1e-6


# --- Benford

def benford(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Chi-square of first significant digits of positive values against log10(1 + 1/d)."""
    digits = benford_digits(df, columns)
    d = F.col("digit").cast("double")
    expected = F.log10(1 + 1 / d) * F.col("n")
    per = digits.groupBy("column_name").agg(
        F.max("n").alias("n"), F.sum((F.col("observed") - expected) * (F.col("observed") - expected) / expected).alias("chi2")
    )
    # Survival function of the chi-square law with 8 degrees of freedom.
    h = F.col("chi2") / 2
    p = F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)
    return per.where("n >= 50").select(
        "column_name", "n", F.round("chi2", 4).alias("chi2"), F.round(p, 6).alias("p_value"), (p > 0.05).alias("conforms")
    )


def benford_digits(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, digit, observed, n) with all nine digits per column, absent ones as zero."""
    columns = columns if columns is not None else numeric_columns(df)
    long = unpivoted(df, columns, read=as_double).where("value > 0")
    # Scientific notation keeps the leading digit first.
    digit = F.regexp_extract(F.col("value").cast("string"), "[1-9]", 0)
    seen = long.groupBy("column_name", digit.alias("digit")).agg(F.count(F.lit(1)).alias("observed")).where("digit <> ''")
    totals = seen.groupBy("column_name").agg(F.sum("observed").alias("n"))
    grid = totals.select("column_name", "n", F.explode(F.array(*[F.lit(str(i)) for i in range(1, 10)])).alias("digit"))
    return grid.join(seen, ["column_name", "digit"], "left").select(
        "column_name", F.col("digit").cast("int").alias("digit"), F.coalesce("observed", F.lit(0)).alias("observed"), "n"
    )


# --- statistical process control

def spc_limits(points: DataFrame, value: str, usl: float | None = None, lsl: float | None = None) -> DataFrame:
    """Centre line, warning and control limits; Cpk only when specification limits are given."""
    x = F.col(quoted(value)).cast("double")
    row = points.where(x.isNotNull()).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    mean, std = F.col("mean"), F.col("std")
    sides = []
    if usl is not None:
        sides.append((F.lit(float(usl)) - mean) / (3 * std))
    if lsl is not None:
        sides.append((mean - F.lit(float(lsl))) / (3 * std))
    cpk = F.lit(None).cast("double") if not sides else sides[0] if len(sides) == 1 else F.least(*sides)
    return row.where((F.col("n") >= 8) & (std > 0)).select(
        "n", "mean", "std", (mean + 3 * std).alias("ucl"), (mean - 3 * std).alias("lcl"),
        (mean + 2 * std).alias("uwl"), (mean - 2 * std).alias("lwl"), cpk.alias("cpk"),
    )


def spc_violations(points: DataFrame, order: list[str], value: str, chunk: int = 50_000) -> DataFrame:
    """(pos, order..., value, rule, severity) for the four run rules over points in date order.

    Rows are indexed globally and cut into chunks that carry their eight predecessors.
    """
    limits = spc_limits(points, value).first()
    keep = points.where(F.col(quoted(value)).isNotNull()).select(*[quoted(o) for o in order], F.col(quoted(value)).cast("double").alias("x"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep.schema.fields if f.name != "x")
    if limits is None:
        return points.sparkSession.createDataFrame([], f"pos bigint, {fields}, x double, rule int, severity string")
    mean, std = F.lit(limits["mean"]), F.lit(limits["std"])
    ordered = ordered_prefix(keep, [F.col(quoted(o)) for o in order])
    spread, w = chunked(ordered, before=9, chunk=chunk)
    x = F.col("x")
    stepped = spread.withColumn("dx", x - F.lag("x").over(w))

    def run(cond: Column, length: int) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).over(w.rowsBetween(1 - length, 0))

    rule1 = (x > mean + 3 * std) | (x < mean - 3 * std)
    rule2 = (run(x > mean, 9) == 9) | (run(x < mean, 9) == 9)
    rule3 = (run(F.col("dx") > 0, 5) == 5) | (run(F.col("dx") < 0, 5) == 5)
    rule4 = (F.col("pos") >= 2) & (run(F.abs(x - mean) > 2 * std, 3) >= 2)
    flagged = stepped.select("*", *[r.alias(f"_r{i}") for i, r in enumerate((rule1, rule2, rule3, rule4), 1)]).where("own")
    hits = F.array_compact(F.array(*[F.when(F.col(f"_r{i}"), F.lit(i)) for i in (1, 2, 3, 4)]))
    return flagged.select("pos", *[quoted(o) for o in order], "x", F.explode(hits).alias("rule")).withColumn(
        "severity", F.when(F.col("rule") == 1, "critical").otherwise("warning")
    )


def spc_report(points: DataFrame, order: list[str], value: str, usl: float | None = None, lsl: float | None = None) -> DataFrame:
    """Limits with the number of violations and whether the process is stable (no point beyond control limits)."""
    v = spc_violations(points, order, value).agg(
        F.count(F.lit(1)).alias("violation_count"), F.count_if(F.col("rule") == 1).alias("beyond")
    )
    limits = spc_limits(points, value, usl, lsl)
    return side_by_side(limits, v).where("n IS NOT NULL").select(
        "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "ucl", "lcl", "uwl", "lwl", "cpk")],
        F.round(F.col("cpk") * 3, 4).alias("sigma_level"), "violation_count", (F.col("beyond") == 0).alias("process_stable"),
    )


# --- drift

def severity_of(psi: Column) -> Column:
    return F.when(psi >= 0.2, "critical").when(psi >= 0.1, "warning").otherwise("stable")


def numeric_psi(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Population stability over equal-width bins of the reference range, with the mean shift."""
    span = range(len(columns))
    # Per column two bounds of the reference: a single driver row.
    bounds = reference.agg(*[f(as_double(reference, c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def bin_of(x: Column, i: int) -> Column:
        lo, hi = bounds[f"lo{i}"], bounds[f"hi{i}"]
        if lo is None:
            return F.lit(None).cast("int")
        if hi == lo:
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / bins
        b = F.floor((x - F.lit(lo)) / F.lit(width))
        return F.when(x.between(lo, hi), F.least(b, F.lit(bins - 1)).cast("int"))

    def histogram(df: DataFrame, tag: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(i).alias("i"), bin_of(as_double(df, c), i).alias("bin"), as_double(df, c).alias("x")) for i, c in enumerate(columns)])
        return df.select(F.explode(entries).alias("s")).where("s.x IS NOT NULL").groupBy("s.i", "s.bin").agg(
            F.count(F.lit(1)).alias(f"{tag}_n"), F.sum("s.x").alias(f"{tag}_sum")
        )

    both = histogram(reference, "ref").unionByName(histogram(current, "cur"), allowMissingColumns=True)
    merged = both.groupBy("i", "bin").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ref_n", "ref_sum", "cur_n", "cur_sum")])
    totals = merged.groupBy("i").agg(
        F.sum("ref_n").alias("rt"), F.sum("cur_n").alias("ct"),
        (F.sum("ref_sum") / F.sum("ref_n")).alias("ref_mean"), (F.sum("cur_sum") / F.sum("cur_n")).alias("cur_mean"),
    )
    spark = reference.sparkSession
    grid = spark.createDataFrame([(i, b) for i in span for b in range(bins)], "i int, bin int")
    names = spark.createDataFrame(list(enumerate(columns)), "i int, column_name string")
    # Everything below has len(columns) * bins rows.
    shares = grid.join(merged.where("bin IS NOT NULL"), ["i", "bin"], "left").join(F.broadcast(totals), "i").select(
        "i", (F.coalesce("ref_n", F.lit(0)) / F.col("rt") + SHARE_FLOOR).alias("r"), (F.coalesce("cur_n", F.lit(0)) / F.col("ct") + SHARE_FLOOR).alias("c")
    )
    psi = shares.groupBy("i").agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))
    shift = F.abs(F.col("cur_mean") - F.col("ref_mean")) / F.greatest(F.abs("ref_mean"), F.lit(1e-6)) * 100
    return psi.join(F.broadcast(totals), "i").join(F.broadcast(names), "i").where("rt >= 10 AND ct >= 10").select(
        "column_name", F.round("psi", 4).alias("psi"), F.round("ref_mean", 4).alias("ref_mean"), F.round("cur_mean", 4).alias("cur_mean"),
        F.round(shift, 2).alias("mean_shift_pct"), severity_of(F.col("psi")).alias("severity"),
    )


def ks_p_value(distance: Column, effective_n: Column) -> Column:
    """Asymptotic two-sided Kolmogorov p-value; 1 where the series has no meaning."""
    lam = distance * F.sqrt(effective_n)
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def ks_two_sample(reference: DataFrame, ref_col: str, current: DataFrame, cur_col: str | None = None) -> DataFrame:
    """Largest distance between two empirical distributions with its p-value.

    Values are counted per sample first; running totals over the distinct values come from a
    range-partitioned pass, so neither sample is ever ordered in one task.
    """
    cur_col = cur_col or ref_col
    sides = reference.select(as_double(reference, ref_col).alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(
        current.select(as_double(current, cur_col).alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c"))
    )
    counts = sides.where("v IS NOT NULL").groupBy("v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    running = ordered_prefix(counts, [F.col("v")], {"cum_r": F.col("r"), "cum_c": F.col("c")})
    n, m = (v or 0 for v in running.agg(F.sum("r").alias("n"), F.sum("c").alias("m")).first())
    if not n or not m:
        return reference.sparkSession.createDataFrame([(n, m, None, None)], "ref_n bigint, cur_n bigint, ks_stat double, p_value double")
    gap = F.abs(F.col("cum_r") / F.lit(n) - F.col("cum_c") / F.lit(m))
    d = F.col("ks")
    return running.agg(F.max(gap).alias("ks")).select(
        F.lit(n).cast("bigint").alias("ref_n"), F.lit(m).cast("bigint").alias("cur_n"), F.round(d, 6).alias("ks_stat"),
        F.round(ks_p_value(d, F.lit(n * m / (n + m))), 6).alias("p_value"),
    )


def categorical_psi(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Population stability over categories, chi-square on aligned shares, new and missing categories."""
    def counts(df: DataFrame, tag: str) -> DataFrame:
        return unpivoted(df, columns, read=as_text).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias(tag))

    both = counts(reference, "r").join(counts(current, "c"), ["column_name", "value"], "full")
    totals = both.groupBy("column_name").agg(F.sum("r").alias("rt"), F.sum("c").alias("ct"))
    shares = both.join(F.broadcast(totals), "column_name").select(
        "column_name", "value", "r", "c", "rt", "ct",
        F.coalesce(F.col("r") / F.col("rt"), F.lit(SHARE_FLOOR)).alias("rs"), F.coalesce(F.col("c") / F.col("ct"), F.lit(SHARE_FLOOR)).alias("cs"),
    )
    # Reference shares are rescaled to the current total so both sides of the test add up.
    norms = shares.groupBy("column_name").agg(F.sum("rs").alias("rsum"), F.sum("cs").alias("csum"))
    exp_, obs = F.col("rs") / F.col("rsum") * F.col("csum") * F.col("ct"), F.col("cs") * F.col("ct")
    return (
        shares.join(F.broadcast(norms), "column_name")
        .groupBy("column_name")
        .agg(
            F.sum((F.col("cs") - F.col("rs")) * F.log(F.col("cs") / F.col("rs"))).alias("psi"),
            F.sum((obs - exp_) * (obs - exp_) / exp_).alias("chi2"),
            (F.count(F.lit(1)) - 1).alias("dof"),
            F.count_if(F.col("r").isNull()).alias("new_categories"),
            F.count_if(F.col("c").isNull()).alias("missing_categories"),
            F.max("rt").alias("rt"), F.max("ct").alias("ct"),
        )
        .where("rt >= 10 AND ct >= 10")
        .select(
            "column_name", F.round("psi", 4).alias("psi"), F.round("chi2", 4).alias("chi2"), "dof", "new_categories", "missing_categories",
            severity_of(F.col("psi")).alias("severity"),
        )
    )


def chi_square_p(frame: DataFrame, chi2: str = "chi2", dof: str = "dof") -> DataFrame:
    """Add ``p_value``: sums for the upper tail, even and odd degrees of freedom apart.

    Terms are carried as logarithms, so many degrees of freedom neither overflow nor vanish. The
    odd case starts from the complementary error function, here by its rational approximation
    (absolute error below 1.5e-7).
    """
    x, k = F.col(chi2), F.col(dof)
    h = x / 2

    def tail(first_log: Column, terms: Column, shift: float) -> Column:
        """Sum of ``terms`` terms, the i-th being the one before times h / (i + shift)."""
        start = F.struct(first_log.alias("log"), F.exp(first_log).alias("sum"))
        more = F.when(terms > 1, F.sequence(F.lit(1), (terms - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(
            more, start,
            lambda a, i: F.struct((a["log"] + F.log(h / (i + shift))).alias("log"), (a["sum"] + F.exp(a["log"] + F.log(h / (i + shift)))).alias("sum")),
            lambda a: a["sum"],
        )

    t = 1 / (1 + 0.3275911 * F.sqrt(h))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erfc = poly * F.exp(-h)
    even = tail(-h, F.floor(k / 2), 0.0)
    odd = F.when(k > 1, tail(F.log(F.sqrt(h) * 1.1283791670955126) - h, F.floor((k - 1) / 2), 0.5)).otherwise(0.0)
    p = F.when((k <= 0) | (x <= 0), 1.0).when(k % 2 == 0, even).otherwise(erfc + odd)
    return frame.withColumn("p_value", F.round(F.least(p, F.lit(1.0)), 6))


def drift_report(reference: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, kind, psi, drifted, severity) over all shared columns; numbers also test KS."""
    columns = columns if columns is not None else [c for c in reference.columns if c in current.columns]
    numbers = [c for c in columns if is_numeric(reference.schema[c].dataType)]
    labels = [c for c in columns if c not in numbers]
    parts = []
    if numbers:
        ks = reduce(
            DataFrame.unionByName,
            [ks_two_sample(reference, c, current).select(F.lit(c).alias("column_name"), "ks_stat", "p_value") for c in numbers],
        )
        parts.append(
            numeric_psi(reference, current, numbers).join(F.broadcast(ks), "column_name").select(
                "column_name", F.lit("numeric").alias("kind"), "psi", "ks_stat", ((F.col("psi") >= 0.2) | (F.col("p_value") < 0.05)).alias("drifted"), "severity"
            )
        )
    if labels:
        parts.append(
            categorical_psi(reference, current, labels).select(
                "column_name", F.lit("categorical").alias("kind"), "psi", F.lit(None).cast("double").alias("ks_stat"), (F.col("psi") >= 0.2).alias("drifted"), "severity"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def drift_summary(report: DataFrame) -> DataFrame:
    psi = F.avg("psi")
    return report.agg(
        F.count(F.lit(1)).alias("columns_checked"),
        F.count_if("drifted").alias("drifted_columns"),
        F.round(psi, 4).alias("overall_psi"),
        F.when(psi >= 0.2, "CRITICAL").when(psi >= 0.1, "WARNING").otherwise("STABLE").alias("verdict"),
        percent(F.count_if("drifted"), F.count(F.lit(1)), 1).alias("drift_pct"),
    )


def split_by_time(df: DataFrame, order: list[str], share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first ``share`` of the rows in order, and the rest, as filters on ``df``; ties go by a hash of the row."""
    return split_at(df, order, int(df.count() * share))
