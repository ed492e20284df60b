"""Named metrics, level-of-detail aggregates and reconciliation of metric definitions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensdq.functions.columns import all_of, clean, quoted
from lensdq.functions.scalars import divide
from lensdq.operators.longform import quantiles
from lensdq.operators.ranking import group_quantiles

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "SUM": F.sum,
    "AVG": F.avg,
    "AVERAGE": F.avg,
    "MIN": F.min,
    "MAX": F.max,
    "COUNT": F.count,
    "COUNTROWS": lambda c: F.count(F.lit(1)),
    "COUNTD": F.count_distinct,
    "DISTINCTCOUNT": F.count_distinct,
    "APPROX_COUNTD": F.approx_count_distinct,
    "STDEV": F.stddev_samp,
    "STDEVP": F.stddev_pop,
    "VAR": F.var_samp,
    "VARP": F.var_pop,
    "MEDIAN": F.median,
    # One value when all agree, null otherwise.
    "ATTR": lambda c: F.when(F.min(c) == F.max(c), F.min(c)),
}


@dataclass(frozen=True)
class Metric:
    """A named aggregate over a column or SQL expression, with an optional row filter."""

    name: str
    agg: str
    expression: str | None = None
    where: str | None = None

    def value(self) -> Column:
        value = F.lit(1) if self.expression is None else F.expr(self.expression)
        return value if self.where is None else F.when(F.expr(self.where), value)

    def column(self) -> Column:
        if self.where is not None and self.agg == "COUNTROWS":
            return F.count(self.value())
        return AGGREGATES[self.agg](self.value())


@dataclass(frozen=True)
class Ratio:
    """One metric divided by another; the alternative stands in for a zero denominator."""

    name: str
    top: Metric
    bottom: Metric
    alternative: float = 0.0

    def column(self) -> Column:
        return divide(self.top.column().cast("double"), self.bottom.column().cast("double"), self.alternative)


def evaluate(df: DataFrame, metrics: list[Metric | Ratio], by: list[str] = ()) -> DataFrame:
    """All metrics as columns, for the whole table or per group, in one aggregation.

    Medians are selected by rank (``group_quantiles``) and joined to it, so no group is held in
    one buffer. A median inside a ratio is not supported.
    """
    medians = {m.name: m for m in metrics if isinstance(m, Metric) and m.agg == "MEDIAN"}
    cols = [m.column().alias(m.name) for m in metrics if m.name not in medians]
    if not medians:
        return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)
    rest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *cols)
    found = group_quantiles(df, list(by), {f"_m{i}": m.value() for i, m in enumerate(medians.values())}, {"m": 0.5})
    keys = [f"_k{i}" for i in range(len(by))]
    found = found.withColumnsRenamed(dict(zip(by, keys)))
    joined = rest.join(found, all_of([rest[quoted(b)].eqNullSafe(F.col(k)) for b, k in zip(by, keys)]), "left") if by else rest.crossJoin(F.broadcast(found))  # one row each
    names = {name: f"_m{i}_m" for i, name in enumerate(medians)}
    return joined.select(*by, *[F.col(names[m.name]).alias(m.name) if m.name in names else F.col(quoted(m.name)) for m in metrics])


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """Median of a whole column without holding it in one task."""
    return quantiles(df, [column], {"median": 0.5})


def lod_fixed(df: DataFrame, dims: list[str], agg: str, measure: str) -> DataFrame:
    """Grand sum of a per-dimension aggregate; groups with a missing dimension are left out."""
    present = df
    for d in dims:
        present = present.where(F.col(quoted(d)).isNotNull())
    per = present.groupBy(*dims).agg(AGGREGATES[agg](clean(df, measure)).alias("v"))
    return per.agg(F.sum("v").cast("double").alias("value"), F.count(F.lit(1)).alias("groups"))


def lod_include(df: DataFrame, view: list[str], extra: list[str], inner: str, measure: str, outer: str = "AVG") -> DataFrame:
    """View-level aggregate of values first aggregated at a finer level."""
    fine = df.groupBy(*view, *extra).agg(AGGREGATES[inner](clean(df, measure)).alias("v"))
    return fine.groupBy(*view).agg(AGGREGATES[outer](F.col("v")).alias("value"))


def lod_exclude(df: DataFrame, view: list[str], drop: list[str], agg: str, measure: str) -> DataFrame:
    """View rows beside the same sum with some dimensions removed (agg SUM, MIN or MAX)."""
    rest = [v for v in view if v not in drop]
    rows = df.groupBy(*view).agg(AGGREGATES[agg](clean(df, measure)).alias("value"))
    # Totals per remaining dimensions join back, so no window holds a whole group of view rows.
    keys = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, c in enumerate(rest)] or [F.lit(0).alias("_k0")]
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select("*", *keys)
    totals = keyed.groupBy(*names).agg(AGGREGATES[agg](F.col("value")).alias("excluded"))
    return keyed.join(totals, names).drop(*names)


def reconcile(df: DataFrame, pairs: list[tuple[str, Column, Column]], tolerance_pct: float = 0.01) -> DataFrame:
    """Two definitions of each metric in one pass: values, relative difference in percent, match."""
    row = df.agg(*[c.cast("double").alias(f"{s}{i}") for i, (_, a, b) in enumerate(pairs) for s, c in (("a", a), ("b", b))])
    items = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(f"a{i}").alias("left_value"), F.col(f"b{i}").alias("right_value")) for i, (n, _, _) in enumerate(pairs)]
    )
    a, b = F.col("left_value"), F.col("right_value")
    delta = F.when((a == 0) & (b == 0), 0.0).when(a == 0, 100.0).otherwise(F.abs(b - a) / F.abs(a) * 100)
    return row.select(F.explode(items).alias("s")).select("s.*").select(
        "metric", "left_value", "right_value", F.round(delta, 4).alias("delta_pct"),
        F.when(a.isNotNull() & b.isNotNull(), (delta < tolerance_pct) | ((a == 0) & (b == 0))).alias("match"),
    )


def reconciliation_summary(result: DataFrame) -> DataFrame:
    return result.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("match").alias("validated"), F.count_if(~F.col("match")).alias("mismatched"),
        F.count_if(F.col("match").isNull()).alias("skipped"),
    )


def match_names(left: DataFrame, right: DataFrame, slack: int = 10) -> DataFrame:
    """Pair metric names: equal, with a ' measure' suffix, or a prefix less than ``slack`` characters longer.

    Instead of comparing all names, each right name offers the few prefixes it may match.
    """
    l = left.select("name").distinct().withColumn("j", F.lower(F.trim("name")))
    r = right.select(F.col("name").alias("matched")).distinct().withColumn("m", F.lower(F.trim("matched")))
    size = F.length("m")
    offers = F.transform(F.sequence(F.greatest(F.lit(1), size - (slack - 1)), F.greatest(size, F.lit(1))), lambda n: F.left(F.col("m"), n))
    suffix = " measure"
    stem = F.when(F.col("m").endswith(suffix), F.array(F.expr(f"left(m, length(m) - {len(suffix)})"))).otherwise(F.array().cast("array<string>"))
    offered = r.withColumn("j", F.explode(F.array_distinct(F.concat(offers, stem))))
    kind = F.when(F.col("m") == F.col("j"), 1).when(F.col("m") == F.concat("j", F.lit(suffix)), 2).otherwise(3)
    pairs = l.join(offered, "j").withColumn("step", kind)
    best = Window.partitionBy("name").orderBy("step", "m")
    return pairs.withColumn("rk", F.row_number().over(best)).where("rk = 1").select(
        "name", "matched", F.element_at(F.array(F.lit("exact"), F.lit("suffix"), F.lit("prefix")), F.col("step")).alias("method")
    )


def mode_of(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Most frequent value of each expression, smallest on ties; frequencies are counted distributed."""
    long = df.select(*[c.cast("bigint").alias(n) for n, c in parts.items()]).unpivot([], list(parts), "part", "value")
    counts = long.where("value IS NOT NULL").groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("part").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("rk", F.row_number().over(best)).where("rk = 1").select("part", "value", "n")
