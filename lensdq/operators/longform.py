"""Shared physical patterns: fused per-column aggregates, value counts, exact quantiles, global order.

All of them keep work spread out when one value holds a large share of the rows:
counts combine map-side, quantiles only move the rows around the wanted rank, and
ordered passes run on range partitions with carried offsets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lensdq.functions.columns import any_of, as_double, as_text, clean, quoted
from lensdq.session import checkpointed


def per_column(
    df: DataFrame,
    columns: Iterable[str],
    metrics: dict[str, Callable[[Column], Column]],
    read: Callable[[DataFrame, str], Column] = clean,
) -> DataFrame:
    """One scan, one aggregate row, then one output row per column (column_name, ordinal, metrics)."""
    columns = list(columns)
    aggs = [
        fn(read(df, c)).alias(f"a{i}_{m}") for i, c in enumerate(columns) for m, fn in metrics.items()
    ]
    if not aggs:
        fields = ", ".join(["column_name string", "ordinal int"] + [f"{m} double" for m in metrics])
        return df.sparkSession.createDataFrame([], fields)
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(i).alias("ordinal"),
            *[F.col(f"a{i}_{m}").alias(m) for m in metrics],
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def unpivoted(
    df: DataFrame,
    columns: Iterable[str],
    read: Callable[[DataFrame, str], Column] = as_text,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Long form (keep..., column_name, value)."""
    columns, keep = list(columns), list(keep)
    wide = df.select(*[quoted(k) for k in keep], *[read(df, c).alias(f"v_{c}") for c in columns])
    ids = [F.col(quoted(k)) for k in keep]
    values = [F.col(quoted(f"v_{c}")) for c in columns]
    long = wide.unpivot(ids, values, "column_name", "value")
    return long.withColumn("column_name", F.expr("substring(column_name, 3)"))


def value_counts(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """(keep..., column_name, value, n) over all listed columns in one shuffle; null is a value of its own."""
    keep = list(keep)
    return unpivoted(df, columns, keep=keep).groupBy(*keep, "column_name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def distinct_stats(counts: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Fold value counts into rows, nulls, distinct values and repeated rows per column."""
    present = F.col("value").isNotNull()
    return counts.groupBy(*keep, "column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.coalesce(F.max(F.when(present, F.col("n"))), F.lit(0)).alias("top_count"),
    )


def top_values(counts: DataFrame, k: int, keep: Iterable[str] = ()) -> DataFrame:
    """The ``k`` most frequent non-null values per column; Spark limits each group map-side first."""
    w = Window.partitionBy(*keep, "column_name").orderBy(F.col("n").desc(), F.col("value").asc())
    return (
        counts.where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def full_row_counts(df: DataFrame) -> DataFrame:
    """(row_count, distinct_rows, duplicate_rows); repeated rows after the first count as duplicates.

    Rows meet by two independent 64-bit hashes of their values and null marks, so the shuffle
    carries 16 bytes a row whatever the width of the table.
    """
    values = [clean(df, c) for c in df.columns]
    nulls = F.array(*[v.isNull() for v in values])
    keys = [F.xxhash64(F.lit(seed), nulls, *values) for seed in (1, 2)]
    grouped = df.groupBy(*[k.alias(f"h{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("copies"))
    return grouped.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


#: Rows inside a bracket that are few enough to be ordered.
BRACKET_ROWS = 20_000


def quantiles(df: DataFrame, columns: Iterable[str], probs: dict[str, float], accuracy: int = 10_000, bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """Exact linear-interpolation quantiles, one local row per column (column_name, <names>).

    Every wanted rank gets a pair of marks from a rank sketch. A pass counts the rows below, at
    and between the marks: the rank is then at a mark, or strictly between two. Where more than
    ``bracket_rows`` rows lie between, these are sketched again; each time about a thousandth is
    left, since rows equal to a mark are not among them. A last pass orders the values between
    the marks. So the passes grow with the logarithm of the rows, and no task orders more than
    ``bracket_rows`` rows for a rank, whatever the number of rows or how often a value occurs.
    """
    columns = list(columns)
    fields = ", ".join(["column_name string", *[f"{quoted(n)} double" for n in probs]])
    if not columns:
        return df.sparkSession.createDataFrame([], fields)
    typed = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    slack = 4.0 / accuracy
    first = typed.agg(*[
        x for i in range(len(columns))
        for x in (F.count(f"c{i}").alias(f"n{i}"), F.percentile_approx(f"c{i}", [m for p in probs.values() for m in _around(p, slack)], accuracy).alias(f"m{i}"))
    ]).first()
    sizes = [first[f"n{i}"] for i in range(len(columns))]
    ranks: dict[tuple[int, int], _Rank] = {}
    for i, n in enumerate(sizes):
        for t, p in enumerate(probs.values()) if n else ():
            for k in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}:
                ranks.setdefault((i, k), _Rank(n, first[f"m{i}"][2 * t : 2 * t + 2]))
    searched = dict(ranks)
    while searched:
        tried = sorted({(i, *r.marks) for (i, _), r in searched.items()})
        counts = typed.agg(*[
            F.count(F.when(c, 1)).alias(f"t{j}_{part}")
            for j, (i, lo, hi) in enumerate(tried)
            for part, c in (("below", F.col(f"c{i}") < lo), ("low", F.col(f"c{i}") == lo), ("inside", (F.col(f"c{i}") > lo) & (F.col(f"c{i}") < hi)), ("high", (F.col(f"c{i}") == hi) & F.lit(lo < hi)))
        ]).first()
        found = {t: [counts[f"t{j}_{part}"] for part in ("below", "low", "inside", "high")] for j, t in enumerate(tried)}
        for (i, k), r in searched.items():
            r.place(k, *found[(i, *r.marks)])
        searched = {key: r for key, r in searched.items() if r.value is None and (r.missed or r.inside > bracket_rows)}
        if searched:
            again = typed.agg(*[
                F.percentile_approx(F.when(r.between(F.col(f"c{i}")), F.col(f"c{i}")), _around((k - r.before + 0.5) / r.inside, slack * r.widen), accuracy).alias(f"m{j}")
                for j, ((i, k), r) in enumerate(searched.items())
            ]).first()
            for j, r in enumerate(searched.values()):
                r.marks = again[f"m{j}"]

    open_ = {key: r for key, r in ranks.items() if r.value is None}
    if open_:
        entries = F.array_compact(F.array(*[F.when(r.between(F.col(f"c{i}")), F.struct(F.lit(j).alias("j"), F.col(f"c{i}").alias("v"))) for j, ((i, _), r) in enumerate(open_.items())]))
        inside = typed.where(any_of([r.between(F.col(f"c{i}")) for (i, _), r in open_.items()])).select(F.explode(entries).alias("s")).groupBy("s.j", "s.v").agg(F.count(F.lit(1)).alias("c"))
        places = df.sparkSession.createDataFrame([(j, k - r.before) for j, ((_, k), r) in enumerate(open_.items())], "j int, place bigint")
        upto = F.sum("c").over(Window.partitionBy("j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        # ``places`` has at most two rows per column and probability.
        hit = inside.withColumn("upto", upto).join(F.broadcast(places), "j").where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place")))
        at = {r["j"]: r["v"] for r in hit.select("j", "v").collect()}
        for j, r in enumerate(open_.values()):
            r.value = at[j]

    def cell(i: int, p: float) -> float | None:
        if not sizes[i]:
            return None
        pos = (sizes[i] - 1) * p
        low, high = ranks[i, math.floor(pos)].value, ranks[i, math.ceil(pos)].value
        return low + (high - low) * (pos - math.floor(pos))

    return df.sparkSession.createDataFrame([(c, *[cell(i, p) for p in probs.values()]) for i, c in enumerate(columns)], fields)


def _around(p: float, slack: float) -> list[float]:
    return [min(max(p - slack, 0.0), 1.0), min(max(p + slack, 0.0), 1.0)]


class _Rank:
    """One wanted rank: the open interval that holds it, the rows before and inside it, the marks to try next."""

    def __init__(self, rows: int, marks: list[float]):
        self.marks, self.bounds, self.before, self.inside = marks, None, 0, rows
        self.value, self.missed, self.widen = None, False, 1.0

    def between(self, value: Column) -> Column:
        return value.isNotNull() if self.bounds is None else (value > self.bounds[0]) & (value < self.bounds[1])

    def place(self, rank: int, below: int, low: int, inside: int, high: int) -> None:
        """Where the rank lies by the counts at the marks; outside of them, wider marks are tried."""
        self.missed = not below <= rank < below + low + inside + high
        if self.missed:
            self.widen *= 8
        elif rank < below + low:
            self.value = self.marks[0]
        elif rank >= below + low + inside:
            self.value = self.marks[1]
        else:
            self.bounds, self.before, self.inside, self.widen = tuple(self.marks), below + low, inside, 1.0


def ordered_prefix(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """Global 0-based position and inclusive running sums over ``order``, without a one-task window.

    Rows are range partitioned and sorted, written once to the checkpoint folder, then each
    partition adds the totals of the partitions before it (one small row per partition).
    """
    sums = sums or {}
    placed = checkpointed(
        df.select("*", *[c.alias(f"_s_{n}") for n, c in sums.items()])
        .orderBy(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_pid", F.shiftright("_mid", 33))
    totals = placed.groupBy("_pid").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums]
    )
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_off"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    # One offset row per range partition, so its size is the partition count.
    joined = placed.join(F.broadcast(offsets), "_pid")
    out = joined.withColumn("pos", F.col("_row_off") + F.col("_mid").bitwiseAND((1 << 33) - 1))
    for n in sums:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.sum(f"_s_{n}").over(inside))
    hidden = ["_pid", "_mid", "_row_off"] + [f"_{k}_{n}" for n in sums for k in ("s", "o")]
    return out.drop(*hidden)


def chunked(ordered: DataFrame, before: int = 0, after: int = 0, chunk: int = 50_000) -> tuple[DataFrame, WindowSpec]:
    """Rows in global ``pos`` order cut into chunks, with the window to use inside a chunk.

    The few rows next to a chunk border are copied into the neighbouring chunk (``own`` false),
    so frames reaching ``before`` rows back and ``after`` rows ahead are complete for the rows a
    chunk owns, and no window partition exceeds ``chunk`` plus the copies. Filter on ``own`` last.
    """
    home = F.floor(F.col("pos") / chunk)
    homes = [F.struct(home.alias("chunk"), F.lit(True).alias("own"))]
    if before:
        tail = F.col("pos") % chunk >= chunk - before
        homes.append(F.when(tail, F.struct((home + 1).alias("chunk"), F.lit(False).alias("own"))))
    if after:
        head = F.col("pos") % chunk < after
        homes.append(F.when(head, F.struct((home - 1).alias("chunk"), F.lit(False).alias("own"))))
    if max(before, after) > chunk:
        raise ValueError("frames may not reach over a whole chunk")
    spread = ordered.select("*", F.explode(F.array_compact(F.array(*homes))).alias("_h")).select("*", "_h.*").drop("_h")
    return spread, Window.partitionBy("chunk").orderBy("pos")


def time_gaps(df: DataFrame, ts: str) -> DataFrame:
    """Differences of consecutive distinct timestamps (prev_ts, ts, gap_us).

    Three window levels (inside a minute, between minutes of a day, between days) replace the
    single global ordering, so no partition holds more than one minute of distinct stamps.
    """
    stamp = F.col(quoted(ts)).cast("timestamp")
    points = df.where(stamp.isNotNull()).select(stamp.alias("ts")).distinct().withColumn(
        "minute", F.date_trunc("minute", "ts")
    )
    inside = points.select(
        F.lag("ts").over(Window.partitionBy("minute").orderBy("ts")).alias("prev_ts"), "ts"
    )
    minutes = (
        points.groupBy("minute")
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        .withColumn("day", F.date_trunc("day", "minute"))
    )
    between_minutes = minutes.select(
        F.lag("last").over(Window.partitionBy("day").orderBy("minute")).alias("prev_ts"),
        F.col("first").alias("ts"),
    )
    days = minutes.groupBy("day").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    # The calendar bounds this last window: one row per day present.
    between_days = days.select(
        F.lag("last").over(Window.orderBy("day")).alias("prev_ts"), F.col("first").alias("ts")
    )
    pairs = inside.unionByName(between_minutes).unionByName(between_days).where(F.col("prev_ts").isNotNull())
    return pairs.withColumn("gap_us", F.unix_micros("ts") - F.unix_micros("prev_ts"))


def gap_median(gaps: DataFrame, repeats: DataFrame) -> DataFrame:
    """Median of consecutive differences, where each repeated stamp adds a zero gap.

    ``repeats`` is a one-row frame with ``zeros``. Gaps are counted in 1/64-octave bins first;
    only the bin that holds the middle is looked at value by value.
    """
    weighted = gaps.groupBy("gap_us").agg(F.count(F.lit(1)).alias("n")).unionByName(
        repeats.select(F.lit(0).cast("bigint").alias("gap_us"), F.col("zeros").cast("bigint").alias("n"))
    ).where("n > 0")
    octave = F.floor(F.log2(F.col("gap_us") + 1.0) * 64)
    binned = weighted.withColumn("bin", octave)
    bins = binned.groupBy("bin").agg(F.sum("n").alias("n"))
    order = Window.orderBy("bin")
    everything = Window.partitionBy()
    # At most 4096 bins exist for 64-bit gaps.
    marked = bins.select(
        "bin",
        (F.sum("n").over(order) - F.col("n")).alias("start"),
        F.sum("n").over(order).alias("stop"),
        F.sum("n").over(everything).alias("total"),
    )
    lower, upper = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    wanted = marked.where(
        ((F.col("start") <= lower) & (F.col("stop") > lower)) | ((F.col("start") <= upper) & (F.col("stop") > upper))
    )
    inner = Window.partitionBy("bin").orderBy("gap_us")
    ranked = (
        binned.join(F.broadcast(wanted), "bin")
        .withColumn("upto", F.col("start") + F.sum("n").over(inner))
        .withColumn("below", F.col("upto") - F.col("n"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (F.col("upto") > rank), F.col("gap_us")))

    return ranked.agg(((at(lower) + at(upper)) / 2.0).alias("median_gap_us"))


__all__ = [
    "chunked",
    "distinct_stats",
    "full_row_counts",
    "gap_median",
    "ordered_prefix",
    "per_column",
    "quantiles",
    "time_gaps",
    "top_values",
    "unpivoted",
    "value_counts",
]
