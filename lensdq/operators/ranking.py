"""Rows at given ranks without a global sort: compound orders, groups, and scans with carried state."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensdq.functions.columns import all_of, any_of, quoted
from lensdq.session import checkpointed

#: Bytes of a string that one digit holds exactly.
CHUNK = 6
#: Even steps of the rank sketch of a group.
GRID = 128
#: Tables of up to this many groups or range partitions are broadcast, larger ones are joined by shuffle.
FEW_GROUPS = 100_000


def digits(df: DataFrame, column: str) -> list[Column]:
    """Numbers whose order, first to last, is the order of a column; nulls and NaN come first.

    Whole numbers, dates and timestamps take two halves, long decimals three parts, strings six
    bytes a number. Every digit is exact as a double.
    """
    x, kind = F.col(quoted(column)), df.schema[column].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        parts = [F.when(~F.isnan(x), x.cast("double"))]
    elif isinstance(kind, T.BooleanType):
        parts = [x.cast("int").cast("double")]
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        raw = x.cast("binary")
        size = df.agg(F.max(F.octet_length(raw))).first()[0] or 0
        byte = lambda at: F.when(F.octet_length(raw) > at, F.conv(F.hex(F.substring(raw, at + 1, 1)), 16, 10).cast("double") + 1).otherwise(0.0)
        chunks = [sum((byte(first + j) * float(257 ** (CHUNK - 1 - j)) for j in range(CHUNK)), F.lit(0.0)) for first in range(0, max(size, 1), CHUNK)]
        parts = [F.when(x.isNotNull(), c) for c in chunks]
    else:
        if isinstance(kind, T.TimestampType):
            whole = F.unix_micros(x)
        elif isinstance(kind, T.TimestampNTZType):
            second = F.hour(x) * 3600 + F.minute(x) * 60 + F.expr(f"extract(SECOND FROM {quoted(column)})").cast("double")
            return [F.coalesce(p.cast("double"), F.lit(float("-inf"))) for p in (F.unix_date(x.cast("date")), second)]
        elif isinstance(kind, T.DateType):
            whole = F.unix_date(x).cast("bigint")
        elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
            whole = (x * F.lit("1" + "0" * kind.scale).cast(f"decimal({kind.scale + 1},0)")).cast("bigint")
        elif isinstance(kind, T.DecimalType):
            # A double and what it leaves out, twice.
            first = x.cast("double")
            rest = x - first.cast(kind)
            second = rest.cast("double")
            return [F.coalesce(p.cast("double"), F.lit(float("-inf"))) for p in (first, second, rest - second.cast(kind))]
        else:
            whole = x.cast("bigint")
        parts = [F.shiftright(whole, 32).cast("double"), whole.bitwiseAND(0xFFFFFFFF).cast("double")]
    return [F.coalesce(p, F.lit(float("-inf"))) for p in parts]


@dataclass
class Cut:
    """The row at a rank: digits that tell it, rows before it and rows equal to it."""

    wanted: int
    where: Column
    order: list[Column]
    key: list[float] = field(default_factory=list)
    less: int = 0
    equal: int = 0

    def _prefix(self, n: int) -> Column:
        return all_of([d == F.lit(v) for d, v in zip(self.order[:n], self.key)])

    def before(self) -> Column:
        return self.where & any_of([self._prefix(i) & (d < F.lit(v)) for i, (d, v) in enumerate(zip(self.order, self.key))])

    def at(self) -> Column:
        return self.where & self._prefix(len(self.key))

    def after(self) -> Column:
        return self.where & any_of([self._prefix(i) & (d > F.lit(v)) for i, (d, v) in enumerate(zip(self.order, self.key))])


def rank_cuts(df: DataFrame, wanted: dict[str, tuple[Column, list[Column], int]], accuracy: int = 10_000) -> dict[str, Cut]:
    """Where the row of a rank lies in a compound order: ``wanted`` maps a name to (rows, digits, 0-based rank).

    The bracket search runs digit by digit: a rank sketch gives two marks around the rank, a pass
    counts rows below, at and between them, until the digit is found; rows equal in it are then
    searched in the next digit. All names share every pass, a pass is one aggregate row, and no
    row is moved or sorted. Passes grow with the digits and the logarithm of the rows, not with
    how often a key occurs. A rank outside its rows has no cut.
    """
    names = list(wanted)
    sizes = df.agg(*[F.count_if(wanted[n][0]).alias(f"n{i}") for i, n in enumerate(names)]).first() if names else ()
    cuts = {n: Cut(rank, where, order, equal=sizes[i]) for i, (n, (where, order, rank)) in enumerate(wanted.items()) if 0 <= rank < sizes[i]}
    # Open interval of the digit under search, rows of the group before it and inside it, and the widening of the marks.
    search = {n: [None, None, 0, c.equal, 1.0] for n, c in cuts.items()}

    def inside(n: str) -> Column:
        c, (lo, hi, *_) = cuts[n], search[n]
        d = c.order[len(c.key)]
        return c.at() & (F.lit(True) if lo is None else (d > F.lit(lo)) & (d < F.lit(hi)))

    live = [n for n, c in cuts.items() if c.order]
    while live:
        asked = []
        for n in live:
            _, _, before, rows, wide = search[n]
            p = (cuts[n].wanted - cuts[n].less - before + 0.5) / rows
            slack = 0.0 if wide == 1.0 and rows < accuracy / 2 else 4.0 / accuracy * wide
            asked.append(F.percentile_approx(F.when(inside(n), cuts[n].order[len(cuts[n].key)]), [min(max(p - slack, 0.0), 1.0), min(max(p + slack, 0.0), 1.0)], accuracy))
        marks = df.agg(*[a.alias(f"m{i}") for i, a in enumerate(asked)]).first()
        tests = []
        for i, n in enumerate(live):
            d, (low, high) = cuts[n].order[len(cuts[n].key)], marks[i]
            own = inside(n)
            tests += [F.count_if(own & t) for t in (d < low, d == low, (d > low) & (d < high), (d == high) & F.lit(low < high))]
        counts = df.agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)]).first()
        for i, n in enumerate(live):
            c, (low, high) = cuts[n], marks[i]
            below, at_low, between, at_high = counts[4 * i : 4 * i + 4]
            lo, hi, before, rows, wide = search[n]
            rank = c.wanted - c.less - before
            if not below <= rank < below + at_low + between + at_high:
                search[n][4] = wide * 8
            elif below + at_low <= rank < below + at_low + between:
                search[n] = [low, high, before + below + at_low, between, 1.0]
            else:
                first = rank < below + at_low
                c.key.append(low if first else high)
                c.less += before + (below if first else below + at_low + between)
                c.equal = at_low if first else at_high
                search[n] = [None, None, 0, c.equal, 1.0]
        # Open: no digit yet, inside a bracket, or several rows left and digits to tell them apart.
        live = [n for n in live if not cuts[n].key or search[n][0] is not None or (cuts[n].equal > 1 and len(cuts[n].key) < len(cuts[n].order))]
    return cuts


def split_at(df: DataFrame, order: list[str], first: int) -> tuple[DataFrame, DataFrame]:
    """The first ``first`` rows by ``order`` and the rest, by filters on two scans of ``df``.

    Ties go by two hashes of the whole row; rows still equal are copies of one another, and as
    many as are wanted go to either side.
    """
    texts = [F.col(quoted(c)).cast("string") if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(quoted(c)) for c in df.columns]
    hashes = [F.xxhash64(F.lit(seed), *texts) for seed in (1, 2)]
    halves = [p for h in hashes for p in (F.shiftright(h, 32).cast("double"), h.bitwiseAND(0xFFFFFFFF).cast("double"))]
    keys = [d for c in order for d in digits(df, c)]
    cut = rank_cuts(df, {"cut": (F.lit(True), [*keys, *halves], first)}).get("cut")
    if cut is None:
        return (df, df.limit(0)) if first > 0 else (df.limit(0), df)
    left, right, taken = df.where(cut.before()), df.where(cut.after()), first - cut.less
    if not taken:
        return left, df.where(~cut.before())
    one = df.where(cut.at()).limit(1)

    def copies(n: int) -> DataFrame:
        # One row meets the wanted number of copies.
        return df.sparkSession.range(n).crossJoin(F.broadcast(one)).drop("id")

    return left.unionByName(copies(taken)), right.unionByName(copies(cut.equal - taken))


def group_quantiles(df: DataFrame, by: list[str], columns: dict[str, Column], probs: dict[str, float], accuracy: int = 1_000, few: int = FEW_GROUPS) -> DataFrame:
    """Exact linear-interpolation quantiles of expressions per group, one row per group: ``by`` and <name>_<prob>.

    Every wanted rank of every group has a bracket: a bounded sketch per group gives marks around
    the rank, one pass counts the rows of all groups below, at and between their marks, and
    groups still open are sketched again inside their brackets. Counts and sketches combine
    before the shuffle, so a group with most of the rows is never in one buffer. Brackets are a
    table, broadcast up to ``few`` rows and joined by shuffle beyond. A group without values has
    null quantiles; NaN counts as null; null keys are a group.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    entries = F.array(*[F.struct(F.lit(n).alias("q"), F.when(~F.isnan(c.cast("double")), c.cast("double")).alias("x")) for n, c in columns.items()])
    long = df.select(*[F.col(quoted(b)).alias(k) for b, k in zip(by, keys)], F.explode(entries).alias("e")).select(*keys, "e.q", "e.x")
    groups = [*keys, "q"]
    same = lambda a, b: all_of([a[g].eqNullSafe(b[f"_{g}"]) for g in groups])
    sizes = checkpointed(long.groupBy(*groups).agg(F.count("x").alias("n")))
    spots = F.array(*[F.struct(F.lit(p).alias("prob"), (F.lit(v) * (F.col("n") - 1)).alias("pos")) for p, v in probs.items()])
    asked = sizes.where("n > 0").select(*groups, "n", F.explode(spots).alias("s")).select(*groups, "n", "s.*")
    ranks = asked.select(*groups, "n", F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("rank")).distinct()
    # lo and hi bound the open interval, before and rows count what lies below and inside it.
    state = checkpointed(ranks.select(*groups, "rank", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("bigint").alias("before"), F.col("n").alias("rows"), F.lit(1.0).alias("wide"), F.lit(None).cast("double").alias("value")))
    small = state.count() <= few
    done = []
    while True:
        brackets = state.where("value is null")
        done.append(state.where("value is not null").select(*groups, "rank", "value"))
        if brackets.isEmpty():
            break
        marked = brackets.withColumnsRenamed({g: f"_{g}" for g in groups})
        rows = long.where("x is not null")
        held = rows.join(F.broadcast(marked) if small else marked, same(rows, marked)).where("lo is null or (x > lo and x < hi)").drop(*[f"_{g}" for g in groups])
        # Few rows are sketched exactly; else the marks are the grid points around the rank, further off after a miss.
        grid = [i / GRID for i in range(GRID + 1)]
        sketch = held.groupBy(*groups, "rank").agg(F.percentile_approx("x", grid, accuracy).alias("grid"))
        place = lambda at: F.get("grid", F.greatest(F.lit(0), F.least(F.lit(GRID), at)).cast("int"))
        spot = (F.col("rank") - F.col("before") + 0.5) / F.col("rows") * GRID
        exact = (F.col("wide") == 1.0) & (F.col("rows") <= GRID - 28)
        low, high = F.when(exact, F.round(spot)).otherwise(F.floor(spot) - F.col("wide")), F.when(exact, F.round(spot)).otherwise(F.ceil(spot) + F.col("wide"))
        near = sketch.withColumnsRenamed({c: f"_{c}" for c in [*groups, "rank"]})
        marks = brackets.join(near, same(brackets, near) & (brackets["rank"] == near["_rank"])).select(*brackets.columns, place(low).alias("low"), place(high).alias("high"))
        marks = checkpointed(marks)
        marked = marks.withColumnsRenamed({g: f"_{g}" for g in groups})
        held = rows.join(F.broadcast(marked) if small else marked, same(rows, marked)).where("lo is null or (x > lo and x < hi)").drop(*[f"_{g}" for g in groups])
        counts = held.groupBy(*groups, "rank").agg(*[F.count_if(F.expr(t)).alias(f"c{i}") for i, t in enumerate(("x < low", "x = low", "x > low and x < high", "x = high and low < high"))])
        told = counts.withColumnsRenamed({c: f"_{c}" for c in [*groups, "rank"]})
        both = marks.join(told, same(marks, told) & (marks["rank"] == told["_rank"])).select(*marks.columns, "c0", "c1", "c2", "c3", (F.col("rank") - F.col("before")).alias("r"))
        missed = (F.col("r") < F.col("c0")) | (F.col("r") >= F.expr("c0 + c1 + c2 + c3"))
        open_ = ~missed & (F.col("r") >= F.expr("c0 + c1")) & (F.col("r") < F.expr("c0 + c1 + c2"))
        state = checkpointed(both.select(
            *groups, "rank", F.when(open_, F.col("low")).otherwise(F.col("lo")).alias("lo"), F.when(open_, F.col("high")).otherwise(F.col("hi")).alias("hi"),
            F.when(open_, F.expr("before + c0 + c1")).otherwise(F.col("before")).alias("before"), F.when(open_, F.col("c2")).otherwise(F.col("rows")).alias("rows"),
            F.when(missed, F.col("wide") * 8).otherwise(1.0).alias("wide"),
            F.when(~missed & ~open_, F.when(F.expr("r < c0 + c1"), F.col("low")).otherwise(F.col("high"))).alias("value"),
        ))
    values = done[0]
    for more in done[1:]:
        values = values.unionByName(more)
    values = values.withColumnsRenamed({c: f"_{c}" for c in [*groups, "rank"]})
    at = asked.join(values, same(asked, values) & F.col("_rank").between(F.floor("pos"), F.ceil("pos"))).groupBy(*groups, "prob", "pos").agg(F.min_by("value", "_rank").alias("below"), F.max_by("value", "_rank").alias("above"))
    exact = at.select(*groups, "prob", (F.col("below") + (F.col("above") - F.col("below")) * (F.col("pos") - F.floor("pos"))).alias("v"))
    known = sizes.select(*groups).withColumn("prob", F.lit(None).cast("string")).withColumn("v", F.lit(None).cast("double")).unionByName(exact)
    wide = known.groupBy(*keys).agg(*[F.max(F.when((F.col("q") == n) & (F.col("prob") == p), F.col("v"))).alias(f"{n}_{p}") for n in columns for p in probs])
    return wide.withColumnsRenamed(dict(zip(keys, by)))


def scanned(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` sorted by (group, order) over range partitions and written once: adds _pid, _mid and _at.

    ``_pid`` numbers the range partition, ``_mid`` orders all rows, ``_at`` is the 0-based place
    of a row inside its group, however many partitions the group spans.
    """
    held = checkpointed(df.orderBy(*[F.col(quoted(g)).asc_nulls_first() for g in group], *order).withColumn("_mid", F.monotonically_increasing_id()))
    placed = held.withColumn("_pid", F.shiftright("_mid", 33))
    local = F.row_number().over(Window.partitionBy("_pid", *group).orderBy("_mid")) - 1
    rows = carried(placed, group, {"_rows": (F.count(F.lit(1)), F.sum)})
    return rows.withColumn("_at", local + F.coalesce("_rows", F.lit(0))).drop("_rows")


def carried(placed: DataFrame, group: list[str], folds: dict[str, tuple[Column, object]]) -> DataFrame:
    """``placed`` with, per fold, the state of its group in the range partitions before its own (null if none).

    A fold is (aggregate of a partition's rows, aggregate that joins states). States form one row
    per partition and group, at most the partitions plus the groups; the carry is a window over
    these rows alone.
    """
    states = placed.groupBy("_pid", *group).agg(*[own.alias(f"_s_{n}") for n, (own, _) in folds.items()])
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = states.select("_pid", *group, *[join(F.col(f"_s_{n}")).over(before).alias(n) for n, (_, join) in folds.items()])
    keys = ["_pid", *group]
    renamed = carry.withColumnsRenamed({k: f"_c{i}" for i, k in enumerate(keys)})
    small = F.broadcast(renamed) if not group else renamed
    joined = placed.join(small, all_of([placed[k].eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)]))
    return joined.drop(*[f"_c{i}" for i in range(len(keys))])


def added(before: Column, own: Column) -> Column:
    return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own)


#: Per kind of running value: state of a range partition, join of states in order, value inside a partition, value with what came before.
FOLDS = {
    "sum": (F.sum, F.sum, F.sum, added),
    "count": (F.count, F.sum, F.count, added),
    "min": (F.min, F.min, F.min, F.least),
    "max": (F.max, F.max, F.max, F.greatest),
    "last": (lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("_mid"))), lambda s: F.last(s, True), lambda x: F.last(x, True), lambda before, own: F.coalesce(own, before)),
}


def running_folds(placed: DataFrame, group: list[str], folds: dict[str, tuple[Column, str]]) -> DataFrame:
    """Running values of the rows of ``scanned`` inside their group: per name (expression, kind of ``FOLDS``).

    The value of a row covers all rows of its group up to itself; nulls are passed over.
    """
    out = carried(placed, group, {f"_r_{n}": (FOLDS[kind][0](x), FOLDS[kind][1]) for n, (x, kind) in folds.items()})
    inside = Window.partitionBy("_pid", *group).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    values = {n: FOLDS[kind][3](F.col(f"_r_{n}"), FOLDS[kind][2](x).over(inside)) for n, (x, kind) in folds.items()}
    return out.withColumns(values).drop(*[f"_r_{n}" for n in folds])


def with_totals(df: DataFrame, group: list[str], totals: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates over all rows of its group; one row per group is joined back."""
    keys = [f"_t{i}" for i in range(len(group))]
    whole = df.groupBy(*[F.col(quoted(g)).alias(k) for g, k in zip(group, keys)]).agg(*[t.alias(n) for n, t in totals.items()])
    if not group:
        return df.crossJoin(F.broadcast(whole))  # one row
    return df.join(whole, all_of([df[quoted(g)].eqNullSafe(F.col(k)) for g, k in zip(group, keys)])).drop(*keys)
