"""Functional dependencies between columns: refuted on slices of left-side values, confirmed on all rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensdq.functions.columns import as_text
from lensdq.operators.longform import distinct_stats, value_counts

#: A left side is first tested on one of up to so many slices of its values.
SLICES = 64
#: Distinct values of a left side that a slice should hold.
SLICE_VALUES = 32

Side = tuple[str, ...]


def column_counts(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """(distinct values, rows with a value) of every column."""
    stats = distinct_stats(value_counts(df, columns)).collect()
    found = {r["column_name"]: (r["distinct_count"], r["row_count"] - r["null_count"]) for r in stats}
    return {c: found.get(c, (0, 0)) for c in columns}


def holding(df: DataFrame, wanted: dict[Side, list[str]], counts: dict[str, tuple[int, int]]) -> set[tuple[Side, str]]:
    """Those (left, right) of ``wanted`` where equal left values never have two right values.

    Only rows with all values of a dependency count, and there must be one. Left sides with a
    column that never repeats need no grouping. The others are tested on a slice of their values
    first: every row of such a value is in the slice, so what fails there fails. What is left is
    tested on all rows. A row is copied once per left side still open that it belongs to, not
    once per pair of columns. The driver gets one row per left side.
    """
    if not wanted:
        return set()
    columns = sorted({c for left, rights in wanted.items() for c in (*left, *rights)})
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    texts = df.select(*[as_text(df, c).alias(n) for c, n in at.items()])
    present = lambda cs: _all(F.col(at[c]).isNotNull() for c in cs)

    def unique(left: Side) -> bool:
        return any(counts[c][0] == counts[c][1] for c in left)

    sure = [(left, right) for left, rights in wanted.items() if unique(left) for right in rights]
    out = set()
    if sure:
        met = texts.agg(*[F.count_if(present((*left, right))).alias(f"n{i}") for i, (left, right) in enumerate(sure)]).first()
        out |= {pair for pair, n in zip(sure, met) if n}

    def tested(sides: dict[Side, list[str]], slices: dict[Side, int], whole: bool) -> dict[Side, list[str]]:
        lefts = list(sides)
        entries = []
        for i, left in enumerate(lefts):
            key = F.array(*[F.col(at[c]) for c in left])
            hit = present(left)
            if slices[left] > 1:
                hit &= F.pmod(F.xxhash64(F.lit(i), *[F.col(at[c]) for c in left]), F.lit(slices[left])) == 0
            entries.append(F.when(hit, F.struct(F.lit(i).alias("side"), key.alias("key"))))
        rights = sorted({r for rs in sides.values() for r in rs})
        # Different hashes are different values, which is enough to refute; confirmation compares the values.
        value = lambda c: F.col(at[c]) if whole else F.when(F.col(at[c]).isNotNull(), F.xxhash64(at[c]))
        rows = texts.select(F.explode(F.filter(F.array(*entries), lambda s: s.isNotNull())).alias("s"), *[value(r).alias(f"r{j}") for j, r in enumerate(rights)])
        ends = [f(f"r{j}").alias(f"{n}{j}") for j in range(len(rights)) for n, f in (("lo", F.min), ("hi", F.max))]
        groups = rows.groupBy("s.side", "s.key").agg(*ends)
        facts = [x for j in range(len(rights)) for x in (F.max(F.col(f"lo{j}") < F.col(f"hi{j}")).alias(f"broken{j}"), F.count(f"lo{j}").alias(f"met{j}"))]
        seen = {r["side"]: r for r in groups.groupBy("side").agg(*facts).collect()}
        place = {r: j for j, r in enumerate(rights)}
        kept = {}
        for i, left in enumerate(lefts):
            row = seen.get(i)
            still = [r for r in sides[left] if (not whole if row is None else not row[f"broken{place[r]}"] and (row[f"met{place[r]}"] > 0 or not whole))]
            if still:
                kept[left] = still
        return kept

    open_sides = {left: rights for left, rights in wanted.items() if not unique(left)}
    slices = {left: max(1, min(SLICES, max(counts[c][0] for c in left) // SLICE_VALUES)) for left in open_sides}
    sliced = {left: rights for left, rights in open_sides.items() if slices[left] > 1}
    if sliced:
        passed = tested(sliced, slices, False)
        open_sides = {left: passed.get(left, []) if left in sliced else rights for left, rights in open_sides.items()}
        open_sides = {left: rights for left, rights in open_sides.items() if rights}
    if open_sides:
        confirmed = tested(open_sides, dict.fromkeys(open_sides, 1), True)
        out |= {(left, right) for left, rights in confirmed.items() for right in rights}
    return out


def dependencies(df: DataFrame, columns: list[str] | None = None, most: int = 2) -> DataFrame:
    """(determinant array<string>, dependent string): minimal dependencies with up to ``most`` columns on the left.

    Null is no value: a dependency is judged on the rows that have all its columns. Left sides
    grow column by column, and a side is not tried for a column that a part of it determines, nor
    at all where a part of it never repeats. Columns with one value or none are no dependents.
    """
    columns = list(columns if columns is not None else df.columns)
    counts = column_counts(df, columns)
    usable = [c for c in columns if counts[c][0] > 0]
    found: set[tuple[Side, str]] = set()
    for width in range(1, most + 1):
        known: dict[str, list[set]] = {}
        for left, right in found:
            known.setdefault(right, []).append(set(left))
        wanted = {}
        for left in combinations(usable, width):
            if width > 1 and any(counts[c][0] == counts[c][1] for c in left):
                continue
            rights = [c for c in usable if c not in left and counts[c][0] > 1 and not any(k <= set(left) for k in known.get(c, []))]
            if rights:
                wanted[left] = rights
        found |= holding(df, wanted, counts)
    rows = sorted((list(left), right) for left, right in found)
    return df.sparkSession.createDataFrame(rows, "determinant array<string>, dependent string")


def _all(tests):
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
