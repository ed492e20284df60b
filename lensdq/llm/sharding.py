"""Shards along a Hilbert curve over several metadata dimensions, cut into runs of equal row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensdq.llm.common import fresh, saved, split_ranks, unit_hash
from lensdq.operators.longform import ordered_prefix

#: Bits per dimension; the curve has 2 ** (BITS * dimensions) cells.
BITS = 5
MOST_DIMENSIONS = 4


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a cell given by whole numbers of ``bits`` bits, one per axis.

    Skilling's transform: undo the rotations from the highest bit down, apply the Gray code, and
    interleave the bits. The axes are one array, so every step reads the array of the step before.
    """
    n = len(axes)
    levels = [1 << b for b in range(bits - 1, 0, -1)]
    start = F.array(*[a.cast("bigint") for a in axes])
    steps = F.array(*[F.struct(F.lit(q).cast("bigint").alias("q"), F.lit(i).alias("i")) for q in levels for i in range(n)]) if levels else None

    def turn(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        first, own = x[0], F.element_at(x, s["i"] + 1)
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        is_set = own.bitwiseAND(s["q"]) != 0
        return F.transform(
            x,
            lambda v, j: F.when(is_set, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
            .otherwise(F.when(s["i"] == 0, v).when(j == 0, v.bitwiseXOR(swap)).when(j == s["i"], v.bitwiseXOR(swap)).otherwise(v)),
        )

    turned = F.aggregate(steps, start, turn) if levels else start
    # Gray code: every axis is xor-ed with the ones before it, then all with the corrections of the last.
    gray = F.aggregate(turned, F.array().cast("array<bigint>"), lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint"))))))
    bit_list = F.array(*[F.lit(q).cast("bigint") for q in levels]) if levels else F.array().cast("array<bigint>")

    def finish(x: Column) -> Column:
        last = F.element_at(x, -1)
        fix = F.aggregate(bit_list, F.lit(0).cast("bigint"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(x, lambda v: v.bitwiseXOR(fix))

    corrected = F.transform(F.array(gray), finish)[0]
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def woven(x: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, p: acc * 2 + F.call_function("shiftright", F.element_at(x, p["i"] + 1), p["b"]).bitwiseAND(F.lit(1).cast("bigint")))

    return F.transform(F.array(corrected), woven)[0]


def _cells(df: DataFrame, dimension: str, into: str, bits: int) -> DataFrame:
    """``df`` with the cell of one dimension: ranks of distinct texts, or equal-depth steps of numbers; null in cell 0."""
    kind = df.schema[dimension].dataType.typeName()
    top = 1 << bits
    if kind in ("string", "boolean", "binary"):
        [value] = fresh(df, "_v")
        # Sorted by range partitions, as there may be a value for every row.
        values = ordered_prefix(df.select(F.col(dimension).alias(value)).where(F.col(value).isNotNull()).distinct(), [F.col(value)])
        cells = values.select(value, F.floor(F.col("pos") * top / max(values.count(), top)).cast("bigint").alias(into))
        return df.join(cells, df[dimension] == F.col(value), "left").drop(value).withColumn(into, F.coalesce(into, F.lit(0).cast("bigint")))
    number = F.col(dimension).cast("double")
    marks = [i / top for i in range(1, top)]
    cuts = df.agg(F.percentile_approx(number, marks, 10_000).alias("c")).first()["c"] or []
    steps = sum((F.when(number > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    return df.withColumn(into, F.coalesce(steps, F.lit(0)).cast("bigint"))


def shard(df: DataFrame, dimensions: list[str], shards: int, key: list[str], bits: int = BITS) -> DataFrame:
    """``df`` with hilbert, shard (from 0) and slot (gapless from 0 inside a shard), law ``rows``.

    Rows are ordered by curve position of their cell, inside a cell by a hash of ``key``, and
    the order is cut into ``shards`` runs whose row counts differ by at most one. Files of a shard
    then span a small box in every dimension, so filters on any of them skip most files. Cells are
    counted (at most 2 ** (bits * dimensions) rows) and a cell with very many rows is ranked in
    slices, so nothing is sorted in one task. Texts get cells by the rank of their distinct values
    and numbers by equal depth; nulls share the lowest cell. Rows equal in ``key`` may trade
    places. With fewer rows than shards some shards stay empty; no rows give no rows. Columns
    that are called hilbert, shard or slot already are replaced.
    """
    if len(dimensions) > MOST_DIMENSIONS:
        raise ValueError(f"at most {MOST_DIMENSIONS} dimensions")
    hashed, cell, other, many, curve, start, total, place, at, part, *names = fresh(df, "_h", "_cell", "_c", "_m", "_curve", "_first", "_total", "_place", "_at", "_part", *[f"_x{i}" for i in range(len(dimensions))])
    celled = df.withColumn(hashed, unit_hash(6, *[F.col(k).cast("string") for k in key]))
    for d, n in zip(dimensions, names, strict=True):
        celled = _cells(celled, d, n, bits)
    packed = sum((F.col(n) * (1 << (bits * i)) for i, n in enumerate(names)), F.lit(0).cast("bigint"))
    celled = saved(celled.withColumn(cell, packed).drop(*names), "cells")
    axes = [F.call_function("shiftright", F.col(cell), F.lit(bits * i)).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")) for i in range(len(names))]
    cells = celled.groupBy(cell).agg(F.count(F.lit(1)).alias(many)).withColumn(curve, hilbert_index(axes, bits))
    before = Window.orderBy(curve).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col(cell).alias(other), curve, F.coalesce(F.sum(many).over(before), F.lit(0)).alias(start), F.sum(many).over(Window.partitionBy()).alias(total))
    ranked = split_ranks(celled, [cell], hashed, key, place)
    placed = ranked.join(starts, F.col(cell) == F.col(other)).withColumn(at, F.col(start) + F.col(place))
    exact = F.expr(f"({at} * {shards}) div {total}")
    first = F.expr(f"({part} * {total} + {shards - 1}) div {shards}")
    out = placed.withColumn(part, exact.cast("int"))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("hilbert", "shard", "slot")]
    return out.select(*kept, F.col(curve).alias("hilbert"), F.col(part).alias("shard"), (F.col(at) - first).cast("bigint").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order: (shard, slot) ranges become the files."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
