"""Helpers shared by the corpus operators: words, saved intermediate tables, exact ranks, hashed words."""

from __future__ import annotations

import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensdq.session import ensure_checkpoint_dir

#: A word: a run of characters other than ASCII white space. ``bytes.split()`` cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later passes see the same rows, lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def unit_hash(seed: int, *cols: Column) -> Column:
    """A reproducible number in [0, 1) from a seed and columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built from ``names`` that ``df`` does not have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def bounded_join(left: DataFrame, right: DataFrame, on: list[str], rows: int, limit: int, how: str = "inner") -> DataFrame:
    """Join a counted right side: broadcast at up to ``limit`` rows, else a shuffled join (split by AQE when skewed)."""
    return left.join(F.broadcast(right) if rows <= limit else right, on, how)


def split_ranks(df: DataFrame, group: list[str], hashed: str, order: list[str], rank: str, slice_rows: int = 20_000) -> DataFrame:
    """Exact 0-based rank of every row inside its group by (``hashed``, ``order``), with no group in one task.

    ``hashed`` is a number in [0, 1). A group of n rows is cut into about n / ``slice_rows`` equal
    hash ranges; ranks are counted inside a range and start at the rows of the ranges before it.
    Only rows equal in ``hashed`` share a range for certain.
    """
    size, piece, start, *same = fresh(df, "_size", "_piece", "_start", *[f"_k{i}" for i in range(len(group) + 1)])
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias(size))
    keyed = df.join(_same(sizes, group, same), _match(df, group, same)).drop(*same)
    cut = keyed.withColumn(piece, F.floor(F.col(hashed) * F.ceil(F.col(size) / slice_rows)))
    counts = cut.groupBy(*group, piece).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, piece, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start))
    inner = Window.partitionBy(*group, piece).orderBy(hashed, *order)
    ranked = cut.drop(size).withColumn(rank, F.row_number().over(inner))
    keys = [*group, piece]
    joined = ranked.join(_same(starts, keys, same), _match(ranked, keys, same)).drop(*same)
    return joined.withColumn(rank, F.col(rank) - 1 + F.col(start)).drop(piece, start)


def _same(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(keys, names)))


def _match(df: DataFrame, keys: list[str], names: list[str]) -> Column:
    test = F.lit(True)
    for k, n in zip(keys, names):
        test = test & df[k].eqNullSafe(F.col(n))
    return test


class WordHashes(dict):
    """64-bit hashes of words, kept while there are fewer than ``most`` of them; long words are not kept.

    With 64 bytes a word at most, the table stays below about 25 MB.
    """

    def __init__(self, most: int = 1 << 17, longest: int = 64):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def shingle_hashes(words: list[bytes], hashes: WordHashes, width: int = 5):
    """64-bit hashes of all ``width``-word windows in order; a shorter sequence is one window; no words, none."""
    import numpy as np

    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    step = np.uint64(0x9E3779B97F4A7C15)
    k = min(n, width)
    out = h[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        out *= step
        out += h[j : n - k + 1 + j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out
