"""Mergeable column summaries: profiles of growing tables that read new parts only.

A part (a file, a day, a partition) is scanned once into one row per column: exact counters and
three sketches for distinct values, quantiles and frequent values. Rows of different parts add up,
so the profile of a table is a merge of its stored rows, whatever the size of the data behind them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensdq.functions.columns import as_double, as_text, clean, numeric_columns, quoted

#: Size of the distinct sketch (log2 of its bins; about 1.6% standard error) and of the quantile sketch (rank error about 0.7%).
DISTINCT_BINS, QUANTILE_SIZE = 12, 400
#: Values that the frequency sketch follows; counts are exact while a column has no more than three quarters of them.
FOLLOWED = 1024


def summarise(df: DataFrame, part: str) -> DataFrame:
    """One row per column of ``df``: counters and sketches, in one scan and one aggregate row.

    NaN counts as null. Numbers have ``total``, ``spread`` (squared distances from their mean) and
    a quantile sketch; all columns have their least and greatest text.
    """
    numbers = set(numeric_columns(df))
    aggs, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(df.columns):
        value, text = clean(df, c), as_text(df, c)
        own: dict[str, Column] = {
            "present": F.count(value),
            "least": F.min(text),
            "greatest": F.max(text),
            "distinct_sketch": F.hll_sketch_agg(text, DISTINCT_BINS),
        }
        if c in numbers:
            x = as_double(df, c)
            own |= {"total": F.sum(x), "mean": F.avg(x), "spread": F.var_pop(x) * F.count(x), "low": F.min(x), "high": F.max(x), "zeros": F.count_if(x == 0), "negatives": F.count_if(x < 0), "quantile_sketch": F.kll_sketch_agg_double(x, QUANTILE_SIZE)}
        aggs += [a.alias(f"a{i}_{n}") for n, a in own.items()]
        aggs.append(F.call_function("approx_top_k_accumulate", text, F.lit(FOLLOWED)).alias(f"a{i}_frequent"))
        kinds = {"total": "double", "mean": "double", "spread": "double", "low": "double", "high": "double", "zeros": "bigint", "negatives": "bigint", "quantile_sketch": "binary"}
        rest = [(F.col(f"a{i}_{n}") if n in own else F.lit(None).cast(kind)).alias(n) for n, kind in kinds.items()]
        rows.append(F.struct(
            F.lit(part).alias("part"), F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type"), F.col("rows"),
            *[F.col(f"a{i}_{n}").alias(n) for n in ("present", "least", "greatest", "distinct_sketch")], *rest, F.col(f"a{i}_frequent").alias("frequent"),
        ))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def merged(summaries: DataFrame) -> DataFrame:
    """The summaries of all parts as one row per column: (column_name, ordinal, rows, ..., sketches).

    Counters and totals add up, spreads are moved to the common mean, sketches are united. The
    grouping combines before its shuffle, and its input is one row per part and column.
    """
    n, mean = F.col("present"), F.col("mean")
    return summaries.groupBy("column_name").agg(
        F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("present").alias("present"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.sum("total").alias("total"), F.sum("zeros").alias("zeros"), F.sum("negatives").alias("negatives"), F.min("low").alias("low"), F.max("high").alias("high"),
        # Means weighted by rows are a population of their own: its variance is the spread between parts.
        (F.sum("spread") + F.coalesce(F.sum(n * mean * mean) - F.sum(n * mean) * F.sum(n * mean) / F.sum(F.when(mean.isNotNull(), n)), F.lit(0.0))).alias("spread"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"), F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(FOLLOWED)).alias("frequent"),
    )


def profile(summaries: DataFrame, probs: tuple[float, ...] = (0.25, 0.5, 0.75), k: int = 10) -> DataFrame:
    """Per column: row_count, null_count, null_pct, mean, std, min, max, zero and negative counts (exact), and
    ``distinct_estimate``, ``quantiles`` and the ``k`` most frequent values (from sketches)."""
    whole = merged(summaries)
    n = F.col("present")
    quantile = F.when(F.col("quantile_sketch").isNotNull() & (F.col("total").isNotNull()), F.kll_sketch_get_quantile_double("quantile_sketch", F.array(*[F.lit(p) for p in probs])))
    return whole.select(
        "column_name", "ordinal", "parts", F.col("rows").alias("row_count"), (F.col("rows") - n).alias("null_count"), F.when(F.col("rows") > 0, (F.col("rows") - n) * 100.0 / F.col("rows")).alias("null_pct"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"), "least", "greatest", F.col("low").alias("min_value"), F.col("high").alias("max_value"), "total",
        F.when(n > 0, F.col("total") / n).alias("mean"), F.when((n > 1) & F.col("spread").isNotNull() & F.col("total").isNotNull(), F.sqrt(F.greatest("spread", F.lit(0.0)) / (n - 1))).alias("std"),
        F.col("zeros").alias("zero_count"), F.col("negatives").alias("negative_count"), quantile.alias("quantiles"), F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(k)).alias("top_values"),
    )


class SummaryStore:
    """Summaries of a table's parts in a folder that all executors share.

    ``add`` scans a part and files its rows under the part's name by one rename, so a part is
    whole or absent; a name that is there already is not scanned again. ``profile`` reads the
    stored rows only. Parts may be added by several writers: of two that add one name, one wins.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        """Names of the parts summarised so far."""
        home = self._path(f"{self.path}/parts")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(home)) if self._fs.exists(home) else []

    def add(self, df: DataFrame, part: str) -> bool:
        """Summarise a part; False, and nothing is read, if it is there already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.=-]*", part):
            raise ValueError(f"part name {part!r}")
        if part in self.parts():
            return False
        staged = f"{self.path}/staged/{part}-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"
        summarise(df, part).write.parquet(staged)
        self._fs.mkdirs(self._path(f"{self.path}/parts"))
        # Renaming onto an existing folder would move into it.
        return not self._fs.exists(self._path(f"{self.path}/parts/{part}")) and self._fs.rename(self._path(staged), self._path(f"{self.path}/parts/{part}"))

    def summaries(self) -> DataFrame:
        names = self.parts()
        if not names:
            raise ValueError("no part has been summarised")
        return self.spark.read.parquet(*[f"{self.path}/parts/{quoted(n)[1:-1]}" for n in names])

    def profile(self, **options) -> DataFrame:
        return profile(self.summaries(), **options)
