"""Shared physical patterns against brute force, with one hot value or block holding a third of the rows."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensdq.operators.longform import (
    chunked, full_row_counts, gap_median, ordered_prefix, quantiles, time_gaps, top_values, value_counts,
)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(i, 5.0 if i % 3 == 0 else round(rng.gauss(0, 100), 3)) for i in range(3000)]
    return spark.createDataFrame(rows, "id bigint, x double").repartition(5), [x for _, x in rows]


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_quantiles_match_linear_interpolation(skewed, limit):
    df, values = skewed
    probs = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.77, "f": 1.0}
    row = quantiles(df, ["x"], probs, bracket_rows=limit).first()
    for name, p in probs.items():
        assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_quantiles_skip_nan_and_empty_columns(spark, limit):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "a double, b double")
    rows = {r["column_name"]: r["m"] for r in quantiles(df, ["a", "b"], {"m": 0.5}, bracket_rows=limit).collect()}
    assert rows == {"a": 2.0, "b": None}


def test_quantiles_give_one_row_per_column(skewed):
    df, _ = skewed
    assert quantiles(df, ["x"], {"m": 0.5}, bracket_rows=10).count() == 1


def test_ordered_prefix_positions_and_sums(skewed):
    df, values = skewed
    rows = ordered_prefix(df, [F.col("x"), F.col("id")], {"run": F.lit(2)}).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(len(values)))
    assert [r["x"] for r in rows] == sorted(values)
    assert [r["run"] for r in rows] == [2 * (i + 1) for i in range(len(values))]


@pytest.mark.parametrize("chunk", [7, 100])
def test_chunked_windows_see_complete_frames(skewed, chunk):
    df, values = skewed
    ordered = ordered_prefix(df, [F.col("x"), F.col("id")])
    spread, w = chunked(ordered, before=4, after=2, chunk=chunk)
    rows = spread.withColumn("s", F.sum("pos").over(w.rowsBetween(-4, 2))).where("own").orderBy("pos").collect()
    n = len(values)
    assert len(rows) == n
    for i in (0, 1, 6, 7, 8, 99, 100, 101, n - 2, n - 1):
        assert rows[i]["s"] == sum(range(max(0, i - 4), min(n, i + 3)))


def test_time_gaps_across_minutes_and_days(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    stamps = [start + timedelta(seconds=rng.choice([0, 1, 30, 3600, 90000]) * rng.randint(0, 20)) for _ in range(400)]
    df = spark.createDataFrame([(s,) for s in stamps], "t timestamp")
    distinct = sorted(set(stamps))
    expected = sorted((b - a).total_seconds() for a, b in zip(distinct, distinct[1:]))
    gaps = time_gaps(df, "t")
    assert sorted(r["gap_us"] / 1e6 for r in gaps.collect()) == expected
    every = sorted(stamps)
    diffs = [(b - a).total_seconds() * 1e6 for a, b in zip(every, every[1:])]
    zeros = df.agg((F.count("t") - F.count_distinct("t")).alias("zeros"))
    assert gap_median(gaps, zeros).first()[0] == pytest.approx(float(np.median(diffs)))


def test_value_counts_treat_nan_as_null_and_join_zeros(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "x double")
    counts = {r["value"]: r["n"] for r in value_counts(df, ["x"]).collect()}
    assert counts == {"0.0": 2, None: 2}


def test_top_values_limit_map_side(spark):
    df = spark.createDataFrame([(str(i % 50),) for i in range(500)], "x string")
    plan = top_values(value_counts(df, ["x"]), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_full_row_counts(spark):
    df = spark.createDataFrame([(1, "a")] * 3 + [(2, None)] * 2 + [(3, "c")], "i int, s string")
    assert full_row_counts(df).first().asDict() == {"row_count": 6, "distinct_rows": 3, "duplicate_rows": 3}
