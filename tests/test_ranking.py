"""Rank selection, splits, grouped quantiles and carried scans against sorting by hand."""

import datetime as dt
import decimal
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensdq.operators import metrics, ranking, stats, windows

KINDS = "big bigint, name string, at timestamp, local timestamp_ntz, day date, x double, money decimal(12,2), long decimal(38,6), flag boolean, small int"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    base = dt.datetime(2020, 5, 1)
    rows = []
    for i in range(700):
        hot = i % 3 == 0
        stamp = base if hot else base + dt.timedelta(microseconds=rng.randrange(10**13))
        rows.append((
            rng.choice([None, -(2**62) + rng.randrange(9), 2**60 + rng.randrange(3), 5]), rng.choice(["", "a", "a\x01", "abcdefghij", "abcdefghik", "é", None, "z" * 14]), stamp, stamp,
            stamp.date(), rng.choice([None, float("nan"), -0.5, 1e300, 3.25, -7.0]), decimal.Decimal(rng.randrange(-50, 50)) / 4,
            rng.choice([decimal.Decimal("12345678901234567890123456.000001"), decimal.Decimal("12345678901234567890123456.000002"), decimal.Decimal("-3.5"), None]), rng.choice([True, False, None]), rng.randrange(5),
        ))
    return spark.createDataFrame(rows, KINDS).repartition(3).cache()


@pytest.mark.parametrize("accuracy", [40, 10_000])
@pytest.mark.parametrize("order", [["big"], ["name"], ["at", "big"], ["local", "x"], ["day", "name", "small"], ["money", "flag"], ["long", "small"], ["x", "at"]])
def test_cuts_equal_sorting(table, order, accuracy):
    keys = [d for c in order for d in ranking.digits(table, c)]
    clean = table.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    sorted_rows = [tuple(r) for r in clean.orderBy(*[F.col(c).asc_nulls_first() for c in order]).select(*order).collect()]
    n = len(sorted_rows)
    spots = [0, 1, n // 3, n // 2, n - 1]
    cuts = ranking.rank_cuts(table, {str(r): (F.lit(True), keys, r) for r in [*spots, n, -1]}, accuracy)
    assert set(cuts) == set(map(str, spots))
    for r in spots:
        cut = cuts[str(r)]
        less = sum(1 for i, row in enumerate(sorted_rows) if sorted_rows.index(row) < sorted_rows.index(sorted_rows[r]))
        assert (cut.less, cut.equal) == (less, sorted_rows.count(sorted_rows[r]))
        got = clean.select(F.count_if(cut.before()).alias("b"), F.count_if(cut.after()).alias("a")).first()
        assert (got["b"], got["a"]) == (less, n - less - cut.equal)
        assert {tuple(x) for x in clean.where(cut.at()).select(*order).collect()} == {sorted_rows[r]}


def test_split_keeps_every_row(spark, table):
    doubled = table.unionByName(table.where("small = 1"))
    total = doubled.count()
    for share in (0.0, 0.1, 0.5, 0.999, 1.0):
        left, right = stats.split_by_time(doubled, ["at", "big"], share)
        assert (left.count(), right.count()) == (int(total * share), total - int(total * share))
        assert not left.unionByName(right).exceptAll(doubled).count()
        if left.count() and right.count():
            assert left.agg(F.max("at")).first()[0] <= right.agg(F.min("at")).first()[0]
    copies = spark.createDataFrame([(1, "a")] * 90 + [(2, "b")] * 10, "t int, v string")
    left, right = ranking.split_at(copies, ["t"], 70)
    assert left.count() == 70 and right.where("t = 1").count() == 20 and right.count() == 30
    assert ranking.split_at(copies.limit(0), ["t"], 0)[1].count() == 0


@pytest.mark.parametrize("use", ["sum", "avg"])
def test_trends_of_all_values_at_once(table, use):
    found = {r["value"]: r for r in windows.early_late_trends(table, ["at"], ["x", "small", "money"], 0.2, use).collect()}
    for v in ("x", "small", "money"):
        rows = sorted((r["at"], float(r[v])) for r in table.collect() if r[v] is not None and r[v] == r[v])
        edge = max(1, int(len(rows) * 0.2))
        first, last = (sum(x for _, x in part) / (1 if use == "sum" else edge) for part in (rows[:edge], rows[len(rows) - edge :]))
        assert found[v]["n"] == len(rows)
        assert found[v]["first_value"] == pytest.approx(first, rel=1e-9, abs=1e-4) and found[v]["last_value"] == pytest.approx(last, rel=1e-9, abs=1e-4)
    nothing = windows.early_late_trend(table.limit(0), ["at"], "x").first()
    assert nothing["n"] == 0 and nothing["first_value"] is None and nothing["trend"] == "stable"


@pytest.mark.parametrize("accuracy,few", [(1_000, 100_000), (100, 0)])
def test_grouped_quantiles_with_a_hot_group(spark, accuracy, few):
    """One group holds 90% of the rows; values repeat, are missing, or are one value only."""
    rng = random.Random(7)
    rows = [("hot", rng.choice([rng.random() * 1000, 5.0])) for _ in range(9000)] + [("one", 3.0)] * 50 + [("none", None)] * 5 + [(None, float(i)) for i in range(400)] + [("two", x) for x in (1.0, 2.0)] + [("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    found = {r["g"]: r for r in ranking.group_quantiles(df, ["g"], {"x": F.col("x")}, {"q1": 0.25, "med": 0.5, "p99": 0.99}, accuracy, few).collect()}
    assert set(found) == {"hot", "one", "none", None, "two", "nan"}
    for g in ("hot", "one", None, "two"):
        values = sorted(x for h, x in rows if h == g and x is not None)
        for name, p in (("q1", 0.25), ("med", 0.5), ("p99", 0.99)):
            at = p * (len(values) - 1)
            low = int(at)
            want = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)
            assert found[g][f"x_{name}"] == pytest.approx(want, rel=1e-12)
    assert found["none"]["x_med"] is None and found["nan"]["x_med"] is None


def test_medians_beside_other_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 2), ("a", 9.0, 9), (None, 2.0, 3)], "g string, x double, y int")
    wanted = [metrics.Metric("total", "SUM", "x"), metrics.Metric("middle", "MEDIAN", "x"), metrics.Metric("late", "MEDIAN", "x", "y > 1")]
    assert {tuple(r) for r in metrics.evaluate(df, wanted, ["g"]).collect()} == {("a", 14.0, 4.0, 6.5), (None, 2.0, 2.0, 2.0)}
    assert tuple(metrics.evaluate(df, wanted).first()) == (16.0, statistics.median([1, 4, 9, 2]), 4.0)


def test_whole_table_windows_run_in_several_tasks(spark):
    """No partition columns: several range partitions, values carried over them, ties across their borders."""
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1.0, 1.0, 1.0, 2.0, 7.5])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, y double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranking.scanned(df, [], [F.col("id")])
        assert placed.select("_pid").distinct().count() > 1 and [r["_at"] for r in placed.orderBy("id").collect()] == list(range(2000))
        ranked = windows.ranks(df, "y", tie=["id"]).collect()
        by = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        place = {r[0]: i + 1 for i, r in enumerate(by)}
        values = [r[1] for r in by]
        distinct = list(dict.fromkeys(values))
        for r in ranked:
            assert (r["unique_rank"], r["rank"], r["dense_rank"], r["index"]) == (place[r["id"]], values.index(r["y"]) + 1, distinct.index(r["y"]) + 1, r["id"] + 1)
        total, count, low, high = 0.0, 0, None, None
        run = {r["id"]: r for r in windows.running(df, "y", ["id"]).collect()}
        look = {r["id"]: r for r in windows.lookups(df, "y", ["id"], offset=700).collect()}
        for i, y in rows:
            if y is not None:
                total, count, low, high = total + y, count + 1, y if low is None else min(low, y), y if high is None else max(high, y)
            r = run[i]
            assert (r["running_sum"], r["running_count"], r["running_min"], r["running_max"]) == (total if count else None, count, low, high)
            assert (look[i]["lookup_back"], look[i]["lookup_ahead"]) == (rows[i - 700][1] if i >= 700 else None, rows[i + 700][1] if i + 700 < 2000 else None)
            assert (look[i]["first_offset"], look[i]["last_offset"]) == (-i, 1999 - i)
        last = ranking.running_folds(placed, [], {"seen": (F.col("y"), "last")}).orderBy("id").collect()
        seen = None
        for r in last:
            seen = r["y"] if r["y"] is not None else seen
            assert r["seen"] == seen
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert windows.running(df.limit(0), "y", ["id"]).count() == 0
