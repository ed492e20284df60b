"""Statistics, matching, lineage and text extraction against brute force."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lensdq.functions import text
from lensdq.functions.similarity import indel_ratio, levenshtein_ratio, token_sorted
from lensdq.operators import lineage, match, metrics, model, observe, portfolio, relate, remediate, stats, windows
from lensdq.operators.metrics import Metric, Ratio


def test_spc_rules_against_plain_loop(spark):
    rng = random.Random(11)
    values = [rng.gauss(0, 1) for _ in range(300)] + [9.0, 9.5, 10.0] + [float(i) / 10 for i in range(12)] + [2.5] * 11
    df = spark.createDataFrame(list(enumerate(values)), "t int, v double")
    n = len(values)
    mean = sum(values) / n
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1))
    expected = set()
    for i, v in enumerate(values):
        if abs(v - mean) > 3 * std:
            expected.add((i, 1))
        w9 = values[i - 8:i + 1] if i >= 8 else []
        if w9 and (all(x > mean for x in w9) or all(x < mean for x in w9)):
            expected.add((i, 2))
        w6 = values[i - 5:i + 1] if i >= 5 else []
        steps = [b - a for a, b in zip(w6, w6[1:])]
        if steps and (all(s > 0 for s in steps) or all(s < 0 for s in steps)):
            expected.add((i, 3))
        if i >= 2 and sum(abs(x - mean) > 2 * std for x in values[i - 2:i + 1]) >= 2:
            expected.add((i, 4))
    got = {(r["pos"], r["rule"]) for r in stats.spc_violations(df, ["t"], "v", chunk=23).collect()}
    assert got == expected


def test_spc_needs_eight_points_and_spread(spark):
    flat = spark.createDataFrame([(i, 1.0) for i in range(20)], "t int, v double")
    assert stats.spc_limits(flat, "v").count() == 0
    assert stats.spc_violations(flat, ["t"], "v").count() == 0


def test_ks_against_brute_force(spark):
    rng = random.Random(5)
    a = [round(rng.gauss(0, 1), 1) for _ in range(400)]
    b = [round(rng.gauss(0.3, 1), 1) for _ in range(250)]
    points = sorted(set(a) | set(b))
    d = max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)
    row = stats.ks_two_sample(spark.createDataFrame([(x,) for x in a], "v double"), "v", spark.createDataFrame([(x,) for x in b], "v double")).first()
    assert row["ks_stat"] == pytest.approx(d, abs=1e-6)


def test_psi_drops_out_of_range_but_keeps_the_total(spark):
    ref = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    cur = spark.createDataFrame([(float(i),) for i in range(50)] + [(1e6,)] * 50, "v double")
    expected = 0.0
    for b in range(10):
        r = sum(b * 9.9 <= i and (i < (b + 1) * 9.9 or b == 9) for i in range(100)) / 100 + 1e-6
        c = sum(b * 9.9 <= i and (i < (b + 1) * 9.9 or b == 9) for i in range(50)) / 100 + 1e-6
        expected += (c - r) * math.log(c / r)
    assert stats.numeric_psi(ref, cur, ["v"]).first()["psi"] == pytest.approx(expected, abs=1e-4)


@pytest.mark.parametrize("chi2, dof, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (15.50731, 8, 0.05), (16.91898, 9, 0.05)])
def test_chi_square_tail(spark, chi2, dof, p):
    df = spark.createDataFrame([(chi2, dof)], "chi2 double, dof int")
    assert stats.chi_square_p(df).first()["p_value"] == pytest.approx(p, abs=1e-5)


def test_benford_digits_of_small_and_large_numbers(spark):
    df = spark.createDataFrame([(0.00123,), (9.9e12,), (-5.0,), (45.0,)], "v double")
    digits = {r["digit"]: r["observed"] for r in stats.benford_digits(df).collect() if r["observed"]}
    assert digits == {1: 1, 9: 1, 4: 1}


def test_entity_resolution_with_one_hot_block(spark):
    rng = random.Random(2)
    words = ["red", "ring", "blue", "bolt", "lamp"]
    rows = [(i, ("abc " if i % 3 else "xyz ") + " ".join(rng.sample(words, 3)), rng.choice(["x", "y", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, name string, tag string")

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
            prev = row
        return prev[-1]

    ratio = lambda a, b: (1 - lev(a, b) / max(len(a), len(b))) * 100
    key = lambda s: " ".join(sorted((s or "").split()))
    expected = set()
    for block in ("abc", "xyz"):
        inside = [r for r in rows if r[1][:3] == block]
        for i, a in enumerate(inside):
            for b in inside[i + 1:i + 10]:
                scores = [ratio(key(a[1]), key(b[1]))] + ([ratio(a[2], b[2])] if a[2] and b[2] else [])
                if sum(scores) / len(scores) >= 85:
                    expected.add((a[0], b[0]))
    got = {(r["id_a"], r["id_b"]) for r in match.duplicate_pairs(df, "id", ["name", "tag"], chunk=16).collect()}
    assert got == expected


def test_similarity_values(spark):
    df = spark.createDataFrame([("a b", "b a"), ("kitten", "sitting")], "x string, y string")
    rows = df.select(token_sorted(F.col("x")).alias("t"), levenshtein_ratio(F.col("x"), F.col("y")).alias("l"), indel_ratio(F.col("x"), F.col("y")).alias("i")).collect()
    assert rows[0]["t"] == "a b"
    assert rows[1]["l"] == pytest.approx((1 - 3 / 7) * 100)
    assert rows[1]["i"] == pytest.approx(200 * 4 / 13)


def test_clusters_against_union_find(spark):
    rng = random.Random(9)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 201 + i) for i in range(25)]
    pairs = [(a, b) for a, b in pairs if a != b]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    expected = {x: find(x) for x in list(parent)}
    got = {r["id"]: r["cluster_id"] for r in match.clusters(spark.createDataFrame(pairs, "id_a int, id_b int")).collect()}
    assert got == expected


def test_lineage_walk_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "f"), ("b", "c", "f"), ("c", "a", "f"), ("c", "d", "f"), ("a", "c", "f")], "source string, target string, relationship string")
    got = {r["id"]: (r["distance"], r["path"]) for r in lineage.reachable(edges, "a", "down", 50).collect()}
    assert got == {"b": (1, "a > b"), "c": (1, "a > c"), "d": (2, "a > c > d")}
    assert {r["id"] for r in lineage.reachable(edges, "d", "up", 1).collect()} == {"c"}


def test_overlap_matches_sets(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (3,), (4,), (5,), (6,)], "k int")
    row = relate.value_overlaps({"l": left, "r": right}, [("l", "k"), ("r", "k")]).first()
    assert (row["common"], row["left_distinct"], row["right_distinct"]) == (2, 3, 5)
    assert row["overlap"] == pytest.approx(2 / 3)
    orphans = {r["side"]: (r["distinct_count"], r["orphan_count"], r["reported"]) for r in relate.orphan_keys(left, "k", right, "k").collect()}
    assert orphans == {"left": (3, 1, True), "right": (5, 3, False)}


def test_auto_join_renames_clashes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "customer_id int, name string")
    b = spark.createDataFrame([(1, "n1"), (1, "n2")], "customer_id int, name string")
    out, log = relate.auto_join({"a": a, "b": b})
    assert out.columns == ["customer_id", "name", "customer_id_b", "name_b"]
    assert out.count() == 3 and log == ["a.customer_id = b.customer_id"]
    lone, note = relate.auto_join({"a": a.select("name"), "c": spark.createDataFrame([(5.5,)], "z double")})
    assert note[0].startswith("no relationship") and lone.columns == ["name"]


def test_resolve_names_methods(spark):
    names = spark.createDataFrame([("Sales Amount",), ("amount sales",), ("Sales-Amount",), ("Rev",), ("zzz",)], "name string")
    cands = spark.createDataFrame([("sales amount",), ("revenue",)], "candidate string")
    got = {r["name"]: (r["candidate"], r["method"]) for r in relate.resolve_names(names, cands, {"rev": "revenue"}).collect()}
    assert got == {"Sales Amount": ("sales amount", "exact"), "Sales-Amount": ("sales amount", "normalized"), "Rev": ("revenue", "alias"), "amount sales": ("sales amount", "fuzzy_token_sort")}


def test_numbers_of_given_texts(spark):
    samples = ["costs $1,234.50 in 3 days", "v1.2.3 is no number, 45% is", "path/7 and x9 but 12 kg", "", "a -5 b", "1,000,000 rows; 2_000 items"]
    df = spark.createDataFrame(list(enumerate(samples)), "k int, t string")
    # No part of a version string is a number.
    expected = [(0, 3.0), (0, 1234.5), (1, 45.0), (2, 12.0), (4, -5.0), (5, 2000.0), (5, 1000000.0)]
    rows = text.extract_numbers(df, "k", "t").collect()
    assert sorted((r["k"], r["value"]) for r in rows) == expected
    assert {r["unit"] for r in rows if r["k"] == 2} == {"kg"}


def test_lod_and_ratio_metrics(sales, sales_nulls, sales_empty):
    assert metrics.lod_fixed(sales, ["Region"], "MAX", "Sales").first()["value"] == 900.0
    assert metrics.lod_fixed(sales_nulls, ["Region"], "COUNT", "Sales").first()["value"] == 2.0
    zero = Ratio("r", Metric("a", "SUM", "Sales"), Metric("b", "SUM", "Profit * 0"), -1)
    assert metrics.evaluate(sales, [zero]).first()["r"] == -1
    row = metrics.evaluate(sales_empty, [Metric("s", "SUM", "Sales"), Metric("n", "COUNTROWS")]).first()
    assert row["s"] is None and row["n"] == 0
    assert metrics.exact_median(sales, "Sales").first()["median"] == 300.0


def test_reconciliation(sales):
    pairs = [("same", F.sum("Sales"), F.sum(F.col("Sales") + 0)), ("off", F.sum("Sales"), F.sum("Sales") * 1.01), ("none", F.sum("Sales"), F.sum(F.lit(None).cast("double")))]
    got = {r["metric"]: r["match"] for r in metrics.reconcile(sales, pairs).collect()}
    assert got == {"same": True, "off": False, "none": None}


def test_scd2_versions(spark):
    cur = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", True)], "k int, v string, is_current boolean").select(
        "k", "v", F.lit("2023-01-01").cast("date").alias("effective_date"), F.lit(model.HIGH_DATE).cast("date").alias("expiry_date"), "is_current"
    )
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k int, v string")
    out = {(r["k"], r["v"], r["is_current"]) for r in model.scd2_apply(cur, new, "k", ["v"], "2024-01-01").collect()}
    assert out == {(1, "a", True), (2, "b", False), (2, "B", True), (3, "c", False), (4, "d", True)}


def test_repairs(sales_nulls):
    fixed = remediate.remediate(sales_nulls, ["dedup", "imputation", "remove_outliers"])
    assert {r["Region"] for r in fixed.collect()} == {"East", "West", "Unknown"}
    assert sorted(r["Sales"] for r in fixed.collect()) == [100.0, 300.0, 300.0, 300.0, 500.0]
    log = {(r["action"], r["column_name"]): r["rows_affected"] for r in remediate.change_log(sales_nulls).collect()}
    assert log == {("imputation", "Sales"): 2, ("imputation", "Region"): 2, ("imputation", "Value"): 1}


def test_schema_drift_kinds(spark):
    a = observe.schema_snapshot(spark.createDataFrame([(1, "x", 1.0, 1)], "a int, b string, c double, d int"))
    b = observe.schema_snapshot(spark.createDataFrame([(1, 2, 1.0, None)], "a bigint, e int, c double, d int"))
    got = {r["column_name"]: (r["change"], r["severity"]) for r in observe.schema_drift(a, b).collect()}
    assert got == {"a": ("type_changed", "CRITICAL"), "b": ("removed", "CRITICAL"), "e": ("new", "WARN"), "d": ("nullability_changed", "OK")}


def test_ranks_and_running(spark):
    v = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 30.0), ("a", 3, 30.0)], "g string, m int, y double")
    ranked = {r["m"]: (r["rank"], r["dense_rank"], r["unique_rank"]) for r in windows.ranks(v, "y", ["g"], ["m"]).collect()}
    assert ranked == {1: (3, 2, 3), 2: (1, 1, 1), 3: (1, 1, 2)}
    assert [r["running_sum"] for r in windows.running(v, "y", ["m"], ["g"]).orderBy("m").collect()] == [10.0, 40.0, 70.0]


def test_portfolio_source_sets_ignore_order(spark):
    rows = [("a", "T1, t2"), ("b", "t2,T1"), ("c", " t1 ,t2"), ("d", "t3")]
    inv = spark.createDataFrame(rows, "dashboard_id string, source_tables string").select(
        "*", F.lit(None).cast("date").alias("last_viewed_date"), F.lit("2025-01-01").cast("date").alias("created_date"), F.lit(0).alias("view_count_30d")
    )
    derived = portfolio.derive(inv)
    assert derived.first()["days_since_viewed"] == 9999
    group = portfolio.duplicate_groups(derived).collect()
    assert [(g["source_set"], g["members"]) for g in group] == [("t1,t2", 3)]


def test_value_pairs_are_counted_not_joined(spark):
    tables = {n: spark.createDataFrame([(i,) for i in range(50)], "k int") for n in "abcd"}
    keys = [(n, "k") for n in "abcd"]
    got = relate.value_overlaps(tables, keys).collect()
    assert len(got) == len(list(combinations(keys, 2))) and all(r["common"] == 50 for r in got)


@pytest.mark.parametrize("ratio", ["levenshtein", "indel"])
def test_fuzzy_names_lose_no_match(spark, ratio):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 14))) for _ in range(40)]

    def changed(s):
        i = rng.randrange(len(s))
        return rng.choice([s[:i] + s[i + 1:], s[:i] + "z" + s[i:], s[:i] + "y" + s[i + 1:], s[:i] + s[i] * 2 + s[i + 1:]])

    names = [changed(s) if rng.random() < 0.7 else changed(changed(s)) for s in base]
    left, right = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in base], "candidate string")
    score = {"levenshtein": levenshtein_ratio, "indel": indel_ratio}[ratio]
    every = left.distinct().crossJoin(right.distinct()).withColumn("score", F.round(score(F.col("name"), F.col("candidate")), 1)).where("score >= 80")
    expected = {r["name"]: r["score"] for r in every.groupBy("name").agg(F.max("score").alias("score")).collect()}
    got = {r["name"]: (r["score"], r["method"]) for r in relate.resolve_names(left, right, ratio=ratio).collect()}
    assert set(got) == set(expected)
    assert all(got[n][0] == expected[n] for n in got if got[n][1] == "fuzzy_token_sort")
