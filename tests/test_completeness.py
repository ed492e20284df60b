"""No caps, prefixes or size switches: cases that a limit would cut, wrong answers of the past, and empty tables."""


import pytest
from pyspark.sql import functions as F

from lensdq.functions import text
from lensdq.operators import audit, generate, governance, lineage, match, model, observe, relate, rules, stats
from lensdq.operators.longform import full_row_counts, quantiles


def test_quantiles_between_two_heavy_values(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 0.0).when(F.col("id") == 1, 0.5).otherwise(1.0).alias("x"), F.lit(7.0).alias("y"), F.lit(None).cast("double").alias("z"))
    rows = {r["column_name"]: r for r in quantiles(df, ["x", "y", "z"], {"a": 0.25, "m": 0.5, "b": 0.9}, bracket_rows=0).collect()}
    assert (rows["x"]["a"], rows["x"]["m"], rows["x"]["b"]) == (0.0, 0.25, 1.0)
    assert rows["y"]["m"] == 7.0 and rows["z"]["m"] is None


def test_quantiles_of_a_million_values_with_a_hot_one(spark):
    df = spark.range(1_000_000).select(F.when(F.col("id") % 3 == 0, 123.0).otherwise(F.pmod(F.col("id") * 7919, F.lit(1_000_003)).cast("double")).alias("x"))
    import numpy as np

    values = np.array([123.0 if i % 3 == 0 else float(i * 7919 % 1_000_003) for i in range(1_000_000)])
    row = quantiles(df, ["x"], {"a": 0.1, "b": 0.5, "c": 0.999}, bracket_rows=50).first()
    for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.999)):
        assert row[name] == pytest.approx(np.quantile(values, p))


def test_row_copies_meet_by_hash_with_nulls_in_place(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), ("a", "")], "x string, y string")
    assert full_row_counts(df).first().asDict() == {"row_count": 4, "distinct_rows": 3, "duplicate_rows": 1}


def test_ninth_descriptor_is_loaded_and_seen(spark):
    cols = ", ".join(f"d{i} int" for i in range(12))
    before = spark.createDataFrame([(1, *range(12))], f"k int, {cols}")
    after = spark.createDataFrame([(1, *range(11), 99)], f"k int, {cols}")
    kept = model.satellite_load(before, "k", "s", "2024-01-01")
    assert {f"d{i}" for i in range(12)} <= set(kept.columns)
    assert model.satellite_load(after, "k", "s", "2024-02-01", kept).count() == 1
    assert model.satellite_load(before, "k", "s", "2024-02-01", kept).count() == 0


@pytest.mark.parametrize("old,new", [(("a|b", "c"), ("a", "b|c")), ((None, "c"), ("", "c")), (("1:a", ""), ("", "1:a"))])
def test_scd2_sees_changes_that_join_to_one_text(spark, old, new):
    shape = "k int, a string, b string"
    current = spark.createDataFrame([(1, *old)], shape).select("*", F.lit("2023-01-01").cast("date").alias("effective_date"), F.lit(model.HIGH_DATE).cast("date").alias("expiry_date"), F.lit(True).alias("is_current"))
    out = model.scd2_apply(current, spark.createDataFrame([(1, *new)], shape), "k", ["a", "b"], "2024-01-01")
    assert sorted(r["is_current"] for r in out.collect()) == [False, True]


def test_scd2_keeps_an_unchanged_null_key(spark):
    shape = "k int, a string"
    rows = spark.createDataFrame([(None, "x")], shape)
    current = rows.select("*", F.lit("2023-01-01").cast("date").alias("effective_date"), F.lit(model.HIGH_DATE).cast("date").alias("expiry_date"), F.lit(True).alias("is_current"))
    out = model.scd2_apply(current, rows, "k", ["a"], "2024-01-01").collect()
    assert len(out) == 1 and out[0]["is_current"] and str(out[0]["effective_date"]) == "2023-01-01"


def test_baseline_of_forty_categories_does_not_drift_from_itself(spark):
    df = spark.range(400).select(F.concat(F.lit("v"), (F.col("id") % 40).cast("string")).alias("c"), F.lit(None).cast("string").alias("gone"))
    base = observe.categorical_baseline(df)
    row = observe.categorical_drift(df, base).collect()
    assert [(r["column_name"], r["new_categories"], r["removed_categories"], r["drifted"], r["score"]) for r in row] == [("c", 0, 0, False, 100.0)]
    emptied = observe.categorical_drift(df.withColumn("c", F.lit(None).cast("string")), base).collect()
    assert [(r["removed_categories"], r["dominant_changed"], r["drifted"]) for r in emptied] == [(40, True, True)]


def test_generated_ids_stay_whole_and_differ(spark):
    rows = spark.range(99_990, 100_030)
    out = [r["Order Id"] for r in generate.generate_rows(rows, [("Order Id", "string", "dimension")], "2024-01-01").collect()]
    assert len(set(out)) == 40 and "ORD-100010" in out


def test_a_chain_of_ten_thousand_links_is_one_cluster(spark):
    links = spark.range(10_000).select(((F.col("id") * 7919) % 10_007).alias("x")).select(F.col("x").alias("id_a"), ((F.col("x") + 7919) % 10_007).alias("id_b"))
    found = match.clusters(links).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster_id").alias("c")).first()
    assert found["n"] == 10_001 and found["c"] == 1


def test_lineage_sixty_steps_deep(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "feeds") for i in range(60)], "source string, target string, relationship string")
    nodes = spark.createDataFrame([(f"n{i}", "table") for i in range(61)], "id string, type string")
    assert lineage.impact(edges, nodes, "n0").first()["total_downstream"] == 60


def test_name_matching_serves_low_thresholds(spark):
    names, candidates = spark.createDataFrame([("abc",)], "name string"), spark.createDataFrame([("axc",)], "candidate string")
    assert relate.resolve_names(names, candidates, threshold=60).first()["score"] == 66.7
    with pytest.raises(ValueError):
        relate.resolve_names(names, candidates, threshold=0)


def test_facts_cover_all_measures_and_labels(spark):
    df = spark.range(20).select(*[(F.col("id") * i).cast("double").alias(f"m{i}") for i in range(1, 9)], *[(F.col("id") % i).cast("string").alias(f"d{i}") for i in range(1, 7)])
    subjects = {(r["fact"], r["subject"]) for r in audit.verified_facts(df).collect()}
    assert {("total", f"m{i}") for i in range(1, 9)} | {("top1_pct", f"d{i}") for i in range(1, 7)} <= subjects


def test_cost_of_validity_grows_with_the_rows(spark):
    wide = lambda n: spark.createDataFrame([("t", n, 100.0, 100.0, 100.0, 50.0, 100.0)], "table_name string, row_count bigint, completeness double, accuracy double, uniqueness double, validity double, timeliness double")
    cost = [governance.quality_cost(wide(n)).first()["validity_cost"] for n in (1_000, 1_000_000)]
    assert cost[1] == pytest.approx(1_000 * cost[0])
    assert governance.quality_cost(wide(10**6), most_violations=100).first()["validity_cost"] < cost[0]


def test_findings_that_start_alike_are_two_issues(spark):
    long = "x" * 120
    findings = spark.createDataFrame([("t", "validity", "HIGH", long + "one"), ("t", "validity", "HIGH", long + "two")], "table_name string, dimension string, priority string, finding string")
    known = spark.createDataFrame([("t", "validity", long + "ONE", "Open")], "table_name string, dimension string, title string, status string")
    assert [r["title"] for r in governance.issues_from_findings(findings, known, "2024-01-01").collect()] == [long + "two"]


@pytest.mark.parametrize("raw,want", [
    ("in 2024 and 1234567", [(2024.0, ""), (1234567.0, "")]), ("1,234,567.5 rows", [(1234567.5, "rows")]), ("took 5 mins", [(5.0, "mins")]),
    ("saves 12%", [(12.0, "%")]), ("v1.2.3 and /7 a9", []), ("10 similar things, 20 kg", [(10.0, "kg"), (20.0, "kg")]), ("$1,500", [(1500.0, "")]), ("EUR 40", [(40.0, "EUR")]),
    ("mark \u0001 5 \u0001 6", [(5.0, ""), (6.0, "")]), (None, []), ("", []),
])
def test_number_extraction(spark, raw, want):
    rows = text.extract_numbers(spark.createDataFrame([(1, raw)], "k int, t string"), "k", "t").orderBy("number_index").collect()
    assert [(r["value"], r["unit"]) for r in rows] == want


@pytest.mark.parametrize("chi2,dof,want", [(3000.0, 3000, 0.496565), (3000.0, 3001, 0.501713), (1600.0, 1600, 0.495298), (3.84, 1, 0.050044), (10.0, 4, 0.040428), (7.0, 3, 0.071898), (0.0, 5, 1.0), (5000.0, 5, 0.0)])
def test_chi_square_tail(spark, chi2, dof, want):
    assert stats.chi_square_p(spark.createDataFrame([(chi2, dof)], "chi2 double, dof int")).first()["p_value"] == pytest.approx(want, abs=2e-5)


def test_whole_numbers_meet_across_types(spark):
    a, b = spark.createDataFrame([(5,), (6,)], "customer_id bigint"), spark.createDataFrame([(5.0,), (7.5,)], "customer_id double")
    found = relate.detect_relationships({"a": a, "b": b}).collect()
    assert [r["overlap_pct"] for r in found] == [50.0]


def test_quarantine_marks_repeated_and_orphan_rows(spark):
    df = spark.createDataFrame([(1, 10), (1, 11), (2, None), (None, 99), (None, 10)], "k int, ref int")
    checks = [rules.Rule("u", "k", "unique"), rules.Rule("r", "ref", "referential", {"reference_table": "t", "reference_column": "id"}), rules.Rule("n", "ref", "not_null")]
    refs = {"t": spark.createDataFrame([(10,), (11,)], "id int")}
    passing, failing = rules.split(df, checks, refs)
    assert [tuple(r) for r in passing.collect()] == []
    assert sorted((r["k"] or 0, r["ref"] or 0, tuple(r["failed_rules"])) for r in failing.collect()) == [
        (0, 10, ("u",)), (0, 99, ("u", "r")), (1, 10, ("u",)), (1, 11, ("u",)), (2, 0, ("n",)),
    ]
    with pytest.raises(ValueError):
        rules.quarantine(df, checks)


def test_empty_inputs_give_defined_results(spark):
    none = spark.createDataFrame([], "x double, c string")
    some = spark.createDataFrame([(1.0, "a")], "x double, c string")
    assert stats.ks_two_sample(none, "x", some).first()["ks_stat"] is None
    assert observe.numeric_drift(none.select("c"), observe.numeric_baseline(some)).collect() == []
    assert observe.numeric_drift(none, observe.numeric_baseline(some)).first()["drifted"] is False
    assert observe.categorical_baseline(none.select("x")).collect() == []
    assert full_row_counts(none).first()["row_count"] == 0
    assert quantiles(none, ["x"], {"m": 0.5}).first()["m"] is None
