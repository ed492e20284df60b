"""Merged summaries of parts against full scans; stable dimension keys; text formats with stamps."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lensdq.operators import model, summaries
from lensdq.sources import readers, writers


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, rng.choice([None, float("nan"), rng.gauss(1e6, 3), rng.gauss(-5, 400)]), rng.choice(["hot"] * 6 + [None, f"v{rng.randrange(300)}"]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(10**6))) for i in range(6000)]


def test_parts_add_up_to_the_full_scan(spark, rows, tmp_path):
    schema = "id bigint, x double, word string, at timestamp"
    store = summaries.SummaryStore(spark, str(tmp_path / "store"))
    cuts = [0, 2500, 2500, 2600, 6000]  # one part is empty, one small
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        assert store.add(spark.createDataFrame(rows[a:b], schema).repartition(3), f"day={i}")
    assert not store.add(spark.createDataFrame(rows, schema), "day=1")
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame(rows, schema), "../x")
    assert store.parts() == ["day=0", "day=1", "day=2", "day=3"]
    found = {r["column_name"]: r for r in store.profile(probs=(0.1, 0.5, 0.9), k=3).collect()}
    whole = {r["column_name"]: r for r in summaries.profile(summaries.summarise(spark.createDataFrame(rows, schema), "all"), probs=(0.1, 0.5, 0.9), k=3).collect()}
    x = [r[1] for r in rows if r[1] is not None and r[1] == r[1]]
    r = found["x"]
    assert (r["row_count"], r["null_count"], r["min_value"], r["max_value"], r["negative_count"]) == (6000, 6000 - len(x), min(x), max(x), sum(v < 0 for v in x))
    assert r["mean"] == pytest.approx(statistics.fmean(x), rel=1e-9) and r["std"] == pytest.approx(statistics.stdev(x), rel=1e-6)
    for c in ("id", "x", "word", "at"):
        for name in ("row_count", "null_count", "least", "greatest", "zero_count"):
            assert found[c][name] == whole[c][name]
        exact = len({row[["id", "x", "word", "at"].index(c)] for row in rows} - {None}) if c != "x" else len(set(x))
        assert found[c]["distinct_estimate"] == pytest.approx(exact, rel=0.08)
    ordered = sorted(x)
    for p, q in zip((0.1, 0.5, 0.9), r["quantiles"]):
        place = sum(v <= q for v in ordered) / len(ordered)
        assert abs(place - p) < 0.02
    assert found["word"]["quantiles"] is None and found["word"]["mean"] is None
    top = found["word"]["top_values"]
    assert top[0]["item"] == "hot" and top[0]["count"] == sum(row[2] == "hot" for row in rows)


def test_profile_reads_summaries_only(spark, rows, tmp_path):
    data = str(tmp_path / "data")
    spark.createDataFrame(rows, "id bigint, x double, word string, at timestamp").write.parquet(f"{data}/old")
    spark.createDataFrame(rows[:10], "id bigint, x double, word string, at timestamp").write.parquet(f"{data}/new")
    store = summaries.SummaryStore(spark, str(tmp_path / "store"))
    store.add(spark.read.parquet(f"{data}/old"), "old")
    store.add(spark.read.parquet(f"{data}/new"), "new")
    assert all("/store/parts/" in f for f in store.summaries().inputFiles())
    assert store.profile().where("column_name = 'id'").first()["row_count"] == 6010
    with pytest.raises(ValueError):
        summaries.SummaryStore(spark, str(tmp_path / "none")).profile()


def test_dimension_keys_stay(spark):
    first = model.build_dimension(spark.createDataFrame([("b",), ("d",), (None,)], "v string"), "v", "2024-01-01")
    more = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), (None,), ("c",)], "v string")
    grown = model.extend_dimension(first, more, "v", "2024-02-01")
    assert {(r["value"], r["dim_key"]) for r in grown.collect()} == {("b", 1), ("d", 2), ("a", 3), ("c", 4), ("z", 5)}
    assert model.extend_dimension(grown, more, "v", "2024-03-01").count() == 5
    assert model.extend_dimension(first.limit(0), more, "v", "2024-03-01").agg(F.max("dim_key")).first()[0] == 4


def test_text_formats_keep_microseconds(spark, tmp_path):
    schema = "id int, at timestamp_ntz, name string"
    rows = [(1, dt.datetime(2024, 2, 29, 23, 59, 59, 123456), "a b"), (2, dt.datetime(1969, 1, 1, 0, 0, 0, 1), "ü"), (3, None, None)]
    df = spark.createDataFrame(rows, schema)
    back = [
        readers.read_csv(spark, writers.write_csv(df, str(tmp_path / "a.csv")), schema), readers.read_json(spark, writers.write_json(df, str(tmp_path / "a.json")), schema),
        readers.read_xml(spark, writers.write_xml(df, str(tmp_path / "a.xml")), "row", schema), readers.read_delimited(spark, writers.write_csv(df, str(tmp_path / "a.txt"), sep=";"), schema),
    ]
    for other in back:
        assert sorted(map(tuple, other.collect()), key=str) == sorted(rows, key=str)
    layout = [("id", 1, 4), ("at", 6, 26), ("name", 33, 5)]
    fixed = readers.read_folder(spark, [writers.write_fixed_width(df, str(tmp_path / "f.prn"), layout), str(tmp_path / "a.xml")], layouts={"f": layout})
    assert fixed["f"].withColumn("at", F.try_to_timestamp("at").cast("timestamp_ntz")).where("id = 1").first()["at"] == rows[0][1]
    assert fixed["a"].count() == 3
    with pytest.raises(Exception, match="wider"):
        writers.write_fixed_width(df, str(tmp_path / "g.prn"), [("name", 1, 2)])
