"""Readers, writers and their options."""

import pytest

from lensdq.sources import readers, writers


@pytest.mark.parametrize("sep", [",", "\t", "|", ";"])
def test_sniffed_separator(spark, tmp_path, sep):
    path = tmp_path / "data.txt"
    path.write_text(f"a{sep}b\n1{sep}x\n2{sep}y\n")
    assert readers.read_delimited(spark, str(path)).columns == ["a", "b"]


def test_json_tables(spark, tmp_path):
    path = tmp_path / "data.json"
    path.write_text('{"people": [{"n": 1, "at": {"c": "x"}}, {"n": 2, "at": {"c": "y"}}], "tags": [{"t": 5}]}')
    tables = readers.json_tables(readers.read_json(spark, str(path), multi_line=True))
    assert set(tables) == {"people", "tags"}
    assert sorted(tables["people"].columns) == ["at.c", "n"]
    assert tables["people"].count() == 2


def test_fixed_width(spark, tmp_path):
    path = tmp_path / "r.rpt"
    path.write_text("  1  abc\n 22  de \n")
    rows = readers.read_fixed_width(spark, str(path), [("n", 1, 4), ("s", 5, 4)]).collect()
    assert [(r["n"], r["s"]) for r in rows] == [("1", "abc"), ("22", "de")]


def test_warehouse_options():
    assert readers.warehouse_options("jdbc:x", table="db.s.t") == {"url": "jdbc:x", "dbtable": "db.s.t"}
    assert readers.warehouse_options("jdbc:x", query="SELECT 1", fetchsize="10")["query"] == "SELECT 1"
    with pytest.raises(ValueError):
        readers.warehouse_options("jdbc:x", table="t; DROP TABLE x")
    with pytest.raises(ValueError):
        readers.warehouse_options("jdbc:x")


def test_partitioned_write_prunes(spark):
    path = writers.scratch_path(spark, "p")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, g string")
    writers.write_parquet(df, path, partition_by=["g"])
    read = readers.read_parquet(spark, path).where("g = 'a'")
    assert read.count() == 1
    assert "PartitionFilters: [isnotnull(g" in read._jdf.queryExecution().executedPlan().toString()


def test_csv_round_trip(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "i int, s string")
    path = writers.write_csv(df, writers.scratch_path(spark, "c"))
    assert sorted(map(tuple, readers.read_csv(spark, path, "i int, s string").collect())) == [(1, "a,b"), (2, None)]
