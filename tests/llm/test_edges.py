"""Clashing column names, and executors without the package."""

import pathlib
import subprocess
import sys

from pyspark.sql import functions as F

from lensdq.llm import mixing, sharding

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_shards_leave_columns_of_any_name_alone(spark):
    rows = [(i, f"s{i % 5}" if i % 7 else None, i * 10, -i, f"v{i}", 7, 8, 9, 99, 5) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, _h bigint, _v string, _cell int, _x0 int, _k0 int, shard int, Slot int").repartition(3)
    out = sharding.shard(df, ["source", "size"], 7, ["doc_id"]).collect()
    assert {r["doc_id"]: (r["_h"], r["_v"], r["_cell"], r["_x0"], r["_k0"]) for r in out} == {r[0]: (r[3], r[4], 7, 8, 9) for r in rows}
    assert out[0].__fields__ == ["doc_id", "source", "size", "_h", "_v", "_cell", "_x0", "_k0", "hilbert", "shard", "slot"]
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [r["hilbert"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    # A column that is replaced may still be a dimension.
    assert sharding.shard(df, ["shard"], 2, ["doc_id"]).count() == 60


def test_text_cells_are_equal_ranks_of_distinct_values(spark):
    values = [f"{i:03d}" for i in range(100)]
    df = spark.createDataFrame([(v,) for v in values * 3] + [(None,)], "v string").repartition(4)
    got = {r["v"]: r["x"] for r in sharding._cells(df, "v", "x", 3).collect()}
    assert got == {None: 0} | {v: i * 8 // 100 for i, v in enumerate(values)}


def test_mix_leaves_columns_of_any_name_alone(spark):
    rows = [(i, f"s{i % 3}", "word " * (i % 9), 99, "p", 3, 4, 5) for i in range(90)] + [(1, "s1", "word", 99, "p", 3, 4, 5)] * 3
    names = "doc_id bigint, source string, text string, _size int, _place string, _copy int, _d int, _rows int"
    df = spark.createDataFrame(rows, names)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert out.select("_size", "_place", "_copy", "_d", "_rows").distinct().collect() == [(99, "p", 3, 4, 5)]
    copies = mixing.mix(df).agg(F.sum("copies")).first()[0]
    assert out.count() == copies


def test_models_reach_executors_without_the_package(tmp_path):
    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from lensdq.llm import ann, langid
docs = spark.createDataFrame([(i, "the cat and the dog " * 5 if i % 2 else "der hund und die katze " * 5, "en" if i % 2 else "de") for i in range(20)], "doc_id bigint, text string, lang string")
found = langid.identify(docs, langid.fit(docs)).collect()
assert all(r["lang"] == r["lang_pred"] for r in found)
vectors = spark.createDataFrame([(i, [float(i), float(i * i % 17), 1.0]) for i in range(120)], "vec_id bigint, embedding array<double>")
assert ann.nearest(vectors, F.col("vec_id") % 100 == 0, k=3).count() == 6
print("fine")
"""
    got = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert got.stdout.strip().endswith("fine"), got.stderr[-2000:]
