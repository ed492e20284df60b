"""Windowed rule results of a stream against the same rows as a table."""

import pytest
from pyspark.sql import functions as F

from lensdq.operators.rules import Rule
from lensdq.streaming import windowed_results

RULES = [Rule("small", "v", "range", {"max": 50}), Rule("known", "k", "not_null")]


def test_stream_and_table_agree(spark, tmp_path):
    rows = spark.range(600).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("at"), (F.col("id") % 97).cast("int").alias("v"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("k")
    )
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = windowed_results(stream, RULES, "at").writeStream.format("memory").queryName("windowed").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("windowed").distinct().collect()))
    assert got == sorted(map(tuple, windowed_results(rows, RULES, "at").collect())) and len(got) == 2 * 11
    with pytest.raises(ValueError):
        windowed_results(rows, [Rule("u", "k", "unique")], "at")
