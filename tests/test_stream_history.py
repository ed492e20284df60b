"""Stream histories: closed windows once each, batches that run again, unique rules and completeness."""

from pyspark.sql import functions as F

from lensdq.operators.rules import Rule
from lensdq.streaming import windowed_results
from lensdq.streaming.history import append_batch, history, key_counts, record, unique_results, windowed_completeness

START = 1_700_000_000 // 3600 * 3600


def _rows(spark, low, high):
    return spark.range(low, high).select(
        F.timestamp_seconds(F.lit(START) + F.col("id") * 60).alias("at"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 > 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).when(F.col("id") % 2 > 0, F.lit(float("nan"))).alias("v"),
    )


def _stream(spark, path, rows):
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_history_holds_every_closed_window_once(spark, tmp_path):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    rules = [Rule("known", "key", "not_null")]
    first, more = _rows(spark, 0, 300), _rows(spark, 300, 600)
    first.coalesce(1).write.parquet(source)
    results = windowed_results(_stream(spark, source, first), rules, "at", late="30 minutes")
    record(results, out, state, once=True).awaitTermination(120)
    # The newest row is of minute 299: windows that end by minute 269 are closed.
    assert history(spark, out).count() == 4
    more.coalesce(1).write.mode("append").parquet(source)
    record(results, out, state, once=True).awaitTermination(120)
    got = history(spark, out)
    want = windowed_results(first.unionByName(more), rules, "at").where(F.col("window_start") < F.timestamp_seconds(F.lit(START + 9 * 3600)))
    assert sorted(map(tuple, got.drop("batch_id").collect())) == sorted(map(tuple, want.collect())) and got.count() == 9

    # The last commit is lost after its batch was written: the batch runs again and changes nothing.
    before = sorted(map(tuple, got.collect()))
    commits = sorted((p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    record(results, out, state, once=True).awaitTermination(120)
    assert sorted(map(tuple, history(spark, out).collect())) == before


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([(None, "r", 2, 1, 50.0)], "window_start timestamp, rule_id string, total_rows bigint, failing_rows bigint, pass_rate double")
    for batch in (3, 3, 4):
        append_batch(rows, f"{tmp_path}/h", batch)
    assert sorted(r["batch_id"] for r in history(spark, f"{tmp_path}/h").collect()) == [3, 4]


def test_unique_rule_and_completeness_of_windows(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows = _rows(spark, 0, 600)
    # One file after the other, so that no row is later than its stream allows.
    for low in (0, 200, 400):
        _rows(spark, low, low + 200).coalesce(1).write.mode("append").parquet(source)
    counts = key_counts(_stream(spark, source, rows), ["key"], "at", late="10 hours")
    record(counts, f"{tmp_path}/u", f"{tmp_path}/us", fold=lambda b: unique_results(b, "one"), once=True).awaitTermination(120)
    # Ten hours of delay leave all windows open but none of them ended before the first row.
    assert history(spark, f"{tmp_path}/u").count() == 0

    want = {}
    for r in rows.collect():
        want.setdefault(int(r["at"].timestamp()) // 3600, []).append((r["key"], r["v"]))
    table = unique_results(key_counts(rows, ["key"], "at"), "one").collect()
    assert len(table) == len(want) == 10
    for r in table:
        keys = [k for k, _ in want[int(r["window_start"].timestamp()) // 3600]]
        failing = sum(k is not None and keys.count(k) > 1 for k in keys)
        assert (r["total_rows"], r["failing_rows"]) == (len(keys), failing)
    for r in windowed_completeness(rows, ["key", "v"], "at").collect():
        at = ["key", "v"].index(r["column_name"])
        values = [x[at] for x in want[int(r["window_start"].timestamp()) // 3600]]
        assert r["missing_rows"] == sum(x is None or x != x for x in values) and r["total_rows"] == len(values)
    closing = key_counts(_stream(spark, source, rows), ["key"], "at", late="1 minute")
    record(closing, f"{tmp_path}/c", f"{tmp_path}/cs", fold=lambda b: unique_results(b, "one"), once=True).awaitTermination(120)
    got = {r["window_start"]: (r["total_rows"], r["failing_rows"]) for r in history(spark, f"{tmp_path}/c").collect()}
    assert got == {r["window_start"]: (r["total_rows"], r["failing_rows"]) for r in table if r["window_start"].timestamp() < START + 9 * 3600}
