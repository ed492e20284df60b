"""Window results of streams appended to a history, exactly once, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lensdq.functions.columns import clean, percent, quoted

RESULT = "window_start timestamp, rule_id string, total_rows bigint, failing_rows bigint, pass_rate double"


def windowed_completeness(stream: DataFrame, columns: list[str], event_time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, column_name, total_rows, missing_rows, completeness_pct) per event-time window.

    NaN is missing too. The state is one row of counters per open window. Rows without an event
    time belong to no window.
    """
    counted = stream.withWatermark(event_time, late).groupBy(F.window(quoted(event_time), window).alias("w")).agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.count_if(clean(stream, c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]
    )
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_rows")) for i, c in enumerate(columns)])
    rate = percent(F.col("total_rows") - F.col("s.missing_rows"), F.col("total_rows"))
    return counted.select(F.col("w.start").alias("window_start"), "total_rows", F.explode(items).alias("s")).select(
        "window_start", "s.column_name", "total_rows", "s.missing_rows", rate.alias("completeness_pct")
    )


def key_counts(stream: DataFrame, keys: list[str], event_time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, key, n): rows of every key per event-time window; nulls in keys make a null key.

    The state is one counter per open window and key, partitioned by both, so a hot key is one
    number combined before the shuffle. Fold closed windows with ``unique_results``.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & clean(stream, k).isNotNull()
    key = F.when(whole, F.to_json(F.struct(*[clean(stream, k).alias(f"k{i}") for i, k in enumerate(keys)])))
    counted = stream.withWatermark(event_time, late).groupBy(F.window(quoted(event_time), window).alias("w"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "key", "n")


def unique_results(counts: DataFrame, rule_id: str) -> DataFrame:
    """Results of a ``unique`` rule from the key counts of closed windows.

    Every row of a key that stands twice or more in the window fails; rows without a key pass.
    """
    failing = F.sum(F.when(F.col("key").isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(0))
    folded = counts.groupBy("window_start").agg(F.sum("n").alias("total_rows"), failing.alias("failing_rows"))
    rate = percent(F.col("total_rows") - F.col("failing_rows"), F.col("total_rows"))
    return folded.select("window_start", F.lit(rule_id).alias("rule_id"), "total_rows", "failing_rows", rate.alias("pass_rate"))


def append_batch(results: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch of a stream below ``path`` under its number; the same number again replaces it."""
    results.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def record(results: DataFrame, path: str, checkpoint: str, fold=None, once: bool = False) -> StreamingQuery:
    """Append the closed windows of ``results`` to the history at ``path``; starts and returns the query.

    A window comes once, when the watermark has passed its end. ``fold`` turns a batch of closed
    windows into result rows (``unique_results`` for key counts): all keys of a window close in
    one batch. A batch that is run again after a failure has the number it had, and replaces what
    it wrote, so the history holds every window exactly once. ``path`` and ``checkpoint`` belong
    together and lie in storage that all executors share. ``once`` reads what is there and ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(fold(batch) if fold else batch, path, batch_id)

    writer = results.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def history(spark: SparkSession, path: str, schema: str = RESULT) -> DataFrame:
    """The recorded rows with the ``batch_id`` that wrote them."""
    return spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
