"""Row-level rules over event-time windows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensdq.functions.columns import percent, quoted
from lensdq.operators.rules import Rule, fails


def windowed_results(stream: DataFrame, rules: list[Rule], event_time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, rule_id, total_rows, failing_rows, pass_rate) per event-time window.

    Rows may be up to ``late`` behind the newest one; the state is one row of counters per open
    window. Works on streams and tables alike. Rules that need all rows of a table (``unique``,
    ``referential``) are refused, as a stream never has them.
    """
    if any(r.rule_type in ("unique", "referential") for r in rules):
        raise ValueError("unique and referential rules need a whole table")
    counted = stream.withWatermark(event_time, late).groupBy(F.window(quoted(event_time), window).alias("w")).agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.count_if(fails(stream, r)).alias(f"f{i}") for i, r in enumerate(rules)]
    )
    items = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.col(f"f{i}").alias("failing_rows")) for i, r in enumerate(rules)])
    rate = percent(F.col("total_rows") - F.col("s.failing_rows"), F.col("total_rows"))
    return counted.select(F.col("w.start").alias("window_start"), "total_rows", F.explode(items).alias("s")).select(
        "window_start", "s.rule_id", "total_rows", "s.failing_rows", rate.alias("pass_rate")
    )
