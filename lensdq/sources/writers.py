"""Sinks for tables and results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensdq.functions.columns import quoted
from lensdq.session import ensure_checkpoint_dir


#: Text formats keep timestamps to the microsecond, as readers give them back.
STAMPS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",") -> str:
    df.write.mode(mode).options(**STAMPS).option("header", True).option("sep", sep).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).options(**STAMPS).json(path)
    return path


def write_xml(df: DataFrame, path: str, row_tag: str = "row", mode: str = "errorifexists") -> str:
    df.write.mode(mode).options(**STAMPS).option("rowTag", row_tag).xml(path)
    return path


def write_fixed_width(df: DataFrame, path: str, fields: list[tuple[str, int, int]], mode: str = "errorifexists") -> str:
    """Lines with every column's text at its declared (name, start, width); longer text is refused, not cut."""
    ends = [start + width for _, start, width in fields]
    if any(start < end for (_, start, _), end in zip(fields[1:], ends)):
        raise ValueError("columns overlap or are out of order")
    cells, at = [], 1
    for name, start, width in fields:
        text = F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))
        fits = F.when(F.length(text) <= width, text).otherwise(F.raise_error(F.concat(F.lit(f"column {name} is wider than {width}: "), text)))
        cells += [F.lit(" " * (start - at)), F.rpad(fits, width, " ")]
        at = start + width
    df.select(F.concat(*cells).alias("value")).write.mode(mode).text(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] = ()) -> str:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh location next to the checkpoints, that is in the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}/{name}"
