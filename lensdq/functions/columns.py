"""Column kinds and null-safe column access shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*FLOATING, *INTEGRAL, T.DecimalType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def columns_of(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, is_numeric)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, lambda t: isinstance(t, T.StringType))


def temporal_columns(df: DataFrame) -> list[str]:
    return columns_of(df, is_temporal)


def boolean_columns(df: DataFrame) -> list[str]:
    return columns_of(df, lambda t: isinstance(t, T.BooleanType))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN folded into null, as every metric here treats both alike."""
    col = F.col(quoted(name))
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.when(~F.isnan(col), col)
    return col


def as_double(df: DataFrame, name: str) -> Column:
    return clean(df, name).cast("double")


def as_text(df: DataFrame, name: str) -> Column:
    """A canonical text form used as a grouping key; -0.0 and 0.0 share one key."""
    dtype = df.schema[name].dataType
    col = clean(df, name)
    if isinstance(dtype, FLOATING):
        col = col + F.lit(0.0)
    if is_numeric(dtype) or isinstance(dtype, (T.StringType, T.BooleanType)) or is_temporal(dtype):
        return col.cast("string")
    return F.to_json(col)


def type_label(dtype: T.DataType) -> str:
    return dtype.simpleString()


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a share of ``whole`` in percent; 0 when there is nothing to divide by."""
    value = part.cast("double") * 100.0 / F.when(whole != 0, whole)
    return F.coalesce(F.round(value, digits), F.lit(0.0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def banded(value: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower bound ``value`` reaches."""
    out = F.lit(otherwise)
    for bound, label in reversed(bands):
        out = F.when(value >= bound, label).otherwise(out)
    return F.when(value.isNotNull(), out)



def side_by_side(*frames: DataFrame) -> DataFrame:
    """Several one-row frames as one row, without joining them: each column is taken from the frame that has it."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(F.col(quoted(c))).alias(c) for c in stacked.columns])


def merged_by(key: str, *frames: DataFrame) -> DataFrame:
    """Small frames with one row per key, merged on it by grouping; columns a key lacks are null."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.groupBy(key).agg(*[F.max(F.col(quoted(c))).alias(c) for c in stacked.columns if c != key])
