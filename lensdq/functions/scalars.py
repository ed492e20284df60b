"""Calculated-field functions as Columns, under their business-intelligence names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radius of the earth per unit.
EARTH_RADIUS = {"km": 6371.0, "mi": 3959.0}


def divide(a: Column, b: Column, alternative: float = 0.0) -> Column:
    """a / b, or the alternative when b is zero."""
    return F.when(b == 0, F.lit(float(alternative))).otherwise(a / F.nullif(b, F.lit(0)))


def zn(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def ifnull(col: Column, replacement) -> Column:
    return F.coalesce(col, replacement if isinstance(replacement, Column) else F.lit(replacement))


def iif(condition: Column, then: Column, otherwise: Column, unknown: Column | None = None) -> Column:
    """Three-way choice: true, false, and null conditions."""
    out = F.when(condition, then).when(~condition, otherwise)
    return out if unknown is None else F.coalesce(out, F.when(condition.isNull(), unknown))


def switch(value: Column, cases: list[tuple[object, Column]], default: Column | None = None) -> Column:
    out = default if default is not None else F.lit(None)
    for match, result in reversed(cases):
        out = F.when(value == match, result).otherwise(out)
    return out


def left(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def right(col: Column, n: int) -> Column:
    return F.when(F.length(col) <= n, col).otherwise(F.substring(col, -n, n))


def mid(col: Column, start: int, length: int = 1) -> Column:
    return F.substring(col, start, length)


def contains_text(col: Column, part: str) -> Column:
    """Case-insensitive contains; null never contains anything."""
    return F.coalesce(F.lower(col).contains(part.lower()), F.lit(False))


def find(col: Column, part: str) -> Column:
    return F.instr(col, part)


def split_part(col: Column, delimiter: str, token: int) -> Column:
    return F.split_part(col, F.lit(delimiter), F.lit(token))


def space(n: int) -> Column:
    return F.repeat(F.lit(" "), n)


def log_base(col: Column, base: float = 10.0) -> Column:
    return F.log(float(base), col)


def integer_division(a: Column, b: Column) -> Column:
    return F.floor(F.abs(a) / F.abs(F.nullif(b, F.lit(0)))) * F.signum(a).cast("bigint") * F.signum(b).cast("bigint")


def date_part(unit: str, col: Column) -> Column:
    return {
        "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "week": F.weekofyear,
        "weekday": F.dayofweek, "hour": F.hour, "minute": F.minute, "second": F.second,
    }[unit](col)


def date_trunc(unit: str, col: Column) -> Column:
    return F.date_trunc(unit, col)


def date_add(unit: str, n: int, col: Column) -> Column:
    months = {"month": 1, "quarter": 3, "year": 12}
    if unit in months:
        return F.add_months(col, n * months[unit])
    return F.date_add(col, n * {"day": 1, "week": 7}[unit])


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Number of unit borders between two dates."""
    if unit in ("year", "month", "quarter"):
        months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
        if unit == "month":
            return months
        if unit == "year":
            return F.year(end) - F.year(start)
        return (F.year(end) - F.year(start)) * 4 + F.quarter(end) - F.quarter(start)
    days = F.datediff(end, start)
    return days if unit == "day" else F.floor(days / 7)


def date_name(unit: str, col: Column) -> Column:
    return F.date_format(col, {"month": "MMMM", "weekday": "EEEE", "year": "yyyy", "day": "d"}[unit])


def make_date(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year, month, day)


def make_datetime(date: Column, time: Column) -> Column:
    return F.to_timestamp(F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), F.date_format(time, "HH:mm:ss")))


def is_date(col: Column) -> Column:
    return col.try_cast("timestamp").isNotNull()


def to_int(col: Column) -> Column:
    """Whole part towards zero; null for text that is no number."""
    return col.try_cast("double").try_cast("bigint")


def to_float(col: Column) -> Column:
    return col.try_cast("double")


def to_text(col: Column) -> Column:
    return col.cast("string")


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "km") -> Column:
    """Great-circle distance by the spherical law of cosines."""
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2) - F.radians(lon1))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) * EARTH_RADIUS[unit]


def display_number(v: Column) -> Column:
    """$1.2M, $34.5K, 1,234, 12.3% or 9.87, by size."""
    a = F.abs(v)
    return (
        F.when(a >= 1e6, F.concat(F.lit("$"), F.format_number(v / 1e6, 1), F.lit("M")))
        .when(a >= 1e4, F.concat(F.lit("$"), F.format_number(v / 1e3, 1), F.lit("K")))
        .when(a >= 100, F.format_number(v, 0))
        .when((a > 0) & (a < 1), F.concat(F.format_number(v * 100, 1), F.lit("%")))
        .otherwise(F.format_number(v, 2))
    )
