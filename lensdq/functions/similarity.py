"""Text similarity as Columns, plus one Arrow function for subsequence-based ratios."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def token_sorted(col: Column) -> Column:
    """Whitespace tokens in sorted order, joined by one blank."""
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(col), r"\s+"), lambda t: t != "")), " ")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """0-100: one minus edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, (1 - F.levenshtein(a, b) / longest) * 100).otherwise(100.0)


def indel_ratio(a: Column, b: Column) -> Column:
    """0-100: twice the longest common subsequence over the summed lengths."""

    # Nested so that it travels by value and executors need no copy of this package.
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            if x is None or y is None:
                out.append(None)
                continue
            row = [0] * (len(y) + 1)
            for ch in x:
                diagonal = 0
                for j, other in enumerate(y, 1):
                    diagonal, row[j] = row[j], diagonal + 1 if ch == other else max(row[j], row[j - 1])
            size = len(x) + len(y)
            out.append(200.0 * row[-1] / size if size else 100.0)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(ratio, "double")(a, b)


RATIOS = {"levenshtein": levenshtein_ratio, "indel": indel_ratio}


def normalised_name(col: Column) -> Column:
    """Lower-case name without blanks, underscores, hyphens and dots."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s_\-\.]+", "")
