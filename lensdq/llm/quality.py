"""Quality rules whose cutoffs are certified on labelled documents: limited false rejection in every stratum."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensdq.llm.common import WordHashes, saved, shingle_hashes

#: Rules (a high score is bad) and their cutoffs from lax to strict, as many for each, fixed before any label is seen.
RULES: dict[str, list[float]] = {
    "symbol_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02],
    "dup_line_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_word_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.075, 0.05],
    "word_length": [60.0, 50.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0],
}


def measure(df: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, n_lines, word_chars, n_symbols, n_dup_lines, n_repeat_words) of whole texts.

    Words are cut at ASCII white space. Null texts have no words. ``n_lines`` counts lines with a word.
    """
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col(text).cast("string").cast("binary").alias("text"))
    counts = ["n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hashes = WordHashes()
        for batch in batches:
            out = []
            for value in batch.column(2):
                raw = value.as_py() or b""
                words = raw.split()
                lines = [line for line in raw.split(b"\n") if line.strip()]
                chars = len(raw.decode("utf-8", "replace")) - sum(raw.count(w) for w in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
                repeated = 0
                if len(words) >= 5:
                    _, which, times = np.unique(shingle_hashes(words, hashes), return_inverse=True, return_counts=True)
                    at = np.flatnonzero(times[which] > 1)
                    edges = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + 5, minlength=len(words) + 1)
                    repeated = int(np.count_nonzero(np.cumsum(edges)))
                out.append((len(words), len(lines), chars, sum(raw.count(bytes([c])) for c in b"#*$%&|<>"), len(lines) - len(set(lines)), repeated))
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array([o[i] for o in out], pa.int64()) for i in range(6)]], ["doc_id", "stratum", *counts])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{c} bigint" for c in counts)).withColumnRenamed("doc_id", doc_id)


def scores() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return {
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), by the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1.0, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    if x >= (a + 1) / (a + b + 2):
        return 1.0 - front * _fraction(b, a, p) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-13:
            break
    return h


def certified_step(good: list[int], bad: list[int], n: int, risk: float, level: float) -> int:
    """The step to use, 0 for none, of rejections that grow from step to step.

    ``good`` and ``bad`` count the holdout documents rejected at each step, ``n`` the good ones in
    all. Steps are tested in order until the exact binomial test that more than ``risk`` of the
    good documents are rejected can no longer be refuted at ``level``. Of the steps before, the
    first that rejects the most bad documents is taken, none if none is rejected.
    """
    most = 0
    for at, k in enumerate(good):
        # Above the expected number the bound exceeds the risk anyway.
        if k > n * risk or binomial_tail(int(k), int(n), risk) > level:
            break
        most = at + 1
    return 1 + list(bad).index(bad[most - 1]) if most and bad[most - 1] > 0 else 0


def certified_cutoffs(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", risk: float = 0.01, confidence: float = 0.95) -> DataFrame:
    """(stratum, rule, cutoff): from which score on a rule rejects documents of a stratum.

    All labelled documents are the holdout; the cutoffs to test are fixed in ``RULES``. Step i
    rejects what any rule rejects at its i-th cutoff, so the rules are tested together and share
    one bound: a step is certified if the exact binomial (Clopper-Pearson) upper bound on the
    share of good documents it rejects is at most ``risk``. The error level 1 - ``confidence`` is
    divided by the strata (Bonferroni); within a stratum steps are tested from lax to strict until
    the first fails, which needs no further correction. So with ``confidence``, in no stratum more
    than ``risk`` of the good documents are rejected. Of the certified steps the laxest that
    rejects the most bad documents is taken, with those of its rules that reject any; a part of a
    certified step rejects no more than the whole. Several labels of one document count as bad if
    any is; null labels take no part.
    """
    known = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_d")).agg((F.min(quality) > 0).alias("good"))
    joined = measured.join(known, F.col(doc_id) == F.col("_d"))
    reached = joined.select("stratum", "good", *[_passed(s, RULES[r]).alias(r) for r, s in scores().items()])
    # A row per stratum, label and set of cutoffs reached, whatever the number of labels.
    per = saved(reached.groupBy("stratum", "good", *RULES).agg(F.count(F.lit(1)).alias("n")), "labelled")
    strata = max(1, per.select("stratum").distinct().count())
    level = (1 - confidence) / strata
    steps = len(next(iter(RULES.values())))

    # A score that reaches ``steps`` + 1 - i of the cutoffs reaches the i-th, as they descend.
    def rejected(score: Column, which: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(which & (score >= steps + 1 - at), F.col("n"))), F.lit(0)) for at in range(1, steps + 1)])

    @F.pandas_udf("int")
    def step(good: pd.Series, bad: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([certified_step(list(g), list(b), k, risk, level) for g, b, k in zip(good, bad, n, strict=True)])

    is_good, any_rule = F.col("good"), F.greatest(*RULES)
    of_rules = F.array(*[F.struct(F.lit(r).alias("rule"), rejected(F.col(r), ~is_good).alias("bad"), F.array(*map(F.lit, RULES[r])).alias("cutoffs")) for r in RULES])
    facts = per.groupBy("stratum").agg(rejected(any_rule, is_good).alias("good"), rejected(any_rule, ~is_good).alias("bad"), F.coalesce(F.sum(F.when(is_good, F.col("n"))), F.lit(0)).alias("n"), of_rules.alias("rules"))
    chosen = facts.withColumn("step", step("good", "bad", "n")).where("step > 0").select("stratum", "step", F.explode("rules").alias("r"))
    return chosen.where("element_at(r.bad, step) > 0").select("stratum", "r.rule", F.expr("element_at(r.cutoffs, step)").alias("cutoff"))


def _passed(score: Column, cutoffs: list[float]) -> Column:
    return sum((F.when(score >= c, 1).otherwise(0) for c in cutoffs), F.lit(0))


def judge(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", **certified) -> DataFrame:
    """The measures of every row with base_failed, rejected_by array<string> and kept.

    ``base_failed``: fewer than 10 words, or over 20% of words in repeated five-word windows.
    Others are rejected by the rules certified for their stratum (a null stratum is one of its
    own). Without labels, or with too few to certify anything, no rule rejects. Rows that repeat
    an id are judged each for itself; an empty table gives an empty result.
    """
    measured = saved(measure(df, doc_id, text, stratum), "measured")
    cutoffs = certified_cutoffs(measured, labels, doc_id, **certified)
    wide = cutoffs.groupBy(F.col("stratum").alias("_s")).pivot("rule", list(RULES)).agg(F.first("cutoff"))
    wide = wide.select("_s", *[F.col(r).alias(f"_c_{r}") for r in RULES])
    joined = measured.join(wide, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    by = F.array_compact(F.array(*[F.when(s >= F.col(f"_c_{r}"), r) for r, s in scores().items()]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select(*measured.columns, failed.alias("base_failed"), by.alias("rejected_by")).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
