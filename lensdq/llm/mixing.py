"""Mixing sources to target weights: water-filled targets, length histograms, subset-sum fitting, seeded choice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensdq.llm.common import fresh, saved, split_ranks, unit_hash, word_count

#: Largest number of times a document is taken.
REPEATS = 3
#: Longest documents' worth of words that are left to the exact fit.
RESERVE = 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of the total by weight.

    Sources in code point order, null last, get ``weights`` in turn. A target stops at ``repeats``
    times its source's size and the excess goes to the others by weight. Sorted by size per
    weight, the first sources stop; the level of the rest follows from what those leave. The
    windows run over one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(int(w)) for w in weights])
    weighed = sizes.withColumn("w", F.element_at(turn, (place % len(weights) + 1).cast("int")).cast("bigint"))
    cap = F.col("source_size") * repeats
    rows = weighed.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    others = F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = rows.withColumn("left", left).withColumn("others", others).withColumn("level", F.col("left") / F.col("others"))
    final = F.max_by(F.struct("left", "others"), "level").over(all_rows)
    share = F.col("final.left") * F.col("w") / F.col("final.others")
    return level.withColumn("final", final).select("source", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def fill_budget(budget: int, lengths: list[int], counts: list[int]) -> dict[int, int]:
    """How many of each length to take so that their sum comes as near ``budget`` from below as any choice can.

    Bounded knapsack on a bit set of reachable sums; counts are split into powers of two.
    """
    reach, mask, stages = 1, (1 << (budget + 1)) - 1, []
    for length, count in sorted(zip(lengths, counts, strict=True), reverse=True):
        if length <= 0 or length > budget:
            continue
        left, piece = min(count, budget // length), 1
        while left > 0 and not reach >> budget & 1:
            n = min(piece, left)
            more = (reach << (length * n)) & mask & ~reach
            if more:
                stages.append((length, n, reach))
                reach |= more
            left -= n
            piece *= 2
    at, taken = reach.bit_length() - 1, {}
    for length, n, earlier in reversed(stages):
        if not earlier >> at & 1:
            taken[length] = taken.get(length, 0) + n
            at -= length * n
    return taken


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.copy()
    extra = fill_budget(int(rows["rest"].iloc[0]), rows["size"].tolist(), (rows["n"] - rows["pick"]).tolist())
    rows["pick"] += rows["size"].map(lambda s: extra.get(s, 0))
    return rows[["source", "size", "passes", "pick", "source_size", "target"]]


def mix(df: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often each row is taken.

    ``size`` is a row's number of words, 0 for null. A source is taken whole as often as its
    target holds it. Of the remaining budget, but for the words of the ``RESERVE`` longest
    documents, every length gets its share (cumulative rounding from the longest down leaves at
    most one longest document), and bounded-knapsack dynamic programming fits the rest with what
    is still free. The histogram of one source has a row per distinct length, and the fit is over
    at most ``RESERVE`` + 1 longest documents, whatever the number of documents. Rows of one length are chosen by the rank of a seeded hash of their
    id. Rows without words come once per whole pass. Rows that repeat an
    id are counted and chosen each for itself; null sources are one source; null ids hash alike.
    An empty table gives an empty result.
    """
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size"))
    rows = saved(slim.withColumn("hash", unit_hash(seed, F.col("doc_id").cast("string"))), "mix")
    lengths = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    goal = targets(lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights)

    hist = lengths.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.when(F.col("source_size") > 0, F.round(F.col("target") - F.col("passes") * F.col("source_size"))).otherwise(0).cast("bigint")
    # The fit gets the words of a few of the longest documents, so that it has enough to choose from.
    reserve = F.least(F.col("budget"), F.lit(RESERVE) * F.max("size").over(Window.partitionBy("source")))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    upto = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))
    share = "CASE WHEN source_size > 0 THEN CAST(CAST(budget - reserve AS DECIMAL(19,0)) * CAST(upto AS DECIMAL(18,0)) DIV CAST(source_size AS DECIMAL(19,0)) AS BIGINT) ELSE 0 END"
    # upto counts documents, the budget counts words: the share taken is (budget - reserve) / source_size.
    shares = hist.withColumn("passes", passes).withColumn("budget", budget).withColumn("reserve", reserve).withColumn("upto", upto).withColumn("share", F.expr(share))
    picks = shares.withColumn("pick", F.col("share") - F.coalesce(F.lag("share").over(down), F.lit(0)))
    rest = F.col("budget") - F.sum(F.col("pick") * F.col("size")).over(Window.partitionBy("source"))
    fitted = picks.withColumn("rest", rest).select("source", "size", "n", "passes", "pick", "rest", "source_size", "target")
    quota = saved(fitted.groupBy("source").applyInPandas(_fill, "source string, size bigint, passes bigint, pick bigint, source_size bigint, target double"), "quota")

    ranked = split_ranks(rows, ["source", "size"], "hash", ["doc_id"], "place")
    q = quota.withColumnsRenamed({"source": "s", "size": "z"})
    chosen = ranked.join(q, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    copies = F.col("passes") + F.when((F.col("place") < F.col("pick")) & (F.col("size") > 0), 1).otherwise(0)
    return chosen.select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mixed(df: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The rows of ``df`` as the mix takes them, repeated ones several times.

    Rows alike in id, source and size share the copies that were found for them together. The
    columns stay as they are, whatever their names.
    """
    every, rows, d, s, z, size, place, own, copy = fresh(df, "_all", "_rows", "_d", "_s", "_z", "_size", "_place", "_own", "_copy")
    plan = mix(df, source, text, doc_id, weights, seed).select(F.col(doc_id).alias(d), F.col(source).alias(s), F.col("size").alias(z), "copies")
    found = plan.groupBy(d, s, z).agg(F.sum("copies").alias(every), F.count(F.lit(1)).alias(rows)).where(F.col(every) > 0)
    sized = df.withColumn(size, word_count(F.col(text).cast("string")))
    joined = sized.join(found, sized[doc_id].eqNullSafe(F.col(d)) & sized[source].cast("string").eqNullSafe(F.col(s)) & (F.col(size) == F.col(z)))
    nth = F.row_number().over(Window.partitionBy(d, s, z).orderBy(F.lit(0)))
    # Whole shares first, the remainder to the first rows.
    share = F.floor((F.col(every) + F.col(rows) - F.col(place)) / F.col(rows)).cast("int")
    shared = joined.withColumn(place, F.when(F.col(rows) > 1, nth).otherwise(1)).withColumn(own, share).where(F.col(own) > 0)
    return shared.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own)))).select(*[shared[c] for c in df.columns])
