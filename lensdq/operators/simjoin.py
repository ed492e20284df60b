"""Exact similarity joins of strings: every pair at or above a threshold, without comparing all pairs.

A string is cut into one segment more than the edits a partner may be away, so an edit leaves at
least one segment whole: the partner holds it, moved by no more places than the other segments
allow. Segments that too many strings share (a common prefix, say) are taken out of both strings
and what is left is cut again, so pairs meet on several segments where one does not tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensdq.functions.similarity import RATIOS
from lensdq.session import checkpointed

#: Pairs under one segment that are compared at once; beyond, the segment is refined or its pairs dealt to cells.
FEW_PAIRS = 10_000


def _reach(ratio: str, share: float) -> tuple[Column, Column]:
    """(shortest partner length, most edits) for a longer string ``lb`` and a shorter one ``la``."""
    if ratio == "levenshtein":
        return F.ceil(F.col("lb") * share - 1e-9), F.floor(F.col("lb") * (1 - share) + 1e-9)
    # Insertions and deletions only: their number is bounded by the summed lengths, and is no less than the edits.
    return F.ceil(F.col("lb") * (share / (2 - share)) - 1e-9), F.floor((F.col("la") + F.col("lb")) * (1 - share) + 1e-9)


def _segment(length: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` when ``length`` characters are cut into ``tau`` + 1 even segments."""
    parts = F.col("tau") + 1
    base = F.floor(length / parts)
    short = parts - length % parts
    return F.col("i") * base + F.greatest(F.lit(0), F.col("i") - short), base + F.when(F.col("i") >= short, 1).otherwise(0)


def _without(rest: Column, start: Column, size: Column) -> Column:
    return F.concat(F.substring(rest, F.lit(1), start), F.substring(rest, start + size + 1, F.length(rest)))


def dealt_join(left: DataFrame, right: DataFrame, key: str, few: int = FEW_PAIRS) -> DataFrame:
    """Inner join on ``key`` in cells of at most about ``few`` pairs, so that no key's pairs land in one task.

    Either side is dealt by hash to as many stripes as its rows need, and copied once per stripe
    of the other side. Columns other than the key must differ.
    """
    side = max(1, int(few**0.5))

    def stripes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias(name))

    sizes = stripes(left, "_l").join(stripes(right, "_r"), key)

    def placed(df: DataFrame, own: str, other: str, own_cell: str, other_cell: str) -> DataFrame:
        mark = F.pmod(F.xxhash64(F.struct(*df.columns)), F.col(own)).cast("int")
        return df.join(sizes, key).select(*df.columns, mark.alias(own_cell), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_cell))

    return placed(left, "_l", "_r", "_i", "_j").join(placed(right, "_r", "_l", "_j", "_i"), [key, "_i", "_j"]).drop("_i", "_j")


def similar_strings(strings: DataFrame, threshold: float, ratio: str = "levenshtein", few: int = FEW_PAIRS) -> DataFrame:
    """(grp, a, b, score): all pairs of different strings of one group whose ratio is at least ``threshold`` (above 0).

    ``strings`` has distinct rows (grp, s, side, meet): a string meets those of its group whose
    ``side`` is its ``meet``; with 0 and 0 the table meets itself, with 0/1 and 1/0 two tables meet.
    Of a pair, ``a`` is the shorter, then the lesser string; two tables may both hold it. Null and
    empty strings match nothing.
    """
    if threshold <= 0:
        raise ValueError("every pair is similar to zero percent")
    share = threshold / 100.0
    least, edits = _reach(ratio, share)
    held = checkpointed(strings.where(F.length("s") > 0).withColumn("sid", F.monotonically_increasing_id()))
    longer = held.withColumn("lb", F.length("s")).withColumn("la", F.explode(F.sequence(least.cast("int"), F.col("lb")))).withColumn("tau", edits.cast("int"))
    chain = F.xxhash64("grp", F.col("side"), "la", "lb")
    shorter = held.withColumn("la", F.length("s")).select("sid", "s", F.xxhash64("grp", "side", "la").alias("home"), "grp", "side", "la")
    wanted = longer.select(F.xxhash64("grp", F.col("meet").alias("side"), "la").alias("home"), "lb", "tau").distinct()
    index = checkpointed(shorter.join(wanted, "home").select(chain.alias("chain"), F.col("sid").alias("sid_a"), F.col("s").alias("rest_a"), "tau"))
    probe = longer.select(F.xxhash64("grp", "meet", "la", "lb").alias("chain"), F.col("sid").alias("sid_b"), F.col("s").alias("rest_b"), "tau", "la", (F.col("lb") - F.col("la")).alias("delta"))
    probe = checkpointed(probe.join(index.select("chain").distinct(), "chain", "left_semi"))
    found = []
    while True:
        start, size = _segment(F.length("rest_a"))
        cut = index.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tau")))).withColumn("start", start.cast("int")).withColumn("size", size.cast("int"))
        cut = cut.select(F.xxhash64("chain", "i", F.substring("rest_a", F.col("start") + 1, F.col("size"))).alias("sig"), "sid_a", _without(F.col("rest_a"), F.col("start"), F.col("size")).alias("rest_a"), "tau")
        start, size = _segment(F.col("la"))
        tried = probe.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tau")))).withColumn("start", start.cast("int")).withColumn("size", size.cast("int"))
        spare = F.col("tau") - F.col("i")
        first, last = F.greatest(-F.col("i"), F.col("delta") - spare, -F.col("start")), F.least(F.col("i"), F.col("delta") + spare, F.length("rest_b") - F.col("size") - F.col("start"))
        tried = tried.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("at", F.explode(F.sequence((F.col("first") + F.col("start")).cast("int"), (F.col("last") + F.col("start")).cast("int"))))
        tried = tried.select(
            F.xxhash64("chain", "i", F.substring("rest_b", F.col("at") + 1, F.col("size"))).alias("sig"), "sid_b", _without(F.col("rest_b"), F.col("at"), F.col("size")).alias("rest_b"),
            "tau", (F.col("la") - F.col("size")).alias("la"), "delta",
        )
        sizes = cut.groupBy("sig").agg(F.count(F.lit(1)).alias("na"), F.any_value("tau").alias("t"), F.any_value(F.length("rest_a")).alias("left")).join(tried.groupBy("sig").agg(F.count(F.lit(1)).alias("nb")), "sig")
        # Cutting again copies every string for each segment and place; it has to be cheaper than the pairs.
        again = (F.col("na") + F.col("nb") * (F.col("t") + 1) / 2.0) * (F.col("t") + 1) * 2
        pairs = F.col("na") * F.col("nb")
        marked = checkpointed(sizes.select("sig", ((F.col("left") > F.col("t")) & (pairs > few) & (pairs > again)).alias("hot")))
        cold, hot = marked.where("not hot").select("sig"), marked.where("hot").select("sig")
        met = dealt_join(cut.join(cold, "sig", "left_semi").select("sig", "sid_a"), tried.join(cold, "sig", "left_semi").select("sig", "sid_b"), "sig", max(few, 1))
        found.append(checkpointed(met.where("sid_a <> sid_b").select(F.least("sid_a", "sid_b").alias("x"), F.greatest("sid_a", "sid_b").alias("y")).distinct()))
        if hot.isEmpty():
            break
        index = checkpointed(cut.join(hot, "sig", "left_semi").select(F.col("sig").alias("chain"), "sid_a", "rest_a", "tau"))
        probe = checkpointed(tried.join(hot, "sig", "left_semi").select(F.col("sig").alias("chain"), "sid_b", "rest_b", "tau", "la", "delta").distinct())
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    one = held.select(F.col("sid").alias("x"), "grp", F.col("s").alias("one"))
    two = held.select(F.col("sid").alias("y"), F.col("s").alias("two"))
    both = every.distinct().join(one, "x").join(two, "y").where(F.col("one") != F.col("two"))
    swap = F.struct(F.length("one"), "one") > F.struct(F.length("two"), "two")
    ordered = both.select("grp", F.when(swap, F.col("two")).otherwise(F.col("one")).alias("a"), F.when(swap, F.col("one")).otherwise(F.col("two")).alias("b")).distinct()
    return ordered.withColumn("score", RATIOS[ratio](F.col("a"), F.col("b"))).where(F.col("score") >= threshold)
