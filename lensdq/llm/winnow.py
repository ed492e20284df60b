"""Benchmark passages in training texts, by winnowed fingerprints.

Every window of ten words is told by the least hash among its five-word grams. Equal windows have
equal grams, hence the same least hash: joining the fingerprints of texts and benchmark items
meets every shared window, and runs of windows with one fingerprint need one row. Windows met
that way are compared word by word, and the hits extended to the words they cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensdq.llm.common import bounded_join, saved

#: Words of a lowered text: ASCII letters and digits, and everything beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 5
#: Fingerprints, windows or results of up to this many rows, about 60 bytes each, are broadcast; more are joined by shuffle.
FEW_ROWS = 300_000


def lowered(text: Column) -> Column:
    return F.translate(text.cast("string"), UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(lowered(text), F.lit("")), F.lit(ITEM_WORD), F.lit(0))


def _upto(size: Column, make) -> Column:
    """``make(i)`` for i in 0..size - 1."""
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), make)).otherwise(F.array())


def _least_hashes(words: str, width: int) -> Column:
    """For every window of ``width`` words the least hash of its grams: the name of a column of word hashes goes in."""
    gram = min(GRAM, width)
    hashes = F.col(words)
    grams = _upto(F.size(hashes) - (gram - 1), lambda i: F.xxhash64(F.lit(gram), *[F.get(hashes, i + j) for j in range(gram)]))
    if width == gram:
        return grams
    return F.transform(F.array(grams), lambda g: _upto(F.size(g) - (width - gram), lambda i: F.least(*[F.get(g, i + j) for j in range(width - gram + 1)])))[0]


def _runs(least: Column, width: int) -> Column:
    """Runs of windows with one fingerprint: (width, first window, last window, fingerprint)."""
    starts = F.filter(_upto(F.size(least), lambda i: i), lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1)))
    return F.transform(F.array(starts), lambda s: F.transform(s, lambda at, k: F.struct(
        F.lit(width).alias("width"), at.alias("first"), (F.coalesce(F.get(s, k + 1), F.size(least)) - 1).alias("last"), F.get(least, at).alias("print"),
    )))[0]


def _digest(text: Column) -> list[Column]:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(1), whole).alias("d1"), F.xxhash64(F.lit(2), whole).alias("d2")]


def benchmark_windows(items: DataFrame, width: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, width, window, print): every window of every item, its words joined by one space, and its fingerprint.

    An item of fewer than ``width`` words is one window of its own width. Items with equal ids
    are one item; a null id is written as an empty string; items without words have no window.
    """
    cut = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    held = saved(cut.withColumn("n", F.least(F.size("w"), F.lit(width))).distinct(), "items")
    widths = [r["n"] for r in held.select("n").distinct().collect()]  # at most ``width`` of them
    out = None
    for n in widths:
        hashed = held.where(F.col("n") == n).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
        least = hashed.withColumn("m", _least_hashes("h", n))
        each = F.transform("m", lambda p, i: F.struct(F.lit(n).alias("width"), F.array_join(F.slice("w", i + 1, F.lit(n)), " ").alias("window"), p.alias("print")))
        part = least.select("item", F.explode(each).alias("x")).select("item", "x.*").distinct()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return items.sparkSession.createDataFrame([], "item string, width int, window string, print bigint")
    return saved(out, "benchmark")


def contamination(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, spans array<struct<start, stop>>, items array<string>) of every row of ``docs``.

    ``windows`` come from ``benchmark_windows``. A word inside any occurrence of a window is hit;
    ``spans`` are the stretches of hit words (stop exclusive), ``items`` the sorted ids of items
    with an occurring window. Every shared window is found: equal windows have equal grams and so
    the same fingerprint, at every length. Equal texts are worked on by digest and count once in
    joins; texts, windows and results meet by broadcast up to ``FEW_ROWS`` counted rows and by
    shuffle beyond, where Spark splits hot keys.

    Null, empty and wordless texts have no words, hits or items. Repeated rows and null ids keep
    their rows; other columns are not read; without items nothing is hit.
    """
    texts = docs.select(*_digest(F.col(text)), F.col(text).cast("string").alias("text"))
    widths = [r["width"] for r in windows.select("width").distinct().collect()]  # at most the window width of them
    rows = docs.select(F.col(doc_id).alias("doc_id"), *_digest(F.col(text)), F.coalesce(F.regexp_count(lowered(F.col(text)), F.lit(ITEM_WORD)), F.lit(0)).cast("bigint").alias("n_words"))
    nothing = F.array().cast("array<struct<start:bigint,stop:bigint>>"), F.array().cast("array<string>")
    if not widths:
        return rows.select(F.col("doc_id").alias(doc_id), "n_words", F.lit(0).cast("bigint").alias("n_hit"), nothing[0].alias("spans"), nothing[1].alias("items"))

    prints = saved(windows.select("width", "print").distinct(), "prints")
    few = prints.count()
    hashed = texts.select("d1", "d2", F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    least = hashed.select("d1", "d2", *[_least_hashes("h", n).alias(f"m{n}") for n in widths])
    found = least.select("d1", "d2", F.explode(F.concat(*[_runs(F.col(f"m{n}"), n) for n in widths])).alias("r")).select("d1", "d2", "r.*")
    met = bounded_join(found, prints, ["width", "print"], few, FEW_ROWS)
    places = saved(met.groupBy("d1", "d2").agg(F.collect_set(F.struct("width", "first", "last")).alias("places")), "places")

    again = bounded_join(texts, places, ["d1", "d2"], places.count(), FEW_ROWS).select("d1", "d2", "places", words_of(F.col("text")).alias("w"))
    every = F.flatten(F.transform("places", lambda p: F.transform(F.sequence(p["first"], p["last"]), lambda at: F.struct(p["width"].alias("width"), at.alias("start"), F.array_join(F.slice("w", at + 1, p["width"]), " ").alias("window")))))
    candidates = again.select("d1", "d2", F.explode(every).alias("x")).select("d1", "d2", "x.*")
    kinds = saved(windows.groupBy("width", "window").agg(F.count(F.lit(1)).alias("n")).select(F.monotonically_increasing_id().alias("kind"), "width", "window"), "windows")
    hits = saved(bounded_join(candidates, kinds, ["width", "window"], kinds.count(), FEW_ROWS).select("d1", "d2", "start", "width", "kind").distinct(), "hits")

    stretches = hits.select("d1", "d2", F.col("start").cast("bigint").alias("start"), (F.col("start") + F.col("width")).cast("bigint").alias("stop")).distinct()
    in_text = Window.partitionBy("d1", "d2").orderBy("start", "stop")
    before = F.max("stop").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    opened = stretches.withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("span", F.sum("opens").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = opened.groupBy("d1", "d2", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    covered = spans.groupBy("d1", "d2").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    by_item = windows.join(kinds, ["width", "window"]).select("kind", "item")
    named = hits.select("d1", "d2", "kind").distinct().join(by_item, "kind").groupBy("d1", "d2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    results = saved(covered.join(named, ["d1", "d2"]), "results")
    whole = bounded_join(rows, results, ["d1", "d2"], results.count(), FEW_ROWS, "left")
    return whole.select(F.col("doc_id").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("spans", nothing[0]).alias("spans"), F.coalesce("items", nothing[1]).alias("items"))
