"""Entity resolution inside blocks, and clusters of matched records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensdq.functions.columns import any_of, quoted
from lensdq.functions.similarity import RATIOS, token_sorted
from lensdq.operators.longform import chunked, ordered_prefix
from lensdq.operators.simjoin import dealt_join, similar_strings
from lensdq.session import checkpointed


#: Links up to this number have their minima broadcast, more are joined by shuffle.
FEW_LINKS = 100_000


def duplicate_pairs(
    df: DataFrame, record_id: str, keys: list[str], threshold: float = 85.0, reach: int = 9, ratio: str = "levenshtein",
    chunk: int = 50_000,
) -> DataFrame:
    """Likely duplicates: (id_a, id_b, score, matched_on).

    Records are blocked on the first three letters of the first key and each is compared with
    the next ``reach`` records of its block in id order. Blocks are laid out in one global
    (block, id) order cut into equal chunks, so a block holding most rows is spread over tasks.
    """
    block = F.lower(F.substring(F.coalesce(F.col(quoted(keys[0])).cast("string"), F.lit("")), 1, 3))
    slim = df.select(
        F.col(quoted(record_id)).alias("id"),
        block.alias("block"),
        *[token_sorted(F.coalesce(F.col(quoted(k)).cast("string"), F.lit(""))).alias(f"k{i}") for i, k in enumerate(keys)],
    )
    ordered = ordered_prefix(slim, [F.col("block"), F.col("id")])
    fields = ["id", "block", *[f"k{i}" for i in range(len(keys))]]
    spread, w = chunked(ordered, after=reach, chunk=chunk)
    ahead = F.collect_list(F.struct(*fields)).over(w.rowsBetween(1, reach))
    near = spread.withColumn("ahead", ahead).where("own")
    pairs = near.withColumn("o", F.explode("ahead")).where(F.col("o.block") == F.col("block"))
    similarity = RATIOS[ratio]
    scores = [
        F.when((F.col(f"k{i}") != "") & (F.col(f"o.k{i}") != ""), similarity(F.col(f"k{i}"), F.col(f"o.k{i}")))
        for i in range(len(keys))
    ]
    scored = pairs.select(
        F.col("id").alias("id_a"), F.col("o.id").alias("id_b"), *[s.alias(f"s{i}") for i, s in enumerate(scores)]
    )
    used = [F.col(f"s{i}") for i in range(len(keys))]
    total = sum((F.coalesce(s, F.lit(0.0)) for s in used), F.lit(0.0))
    number = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in used), F.lit(0))
    mean = F.when(number > 0, total / number)
    hits = F.array_compact(F.array(*[F.when(F.col(f"s{i}") >= threshold, k) for i, k in enumerate(keys)]))
    return scored.where(mean >= threshold).select(
        "id_a", "id_b", F.round(mean, 1).alias("score"), F.array_join(hits, ",").alias("matched_on")
    )


def all_duplicates(df: DataFrame, record_id: str, keys: list[str], threshold: float = 85.0, ratio: str = "levenshtein") -> tuple[DataFrame, DataFrame]:
    """Complete duplicates: members (id, class_id) and pairs (id_a, id_b, score, matched_on) of classes.

    Blocks and scores are those of ``duplicate_pairs``, but every pair of a block counts, however
    far apart. Records of a block with equal token-sorted keys form a class named by the smallest
    id, so copies cost one row each; records without any key text are in no class. A mean of
    ``threshold`` needs one key at or above it: the keys' distinct strings are joined exactly by
    similarity, and classes meet on the strings of such a key in cells of bounded size. With
    several keys, classes agreeing on a key of few values all meet there, unless the lengths of
    their other keys already rule the mean out. A null id takes no part.
    """
    block = F.lower(F.substring(F.coalesce(F.col(quoted(keys[0])).cast("string"), F.lit("")), 1, 3))
    names = [f"k{i}" for i in range(len(keys))]
    slim = df.select(
        F.col(quoted(record_id)).alias("id"), block.alias("block"),
        *[token_sorted(F.coalesce(F.col(quoted(k)).cast("string"), F.lit(""))).alias(n) for n, k in zip(names, keys)],
    ).where(F.col("id").isNotNull() & any_of([F.col(n) != "" for n in names]))
    classes = checkpointed(slim.groupBy("block", *names).agg(F.min("id").alias("class_id")))
    members = slim.join(classes, ["block", *names]).select("id", "class_id")

    texts = None
    for i, n in enumerate(names):
        own = classes.where(F.col(n) != "").select(F.concat(F.lit(f"{i}:"), "block").alias("grp"), F.col(n).alias("s"), "class_id", F.struct(*names).alias("keys"))
        texts = own if texts is None else texts.unionByName(own)
    distinct = checkpointed(texts.select("grp", "s").distinct())
    near = similar_strings(distinct.select("grp", "s", F.lit(0).alias("side"), F.lit(0).alias("meet")), threshold, ratio).select("grp", "a", "b")
    near = near.unionByName(distinct.select("grp", F.col("s").alias("a"), F.col("s").alias("b")))
    left = near.join(texts.select("grp", F.col("s").alias("a"), F.col("class_id").alias("class_a"), F.col("keys").alias("ka")), ["grp", "a"])
    left = left.select(F.xxhash64("grp", "a", "b").alias("meet"), F.col("grp").alias("grp_a"), "class_a", "ka", (F.col("a") == F.col("b")).alias("same"))
    right = near.join(texts.select("grp", F.col("s").alias("b"), F.col("class_id").alias("class_b"), F.col("keys").alias("kb")), ["grp", "b"])
    right = right.select(F.xxhash64("grp", "a", "b").alias("meet"), "class_b", "kb")
    met = dealt_join(left, right, "meet").where(F.when(F.col("same"), F.col("class_a") < F.col("class_b")).otherwise(F.col("class_a") != F.col("class_b")))

    used = [(F.col(f"ka.{n}") != "") & (F.col(f"kb.{n}") != "") for n in names]
    number = sum((u.cast("int") for u in used), F.lit(0))
    shorter = [F.least(F.length(f"ka.{n}"), F.length(f"kb.{n}")) for n in names]
    longer = [F.greatest(F.length(f"ka.{n}"), F.length(f"kb.{n}")) for n in names]
    bound = [F.when(u, (100.0 if ratio == "levenshtein" else 200.0) * s / (l if ratio == "levenshtein" else s + l)).otherwise(0.0) for u, s, l in zip(used, shorter, longer)]
    possible = met.where(sum(bound, F.lit(0.0)) >= threshold * number - 1e-6)
    scores = [F.when(u, RATIOS[ratio](F.col(f"ka.{n}"), F.col(f"kb.{n}"))) for u, n in zip(used, names)]
    scored = possible.select("grp_a", "class_a", "class_b", *[s.alias(f"s{i}") for i, s in enumerate(scores)])
    held = [F.col(f"s{i}") for i in range(len(keys))]
    mean = sum((F.coalesce(s, F.lit(0.0)) for s in held), F.lit(0.0)) / sum((s.isNotNull().cast("int") for s in held), F.lit(0))
    hits = F.array_compact(F.array(*[F.when(s >= threshold, F.lit(k)) for s, k in zip(held, keys)]))
    # A pair meets on each key at the threshold; the first of them keeps it.
    first = F.coalesce(*[F.when(s >= threshold, F.lit(str(i))) for i, s in enumerate(held)])
    kept = scored.where((mean >= threshold) & (first == F.substring_index("grp_a", ":", 1)))
    pairs = kept.select(F.least("class_a", "class_b").alias("id_a"), F.greatest("class_a", "class_b").alias("id_b"), F.round(mean, 1).alias("score"), F.array_join(hits, ",").alias("matched_on"))
    return members, pairs.distinct()


def resolution_summary(pairs: DataFrame, total_records: int) -> DataFrame:
    n = F.count(F.lit(1))
    return pairs.agg(
        n.alias("duplicate_count"),
        F.lit(total_records).cast("bigint").alias("total_records"),
        F.round(n * 100.0 / max(total_records, 1), 2).alias("dedup_rate"),
    )


def clusters(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Connected components (id, cluster_id = smallest id) of links, by alternating large and small stars.

    A large star hangs the greater neighbours of a record on its smallest neighbour, a small star
    the smaller ones; the links become one star per component after a number of rounds that grows
    with the square of the logarithm of the longest chain. Every round is checkpointed, and the
    loop ends when no link moves. Neighbours of a hub are never gathered: its minimum combines
    before the shuffle and is joined back, which Spark splits when skewed.
    """
    high, low = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    alone = known.where(F.col(a) == F.col(b)).select(F.col(a).alias("u"))
    links = checkpointed(known.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    print_of = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))]
    mark = links.agg(*print_of).first()
    while mark[0]:
        # Minima have at most one row per record, that is two per link.
        small_side = F.broadcast if mark[0] <= FEW_LINKS else lambda frame: frame
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(small_side(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_side(root), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpointed(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(*print_of).first()
        if now == mark:
            break
        mark = now
    members = links.select(F.col("u").alias("id"), F.col("v").alias("cluster_id"))
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("cluster_id")).unionByName(alone.select(F.col("u").alias("id"), F.col("u").alias("cluster_id")))
    return members.unionByName(roots.distinct().join(members.select("id"), "id", "left_anti"))
