"""Approximate nearest neighbours with learned partitions of a neighbour graph and a routing classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensdq.llm.common import saved, unit_hash

#: Distinct vectors the router is fitted on, about; all when there are fewer.
SAMPLE = 8_000
#: Wanted distinct vectors per partition, and the largest number of partitions.
PARTITION_ROWS, MOST_PARTITIONS = 1_000, 1_024
#: Largest vectors and queries of one search task; larger partitions are searched in a grid of such blocks.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 4_000


@dataclass
class Router:
    """A classifier with one hidden layer: probabilities of partitions for a vector."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def partitions(self) -> int:
        return len(self.b2)

    @property
    def layers(self) -> tuple[np.ndarray, ...]:
        return self.mean, self.scale, self.w1, self.b1, self.w2, self.b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        return layer_logits(x, *self.layers)


def layer_logits(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """Indexes of the ``k`` nearest other rows, by blocks."""
    norms, out = (x * x).sum(axis=1), []
    for at in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out.append(np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 3, sweeps: int = 12) -> np.ndarray:
    """Parts of about equal size that cut few graph edges.

    Rows are seeded from balanced centres, then moved to the part holding most of their graph
    neighbours (in both directions) while that part has room; room is 10% above the mean.
    """
    rng, n = np.random.default_rng(seed), len(x)
    room = int(np.ceil(1.1 * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        d = ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).astype(np.float64)
        part, load = np.full(n, -1), np.zeros(parts, int)
        best = np.argsort(d, axis=1)
        gap = d[np.arange(n), best[:, min(1, parts - 1)]] - d[np.arange(n), best[:, 0]]
        for i in np.argsort(-gap, kind="stable"):
            for p in best[i]:
                if load[p] < room:
                    part[i], load[p] = p, load[p] + 1
                    break
        centres = np.stack([x[part == p].mean(axis=0) if load[p] else centres[p] for p in range(parts)])
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    for _ in range(sweeps):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (a, part[b]), 1)
        wish = votes.argmax(axis=1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if load[wish[i]] < room:
                load[part[i]] -= 1
                load[wish[i]] += 1
                part[i] = wish[i]
                moved += 1
        if moved < n // 500 + 1:
            break
    return part


def fit_router(x: np.ndarray, parts: int, k: int = 10, target: float = 0.97, seed: int = 5, epochs: int = 40) -> Router:
    """Partition the sample's neighbour graph, learn to predict the parts of a row's neighbours, choose the probes.

    ``probes`` is the least number of parts, ordered by probability, that hold ``target`` of the
    sample's neighbours where the router itself puts them.
    """
    x = x.astype(np.float32)
    mean, scale = x.mean(axis=0), np.float32(x.std() or 1.0)
    rng, dim, hidden = np.random.default_rng(seed), x.shape[1], 128
    if parts < 2 or len(x) <= k + 1:
        return Router(mean, scale, np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    graph = neighbour_graph(x, k)
    part = balanced_partition(x, graph, parts)
    goal = np.zeros((len(x), parts), np.float32)
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    np.add.at(goal, (np.arange(len(x)), part), 2.0)
    goal /= goal.sum(axis=1, keepdims=True)
    z = (x - mean) / scale
    weights = [rng.normal(0, dim**-0.5, (dim, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, hidden**-0.5, (hidden, parts)).astype(np.float32), np.zeros(parts, np.float32)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            own = order[at : at + 256]
            h = np.tanh(z[own] @ weights[0] + weights[1])
            out = h @ weights[2] + weights[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            delta = (out / out.sum(axis=1, keepdims=True) - goal[own]) / len(own)
            back = delta @ weights[2].T * (1 - h * h)
            step += 1
            for i, g in enumerate((z[own].T @ back, back.sum(axis=0), h.T @ delta, delta.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] -= 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(mean, scale, *weights)
    order = np.argsort(-router.logits(x), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(x), 0), axis=1)
    needed = rank[np.repeat(np.arange(len(x)), graph.shape[1]), order[graph.ravel(), 0]]
    held = np.cumsum(np.bincount(needed, minlength=parts)) / len(needed)
    router.probes = int(np.searchsorted(held, target) + 1)
    return router


def usable(vector: Column) -> Column:
    """Not null, not empty, finite in every component, not zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Router | None:
    """The router of distinct vectors (column ``v``), from a seeded sample of about ``sample`` of them."""
    n = vectors.count()
    if not n:
        return None
    rows = vectors.where(unit_hash(8, F.col("v")) < min(1.0, sample / n)).orderBy(F.xxhash64("v"), "first").select("v").toPandas() if n > sample else vectors.orderBy("first").select("v").toPandas()
    if not len(rows):
        rows = vectors.orderBy("first").limit(1).select("v").toPandas()
    parts = int(min(MOST_PARTITIONS, max(1, round(n / PARTITION_ROWS)), max(1, len(rows) // 60)))
    return fit_router(np.array(rows["v"].tolist(), np.float32), parts)


def nearest(df: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows by Euclidean distance for rows where ``queries`` holds.

    Equal vectors are one candidate with their ``k`` + 1 smallest ids, which is all that any
    result can show of them, and one query. Every candidate goes to its most probable partition;
    a query visits the most probable ``probes`` partitions, more if those hold too few rows.
    Candidates are compared in double precision; ties go to the smaller id. Rows with a null id or
    a vector that is null, empty, zero or not finite take no part, nor do vectors of other lengths
    than the most frequent one. Rows that repeat an id count once. No usable rows give no result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    id_type = rows.schema["id"].dataType.simpleString()
    if lengths is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    rows = rows.where(F.size("v") == lengths["d"])
    lead = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct_ids = rows.select("v", "id").distinct()
    groups = distinct_ids.withColumn("_r", lead).where(F.col("_r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("first", F.col("ids")[0])
    vectors = saved(groups, "vectors")
    router = fit(vectors, sample)
    # Plain arrays: executors need no package to read them.
    shared, probes = spark.sparkContext.broadcast(router.layers), router.probes

    @F.pandas_udf("int")
    def home(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(layer_logits(np.array(v.tolist(), np.float32), *shared.value).argmax(axis=1) if len(v) else [], dtype="int32")

    placed = saved(vectors.withColumn("part", home("v")), "placed")
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per partition
    held = np.array([sizes.get(p, 0) for p in range(router.partitions)])

    @F.pandas_udf("array<int>")
    def visits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            if not len(v):
                yield pd.Series([], dtype=object)
                continue
            order = np.argsort(-layer_logits(np.array(v.tolist(), np.float32), *shared.value), axis=1, kind="stable")
            enough = (np.cumsum(held[order], axis=1) > k + 1).argmax(axis=1) + 1
            enough = np.where(np.cumsum(held[order], axis=1)[:, -1] > k + 1, enough, order.shape[1])
            yield pd.Series([o[: max(e, probes)].tolist() for o, e in zip(order, enough, strict=True)])

    asking = saved(rows.where("asks").select("id", "v").distinct(), "asking")
    asked = asking.groupBy("v").agg(F.min("id").alias("q"))
    visit = saved(asked.select("q", "v", F.explode(visits("v")).alias("part")), "visits")
    asked_of = {r["part"]: r["n"] for r in visit.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    row_blocks = {p: -(-n // BLOCK_ROWS) for p, n in sizes.items()}
    query_blocks = {p: -(-n // BLOCK_QUERIES) for p, n in asked_of.items()}

    def blocks(of: dict[int, int]) -> Column:
        return F.coalesce(F.element_at(F.array(*[F.lit(of.get(p, 1)) for p in range(router.partitions)]), F.col("part") + 1), F.lit(1))

    def spread(frame: DataFrame, own: dict[int, int], other: dict[int, int], key: str, mine: str, theirs: str) -> DataFrame:
        at = F.pmod(F.xxhash64(key), blocks(own)).cast("int")
        return frame.withColumn(mine, at).withColumn(theirs, F.explode(F.sequence(F.lit(0), blocks(other) - 1)))

    left = spread(visit, query_blocks, row_blocks, "q", "qb", "rb").select("part", "qb", "rb", "q", "v")
    right = spread(placed, row_blocks, query_blocks, "first", "rb", "qb").select("part", "qb", "rb", "ids", F.col("first").alias("lead"), "v")

    def search(questions: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(questions) and len(candidates):
            c = np.array(candidates["v"].tolist(), np.float64)
            lead = candidates["lead"].to_numpy()
            ids = candidates["ids"].to_numpy()
            for q, v in zip(questions["q"], questions["v"], strict=True):
                d = np.sqrt(((c - np.asarray(v, np.float64)) ** 2).sum(axis=1))
                near = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
                near = near[np.lexsort((lead[near], d[near]))][: k + 1]
                found = sorted((float(d[i]), int(x)) for i in near for x in ids[i])[: k + 1]
                out.extend((q, x, s) for s, x in found)
        return pd.DataFrame(out, columns=["q", "id", "score"])

    hits = left.groupBy("part", "qb", "rb").cogroup(right.groupBy("part", "qb", "rb")).applyInPandas(search, f"q {id_type}, id {id_type}, score double")
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("_r") <= k + 1).drop("_r")
    answers = asking.join(asked, "v").select(F.col("id").alias("query_id"), "q").join(best, "q").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
