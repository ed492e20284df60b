"""Near-duplicate documents: banded MinHash candidates, odd-sketch estimates, exact confirmation, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensdq.llm.common import WordHashes, bounded_join, saved, shingle_hashes
from lensdq.operators.match import clusters

ROWS_PER_BAND = 5
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
#: Parity bitmap of a candidate's whole shingle set.
PARITY_WORDS = 16
PARITY_BITS = 64 * PARITY_WORDS
#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-7
#: Share of the candidate nodes that a round must link for another round of its kind.
ENOUGH_LINKS = 0.01
#: Tables of up to this many candidate nodes, about 100 bytes each, are broadcast; more are joined by shuffle.
FEW_NODES = 200_000


def bands_for(percent: int) -> int:
    together = min(percent / 100.0, 0.99) ** ROWS_PER_BAND
    return math.ceil(math.log(MISS) / math.log(1 - together))


def sketch_limit(percent: int, samples: int) -> int:
    """Most differing sketch bits of a pair worth confirming.

    Of ``samples`` MinHash values a pair at similarity t differs in about (1 - t) samples, with
    seven standard deviations added; each differing sample flips two bits, and bits hit twice
    cancel, so at most twice that number differ.
    """
    t = percent / 100.0
    differing = samples * (1 - t) + 7 * math.sqrt(samples * t * (1 - t)) + 1
    return min(SKETCH_BITS, math.ceil(2 * differing))


def similarity_estimate(differing_bits: Column, samples: int) -> Column:
    """Jaccard estimate of an odd sketch pair from its XOR population count."""
    share = F.least(F.lit(2.0) * differing_bits / SKETCH_BITS, F.lit(1 - 1.0 / SKETCH_BITS))
    return F.lit(1.0) + F.log(1 - share) * (SKETCH_BITS / 4.0 / samples)


def _words(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def _signatures(batches: Iterator[pa.RecordBatch], bands: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import xxhash

    hashes, k = WordHashes(), bands * ROWS_PER_BAND
    rng = np.random.default_rng(20_240_501)
    first = (rng.integers(1, 1 << 32, k, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    second = (rng.integers(1, 1 << 32, k, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    salt = np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    band_salt = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    none_bands, none_sketch = np.zeros(bands, np.int64), np.zeros(SKETCH_WORDS, np.int64)

    def mixed(x):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    for batch in batches:
        sizes, keys, banded, sketches = [], [], [], []
        for value in batch.column(1):
            grams = np.unique(shingle_hashes(_words(value.as_py() or b""), hashes))
            sizes.append(len(grams))
            keys.append(xxhash.xxh3_128_digest(grams.tobytes()))
            if not len(grams):
                banded.append(none_bands)
                sketches.append(none_sketch)
                continue
            low = (grams >> np.uint64(32)).astype(np.uint32)
            least = None
            for at in range(0, len(low), 512):
                y = low[at : at + 512, None] * first
                y ^= y >> np.uint32(16)
                y *= second
                m = y.min(axis=0)
                least = m if least is None else np.minimum(least, m)
            values = least.astype(np.uint64)
            rows = values.reshape(bands, ROWS_PER_BAND)
            code = band_salt.copy()
            for j in range(ROWS_PER_BAND):
                code = mixed(code ^ rows[:, j])
            banded.append(code.view(np.int64))
            bits = np.bincount((mixed(values + salt) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
            sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
        n = len(sizes)
        yield pa.record_batch(
            [
                batch.column(0).cast(kind), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(np.concatenate(banded) if n else none_bands[:0])),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * SKETCH_WORDS, pa.int32()), pa.array(np.concatenate(sketches) if n else none_sketch[:0])),
            ],
            ["doc_id", "n_shingles", "digest", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import xxhash

    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            grams = [np.unique(shingle_hashes(_words(v.as_py() or b""), hashes)) for v in batch.column(1).slice(at, 500)]
            offsets = pa.array(np.cumsum([0, *map(len, grams)]), pa.int32())
            keys = pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in grams], pa.binary())
            bits = [np.packbits((np.bincount((g & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64) for g in grams]
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * PARITY_WORDS, pa.int32()), pa.array(np.concatenate(bits)))
            yield pa.record_batch([keys, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(grams).view(np.int64))), parity], ["digest", "grams", "parity"])


def near_duplicates(df: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents whose sets of five-word shingles (A-Z lowered, white space cut) have a similarity of
    at least ``percent`` are linked; ``component_id`` is the smallest id reachable by links and
    ``kept`` marks it. Equal sets are one node from the start, so copies cost one row each.

    Nodes sharing a MinHash band and a class of like size meet in a bucket. In every bucket the
    node with most company is compared with all others and components are formed, so a group of
    copies costs one comparison per member; this goes on with the next such node while it links
    more than ``ENOUGH_LINKS`` of the nodes. In what is still apart, pairs of a bucket whose
    parity bitmaps differ in no more bits than linked sets can are compared; pairs already tried
    or already connected are not. Candidates are estimated by odd sketches of their MinHash
    samples and confirmed on their full sets. The bitmaps never lose a pair: an XOR has at most
    as many bits as the sets differ in shingles.

    A text without words (null, empty, blank) is linked with nothing. Rows that repeat an id keep
    their rows; a null id is never a component's id and its row is kept only if no other row of
    the component has an id. An empty table gives an empty result.
    """
    bands = bands_for(percent)
    samples = bands * ROWS_PER_BAND
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    arrow_id = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    found = saved(docs.mapInArrow(lambda it: _signatures(it, bands, arrow_id), f"doc_id {id_type}, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>"), "signatures")
    sets = found.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("low"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    # From here on a number stands for a set. What is broadcast by a number is as large as its
    # rows; by the digest it would take a whole memory page of the executor, however few they are.
    nodes = saved(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")

    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    multi = saved(rows.join(shared, "bucket"), "buckets")
    scores = saved(multi.groupBy("node").agg(F.sum("size").alias("score")), "scores")
    few = scores.count()
    if not few:
        return _with_components(found, nodes.select("digest", F.col("low").alias("component_id")), doc_id)
    # Tables with one row per candidate node are broadcast up to a counted size.
    per_node = F.broadcast if few <= FEW_NODES else lambda frame: frame
    members = saved(nodes.join(per_node(scores), "node").select("node", "digest", "low", "n", "sketch", "score"), "members")
    # Linked sizes differ by a factor of 100 / percent at most, so a bucket falls into classes of
    # that width: a node goes to its own class and the next, and a pair meets where one is at home.
    home = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / min(percent, 99)) * (1 + 1e-9)))
    classed = multi.join(per_node(members.select("node", "n", "score")), "node").withColumn("class", home)
    # Texts without an id cannot be told by it: all of them are read, and those of members kept by their hash.
    of_members = bounded_join(docs, members.select(F.col("low").alias("doc_id")).distinct(), ["doc_id"], few, FEW_NODES, "left_semi").unionByName(docs.where("doc_id is null"))
    hashed = of_members.mapInArrow(_sets, "digest binary, grams array<bigint>, parity array<bigint>").join(per_node(members.select("digest", "node")), "digest")
    grams = saved(hashed.groupBy("node").agg(F.any_value("grams").alias("grams"), F.any_value("parity").alias("parity")), "shingles")
    twice = classed.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("up"))
    keyed = twice.select(F.xxhash64("bucket", F.col("class") + F.col("up")).alias("bucket"), "node", "n", "score", (F.col("up") == 0).alias("home"), F.col("node").alias("component"))
    active = saved(_open(keyed).join(grams.select("node", "parity"), "node"), "active")

    limit = sketch_limit(percent, samples)

    def confirmed(pairs: DataFrame, step: int) -> DataFrame:
        """Linked pairs, as pairs of the components they belong to."""
        a = members.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = members.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        near = pairs.join(per_node(b), "b").join(per_node(a), "a").where(_differing("sa", "sb", SKETCH_WORDS) <= limit)
        ga = grams.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
        gb = grams.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
        both = near.select("a", "b", "ca", "cb", "na", "nb").join(gb, "b").join(ga, "a").withColumn("common", F.size(F.array_intersect("ga", "gb")))
        linked = both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common")))
        return saved(linked.select("ca", "cb").distinct(), f"links{step}")

    labels = members.select("node", F.col("node").alias("component"))
    other = [F.col(c).alias(f"other_{c}") for c in ("node", "n", "home", "component", "parity")]
    # Sets of the wanted similarity differ in at most this many shingles, and so do their bitmaps.
    apart = F.floor((F.col("n") + F.col("other_n")) * (100 - percent) / (100 + percent) + 1e-6)
    alike = (F.col("home") | F.col("other_home")) & (100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")) & (_differing("parity", "other_parity", PARITY_WORDS) <= apart)
    tried, step, last = None, 0, False
    while not active.isEmpty():
        step += 1
        if last:
            met = active.join(active.select("bucket", *other), "bucket").where("node < other_node")
        else:
            leaders = active.groupBy("bucket").agg(F.max_by("node", F.struct("score", "node")).alias("node"))
            pivots = saved(active.join(leaders, ["bucket", "node"], "left_semi"), f"pivots{step}")
            met = active.join(pivots.select("bucket", *other), "bucket").where("node <> other_node")
        in_order = F.col("node") < F.col("other_node")
        one, two = F.struct(F.col("node").alias("n"), F.col("component").alias("c")), F.struct(F.col("other_node").alias("n"), F.col("other_component").alias("c"))
        found_pairs = met.where("component <> other_component").where(alike).select(F.when(in_order, one).otherwise(two).alias("x"), F.when(in_order, two).otherwise(one).alias("y"))
        pairs = found_pairs.select(F.col("x.n").alias("a"), F.col("y.n").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, f"pairs{step}")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        links = confirmed(pairs, step)
        merged = clusters(links, "ca", "cb").select(F.col("id").alias("component"), F.col("cluster_id").alias("into"))
        labels = saved(_relabelled(labels, per_node(merged)), f"labels{step}")
        if last:
            break
        last = links.count() <= few * ENOUGH_LINKS
        rest = active.join(pivots.select("bucket", "node"), ["bucket", "node"], "left_anti")
        active = saved(_open(_relabelled(rest, per_node(merged))), f"active{step}")

    rooted = nodes.select("node", "digest", "low").join(per_node(labels), "node", "left").select("digest", "low", F.coalesce("component", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return _with_components(found, rooted.join(lowest, "root").select("digest", "component_id"), doc_id)


def _differing(one: str, two: str, words: int) -> Column:
    """Population count of the XOR of two bitmaps."""
    return sum((F.bit_count(F.col(one)[i].bitwiseXOR(F.col(two)[i])) for i in range(words)), F.lit(0))


def _open(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components."""
    several = rows.groupBy("bucket").agg((F.min("component") < F.max("component")).alias("several")).where("several").select("bucket")
    return rows.join(several, "bucket", "left_semi")


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with their component replaced by the one it went into."""
    return rows.join(merged, "component", "left").withColumn("component", F.coalesce("into", "component")).select(*rows.columns)


def _with_components(found: DataFrame, labels: DataFrame, doc_id: str) -> DataFrame:
    own = found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    whole = own.join(labels, "digest", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return whole.select(F.col("doc_id").alias(doc_id), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
