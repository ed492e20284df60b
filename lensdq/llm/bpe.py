"""Byte-level BPE encoding and decoding.

Text is cut into pre-tokens; every distinct pre-token of the corpus is encoded once and its ids
are joined back by word. To keep positions small, a block of documents (bounded in characters)
numbers its own distinct pre-tokens and holds each document as the sequence of those numbers,
so position i of a document is entry i of that sequence.
"""

from __future__ import annotations

import base64
import heapq
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lensdq.llm.common import scratch_path

#: Largest vocabulary that is sent to every task.
MOST_TOKENS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its id per line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, filter(bytes.strip, lines))}
    if len(ranks) > MOST_TOKENS:
        raise ValueError(f"{len(ranks)} tokens are more than the {MOST_TOKENS} a task may hold")
    return ranks


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: join the neighbouring pair of lowest rank, leftmost first, until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 100:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    scores = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
    while True:
        at, low = -1, None
        for i, s in enumerate(scores):
            if s is not None and (low is None or s < low):
                at, low = i, s
        if low is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del scores[at]
        if at < len(scores):
            scores[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            scores[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long words with a heap of pairs, in n log n steps."""
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    live = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            rank = ranks.get(word[i : end[j]])
            if rank is not None:
                heap.append((rank, i, end[j])) if not ready else heapq.heappush(heap, (rank, i, end[j]))

    ready = False
    for i in range(n):
        offer(i)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if live[i] else n
        if j >= n or end[j] != stop:
            continue
        live[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _packed(values, kind: str) -> bytes:
    """Whole numbers as byte planes, compressed: small numbers leave planes of zeros."""
    import numpy as np

    return zlib.compress(np.ascontiguousarray(np.asarray(values, kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes(), 1)


def _unpacked(raw: bytes, kind: str):
    import numpy as np

    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _numbered(batches: Iterator[pa.RecordBatch], pattern: str, block_chars: int, parts: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """For each block one row with its documents as numbers of pre-tokens, and its dictionary by hash part.

    Numbers follow frequency, 0 the most frequent pre-token of the block.
    """
    import numpy as np
    import regex
    from pyspark import TaskContext

    cut = regex.compile(pattern).findall
    block = TaskContext.get().partitionId() << 32

    class Numbers(dict):
        def __missing__(self, token):
            n = self[token] = len(self)
            return n

    numbers, ids, docs, chars = Numbers(), [], [], 0

    def row(part, docs_, counts, numbers_, words) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([block], pa.int64()), pa.array([part], pa.int64()), pa.array([docs_], pa.list_(id_type)), pa.array([counts], pa.list_(pa.int32())), pa.array([numbers_], pa.binary()), pa.array([words], pa.binary())],
            ["block", "part", "docs", "counts", "numbers", "words"],
        )

    def out() -> Iterator[pa.RecordBatch]:
        first = np.concatenate(docs)
        place = np.empty(len(numbers), np.uint32)
        place[np.argsort(-np.bincount(first, minlength=len(numbers)), kind="stable")] = np.arange(len(numbers), dtype=np.uint32)
        yield row(None, ids, [len(d) for d in docs], _packed(place[first], "<u4"), None)
        words = [w.encode() for w in numbers]
        part_of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
        order = np.lexsort((place, part_of))
        edges = np.flatnonzero(np.diff(part_of[order])) + 1
        for own in np.split(order, edges) if len(order) else ():
            held = [words[i] for i in own]
            lengths = _packed([len(w) for w in held], "<u4")
            steps = _packed(np.diff(place[own].astype(np.int64), prepend=0), "<u4")
            head = len(lengths).to_bytes(4, "little")
            yield row(int(part_of[own[0]]), None, None, steps, head + lengths + zlib.compress(b"".join(held), 1))

    for batch in batches:
        for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = value.as_py() or ""
            tokens = cut(text)
            ids.append(doc)
            docs.append(np.fromiter(map(numbers.__getitem__, tokens), np.uint32, len(tokens)))
            chars += len(text)
            if chars >= block_chars or len(ids) >= 100_000:
                yield from out()
                numbers, ids, docs, chars, block = Numbers(), [], [], 0, block + 1
    if ids:
        yield from out()


def _words_of(raw: bytes) -> list[bytes]:
    import numpy as np

    size = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(_unpacked(raw[4 : 4 + size], "<u4").astype(np.int64)).tolist()
    joined, out, at = zlib.decompress(raw[4 + size :]), [], 0
    for end in ends:
        out.append(joined[at:end])
        at = end
    return out


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", block_chars: int = 8_000_000, part_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, ids array<int>) of every row: whole texts, no special tokens.

    Blocks of documents number their distinct pre-tokens; the dictionaries of all blocks are
    shuffled by hash part of the word, each distinct word of a part is encoded once, and the ids
    go back to the blocks, where documents are put together by position. Dictionaries and ids
    travel packed. ``block_chars`` bounds what one task holds at a time (a longer text is a block
    of its own); there is a part for every ``part_chars`` characters of the corpus, so a part
    stays as small however many there are.

    A null text has no ids, as an empty one. Rows with equal or null ids each keep their row.
    """
    spark = df.sparkSession
    slim = df.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc"].dataType.simpleString()
    id_type = slim.select("doc").limit(0).toArrow().schema.field(0).type
    parts = max(64, (slim.agg(F.sum(F.length("text"))).first()[0] or 0) // part_chars)
    blocks = slim.mapInArrow(lambda it: _numbered(it, pattern, block_chars, parts, id_type), f"block bigint, part bigint, docs array<{kind}>, counts array<int>, numbers binary, words binary")
    # Written by block, so that the documents are not shuffled again when their ids come back.
    table, buckets = f"llm_bpe_{uuid.uuid4().hex}", min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks.write.option("compression", "zstd").option("path", scratch_path(spark, "bpe")).bucketBy(buckets, "block").saveAsTable(table)
    written = spark.table(table)
    shared = spark.sparkContext.broadcast(ranks)

    def encode_part(rows: pa.Table) -> pa.Table:
        known, encoded = shared.value, {}
        sizes, ids = [], []
        for value in rows["words"]:
            found = []
            for word in _words_of(value.as_py()):
                own = encoded.get(word)
                if own is None:
                    own = encoded[word] = merge_word(word, known)
                found.append(own)
            sizes.append(_packed([len(f) for f in found], "<u4"))
            ids.append(_packed([i for f in found for i in f], "<u4"))
        return pa.table({"block": rows["block"], "numbers": rows["numbers"], "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    encoded = written.where("part is not null").select("block", "part", "numbers", "words").groupBy("part").applyInArrow(encode_part, "block bigint, numbers binary, sizes binary, ids binary")

    def assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
        import numpy as np

        numbers, sizes, flat = [], [], []
        for n, s, i in zip(words["numbers"], words["sizes"], words["ids"], strict=True):
            numbers.append(np.cumsum(_unpacked(n.as_py(), "<u4").astype(np.int64)))
            sizes.append(_unpacked(s.as_py(), "<u4").astype(np.int64))
            flat.append(_unpacked(i.as_py(), "<u4").astype(np.int32))
        none = np.empty(0, np.int64)
        number, size, ids = np.concatenate([none, *numbers]), np.concatenate([none, *sizes]), np.concatenate([none.astype(np.int32), *flat])
        length, start = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        length[number], start[number] = size, np.cumsum(size) - size
        out_docs, lists = [], []
        for d, counts, packed in zip(docs["docs"], docs["counts"], docs["numbers"], strict=True):
            tokens = _unpacked(packed.as_py(), "<u4")
            n = length[tokens]
            ends = np.concatenate([[0], np.cumsum(n)])
            whole = np.empty(ends[-1], np.int32)
            for at in range(0, len(tokens), 500_000):
                own, m = tokens[at : at + 500_000], n[at : at + 500_000]
                first, last = ends[at], ends[at + len(own)]
                whole[first:last] = ids[np.arange(last - first) + np.repeat(start[own] - (ends[at : at + len(own)] - first), m)]
            edges = ends[np.concatenate([[0], np.cumsum(counts.values.to_numpy())])]
            lists.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(whole)))
            out_docs.append(d.values)
        return pa.table({"doc": pa.chunked_array(out_docs), "ids": pa.chunked_array(lists)})

    docs = written.where("part is null").select("block", "docs", "counts", "numbers")
    whole = docs.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(assemble, f"doc {kind}, ids array<int>")
    return whole.withColumnRenamed("doc", doc_id)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "decoded", packed: str | None = None) -> DataFrame:
    """``df`` with the bytes of its ids in ``into``, joined with the token-byte table inside each task.

    The table has one row per token, at most ``MOST_TOKENS``. Null ids give null bytes; no ids
    give no bytes; an id without a token makes the row's bytes null. ``packed`` names a further
    column for the ids as little-endian unsigned 32-bit integers in a row.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    added = [into] if packed is None else [into, packed]
    schema = StructType([*df.drop(*added).schema.fields, *[StructField(c, BinaryType()) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        by_id = {i: t for t, i in shared.value.items()}
        table = pa.array([by_id.get(i) for i in range(max(by_id, default=-1) + 1)], pa.large_binary())
        del by_id
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = part.column(ids)
                flat = lists.flatten()
                known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table))), flat, None)
                sizes = pc.cumulative_sum(pc.fill_null(lists.value_lengths(), 0))
                offsets = pa.concat_arrays([pa.array([0], pa.int32()), sizes.cast(pa.int32())])
                joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets.cast(pa.int64()), table.take(known)), pa.scalar(b"", pa.large_binary()))
                columns = [pc.if_else(lists.is_valid(), joined, None).cast(pa.binary())]
                if packed is not None:
                    numbers = flat.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
                    columns.append(pa.Array.from_buffers(pa.binary(), len(lists), [None, pc.multiply(offsets, pa.scalar(4, pa.int32())).buffers()[1], pa.py_buffer(numbers)]))
                names = [n for n in part.schema.names if n not in added]
                yield pa.record_batch([*[part.column(n) for n in names], *columns], [*names, *added])

    return df.mapInArrow(run, schema)


def digests(encoded: DataFrame, ranks: dict[bytes, int], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded rows: their ids, and what these decode to."""
    both = decode(encoded.select(doc_id, "ids"), ranks, packed="packed")
    return both.select(doc_id, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
