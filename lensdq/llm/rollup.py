"""Token counts kept as additive totals: signed change batches, committed once each."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import mul

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensdq.llm.bpe import merge_word

KEYS = ["source", "lang", "tokenizer_version"]
#: Words whose token counts a task remembers.
REMEMBERED = 200_000


def count_tokens(df: DataFrame, tokenizers: dict[str, dict[bytes, int]], pattern: str, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", wanted: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, source, lang, digest, tokens map<version, count>): byte-level BPE token counts of whole texts.

    All tokenizers share one pre-token pattern. ``wanted`` names the rows that a version is to
    count (all, where it names none); other rows lack the version in ``tokens``. Null texts have
    no tokens. ``digest`` is the hash of the text, null for null. Each row is counted for itself;
    a task remembers the counts of ``REMEMBERED`` words.
    """
    versions = sorted(tokenizers)
    asked = F.array(*[F.coalesce((wanted or {}).get(v, F.lit(True)), F.lit(False)) for v in versions])
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.sha2(F.col(text).cast("string").cast("binary"), 256).alias("digest"), F.col(text).cast("string").alias("text"), asked.alias("asked"))
    shared = df.sparkSession.sparkContext.broadcast(tokenizers)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import regex
        import tiktoken

        cut = regex.compile(pattern).findall
        pieces = {v: tiktoken.Encoding(v, pat_str=pattern, mergeable_ranks=shared.value[v], special_tokens={})._core_bpe.encode_single_piece for v in versions}

        def sizes_of(version: str) -> Callable[[str], int]:
            ranks, piece = shared.value[version], pieces[version]

            @lru_cache(REMEMBERED)
            def size(word: str) -> int:
                raw = word.encode()
                # The library's merge is quadratic in long words.
                return len(piece(raw)) if len(raw) <= 200 else len(merge_word(raw, ranks))

            return size

        sizes = [sizes_of(v) for v in versions]
        for batch in batches:
            counted = []
            for value, marks in zip(batch.column(4), batch.column(5).to_pylist(), strict=True):
                words = Counter(cut(value.as_py() or ""))
                counted.append([(v, sum(map(mul, map(size, words), words.values()))) for v, size, mark in zip(versions, sizes, marks, strict=True) if mark])
            yield pa.record_batch([*(batch.column(i) for i in range(4)), pa.array(counted, pa.map_(pa.string(), pa.int64()))], ["doc_id", "source", "lang", "digest", "tokens"])

    return slim.mapInArrow(run, f"doc_id {kind}, source string, lang string, digest string, tokens map<string,bigint>").withColumnRenamed("doc_id", doc_id)


def inserts(after: DataFrame) -> DataFrame:
    return after.select(*KEYS, F.lit(1).alias("sign"), "n_tokens")


def deletes(before: DataFrame) -> DataFrame:
    return before.select(*KEYS, F.lit(-1).alias("sign"), "n_tokens")


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """A revised count takes back the old row and adds the new one, which may lie under other keys."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors share.

    ``commit`` sums a batch of signed rows (keys, sign, n_tokens) to one delta per key and writes
    it under the batch's name. The delta appears by one rename, after all its files are complete,
    so a batch is either whole or absent; a batch name that is there already is not applied again,
    whatever its rows. ``totals`` adds up the deltas, one row per key and batch; keys whose
    documents are all gone are left out. Null keys are keys of their own, null token counts add nothing, an empty batch is committed
    as empty. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._hadoop(f"{self.path}/{name}"))

    def _rename(self, old: str, new: str) -> bool:
        self._fs.mkdirs(self._hadoop(f"{self.path}/{new}").getParent())
        return self._fs.rename(self._hadoop(f"{self.path}/{old}"), self._hadoop(f"{self.path}/{new}"))

    def committed(self) -> list[str]:
        """Names of the batches applied so far."""
        if not self._exists("deltas"):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._hadoop(f"{self.path}/deltas")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; False, and no change, if it was applied before."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError(f"batch name {batch!r}")
        if self._exists(f"deltas/{batch}"):
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("bigint")).alias("docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("bigint").alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/staged/{batch}")
        return self._rename(f"staged/{batch}", f"deltas/{batch}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens)"""
        shape = "source string, lang string, tokenizer_version string, docs bigint, tokens bigint"
        names = self.committed()
        rows = self.spark.read.schema(shape).parquet(*[f"{self.path}/deltas/{n}" for n in names]) if names else self.spark.createDataFrame([], shape)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0")
