"""From documents to token ids: language, near-duplicates, personal data, source mix, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensdq.llm import bpe, langid, mixing, neardup, pii
from lensdq.llm.common import fresh, saved
from lensdq.session import read_table


#: Keys of up to this number, 16 MB, are broadcast rather than shuffled with the texts.
FEW_KEYS = 200_000
#: Bytes of texts that go to a Python worker at a time.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python and back in batches of bounded bytes, whatever their lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a language the labelled rows teach; ``lang`` becomes the inferred one.

    Texts without a letter, and texts that no language explains better than chance, go.
    """
    small_batches(spark)
    found = langid.identify(docs, langid.fit(docs))
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_gain") > 0))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Rows are told by their id and their text, so null ids and ids that repeat are documents of
    their own. Rows that repeat both are one document. Texts without words are linked with nothing.
    """
    small_batches(spark)
    key, kept_key, rows = fresh(docs, "_key", "_kept", "_rows")
    number = F.col("doc_id").cast("string")
    # Ids of one width keep their order, null ids come last.
    own_id = F.coalesce(F.lpad(number, F.greatest(F.length(number), F.lit(20)), F.lit("0")), F.lit("~"))
    keyed = docs.withColumn(key, F.concat_ws(":", own_id, F.hex(F.xxhash64("text"))))
    found = neardup.near_duplicates(keyed, percent=80, doc_id=key).where("kept")
    kept = saved(found.groupBy(F.col(key).alias(kept_key)).agg(F.count(F.lit(1)).alias(rows)), "kept")
    side = F.broadcast(kept) if kept.count() <= FEW_KEYS else kept
    joined = keyed.join(side, F.col(key) == F.col(kept_key))
    once = joined.where(F.col(rows) == 1).drop(kept_key, rows)
    again = joined.where(F.col(rows) > 1).drop(kept_key, rows).dropDuplicates([key])
    return once.unionByName(again).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and disclosing terms in every text; ``n_chars`` follows."""
    found = pii.find(docs)
    clean = found.withColumn("text", pii.sanitised(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("bigint")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, some several times, so that every source's words meet its target."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, encoded and decoded again."""
    small_batches(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mix", source_mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained language models and seeded choices are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None
