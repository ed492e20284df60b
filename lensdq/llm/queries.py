"""One registered query per corpus operator, with production parameters over whole tables, and their statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lensdq.llm import ann, bpe, langid, licenses, mixing, neardup, periodic, phrases, pii, quality, rollup, sharding, winnow
from lensdq.llm.common import WORD, saved, scratch_path
from lensdq.session import read_table

SHARDS = 16


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(encoded, ranks)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"), licenses.fit(spark))


def op3_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != pii.TERM)
    counts = [F.size(F.filter("spans", _of(kind))).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base).cast("binary"), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard(rows, ["lang", "source", "size", "doc_id"], SHARDS, ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.fit(documents.where(~held_out))
    found = langid.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.array_join(F.transform("lang_set", lambda s: s["lang"]), ",").alias("lang_set"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three change batches over the documents, the first one sent twice.

    ``load`` inserts every document with its 50k counts. ``recount`` revises the documents in
    languages other than English to the multilingual tokenizer. ``dedup`` deletes the copies of
    texts that a smaller id holds, under whatever version they stand by then.
    """
    ranks = {v: bpe.read_ranks(public_tokenizers.path(f"{v}.tiktoken")) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    foreign = F.coalesce(F.col("lang") != "en", F.lit(True))
    documents = read_table(spark, sf_dir, "documents")
    counted = saved(rollup.count_tokens(documents, ranks, public_tokenizers.PATTERN, wanted={"byte_bpe_multi_50k": foreign}), "counts")

    def under(rows: DataFrame, version: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.col("tokens")[version].alias("n_tokens"))

    first, second = "byte_bpe_50k", "byte_bpe_multi_50k"
    lowest = counted.groupBy("digest").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = counted.join(lowest, "digest").where("doc_id > lowest")
    book = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    book.commit("load", rollup.inserts(under(counted, first)))
    book.commit("recount", rollup.revisions(under(counted.where(foreign), first), under(counted.where(foreign), second)))
    book.commit("dedup", rollup.deletes(under(copies.where(foreign), second).unionByName(under(copies.where(~foreign), first))))
    book.commit("load", rollup.inserts(under(counted, first)))
    return book.totals()


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, totals = phrases.phrase_counts(read_table(spark, sf_dir, "documents"), longest=4, support=30)
    return phrases.ranked(phrases.collocations(counts, totals, covered=80), most=2000)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = winnow.benchmark_windows(read_table(spark, sf_dir, "benchmark"), width=10)
    found = winnow.contamination(read_table(spark, sf_dir, "documents"), windows)
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of a tenth of the ids with their end replaced by a repeated part of it."""
    slim = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    words = slim.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    g = F.floor(F.col("_h") / 10)
    laid = words.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")).cast("int"))
    laid = laid.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int"))
    whole = F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.transform(F.sequence(F.col("_a"), F.col("_n") - 1), lambda i: F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return laid.select("doc_id", F.when(F.col("_n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted_repeats(read_table(spark, sf_dir, "documents")), shortest=6, times=4)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_byte_bpe, op2_license_scan, op3_pii_sanitise, op4_near_duplicates, op5_quality_rules, op6_hilbert_shards, op7_source_mix, op8_nearest_vectors, op9_language_id, op10_token_rollup, op11_phrase_collocations, op12_decontamination, op13_periodic_runs]
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS low FROM sets
  UNION SELECT e.b, r.low FROM reach r JOIN both_ways e ON e.a = r.node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(low) AS component_id, doc_id = min(low) AS kept
FROM sets JOIN reach ON node = doc_id GROUP BY doc_id, s
"""


PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
cut AS (SELECT lang, w FROM (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces) WHERE len(w) > 0),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM cut, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM cut GROUP BY lang),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS p FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, k, a, j, array_to_string(p[1:j], ' ') AS head, array_to_string(p[j + 1:], ' ') AS tail FROM cand, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
scored AS (SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT lang, array_to_string(p[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM cand, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
free AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN total USING (lang) WHERE rank <= 2000
"""

LEAK_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM b),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k),
hits AS (SELECT doc_id, pos, dw.k, item_id FROM dw JOIN bw ON bw.g = dw.g AND bw.k = dw.k),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT doc_id, pos, k FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit_words.n, 0) AS n_hit, coalesce(hit_items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit_words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicates": NEAR_SQL, "op11_phrase_collocations": PHRASE_SQL, "op12_decontamination": LEAK_SQL}
