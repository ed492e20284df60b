"""Language identification by mixture inference: each text is a mixture of languages with trigram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lensdq.llm.common import unit_hash

BINS = 1 << 15
#: Largest number of languages a model may have; more is an error, as the model is held by every task.
MOST_LANGUAGES = 500
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    """Probabilities of hashed trigrams by language: BINS values for each name."""

    languages: list[str] = field(default_factory=list)
    shares: list[list[float]] = field(default_factory=list)


def _gram_counts(text: str):
    """Counts of the hashed byte trigrams of a lower-cased text, white space as one blank each."""
    import numpy as np

    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "ignore"), np.uint8)
    counts = np.zeros(BINS, np.int64)
    for at in range(0, max(len(raw) - 2, 0), 1 << 20):
        b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        code *= np.uint32(0x9E3779B1)
        counts += np.bincount(code >> np.uint32(17), minlength=BINS)
    return counts


def fit(df: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample_docs: int = 5_000, smoothing: float = 0.1) -> LanguageModel:
    """Trigram likelihoods of every language in ``lang`` from whole texts.

    A language with more than ``sample_docs`` rows is fitted on a seeded sample of about that many
    (chosen by a hash of the id); smaller ones on all. Rows with null text or language take no
    part. The counts of all tasks are added up in Spark; the model has BINS numbers per language.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(doc_id).cast("string").alias("doc"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return LanguageModel()
    names = sorted(sizes)
    rates = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, sample_docs / sizes[n]))])
    index = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sums = np.zeros((len(names), BINS), np.int64)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[index[name]] += _gram_counts(value.as_py())
        which, bins = np.nonzero(sums)
        yield pa.record_batch([pa.array(which, pa.int32()), pa.array(bins, pa.int32()), pa.array(sums[which, bins], pa.int64())], ["l", "bin", "n"])

    sample = rows.where(unit_hash(9, F.col("doc")) < F.element_at(rates, F.col("lang"))).select("lang", "text")
    import numpy as np

    totals = np.zeros((len(names), BINS))
    for r in sample.mapInArrow(count, "l int, bin int, n bigint").groupBy("l", "bin").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        totals[r.l, r.bin] = r.n
    smooth = totals + smoothing
    return LanguageModel(names, (smooth / smooth.sum(axis=1, keepdims=True)).tolist())


def infer(counts, shares, penalty: float, rounds: int = 40):
    """Proportions, chosen set and gain of one text: (full proportions, proportions of the set, indexes, gain).

    Expectation-maximisation finds the proportions of all languages. The set grows from the
    largest proportion on and stops where the likelihood no longer pays ``penalty`` times the
    logarithm of the number of grams for another language. No set can be likelier than all
    languages together, so if that cannot pay for a second one, one language it is.
    """
    import numpy as np

    at = np.flatnonzero(counts)
    c = counts[at].astype(np.float64)
    n = c.sum()
    p = shares[at]

    def em(q):
        mix = np.full(q.shape[1], 1.0 / q.shape[1])
        for _ in range(rounds):
            new = mix * (q.T @ (c / (q @ mix))) / n
            moved = np.abs(new - mix).max()
            mix = new
            if moved < 1e-3:
                break
        return mix, float(c @ np.log(q @ mix))

    full, best = em(p)
    order = np.argsort(-full, kind="stable")
    price = penalty * np.log(max(n, 2.0))
    chosen, mix = order[:1], np.ones(1)
    like = float(c @ np.log(p[:, order[0]]))
    for k in range(2, len(order) + 1):
        if 2 * (best - like) <= price:
            break
        more, more_like = em(p[:, order[:k]])
        if 2 * (more_like - like) <= price:
            break
        chosen, mix, like = order[:k], more, more_like
    return full, mix, chosen, like / n + np.log(BINS)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", penalty: float = 6.0) -> DataFrame:
    """``df`` with lang_pred, score, lang_set array<struct<lang, share>> and lang_gain.

    ``lang_pred`` is the language with the largest share in the chosen set, ``score`` its share
    among all languages; ``lang_gain`` tells how much better a trigram is explained than by equal
    chances (nats; at or below 0 the text is no known language). Null texts, texts without any
    letter, and every text under an empty model give ``und`` with score 0, no set, null gain. Equal
    shares go to the language first by name. Columns of the same names are replaced.
    """
    added = ["lang_pred", "score", "lang_set", "lang_gain"]
    base = df.drop(*[c for c in df.columns if c.lower() in added])
    schema = StructType([*base.schema.fields, *StructType.fromDDL("lang_pred string, score double, lang_set array<struct<lang:string,share:double>>, lang_gain double")])
    # Plain values: executors need no package to read them.
    shared = df.sparkSession.sparkContext.broadcast((list(model.languages), model.shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import regex

        names, likely = shared.value
        shares = np.ascontiguousarray(np.array(likely).T) if names else None
        letter = regex.compile(r"\p{L}").search
        set_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            out = []
            for value in batch.column(text):
                words = value.as_py()
                if not names or words is None or not letter(words):
                    out.append((UNDETERMINED, 0.0, [], None))
                    continue
                full, mix, chosen, gain = infer(_gram_counts(words), shares, penalty)
                first = int(chosen[np.argmax(mix)])
                out.append((names[first], float(min(1.0, full[first])), [{"lang": names[int(i)], "share": float(m)} for i, m in zip(chosen, mix, strict=True)], float(gain)))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), set_type, pa.float64()))]
            yield pa.record_batch([*batch.columns, *columns], [*batch.schema.names, *added])

    return base.mapInArrow(run, schema)
