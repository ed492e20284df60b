"""Personal data: pattern spans, and terms that give protected values away by corpus co-occurrence.

Everything runs as SQL functions. Positions come from the lengths of the pieces between matches,
which ``split`` returns for the same pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensdq.llm.common import bounded_join, fresh, saved
from lensdq.operators.match import clusters

KINDS = ["email", "ip", "card", "phone"]
TERM = "term"
# Possessive forms of the contract's patterns: the same matches without backtracking or recursion.
# A match may begin where the last one ended or where no earlier character could have begun it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Text without these cannot hold a match.
NEEDED = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Letters of scripts written without spaces; their terms are pairs of neighbouring characters.
DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\u30FC"
#: Code points of those scripts and some more: a quick test whether a text holds any.
MAYBE_DENSE = r"[\u0E00-\u109F\u1780-\u19FF\u2E80-\uFAFF\uFF65-\uFFDC\uAA60-\uAA7F\x{10000}-\x{3FFFF}]"
PLAIN_WORDS = r"[\p{L}\p{M}\p{N}]++"
WORDS = rf"[{DENSE}]++|[\p{{L}}\p{{M}}\p{{N}}&&[^{DENSE}]]++"
#: Disclosed terms up to this number are broadcast, more are joined by shuffle.
FEW_TERMS = 20_000
#: Smallest hashes kept of a text, those under which near copies meet, and the estimate from which they are near copies.
SKETCH, SKETCH_KEYS, ALIKE = 64, 8, 0.6
#: Texts with copies up to this number are broadcast, more are joined by shuffle.
FEW_CLASSES = 200_000


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn sum: every second digit from the right counts twice, less 9 above 9."""
    places = F.split(F.reverse(digits), "")

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, twice).otherwise(n)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda total, v: total + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: part.rlike(r"\A0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
    if kind == "card":
        digits = _digits(hit)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: Column, needed: Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, hit>>: code points, end exclusive."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.zip_with(hits, F.call_function("split", text, pattern, F.lit(-1)), lambda h, g: F.struct(F.length(g).cast("bigint").alias("gap"), F.length(h).cast("bigint").alias("size"), h.alias("hit")))
    shape = "array<struct<start:bigint,end:bigint,hit:string>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(shape).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        one = F.array(F.struct(begin.alias("start"), (begin + p["size"]).alias("end"), p["hit"].alias("hit")))
        return F.struct((begin + p["size"]).alias("at"), F.concat(acc["out"], one).alias("out"))

    found = F.aggregate(F.filter(pairs, lambda p: p["hit"].isNotNull()), start, step, lambda acc: acc["out"])
    return F.when(needed, found).otherwise(F.array().cast(shape))


def _test(kind: str):
    return lambda s: _valid(kind, s["hit"])


def _span(kind: Column, hit: Column | None = None):
    return lambda s: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["hit"] if hit is None else hit).alias("hit"))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, hit>> of the four patterns, failing matches dropped, by kind as listed, then start."""
    lists = []
    for kind in KINDS:
        found = F.filter(matches(text, F.lit(PATTERNS[kind]), text.rlike(NEEDED[kind])), _test(kind))
        lists.append(F.transform(found, _span(F.lit(kind))))
    return F.concat(*lists)


def _units(text: Column) -> Column:
    """Words of letters and digits, whatever their length, and character pairs where words have no spaces.

    Texts without a letter of the scripts written without spaces take the plain pattern, which
    finds the same words there.
    """
    plain = F.regexp_extract_all(F.lower(text), F.lit(PLAIN_WORDS), F.lit(0))
    runs = F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))

    def pairs(run: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))

    cut = F.flatten(F.transform(runs, lambda run: F.when(run.rlike(f"^[{DENSE}]") & (F.length(run) > 1), pairs(run)).otherwise(F.array(run))))
    return F.when(F.lower(text).rlike(MAYBE_DENSE), cut).otherwise(plain)


def _outside(text: Column, spans: Column) -> Column:
    """The text with a space for every span: words of a value are not terms beside it."""
    return replaced(text, spans, lambda s: F.lit(" "))


def _shingles(units: Column) -> Column:
    """64-bit hashes of all runs of five units; a shorter text is one run."""
    hashed = F.transform(units, lambda u: F.xxhash64(u))

    def runs(h: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
        five = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))
        return F.when(F.size(h) < 5, whole).otherwise(five)

    return F.transform(F.array(hashed), runs)[0]


def _sketch(units: Column) -> Column:
    """The ``SKETCH`` smallest hashes of the runs, in order; null without a unit. One sort, whatever the length."""
    least = F.transform(F.array(units), lambda own: F.slice(F.array_sort(F.array_distinct(_shingles(own))), 1, SKETCH))[0]
    return F.when(F.size(units) > 0, least)


def weights(texts: DataFrame) -> tuple[DataFrame, float]:
    """(key, weight) of texts that have copies or near copies, and the number of texts that count.

    ``key`` is the hash of a whole text (``text_key``). A text meets others under each of its
    ``SKETCH_KEYS`` smallest run hashes and is linked with the text of lowest key there, if the
    bottom sketches estimate a similarity of at least ``ALIKE``; links chain. Every document of a
    component of n documents weighs 1/n; all others weigh 1. So copies and near copies of a
    document weigh one together in every count, and equal passages of different documents count
    each. Sketches estimate: with 64 hashes the estimate of a similarity of 0.8 is off by 0.05 in
    the standard deviation, and near copies that are nobody's lowest stay apart.
    """
    cut = texts.select(text_key(F.col("text")).alias("key"), _units(F.col("text")).alias("units"))
    sketched = cut.select("key", _sketch(F.col("units")).alias("sketch"))
    classes = saved(sketched.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.any_value("sketch").alias("sketch")), "classes")
    banded = classes.where("sketch is not null").select("key", "sketch", F.explode(F.slice("sketch", 1, SKETCH_KEYS)).alias("band"))
    leaders = saved(banded.groupBy("band").agg(F.min("key").alias("leader"), F.max("key").alias("last")).where("leader < last").select("band", "leader"), "leaders")
    few = leaders.count()
    led = leaders.select(F.col("leader").alias("key")).distinct()
    of_leaders = saved(bounded_join(classes, led, ["key"], few, FEW_CLASSES, "left_semi").select(F.col("key").alias("leader"), F.col("sketch").alias("other")), "led")
    met = bounded_join(banded, leaders, ["band"], few, FEW_CLASSES).where("key <> leader").select("key", "sketch", "leader").dropDuplicates(["key", "leader"])
    both = bounded_join(met, of_leaders, ["leader"], few, FEW_CLASSES).withColumn("least", F.slice(F.array_sort(F.array_union("sketch", "other")), 1, SKETCH))
    agree = F.size(F.array_intersect("least", F.array_intersect("sketch", "other")))
    links = both.where(agree >= ALIKE * F.size("least")).select("key", "leader")
    merged = saved(clusters(links, "key", "leader"), "merged")
    counted = merged.count()
    grouped = bounded_join(classes.select("key", "copies"), merged.withColumnRenamed("id", "key"), ["key"], counted, FEW_CLASSES, "left").select("key", "copies", F.coalesce("cluster_id", "key").alias("component"))
    sizes = saved(grouped.groupBy("component").agg(F.sum("copies").alias("size")), "sizes")
    several = sizes.where("size > 1")
    weighed = saved(bounded_join(grouped, several, ["component"], several.count(), FEW_CLASSES).select("key", (1 / F.col("size")).alias("weight")), "weights")
    return weighed, float(sizes.count())


def text_key(text: Column) -> Column:
    return F.xxhash64(F.lit(3), F.coalesce(text, F.lit("")))


def disclosed_terms(found: DataFrame, texts: DataFrame, support: int = 3, chance: float = 0.01, generalise: float = 0.97, remove: float = 0.995) -> DataFrame:
    """(term, disclosure, action): terms of documents with protected values that give one of them away.

    Terms are all words and character pairs (``_units``) outside of the patterns' spans. Documents
    are counted by ``weights``, on both sides alike: n_value are those holding a value, n_term
    those holding a term, n_joint those holding both, wherever they stand. Disclosure is the pointwise mutual information of term and value divided by the
    information of the value: 1 means that the term alone identifies the value, 0 that it says
    nothing. Terms need ``support`` documents beside the value, and more of them than chance would
    bring together: the Chernoff bound of the binomial tail, times the number of pairs tried, has
    to be below ``chance``, so that a value held by many documents does not draw in every rare
    word. From ``generalise`` on terms are replaced by a class label, from ``remove`` on removed.
    """
    shape = "term string, disclosure double, action string"
    none = texts.sparkSession.createDataFrame([], shape)
    weighed, total = weights(texts)
    rows = weighed.count()
    if total < 2:
        return none

    def with_weight(df: DataFrame) -> DataFrame:
        return bounded_join(df, weighed, ["key"], rows, FEW_CLASSES, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))

    enough = support - 1e-6
    value_of = lambda s: F.concat_ws(":", s["kind"], F.lower(s["hit"]))
    holders = saved(with_weight(found.select(text_key(F.col("text")).alias("key"), "text", "spans")), "holders")
    each = holders.select("weight", F.explode(F.array_distinct(F.transform("spans", value_of))).alias("value"))
    of_value = saved(each.groupBy("value").agg(F.sum("weight").alias("n_value")).where(F.col("n_value") >= enough), "values")
    few = of_value.count()
    if not few:
        return none
    # A document holds a value and a term once each, so a grouping by both needs no distinct.
    words = F.array_distinct(_units(_outside(F.col("text"), F.col("spans"))))
    several = holders.select("weight", "text", "spans", F.explode(F.array_distinct(F.transform("spans", value_of))).alias("value"))
    held = bounded_join(several, of_value, ["value"], few, FEW_TERMS, "left_semi")
    pairs = held.select("weight", "value", F.explode(words).alias("term"))
    met = saved(pairs.groupBy("value", "term").agg(F.sum("weight").alias("n_joint")), "joint")
    tried, joint = met.count(), met.where(F.col("n_joint") >= enough)
    terms = saved(joint.select("term").distinct(), "candidates")
    candidates = terms.count()
    if not candidates:
        return none
    texts = texts.select("text", base_spans(F.coalesce("text", F.lit(""))).alias("spans"))
    held_by = texts.select(text_key(F.col("text")).alias("key"), words.alias("terms")).select("key", F.explode("terms").alias("term"))
    # Only candidates are counted: words of texts beside no value leave before the shuffle.
    documents = with_weight(bounded_join(held_by, terms, ["term"], candidates, FEW_TERMS)).groupBy("term").agg(F.sum("weight").alias("n_term"))
    # Sums of weights differ from whole numbers by rounding.
    both = bounded_join(joint.join(documents, "term"), of_value, ["value"], few, FEW_TERMS).select("term", *[F.round(c, 6).alias(c) for c in ("n_joint", "n_term", "n_value")])
    share = F.col("n_joint") / F.greatest("n_term", "n_joint")
    by_chance = F.least(F.col("n_value") / F.lit(total), F.lit(1 - 1e-9))
    own = -F.log(by_chance)
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - by_chance))).otherwise(0.0)
    evidence = F.when(share > by_chance, F.col("n_term") * (share * F.log(share / by_chance) + rest)).otherwise(0.0)
    sure = both.where(evidence >= math.log(tried / chance))
    scored = sure.select("term", ((F.log(share) + own) / own).alias("disclosure")).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    action = F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")
    return scored.where(F.col("disclosure") >= generalise).select("term", "disclosure", action.alias("action"))


def _acts(action: str):
    return lambda t: t["action"] == action


def _any_of(terms: Column) -> Column:
    """A pattern of whole words, of chains of character pairs, and of single characters that stand alone."""
    dense = F.filter(terms, lambda t: t.rlike(f"^[{DENSE}]"))
    words = F.filter(terms, lambda t: ~t.rlike(f"^[{DENSE}]"))
    pairs, alone = F.filter(dense, lambda t: F.length(t) > 1), F.filter(dense, lambda t: F.length(t) == 1)
    word, run = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{DENSE}]]", f"[{DENSE}]"

    def joined(own: Column, before: str, after: str) -> Column:
        return F.when(F.size(own) > 0, F.concat(F.lit(before), F.array_join(F.transform(own, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|"), F.lit(after)))

    return F.concat_ws("|", F.lit(r"(?iu)(?!)"), joined(words, rf"(?<!{word})(?:", rf")(?!{word})"), joined(pairs, "(?:(?=", ").)++."), joined(alone, f"(?<!{run})(?:", f")(?!{run})"))


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """``df`` with ``spans``: personal data and disclosing terms of every row, as code point spans.

    ``spans`` is array<struct<kind, start, end, hit>>: the base kinds as listed, then ``term``
    spans, whose hit is the action taken (``remove`` or ``generalise``). Null text counts as
    empty and has no spans. Rows with equal or null ids each keep their row; a column named spans
    is replaced; an empty table gives an empty result. ``thresholds`` go to ``disclosed_terms``.
    """
    shape = "array<struct<kind:string,start:bigint,end:bigint,hit:string>>"
    df = df.drop("spans")
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = df.withColumn("spans", base_spans(words).cast(shape))
    texts = df.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    held = saved(found.where(F.size("spans") > 0).select(words.alias("text"), "spans"), "spans")
    flagged = saved(disclosed_terms(held, texts, **thresholds), "terms")
    few = flagged.count()
    if not few:
        return found
    own_terms, own_doc = fresh(df, "_terms", "_doc")
    held_by = texts.select("doc", F.explode(F.array_distinct(_units(F.col("text")))).alias("term"))
    by_doc = bounded_join(held_by, flagged.select("term", "action"), ["term"], few, FEW_TERMS).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("action", "term"))).alias(own_terms))
    joined = found.join(by_doc.withColumnRenamed("doc", own_doc), F.col(doc_id).eqNullSafe(F.col(own_doc)), "left")
    added = F.array().cast(shape)
    for action in ("generalise", "remove"):
        own = F.transform(F.filter(own_terms, _acts(action)), lambda t: t["term"])
        pattern = _any_of(own)
        hits = matches(words, pattern, F.size(own) > 0)
        added = F.concat(added, F.transform(hits, _span(F.lit(TERM), F.lit(action))))
    in_order = F.array_sort(added, lambda a, b: (a["start"] - b["start"]).cast("int"))
    terms = F.when(F.col(own_terms).isNotNull(), in_order).otherwise(F.array().cast(shape))
    return joined.withColumn("spans", F.concat("spans", terms).cast(shape)).select(*df.columns, "spans")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; terms to remove leave nothing.

    Overlapping spans are replaced together under the label of the one that begins first.
    """
    return replaced(text, spans, lambda s: F.when((s["kind"] == TERM) & (s["hit"] == "remove"), "").otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))


def replaced(text: Column, spans: Column, label) -> Column:
    """The text with every span, or run of overlapping spans, replaced by the label of its first one."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.array(between, label(s)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, end)).otherwise(text)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
