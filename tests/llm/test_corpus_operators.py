"""Every corpus operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from lensdq.llm import ann, bpe, langid, licenses, mixing, neardup, pii, quality, rollup, sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_2 string, spans int, term string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _prose(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    stock = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sti", "pol", "vax") for c in ("o", "es", "um")]
    out = []
    for i in range(60):
        out.append((i, _prose(rng, rng.randint(8, 120), stock), ["en", "fr", None][i % 3], f"src{i % 4}" if i % 9 else None))
    base = _prose(rng, 150, stock).split()
    for i in range(60, 75):  # near copies of one text: a word or two changed
        words = list(base)
        for _ in range(i % 3):
            words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words), "en", "src1"))
    out += [(i, "Same text in many rows, one two three four five six seven eight.", "en", "hot") for i in range(75, 110)]
    out += [(200, None, "en", "src0"), (201, "", None, None), (202, " \t\n ", "fr", "src1"), (203, "one two", "en", "src1"), (204, "ONE  two", "en", "src1"), (203, "one two", "en", "src1"), (None, "one two", "en", "src1")]
    out += [(205, "x" * 30_000, "en", "src2"), (206, ("wort " * 4_000).strip(), "en", "src2"), (207, "### $$$ %%%\n### $$$ %%%", "en", "src3"), (208, "née \U0001f600 ’tis <|endoftext|> don't  12３4 x\x1cy\r\n", "fr", "src3")]
    return [(*r, None if r[1] is None else len(r[1]), "clash", 7, "clash") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _sorted(it):
    return sorted(it, key=repr)


# 1. Byte-level BPE


def test_bpe_matches_reference_encoder_and_decodes(docs, rows, ranks):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, block_chars=2_000)
    got = bpe.digests(encoded, ranks).collect()
    want = []
    for doc, text, *_ in rows:
        ids = own.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert _sorted(map(tuple, got)) == _sorted(want)


def test_bpe_long_words_merge_like_short_ones(ranks):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for n in (1, 5, 99, 100, 101, 700):
        word = "".join(rng.choice("abcdeéthin") for _ in range(n))
        assert bpe.merge_word(word.encode(), ranks) == own.encode_ordinary(word)
        assert bpe._merge_long(word.encode(), ranks) == own.encode_ordinary(word)


def test_bpe_decode_of_null_unknown_and_no_ids(spark, ranks):
    df = spark.createDataFrame([(1, [31373]), (2, []), (3, None), (4, [999_999]), (5, [-1])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(df, ranks).collect()}
    assert got == {1: bytearray(b"hello"), 2: bytearray(b""), 3: None, 4: None, 5: None}


def test_bpe_empty_table(empty, ranks):
    assert bpe.digests(bpe.encode(empty, ranks, public_tokenizers.PATTERN), ranks).collect() == []


# 2. Licenses


def test_license_families_and_unknown(spark, docs, rows, empty):
    notes = {1000: "Some prose first.\nReleased under the MIT License.", 1001: "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", 1002: "This work is licensed under the GNU General Public License, version 3.", 1003: "nothing of the kind"}
    extra = spark.createDataFrame([(k, v, "en", "s", 1, "c", 1, "c") for k, v in notes.items()], DOCS)
    whole = docs.unionByName(extra)
    model = licenses.fit(spark)
    found = licenses.scan(whole, model).collect()
    assert len(found) == len(rows) + len(notes)
    by = {r["doc_id"]: r for r in found}
    assert by[1000]["families"] == "mit" and by[1000]["places"] == "1:mit" and by[1000]["n_paragraphs"] == 2
    assert by[1001]["families"] == "apache-2.0,cc-by-nc"
    assert by[1002]["families"] == "gpl"
    assert all(not r["families"] for r in found if r["doc_id"] not in (1000, 1001, 1002))
    assert by[200]["n_paragraphs"] == by[201]["n_paragraphs"] == 0
    assert licenses.scan(empty, model).collect() == []
    assert licenses.scan(empty, licenses.fit(spark, {})).collect() == []
    only = licenses.scan(extra, licenses.fit(spark, {})).collect()
    assert all(not r["families"] for r in only) and {r["doc_id"]: r["n_unknown"] for r in only}[1000] <= 1


def test_unlisted_licenses_are_unknown(spark):
    unlisted = ["Released under the Foo Public License, see the file.", "Licensed under the Artistic License 2.0.", "This project is licensed under the Eclipse Public License 2.0", "Licensed under the Boost Software License, Version 1.0.", "Released under the GNU Foo License", "Released under the ISC License.", "Licence: EUPL-1.2"]
    plain = ["Ein Mann ging mit dem Hund.", "They met in the hall and sat by the window.", "Mit und ohne.", "La maison est grande.", "12 34 56", "This is the work of a general."]
    known = {"SPDX-License-Identifier: MIT": "mit", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Copyright 2019 Foo Inc. All rights reserved.": "proprietary"}
    lines = [*unlisted, *plain, *known]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    model = licenses.fit(spark)
    got = {r["doc_id"]: r for r in licenses.scan_paragraphs(df, model).collect()}
    for i, line in enumerate(lines):
        want = "unknown" if line in unlisted else known.get(line)
        assert got[i]["family"] == want, line
    assert 0.5 <= model.cutoff < 1

    # Likeness against the same sums in plain Python.
    def grams(text):
        words = regex.findall(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*", text.lower())
        return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}

    classes = {**{f: [grams(t) for t in ts] for f, ts in model.templates.items()}, "unknown": [grams(t) for t in licenses.UNLISTED], "none": [grams(t) for t in licenses.PLAIN]}
    users = collections.Counter(g for sets in classes.values() for g in set().union(*sets))
    weight = {g: math.log(len(classes) / n) for g, n in users.items()}
    most = max(weight.values())
    for i, line in enumerate(lines):
        if line in known:
            own, best = grams(line), 0.0
            for t in classes[known[line]]:
                lighter = min(sum(weight.get(g, most) for g in own), sum(weight[g] for g in t))
                best = max(best, sum(weight[g] for g in own & t) / lighter)
            assert got[i]["likeness"] == pytest.approx(best)


# 3. Personal data

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _base(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True, "ip": lambda h=m.group(): all(int(p) <= 255 for p in h.split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and _luhn(d), "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


PRIVATE = [
    "a@b.com_x@c.d, a@b@c.de ..@x.y x@y", "1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1 1.2.3", "é\U0001f600 4111 1111 1111 1111 4111-1111-1111-1112 4111--1111",
    "+1 (23) 45-678.9 +12 +123 456 789 012 345 678 +1", "9" * 12_000 + " " + "a" * 12_000 + "@x.y +1" + " " * 3_000, "", None, "٣@x.y mail@ex.org",
]


def test_pii_base_spans(spark, empty):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(PRIVATE)] + [(None, "q@q.qq", "c"), (0, PRIVATE[0], "c")], "doc_id int, text string, spans string")
    for r in pii.find(df).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == _base(r["text"] or "")
    assert pii.find(empty).collect() == []


def test_pii_terms_that_give_a_value_away(spark):
    rng = random.Random(5)
    filler = [f"word{c}{d}{e}" for c in "abcdefgh" for d in "klmnop" for e in "qrstuvw"]
    secret = [(i, f"{_prose(rng, 4, filler)} Quetzalcoat {_prose(rng, 3, filler)} boss@corp.example {_prose(rng, 7, filler)}") for i in range(40)]
    plain = [(100 + i, _prose(rng, 30, filler)) for i in range(200)]
    hint = [(900, "Nobody but Quetzalcoat knows.")]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(secret + plain + hint, "doc_id int, text string")).withColumn("clean", pii.sanitised(F.col("text"), F.col("spans"))).collect()}
    gone = pii.find(spark.createDataFrame(secret + plain + hint, "doc_id int, text string"), remove=0.9).where("doc_id = 900").select(pii.sanitised(F.col("text"), F.col("spans"))).first()
    assert gone[0] == "Nobody but  knows."
    assert [(s["kind"], s["start"], s["end"], s["hit"]) for s in found[900]["spans"]] == [("term", 11, 22, "generalise")]
    assert found[900]["clean"] == "Nobody but <TERM> knows."
    assert all("Quetzalcoat" not in found[i]["clean"] and "<EMAIL>" in found[i]["clean"] for i in range(40))
    assert all(not found[100 + i]["spans"] for i in range(200))


def test_pii_copies_of_one_text_are_one_piece_of_evidence(spark):
    df = spark.createDataFrame([(i, "rareword stands beside me@here.example all along") for i in range(40)] + [(99, "rareword alone")] + [(i, f"other text {i}") for i in range(100, 160)], "doc_id int, text string")
    assert {s["kind"] for r in pii.find(df).collect() for s in r["spans"]} == {"email"}


def _flagged(spark, texts, **thresholds):
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3), **thresholds)
    return {(r["text"] or "")[s["start"] : s["end"]].lower() for r in found.collect() for s in r["spans"] if s["kind"] == "term"}


def _letters(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))


def test_pii_equal_lines_of_different_documents_count_each(spark):
    rng = random.Random(21)
    line = "Regards, Marabunta, head office, ring marabunta.x@corp.example any day"
    signed = [f"{_letters(rng, 60)}\n{line}" for _ in range(12)]
    rest = [_letters(rng, 60) + " regards head office ring any day" for _ in range(150)]
    assert _flagged(spark, signed + rest) == {"marabunta"}


def test_pii_copies_weigh_one_on_both_sides(spark):
    rng = random.Random(22)
    held = [f"{_letters(rng, 40)} Marabunta wrote from q.x@corp.example {_letters(rng, 40)}" for _ in range(5)]
    copies = [held[0]] * 200
    near = [" ".join(w if i != 10 + k % 30 else f"edit{k}" for i, w in enumerate(held[1].split())) for k in range(60)]
    rest = [_letters(rng, 80) + " wrote from" for _ in range(150)]
    assert _flagged(spark, held + copies + near + rest) == {"marabunta"}
    # Near copies alone are one document, whatever their number.
    assert _flagged(spark, near + rest) == set()


def test_pii_chance_does_not_flag_rare_words_beside_a_frequent_value(spark):
    rng = random.Random(23)
    often = [f"{_letters(rng, 40)} {'odd word' if i < 3 else 'some'} help.desk@corp.example {_letters(rng, 40)}" for i in range(150)]
    rest = [_letters(rng, 80) for _ in range(60)]
    assert not {"word"} & _flagged(spark, often + rest)


def test_pii_terms_of_any_length_and_script_anywhere_in_the_document(spark):
    rng = random.Random(24)
    names = ["Kim", "x7q9", "Ng", "\u738b\u5c0f\u660e"]
    held = [f"{name} heads this page\n{_letters(rng, 150)}\nmail box{k}@corp.example" for k, name in enumerate(names) for _ in range(8)]
    rest = [f"heads this page mail {_letters(rng, 150)}\n\u5929\u6c14\u5f88\u597d" for _ in range(150)]
    found = pii.find(spark.createDataFrame(list(enumerate([*held, *rest])), "doc_id int, text string").repartition(3)).withColumn("clean", pii.sanitised(F.col("text"), F.col("spans"))).collect()
    assert {r["text"][s["start"] : s["end"]] for r in found for s in r["spans"] if s["kind"] == "term"} == set(names)
    assert all(not r["spans"] for r in found if r["doc_id"] >= len(held))
    assert all(not any(n in r["clean"] for n in names) for r in found)


# 4. Near-duplicates


def _shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def _components(rows, percent):
    sets = [_shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[root(i)] = root(j)
    low = collections.defaultdict(list)
    for i, r in enumerate(rows):
        low[root(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [x for x in low[root(i)] if x is not None]
        comp = (min(ids) if ids else None) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), comp, comp == r[0]))
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_all_pairs(docs, rows, percent):
    got = neardup.near_duplicates(docs, percent).collect()
    assert _sorted(map(tuple, got)) == _sorted(_components(rows, percent))


def test_near_duplicates_chain_and_star(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[6 * i : 6 * i + 120])) for i in range(12)]
    hub = [rng.choice(words) for _ in range(200)]
    star = [(100, " ".join(hub))]
    for i in range(1, 60):
        own = list(hub)
        own[rng.randrange(200)] = f"x{i}"
        own[rng.randrange(200)] = f"y{i}"
        star.append((100 + i, " ".join(own)))
    rows = chain + star
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), 85).collect()
    assert _sorted(map(tuple, got)) == _sorted(_components(rows, 85))


def test_near_duplicates_empty_tables(spark, empty):
    assert neardup.near_duplicates(empty).collect() == []
    blank = spark.createDataFrame([(1, ""), (2, None), (2, None)], "doc_id int, text string")
    assert _sorted(map(tuple, neardup.near_duplicates(blank).collect())) == _sorted([(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)])


def test_odd_sketch_estimate_is_near_the_similarity():
    import pyarrow as pa

    rng, samples = random.Random(4), 28 * neardup.ROWS_PER_BAND
    for share in (0.5, 0.85, 0.95):
        words = [str(rng.random()) for _ in range(3_000)]
        other = list(words)
        cut = int(len(words) * (1 - share) / (1 + share))
        other[:cut] = [str(rng.random()) for _ in range(cut)]
        batch = pa.record_batch([pa.array([1, 2]), pa.array([" ".join(words).encode(), " ".join(other).encode()])], ["doc_id", "text"])
        found = next(neardup._signatures(iter([batch]), 28, pa.int64())).to_pylist()
        differing = sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(found[0]["sketch"], found[1]["sketch"], strict=True))
        estimate = 1 + math.log(1 - 2 * differing / neardup.SKETCH_BITS) * neardup.SKETCH_BITS / 4 / samples
        assert abs(estimate - share) < 0.12


# 5. Quality


def test_quality_measures_against_brute_force(docs, rows):
    got = {}
    for r in quality.measure(docs).collect():
        got[(r["doc_id"], r["n_words"])] = r
    for doc, text, *_ in rows:
        text = text or ""
        words, seen, again = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        r = got[(doc, len(words))]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered))


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.3), (400, 0.01), (2_000, 0.0025)):
        for k in (0, 1, int(n * p), int(n * p) + 3, n - 1, n):
            terms = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1))
            want = math.fsum(math.exp(t) for t in terms)
            assert quality.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_quality_cutoffs_reject_bad_and_respect_the_risk(spark, docs, empty):
    rng = random.Random(8)
    body = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    many, labels = [], []
    for i in range(6_000):
        bad = i % 10 == 0
        words = [rng.choice(body) for _ in range(40)]
        many.append((i, " ".join(w + "#" if bad and j % 3 == 0 else w for j, w in enumerate(words)), "en" if i % 4 < 2 else None))
        labels.append((i, 0 if bad else 1))
    df, marks = spark.createDataFrame(many, "doc_id int, text string, lang string"), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id int, quality int")
    out = quality.judge(df, marks, risk=0.02).collect()
    assert not any(r["kept"] for r in out if r["doc_id"] % 10 == 0) and {tuple(r["rejected_by"]) for r in out} == {(), ("symbol_share",)}
    assert all(r["kept"] or r["base_failed"] for r in out if r["doc_id"] % 10)
    none = quality.judge(docs, marks.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] and not r["rejected_by"] for r in none)
    assert quality.judge(empty, marks).collect() == []


# 6. Shards


def test_hilbert_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (4, 1)):
        side = 1 << bits
        cells = list(itertools.product(range(side), repeat=n))
        df = spark.createDataFrame(cells, ", ".join(f"a{i} int" for i in range(n)))
        rows = sorted(df.withColumn("h", sharding.hilbert_index([F.col(f"a{i}") for i in range(n)], bits)).collect(), key=lambda r: r["h"])
        assert [r["h"] for r in rows] == list(range(len(cells)))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in itertools.pairwise(rows))


def test_shards_are_even_gapless_and_prune(spark, docs, rows, empty):
    sized = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    for shards in (1, 7, 16, 500):
        out = sharding.shard(sized, ["lang", "source", "size"], shards, ["doc_id", "text"]).collect()
        assert len(out) == len(rows)
        count = collections.Counter(r["shard"] for r in out)
        every = [count.get(s, 0) for s in range(shards)]
        assert max(every) - min(every) <= 1 and set(count) <= set(range(shards))
        for s in count:
            assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(count[s]))
    assert sharding.shard(empty, ["lang", "n_chars"], 4, ["doc_id"]).collect() == []
    grid = spark.range(4096).select("id", (F.col("id") % 64).alias("a"), F.floor(F.col("id") / 64).alias("b"))
    spans = sharding.shard(grid, ["a", "b"], 16, ["id"]).groupBy("shard").agg((F.max("a") - F.min("a")).alias("a"), (F.max("b") - F.min("b")).alias("b")).collect()
    assert all(r["a"] <= 40 and r["b"] <= 40 for r in spans) and len(spans) == 16


# 7. Mixing


def _targets(sizes, weights=(1, 2, 3)):
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(fixed.values()), [s for s in order if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix_meets_targets_and_repeats(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken = _targets(sizes), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    longest = {s: max(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, longest[s])
    assert _sorted(map(tuple, got)) == _sorted(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_budget_fit_is_the_best_subset_sum():
    rng = random.Random(6)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), rng.randint(1, 5))
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 60)
        sums = {sum(n * x for n, x in zip(pick, lengths, strict=True)) for pick in itertools.product(*[range(c + 1) for c in counts])}
        taken = mixing.fill_budget(budget, lengths, counts)
        assert sum(k * v for k, v in taken.items()) == max(s for s in sums if s <= budget)
        assert all(v <= counts[lengths.index(k)] for k, v in taken.items())


# 8. Nearest vectors


def _nearest(rows, k):
    out = []
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8:
            good[i] = np.array(v, np.float32).astype(np.float64)
    for q in sorted(x for x in good if x % 100 == 0):
        near = sorted((math.dist(good[q], v), i) for i, v in good.items() if i != q)[:k]
        out.extend((q, r + 1, i, d) for r, (d, i) in enumerate(near))
    return out


def test_nearest_vectors_recall_ties_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(3_000)]
    rows += [(i, [0.5] * 8) for i in range(4_000, 5_500)]  # one vector, very often
    rows += [(6_000, None), (6_100, []), (6_200, [0.0] * 8), (6_300, [float("nan")] * 8), (6_400, [1.0] * 5), (6_500, [None] * 8), (6_600, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (100, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>").repartition(4)
    monkeypatch.setattr(ann, "PARTITION_ROWS", 150)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 5)
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    want = _nearest(rows, 10)
    assert [(r["query_id"], r["rank"]) for r in sorted(got)] == [w[:2] for w in want]
    hits = {w[::2]: w[3] for w in want}
    assert sum((r["query_id"], r["vec_id"]) in hits for r in got) >= 0.9 * len(want)
    copies = [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got) if r["query_id"] == 4_000]
    assert copies == [(i + 1, 4_001 + i, 0.0) for i in range(10)]
    vectors = dict(rows)
    for r in got[::7]:
        assert r["score"] == pytest.approx(math.dist(np.float32(vectors[r["query_id"]]), np.float32(vectors[r["vec_id"]])), rel=1e-12)


def test_nearest_with_few_or_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 2.5]), (7, [3.0, 2.0])], "vec_id int, embedding array<float>")
    assert [r["vec_id"] for r in sorted(ann.nearest(few, F.col("vec_id") % 100 == 0).collect())] == [5, 7]
    assert ann.nearest(few.limit(0), F.col("vec_id") % 100 == 0).collect() == []


# 9. Languages


def _language_rows():
    rng = random.Random(9)
    parts = {"aa": ["tho", "ing", "ed", "wh", "and"], "bb": ["eau", "oi", "que", "ch", "ent"], "cc": ["sch", "ung", "ber", "ein", "lich"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(5, 60)), lang) for i, lang in enumerate(rng.choice(sorted(parts)) for _ in range(600))]
    return rows, text


def test_language_accuracy_mixtures_and_undetermined(spark, docs, empty):
    rows, text = _language_rows()
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = langid.fit(df.where("doc_id % 3 <> 1"), sample_docs=100)
    assert model.languages == ["aa", "bb", "cc"]
    held = langid.identify(df.where("doc_id % 3 = 1"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 + 34 !"), (4, text("aa", 200) + " " + text("bb", 150)), (5, "Q9zX" * 2000)], "k int, text string")
    out = {r["k"]: r for r in langid.identify(odd, model).collect()}
    assert all((out[i]["lang_pred"], out[i]["score"], out[i]["lang_gain"]) == ("und", 0.0, None) for i in (1, 2, 3))
    assert {s["lang"] for s in out[4]["lang_set"]} == {"aa", "bb"} and out[4]["lang_pred"] == "aa"
    assert out[5]["lang_gain"] <= 0
    assert langid.identify(empty, model).collect() == []
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


# 10. Token rollups


def test_rollup_is_additive_idempotent_and_equals_recount(spark, docs, rows, ranks, tmp_path):
    counted = rollup.count_tokens(docs, {"v1": ranks}, public_tokenizers.PATTERN).cache()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {(r[0], r[1]): len(own.encode_ordinary(r[1] or "")) for r in rows}
    texts = {hashlib.sha256(r[1].encode()).hexdigest() if r[1] is not None else None: r[1] for r in rows}
    assert all(r["tokens"]["v1"] == want[(r["doc_id"], texts[r["digest"]])] for r in counted.collect())
    flat = counted.select("doc_id", "source", "lang", F.lit("v1").alias("tokenizer_version"), F.col("tokens")["v1"].alias("n_tokens"))
    book = rollup.Rollup(spark, f"{tmp_path}/book")
    assert book.totals().collect() == [] and book.committed() == []
    assert book.commit("a", rollup.inserts(flat))
    assert not book.commit("a", rollup.inserts(flat))  # sent again
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    revised = flat.where(even).withColumn("n_tokens", F.col("n_tokens") + 5).withColumn("tokenizer_version", F.lit("v2"))
    assert book.commit("b", rollup.revisions(flat.where(even), revised))
    assert book.commit("c", rollup.deletes(flat.where(~even)))
    assert book.commit("d", rollup.inserts(flat.limit(0)))
    assert book.committed() == ["a", "b", "c", "d"]
    expected = collections.defaultdict(lambda: [0, 0])
    for r in revised.collect():
        at = expected[(r["source"], r["lang"], "v2")]
        at[0] += 1
        at[1] += r["n_tokens"]
    assert {tuple(r)[:3]: list(tuple(r)[3:]) for r in book.totals().collect()} == dict(expected)
    assert rollup.Rollup(spark, f"{tmp_path}/book").committed() == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        book.commit("../x", rollup.inserts(flat))


def test_rollup_counts_of_an_empty_table(empty, ranks):
    assert rollup.count_tokens(empty, {"v1": ranks}, public_tokenizers.PATTERN).collect() == []


def test_letters_follow_the_unicode_property():
    assert regex.search(r"\p{L}", "²٣") is None
