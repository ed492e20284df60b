"""Phrase mining, benchmark passages and periodic runs against brute force and on odd tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from lensdq.llm import neardup, periodic, phrases, queries, winnow

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, d1 int, block string, part string, w int, n int, h string, runs int"
CLASH = ("src", 1, 7, "clash", "clash", 3, 4, "clash", 5)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    stock = ["Red", "red", "fox", "É", "é", "im", "x1", "über", "the", "of", "-", "a\x1cb"]
    text = lambda n: "".join(rng.choice(stock) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0c", " ! "]) for _ in range(n))
    out = [(i, text(rng.choice([1, 3, 30, 80])), ["en", "fr", None, "und"][i % 4]) for i in range(60)]
    passage = text(40)
    out += [(i, "lead " * (i % 4) + passage + " tail", "en") for i in range(60, 90)]
    out += [(i, passage, "en") for i in range(90, 130)]
    out += [(130, None, "en"), (131, "", None), (132, " \t\n.,;", "fr"), (5, "repeated id", "en"), (5, "repeated id", "en"), (None, passage, None), (133, "la " * 3000, "fr"), (134, "ABC" * 5000, "en")]
    return [(*r, *CLASH) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _phrases_by_hand(rows, longest, support, covered):
    f, total = collections.Counter(), collections.Counter()
    for r in rows:
        lang = r[2] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {key: n for key, n in f.items() if n >= support}
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        inside = any(100 * b >= covered * a for (other, q), b in often.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if not inside:
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found))}


@pytest.mark.parametrize("longest,support,block_chars", [(4, 3, 500), (4, 30, 10**6), (5, 4, 3000), (2, 3, 3000)])
def test_phrases_equal_counting_by_hand(docs, rows, longest, support, block_chars):
    counts, totals = phrases.phrase_counts(docs, longest=longest, support=support, block_chars=block_chars, part_words=200)
    found = {tuple(r) for r in phrases.ranked(phrases.collocations(counts, totals, covered=80)).collect()}
    assert found == _phrases_by_hand(rows, longest, support, 80) and found


def test_phrase_products_beyond_64_bits(spark):
    big = 9 * 10**18
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, length int, f bigint")
    got = phrases.collocations(counts, spark.createDataFrame([("en", big)], "lang string, n bigint")).first()
    assert got["score"] == 2_000_000 * (big - 1) // (2 * big)


def test_phrases_cut_to_the_most(docs):
    counts, totals = phrases.phrase_counts(docs, support=3)
    whole = phrases.collocations(counts, totals)
    top = phrases.ranked(whole, most=2).collect()
    assert max(collections.Counter(r["lang"] for r in top).values()) == 2


def test_phrases_of_nothing(empty, docs):
    for df in (empty, docs.where("text is null or text = ''")):
        counts, totals = phrases.phrase_counts(df)
        assert phrases.ranked(phrases.collocations(counts, totals)).count() == 0


def _leaks_by_hand(rows, items, width=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = ITEM_WORD.findall((text or "").translate(LOW))
        k = min(len(words), width)
        for i in range(len(words) - k + 1 if k else 0):
            windows[tuple(words[i : i + k])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for r in rows:
        words = ITEM_WORD.findall((r[1] or "").translate(LOW))
        hit, found = set(), set()
        for k, i in ((k, i) for k in lengths for i in range(len(words) - k + 1)):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found |= windows[tuple(words[i : i + k])]
        out.append((r[0], len(words), len(hit), ",".join(sorted(found))))
    return collections.Counter(out)


def test_contamination_equals_search_by_hand(spark, docs, rows):
    rng = random.Random(8)
    items = []
    for i in range(40):
        words = WORD.findall(rng.choice(rows)[1] or "")
        at = rng.randrange(max(1, len(words)))
        items.append((i, " ".join(words[at : at + rng.choice([1, 3, 9, 10, 11, 25])])))
    items += [(3, "second text of an id"), (100, None), (101, ""), (102, "..."), (None, rows[61][1]), (103, items[5][1]), (103, items[5][1]), (104, "la " * 12), (105, "never seen words stand here in this one item of the set")]
    table = spark.createDataFrame([(*i, 1, "clash", 2) for i in items], "item_id bigint, text string, d1 int, window string, n int")
    found = winnow.contamination(docs, winnow.benchmark_windows(table)).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in found) == _leaks_by_hand(rows, items)
    for r in found:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["stop"] < b["start"] for a, b in itertools.pairwise(r["spans"]))


def test_contamination_by_shuffle_equals_broadcast(spark, docs, rows, monkeypatch):
    table = spark.createDataFrame([(i, rows[i][1]) for i in (2, 61, 95)], "item_id bigint, text string")
    windows = winnow.benchmark_windows(table)
    key = lambda df: sorted(map(repr, df.collect()))
    by_broadcast = key(winnow.contamination(docs, windows))
    monkeypatch.setattr(winnow, "FEW_ROWS", 0)
    assert key(winnow.contamination(docs, windows)) == by_broadcast


def test_contamination_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "a b c"), (2, None)], "item_id bigint, text string")
    assert winnow.contamination(empty, winnow.benchmark_windows(items)).count() == 0
    clean = winnow.contamination(docs, winnow.benchmark_windows(items.where("item_id = 2")))
    assert clean.where("n_hit > 0 or size(items) > 0").count() == 0 and clean.count() == docs.count()


def _runs_by_hand(words, shortest=6, times=4):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(shortest, times * q):
                out.setdefault((start, i + q - start), q)
    return sorted((s, length, q) for (s, length), q in out.items())


def _collapsed_by_hand(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


@pytest.mark.parametrize("block_words", [1, 50, 10**6])
def test_runs_equal_search_by_hand(spark, rows, block_words):
    rng = random.Random(2)
    more = []
    for i in range(300):
        n, k = rng.choice([0, 1, 7, 30, 90]), rng.choice([1, 2, 3, 6])
        words = [rng.choice("abcdef"[:k]) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 12)
            words = [words[j] if j < a else words[min(n - 1, a + (j - a) % p)] for j in range(n)]
        more.append((1000 + i, " ".join(words), "en", *CLASH))
    mine = [r for r in rows if not r[1] or len(r[1]) < 5000] + more
    found = periodic.periodic_runs(spark.createDataFrame(mine, DOCS).repartition(2), block_words=block_words).collect()
    want = collections.Counter()
    for r in mine:
        words = WORD.findall(r[1] or "")
        runs = _runs_by_hand(words)
        want[r[0], len(words), tuple(runs), _collapsed_by_hand(words, runs)] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in found) == want


def test_runs_of_long_texts_and_nothing(spark, empty):
    text = "x " + "la " * 30_000 + "y " + "do re mi " * 10_000
    one = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [tuple(r) for r in one["runs"]] == [(1, 30_000, 1), (30_002, 30_000, 3)]
    assert one["collapsed"] == "x la y do re mi"
    assert periodic.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(empty, times=1)


def test_planted_repeats_and_digests(spark, tmp_path):
    rng = random.Random(9)
    table = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(200)] + [(None, "a a a a a a a"), (300, None)]
    spark.createDataFrame(table, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for doc, text in table:
        words = WORD.findall(text or "")
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = _runs_by_hand(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        r = found[doc]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *best, 1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(_collapsed_by_hand(words, runs).encode()).hexdigest()
    assert planted


def test_near_copies_without_ids_are_linked(spark):
    words = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(7, " ".join(words)), (None, " ".join([*words[:-1], "x"])), (None, " ".join(other)), (None, " ".join(["x", *other[1:]])), (9, "quite another text of some words here")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=80).collect()
    # The near copy of 7 belongs to it and goes; a component without any id has none and stays.
    assert collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in found) == collections.Counter([(7, 7, True), (None, 7, False), (None, None, True), (None, None, True), (9, 9, True)])
