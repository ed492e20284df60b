"""Exact similarity joins and complete entity resolution against all-pairs comparison."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lensdq.operators import match, relate, simjoin


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _ratio(a, b, ratio):
    if ratio == "indel":
        return 200.0 * _lcs(a, b) / (len(a) + len(b))
    return (1 - _lev(a, b) / max(len(a), len(b))) * 100


def _names(rng, n):
    out = [f"Customer#{i:06d}" for i in range(n)]
    out += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    words = ["red", "blue", "green", "ivory", "olive", "peach"]
    for _ in range(n):
        s = list(" ".join(rng.choice(words) for _ in range(3)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(s))
            s[at : at + 1] = rng.choice(["", "x", s[at] + "é"])
        out.append("".join(s))
    return sorted(set(out) - {""})


@pytest.mark.parametrize("threshold,ratio,few", [(85.0, "levenshtein", 4), (85.0, "levenshtein", 10_000), (60.0, "levenshtein", 300), (95.0, "indel", 20), (75.0, "indel", 10_000), (30.0, "levenshtein", 2000)])
def test_every_similar_pair_is_found(spark, threshold, ratio, few):
    names = _names(random.Random(4), 40 if threshold > 50 else 20)
    groups = [(g, s) for g in ("x", "y") for s in (names if g == "x" else names[::3])]
    table = spark.createDataFrame([(g, s, 0, 0) for g, s in groups] + [("x", "", 0, 0), ("x", None, 0, 0)], "grp string, s string, side int, meet int")
    found = {(r["grp"], *sorted((r["a"], r["b"]))) for r in simjoin.similar_strings(table, threshold, ratio, few).collect()}
    want = {(g, *sorted((a, b))) for g in ("x", "y") for a, b in itertools.combinations([s for h, s in groups if h == g], 2) if _ratio(a, b, ratio) >= threshold - 1e-9}
    assert found == want and want


def test_two_tables_meet(spark):
    names = _names(random.Random(6), 25)
    left, right = names[::2], names[1::2] + names[:4]
    table = spark.createDataFrame([("", s, 0, 1) for s in left] + [("", s, 1, 0) for s in right], "grp string, s string, side int, meet int")
    found = {frozenset((r["a"], r["b"])) for r in simjoin.similar_strings(table, 70.0, few=50).collect()}
    assert found == {frozenset((a, b)) for a in left for b in right if a != b and _ratio(a, b, "levenshtein") >= 70}


def test_similar_to_nothing(spark):
    empty = spark.createDataFrame([], "grp string, s string, side int, meet int")
    assert simjoin.similar_strings(empty, 80.0).count() == 0
    with pytest.raises(ValueError):
        simjoin.similar_strings(empty, 0)


def test_dealt_join_keeps_every_pair(spark):
    left = spark.createDataFrame([(k, i) for k in (0, 0, 0, 1) for i in range(30)], "key int, x int")
    right = spark.createDataFrame([(k, i) for k in (0, 2) for i in range(50)], "key int, y int")
    joined = simjoin.dealt_join(left, right, "key", few=9)
    assert collections.Counter(map(tuple, joined.collect())) == collections.Counter((0, x, y) for _ in range(3) for x in range(30) for y in range(50))


@pytest.mark.parametrize("ratio", ["levenshtein", "indel"])
def test_duplicates_of_a_block_with_all_records(spark, ratio):
    """Every record in one block, a third of them copies: equal to comparing all pairs."""
    rng = random.Random(3)
    stock = ["cor lamp", "cor lamb", "cor table small", "cor tabel small", "cor chair", "cor chairs"]
    rows = [(i, rng.choice(stock) + rng.choice(["", " x", " 12"]), rng.choice(["STEEL", "STEAL", "brass", "", None])) for i in range(120)]
    rows += [(i, "cor copy", "COPY") for i in range(120, 180)] + [(None, "cor copy", "COPY"), (500, None, None), (501, "", "brass"), (502, None, "brass")]
    members, pairs = match.all_duplicates(spark.createDataFrame(rows, "id bigint, name string, kind string"), "id", ["name", "kind"], ratio=ratio)
    sort = lambda s: " ".join(sorted((s or "").split()))
    classes = {}
    for i, name, kind in rows:
        if i is not None and (sort(name) or sort(kind)):
            classes.setdefault(((name or "")[:3].lower(), sort(name), sort(kind)), []).append(i)
    want = set()
    for (b1, *k1), (b2, *k2) in itertools.combinations(classes, 2):
        scores = [_ratio(x, y, ratio) for x, y in zip(k1, k2) if x and y]
        if b1 == b2 and scores and sum(scores) / len(scores) >= 85:
            want.add(tuple(sorted((min(classes[b1, *k1]), min(classes[b2, *k2])))))
    found = [(r["id_a"], r["id_b"]) for r in pairs.collect()]
    assert set(found) == want and len(found) == len(want) and want
    assert {(r["id"], r["class_id"]) for r in members.collect()} == {(i, min(own)) for own in classes.values() for i in own}


@pytest.mark.parametrize("threshold", [60.0, 80.0])
def test_name_resolution_at_any_threshold(spark, threshold):
    names = _names(random.Random(12), 40)
    left, right = names[::2], names[1::2]
    got = {r["name"]: (r["candidate"], r["score"]) for r in relate.resolve_names(spark.createDataFrame([(n,) for n in left], "name string"), spark.createDataFrame([(n,) for n in right], "candidate string"), threshold=threshold).where(F.col("method") == "fuzzy_token_sort").collect()}
    sort = lambda s: " ".join(sorted(s.split()))
    for name in left:
        best = min(((-round(_ratio(sort(name), sort(c), "levenshtein"), 1), c) for c in right), default=None)
        if name in got:
            assert got[name] == (best[1], -best[0])
        elif -best[0] >= threshold:
            assert any(c.lower() == name.lower() for c in right)
