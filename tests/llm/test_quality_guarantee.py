"""Certified quality cutoffs: recomputed from the labels, and their guarantee in seeded draws."""

import os

import numpy as np
import pytest

from lensdq.llm import quality

BASE = "/root/testdata/sf0.1"


def _bound_by_bisection(k, n, level):
    """Clopper-Pearson upper bound from the plain binomial sum."""
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if quality.binomial_tail(k, n, p) > level:
            low = p
        else:
            high = p
    return high


def test_step_is_the_last_in_order_under_the_bound():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 2_000))
        good = np.minimum(np.sort(rng.integers(0, 14, 13)), n).tolist()
        bad = np.sort(rng.integers(0, 9, 13)).tolist()
        most = 0
        while most < 13 and _bound_by_bisection(good[most], n, 0.0125) <= 0.01:
            most += 1
        want = 0 if not most or not bad[most - 1] else min(i for i in range(most) if bad[i] == bad[most - 1]) + 1
        assert quality.certified_step(good, bad, n, 0.01, 0.0125) == want
    assert quality.certified_step([0] * 13, [1] * 13, 0, 0.01, 0.05) == 0


def test_guarantee_holds_in_seeded_draws():
    rng = np.random.default_rng(11)
    # True shares of good documents that the steps reject; the fifth and later ones break the risk.
    shares = np.array([0.0, 0.001, 0.004, 0.008, 0.0101, 0.012, 0.02, 0.03, 0.05, 0.1, 0.2, 0.3, 0.5])
    broken = certified = 0
    for _ in range(1_000):
        n = 3_000
        seen = rng.random(n)
        good = [(seen < s).sum() for s in shares]
        step = quality.certified_step(good, list(range(1, 14)), n, 0.01, 0.05)
        certified += step > 0
        broken += step > 0 and shares[step - 1] > 0.01
    assert certified == 1_000 and broken <= 50 + 3 * (1_000 * 0.05 * 0.95) ** 0.5


@pytest.mark.skipif(not os.path.isdir(BASE), reason="driver tables not present")
def test_cutoffs_of_the_labels_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{BASE}/{t}.parquet") for t in ("documents", "labels"))
    measured = quality.measure(docs).cache()
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in quality.certified_cutoffs(measured, labels).collect()}
    marks = {}
    for r in labels.collect():
        if r["quality"] is not None and r["doc_id"] is not None:
            marks[r["doc_id"]] = min(marks.get(r["doc_id"], 1), int(r["quality"] > 0))
    names = list(quality.RULES)
    by = {}
    for r in measured.select("doc_id", "stratum", *[s.alias(n) for n, s in quality.scores().items()]).collect():
        if r["doc_id"] in marks:
            by.setdefault(r["stratum"], []).append((marks[r["doc_id"]], [r[n] or 0.0 for n in names]))
    want = {}
    for stratum, rows in by.items():
        hit = lambda at, of: [any(x[j] >= quality.RULES[names[j]][at] for j in of) for _, x in rows]
        n, best = sum(g for g, _ in rows), None
        for at in range(13):
            every = hit(at, range(len(names)))
            if _bound_by_bisection(sum(h and g for h, (g, _) in zip(every, rows)), n, 0.05 / len(by)) > 0.01:
                break
            bad = sum(h and not g for h, (g, _) in zip(every, rows))
            if bad and (best is None or bad > best[0]):
                best = bad, at
        for j, name in enumerate(names):
            if best and any(h and not g for h, (g, _) in zip(hit(best[1], [j]), rows)):
                want[stratum, name] = quality.RULES[name][best[1]]
    assert got == want
    print({s: (len(r), sum(g for g, _ in r)) for s, r in by.items()}, got)
