"""Dependencies between columns, and walks from many starts, against plain Python."""

import random
from itertools import combinations

from lensdq.operators import lineage, profile
from lensdq.operators.dependencies import dependencies


def _holds(rows, left, right):
    seen = {}
    for r in rows:
        if r[right] is not None and all(r[c] is not None for c in left):
            seen.setdefault(tuple(r[c] for c in left), set()).add(r[right])
    return bool(seen) and all(len(v) == 1 for v in seen.values())


def _minimal(rows, columns, most):
    out = set()
    for width in range(1, most + 1):
        for left in combinations(columns, width):
            for right in columns:
                if right in left or len({r[right] for r in rows} - {None}) < 2:
                    continue
                if any(set(k) <= set(left) and r == right for k, r in out):
                    continue
                parts_unique = width > 1 and any(len({r[c] for r in rows} - {None}) == sum(r[c] is not None for r in rows) for c in left)
                if not parts_unique and _holds(rows, left, right):
                    out.add((left, right))
    return out


def test_dependencies_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        city, day = rng.randrange(400), rng.randrange(90)
        rows.append({
            "id": f"i{i}", "city": f"c{city}", "land": f"l{city % 20}", "day": f"d{day}", "price": f"{city * 7919 % 97}-{day * 31 % 89}",
            # Nearly determined: one breach; a hot value with a third of all rows; nulls; a constant.
            "near": f"n{city % 50}" if i != 1234 else "other", "hot": "h" if i % 3 == 0 else f"h{i % 700}", "part": f"p{city % 9}" if i % 4 else None, "same": "x",
        })
    columns = list(rows[0])
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns)).repartition(6)
    got = {(tuple(r["determinant"]), r["dependent"]) for r in dependencies(df).collect()}
    assert got == _minimal(rows, columns, 2)
    assert (("city", "day"), "price") in got and (("city",), "land") in got and (("city",), "near") not in got
    pairs = {(r["parent"], r["child"]) for r in profile.hierarchies(df).collect()}
    n = {c: len({r[c] for r in rows} - {None}) for c in columns}
    assert pairs == {(p, c) for c in columns for p in columns if p != c and n[c] > 2 * n[p] and _holds(rows, (c,), p)}


def test_dependencies_of_odd_tables(spark):
    assert dependencies(spark.createDataFrame([], "a string, b int")).collect() == []
    apart = spark.createDataFrame([("x", None), ("y", None), (None, "u"), (None, "v")], "a string, b string")
    assert dependencies(apart).collect() == []
    names = spark.createDataFrame([(i % 4, i % 2, float("nan")) for i in range(40)], "`a.b` int, `key` int, side double")
    assert [(r[0], r[1]) for r in dependencies(names).collect()] == [(["a.b"], "key")]


def test_many_starts_equal_one_walk_each(spark):
    rng = random.Random(8)
    links = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)} | {(f"m{i}", f"m{i + 1}") for i in range(10)} | {("m10", "m0"), ("n0", "n0")}
    edges = spark.createDataFrame([(a, b, "feeds") for a, b in links] + [(None, "n1", "feeds"), ("n1", None, "feeds")], lineage.EDGE)
    nodes = spark.createDataFrame([(x, "table" if x[0] == "m" else "column", x) for x in sorted({x for e in links for x in e})], lineage.NODE)

    def walk(start, depth):
        far, front = {start: 0}, [start]
        while front and (depth is None or far[front[0]] < depth):
            front = sorted({b for a, b in links if a in front and b not in far})
            for x in front:
                far[x] = max(far.values()) + 1 if x == front[0] else far[front[0]]
        return {k: v for k, v in far.items() if v}

    starts = [x for x in sorted({x for e in links for x in e})]
    frame = spark.createDataFrame([(s,) for s in [*starts, "m0", None, "stranger"]], "id string")
    for depth in (None, 4):
        rows = lineage.reachable_from(edges, frame, depth=depth).collect()
        want = {(s, k): v for s in starts for k, v in walk(s, depth).items()}
        assert {(r["start"], r["id"]): r["distance"] for r in rows} == want and len(rows) == len(want)
        for r in rows:
            before = [a for a, b in links if b == r["id"] and ((r["start"], a) in want or a == r["start"]) and want.get((r["start"], a), 0) == r["distance"] - 1]
            assert r["via"] == min(before)
    told = {r["impacted_node"]: r for r in lineage.impacts(edges, nodes, frame).collect()}
    assert told["m0"]["tables"] == 10 and told["m0"]["depth"] == 10 and told["m0"]["impact_severity"] == "MEDIUM"
    assert told["stranger"]["total_downstream"] == 0 and told["stranger"]["impact_severity"] == "LOW"
