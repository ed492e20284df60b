"""Stages of the pipeline on odd rows, against plain Python."""

import random
import string

import pyarrow as pa
import pytest

import corpus_pipeline
from lensdq.llm import neardup, pii
from lensdq.llm.common import saved

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, _kept string, _rows int"


def _row(doc_id, text):
    return (doc_id, text, "en", "s", len(text or ""), "k", "l", 7)


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _groups(rows):
    """Components of distinct (id, text) by similarity 0.8, texts without words alone."""
    nodes = sorted(set((r[0] is None, r[0] or 0, r[1] or "") for r in rows))
    sets = [_shingles(n[2]) for n in nodes]
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return nodes, [find(i) for i in range(len(nodes))]


def test_one_document_of_each_group_stays_whatever_the_ids(spark):
    base = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(6)]
    near = [b.replace("x30", "y30") for b in base]
    rows = [_row(1, base[0]), _row(None, near[0]), _row(None, base[1]), _row(None, near[1]), _row(2, base[2]), _row(2, base[3]), _row(2, near[3])]
    rows += [_row(3, base[4])] * 5 + [_row(None, base[5])] * 4 + [_row(4, None), _row(5, ""), _row(None, None), _row(6, " \n"), _row(6, "short one"), _row(7, "Short one")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    got = out.collect()
    nodes, root = _groups(rows)
    at = {n: r for n, r in zip(nodes, root)}
    left = sorted(at[(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")] for r in got)
    assert left == sorted(set(root))
    assert {(r["_key"], r["_kept"], r["_rows"]) for r in got} == {("k", "l", 7)}
    # The row with an id stays before the one without.
    assert [r["doc_id"] for r in got if (r["text"] or "").startswith("w0x")] == [1]
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


def test_personal_data_leaves_columns_of_any_name_alone(spark):
    rng = random.Random(3)
    noise = lambda: " ".join(rng.choice(string.ascii_lowercase) + str(rng.randrange(400)) for _ in range(25))
    rows = [(i, f"{noise()} owner{i % 8}@mail.example {noise()} quimby{i % 8}", "t", "d") for i in range(80)]
    rows += [(100 + i, noise(), "t", "d") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _terms string, _doc string")
    out = pii.find(df).collect()
    assert len(out) == 680 and {(r["_terms"], r["_doc"]) for r in out} == {("t", "d")}
    kinds = [{s["kind"] for s in r["spans"]} for r in out if r["doc_id"] < 80]
    assert all(k == {"email", "term"} for k in kinds)
    assert not any(r["spans"] for r in out if r["doc_id"] >= 100)


@pytest.mark.parametrize("at", range(4))
def test_stages_take_empty_tables(spark, at):
    empty = spark.createDataFrame([], SCHEMA)
    out = corpus_pipeline.STAGES[at][1](spark, empty, "")
    assert out.columns == empty.columns and out.count() == 0


def test_sets_of_shingles_are_joined_by_numbers(spark, monkeypatch):
    """A relation broadcast by a digest takes a whole memory page of every executor, one by a number as much as its rows."""
    tables = {}

    def noted(df, name):
        out = saved(df, name)
        tables[name.rstrip("0123456789")] = out
        return out

    monkeypatch.setattr(neardup, "saved", noted)
    base = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(f"{i:02}", b.replace("x30", f"y{n}")) for n in range(3) for i, b in enumerate(base, 4 * n)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), percent=80).collect()
    assert sorted(r["doc_id"] for r in found if r["kept"]) == ["00", "01", "02", "03"]
    assert sorted(r["component_id"] for r in found) == sorted(["00", "01", "02", "03"] * 3)
    keys = {(t, c): dict(df.dtypes)[c] for t, df in tables.items() for c in ("node", "component", "a", "b", "ca", "cb") if c in df.columns}
    assert {t for t, _ in keys} >= {"nodes", "buckets", "members", "shingles", "active", "pairs", "links", "labels"}
    assert set(keys.values()) == {"bigint"}
    assert tables["nodes"].select("node").distinct().count() == tables["nodes"].count() == 12


def test_python_workers_get_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        corpus_pipeline.small_batches(spark)
        held = spark.range(64, numPartitions=1).selectExpr("repeat('x', 200000) text").mapInArrow(lambda it: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in it), "n bigint").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    assert sum(r["n"] for r in held) >= 64 * 200_000
    assert max(r["n"] for r in held) < 3 << 20
