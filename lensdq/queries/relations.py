"""Join and key-discovery queries (J01-J13) and set operations (U01-U04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensdq.functions.wordlists import ABBREVIATIONS, KEY_SUFFIXES
from lensdq.operators import match, present, relate
from lensdq.queries.base import Suite

suite = Suite()
add = suite.add

# Aliased views whose key names agree across tables.
KEYED = {
    "purchase": "SELECT o_orderkey AS order_id, o_custkey AS cust_key, o_totalprice AS amount FROM {orders}",
    "client": "SELECT c_custkey AS customer_key, c_nationkey AS nation_id, c_name AS name FROM {customer}",
    "place": "SELECT n_nationkey AS nation_id, n_name AS name, n_regionkey AS region_id FROM {nation}",
    "line": "SELECT l_orderkey AS order_id, l_partkey AS product_no, l_quantity AS qty FROM {lineitem}",
}


def keyed(t):
    return {n: t.sql(q) for n, q in KEYED.items()}


KEYED_CTE = "WITH " + ", ".join(f"{n} AS ({q})" for n, q in KEYED.items()) + " "
COLUMNS = {
    "purchase": ["order_id", "cust_key", "amount"], "client": ["customer_key", "nation_id", "name"],
    "place": ["nation_id", "name", "region_id"], "line": ["order_id", "product_no", "qty"],
}
_SCHEMA = "schema_list(p, t, c) AS (VALUES " + ", ".join(
    f"({i}, '{t}', '{c}')" for i, (t, cs) in enumerate(COLUMNS.items()) for c in cs
) + ")"
_ID = "(_?id|_?key|_?code|_?num|_?no|_?number)$"
_ABBR = "(VALUES " + ", ".join(f"('{s}', '{f}')" for s, f in ABBREVIATIONS.items()) + ") ab(s, f)"
_CAND = f"""{_SCHEMA}, nm AS (SELECT p, t, c, replace(c, '_', '') AS n, regexp_matches(c, '{_ID}') AS is_id,
    regexp_replace(replace(c, '_', ''), '{_ID}', '') AS stem FROM schema_list),
  cand AS (SELECT a.t AS left_table, b.t AS right_table, a.c AS left_col, b.c AS right_col,
    CASE WHEN a.n = b.n THEN 'exact_name' WHEN a.is_id AND b.is_id AND a.stem <> '' AND a.stem = b.stem THEN 'id_pattern'
         WHEN EXISTS (SELECT 1 FROM {_ABBR} WHERE (contains(a.n, s) AND contains(b.n, f)) OR (contains(a.n, f) AND contains(b.n, s))) THEN 'abbreviation' END AS match_type,
    CASE WHEN a.n = b.n THEN CASE WHEN a.is_id THEN 0.9 ELSE 0.7 END WHEN a.is_id AND b.is_id AND a.stem <> '' AND a.stem = b.stem THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence
    FROM nm a JOIN nm b ON a.p < b.p)"""
_VALUES = "vals AS (" + " UNION ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cs in COLUMNS.items() for c in cs
) + ")"
_OVER = """over AS (SELECT k.*, (SELECT count(*) FROM (SELECT v FROM vals WHERE t = k.left_table AND c = k.left_col INTERSECT SELECT v FROM vals WHERE t = k.right_table AND c = k.right_col))
     / least((SELECT count(*) FROM vals WHERE t = k.left_table AND c = k.left_col), (SELECT count(*) FROM vals WHERE t = k.right_table AND c = k.right_col)) AS ov FROM cand k WHERE match_type IS NOT NULL)"""


def with_row_counts(t, frame):
    """Add the row counts of both tables, so metadata results also depend on the data."""
    spark = t.spark
    sizes = [(n, df.count()) for n, df in keyed(t).items()]
    left = spark.createDataFrame(sizes, "left_table string, left_rows bigint")
    right = spark.createDataFrame(sizes, "right_table string, right_rows bigint")
    return frame.join(F.broadcast(left), "left_table").join(F.broadcast(right), "right_table")


_SIZES = "sizes AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, CAST(count(*) AS BIGINT) AS n FROM {t}" for t in KEYED) + ")"
add(
    "j01_name_candidates",
    lambda t: with_row_counts(t, relate.name_candidates(relate.schema_frame(t.spark, keyed(t)))),
    KEYED_CTE + f""", {_CAND}, {_SIZES} SELECT cand.*, a.n AS left_rows, b.n AS right_rows FROM cand JOIN sizes a ON a.t = left_table JOIN sizes b ON b.t = right_table
      WHERE match_type IS NOT NULL""",
)
_OVERLAP_KEYS = [("purchase", "cust_key"), ("client", "customer_key"), ("client", "nation_id"), ("place", "nation_id"), ("place", "region_id")]


def _overlaps(t):
    o = relate.value_overlaps(keyed(t), _OVERLAP_KEYS)
    return o.withColumn("overlap", F.round("overlap", 6))


add(
    "j02_value_overlap",
    _overlaps,
    KEYED_CTE + ", v AS (" + " UNION ".join(
        f"SELECT {i} AS id, CAST({c} AS VARCHAR) AS v FROM {t}" for i, (t, c) in enumerate(_OVERLAP_KEYS)
    ) + """), n AS (SELECT id, count(*) AS n FROM v GROUP BY 1)
    SELECT a.id AS left_id, b.id AS right_id, CAST(count(*) AS BIGINT) AS common, CAST(any_value(na.n) AS BIGINT) AS left_distinct,
      CAST(any_value(nb.n) AS BIGINT) AS right_distinct, round(count(*) / least(any_value(na.n), any_value(nb.n)), 6) AS overlap
    FROM v a JOIN v b ON a.v = b.v AND a.id < b.id JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id GROUP BY 1, 2""",
)
_REL_SQL = KEYED_CTE + f""", {_CAND}, {_VALUES}, {_OVER} SELECT left_table, right_table, left_col, right_col, match_type,
      round(CASE WHEN ov >= 0.5 THEN least(1.0, confidence + 0.2) ELSE confidence END, 2)::DOUBLE AS confidence, round(ov * 100, 1) AS overlap_pct FROM over WHERE ov > 0"""
add("j03_detect_relationships", lambda t: relate.detect_relationships(keyed(t)), _REL_SQL)


def _auto_join(t):
    joined, _ = relate.auto_join(keyed(t))
    return joined.groupBy("name_place").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("amount"), 2).alias("amount"), F.sum("qty").alias("qty"),
        F.count("order_id_line").alias("with_line"),
    )


add(
    "j04_auto_join",
    _auto_join,
    KEYED_CTE + """SELECT p.name AS name_place, CAST(count(*) AS BIGINT) AS row_count, round(sum(amount), 2) AS amount, sum(qty) AS qty,
      CAST(count(l.order_id) AS BIGINT) AS with_line
      FROM client c LEFT JOIN place p ON c.nation_id = p.nation_id LEFT JOIN purchase o ON o.cust_key = c.customer_key
      LEFT JOIN line l ON l.order_id = o.order_id GROUP BY 1""",
)
add(
    "j05_orphan_keys",
    lambda t: relate.orphan_keys(t.orders, "o_custkey", t.customer_next, "c_custkey"),
    """SELECT side, n AS distinct_count, o AS orphan_count, o > 0 AND o < n * 0.5 AS reported FROM (
      SELECT 'left' AS side, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (v NOT IN (SELECT c_custkey FROM {customer_next})) AS BIGINT) AS o FROM (SELECT DISTINCT o_custkey AS v FROM {orders})
      UNION ALL SELECT 'right', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (v NOT IN (SELECT o_custkey FROM {orders})) AS BIGINT) FROM (SELECT DISTINCT c_custkey AS v FROM {customer_next}))""",
)
_SAME = """, same AS (SELECT a.t AS from_table, b.t AS to_table, a.c AS column_name, a.p AS pa, b.p AS pb FROM schema_list a JOIN schema_list b ON a.c = b.c AND a.p < b.p),
  s AS (SELECT *, (SELECT count(*) FROM vals WHERE t = from_table AND c = column_name) AS na, (SELECT count(*) FROM vals WHERE t = to_table AND c = column_name) AS nb,
    (SELECT count(*) FROM (SELECT v FROM vals WHERE t = from_table AND c = column_name INTERSECT SELECT v FROM vals WHERE t = to_table AND c = column_name)) AS k FROM same),
  found AS (SELECT column_name, from_table, to_table, round(k / least(na, nb) * 100, 1) AS confidence, CAST(na - k AS BIGINT) AS from_orphans, CAST(nb - k AS BIGINT) AS to_orphans
    FROM s WHERE k / least(na, nb) > 0.3)"""
add("j06_same_name_analysis", lambda t: relate.same_name_analysis(keyed(t)), KEYED_CTE + f", {_SCHEMA}, {_VALUES}{_SAME} SELECT * FROM found")


def _health(t):
    tables = keyed(t)
    return relate.schema_health(tables, relate.same_name_analysis(tables))


add(
    "j06_schema_health",
    _health,
    KEYED_CTE + f""", {_SCHEMA}, {_VALUES}{_SAME}, m AS (SELECT round(greatest(count(*) FILTER (regexp_matches(c, '^[a-z_]+$')), count(*) FILTER (regexp_matches(c, '^[a-z]+[A-Z]'))) * 100.0 / count(*), 1) AS nc FROM schema_list),
      o AS (SELECT CAST(count(*) FILTER (from_orphans > 0 OR to_orphans > 0) AS BIGINT) AS ol FROM found)
      SELECT nc AS naming_consistency, ol AS orphan_links, round((nc + CASE WHEN ol = 0 THEN 100 ELSE 60 END) / 2, 1) AS schema_health FROM m, o""",
)
TPCH = ["region", "nation", "customer", "supplier", "orders"]
TPCH_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
             "supplier": ["s_suppkey", "s_nationkey"], "orders": ["o_orderkey", "o_custkey"]}


def _suffix(t):
    tables = {n: getattr(t, n) for n in TPCH}
    candidates = relate.suffix_foreign_keys(relate.schema_frame(t.spark, tables))
    return relate.detect_relationships(tables, candidates)


add(
    "j07_key_suffix",
    _suffix,
    "WITH ks(p, t, c, x) AS (VALUES " + ", ".join(
        f"({i}, '{t}', '{c}', '{c.split('_')[-1]}')" for i, (t, cs) in enumerate(TPCH_KEYS.items()) for c in cs if c.split("_")[-1] in KEY_SUFFIXES
    ) + "), vals AS (" + " UNION ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {{{t}}}" for t, cs in TPCH_KEYS.items() for c in cs
    ) + """), cand AS (SELECT a.t AS left_table, b.t AS right_table, a.c AS left_col, b.c AS right_col, 'key_suffix' AS match_type, 0.7::DOUBLE AS confidence FROM ks a JOIN ks b ON a.x = b.x AND a.p < b.p),
    """ + _OVER + """ SELECT left_table, right_table, left_col, right_col, match_type, round(CASE WHEN ov >= 0.5 THEN confidence + 0.2 ELSE confidence END, 2)::DOUBLE AS confidence,
      round(ov * 100, 1) AS overlap_pct FROM over WHERE ov > 0""",
)
add(
    "j08_key_like_columns",
    lambda t: relate.key_like_columns(t.sql(KEYED["line"])).unionByName(relate.key_like_columns(t.documents)),
    """SELECT 'order_id' AS column_name, 'id' AS hint, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS unique_count, count(DISTINCT l_orderkey) = count(*) AS is_unique FROM {lineitem}
    UNION ALL SELECT 'product_no', 'no', CAST(count(DISTINCT l_partkey) AS BIGINT), count(DISTINCT l_partkey) = count(*) FROM {lineitem}
    UNION ALL SELECT 'doc_id', 'id', CAST(count(DISTINCT doc_id) AS BIGINT), count(DISTINCT doc_id) = count(*) FROM {documents}""",
)
add(
    "j09_primary_keys",
    lambda t: relate.primary_keys(t.orders).unionByName(relate.primary_keys(t.part)),
    "SELECT column_name, distinct_count FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, count(*) AS n FROM {{{tab}}}"
        for tab, cs in (("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
                        ("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]))
        for c in cs
    ) + ") WHERE distinct_count = n",
)


def _mapping(t):
    """Data files: the words each event type's JSON uses, plus its name; sources: two expected layouts."""
    data = t.events.groupBy(F.col("event_type").alias("name")).agg(
        F.array_sort(F.array_union(F.collect_set(F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string"))), F.collect_set(F.lit("ts")))).alias("columns")
    )
    expected = t.events.groupBy(F.concat(F.lit("src_"), "event_type").alias("name")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("K"), (F.col("event_id") % 5).cast("string")))).alias("columns")
    )
    return relate.schema_mapping(data, expected)


add(
    "j10_schema_mapping",
    _mapping,
    """WITH d AS (SELECT DISTINCT event_type AS n, 'k' || (user_id % 7) AS c FROM {events} UNION SELECT event_type, 'ts' FROM {events}),
    e AS (SELECT DISTINCT 'src_' || event_type AS n, 'k' || (event_id % 5) AS c FROM {events}), w AS (SELECT n, count(*) AS wanted FROM e GROUP BY 1)
    SELECT d.n AS data_file, e.n AS source, CASE WHEN contains(replace(e.n, '_', ''), d.n) THEN 'filename' ELSE 'column_overlap' END AS match_type, CAST(count(*) AS BIGINT) AS shared_columns
    FROM d JOIN e USING (c) JOIN w ON w.n = e.n GROUP BY d.n, e.n, wanted HAVING contains(replace(e.n, '_', ''), d.n) OR count(*) > least(3, wanted * 0.3)""",
)
_MESSY = """SELECT DISTINCT CASE WHEN p_size < 10 THEN upper(p_name) WHEN p_size < 20 THEN replace(p_name, ' ', '_')
    WHEN p_size < 30 THEN concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))
    WHEN p_size < 40 THEN concat(p_name, 's') ELSE p_brand END AS name FROM {part}"""
add(
    "j11_field_resolution",
    lambda t: relate.resolve_names(t.sql(_MESSY), t.part.select(F.col("p_name").alias("candidate"))),
    "WITH n AS (" + _MESSY + """), c AS (SELECT DISTINCT p_name AS candidate FROM {part}),
    p AS (SELECT name, candidate, lower(trim(name)) = lower(trim(candidate)) AS ex, regexp_replace(lower(name), '[\\s_\\-\\.]+', '', 'g') = regexp_replace(lower(candidate), '[\\s_\\-\\.]+', '', 'g') AS nm,
      array_to_string(list_sort(string_split(trim(name), ' ')), ' ') AS a, array_to_string(list_sort(string_split(trim(candidate), ' ')), ' ') AS b FROM n, c),
    s AS (SELECT name, candidate, CASE WHEN ex THEN 1 WHEN nm THEN 3 ELSE 4 END AS step,
      CASE WHEN ex THEN 100.0 WHEN nm THEN 98.0 ELSE round((1 - levenshtein(a, b) / greatest(length(a), length(b))) * 100, 1) END::DOUBLE AS score FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step, score DESC, candidate) AS rk FROM s WHERE score >= 80)
    SELECT name, candidate, score, CASE step WHEN 1 THEN 'exact' WHEN 3 THEN 'normalized' ELSE 'fuzzy_token_sort' END AS method FROM r WHERE rk = 1""",
)


def pairs_sql(table: str, rid: str, keys: list[str]) -> str:
    ratios = [f"(1 - levenshtein(a.k{i}, b.k{i}) / greatest(length(a.k{i}), length(b.k{i}))) * 100" for i in range(len(keys))]
    mean = "(" + " + ".join(ratios) + f") / {len(keys)}"
    sorted_keys = ", ".join(f"array_to_string(list_sort(string_split(trim({k}), ' ')), ' ') AS k{i}" for i, k in enumerate(keys))
    hits = "concat_ws(',', " + ", ".join(f"CASE WHEN {r} >= 85 THEN '{k}' END" for r, k in zip(ratios, keys)) + ")"
    return f"""r AS (SELECT {rid} AS id, lower(substr({keys[0]}, 1, 3)) AS block, {sorted_keys},
      row_number() OVER (PARTITION BY lower(substr({keys[0]}, 1, 3)) ORDER BY {rid}) AS rn FROM {{{table}}}),
    pairs AS (SELECT a.id AS id_a, b.id AS id_b, round({mean}, 1) AS score, {hits} AS matched_on FROM r a JOIN r b ON a.block = b.block AND b.rn BETWEEN a.rn + 1 AND a.rn + 9
      WHERE {mean} >= 85)"""


add(
    "j12_entity_resolution",
    lambda t: match.duplicate_pairs(t.part, "p_partkey", ["p_name", "p_type"], chunk=500),
    "WITH " + pairs_sql("part", "p_partkey", ["p_name", "p_type"]) + " SELECT * FROM pairs",
)
add(
    "j12_entity_resolution_one_block",
    lambda t: match.duplicate_pairs(t.customer, "c_custkey", ["c_name"], chunk=200),
    "WITH " + pairs_sql("customer", "c_custkey", ["c_name"]) + " SELECT * FROM pairs",
)
add("j12_entity_resolution_indel", lambda t: match.duplicate_pairs(t.part, "p_partkey", ["p_name", "p_type"], ratio="indel"))
add(
    "j13_duplicate_clusters",
    lambda t: match.clusters(match.duplicate_pairs(t.part, "p_partkey", ["p_name", "p_type"])).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members")),
    "WITH RECURSIVE " + pairs_sql("part", "p_partkey", ["p_name", "p_type"]) + """, e AS (SELECT id_a AS s, id_b AS d FROM pairs UNION SELECT id_b, id_a FROM pairs),
    reach(id, seen) AS (SELECT s, s FROM e UNION SELECT reach.id, e.d FROM reach JOIN e ON e.s = reach.seen)
    SELECT cluster_id, CAST(count(*) AS BIGINT) AS members FROM (SELECT id, min(seen) AS cluster_id FROM reach GROUP BY 1) GROUP BY 1""",
)


def all_pairs_sql(table: str, rid: str, keys: list[str], threshold: float = 85) -> str:
    """Every pair of a block, between the smallest ids of records with equal token-sorted keys."""
    ks = ", ".join(f"k{i}" for i in range(len(keys)))
    ratios = [f"(1 - levenshtein(a.k{i}, b.k{i}) / greatest(length(a.k{i}), length(b.k{i}))) * 100" for i in range(len(keys))]
    mean = "(" + " + ".join(ratios) + f") / {len(keys)}"
    sorted_keys = ", ".join(f"array_to_string(list_sort(string_split(trim({k}), ' ')), ' ') AS k{i}" for i, k in enumerate(keys))
    hits = "concat_ws(',', " + ", ".join(f"CASE WHEN {r} >= {threshold} THEN '{k}' END" for r, k in zip(ratios, keys)) + ")"
    return f"""r AS (SELECT {rid} AS id, lower(substr({keys[0]}, 1, 3)) AS block, {sorted_keys} FROM {{{table}}}),
    c AS (SELECT min(id) AS id, count(*) AS n, block, {ks} FROM r GROUP BY block, {ks}),
    pairs AS (SELECT a.id AS id_a, b.id AS id_b, round({mean}, 1) AS score, {hits} AS matched_on FROM c a JOIN c b ON a.block = b.block AND a.id < b.id WHERE {mean} >= {threshold})"""


add(
    "j12_entity_resolution_complete",
    lambda t: match.all_duplicates(t.part, "p_partkey", ["p_name", "p_type"])[1],
    "WITH " + all_pairs_sql("part", "p_partkey", ["p_name", "p_type"]) + " SELECT * FROM pairs",
)
add(
    "j12_entity_resolution_complete_one_block",
    lambda t: match.all_duplicates(t.customer, "c_custkey", ["c_name"], threshold=92)[1],
    "WITH " + all_pairs_sql("customer", "c_custkey", ["c_name"], 92) + " SELECT * FROM pairs",
)


def _complete_clusters(t):
    members, pairs = match.all_duplicates(t.part, "p_partkey", ["p_name"], threshold=70)
    found = match.clusters(pairs.select("id_a", "id_b").unionByName(members.select(F.col("class_id").alias("id_a"), F.col("class_id").alias("id_b")).distinct()))
    return members.join(found.withColumnRenamed("id", "class_id"), "class_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members")).where("members > 1")


add(
    "j13_duplicate_clusters_complete",
    _complete_clusters,
    "WITH RECURSIVE " + all_pairs_sql("part", "p_partkey", ["p_name"], 70) + """, e AS (SELECT id_a AS s, id_b AS d FROM pairs UNION SELECT id_b, id_a FROM pairs UNION SELECT id, id FROM c),
    reach(id, seen) AS (SELECT s, s FROM e UNION SELECT reach.id, e.d FROM reach JOIN e ON e.s = reach.seen)
    SELECT cluster_id, CAST(sum(n) AS BIGINT) AS members FROM (SELECT id, min(seen) AS cluster_id FROM reach GROUP BY 1) JOIN c USING (id) GROUP BY 1 HAVING sum(n) > 1""",
)

add(
    "u01_union_reports",
    lambda t: present.union_tagged({"customer": t.customer.select(F.col("c_acctbal").alias("balance")), "supplier": t.supplier.select(F.col("s_acctbal").alias("balance"))})
    .groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance")),
    """SELECT 'customer' AS source, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS balance FROM {customer}
    UNION ALL SELECT 'supplier', CAST(count(*) AS BIGINT), round(sum(s_acctbal), 2) FROM {supplier}""",
)
add("u02_distinct", lambda t: present.distinct_values(t.lineitem, "l_partkey"), "SELECT DISTINCT l_partkey AS value FROM {lineitem}")
add(
    "u03_intersect",
    lambda t: present.common_values(t.orders, "o_custkey", t.customer_next, "c_custkey"),
    "SELECT o_custkey AS value FROM {orders} INTERSECT SELECT c_custkey FROM {customer_next}",
)
add(
    "u04_except",
    lambda t: present.missing_values(t.customer, "c_custkey", t.orders, "o_custkey"),
    "SELECT c_custkey AS value FROM {customer} EXCEPT SELECT o_custkey FROM {orders}",
)
