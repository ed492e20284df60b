"""Lineage graphs as node and edge tables: build, traversal, impact, statistics."""

from __future__ import annotations

import itertools
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensdq.functions.columns import side_by_side
from lensdq.operators.relate import schema_frame, suffix_foreign_keys
from lensdq.session import checkpointed

NODE = "id string, type string, name string"
EDGE = "source string, target string, relationship string"


def build(
    tables: dict[str, DataFrame], system: str, database: str, schema: str, deliverables: dict[str, tuple[str, list[str]]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from system down to columns, foreign keys by name suffix, and deliverables fed by tables.

    ``deliverables`` maps a name to (type, source tables).
    """
    spark = next(iter(tables.values())).sparkSession
    chain = [(f"sys_{system.lower()}", "source_system", system), (f"db_{database.lower()}", "database", database), (f"schema_{schema.lower()}", "schema", schema)]
    columns = schema_frame(spark, tables)
    table_id = F.concat(F.lit("table_"), F.lower("table_name"))
    column_id = F.concat_ws("_", F.lit("col"), F.lower("table_name"), F.lower("column_name"))
    names = columns.select("table_name").distinct()
    nodes = (
        spark.createDataFrame(chain, NODE)
        .unionByName(names.select(table_id.alias("id"), F.lit("table").alias("type"), F.col("table_name").alias("name")))
        .unionByName(columns.select(column_id.alias("id"), F.lit("column").alias("type"), F.concat_ws(".", "table_name", "column_name").alias("name")))
    )
    feeds = F.lit("feeds").alias("relationship")
    edges = (
        spark.createDataFrame([(a[0], b[0], "feeds") for a, b in zip(chain, chain[1:])], EDGE)
        .unionByName(names.select(F.lit(chain[-1][0]).alias("source"), table_id.alias("target"), feeds))
        .unionByName(columns.select(table_id.alias("source"), column_id.alias("target"), feeds))
    )
    keys = suffix_foreign_keys(columns)
    side = lambda t, c: F.concat_ws("_", F.lit("col"), F.lower(t), F.lower(c))
    edges = edges.unionByName(
        keys.select(side("left_table", "left_col").alias("source"), side("right_table", "right_col").alias("target"), F.lit("references").alias("relationship"))
    )
    if deliverables:
        made = [(f"deliverable_{n.lower().replace(' ', '_')}", kind, n) for n, (kind, _) in deliverables.items()]
        used = [(f"table_{t.lower()}", f"deliverable_{n.lower().replace(' ', '_')}", "used_by") for n, (_, ts) in deliverables.items() for t in ts]
        nodes = nodes.unionByName(spark.createDataFrame(made, NODE))
        edges = edges.unionByName(spark.createDataFrame(used, EDGE))
    return nodes, edges.distinct()


def reachable(edges: DataFrame, start: str, direction: str = "down", depth: int | None = 3) -> DataFrame:
    """(id, distance, path) of all nodes within ``depth`` steps (None: all), each at its shortest distance.

    One join per level from the newly reached nodes; known nodes are removed by an anti join,
    so cycles end. Of equally short paths the first in text order is kept.
    """
    a, b = ("source", "target") if direction == "down" else ("target", "source")
    # Written once, so the levels do not rebuild the edge list.
    steps = checkpointed(edges.select(F.col(a).alias("here"), F.col(b).alias("there")).distinct())
    spark = edges.sparkSession
    seen = frontier = checkpointed(spark.createDataFrame([(start, 0, start)], "id string, distance int, path string"))
    for level in itertools.count(1) if depth is None else range(1, depth + 1):
        found = (
            steps.join(frontier, steps["here"] == frontier["id"])
            .groupBy("there")
            .agg(F.min(F.concat_ws(" > ", "path", "there")).alias("path"))
            .select(F.col("there").alias("id"), F.lit(level).alias("distance"), "path")
        )
        frontier = checkpointed(found.join(seen.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where(F.col("id") != start)


def impact(edges: DataFrame, nodes: DataFrame, start: str, depth: int | None = None) -> DataFrame:
    """Downstream nodes by type and the severity they imply."""
    below = reachable(edges, start, "down", depth).join(nodes, "id", "left")
    kind = F.col("type")
    hit = lambda *names: F.count_if(kind.isin(*names))
    return below.agg(
        F.count(F.lit(1)).alias("total_downstream"), hit("dashboard").alias("dashboards"), hit("report").alias("reports"),
        hit("table").alias("tables"), hit("column").alias("columns"),
    ).select(
        F.lit(start).alias("impacted_node"), "*",
        F.when((F.col("dashboards") > 0) | (F.col("reports") > 0), "HIGH").when(F.col("tables") > 0, "MEDIUM").otherwise("LOW").alias("impact_severity"),
    )


def reachable_from(edges: DataFrame, starts: DataFrame, direction: str = "down", depth: int | None = None, levels: int = 3) -> DataFrame:
    """(start, id, distance, via) of all nodes within ``depth`` steps (None: all) of each start.

    ``starts`` has a column ``id``. All starts walk together: one table holds (start, node,
    distance), and ``levels`` steps are one plan with one checkpoint, so jobs grow with the depth
    of the graph and not with the starts. ``via`` is the node before on a shortest way, the first
    in text order; following it from any node gives the way back to the start. A start is not
    reached by itself, cycles end, null ids and edges with a null end lead nowhere.
    """
    a, b = ("source", "target") if direction == "down" else ("target", "source")
    steps = checkpointed(edges.select(F.col(a).alias("here"), F.col(b).alias("there")).where("here IS NOT NULL AND there IS NOT NULL").distinct())
    first = starts.select(F.col("id").cast("string").alias("start")).where("start IS NOT NULL").distinct()
    seen = edge_of = checkpointed(first.select("start", F.col("start").alias("id"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("via")))
    done = 0
    while depth is None or done < depth:
        more = levels if depth is None else min(levels, depth - done)
        walk, ways = edge_of, None
        for step in range(1, more + 1):
            next_to = walk.join(steps, walk["id"] == steps["here"]).groupBy("start", "there").agg(F.min("here").alias("via"))
            walk = next_to.select("start", F.col("there").alias("id"), F.lit(done + step).alias("distance"), "via")
            ways = walk if ways is None else ways.unionByName(walk)
        nearest = ways.groupBy("start", "id").agg(F.min(F.struct("distance", "via")).alias("w")).select("start", "id", "w.distance", "w.via")
        found = checkpointed(nearest.join(seen.select("start", "id"), ["start", "id"], "left_anti"))
        done += more
        seen = seen.unionByName(found)
        edge_of = found.where(F.col("distance") == done)
        if edge_of.isEmpty():
            break
    return seen.where(F.col("distance") > 0)


def impacts(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """``impact`` of every start in one walk; a start with nothing below it has zeros."""
    below = reachable_from(edges, starts, "down", depth).join(nodes.select("id", "type"), "id", "left")
    kind = F.col("type")
    hit = lambda *names: F.count_if(kind.isin(*names))
    counts = below.groupBy("start").agg(
        F.count(F.lit(1)).alias("total_downstream"), hit("dashboard").alias("dashboards"), hit("report").alias("reports"),
        hit("table").alias("tables"), hit("column").alias("columns"), F.max("distance").alias("depth"),
    )
    every = starts.select(F.col("id").cast("string").alias("start")).where("start IS NOT NULL").distinct().join(counts, "start", "left")
    filled = every.fillna(0, ["total_downstream", "dashboards", "reports", "tables", "columns", "depth"])
    severity = F.when((F.col("dashboards") > 0) | (F.col("reports") > 0), "HIGH").when(F.col("tables") > 0, "MEDIUM").otherwise("LOW")
    return filled.withColumnRenamed("start", "impacted_node").withColumn("impact_severity", severity)


def counts_by_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(F.lit("node").alias("element"), F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges.groupBy(F.lit("edge").alias("element"), F.col("relationship").alias("label")).agg(F.count(F.lit(1)).alias("n")))


def lineage_stats(nodes: DataFrame, edges: DataFrame, kind: str = "table") -> DataFrame:
    """Totals, nodes of one type without a source, and the share with both sources and targets."""
    chosen = nodes.where(F.col("type") == kind).select("id")
    ups = edges.select(F.col("target").alias("id")).distinct().withColumn("up", F.lit(1))
    downs = edges.select(F.col("source").alias("id")).distinct().withColumn("down", F.lit(1))
    covered = chosen.join(ups, "id", "left").join(downs, "id", "left").agg(
        F.count(F.lit(1)).alias("tables_with_lineage"), F.count_if(F.col("up").isNull()).alias("orphan_tables"),
        F.count_if(F.col("up").isNotNull() & F.col("down").isNotNull()).alias("both"),
    )
    totals = side_by_side(nodes.agg(F.count(F.lit(1)).alias("total_nodes")), edges.agg(F.count(F.lit(1)).alias("total_edges")))
    share = F.when(F.col("tables_with_lineage") > 0, F.round(F.col("both") * 100.0 / F.col("tables_with_lineage"), 1)).otherwise(0.0)
    return side_by_side(totals, covered).select("total_nodes", "total_edges", "tables_with_lineage", "orphan_tables", share.alias("coverage_pct"))
