"""Breadth-first search by levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.graph import Graph
from tessera.plans.loop import Tables

#: Levels after which what was visited becomes one table, so that deep graphs don't read ever more small ones.
COMPACT = 32


def bfs(graph: Graph, source: int, max_levels: int | None = None) -> DataFrame:
    """(id, depth, parent): depth -1 and parent -1 where unreached; the source is its own parent.

    Of the possible parents the least id is taken. A level joins the frontier to the edges, which stay partitioned by source,
    and drops what was visited. Spark broadcasts a frontier of small measured size and shuffles a large one, which is the
    choice between pushing from few vertices and scanning for many; the result is the same.
    """
    spark, tables = graph.spark, Tables(graph.spark, "bfs")
    if not 0 <= source < graph.num_nodes:
        raise ValueError(f"source {source} is not a vertex")
    edges = graph.kept()
    start = spark.range(source, source + 1).select("id", F.lit(0).alias("depth"), F.col("id").alias("parent"))
    frontier, _ = tables.write(start, "level")
    visited, depth, parts = frontier, 0, list(tables.made["level"])
    while max_levels is None or depth < max_levels:
        depth += 1
        reached = edges.along(frontier.select(F.col("id").alias("src"))).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        fresh = reached.join(visited.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent")
        frontier, seen = tables.write(fresh, "level", n=F.count("*"))
        if not seen["n"]:
            break
        parts.append(tables.made["level"][-1])
        visited = spark.read.schema(fresh.schema).parquet(*parts)
        if len(parts) >= COMPACT:
            visited, _ = tables.write(visited, "visited", keep=1)
            parts = list(tables.made["visited"])
    return graph.vertices().join(visited, "id", "left").select("id", F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("parent", F.lit(-1)).cast("bigint").alias("parent"))
