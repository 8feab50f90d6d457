"""Betweenness centrality from a set of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.bfs import COMPACT
from tessera.plans.graph import Graph
from tessera.plans.loop import Tables


def dependencies(graph: Graph, sources: list[int]) -> DataFrame:
    """(s, id, depth, sigma, delta) for every vertex that a source reaches: shortest paths counted, dependencies added up.

    All sources go together; a level of the search forward and a level back are one job each.
    """
    spark, tables = graph.spark, Tables(graph.spark, "betweenness")
    for s in sources:
        if not 0 <= s < graph.num_nodes:
            raise ValueError(f"source {s} is not a vertex")
    edges = graph.kept()
    start = spark.range(len(sources)).select(F.get(F.array(*[F.lit(s).cast("bigint") for s in sources]), F.col("id").cast("int")).alias("s"))
    level, _ = tables.write(start.distinct().select("s", F.col("s").alias("id"), F.lit(0).alias("depth"), F.lit(1.0).alias("sigma")), "forward")
    levels, visited, parts = [level], level, list(tables.made["forward"])
    while True:
        reached = edges.along(level.select("s", F.col("id").alias("src"), "sigma")).groupBy("s", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        fresh = reached.join(visited.select("s", "id"), ["s", "id"], "left_anti").select("s", "id", F.lit(len(levels)).alias("depth"), "sigma")
        level, seen = tables.write(fresh, "forward", n=F.count("*"))
        if not seen["n"]:
            break
        levels.append(level)
        parts.append(tables.made["forward"][-1])
        visited = spark.read.schema(fresh.schema).parquet(*parts)
        if len(parts) >= COMPACT:
            visited, _ = tables.write(visited, "visited", keep=1)
            parts = list(tables.made["visited"])
    below, _ = tables.write(levels[-1].withColumn("delta", F.lit(0.0)), "back")
    for level in reversed(levels[:-1]):
        share = below.select("s", F.col("id").alias("dst"), ((F.lit(1.0) + F.col("delta")) / F.col("sigma")).alias("share"))
        given = edges.along(level.select("s", F.col("id").alias("src"))).join(share, ["s", "dst"]).groupBy("s", F.col("src").alias("id")).agg(F.sum("share").alias("share"))
        below, _ = tables.write(level.join(given, ["s", "id"], "left").select("s", "id", "depth", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta")), "back")
    return spark.read.schema(below.schema).parquet(*tables.made["back"])


def betweenness(graph: Graph, sources: list[int]) -> DataFrame:
    """(id, score): dependencies summed over ``sources`` (each source's own included), divided by the largest sum.

    All scores are 0 where nothing depends on any vertex.
    """
    sums = dependencies(graph, sources).groupBy("id").agg(F.sum("delta").alias("d"))
    top = sums.agg(F.max("d").alias("top"))
    scaled = sums.crossJoin(F.broadcast(top)).select("id", F.coalesce(F.try_divide("d", F.expr("nullif(top, 0D)")), F.lit(0.0)).alias("score"))  # top is one row
    return graph.vertices().join(scaled, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
