"""Weakly connected components, labelled by their least vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.graph import Graph
from tessera.plans.loop import Tables


def _stars(pairs: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(u, v): every vertex of ``pairs`` but the least of its component, with that least vertex. Large and small stars in turn.

    Edges only ever point to smaller vertices, a hub's edges are re-pointed by a join (whose skew can be split), and the
    number of rounds grows with the logarithm of the number of vertices.
    """
    now, seen = tables.write(pairs.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), name, 2, n=F.count("*"), x=F.bit_xor(F.xxhash64("u", "v")))
    while seen["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        before = seen
        now, seen = tables.write(after, name, 2, n=F.count("*"), x=F.bit_xor(F.xxhash64("u", "v")))
        if seen == before:
            break
    return now


def _labels(graph: Graph, stars: DataFrame) -> DataFrame:
    return graph.vertices().join(stars, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", F.col("id")).alias("comp"))


def afforest(graph: Graph, neighbor_rounds: int = 2) -> DataFrame:
    """(id, comp). First the components of a sample, each vertex's first ``neighbor_rounds`` edges; then those of what is left.

    The sample merges most of the largest component, so that most edges have both ends in one component and drop out before
    the full passes.
    """
    tables = Tables(graph.spark, "afforest")
    pairs = graph.edges.select("src", "dst")
    first = pairs.groupBy("src").agg(F.min("dst").alias("dst"))
    sample = first
    for _ in range(1, neighbor_rounds):  # the next neighbour in order, one aggregation a round
        first = pairs.join(first.withColumnRenamed("dst", "last"), "src").where("dst > last").groupBy("src").agg(F.min("dst").alias("dst"))
        sample = sample.unionByName(first)
    if neighbor_rounds < 1:
        return _labels(graph, _stars(pairs, tables, "all"))
    found = _stars(sample, tables, "sample")
    a, b = found.select(F.col("u").alias("src"), F.col("v").alias("ca")), found.select(F.col("u").alias("dst"), F.col("v").alias("cb"))
    left = pairs.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("ca", "src").alias("src"), F.coalesce("cb", "dst").alias("dst")).where("src <> dst").distinct()
    rest = _stars(left, tables, "rest")
    # A vertex's label is that of its sample component, or what that component was merged into.
    labels = _labels(graph, found).withColumnRenamed("comp", "c")
    return labels.join(rest, F.col("c") == F.col("u"), "left").select("id", F.coalesce("v", F.col("c")).alias("comp"))


def shiloach_vishkin(graph: Graph) -> DataFrame:
    """(id, comp) by hooking and shortcutting: roots hook to the least label across an edge, then every vertex points to its root.

    Edges are rewritten to labels each round, and those inside a component drop out.
    """
    spark, tables = graph.spark, Tables(graph.spark, "hooks")
    labels, _ = tables.write(graph.vertices().select("id", F.col("id").alias("comp")), "labels", 2)
    edges = graph.edges.select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")).where("high <> low").distinct()
    edges, seen = tables.write(edges, "edges", 2, n=F.count("*"))
    while seen["n"]:
        hooks, _ = tables.write(edges.groupBy(F.col("high").alias("root")).agg(F.min("low").alias("to")), "hooks", 2)
        while True:  # hooks of hooks: chains halve each time
            up = hooks.select(F.col("root").alias("to"), F.col("to").alias("up"))
            shorter = hooks.join(up, "to", "left").select("root", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved"))
            hooks, moved = tables.write(shorter, "hooks", 2, n=F.count_if("moved"))
            hooks = hooks.select("root", "to")
            if not moved["n"]:
                break
        labels, _ = tables.write(labels.join(hooks, F.col("comp") == F.col("root"), "left").select("id", F.coalesce("to", "comp").alias("comp")), "labels", 2)
        a, b = hooks.select(F.col("root").alias("high"), F.col("to").alias("x")), hooks.select(F.col("root").alias("low"), F.col("to").alias("y"))
        moved_edges = edges.join(a, "high", "left").join(b, "low", "left").select(F.coalesce("x", "high").alias("p"), F.coalesce("y", "low").alias("q")).where("p <> q").select(F.greatest("p", "q").alias("high"), F.least("p", "q").alias("low")).distinct()
        edges, seen = tables.write(moved_edges, "edges", 2, n=F.count("*"))
    return labels
