"""Triangles of undirected graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.graph import Graph


def _lists(graph: Graph) -> DataFrame:
    """(u, list): a vertex and its neighbours of higher (degree, id), in that order.

    No list is longer than the square root of twice the number of edges, however large a hub is.
    """
    if graph.directed:
        raise ValueError("triangles need an undirected graph")
    e = graph.edges.select("src", "dst")
    degree = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
    ends = e.where("src < dst").join(degree.select(F.col("v").alias("src"), F.col("d").alias("a")), "src").join(degree.select(F.col("v").alias("dst"), F.col("d").alias("b")), "dst")
    low, high = F.struct(F.col("a").alias("d"), F.col("src").alias("v")), F.struct(F.col("b").alias("d"), F.col("dst").alias("v"))
    out = ends.select(F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))
    return out.groupBy(F.col("low.v").alias("u")).agg(F.sort_array(F.collect_list("high"))["v"].alias("list"))


def _closed(graph: Graph) -> DataFrame:
    """(u, v, thirds): for each oriented edge the vertices that close a triangle with it. Each triangle appears once.

    A third vertex comes after v in the list of u, so v gets only the rest of that list, and the last of a list gets nothing:
    half of what whole lists would take, and no row at all for the many vertices with a list of one.
    """
    lists = _lists(graph)
    rest = lists.where(F.size("list") > 1).select("u", "list", F.posexplode("list").alias("at", "v")).where(F.col("at") < F.size("list") - 1)
    wedges = rest.select("u", "v", F.slice("list", F.col("at") + 2, F.size("list")).alias("rest"))
    other = lists.select(F.col("u").alias("v"), F.col("list").alias("other"))
    return wedges.join(other, "v").select("u", "v", F.array_intersect("rest", "other").alias("thirds"))


def triangle_count(graph: Graph) -> DataFrame:
    """One row: triangles."""
    return _closed(graph).agg(F.coalesce(F.sum(F.size("thirds")), F.lit(0)).cast("bigint").alias("triangles"))


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c) with a > b > c, each triangle once."""
    t = _closed(graph).select("u", "v", F.explode("thirds").alias("x"))
    s = F.sort_array(F.array("u", "v", "x"), False)
    return t.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def triangles_per_vertex(graph: Graph) -> DataFrame:
    """(id, triangles) of every vertex."""
    ends = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return graph.vertices().join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("triangles"))


def worth_relabelling(graph: Graph, sample: int = 1000) -> DataFrame:
    """One row: average_degree, sample_mean, sample_median, worth. Whether degrees are skewed enough for a rename to pay.

    As the kernel orients by degree anyway its result does not depend on this. The sample is the ``sample`` vertices with an
    edge whose ids hash lowest.
    """
    average = graph.num_entries // graph.num_nodes if graph.num_nodes else 0
    picked = graph.out_degree().where("out_degree > 0").orderBy(F.xxhash64("id"), "id").limit(sample)
    r = picked.agg(F.avg("out_degree").alias("sample_mean"), F.percentile("out_degree", 0.5).alias("sample_median"))
    return r.select(F.lit(average).cast("bigint").alias("average_degree"), "sample_mean", "sample_median", (F.lit(average >= 10) & F.coalesce(F.col("sample_mean") / 1.3 > F.col("sample_median"), F.lit(False))).alias("worth"))
