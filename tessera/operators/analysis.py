"""What is read off results: the largest values, component sizes, reach; and the choice of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sssp import UNREACHED
from tessera.plans.graph import Graph
from tessera.sources.generators import SEED



def top_k(rows: DataFrame, k: int = 5, key: str = "id", value: str = "score", digits: int | None = None) -> DataFrame:
    """The k largest values, largest first, ties to the larger key. With ``digits``, values are rounded before they are ranked."""
    v = F.col(value) if digits is None else F.round(value, digits)
    return rows.select(F.col(key), v.alias(value)).orderBy(F.desc(value), F.desc(key)).limit(k)


def bfs_stats(graph: Graph, tree: DataFrame) -> DataFrame:
    """One row: reached vertices and the sum of their out-degrees."""
    reached = tree.where("depth >= 0").select("id")
    return reached.join(graph.out_degree(), "id").agg(F.count("*").alias("reached"), F.coalesce(F.sum("out_degree"), F.lit(0)).cast("bigint").alias("edges"))


def component_sizes(labels: DataFrame, k: int | None = 5) -> DataFrame:
    """(comp, vertices) of the k largest components, ties to the larger label; of all with None."""
    sizes = labels.groupBy("comp").agg(F.count("*").alias("vertices"))
    return sizes if k is None else top_k(sizes, k, "comp", "vertices")


def component_count(labels: DataFrame) -> DataFrame:
    return labels.select("comp").distinct().agg(F.count("*").alias("components"))


def frequent_component(labels: DataFrame) -> DataFrame:
    """One row: the label that most vertices have."""
    return component_sizes(labels, 1)


def sssp_reach(distances: DataFrame) -> DataFrame:
    """One row: vertices with a path."""
    return distances.where(F.col("dist") < UNREACHED).agg(F.count("*").alias("reached"))


def pick_sources(graph: Graph, n: int = 1, seed: int = SEED, start: int | None = None) -> list[int]:
    """``start`` n times where it is given, else n vertices with out-edges in an order that the seed decides."""
    if start is not None:
        return [start] * n
    found = graph.edges.select(F.col("src").alias("id")).distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).collect()
    if not found:
        raise ValueError("no vertex has an out-edge")
    return [found[i % len(found)].id for i in range(n)]
