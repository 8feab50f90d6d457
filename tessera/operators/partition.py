"""Who owns what when vertices or edges are dealt to a number of owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.graph import Graph


def block_owner(v: Column, n: int, owners: int) -> Column:
    """Owners have n / owners vertices each in order, the last one the rest as well; with fewer vertices than owners, one each."""
    if n < owners:
        return v.cast("int")
    return F.least(F.floor(v / F.lit(n // owners)), F.lit(owners - 1)).cast("int")


def block_local(v: Column, n: int, owners: int) -> Column:
    """A vertex's place among those of its owner."""
    if n < owners:
        return F.lit(0).cast("bigint")
    return (v - block_owner(v, n, owners) * F.lit(n // owners)).cast("bigint")


def rest_to_last_owner(v: Column, n: int, owners: int) -> Column:
    """As ``block_owner``, but with fewer vertices than owners the last owner has them all."""
    return F.lit(owners - 1).cast("int") if n < owners else block_owner(v, n, owners)


def round_robin_owner(pos: Column, owners: int) -> Column:
    return F.pmod(pos, F.lit(owners)).cast("int")


def round_robin_size(total: int, owner: int, owners: int) -> int:
    """Positions 0..total-1 that ``owner`` has."""
    return total // owners + (owner < total % owners)


def partition_block(graph: Graph, owners: int) -> DataFrame:
    """(owner, vertices, first_node, entries): each owner's block and the adjacency entries in it."""
    n = graph.num_nodes
    v = graph.out_degree().select("id", "out_degree", block_owner(F.col("id"), n, owners).alias("owner"))
    return v.groupBy("owner").agg(F.count("*").alias("vertices"), F.min("id").alias("first_node"), F.sum("out_degree").cast("bigint").alias("entries"))


def partition_round_robin(rows: DataFrame, pos: str, owners: int) -> DataFrame:
    """(owner, edges): how many rows each owner has by position."""
    return rows.groupBy(round_robin_owner(F.col(pos), owners).alias("owner")).agg(F.count("*").alias("edges"))


def redistributed(graph: Graph, owners: int) -> Graph:
    """The same graph with its edges range-partitioned by source."""
    return Graph(graph.spark, graph.edges.repartitionByRange(owners, "src"), graph.num_nodes, graph.directed, graph.weighted, _entries=graph._entries)
