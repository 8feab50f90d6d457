"""Graphs that the driver's tables imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.graph import Graph, from_edges


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw edges from each part to the next one of the same order, weighted by quantity. Loops and repetitions are kept.

    Line numbers repeat within an order, so the order of its lines needs all these columns.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_quantity").cast("int").alias("w"))
    return out.where("dst IS NOT NULL")


def sparse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw edges from parts (even ids) to suppliers (odd ids) of a few lines: many components, many isolated vertices."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 50 AND l_discount >= 0.09")
    ends = lines.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.col("l_linenumber").cast("int").alias("w"))
    return ends.groupBy("src", "dst").agg(F.min("w").alias("w"))


def flow(spark: SparkSession, sf_dir: str, symmetrize: bool = False, weighted: bool = True) -> Graph:
    return from_edges(flow_edges(spark, sf_dir), symmetrize=symmetrize, weighted=weighted)


def sparse(spark: SparkSession, sf_dir: str, symmetrize: bool = False, weighted: bool = True) -> Graph:
    return from_edges(sparse_edges(spark, sf_dir), symmetrize=symmetrize, weighted=weighted)
