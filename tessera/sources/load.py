"""From a file or a generator to a built graph."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import fenced
from tessera.plans.graph import Graph, from_edges
from tessera.plans.loop import Tables
from tessera.sources.generators import DEGREE, SEED, generate_edges, with_weights
from tessera.sources.readers import BINARY_SUFFIXES, read_edges, read_serialized, suffix_of


def load_graph(spark: SparkSession, path: str, *, symmetrize: bool = False, weighted: bool = False, seed: int = SEED, tables: Tables | None = None) -> Graph:
    """A graph from a file. Weights are dropped unless wanted, and made up where they are wanted and the file has none."""
    if suffix_of(path) in BINARY_SUFFIXES:
        graph = read_serialized(spark, path)
        if graph.weighted and not weighted:
            return Graph(spark, graph.edges.drop("w"), graph.num_nodes, graph.directed, False, _entries=graph._entries)
        if weighted and not graph.weighted:
            raise ValueError(f"{path} has no weights")
        return graph
    return from_raw(read_edges(spark, path), symmetrize=symmetrize, weighted=weighted, seed=seed, tables=tables)


@contextlib.contextmanager
def _small_methods(spark: SparkSession):
    """Meanwhile, stages whose compiled method the JVM wouldn't optimise, beyond 8000 bytes, are run as smaller methods."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def generate_graph(spark: SparkSession, scale: int, degree: int = DEGREE, *, uniform: bool = False, weighted: bool = False, seed: int = SEED, tables: Tables | None = None) -> Graph:
    """An undirected synthetic graph."""
    raw = fenced(generate_edges(spark, scale, degree, uniform=uniform, seed=seed), ["src", "dst"])
    with _small_methods(spark):  # the edges are written in here
        return from_raw(raw, symmetrize=True, weighted=weighted, seed=seed, tables=tables)


def from_raw(raw: DataFrame, *, symmetrize: bool, weighted: bool, seed: int = SEED, tables: Tables | None = None) -> Graph:
    if weighted and "w" not in raw.columns:
        raw = with_weights(raw, seed)
    return from_edges(raw.select("src", "dst", *([F.col("w")] if weighted else [])), symmetrize=symmetrize, weighted=weighted, tables=tables)
