"""PageRank by pulling contributions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.graph import Graph
from tessera.plans.loop import Tables

DAMPING = 0.85


@dataclass
class Ranks:
    scores: DataFrame  # id, score
    iterations: int
    error: float


def pagerank(graph: Graph, max_iters: int = 20, epsilon: float = 1e-4, damping: float = DAMPING) -> Ranks:
    """Every score is (1 - damping) / N plus damping times what its in-neighbours share out equally.

    Vertices without out-edges share nothing, so scores need not sum to 1. Stops once the scores changed by less than
    ``epsilon`` in all. An iteration shuffles one sum for each vertex that a block of edges reaches, never edges.
    """
    n, tables = graph.num_nodes, Tables(graph.spark, "pagerank")
    blocks = graph.blocks()
    form = np.dtype([("score", "<f8"), ("degree", "<f8")])

    def begin(ids: np.ndarray) -> bytes:
        x = np.zeros(len(ids), form)
        x["score"] = 1.0 / n
        return x.tobytes()

    def with_degrees(x: bytes, got: np.ndarray):
        x = np.frombuffer(x, form).copy()
        x["degree"] = got
        return x.tobytes(), None

    def share(x: bytes) -> np.ndarray:
        x = np.frombuffer(x, form)
        return np.divide(x["score"], x["degree"], out=np.zeros(len(x)), where=x["degree"] > 0)

    def pulled(x: bytes, got: np.ndarray):
        x = np.frombuffer(x, form).copy()
        old, x["score"] = x["score"].copy(), (1 - damping) / n + damping * got
        return x.tobytes(), float(np.abs(x["score"] - old).sum())

    done, error = 0, float("inf")
    state, _ = tables.write(blocks.degrees(blocks.start(begin), with_degrees), "scores")
    while done < max_iters:
        state, seen = tables.write(blocks.step(state, share, "add", pulled), "scores", 2, change=F.sum("figure"))
        done, error = done + 1, float(seen["change"] or 0.0)
        if error < epsilon:
            break
    return Ranks(blocks.rows(state, lambda x: np.frombuffer(x, form)["score"], "score", "double"), done, error)
