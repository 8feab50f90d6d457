"""Single-source shortest paths by buckets of distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.blocks import NEUTRAL
from tessera.plans.graph import Graph
from tessera.plans.loop import Tables

#: Without effect, as every step writes all distances; it stays for those who set it.
COMPACT = 32
#: Fixed value: the distance of what can't be reached.
UNREACHED = 1073741823


def sssp(graph: Graph, source: int, delta: int | None = None) -> DataFrame:
    """(id, dist): the least sum of weights from ``source``; ``UNREACHED`` where there is no path shorter than that.

    Vertices whose distance fell wait for their edges to be relaxed. A step takes those in the lowest bucket of width
    ``delta`` (all of them where it is None); the result is the same for any width. Distances and who waits are five bytes a
    vertex, so a step writes them whole; it shuffles the least offer of a block of edges to each vertex.
    """
    if not graph.weighted:
        raise ValueError("shortest paths need weights")
    if delta is not None and delta < 1:
        raise ValueError("delta must be positive")
    if not 0 <= source < graph.num_nodes:
        raise ValueError(f"source {source} is not a vertex")
    tables, blocks = Tables(graph.spark, "sssp"), graph.blocks()
    form = np.dtype([("dist", "<i4"), ("waits", "?")])

    def begin(ids: np.ndarray) -> bytes:
        x = np.zeros(len(ids), form)
        x["dist"], x["waits"] = np.where(ids == source, 0, UNREACHED), ids == source
        return x.tobytes()

    state, least = blocks.start(begin), 0
    while least is not None:
        end = UNREACHED if delta is None else (least // delta + 1) * delta

        def waiting(x: bytes, end: int = end) -> np.ndarray:
            x = np.frombuffer(x, form)
            return np.where(x["waits"] & (x["dist"] < end), x["dist"].astype(np.int64), NEUTRAL["least"])

        def offered(x: bytes, got: np.ndarray, end: int = end):
            x = np.frombuffer(x, form).copy()
            better = got < x["dist"]
            x["waits"] = x["waits"] & (x["dist"] >= end) | better
            x["dist"] = np.where(better, got, x["dist"])
            return x.tobytes(), float(x["dist"][x["waits"]].min()) if x["waits"].any() else None

        state, seen = tables.write(blocks.step(state, waiting, "least", offered), "step", 2, least=F.min("figure"))
        least = None if seen["least"] is None else int(seen["least"])
    return blocks.rows(state, lambda x: np.frombuffer(x, form)["dist"].astype(np.int64), "dist", "bigint")
