"""Independent checks of results: each returns one row whose figures are all 0 where the result is right."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.pagerank import DAMPING
from tessera.operators.sssp import UNREACHED
from tessera.plans.blocks import Blocks
from tessera.plans.graph import Graph, reversed_edges
from tessera.plans.loop import Tables


def _bad(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def _one_row(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # each side is one row
    return out


def verify_bfs(graph: Graph, source: int, tree: DataFrame) -> DataFrame:
    """Depths must be shortest: the source alone has 0, no edge skips a level or leaves the reached part, and every other
    reached vertex has a parent one level up over an edge."""
    t = tree.select("id", "depth", "parent")
    here = t.agg(_bad((F.col("id") == source) != (F.col("depth") == 0), "bad_source"), _bad((F.col("id") == source) & (F.col("parent") != source), "bad_source_parent"), _bad((F.col("depth") < 0) != (F.col("parent") < 0), "bad_unreached"))
    edges = graph.edges.select("src", "dst")
    ends = edges.join(t.select(F.col("id").alias("src"), F.col("depth").alias("a")), "src").join(t.select(F.col("id").alias("dst"), F.col("depth").alias("b")), "dst")
    skips = ends.agg(_bad((F.col("a") >= 0) & ((F.col("b") < 0) | (F.col("b") > F.col("a") + 1)), "bad_edges"))
    child = t.where((F.col("depth") > 0)).select(F.col("id").alias("dst"), F.col("parent").alias("src"), "depth")
    up = child.join(edges.withColumn("e", F.lit(1)), ["src", "dst"], "left").join(t.select(F.col("id").alias("src"), F.col("depth").alias("p")), "src", "left")
    parents = up.agg(_bad(F.col("e").isNull() | F.col("p").isNull() | (F.col("p") != F.col("depth") - 1), "bad_parents"))
    missing = F.abs(F.count("*") - F.lit(graph.num_nodes)).alias("bad_rows")
    return _one_row(here, skips, parents, t.agg(missing))


def verify_sssp(graph: Graph, source: int, distances: DataFrame) -> DataFrame:
    """No edge can shorten a distance, and every reached vertex but the source has an edge that gives exactly its distance
    (enough for positive weights)."""
    t = distances.select("id", "dist")
    ends = graph.edges.join(t.select(F.col("id").alias("src"), F.col("dist").alias("a")), "src").join(t.select(F.col("id").alias("dst"), F.col("dist").alias("b")), "dst")
    reached = F.col("a") < UNREACHED
    relax = ends.agg(_bad(reached & (F.col("a") + F.col("w") < F.col("b")), "relaxable"))
    tight = ends.where(reached & (F.col("a") + F.col("w") == F.col("b"))).select(F.col("dst").alias("id")).distinct()
    loose = t.where((F.col("dist") < UNREACHED) & (F.col("id") != source)).join(tight, "id", "left_anti").agg(F.count("*").alias("without_tight_edge"))
    here = t.agg(_bad((F.col("id") == source) & (F.col("dist") != 0), "bad_source"), F.abs(F.count("*") - F.lit(graph.num_nodes)).alias("bad_rows"))
    return _one_row(here, relax, loose)


def verify_cc(graph: Graph, labels: DataFrame) -> DataFrame:
    """No edge joins two labels; a label is the least member of its component; and there are as many labels as components,
    which are counted by running ``shiloach_vishkin`` over the graph once more.

    ``bad_labels``: rows whose label is null or larger than their id, and those whose label names no vertex or one of another label.
    """
    from tessera.operators.components import shiloach_vishkin

    t = labels.select("id", "comp")
    ends = graph.edges.join(t.select(F.col("id").alias("src"), F.col("comp").alias("a")), "src").join(t.select(F.col("id").alias("dst"), F.col("comp").alias("b")), "dst")
    cross = ends.agg(_bad(F.col("a") != F.col("b"), "cross_edges"))
    named = t.join(t.where("id = comp").select(F.col("comp").alias("root")).distinct(), F.col("comp") == F.col("root"), "left")
    own = named.agg(_bad(F.col("root").isNull() | (F.col("comp") > F.col("id")), "bad_labels"), F.abs(F.count("*") - F.lit(graph.num_nodes)).alias("bad_rows"), F.count_distinct("comp").alias("labels"))
    other = shiloach_vishkin(graph).agg(F.count_distinct("comp").alias("components"))
    return _one_row(cross, own, other).select("cross_edges", "bad_labels", "bad_rows", F.abs(F.col("labels") - F.col("components")).alias("label_difference"))


def pagerank_residual(graph: Graph, scores: DataFrame, damping: float = DAMPING) -> DataFrame:
    """One row: residual, the total change that one more iteration (pushed along out-edges) would make."""
    n = graph.num_nodes
    degree = graph.edges.groupBy("src").agg(F.count("*").alias("d"))
    share = scores.select(F.col("id").alias("src"), "score").join(degree, "src").select("src", (F.col("score") / F.col("d")).alias("share"))
    got = graph.edges.select("src", "dst").join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
    change = scores.join(got, "id", "left").select(F.abs(F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0)) - F.col("score")).alias("c"))
    return change.agg(F.sum("c").alias("residual"))


def verify_pagerank(graph: Graph, scores: DataFrame, epsilon: float = 1e-4, damping: float = DAMPING) -> DataFrame:
    return pagerank_residual(graph, scores, damping).select((F.coalesce("residual", F.lit(0.0)) >= epsilon).cast("int").alias("not_converged"))


def differing(a: DataFrame, b: DataFrame, column: str, tolerance: float) -> DataFrame:
    """One row: how many vertices have values of two results that differ by more than the tolerance."""
    both = a.select("id", F.col(column).alias("x")).join(b.select("id", F.col(column).alias("y")), "id", "full")
    return both.agg(_bad(F.col("x").isNull() | F.col("y").isNull() | (F.abs(F.col("x") - F.col("y")) > tolerance), "different"))


def verify_betweenness(graph: Graph, sources: list[int], scores: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Brandes' algorithm once more, one source at a time over edges as arrays, by other code than the kernel's and without its
    tables of levels. The state is 28 bytes a vertex, in ranges; the driver holds none of it."""
    tables, forth = Tables(graph.spark, "brandes"), graph.blocks()
    back = Blocks(reversed_edges(graph.edges.select("src", "dst")), graph.num_nodes, graph.num_entries) if graph.directed else forth
    form = np.dtype([("depth", "<i4"), ("sigma", "<f8"), ("delta", "<f8"), ("total", "<f8")])
    state, before = forth.start(lambda ids: np.zeros(len(ids), form).tobytes()), 0
    for source, times in [*Counter(sources).items(), (None, 0)]:

        def begin(x: bytes, first: int, source: int | None = source, before: int = before) -> bytes:
            x = np.frombuffer(x, form).copy()
            x["total"] += before * x["delta"]
            x["depth"], x["sigma"], x["delta"] = -1, 0.0, 0.0
            if source is not None and 0 <= source - first < len(x):
                x["depth"][source - first], x["sigma"][source - first] = 0, 1.0
            return x.tobytes()

        state, before = forth.each(state, begin), times
        if source is None:
            break
        depth, found = -1, 1
        while found:
            depth += 1

            def paths(x: bytes, depth: int = depth) -> np.ndarray:
                x = np.frombuffer(x, form)
                return np.where(x["depth"] == depth, x["sigma"], 0.0)

            def counted(x: bytes, got: np.ndarray, depth: int = depth):
                x = np.frombuffer(x, form).copy()
                new = (x["depth"] < 0) & (got > 0)
                x["depth"][new], x["sigma"][new] = depth + 1, got[new]
                return x.tobytes(), float(new.sum())

            state, seen = tables.write(forth.step(state, paths, "add", counted), "state", 2, found=F.sum("figure"))
            found = seen["found"]
        for level in range(depth - 1, -1, -1):

            def shares(x: bytes, level: int = level) -> np.ndarray:
                x = np.frombuffer(x, form)
                return np.divide(1 + x["delta"], x["sigma"], out=np.zeros(len(x)), where=x["depth"] == level + 1)

            def depend(x: bytes, got: np.ndarray, level: int = level):
                x = np.frombuffer(x, form).copy()
                here = x["depth"] == level
                x["delta"][here] = x["sigma"][here] * got[here]
                return x.tobytes(), None

            state, _ = tables.write(back.step(state, shares, "add", depend), "state", 2)
    if back is not forth:
        back.release()
    totals = forth.rows(state, lambda x: np.frombuffer(x, form)["total"], "total", "double")
    top = totals.agg(F.max("total")).first()[0] or 0.0
    return differing(scores, totals.select("id", (F.col("total") / top if top else F.lit(0.0)).alias("score")), "score", tolerance)


def verify_triangles(graph: Graph, count: int) -> DataFrame:
    """Counted once more, the other way round than by the kernel: edges lead from lower to higher (degree, -id), and the whole list
    of an edge's end comes to its start, where what it shares with the list there closes triangles.

    A list is no longer than the square root of twice the edges, and a vertex gets no more lists than it has edges in its own.
    """
    e = graph.edges.select("src", "dst")
    degree = e.groupBy("src").agg(F.count("*").alias("d"))
    ends = e.where("src > dst").join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("b")), "dst")
    up = F.col("d") < F.col("b")  # of equal degrees the larger id, src, comes first
    start, end = F.when(up | (F.col("d") == F.col("b")), F.col("src")).otherwise(F.col("dst")), F.when(up | (F.col("d") == F.col("b")), F.col("dst")).otherwise(F.col("src"))
    kind = "int" if graph.num_nodes < 1 << 31 else "bigint"
    leads = ends.select(start.alias("u"), end.alias("v"))
    lists = leads.groupBy("u").agg(F.collect_list(F.col("v").cast(kind)).alias("list"))
    come = leads.join(lists.select(F.col("u").alias("v"), F.col("list").alias("other")), "v").select("u", "other")
    closed = come.join(lists, "u").agg(F.coalesce(F.sum(F.size(F.array_intersect("list", "other"))), F.lit(0)).alias("s"))
    return closed.select(F.abs(F.col("s") - F.lit(count)).alias("difference"))


def verify_unimplemented(result: DataFrame) -> DataFrame:
    """For a kernel without a check: says so, and never passes."""
    print("** verify unimplemented **")
    return result.sparkSession.range(1).select(F.lit(1).alias("unimplemented"))
