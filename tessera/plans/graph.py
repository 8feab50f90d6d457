"""A graph is two facts and a table: how many vertices, whether edges have a direction, and the edges."""

from __future__ import annotations

import contextlib
import weakref
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import numbered
from tessera.plans.loop import Tables

if TYPE_CHECKING:
    from tessera.plans.blocks import Blocks

SCHEMA = "src bigint, dst bigint"
WEIGHTED_SCHEMA = "src bigint, dst bigint, w int"


#: Edges of one vertex from which on they may be dealt to several partitions.
HUB_EDGES = 1_000_000


def _unpersist(df: DataFrame) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        df.unpersist()


class KeptEdges:
    """Edges hash-partitioned and sorted by source and kept that way, so that iterations shuffle and sort vertex state only.

    The edges of a hub, a vertex with more of them than a quarter of an even share, are dealt to several slices by their other
    end, and state is copied to each slice of a hub when it meets them. Hubs are at most four for each partition, so their
    table may be broadcast. Kept partitions that are lost with an executor are made again; they go when nothing uses this object.
    """

    def __init__(self, edges: DataFrame, entries: int):
        spark = edges.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        most = max(HUB_EDGES, entries // (4 * n))
        self.hubs, self.keys = None, ["src"]
        if entries > most:
            large = edges.groupBy("src").agg(F.count("*").alias("d")).where(F.col("d") > most)
            rows = [(r.src, -(-r.d // most)) for r in large.collect()]
            if rows:
                self.hubs, self.keys = spark.createDataFrame(rows, "src bigint, slices bigint"), ["src", "slice"]
                edges = edges.join(F.broadcast(self.hubs), "src", "left").withColumn("slice", F.pmod(F.xxhash64("dst"), F.coalesce("slices", F.lit(1)))).drop("slices")
        self.edges = edges.repartition(n, *self.keys).sortWithinPartitions(*self.keys).persist(StorageLevel.MEMORY_AND_DISK)
        weakref.finalize(self, _unpersist, self.edges).atexit = False

    def along(self, state: DataFrame) -> DataFrame:
        """Rows of ``state`` (src and more) joined to the edges that leave their src."""
        if self.hubs is None:
            return state.join(self.edges, "src")
        sliced = state.join(F.broadcast(self.hubs), "src", "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
        return sliced.join(self.edges, self.keys).drop("slice")


@dataclass
class Graph:
    """Vertices are 0..num_nodes-1. ``edges`` has one row for each adjacency entry: both directions of an undirected edge."""

    spark: SparkSession
    edges: DataFrame
    num_nodes: int
    directed: bool
    weighted: bool = False
    _kept: KeptEdges | None = field(default=None, repr=False)
    _blocks: Blocks | None = field(default=None, repr=False)
    _entries: int | None = field(default=None, repr=False)

    # --- sizes

    @property
    def num_entries(self) -> int:
        """Adjacency entries: each undirected edge counts twice."""
        if self._entries is None:
            self._entries = self.edges.count()
        return self._entries

    @property
    def num_edges(self) -> int:
        return self.num_entries if self.directed else self.num_entries // 2

    @property
    def num_edges_directed(self) -> int:
        return self.num_entries

    def vertices(self) -> DataFrame:
        return self.spark.range(self.num_nodes)

    # --- physical form

    def kept(self) -> KeptEdges:
        """The edges by source, made at first use and kept as long as the graph."""
        if self._kept is None:
            self._kept = KeptEdges(self.edges, self.num_entries)
        return self._kept

    def blocks(self) -> Blocks:
        """The edges as arrays, made and kept in the same way."""
        from tessera.plans.blocks import Blocks

        if self._blocks is None:
            self._blocks = Blocks(self.edges, self.num_nodes, self.num_entries)
        return self._blocks

    def release(self) -> None:
        if self._blocks is not None:
            self._blocks.release()
            self._blocks = None
        if self._kept is not None:
            _unpersist(self._kept.edges)
            self._kept = None

    # --- access

    def transpose(self) -> Graph:
        """Every edge turned round; an undirected graph is its own transpose."""
        if not self.directed:
            return self
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.spark, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), self.num_nodes, True, self.weighted)

    def _degree(self, key: str, name: str) -> DataFrame:
        n = self.edges.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
        return self.vertices().join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias(name))

    def out_degree(self) -> DataFrame:
        """(id, out_degree) of every vertex."""
        return self._degree("src", "out_degree")

    def in_degree(self) -> DataFrame:
        return self._degree("dst", "in_degree")

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree) of every vertex, isolated ones too."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
        n = ends.groupBy("e.id").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"))
        return self.vertices().join(n, "id", "left").select("id", F.coalesce("o", F.lit(0)).cast("bigint").alias("out_degree"), F.coalesce("i", F.lit(0)).cast("bigint").alias("in_degree"))

    def degree_histogram(self) -> DataFrame:
        """(out_degree, vertices)."""
        return self.out_degree().groupBy("out_degree").agg(F.count("*").alias("vertices"))

    def adjacency(self, outgoing: bool = True) -> DataFrame:
        """(id, neighbors): sorted neighbours as an array; with weights an array of (v, w)."""
        key, other = ("src", "dst") if outgoing else ("dst", "src")
        item = F.struct(F.col(other).alias("v"), "w") if self.weighted else F.col(other)
        lists = self.edges.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(item)).alias("neighbors"))
        kind = lists.schema["neighbors"].dataType
        return self.vertices().join(lists, "id", "left").select("id", F.coalesce("neighbors", F.array().cast(kind)).alias("neighbors"))

    def _ordered(self, outgoing: bool) -> DataFrame:
        """(id, neighbor, and w with weights, k): each vertex's neighbours numbered from 1 in order. No list is made, so hubs are sorted with spilling."""
        key, other = ("src", "dst") if outgoing else ("dst", "src")
        rest = ["w"] if self.weighted else []
        order = Window.partitionBy("id").orderBy("neighbor", *rest)
        return self.edges.select(F.col(key).alias("id"), F.col(other).alias("neighbor"), *rest).withColumn("k", F.row_number().over(order))

    def neighbors(self, start: int = 0, outgoing: bool = True) -> DataFrame:
        """(id, place, neighbor): each vertex's neighbours in order, from the ``start``-th on; none where it has fewer."""
        found = self._ordered(outgoing).where(F.col("k") > start)
        return found.select("id", (F.col("k") - 1).alias("place"), "neighbor", *(["w"] if self.weighted else []))

    def neighbor_at(self, place: int, outgoing: bool = True) -> DataFrame:
        """(id, neighbor): one neighbour by its place in order, null where there are fewer. Tasks give up no more than ``place + 1`` of a vertex."""
        found = self._ordered(outgoing).where(F.col("k") == place + 1).select("id", "neighbor")
        return self.vertices().join(found, "id", "left")

    def adjacency_offsets(self) -> DataFrame:
        """(id, offset, out_degree): where each vertex's neighbours start when all lists follow each other.

        Ids are dense, so blocks of ids are summed first and a row a block gets the running sum.
        """
        block = max(1, self.num_nodes // 4096)
        d = self.out_degree().withColumn("b", F.expr(f"id div {block}"))
        sums = d.groupBy("b").agg(F.sum("out_degree").alias("n"))
        base = sums.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        inner = F.coalesce(F.sum("out_degree").over(Window.partitionBy("b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return d.withColumn("inner", inner).join(base, "b").select("id", (F.col("base") + F.col("inner")).cast("bigint").alias("offset"), "out_degree")

    def stats(self) -> DataFrame:
        """One row: nodes, edges, degree (edges / nodes, rounded down), directed."""
        m = self.edges.agg(F.count("*").alias("n"))
        edges = F.col("n") if self.directed else F.expr("n div 2")
        nodes = F.lit(self.num_nodes).cast("bigint")
        return m.select(nodes.alias("nodes"), edges.alias("edges"), F.when(nodes > 0, F.floor(F.try_divide(edges, nodes))).otherwise(0).cast("bigint").alias("degree"), F.lit(self.directed).alias("directed"))

    def describe(self) -> str:
        r = self.stats().first()
        return f"Graph has {r.nodes} nodes and {r.edges} {'' if r.directed else 'un'}directed edges for degree: {r.degree}"

    def topology(self, rows: int | None = None, width: int | None = None, outgoing: bool = True) -> DataFrame:
        """(id, line): ``id: n1 n2 ...`` for each vertex, or for the first ``rows`` with up to ``width`` neighbours."""
        lists = self.adjacency(outgoing)
        item = (lambda x: F.concat_ws(":", x["v"].cast("string"), x["w"].cast("string"))) if self.weighted else (lambda x: x.cast("string"))
        shown = F.col("neighbors") if width is None else F.slice("neighbors", 1, width)
        out = lists.select("id", F.concat(F.col("id").cast("string"), F.lit(": "), F.array_join(F.transform(shown, item), " ")).alias("line"))
        return out.orderBy("id") if rows is None else out.where(F.col("id") < rows).orderBy("id")

    def where_vertices(self, condition: Column) -> DataFrame:
        """Vertices by a predicate over id, out_degree and in_degree."""
        return self.degrees().where(condition)


# --- building --------------------------------------------------------------------------------------------------------


def max_node_id(edges: DataFrame) -> DataFrame:
    """One row: the largest id over both ends (null without edges). Self-loops count."""
    return edges.agg(F.max(F.greatest("src", "dst")).alias("max_node_id"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def symmetrized(edges: DataFrame) -> DataFrame:
    """Both directions of each raw edge, repetitions kept."""
    return edges.unionByName(reversed_edges(edges))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def deduplicated(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst); of repeated edges the least weight stays."""
    if "w" in edges.columns:
        return edges.groupBy("src", "dst").agg(F.min("w").alias("w"))
    return edges.select("src", "dst").distinct()


def from_edges(raw: DataFrame, *, symmetrize: bool = False, weighted: bool | None = None, num_nodes: int | None = None, tables: Tables | None = None) -> Graph:
    """A graph from raw edges: ids up to the largest of the raw list, no self-loops, no repeated edges.

    Pooling both directions before deduplication gives both sides of an undirected edge the same least weight. The edges are
    written once, so kernels neither recompute nor re-read their source.
    """
    spark = raw.sparkSession
    weighted = ("w" in raw.columns) if weighted is None else weighted
    raw = raw.select("src", "dst", "w") if weighted else raw.select("src", "dst")
    if num_nodes is None:
        top = max_node_id(raw).first()[0]
        num_nodes = 0 if top is None else int(top) + 1
    clean = deduplicated(without_loops(symmetrized(raw) if symmetrize else raw))
    tables = tables or Tables(spark, "graph")
    edges, seen = tables.write(clean, "edges", n=F.count("*"))
    return Graph(spark, edges, num_nodes, not symmetrize, weighted, _entries=int(seen["n"]))


def relabel_map(graph: Graph, tables: Tables | None = None) -> DataFrame:
    """(id, new_id): 0 is the vertex of highest degree; of equal degrees the higher id comes first."""
    if graph.directed:
        raise ValueError("relabelling by degree needs an undirected graph")
    d = graph.out_degree()
    return numbered(d, [F.desc("out_degree"), F.desc("id")], "new_id", tables or Tables(graph.spark, "relabel")).select("id", "new_id")


def relabel_by_degree(graph: Graph, tables: Tables | None = None) -> Graph:
    """The same graph with vertices renamed by ``relabel_map``."""
    names = relabel_map(graph, tables)
    rest = ["w"] if graph.weighted else []
    e = graph.edges.join(names.select(F.col("id").alias("src"), F.col("new_id").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("new_id").alias("b")), "dst")
    return Graph(graph.spark, e.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest), graph.num_nodes, False, graph.weighted, _entries=graph._entries)
