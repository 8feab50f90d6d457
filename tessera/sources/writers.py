"""Edge lists, the binary CSR form, result files, and conversion between formats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import numbered
from tessera.plans.graph import Graph
from tessera.plans.loop import Tables
from tessera.sources.readers import GraphFormatError

_INT32 = 2**31 - 1
#: Values that one write to a file takes, about.
_CHUNK = 1 << 18


def write_edge_list(graph: Graph, path: str) -> None:
    """``u v`` (or ``u v w``) for each adjacency entry, by u and v over the parts of ``path``; undirected edges appear twice."""
    cols = ["src", "dst", "w"] if graph.weighted else ["src", "dst"]
    graph.edges.select(*cols).orderBy("src", "dst").select(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]).alias("value")).write.text(path)


def write_serialized(graph: Graph, path: str) -> None:
    """The binary form, one file; ids and weights must fit 32 bits.

    Every value's place in the file is known, so in a file system that is mounted (``file:``) tasks put them there and nothing
    passes through the driver. Others have no writes at a place: there the driver streams chunks in order.
    """
    if graph.num_nodes - 1 > _INT32:
        raise GraphFormatError("ids don't fit 32 bits")
    if graph.weighted and (graph.edges.agg(F.max(F.abs("w"))).first()[0] or 0) > _INT32:
        raise GraphFormatError("weights don't fit 32 bits")
    spark = graph.spark
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    head = np.array([graph.directed], "?").tobytes() + np.array([graph.num_entries, graph.num_nodes], "<i8").tobytes()
    parts = (graph, graph.transpose()) if graph.directed else (graph,)
    uri = files.makeQualified(at).toUri()
    if uri.getScheme() == "file":
        files.delete(at, False)  # its checksums go too
        files.mkdirs(files.makeQualified(at).getParent())
        _put(parts, head, uri.getPath())
        return
    out = files.create(at, True)
    try:
        out.write(bytearray(head))
        for part in parts:
            _stream(part.adjacency_offsets().orderBy("id").select(F.col("offset").alias("a")), out, "<i8")
            out.write(bytearray(np.array([graph.num_entries], "<i8").tobytes()))
            _stream(part.edges.orderBy("src", "dst").select(*_entry(part)), out, "<i4")
    finally:
        out.close()


def _entry(graph: Graph) -> list:
    return [F.col("dst").cast("int").alias("a"), *([F.col("w").alias("b")] if graph.weighted else [])]


def _put(parts: tuple[Graph, ...], head: bytes, name: str) -> None:
    """Makes the file and lets tasks put offsets and entries at their places."""
    nodes, entries, width = parts[0].num_nodes, parts[0].num_entries, 8 if parts[0].weighted else 4
    with open(name, "wb") as file:
        file.write(head)
        for i in range(len(parts)):
            file.seek(len(head) + i * (8 * (nodes + 1) + width * entries) + 8 * nodes)
            file.write(np.array([entries], "<i8").tobytes())
        file.truncate(len(head) + len(parts) * (8 * (nodes + 1) + width * entries))
    start = len(head)
    for part in parts:
        tables = Tables(part.spark, "places")
        offsets = part.adjacency_offsets().select(F.col("id").alias("k"), F.col("offset").alias("a")).sortWithinPartitions("k")
        _at_places(offsets, nodes, name, start, "<i8")
        start += 8 * (nodes + 1)
        _at_places(numbered(part.edges, [F.col("src"), F.col("dst")], "k", tables).select("k", *_entry(part)), entries, name, start, "<i4")
        start += width * entries
        for path in list(tables.made["k"]):
            tables.drop(path)


def _at_places(rows: DataFrame, n: int, name: str, start: int, kind: str) -> None:
    """Puts the values of ``n`` rows into a file by their number k. Doing it twice does no harm, so tasks may be repeated."""

    def put(batches):
        import pandas as pd

        done = 0
        with open(name, "r+b") as file:
            for b in batches:
                k, data = b["k"].to_numpy(), b.drop(columns="k").to_numpy(kind)
                cuts = [0, *(np.flatnonzero(np.diff(k) != 1) + 1).tolist(), len(k)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if lo < hi:
                        file.seek(start + data.itemsize * data.shape[1] * int(k[lo]))
                        file.write(data[lo:hi].tobytes())
                done += len(k)
        yield pd.DataFrame({"n": [done]})

    if (rows.mapInPandas(put, "n bigint").agg(F.sum("n")).first()[0] or 0) != n:
        raise GraphFormatError(f"{name}: rows are missing")


def _stream(rows: DataFrame, out, kind: str) -> None:
    """Values of rows in their order. Tasks make the bytes, so that the driver only passes chunks on: the form is one file."""

    def pack(batches):
        import pandas as pd

        held, size = [], 0
        for b in batches:
            held.append(b.to_numpy(kind).tobytes())
            size += b.size
            if size >= _CHUNK:
                yield pd.DataFrame({"bytes": [b"".join(held)]})
                held, size = [], 0
        if held:
            yield pd.DataFrame({"bytes": [b"".join(held)]})

    for r in rows.mapInPandas(pack, "bytes binary").toLocalIterator(prefetchPartitions=True):
        out.write(bytearray(r.bytes))


def write_graph(graph: Graph, path: str, serialized: bool = False) -> None:
    if not path:
        raise ValueError("no output file")
    (write_serialized if serialized else write_edge_list)(graph, path)


def write_results(result: DataFrame, path: str, trial: int = 0) -> None:
    """A kernel's result in order of vertices, under its trial."""
    ordered = result.orderBy("id") if "id" in result.columns else result
    ordered.write.mode("overwrite").parquet(f"{path}/trial={trial}")


def write_result_lines(result: DataFrame, column: str, path: str) -> None:
    """One value a line in order of vertices."""
    value = F.col(column)
    if dict(result.dtypes)[column] == "double":
        value = F.format_string("%.17g", value)
    result.orderBy("id").select(value.cast("string").alias("value")).write.text(path)


def read_results(spark: SparkSession, path: str, trial: int | None = None) -> DataFrame:
    """Results with their trial, or those of one trial."""
    found = spark.read.parquet(path)
    return found if trial is None else found.where(F.col("trial") == trial).drop("trial")


def convert(spark: SparkSession, source: str, target: str, *, serialized: bool = False, weighted: bool = False, symmetrize: bool = False) -> Graph:
    """Reads a graph file, builds the graph and writes it in another format."""
    from tessera.sources.load import load_graph

    graph = load_graph(spark, source, symmetrize=symmetrize, weighted=weighted, tables=Tables(spark, "convert"))
    write_graph(graph, target, serialized)
    return graph
