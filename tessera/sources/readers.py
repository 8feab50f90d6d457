"""Graph files: edge lists, DIMACS, METIS, Matrix Market and the binary CSR form."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.graph import Graph
from tessera.plans.loop import Tables

#: Suffixes of files that hold raw edges, and of those that hold a built graph.
TEXT_SUFFIXES = ("el", "wel", "gr", "graph", "mtx")
BINARY_SUFFIXES = ("sg", "wsg")
#: A vertex id or a weight, as edge lists write it.
_INT = r"^[+-]?[0-9]{1,18}$"


class GraphFormatError(ValueError):
    """A file that isn't what its suffix says, or a suffix that isn't known."""


def suffix_of(path: str) -> str:
    """What follows the last dot of the file's name."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." not in name:
        raise GraphFormatError(f"{path} has no suffix")
    suffix = name.rsplit(".", 1)[-1]
    if suffix not in TEXT_SUFFIXES + BINARY_SUFFIXES:
        raise GraphFormatError(f"{path}: unknown suffix .{suffix}")
    return suffix


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, m, value): lines with an order: by file, by block of it, and within a block by m."""
    try:
        return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("value"))
    except AnalysisException as e:
        raise FileNotFoundError(path) from e


def _numbered(lines: DataFrame, tables: Tables) -> DataFrame:
    """``lines`` with ``line``, 0-based over all of them. Blocks number their own lines; a row a block makes the offsets."""
    lines, _ = tables.write(lines, "lines")
    own = lines.withColumn("k", F.row_number().over(Window.partitionBy("file", "block").orderBy("m")) - 1)
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    offsets = sizes.select("file", "block", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    return own.join(offsets, ["file", "block"]).select((F.col("o") + F.col("k")).cast("bigint").alias("line"), "value")


def _ints(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Rows of ``width`` integers from a stream of tokens, up to the first that is none; line ends are white space.

    Where every line has ``width`` integers, lines are rows and need no order. Otherwise tokens are numbered over the file.
    """
    lines = _lines(spark, path).where("value <> ''")
    words = lines.withColumn("t", F.split("value", " "))
    odd = (F.size("t") != width) | ~F.forall("t", lambda x: x.rlike(_INT))
    if not words.where(odd).take(1):
        return words.select(F.col("t"))
    tables = Tables(spark, "tokens")
    tokens = _numbered(lines, tables).select("line", F.posexplode(F.split("value", " ")).alias("p", "x"))
    per = tokens.groupBy("line").agg(F.count("*").alias("n"))
    blocks = per.withColumn("b", F.expr("line div 65536"))
    base = blocks.groupBy("b").agg(F.sum("n").alias("s")).select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("before", before).join(base, "b").select("line", (F.col("base") + F.col("before")).alias("first"))
    placed = tokens.join(starts, "line").select((F.col("first") + F.col("p")).alias("at"), "x")
    bad = placed.where(~F.col("x").rlike(_INT)).agg(F.min("at")).first()[0]
    if bad is not None:
        placed = placed.where(F.col("at") < bad)
    rows = placed.groupBy(F.expr(f"at div {width}").alias("row")).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("a")).where(F.size("a") == width)
    return rows.select(F.transform("a", lambda s: s["x"]).alias("t"))


def _edge(t: Column, shift: int, weight: Column | None) -> list[Column]:
    ends = [(t[0].cast("bigint") + shift).alias("src"), (t[1].cast("bigint") + shift).alias("dst")]
    return ends if weight is None else [*ends, weight.cast("int").alias("w")]


def read_el(spark: SparkSession, path: str) -> DataFrame:
    """``u v`` pairs, 0-based."""
    return _ints(spark, path, 2).select(*_edge(F.col("t"), 0, None))


def read_wel(spark: SparkSession, path: str) -> DataFrame:
    """``u v w`` triples, 0-based."""
    return _ints(spark, path, 3).select(*_edge(F.col("t"), 0, F.col("t")[2]))


def read_gr(spark: SparkSession, path: str) -> DataFrame:
    """DIMACS: lines ``a u v w``, 1-based; other lines are ignored."""
    arcs = _lines(spark, path).where("value like 'a %'").select(F.split("value", " ").alias("t"))
    return arcs.select((F.col("t")[1].cast("bigint") - 1).alias("src"), (F.col("t")[2].cast("bigint") - 1).alias("dst"), F.col("t")[3].cast("int").alias("w"))


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """METIS: a header ``n m [fmt]``, then a line of 1-based neighbours for each vertex; fmt 1 has a weight after each. ``%`` lines are comments."""
    tables = Tables(spark, "metis")
    lines = _numbered(_lines(spark, path).where("value not like '%\\%%' or value not rlike '^%'"), tables)
    head = lines.where("line = 0").first()
    parts = head.value.split() if head else []
    if len(parts) < 2 or not all(p.isdigit() for p in parts):
        raise GraphFormatError(f"{path}: no header")
    fmt = parts[2] if len(parts) > 2 else "0"
    if fmt not in ("0", "00", "000", "1", "01", "001", "100"):
        raise GraphFormatError(f"{path}: format {fmt} isn't supported")
    n, weighted = int(parts[0]), fmt.lstrip("0") == "1"
    rows = lines.where(F.col("line").between(1, n) & (F.col("value") != "")).select((F.col("line") - 1).alias("src"), F.split("value", " ").alias("t"))
    if weighted:
        pairs = rows.select("src", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("t") / 2).cast("int") - 1), lambda i: F.struct(F.get("t", i * 2).alias("v"), F.get("t", i * 2 + 1).alias("w")))).alias("p"))
        return pairs.select("src", (F.col("p.v").cast("bigint") - 1).alias("dst"), F.col("p.w").cast("int").alias("w"))
    return rows.select("src", F.explode("t").alias("v")).select("src", (F.col("v").cast("bigint") - 1).alias("dst"))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """Matrix Market coordinates, 1-based. A symmetric matrix gives each entry the other way round too; weights become integers."""
    lines = _lines(spark, path)
    first = lines.orderBy("file", "block", "m").first()
    head = first.value.split() if first else []
    if len(head) != 5 or head[0] != "%%MatrixMarket" or head[1] != "matrix":
        raise GraphFormatError(f"{path}: not a Matrix Market file")
    _, _, layout, field, symmetry = head
    if layout != "coordinate":
        raise GraphFormatError(f"{path}: {layout} isn't supported")
    if field not in ("pattern", "real", "double", "integer"):
        raise GraphFormatError(f"{path}: field {field} isn't supported")
    if symmetry not in ("general", "symmetric", "skew-symmetric"):
        raise GraphFormatError(f"{path}: symmetry {symmetry} isn't supported")
    body = lines.where("value <> '' and not startswith(value, '%')")
    size = body.orderBy("file", "block", "m").first()
    dims = size.value.split() if size else []
    if len(dims) < 2 or dims[0] != dims[1]:
        raise GraphFormatError(f"{path}: not a square matrix")
    rest = body.where(~((F.col("file") == size.file) & (F.col("block") == size.block) & (F.col("m") == size.m)))
    weight = None if field == "pattern" else F.col("t")[2].cast("double")
    edges = rest.select(F.split("value", " ").alias("t")).select(*_edge(F.col("t"), -1, weight))
    if symmetry == "symmetric":
        turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *edges.columns[2:])
        edges = edges.unionByName(turned)
    return edges


READERS = {"el": read_el, "wel": read_wel, "gr": read_gr, "graph": read_metis, "mtx": read_mtx}


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Raw edges of a text file, by its suffix: (src, dst), with w where the file has weights."""
    suffix = suffix_of(path)
    if suffix in BINARY_SUFFIXES:
        raise GraphFormatError(f"{path} holds a built graph")
    return READERS[suffix](spark, path)


def read_table(spark: SparkSession, path: str, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """Raw edges of a Parquet table; only the named columns are read."""
    t = spark.read.parquet(path)
    cols = [F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst")]
    return t.select(*cols, *([F.col(weight).cast("int").alias("w")] if weight else []))


#: The binary form: bool directed, int64 entries, int64 nodes, int64 offsets[nodes + 1], int32 neighbours (or pairs of
#: neighbour and weight); directed graphs have offsets and neighbours of the transpose after that. Little-endian.
HEADER = 17
#: Entries that are decoded at a time, slices of so many that a task takes, and offsets that are read at a time.
SLICE, SLICES, OFFSETS = 1 << 20, 32, 1 << 17


def _decoded(file, lo: int, hi: int, vertex: int, nodes: int, weighted: bool):
    """(src, dst and w) of entries ``lo`` to ``hi`` of an open file; ``vertex`` is none after the one that has ``lo``."""
    width = 8 if weighted else 4
    while lo < hi:
        last = min(vertex + OFFSETS, nodes)
        off = np.frombuffer(file.read_at(8 * (last - vertex + 1), HEADER + 8 * vertex), "<i8")
        end = min(hi, int(off[-1]))
        if end > lo:
            src = vertex + np.searchsorted(off, np.arange(lo, end), "right") - 1
            raw = file.read_at(width * (end - lo), HEADER + 8 * (nodes + 1) + width * lo)
            yield src, np.frombuffer(raw, "<i4").reshape(end - lo, -1)
            lo = end
        elif last == nodes:
            raise GraphFormatError("offsets end before the entries")
        vertex = last if lo >= off[-1] else int(src[-1])


def _vertex_of(file, entry: int, nodes: int) -> int:
    """The vertex that has an entry, by bisection of the offsets."""
    lo, hi = 0, nodes
    while lo < hi:
        mid = (lo + hi) // 2
        if int.from_bytes(file.read_at(8, HEADER + 8 * (mid + 1)), "little") > entry:
            hi = mid
        else:
            lo = mid + 1
    return lo


def read_serialized(spark: SparkSession, path: str) -> Graph:
    """A built graph from ``.sg`` or ``.wsg``, as it is: nothing is removed or sorted. Tasks read slices of the entries.

    A file system that pyarrow doesn't know gives the file as one row, of up to 2 GB.
    """
    import pyarrow
    from pyarrow import fs as arrow_fs

    weighted = suffix_of(path) == "wsg"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        raise FileNotFoundError(path)
    stream = files.open(at)
    try:
        raw = bytes(stream.readNBytes(HEADER))
    finally:
        stream.close()
    size, uri = files.getFileStatus(at).getLen(), files.makeQualified(at).toUri()
    directed, entries, nodes = bool(raw[:1] != b"\0"), int.from_bytes(raw[1:9], "little"), int.from_bytes(raw[9:17], "little")
    if size < HEADER + (2 if directed else 1) * (8 * (nodes + 1) + (8 if weighted else 4) * entries):
        raise GraphFormatError(f"{path} is shorter than its header says")
    local, name = uri.getScheme() == "file", uri.getPath() if uri.getScheme() == "file" else uri.toString()

    def opened():
        if local:
            return arrow_fs.LocalFileSystem().open_input_file(name)
        found, inner = arrow_fs.FileSystem.from_uri(name)
        return found.open_input_file(inner)

    def frame(src, data):
        import pandas as pd

        out = {"src": src, "dst": data[:, 0].astype(np.int64)}
        return pd.DataFrame(out | ({"w": data[:, 1]} if weighted else {}))

    def slices(batches):
        with opened() as file:
            for b in batches:
                for k in b["id"]:
                    lo = int(k) * SLICE
                    for part in _decoded(file, lo, min(lo + SLICE, entries), _vertex_of(file, lo, nodes), nodes, weighted):
                        yield frame(*part)

    def whole(batches):
        for b in batches:
            for content in b["content"]:
                file = pyarrow.BufferReader(content)
                for lo in range(0, entries, SLICE):
                    for part in _decoded(file, lo, min(lo + SLICE, entries), _vertex_of(file, lo, nodes), nodes, weighted):
                        yield frame(*part)

    schema = "src bigint, dst bigint" + (", w int" if weighted else "")
    try:
        opened().close()
        count = -(-entries // SLICE)
        tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, -(-count // SLICES))))
        edges = spark.range(0, count, 1, tasks).mapInPandas(slices, schema)
    except (pyarrow.ArrowException, OSError):
        edges = spark.read.format("binaryFile").load(path).select("content").mapInPandas(whole, schema)
    edges, _ = Tables(spark, "serialized").write(edges, "edges")
    return Graph(spark, edges, nodes, directed, weighted, _entries=entries)
