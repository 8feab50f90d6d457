import numpy as np
import pytest

from tessera.sources import generators, readers, writers
from tessera.sources.load import from_raw, generate_graph, load_graph
from tests.golden import CYCLE, T1, graph, rows

FILES = {
    "wel": "0 1 5\n1 2 7\n2 0 9\n",
    "gr": "c comment\np sp 3 3\na 1 2 5\na 2 3 7\na 3 1 9\n",
    "graph": "% comment\n3 3 1\n2 5\n3 7\n1 9\n",
    "mtx": "%%MatrixMarket matrix coordinate integer general\n% comment\n3 3 3\n1 2 5\n2 3 7\n3 1 9\n",
}
PAIRS = {(a, b) for a, b, _ in CYCLE}


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


@pytest.mark.parametrize("suffix", FILES)
def test_weighted(spark, tmp_path, suffix):
    path = put(tmp_path, f"g.{suffix}", FILES[suffix])
    assert rows(readers.read_edges(spark, path)) == CYCLE
    assert rows(load_graph(spark, path).edges) == PAIRS
    assert rows(load_graph(spark, path, weighted=True).edges) == CYCLE


@pytest.mark.parametrize(("name", "content"), [("g.el", "0 1\n1 2\n2 0\n"), ("t.el", "0 1 1\n2\n\n2   0 junk 5 5"), ("g.graph", "3 3\n2\n3\n1\n"), ("p.mtx", "%%MatrixMarket matrix coordinate pattern general\n3 3 3\n1 2\n2 3\n3 1\n")])
def test_unweighted(spark, tmp_path, name, content):
    path = put(tmp_path, name, content)
    assert rows(readers.read_edges(spark, path)) == PAIRS
    g = load_graph(spark, path, weighted=True)
    assert all(1 <= w <= 255 for _, _, w in rows(g.edges.select("src", "dst", "w")))


def test_blank_line_is_a_vertex(spark, tmp_path):
    assert rows(readers.read_edges(spark, put(tmp_path, "b.graph", "3 1\n\n3\n2\n"))) == {(1, 2), (2, 1)}


def test_symmetric_and_real(spark, tmp_path):
    path = put(tmp_path, "s.mtx", "%%MatrixMarket matrix coordinate real symmetric\n2 2 1\n2 1 3.9\n")
    assert rows(readers.read_edges(spark, path)) == {(1, 0, 3), (0, 1, 3)}


def test_serialized_layout(spark, tmp_path):
    sg = np.array([True]).tobytes() + np.array([3, 3, 0, 1, 2, 3], "<i8").tobytes() + np.array([1, 2, 0], "<i4").tobytes() + np.array([0, 1, 2, 3], "<i8").tobytes() + np.array([2, 0, 1], "<i4").tobytes()
    g = readers.read_serialized(spark, put(tmp_path, "g.sg", sg))
    assert (g.directed, g.num_nodes, g.num_edges, rows(g.edges)) == (True, 3, 3, PAIRS)


@pytest.mark.parametrize("symmetrize", [False, True])
@pytest.mark.parametrize("weighted", [False, True])
def test_serialized_round_trip(spark, tmp_path, symmetrize, weighted):
    g = graph(spark, T1, symmetrize, weighted)
    path = f"{tmp_path}/g.{'wsg' if weighted else 'sg'}"
    writers.write_graph(g, path, serialized=True)
    back = readers.read_serialized(spark, path)
    assert (back.directed, back.num_nodes, back.num_entries) == (g.directed, g.num_nodes, g.num_entries)
    assert rows(back.edges) == rows(g.edges)


@pytest.mark.parametrize("symmetrize", [False, True])
def test_serialized_bypasses_the_driver(spark, tmp_path, monkeypatch, symmetrize):
    """Tasks write to a mounted file; elsewhere the driver streams. Both give the same bytes, over an older and longer file too."""
    r = np.random.default_rng(3)
    g = graph(spark, [(int(a), int(b), int(w)) for a, b, w in r.integers(0, 90, (700, 3))], symmetrize)
    path = put(tmp_path, "g.wsg", b"x" * 100_000)
    streamed = bytearray()
    monkeypatch.setattr(writers, "_stream", lambda rows, out, kind: streamed.extend(np.array([list(x) for x in rows.collect()], kind).tobytes()))
    writers.write_serialized(g, path)
    assert not streamed
    n, m = g.num_nodes, g.num_entries
    want = np.array([g.directed]).tobytes() + np.array([m, n], "<i8").tobytes()
    for part in (g, g.transpose())[: 2 if g.directed else 1]:
        e = sorted(rows(part.edges.select("src", "dst", "w")))
        offsets = np.searchsorted([x[0] for x in e], np.arange(n + 1))
        want += offsets.astype("<i8").tobytes() + np.array([x[1:] for x in e], "<i4").tobytes()
    assert (tmp_path / "g.wsg").read_bytes() == want
    assert rows(readers.read_serialized(spark, path).edges) == rows(g.edges.select("src", "dst", "w"))


def test_serialized_in_slices(spark, tmp_path, monkeypatch):
    """Slices that begin and end within a vertex, blocks of offsets without an entry, and the fallback of one row."""
    import pyarrow

    r = np.random.default_rng(5)
    degrees = np.where(r.random(300) < 0.8, 0, r.integers(0, 60, 300))
    src, dst = np.repeat(np.arange(300), degrees), r.integers(0, 300, degrees.sum())
    offsets = np.concatenate([[0], np.cumsum(degrees)])
    raw = np.array([False]).tobytes() + np.array([len(src), 300, *offsets], "<i8").tobytes() + dst.astype("<i4").tobytes()
    monkeypatch.setattr(readers, "OFFSETS", 7)
    monkeypatch.setattr(readers, "SLICE", 31)
    monkeypatch.setattr(readers, "SLICES", 2)
    file = pyarrow.BufferReader(raw)
    for lo, hi in ((0, len(src)), (1, 2), (17, 300)):
        parts = list(readers._decoded(file, lo, hi, readers._vertex_of(file, lo, 300), 300, False))
        assert np.concatenate([p[0] for p in parts]).tolist() == src[lo:hi].tolist()
        assert np.concatenate([p[1][:, 0] for p in parts]).tolist() == dst[lo:hi].tolist()
    want = sorted(zip(src.tolist(), dst.tolist(), strict=True))
    path = put(tmp_path, "s.sg", raw)
    assert sorted(tuple(e) for e in readers.read_serialized(spark, path).edges.collect()) == want
    monkeypatch.setattr("pyarrow.fs.LocalFileSystem", lambda: (_ for _ in ()).throw(OSError()))
    assert sorted(tuple(e) for e in readers.read_serialized(spark, path).edges.collect()) == want


def test_serialized_cut_short_missing_and_empty(spark, tmp_path):
    head = np.array([False]).tobytes()
    with pytest.raises(readers.GraphFormatError):
        readers.read_serialized(spark, put(tmp_path, "c.sg", head + np.array([4, 2, 0, 2, 4], "<i8").tobytes()))
    with pytest.raises(FileNotFoundError):
        readers.read_serialized(spark, f"{tmp_path}/none.sg")
    g = readers.read_serialized(spark, put(tmp_path, "e.sg", head + np.array([0, 2, 0, 0, 0], "<i8").tobytes()))
    assert (g.num_nodes, g.num_entries, g.edges.count()) == (2, 0, 0)


def test_edge_list_and_convert(spark, tmp_path):
    g = graph(spark, T1, True)
    writers.write_graph(g, f"{tmp_path}/a.wel")
    assert rows(readers.read_edges(spark, f"{tmp_path}/a.wel")) == rows(g.edges.select("src", "dst", "w"))
    writers.convert(spark, f"{tmp_path}/a.wel", f"{tmp_path}/b.wsg", serialized=True, weighted=True)
    assert rows(readers.read_serialized(spark, f"{tmp_path}/b.wsg").edges) == rows(g.edges.select("src", "dst", "w"))
    with pytest.raises(ValueError):
        writers.write_graph(g, "")


@pytest.mark.parametrize(("name", "content"), [
    ("c.mtx", "%%MatrixMarket matrix coordinate complex general\n1 1 0\n"), ("a.mtx", "%%MatrixMarket matrix array real general\n1 1\n"), ("n.mtx", "%%MatrixMarket matrix coordinate real general\n1 2 0\n"), ("m.mtx", "%MatrixMarket\n1 1 0\n"), ("y.mtx", "%%MatrixMarket matrix coordinate real hermitian\n1 1 0\n"),
    ("f.graph", "3 3 11\n"), ("x.txt", "0 1\n"), ("nosuffix", "0 1\n"),
])
def test_refused(spark, tmp_path, name, content):
    with pytest.raises(readers.GraphFormatError):
        readers.read_edges(spark, put(tmp_path, name, content))


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_edges(spark, f"{tmp_path}/none.el")


def test_empty_file(spark, tmp_path):
    g = load_graph(spark, put(tmp_path, "e.el", ""))
    assert (g.num_nodes, g.num_edges) == (0, 0)


def test_result_lines(spark, tmp_path):
    writers.write_result_lines(graph(spark, T1).out_degree(), "out_degree", f"{tmp_path}/r")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()].count("0") == 2


def test_generators(spark):
    from pyspark.sql import functions as F

    for make in (generators.uniform_edges, generators.rmat_edges):
        e = make(spark, 8, 4)
        assert e.count() == 1024 and e.agg(F.max(F.greatest("src", "dst"))).first()[0] < 256
        assert rows(e) == rows(make(spark, 8, 4).repartition(7))
    skew = generators.rmat_edges(spark, 10).groupBy("src").count().agg(F.max("count")).first()[0]
    assert skew > 3 * generators.uniform_edges(spark, 10).groupBy("src").count().agg(F.max("count")).first()[0]
    w = generators.with_weights(generators.uniform_edges(spark, 10)).agg(F.min("w"), F.max("w")).first()
    assert tuple(w) == (1, 255)
    g = generate_graph(spark, 6, weighted=True)
    assert not g.directed and g.weighted and g.num_nodes <= 64


def test_generated_graph_is_that_of_its_edges(spark):
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    g, plain = generate_graph(spark, 7, 4, weighted=True), from_raw(generators.generate_edges(spark, 7, 4), symmetrize=True, weighted=True)
    assert rows(g.edges) == rows(plain.edges) and g.num_nodes == plain.num_nodes
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
