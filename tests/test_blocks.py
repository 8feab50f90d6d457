"""Edges as arrays, cut into many small ranges, chunks and blocks, against plain versions."""

import random

import numpy as np
import pytest

from tessera.operators import betweenness, pagerank, sssp, verify
from tessera.plans import blocks
from tessera.plans.loop import Tables
from tests.test_hubs import dijkstra, edges_of


@pytest.fixture
def small(monkeypatch):
    for name, value in (("WIDTH", 7), ("CHUNK", 5), ("TASK", 16)):
        monkeypatch.setattr(blocks, name, value)


@pytest.fixture
def build(spark):
    from tessera.plans import graph as graphs

    return lambda edges, **options: graphs.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint, w int"), **options)


@pytest.mark.parametrize("by", ["add", "least"])
def test_step(build, small, by):
    edges, g = edges_of(), build(edges_of())
    own = g.blocks()
    assert own.chunks.count() > 20 and own.copies.count() > 8 and own.width == 7
    sent = {a: (0 if by == "add" else None) if a % 3 else a + 2 for a in range(60)}
    none = blocks.NEUTRAL[by]
    start = own.start(lambda ids: np.where(ids % 3 == 0, ids + 2, none).astype("f8" if by == "add" else "i8").tobytes())
    kind = "f8" if by == "add" else "i8"
    after = own.step(start, lambda x: np.frombuffer(x, kind), by, lambda x, got: (got.tobytes(), float(len(got))))
    got = {r.id: r.v for r in own.rows(after, lambda x: np.frombuffer(x, kind), "v", "double" if by == "add" else "bigint").collect()}
    for v in range(60):
        offers = [(sent[a], w) for a, b, w in edges if b == v and a % 3 == 0]
        assert got[v] == (sum(s for s, _ in offers) if by == "add" else min((s + w for s, w in offers), default=none))


def test_values_meet_before_they_are_shuffled(build, small, monkeypatch):
    """Ninety edges from one range to one vertex make a few messages, not ninety."""
    monkeypatch.setattr(blocks, "WIDTH", 100)
    monkeypatch.setattr(blocks, "TASK", 1 << 20)
    monkeypatch.setattr(blocks, "CHUNK", 30)
    g = build([(a, 99, 1) for a in range(90)])
    seen = []
    meet = blocks.Blocks._meet
    monkeypatch.setattr(blocks.Blocks, "_meet", lambda self, state, sent, by, update: seen.append(sent.count()) or meet(self, state, sent, by, update))
    ranks = {r.id: r.score for r in pagerank.pagerank(g, 1, 0.0).scores.collect()}
    assert ranks[99] == pytest.approx(0.0015 + 0.85 * 0.9) and ranks[0] == pytest.approx(0.0015)
    assert seen == [3, 3]


def test_pagerank(build, small):
    edges, n = edges_of(), 60
    out, score = {}, [1 / n] * n
    for a, _, _ in edges:
        out[a] = out.get(a, 0) + 1
    for _ in range(4):
        score = [0.15 / n + 0.85 * sum(score[a] / out[a] for a, b, _ in edges if b == v) for v in range(n)]
    got = {r.id: r.score for r in pagerank.pagerank(build(edges), 4, 0.0).scores.collect()}
    assert [got[v] for v in range(n)] == pytest.approx(score)


def test_places_far_apart():
    r = random.Random(1)
    for span in (3, 200, 70_000, 1 << 18):
        at = np.array(sorted({r.randrange(1 << 18) if span > 200 else i * span for i in range(50)}))
        p, size, first, raw, x = blocks._message(4, at, np.arange(len(at)))
        assert p == 4 and blocks._places(size, first, raw).tolist() == at.tolist() and np.frombuffer(x, "<i4").tolist() == list(range(len(at)))


@pytest.mark.parametrize("delta", [None, 1, 4])
def test_shortest_paths(build, small, delta):
    edges = edges_of()
    got = {r.id: r.dist for r in sssp.sssp(build(edges, num_nodes=63), 8, delta).collect()}
    assert got == dijkstra(edges, 63, 8)


def test_shortest_paths_make_one_table_a_step(build, small, monkeypatch):
    """Five edges in a row are six steps; each writes one table, of which two stay."""
    written = []
    write = Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, df, name, *a, **b: written.append(name) or write(self, df, name, *a, **b))
    g = build([(i, i + 1, 2) for i in range(5)])
    written.clear()
    assert [r.dist for r in sssp.sssp(g, 0).orderBy("id").collect()] == [0, 2, 4, 6, 8, 10]
    assert written.count("step") == 6 and "offers" not in written


@pytest.mark.parametrize("symmetrize", [False, True])
def test_verify_betweenness_away_from_the_driver(build, small, monkeypatch, symmetrize):
    g = build(edges_of(), symmetrize=symmetrize)
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", None)
    scores = betweenness.betweenness(g, [0, 3, 8])
    assert not any(verify.verify_betweenness(g, [0, 3, 8], scores).first())
    assert verify.verify_betweenness(g, [0, 3, 8], scores.selectExpr("id", "if(id in (3, 9), score + 1e-6, score) score")).first()[0] == 2
    assert verify.verify_betweenness(g, [0, 3], scores).first()[0] > 0


def test_verify_triangles_takes_no_square_of_a_hub(build):
    """A hub's list is short where edges lead to it; before, it came whole to each of its neighbours."""
    g = build([(0, v, 1) for v in range(1, 400)] + [(v, v + 1, 1) for v in range(1, 399)], symmetrize=True)
    assert not any(verify.verify_triangles(g, 398).first()) and verify.verify_triangles(g, 397).first()[0] == 1
    sizes = []
    intersect = verify.F.array_intersect
    try:
        verify.F.array_intersect = lambda a, b: sizes.append((a, b)) or verify.F.filter(intersect(a, b), lambda x: verify.F.size(b) < 5)
        assert not any(verify.verify_triangles(g, 398).first()) and sizes
    finally:
        verify.F.array_intersect = intersect
