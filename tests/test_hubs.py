"""Graphs with hubs, whose edges are dealt to several partitions, and deep graphs, against plain versions."""

import heapq
import random

import pytest

from tessera.operators import betweenness, bfs, pagerank, sssp
from tessera.plans import graph as graphs


def edges_of(seed=2, n=60):
    """A star of vertex 0, one of vertex 7 that points inwards, and random edges."""
    r = random.Random(seed)
    pairs = {(0, v): r.randint(1, 9) for v in range(1, n)} | {(v, 7): r.randint(1, 9) for v in range(8, n)}
    for _ in range(80):
        a, b = r.randrange(n), r.randrange(n)
        if a != b:
            pairs[a, b] = r.randint(1, 9)
    return [(a, b, w) for (a, b), w in pairs.items()]


def dijkstra(edges, n, source):
    out, dist, queue = {}, {source: 0}, [(0, source)]
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    while queue:
        d, a = heapq.heappop(queue)
        for b, w in out.get(a, []) if d == dist[a] else []:
            if d + w < dist.get(b, 1 << 40):
                dist[b] = d + w
                heapq.heappush(queue, (d + w, b))
    return {v: dist.get(v, sssp.UNREACHED) for v in range(n)}


@pytest.fixture
def build(spark, monkeypatch):
    def make(edges, hub=None, **options):
        monkeypatch.setattr(graphs, "HUB_EDGES", hub or 1_000_000)
        return graphs.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint, w int"), **options)

    return make


def values(df):
    return {r[0]: tuple(round(x, 9) if isinstance(x, float) else x for x in r[1:]) for r in df.collect()}


def test_hubs_are_sliced_and_results_stay(build):
    edges = edges_of()
    sliced = build(edges, 5)
    kept = sliced.kept()
    whole = build(edges)
    assert kept.keys == ["src", "slice"] and whole.kept().keys == ["src"]
    hub = kept.edges.where("src = 0").groupBy("slice").count().collect()
    assert len(hub) > 3 and sum(r["count"] for r in hub) == 59
    assert "slice" not in sliced.kept().along(sliced.vertices().withColumnRenamed("id", "src")).columns
    for kernel in (lambda g: bfs.bfs(g, 3), lambda g: sssp.sssp(g, 0), lambda g: betweenness.betweenness(g, [0, 3])):
        assert values(kernel(sliced)) == values(kernel(whole))
    ranks = values(pagerank.pagerank(whole).scores)
    assert ranks == values(pagerank.pagerank(build(edges, 5)).scores)  # the ranks keep edges of their own


@pytest.mark.parametrize("delta", [None, 1, 4])
@pytest.mark.parametrize("compact", [2, 32])
def test_shortest_paths(build, monkeypatch, delta, compact):
    monkeypatch.setattr(sssp, "COMPACT", compact)
    edges = [(i, i + 1, 3) for i in range(9)] + [(0, 5, 20), (5, 2, 1), (9, 0, 1), (11, 0, 1), (2, 10, 40), (8, 10, 2)]
    got = {r.id: r.dist for r in sssp.sssp(build(edges, num_nodes=13), 0, delta).collect()}
    assert got == dijkstra(edges, 13, 0)


def test_kept_edges_go_with_the_graph(build, spark):
    import gc

    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    g = build(edges_of())
    assert bfs.bfs(g, 0).count() == 60
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() > before
    del g
    gc.collect()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= before


@pytest.mark.parametrize("weighted", [False, True])
def test_neighbours_by_place(build, weighted):
    edges = edges_of()
    g = build(edges, weighted=weighted)
    lists = {}
    for a, b, w in sorted(edges):
        lists.setdefault(a, []).append((b, w))
    want = sorted((a, k, *(x if weighted else x[:1])) for a, own in lists.items() for k, x in enumerate(own) if k >= 2)
    assert sorted(tuple(r) for r in g.neighbors(2).collect()) == want
    assert {r.id: r.neighbor for r in g.neighbor_at(1).collect()} == {v: (lists.get(v, []) + [(None, 0)] * 2)[1][0] for v in range(60)}
