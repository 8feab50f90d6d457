import heapq
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import betweenness, bfs, components, pagerank, partition, sssp, triangles, verify
from tessera.plans.graph import relabel_by_degree
from tests.golden import INF, T1, column, graph, rows

EDGES = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 20)), min_size=1, max_size=30)
FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture], derandomize=True)


def adjacency(raw, symmetrize):
    best = {}
    for a, b, w in raw + ([(b, a, w) for a, b, w in raw] if symmetrize else []):
        if a != b:
            best[a, b] = min(w, best.get((a, b), 99))
    n = max(max(a, b) for a, b, _ in raw) + 1
    return n, best


@FEW
@given(EDGES)
def test_kernels_match_plain_python(spark, raw):
    n, best = adjacency(raw, False)
    g, source = graph(spark, raw), raw[0][0]
    out = {v: sorted(b for a, b in best if a == v) for v in range(n)}
    depth, queue = {source: 0}, deque([source])
    while queue:
        u = queue.popleft()
        for v in out[u]:
            if v not in depth:
                depth[v] = depth[u] + 1
                queue.append(v)
    tree = bfs.bfs(g, source)
    assert column(tree, "depth") == [depth.get(v, -1) for v in range(n)]
    assert not any(verify.verify_bfs(g, source, tree).first())
    dist, heap = {}, [(0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in dist:
            dist[u] = d
            for v in out[u]:
                heapq.heappush(heap, (d + best[u, v], v))
    assert column(sssp.sssp(g, source, 5), "dist") == [dist.get(v, INF) for v in range(n)]
    root = list(range(n))
    for _ in range(n):
        for a, b in best:
            root[a] = root[b] = min(root[a], root[b])
    assert column(components.afforest(g), "comp") == column(components.shiloach_vishkin(g), "comp") == root
    assert not any(verify.verify_betweenness(g, [source], betweenness.betweenness(g, [source])).first())


@FEW
@given(EDGES)
def test_triangles_match(spark, raw):
    n, best = adjacency(raw, True)
    want = {(a, b, c) for a in range(n) for b in range(a) for c in range(b) if (a, b) in best and (b, c) in best and (a, c) in best}
    g = graph(spark, raw, symmetrize=True)
    assert rows(triangles.triangles(g)) == want
    assert triangles.triangle_count(relabel_by_degree(g)).first()[0] == len(want)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_any_partitioning(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        g = partition.redistributed(graph(spark, T1), parts)
        assert column(bfs.bfs(g, 0), "parent") == [0, 0, 0, 1] + [-1] * 6
        assert pagerank.pagerank(g).iterations == 11
        assert column(components.afforest(g), "comp") == [0, 0, 0, 0, 4, 4, 4, 7, 8, 8]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeated_and_reversed_edges_change_nothing(spark):
    turned = T1 + [(b, a, w) for a, b, w in T1] + T1
    assert rows(graph(spark, turned, symmetrize=True).edges) == rows(graph(spark, T1, symmetrize=True).edges)


def test_ownership(spark):
    from pyspark.sql import functions as F

    ids = spark.range(10)
    own = ids.select("id", partition.block_owner(F.col("id"), 10, 4).alias("o"), partition.block_local(F.col("id"), 10, 4).alias("l"))
    assert [(r.o, r.l) for r in own.orderBy("id").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (3, 3)]
    few = spark.range(2).select(partition.block_owner(F.col("id"), 2, 4).alias("o"), partition.rest_to_last_owner(F.col("id"), 2, 4).alias("p"))
    assert [tuple(r) for r in few.collect()] == [(0, 3), (1, 3)]
    assert [partition.round_robin_size(10, p, 4) for p in range(4)] == [3, 3, 2, 2]


def test_no_edges(spark):
    g = graph(spark, [(2, 2, 1)], symmetrize=True)
    assert (g.num_nodes, g.num_edges) == (3, 0)
    assert column(bfs.bfs(g, 2), "depth") == [-1, -1, 0]
    assert column(components.afforest(g), "comp") == column(components.shiloach_vishkin(g), "comp") == [0, 1, 2]
    assert triangles.triangle_count(g).first()[0] == 0
    assert [round(x, 9) for x in column(pagerank.pagerank(g).scores, "score")] == [0.05] * 3
