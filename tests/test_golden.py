import pytest

from tessera.operators import analysis, betweenness, bfs, components, pagerank, sssp, triangles, verify
from tessera.plans.graph import relabel_by_degree, relabel_map
from tests.golden import INF, T1, T1_EDGES, T3, column, graph, rows


@pytest.fixture(scope="module")
def t1(spark):
    return graph(spark, T1)


@pytest.fixture(scope="module")
def t2(spark):
    return graph(spark, T1, symmetrize=True)


@pytest.fixture(scope="module")
def t3(spark):
    return graph(spark, T3)


def test_building(t1, t2):
    assert (t1.num_nodes, t1.num_edges, t1.directed) == (10, 11, True)
    assert rows(t1.edges.select("src", "dst", "w")) == T1_EDGES
    assert (t2.num_nodes, t2.num_edges, t2.num_edges_directed) == (10, 10, 20)
    least = {(min(a, b), max(a, b)): w for a, b, w in rows(t2.edges.select("src", "dst", "w"))}
    assert least == {(0, 1): 2, (0, 2): 1, (0, 3): 6, (1, 2): 5, (1, 3): 1, (2, 3): 8, (4, 5): 2, (4, 6): 9, (5, 6): 1, (8, 9): 5}


def test_degrees(t1, t2):
    assert column(t1.out_degree(), "out_degree") == [2, 1, 2, 2, 1, 1, 1, 0, 0, 1]
    assert column(t1.degrees(), "in_degree") == column(t1.in_degree(), "in_degree") == [1, 3, 1, 2, 1, 1, 1, 0, 1, 0]
    assert column(t2.out_degree(), "out_degree") == [3, 3, 3, 3, 2, 2, 2, 0, 1, 1]
    assert column(t2.adjacency_offsets(), "offset") == [0, 3, 6, 9, 12, 14, 16, 18, 18, 19]


def test_access(t1, t2):
    assert [r.neighbors for r in graph_lists(t2)][:2] == [[(1, 2), (2, 1), (3, 6)], [(0, 2), (2, 5), (3, 1)]]
    assert rows(t2.transpose().edges) == rows(t2.edges)
    assert {(b, a) for a, b, _ in rows(t1.transpose().edges.select("src", "dst", "w"))} == {(a, b) for a, b, _ in T1_EDGES}
    assert t2.describe() == "Graph has 10 nodes and 10 undirected edges for degree: 1"
    assert [r.line for r in t2.topology(2, 2).collect()] == ["0: 1:2 2:1", "1: 0:2 2:5"]
    assert rows(t2.neighbors(2).select("id", "neighbor")) == {(0, 3), (1, 3), (2, 3), (3, 2)}
    assert column(t2.neighbor_at(2), "neighbor")[3:8] == [2, None, None, None, None]


def graph_lists(g):
    return [type("R", (), {"neighbors": [tuple(x) for x in r.neighbors]}) for r in g.adjacency().orderBy("id").collect()]


def test_bfs(t1, t2, t3):
    assert column(bfs.bfs(t1, 0), "depth") == [0, 1, 1, 2, -1, -1, -1, -1, -1, -1]
    assert column(bfs.bfs(t1, 0), "parent") == [0, 0, 0, 1, -1, -1, -1, -1, -1, -1]
    assert column(bfs.bfs(t2, 0), "depth") == [0, 1, 1, 1, -1, -1, -1, -1, -1, -1]
    assert column(bfs.bfs(t3, 0), "parent") == [0, 0, 0, 1, 3]
    with pytest.raises(ValueError):
        bfs.bfs(t1, 10)


@pytest.mark.parametrize("delta", [None, 1, 3, 100])
def test_sssp(t1, t2, t3, delta):
    assert column(sssp.sssp(t1, 0, delta), "dist") == [0, 2, 1, 5] + [INF] * 6
    assert column(sssp.sssp(t2, 0, delta), "dist") == [0, 2, 1, 3] + [INF] * 6
    assert column(sssp.sssp(t3, 0, delta), "dist") == [0, 1, 2, 2, 12]


@pytest.mark.parametrize("kernel", [components.afforest, components.shiloach_vishkin])
def test_components(t1, t2, kernel):
    assert column(kernel(t1), "comp") == column(kernel(t2), "comp") == [0, 0, 0, 0, 4, 4, 4, 7, 8, 8]


def test_pagerank(t1, t2):
    r = pagerank.pagerank(t1)
    assert r.iterations == 11 and r.error < 1e-4
    assert [round(x, 6) for x in column(r.scores, "score")] == [0.076890, 0.129827, 0.047668, 0.145615, 0.1, 0.1, 0.1, 0.015, 0.027750, 0.015]
    r = pagerank.pagerank(t2)
    assert r.iterations == 2
    assert [round(x, 6) for x in column(r.scores, "score")] == [0.1] * 7 + [0.015, 0.1, 0.1]


def test_betweenness(t1, t3):
    assert [round(x, 6) for x in column(betweenness.betweenness(t1, [0]), "score")] == [1, 0.166667, 0.166667] + [0] * 7
    d = {r.id: (r.sigma, r.delta) for r in betweenness.dependencies(t3, [0]).collect()}
    assert d == {0: (1, 4), 1: (1, 1), 2: (1, 1), 3: (2, 1), 4: (2, 0)}
    many = {}
    for r in betweenness.dependencies(t1, [0, 1, 2]).collect():
        many[r.id] = many.get(r.id, 0) + r.delta
    assert many == {0: 4.0, 1: 3.5, 2: 3.5, 3: 3.0}
    assert column(betweenness.betweenness(t1, [7]), "score") == [0.0] * 10


def test_triangles(spark, t1, t2):
    assert triangles.triangle_count(t2).first()[0] == 5
    assert rows(triangles.triangles(t2)) == {(2, 1, 0), (3, 1, 0), (3, 2, 0), (3, 2, 1), (6, 5, 4)}
    assert column(triangles.triangles_per_vertex(t2), "triangles") == [3, 3, 3, 3, 1, 1, 1, 0, 0, 0]
    assert rows(triangles.triangles(graph(spark, T3, symmetrize=True))) == {(2, 1, 0), (3, 2, 1)}
    with pytest.raises(ValueError):
        triangles.triangle_count(t1)


def test_relabel(t1, t2):
    assert column(relabel_map(t2), "new_id") == [3, 2, 1, 0, 6, 5, 4, 9, 8, 7]
    assert triangles.triangle_count(relabel_by_degree(t2)).first()[0] == 5
    with pytest.raises(ValueError):
        relabel_map(t1)


def test_analysis(t1, t2):
    tree = bfs.bfs(t1, 0)
    assert tuple(analysis.bfs_stats(t1, tree).first()) == (4, 7)
    labels = components.afforest(t1)
    assert [tuple(r) for r in analysis.component_sizes(labels, 2).collect()] == [(0, 4), (4, 3)]
    assert analysis.component_count(labels).first()[0] == 4
    assert analysis.sssp_reach(sssp.sssp(t1, 0)).first()[0] == 4
    assert analysis.pick_sources(t1, 3, start=9) == [9, 9, 9]
    assert set(analysis.pick_sources(t1, 20)) <= {0, 1, 2, 3, 4, 5, 6, 9}
    assert [r.id for r in analysis.top_k(pagerank.pagerank(t2).scores, 2, digits=6).collect()] == [9, 8]


def test_verifiers_accept(t1, t2):
    assert not any(verify.verify_bfs(t1, 0, bfs.bfs(t1, 0)).first())
    assert not any(verify.verify_sssp(t1, 0, sssp.sssp(t1, 0)).first())
    assert not any(verify.verify_cc(t1, components.afforest(t1)).first())
    assert not any(verify.verify_pagerank(t1, pagerank.pagerank(t1, 40).scores).first())
    assert not any(verify.verify_betweenness(t1, [0, 1], betweenness.betweenness(t1, [0, 1])).first())
    assert not any(verify.verify_triangles(t2, 5).first())


def test_verifiers_reject(spark, t1, t2):
    wrong = bfs.bfs(t1, 0).selectExpr("id", "if(id = 3, 3, depth) depth", "parent")
    assert any(verify.verify_bfs(t1, 0, wrong).first())
    assert any(verify.verify_sssp(t1, 0, sssp.sssp(t1, 0).selectExpr("id", "if(id = 3, 4, dist) dist")).first())
    assert any(verify.verify_sssp(t1, 0, sssp.sssp(t1, 0).selectExpr("id", "if(id = 3, 9, dist) dist")).first())
    assert any(verify.verify_cc(t1, components.afforest(t1).selectExpr("id", "if(id = 9, 9, comp) comp")).first())
    assert any(verify.verify_cc(t1, components.afforest(t1).selectExpr("id", "if(comp = 4, 0, comp) comp")).first())
    assert any(verify.verify_pagerank(t1, t1.vertices().selectExpr("id", "0.5D score")).first())
    assert any(verify.verify_triangles(t2, 6).first())
    scores = betweenness.betweenness(t1, [0, 1])
    assert any(verify.verify_betweenness(t1, [0, 1], scores.selectExpr("id", "if(id = 3, score + 0.01, score) score")).first())
    assert any(verify.verify_betweenness(t1, [0, 1], scores.where("id <> 3")).first())
    tree = bfs.bfs(t1, 0)
    changes = [("if(id = 0, 1, depth) depth", "parent"), ("depth", "if(id = 0, 1, parent) parent"), ("depth", "if(id = 3, 0, parent) parent"), ("if(id = 4, 1, depth) depth", "parent")]
    for depth, parent in changes:
        assert any(verify.verify_bfs(t1, 0, tree.selectExpr("id", depth, parent)).first())
    assert any(verify.verify_bfs(t1, 0, tree.where("id <> 5")).first())


@pytest.mark.parametrize(("comp", "bad"), [("if(comp = 4, 40, comp)", 3), ("if(comp = 4, 6, comp)", 2), ("if(comp = 4, 7, if(comp = 7, 4, comp))", 4), ("if(comp = 4, NULL, comp)", 3)])
def test_verify_cc_labels(t1, comp, bad):
    """The same partition under labels that name no vertex, a vertex but the least, or one of another component."""
    right = components.afforest(t1)
    assert verify.verify_cc(t1, right).first().bad_labels == 0
    assert verify.verify_cc(t1, right.selectExpr("id", f"{comp} comp")).first().bad_labels == bad


def test_deep_graphs(spark, monkeypatch):
    monkeypatch.setattr("tessera.operators.bfs.COMPACT", 3)
    monkeypatch.setattr("tessera.operators.betweenness.COMPACT", 3)
    path = graph(spark, [(i, i + 1, 1) for i in range(9)] + [(4, 1, 1)])
    assert column(bfs.bfs(path, 0), "depth") == list(range(10))
    assert {r.id: r.delta for r in betweenness.dependencies(path, [0]).collect()} == {i: 9.0 - i for i in range(10)}


def test_unimplemented_never_passes(t1):
    assert any(verify.verify_unimplemented(t1.edges).first())
