"""The registered queries over derived graphs, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import permuted
from tessera.operators import analysis, betweenness, bfs, components, pagerank, partition, sssp, triangles, verify
from tessera.plans import derived
from tessera.plans import graph as graphs
from tessera.plans.loop import Tables
from tessera.sources import generators, readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}

FLOW = """raw AS MATERIALIZED (SELECT src, dst, w FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
  l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst, CAST(l_quantity AS INTEGER) AS w FROM lineitem) t WHERE dst IS NOT NULL)"""
SPARSE = """raw AS MATERIALIZED (SELECT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst, min(CAST(l_linenumber AS INTEGER)) AS w FROM lineitem
  WHERE l_quantity >= 50 AND l_discount >= 0.09 GROUP BY 1, 2)"""
GRAPHS = """g AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM raw WHERE src <> dst GROUP BY src, dst),
 ways AS (SELECT src, dst, w FROM raw UNION ALL SELECT dst, src, w FROM raw),
 u AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM ways WHERE src <> dst GROUP BY src, dst),
 n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM raw), v AS (SELECT unnest(range(n)) AS id FROM n)"""


def register(name: str, body: str | None = None, base: str = FLOW, ctes: str = ""):
    """Adds a query; ``body`` is its SQL after the graph's common table expressions."""

    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = f"WITH RECURSIVE {base}, {GRAPHS}{', ' + ctes if ctes else ''} {body}"
        return f

    return add


# --- building and access ---------------------------------------------------------------------------------------------


@register("edges_raw", "SELECT src, dst, w FROM raw")
def edges_raw(spark: SparkSession, sf: str) -> DataFrame:
    return derived.flow_edges(spark, sf)


@register("edges_dedup_min_weight", "SELECT src, dst, w FROM g")
def edges_dedup_min_weight(spark, sf):
    return derived.flow(spark, sf).edges


@register("edges_symmetrized", "SELECT src, dst, w FROM u")
def edges_symmetrized(spark, sf):
    return derived.flow(spark, sf, symmetrize=True).edges


@register("self_loops_removed", "SELECT src, dst, w FROM raw WHERE src <> dst")
def self_loops_removed(spark, sf):
    return graphs.without_loops(derived.flow_edges(spark, sf))


@register("transpose", "SELECT dst AS src, src AS dst, w FROM g")
def transpose(spark, sf):
    return derived.flow(spark, sf).transpose().edges.select("src", "dst", "w")


@register("max_node_id", "SELECT max(greatest(src, dst)) AS max_node_id FROM raw")
def max_node_id(spark, sf):
    return graphs.max_node_id(derived.flow_edges(spark, sf))


@register("out_degree", "SELECT id, count(src) AS out_degree FROM v LEFT JOIN g ON src = id GROUP BY id")
def out_degree(spark, sf):
    return derived.flow(spark, sf).out_degree()


@register("in_degree", "SELECT id, count(dst) AS in_degree FROM v LEFT JOIN g ON dst = id GROUP BY id")
def in_degree(spark, sf):
    return derived.flow(spark, sf).in_degree()


@register("degree_all_vertices", "SELECT id, (SELECT count(*) FROM g WHERE src = id) AS out_degree, (SELECT count(*) FROM g WHERE dst = id) AS in_degree FROM v", SPARSE)
def degree_all_vertices(spark, sf):
    return derived.sparse(spark, sf).degrees()


@register("degree_histogram", "SELECT out_degree, count(*) AS vertices FROM (SELECT id, count(src) AS out_degree FROM v LEFT JOIN u ON src = id GROUP BY id) GROUP BY out_degree")
def degree_histogram(spark, sf):
    return derived.flow(spark, sf, symmetrize=True).degree_histogram()


@register("vertices_with_edges", "SELECT id FROM v WHERE id IN (SELECT src FROM g)", SPARSE)
def vertices_with_edges(spark, sf):
    return derived.sparse(spark, sf).where_vertices(F.col("out_degree") > 0).select("id")


@register("graph_stats", "SELECT n AS nodes, m AS edges, m // n AS degree, false AS directed FROM n, (SELECT count(*) // 2 AS m FROM u)")
def graph_stats(spark, sf):
    return derived.flow(spark, sf, symmetrize=True).stats()


@register("graph_stats_directed", "SELECT n AS nodes, m AS edges, m // n AS degree, true AS directed FROM n, (SELECT count(*) AS m FROM g)", SPARSE)
def graph_stats_directed(spark, sf):
    return derived.sparse(spark, sf).stats()


@register("adjacency_offsets", 'SELECT id, CAST(coalesce(sum(d) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", d AS out_degree FROM (SELECT id, count(src) AS d FROM v LEFT JOIN g ON src = id GROUP BY id)')
def adjacency_offsets(spark, sf):
    return derived.flow(spark, sf).adjacency_offsets()


@register("neighbors_from_offset", "SELECT src AS id, CAST(k - 1 AS INTEGER) AS place, dst AS neighbor FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM g) WHERE k > 3")
def neighbors_from_offset(spark, sf):
    return derived.flow(spark, sf, weighted=False).neighbors(3)


@register("neighbor_at", "SELECT id, dst AS neighbor FROM v LEFT JOIN (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM g) ON src = id AND k = 2", SPARSE)
def neighbor_at(spark, sf):
    return derived.sparse(spark, sf, weighted=False).neighbor_at(1)


@register("topology", "SELECT id, concat(id, ': ', coalesce(string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst), '')) AS line FROM v LEFT JOIN g ON src = id GROUP BY id", SPARSE)
def topology(spark, sf):
    return derived.sparse(spark, sf, weighted=False).topology()


@register("relabel_by_degree", "SELECT id, row_number() OVER (ORDER BY d DESC, id DESC) - 1 AS new_id FROM (SELECT id, count(src) AS d FROM v LEFT JOIN u ON src = id GROUP BY id)")
def relabel_by_degree(spark, sf):
    return graphs.relabel_map(derived.flow(spark, sf, symmetrize=True))


@register("relabelled_edges", "SELECT a.k AS src, b.k AS dst FROM u JOIN r a ON a.id = u.src JOIN r b ON b.id = u.dst", ctes="r AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY d DESC, id DESC) - 1 AS k FROM (SELECT id, count(src) AS d FROM v LEFT JOIN u ON src = id GROUP BY id))")
def relabelled_edges(spark, sf):
    return graphs.relabel_by_degree(derived.flow(spark, sf, symmetrize=True, weighted=False)).edges


@register("partition_block", "SELECT owner, count(*) AS vertices, min(id) AS first_node, CAST(sum(d) AS BIGINT) AS entries FROM (SELECT id, d, CAST(least(id // (n // 7), 6) AS INTEGER) AS owner FROM n, (SELECT id, count(src) AS d FROM v LEFT JOIN g ON src = id GROUP BY id)) GROUP BY owner")
def partition_block(spark, sf):
    return partition.partition_block(derived.flow(spark, sf), 7)


@register("partition_round_robin", "SELECT CAST(l_orderkey % 5 AS INTEGER) AS owner, count(*) AS edges FROM lineitem GROUP BY 1")
def partition_round_robin(spark, sf):
    return partition.partition_round_robin(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey", 5)


_LAST = "SELECT CAST({k} AS INTEGER) AS owners, CAST(CASE WHEN n < {k} THEN {k} - 1 ELSE least(id // greatest(n // {k}, 1), {k} - 1) END AS INTEGER) AS owner, count(*) AS vertices FROM n, v GROUP BY 1, 2"


@register("partition_rest_to_last", " UNION ALL ".join(_LAST.format(k=k) for k in (7, 1_000_000)))
def partition_rest_to_last(spark, sf):
    graph = derived.flow(spark, sf)
    parts = [graph.vertices().select(F.lit(k).alias("owners"), partition.rest_to_last_owner(F.col("id"), graph.num_nodes, k).alias("owner")) for k in (7, 1_000_000)]
    return parts[0].unionByName(parts[1]).groupBy("owners", "owner").agg(F.count("*").alias("vertices"))


@register("partition_round_robin_sizes", "SELECT CAST(k % 7 AS INTEGER) AS owner, count(*) AS positions FROM (SELECT row_number() OVER () - 1 AS k FROM raw) GROUP BY 1")
def partition_round_robin_sizes(spark, sf):
    total = derived.flow_edges(spark, sf).count()
    return spark.createDataFrame([(i, partition.round_robin_size(total, i, 7)) for i in range(7)], "owner int, positions bigint")


# --- kernels ---------------------------------------------------------------------------------------------------------

BFS = """s(v, depth) USING KEY (v) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, max(s.depth) + 1 FROM s JOIN {0} e ON e.src = s.v
  LEFT JOIN recurring.s r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst), t AS MATERIALIZED (SELECT v, depth FROM s)"""


@register("bfs_depth", "SELECT id, coalesce(depth, -1) AS depth FROM v LEFT JOIN t ON t.v = id", ctes=BFS.format("g"))
def bfs_depth(spark, sf):
    return bfs.bfs(derived.flow(spark, sf), 0).select("id", "depth")


_PARENT = "SELECT id, coalesce(t.depth, -1) AS depth, CASE WHEN id = 0 THEN 0 ELSE coalesce(min(p.v), -1) END AS parent FROM v LEFT JOIN t ON t.v = id LEFT JOIN {0} e ON e.dst = id LEFT JOIN t p ON p.v = e.src AND p.depth = t.depth - 1 GROUP BY id, t.depth"


@register("bfs_parent_min", _PARENT.format("g"), ctes=BFS.format("g"))
def bfs_parent_min(spark, sf):
    return bfs.bfs(derived.flow(spark, sf), 0)


@register("bfs_undirected", _PARENT.format("u"), ctes=BFS.format("u"))
def bfs_undirected(spark, sf):
    return bfs.bfs(derived.flow(spark, sf, symmetrize=True), 0)


SSSP = """s(v, dist) USING KEY (v) AS (SELECT {1}, 0::BIGINT UNION SELECT e.dst, min(s.dist + e.w)::BIGINT FROM s JOIN {0} e ON e.src = s.v
  LEFT JOIN recurring.s r ON r.v = e.dst WHERE r.dist IS NULL OR s.dist + e.w < r.dist GROUP BY e.dst)"""
_DIST = "SELECT id, coalesce(dist, 1073741823) AS dist FROM v LEFT JOIN s ON s.v = id"


@register("sssp", _DIST, ctes=SSSP.format("g", "0::BIGINT"))
def sssp_flow(spark, sf):
    return sssp.sssp(derived.flow(spark, sf), 0)


@register("sssp_delta", _DIST, ctes=SSSP.format("g", "0::BIGINT"))
def sssp_delta(spark, sf):
    return sssp.sssp(derived.flow(spark, sf), 0, delta=8)


@register("sssp_unreached", _DIST, SPARSE, SSSP.format("u", "(SELECT min(src) FROM raw)"))
def sssp_unreached(spark, sf):
    first = derived.sparse_edges(spark, sf).agg(F.min("src")).first()[0]
    return sssp.sssp(derived.sparse(spark, sf, symmetrize=True), first)


CC = """s(v, comp) USING KEY (v) AS (SELECT r.id, r.id FROM v r UNION SELECT u.dst, min(s.comp) FROM s JOIN u ON u.src = s.v
  JOIN recurring.s r ON r.v = u.dst WHERE s.comp < r.comp GROUP BY u.dst), c AS MATERIALIZED (SELECT v AS id, comp FROM s)"""


@register("cc_weak", "SELECT id, comp FROM c", ctes=CC)
def cc_weak(spark, sf):
    return components.shiloach_vishkin(derived.flow(spark, sf))


@register("cc_afforest", "SELECT id, comp FROM c", ctes=CC, base=SPARSE)
def cc_afforest(spark, sf):
    return components.afforest(derived.sparse(spark, sf))


@register("cc_afforest_flow", "SELECT id, comp FROM c", ctes=CC)
def cc_afforest_flow(spark, sf):
    return components.afforest(derived.flow(spark, sf))


@register("cc_isolated", "SELECT id, comp FROM c", ctes=CC, base=SPARSE)
def cc_isolated(spark, sf):
    return components.shiloach_vishkin(derived.sparse(spark, sf, symmetrize=True))


RANKS = """od AS (SELECT src, count(*) AS d FROM {0} GROUP BY src), a AS (SELECT e.src, e.dst, od.d FROM {0} e JOIN od USING (src)),
 p(it, id, s) AS (SELECT 0, id, 1.0::DOUBLE / n FROM v, n UNION ALL
  SELECT m.it + 1, v.id, 0.15 / n + 0.85 * coalesce(sum(x.s / x.d), 0) FROM v LEFT JOIN (SELECT p.s, a.dst, a.d FROM p JOIN a ON a.src = p.id) x ON x.dst = v.id,
   n, (SELECT max(it) AS it FROM p) m WHERE m.it < {1} GROUP BY m.it, v.id, n),
 q AS MATERIALIZED (SELECT it, id, s FROM p)"""
STOP = ", e AS (SELECT b.it, sum(abs(b.s - c.s)) AS err FROM q b JOIN q c ON c.id = b.id AND c.it = b.it - 1 GROUP BY b.it), z AS (SELECT coalesce(min(it) FILTER (WHERE err < 1e-4), max(it)) AS it FROM e)"


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("id", F.round("score", 6).alias("score"))


@register("pagerank_fixed_iters", "SELECT id, round(s, 6) AS score FROM q WHERE it = 20", ctes=RANKS.format("g", 20))
def pagerank_fixed_iters(spark, sf):
    return _rounded(pagerank.pagerank(derived.flow(spark, sf), 20, 0.0).scores)


@register("pagerank_converged", "SELECT id, round(s, 6) AS score FROM q JOIN z USING (it)", ctes=RANKS.format("u", 20) + STOP)
def pagerank_converged(spark, sf):
    return _rounded(pagerank.pagerank(derived.flow(spark, sf, symmetrize=True)).scores)


@register("pagerank_dangling", "SELECT id, round(s, 6) AS score FROM q WHERE it = 5", SPARSE, RANKS.format("g", 5))
def pagerank_dangling(spark, sf):
    return _rounded(pagerank.pagerank(derived.sparse(spark, sf), 5, 0.0).scores)


BC = """f(s, v, depth, sigma) USING KEY (s, v) AS (SELECT x, x, 0, 1::DOUBLE FROM (SELECT unnest({0})::BIGINT AS x)
  UNION SELECT f.s, e.dst, max(f.depth) + 1, sum(f.sigma) FROM f JOIN g e ON e.src = f.v LEFT JOIN recurring.f r ON r.s = f.s AND r.v = e.dst WHERE r.v IS NULL GROUP BY f.s, e.dst),
 fm AS MATERIALIZED (SELECT s, v, depth, sigma FROM f),
 b(s, v, depth, delta) AS (SELECT s, v, depth, 0::DOUBLE FROM fm WHERE depth = (SELECT max(depth) FROM fm)
  UNION ALL SELECT a.s, a.v, any_value(a.depth), coalesce(sum(CASE WHEN b.v IS NOT NULL THEN a.sigma / w.sigma * (1 + b.delta) END), 0)
  FROM fm a JOIN (SELECT max(depth) AS d FROM b) x ON a.depth = x.d - 1 LEFT JOIN g e ON e.src = a.v LEFT JOIN b ON b.s = a.s AND b.v = e.dst LEFT JOIN fm w ON w.s = b.s AND w.v = b.v GROUP BY a.s, a.v),
 d AS MATERIALIZED (SELECT v, sum(delta) AS delta FROM b GROUP BY v), t AS (SELECT max(delta) AS top FROM d)"""
_BC = "SELECT id, round(coalesce(delta / nullif(top, 0), 0), 6) AS score FROM t, v LEFT JOIN d ON d.v = id"


@register("bc_single_source", _BC, ctes=BC.format("[0]"))
def bc_single_source(spark, sf):
    return _rounded(betweenness.betweenness(derived.flow(spark, sf), [0]))


@register("bc_multi_source", _BC, ctes=BC.format("[0, 1, 2]"))
def bc_multi_source(spark, sf):
    return _rounded(betweenness.betweenness(derived.flow(spark, sf), [0, 1, 2]))


TC = "o AS MATERIALIZED (SELECT src, dst FROM u WHERE src > dst), t AS MATERIALIZED (SELECT a.src AS a, a.dst AS b, b.dst AS c FROM o a JOIN o b ON b.src = a.dst JOIN o c ON c.src = a.src AND c.dst = b.dst)"


@register("triangle_count", "SELECT count(*) AS triangles FROM t", ctes=TC)
def triangle_count(spark, sf):
    return triangles.triangle_count(derived.flow(spark, sf, symmetrize=True))


@register("triangles_listed", "SELECT a, b, c FROM t", ctes=TC)
def triangles_listed(spark, sf):
    return triangles.triangles(derived.flow(spark, sf, symmetrize=True))


@register("triangles_per_vertex", "SELECT id, count(x) AS triangles FROM v LEFT JOIN (SELECT unnest([a, b, c]) AS x FROM t) ON x = id GROUP BY id", ctes=TC)
def triangles_per_vertex(spark, sf):
    return triangles.triangles_per_vertex(derived.flow(spark, sf, symmetrize=True))


# --- analysis --------------------------------------------------------------------------------------------------------


@register("bfs_stats", "SELECT count(*) AS reached, CAST(sum((SELECT count(*) FROM g WHERE src = t.v)) AS BIGINT) AS edges FROM t", ctes=BFS.format("g"))
def bfs_stats(spark, sf):
    g = derived.flow(spark, sf)
    return analysis.bfs_stats(g, bfs.bfs(g, 0))


@register("component_sizes_top5", "SELECT comp, count(*) AS vertices FROM c GROUP BY comp ORDER BY vertices DESC, comp DESC LIMIT 5", SPARSE, CC)
def component_sizes_top5(spark, sf):
    return analysis.component_sizes(components.afforest(derived.sparse(spark, sf)))


@register("component_count", "SELECT count(DISTINCT comp) AS components FROM c", SPARSE, CC)
def component_count(spark, sf):
    return analysis.component_count(components.afforest(derived.sparse(spark, sf)))


@register("component_frequent", "SELECT comp, count(*) AS vertices FROM c GROUP BY comp ORDER BY vertices DESC, comp DESC LIMIT 1", SPARSE, CC)
def component_frequent(spark, sf):
    return analysis.frequent_component(components.shiloach_vishkin(derived.sparse(spark, sf)))


@register("pagerank_top5", "SELECT id, round(s, 6) AS score FROM q WHERE it = 20 ORDER BY score DESC, id DESC LIMIT 5", ctes=RANKS.format("g", 20))
def pagerank_top5(spark, sf):
    return analysis.top_k(pagerank.pagerank(derived.flow(spark, sf), 20, 0.0).scores, 5, digits=6)


@register("bc_top5", f"SELECT * FROM ({_BC}) ORDER BY score DESC, id DESC LIMIT 5", ctes=BC.format("[0]"))
def bc_top5(spark, sf):
    return analysis.top_k(betweenness.betweenness(derived.flow(spark, sf), [0]), 5, digits=6)


@register("sssp_reach", "SELECT count(*) AS reached FROM s", SPARSE, SSSP.format("u", "(SELECT min(src) FROM raw)"))
def sssp_reach(spark, sf):
    return analysis.sssp_reach(sssp_unreached(spark, sf))


@register("worth_relabelling", "SELECT a AS average_degree, round(m, 6) AS sample_mean, p AS sample_median, (a >= 10 AND m / 1.3 > p) AS worth FROM (SELECT (SELECT count(*) FROM u) // n AS a, m, p FROM n, (SELECT avg(d) AS m, quantile_cont(d, 0.5) AS p FROM (SELECT count(*) AS d FROM u GROUP BY src)))")
def worth_relabelling(spark, sf):
    g = derived.flow(spark, sf, symmetrize=True)
    return triangles.worth_relabelling(g, g.num_nodes).withColumn("sample_mean", F.round("sample_mean", 6))


@register("pick_source")
def pick_source(spark, sf):
    g = derived.flow(spark, sf)
    return spark.createDataFrame([(i, s) for i, s in enumerate(analysis.pick_sources(g, 4))], "trial int, source bigint")


# --- verifiers: the SQL is what a right result gives -----------------------------------------------------------------


@register("verify_bfs", "SELECT 0::BIGINT AS bad_source, 0::BIGINT AS bad_source_parent, 0::BIGINT AS bad_unreached, 0::BIGINT AS bad_edges, 0::BIGINT AS bad_parents, 0::BIGINT AS bad_rows")
def verify_bfs(spark, sf):
    g = derived.flow(spark, sf)
    return verify.verify_bfs(g, 0, bfs.bfs(g, 0))


@register("verify_sssp", "SELECT 0::BIGINT AS bad_source, 0::BIGINT AS bad_rows, 0::BIGINT AS relaxable, 0::BIGINT AS without_tight_edge")
def verify_sssp(spark, sf):
    g = derived.flow(spark, sf)
    return verify.verify_sssp(g, 0, sssp.sssp(g, 0))


@register("verify_cc", "SELECT 0::BIGINT AS cross_edges, 0::BIGINT AS bad_labels, 0::BIGINT AS bad_rows, 0::BIGINT AS label_difference")
def verify_cc(spark, sf):
    g = derived.sparse(spark, sf)
    return verify.verify_cc(g, components.afforest(g))


@register("verify_cc_flow", "SELECT 0::BIGINT AS cross_edges, 0::BIGINT AS bad_labels, 0::BIGINT AS bad_rows, 0::BIGINT AS label_difference")
def verify_cc_flow(spark, sf):
    g = derived.flow(spark, sf)
    return verify.verify_cc(g, components.afforest(g))


@register("verify_pr_residual", "SELECT 0 AS not_converged")
def verify_pr_residual(spark, sf):
    g = derived.flow(spark, sf, symmetrize=True)
    return verify.verify_pagerank(g, pagerank.pagerank(g, 60).scores)


@register("verify_bc", "SELECT 0::BIGINT AS different")
def verify_bc(spark, sf):
    g = derived.sparse(spark, sf, symmetrize=True)
    sources = analysis.pick_sources(g, 2)
    return verify.verify_betweenness(g, sources, betweenness.betweenness(g, sources))


@register("verify_bc_flow", "SELECT 0::BIGINT AS different")
def verify_bc_flow(spark, sf):
    g = derived.flow(spark, sf, symmetrize=True)
    sources = analysis.pick_sources(g, 2)
    return verify.verify_betweenness(g, sources, betweenness.betweenness(g, sources))


@register("verify_tc_setintersect", "SELECT 0::BIGINT AS difference")
def verify_tc_setintersect(spark, sf):
    g = derived.flow(spark, sf, symmetrize=True)
    return verify.verify_triangles(g, triangles.triangle_count(g).first()[0])


# --- files and generators --------------------------------------------------------------------------------------------


def _there(spark: SparkSession, suffix: str) -> str:
    return f"{Tables(spark, 'files').root}/graph.{suffix}"


def _lines(spark: SparkSession, rows: DataFrame, path: str, head: list[str]) -> None:
    """Lines in the order of ``k``, after the head."""
    top = spark.createDataFrame([(i - len(head), 0, x) for i, x in enumerate(head)], "k bigint, j bigint, value string")
    top.unionByName(rows.select("k", "j", "value")).orderBy("k", "j").select("value").write.text(path)


@register("io_el", "SELECT src, dst FROM g")
def io_el(spark, sf):
    path = _there(spark, "el")
    writers.write_edge_list(derived.flow(spark, sf, weighted=False), path)
    return readers.read_edges(spark, path)


@register("io_wel", "SELECT src, dst, w FROM g")
def io_wel(spark, sf):
    path = _there(spark, "wel")
    writers.write_edge_list(derived.flow(spark, sf), path)
    return readers.read_edges(spark, path)


@register("io_gr", "SELECT src, dst, w FROM g")
def io_gr(spark, sf):
    path, g = _there(spark, "gr"), derived.flow(spark, sf)
    rows = g.edges.select(F.col("src").alias("k"), F.col("dst").alias("j"), F.concat_ws(" ", F.lit("a"), F.col("src") + 1, F.col("dst") + 1, "w").alias("value"))
    _lines(spark, rows, path, ["c a graph", f"p sp {g.num_nodes} {g.num_edges}"])
    return readers.read_edges(spark, path)


@register("io_metis", "SELECT src, dst, w FROM u")
def io_metis(spark, sf):
    path, g = _there(spark, "graph"), derived.flow(spark, sf, symmetrize=True)
    rows = g.adjacency().select(F.col("id").alias("k"), F.lit(0).cast("bigint").alias("j"), F.array_join(F.transform("neighbors", lambda x: F.concat_ws(" ", x["v"] + 1, x["w"])), " ").alias("value"))
    _lines(spark, rows, path, ["% a graph", f"{g.num_nodes} {g.num_edges} 1"])
    return readers.read_edges(spark, path)


@register("io_mtx", "SELECT src, dst, w FROM u")
def io_mtx(spark, sf):
    path, g = _there(spark, "mtx"), derived.flow(spark, sf, symmetrize=True)
    half = g.edges.where("src > dst")
    rows = half.select(F.col("src").alias("k"), F.col("dst").alias("j"), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, "w").alias("value"))
    _lines(spark, rows, path, ["%%MatrixMarket matrix coordinate integer symmetric", "% a graph", f"{g.num_nodes} {g.num_nodes} {g.num_edges}"])
    return readers.read_edges(spark, path)


@register("io_sg", "SELECT src, dst FROM u")
def io_sg(spark, sf):
    path = _there(spark, "sg")
    writers.write_serialized(derived.flow(spark, sf, symmetrize=True, weighted=False), path)
    return readers.read_serialized(spark, path).edges


@register("io_wsg", "SELECT src, dst, w FROM g")
def io_wsg(spark, sf):
    path = _there(spark, "wsg")
    writers.write_serialized(derived.flow(spark, sf), path)
    return readers.read_serialized(spark, path).edges


@register("io_convert", "SELECT src, dst, w FROM u")
def io_convert(spark, sf):
    source, target = _there(spark, "wel"), _there(spark, "wsg")
    writers.write_edge_list(derived.flow(spark, sf), source)
    writers.convert(spark, source, target, serialized=True, weighted=True, symmetrize=True)
    return readers.read_serialized(spark, target).edges


@register("io_results", "SELECT id, coalesce(depth, -1) AS depth FROM v LEFT JOIN t ON t.v = id", ctes=BFS.format("g"))
def io_results(spark, sf):
    path = _there(spark, "results")
    writers.write_results(bfs.bfs(derived.flow(spark, sf), 0).select("id", "depth"), path, trial=1)
    return writers.read_results(spark, path, 1)


@register("io_parquet_edges", "SELECT l_partkey AS src, l_suppkey AS dst, CAST(l_quantity AS INTEGER) AS w FROM lineitem")
def io_parquet_edges(spark, sf):
    return readers.read_table(spark, f"{sf}/lineitem.parquet", "l_partkey", "l_suppkey", "l_quantity")


@register("generate_uniform")
def generate_uniform(spark, sf):
    return generators.uniform_edges(spark, 10)


@register("generate_rmat")
def generate_rmat(spark, sf):
    return generators.rmat_edges(spark, 10)


@register("generate_weights")
def generate_weights(spark, sf):
    return generators.with_weights(generators.rmat_edges(spark, 10))


#: What holds for any seed: how many edges, which ids and weights, and that only one of the two kinds has hubs.
_KINDS = "SELECT * FROM (VALUES ('rmat', 16384, true, true, true), ('uniform', 16384, true, false, true)) AS t(kind, edges, ids_in_range, has_hubs, weights_in_range)"


@register("generate_summary", "SELECT kind, CAST(edges AS BIGINT) AS edges, ids_in_range, has_hubs, weights_in_range FROM (" + _KINDS + ")")
def generate_summary(spark, sf):
    parts = []
    for kind, edges in (("rmat", generators.rmat_edges(spark, 10)), ("uniform", generators.uniform_edges(spark, 10))):
        e = generators.with_weights(edges)
        top = e.groupBy("src").agg(F.count("*").alias("d")).agg((F.max("d") > 16 * 4).alias("has_hubs"))
        inside = e.agg(F.count("*").alias("edges"), F.every(F.least("src", "dst").between(0, 1023) & F.greatest("src", "dst").between(0, 1023)).alias("ids_in_range"), ((F.min("w") >= 1) & (F.max("w") <= generators.MAX_WEIGHT) & (F.count_distinct("w") > 200)).alias("weights_in_range"))
        parts.append(inside.crossJoin(top).select(F.lit(kind).alias("kind"), "edges", "ids_in_range", "has_hubs", "weights_in_range"))  # both are one row
    return parts[0].unionByName(parts[1])


@register("generate_permutation", "SELECT count(*) AS ids, count(DISTINCT id) AS images, min(id) AS least, max(id) AS most FROM (SELECT unnest(range(2048)) AS id)")
def generate_permutation(spark, sf):
    p = permuted(spark.range(2048), ["id"], 11, 5)
    return p.agg(F.count("*").alias("ids"), F.count_distinct("id").alias("images"), F.min("id").alias("least"), F.max("id").alias("most"))
