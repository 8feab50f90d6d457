"""Command line: ``python -m tessera.cli bfs -g 10 -n 3 -v`` and the like; ``convert`` for files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.harness import run_trials, timed
from tessera.operators import analysis, betweenness, bfs, components, pagerank, sssp, triangles, verify
from tessera.plans.graph import Graph
from tessera.sources.load import generate_graph, load_graph
from tessera.sources.writers import write_graph, write_results

KERNELS = ("bfs", "sssp", "cc", "cc_sv", "pr", "bc", "tc")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    subs = top.add_subparsers(dest="command", required=True)
    for name in (*KERNELS, "convert"):
        p = subs.add_parser(name)
        p.add_argument("-f", dest="file", default="", help="file to read the graph from")
        p.add_argument("-s", dest="symmetrize", action="store_true", help="add the other direction of every edge")
        p.add_argument("-g", dest="rmat", type=int, default=-1, metavar="scale", help="make an R-MAT graph with 2^scale vertices")
        p.add_argument("-u", dest="uniform", type=int, default=-1, metavar="scale", help="make a uniform random graph with 2^scale vertices")
        p.add_argument("-k", dest="degree", type=int, default=16, help="edges for each vertex of a synthetic graph")
        if name == "convert":
            p.add_argument("-b", dest="serialized", default="", help="where to write the binary form")
            p.add_argument("-e", dest="edge_list", default="", help="where to write an edge list")
            p.add_argument("-w", dest="weighted", action="store_true", help="write weights too")
            continue
        p.add_argument("-a", dest="analysis", action="store_true", help="show figures of the last result")
        p.add_argument("-n", dest="trials", type=int, default=16, help="number of trials")
        p.add_argument("-r", dest="start", type=int, default=None, metavar="node", help="vertex to start from")
        p.add_argument("-v", dest="verify", action="store_true", help="check each result")
        p.add_argument("-o", dest="output", default="", help="write the results of each trial to a table")
        if name == "bc":
            p.add_argument("-i", dest="iters", type=int, default=1, help="sources of a trial")
        if name == "pr":
            p.add_argument("-i", dest="iters", type=int, default=20, help="at most i iterations")
            p.add_argument("-t", dest="tolerance", type=float, default=1e-4, help="stop below this total change")
        if name == "sssp":
            p.add_argument("-d", dest="delta", type=int, default=1, help="width of a bucket")
    return top


def build(spark: SparkSession, args: argparse.Namespace, weighted: bool) -> Graph:
    if args.file:
        return timed("Build Time", lambda: load_graph(spark, args.file, symmetrize=args.symmetrize, weighted=weighted))
    if args.uniform >= 0 or args.rmat >= 0:
        uniform = args.uniform >= 0
        return timed("Generate Time", lambda: generate_graph(spark, args.uniform if uniform else args.rmat, args.degree, uniform=uniform, weighted=weighted))
    raise SystemExit("a graph is needed: -f, -g or -u")


def run(spark: SparkSession, args: argparse.Namespace):
    """Runs one command; the report of a kernel's trials, or the converted graph."""
    name = args.command
    if name == "convert":
        if not (args.serialized or args.edge_list):
            raise SystemExit("nothing to write: -b or -e")
        graph = build(spark, args, args.weighted)
        print(graph.describe())
        if args.serialized:
            write_graph(graph, args.serialized, serialized=True)
        if args.edge_list:
            write_graph(graph, args.edge_list)
        return graph
    graph = build(spark, args, weighted=name == "sssp")
    n = max(1, args.trials)
    per = args.iters if name == "bc" else 1
    sources = analysis.pick_sources(graph, n * per, start=args.start) if name in ("bfs", "sssp", "bc") else []
    if name == "bfs":
        kernel, look, check = (lambda t: bfs.bfs(graph, sources[t])), (lambda r: analysis.bfs_stats(graph, r)), (lambda r, t: verify.verify_bfs(graph, sources[t], r))
    elif name == "sssp":
        kernel, look, check = (lambda t: sssp.sssp(graph, sources[t], args.delta)), analysis.sssp_reach, (lambda r, t: verify.verify_sssp(graph, sources[t], r))
    elif name in ("cc", "cc_sv"):
        find = components.afforest if name == "cc" else components.shiloach_vishkin
        kernel, look, check = (lambda t: find(graph)), (lambda r: analysis.component_sizes(r).crossJoin(analysis.component_count(r))), (lambda r, t: verify.verify_cc(graph, r))  # the count is one row
    elif name == "pr":
        kernel, look, check = (lambda t: pagerank.pagerank(graph, args.iters, args.tolerance).scores), analysis.top_k, (lambda r, t: verify.verify_pagerank(graph, r, args.tolerance))
    elif name == "bc":
        kernel, look, check = (lambda t: betweenness.betweenness(graph, sources[t * per : (t + 1) * per])), analysis.top_k, (lambda r, t: verify.verify_betweenness(graph, sources[t * per : (t + 1) * per], r))
    else:
        if graph.directed:
            raise SystemExit("triangles need an undirected graph: try -s")
        kernel, look, check = (lambda t: triangles.triangle_count(graph)), (lambda r: r.select(F.concat_ws(" ", "triangles", F.lit("triangles")).alias("stats"))), (lambda r, t: verify.verify_triangles(graph, r.first()[0]))
    sink = (lambda r, t: write_results(r, args.output, t)) if args.output else None
    return run_trials(graph, kernel, trials=args.trials, analysis=look if args.analysis else None, verifier=check if args.verify else None, sink=sink)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    report = run(spark, args)
    return int(bool(getattr(report, "verified", None)) and not all(report.verified))


if __name__ == "__main__":
    sys.exit(main())
