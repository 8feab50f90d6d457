"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one line of JSON.

A query that fails is named in ``failed``, and the exit code tells.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tessera.operators import betweenness, bfs, components, pagerank, sssp, triangles
from tessera.plans import derived
from tessera.sources import generators

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> int:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, make):
        t = time.perf_counter()
        out = make()
        if hasattr(out, "write"):
            out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    spark.range(1000).selectExpr("sum(id)").collect()  # the session's first job
    timed("read", lambda: derived.flow_edges(spark, SF_DIR))
    timed("generate_rmat_18", lambda: generators.rmat_edges(spark, 18))
    timed("generate_rmat_15", lambda: generators.rmat_edges(spark, 15))
    directed = timed("build_directed", lambda: derived.flow(spark, SF_DIR))
    both = timed("build_undirected", lambda: derived.flow(spark, SF_DIR, symmetrize=True))
    timed("bfs", lambda: bfs.bfs(directed, 0))
    timed("sssp", lambda: sssp.sssp(directed, 0))
    timed("cc_afforest", lambda: components.afforest(directed))
    timed("cc_shiloach_vishkin", lambda: components.shiloach_vishkin(directed))
    timed("pagerank_20", lambda: pagerank.pagerank(directed, 20, 0.0).scores)
    timed("bc_1", lambda: betweenness.betweenness(directed, [0]))
    timed("tc", lambda: triangles.triangle_count(both))
    try:
        from tessera.llm import queries as llm
    except ImportError:
        llm = None
    failed = []
    for name, query in (llm.queries() if llm else {}).items():
        try:
            timed(name, lambda query=query: query(spark, SF_DIR))
        except Exception as e:  # noqa: BLE001  one failure must not hide the other figures
            print(f"{name}: {str(e)[:300]}", file=sys.stderr)
            failed.append(name)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").rsplit("/sf", 1)[-1]}
    print(json.dumps(out | ({"failed": failed} if failed else {})))
    spark.stop()
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
