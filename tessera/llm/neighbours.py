"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the cell floor((a.x + b) / w) for several Gaussian directions a. A query visits its own cell of
every table and then perturbed ones (one or more coordinates moved by one), in the order in which they are estimated to
succeed: by the squared distances from the query's projections to the cell walls that are crossed. Candidates of all
tables are merged and ranked by exact distance.

Points meet probes in blocks: a group of cells of one table, split further where it is hot. A task holds one block of
points, and probes stream past it. Identical vectors are taken together before anything is shuffled, with the smallest of
their ids, so a vector that a third of all rows hold costs a row a batch. Queries that find fewer neighbours than there are
get them from an exact scan in blocks, and so do all of them where no number of probes reaches the target recall.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import small_batches, trimmed, written

#: Vectors that the index is fitted on at most; every row is indexed.
SAMPLE = 4096
TUNING_QUERIES = 96
TABLES = 3
TARGET_RECALL = 0.98
MOST_PROBES = 4096
#: Points of a block, about.
BLOCK = 20_000
#: Groups that are split into blocks by measured size; any further ones would only be slower, not different.
SPLIT_GROUPS = 100_000
#: Queries that one exact scan takes along.
SCAN_QUERIES = 2000


@dataclass
class Index:
    directions: np.ndarray  # tables x dims x coordinates
    shift: np.ndarray
    width: float
    template: np.ndarray  # probes x 2 coordinates, which walls are crossed, by rank of their distance
    salt: np.ndarray

    def cells(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        f = (x @ self.directions[table] + self.shift[table]) / self.width
        c = np.floor(f)
        return c.astype(np.int64), f - c

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        """A 64-bit name for each cell; equal names of different cells only add candidates."""
        with np.errstate(over="ignore"):
            h = (cells.astype(np.uint64) * self.salt[table]).sum(axis=-1, dtype=np.uint64)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            return (h ^ (h >> np.uint64(32))).view(np.int64)

    def probes(self, q: np.ndarray, table: int, most: int | None = None) -> np.ndarray:
        """Names of the cells to visit for each query, in order (queries x probes)."""
        cells, inside = self.cells(q, table)
        m = cells.shape[1]
        walls = np.concatenate([inside, 1 - inside], axis=1)  # below, above
        order = np.argsort(walls, axis=1, kind="stable")
        template = self.template[:most]
        out = np.empty((len(q), len(template)), np.int64)
        for i in range(len(q)):
            moved = np.zeros((len(template), 2 * m), np.int64)
            moved[:, order[i]] = template
            out[i] = self.keys(cells[i] + moved[:, m:] - moved[:, :m], table)
        return out


def probe_template(m: int, most: int) -> np.ndarray:
    """Sets of walls in order of expected score, walls ranked by distance: rank j and rank 2m-1-j are the two walls of a coordinate.

    Expected squared distances of the ranks are those of sorted uniform variables.
    """
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    score = np.concatenate([low, (1 - j / (m + 1) + j * (j + 1) / (4 * (m + 1) * (m + 2)))[::-1]])
    sets, heap = [()], [(score[0], (0,))]
    while heap and len(sets) < most:
        s, walls = heapq.heappop(heap)
        if all(2 * m - 1 - w not in walls for w in walls):
            sets.append(walls)
        last = walls[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (s - score[last] + score[last + 1], (*walls[:-1], last + 1)))
            heapq.heappush(heap, (s + score[last + 1], (*walls, last + 1)))
    out = np.zeros((len(sets), 2 * m), np.int64)
    for i, walls in enumerate(sets):
        out[i, list(walls)] = 1
    return out


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def fit(sample: np.ndarray, total: int, *, tables: int = TABLES, target: float = TARGET_RECALL, k: int = 10) -> Index | None:
    """Directions, cell width and probes for ``total`` vectors, from a bounded sample; None where none reach the target.

    Cells start out as fine as ``total`` asks for (coordinates by its logarithm) and get coarser until some number of
    probes reaches the target recall on the sample; the least such number is taken. Neighbours in the sample are farther
    than among all vectors, so this errs on the safe side.
    """
    finest = int(np.clip(round(np.log2(max(total, 2)) * 0.75), 4, 24))
    for m in range(finest, 3, -1):
        index, recall = _fitted(sample, m, tables, target, k)
        if recall >= target:
            return index
    return None


def _fitted(sample: np.ndarray, m: int, tables: int, target: float, k: int) -> tuple[Index, float]:
    rng = np.random.default_rng(20240229)
    n, dims = sample.shape
    directions = rng.normal(size=(tables, dims, m))
    width = 2.0 * float(np.std(sample @ directions[0])) if n > 1 else 1.0
    width = width if width > 0 else 1.0
    salt = rng.integers(1, 2**63, size=(tables, m), dtype=np.uint64) | np.uint64(1)
    index = Index(directions, rng.uniform(0, width, size=(tables, m)), width, probe_template(m, MOST_PROBES), salt)
    if n <= k + 1:
        return index, 1.0
    queries = np.arange(n)[:: max(1, n // TUNING_QUERIES)]
    truth = []
    for i in queries:
        d = distances(sample, sample[i])
        d[i] = np.inf
        truth.append(np.argsort(d, kind="stable")[:k])
    most = len(index.template)
    first = np.full((len(queries), k), most)  # the least probe, of any table, that finds a neighbour
    for t in range(tables):
        own = index.keys(index.cells(sample, t)[0], t)
        probes = index.probes(sample[queries], t)
        for i in range(len(queries)):
            hit = probes[i][None, :] == own[truth[i]][:, None]
            first[i] = np.minimum(first[i], np.where(hit.any(axis=1), hit.argmax(axis=1), most))
    found = np.sort(first.ravel())
    need = int(found[int(np.ceil(target * len(found))) - 1]) + 1
    index.template = index.template[: min(need, most)]
    return index, float((first < most).mean())


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is not null, not zero and finite throughout."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _together(ids: np.ndarray, x: np.ndarray, most: int | None) -> tuple[list, np.ndarray]:
    """Identical vectors taken together: their smallest distinct ids (all, without ``most``), and one vector each."""
    if not len(ids):
        return [], x
    order = np.lexsort((ids, *x.T[::-1]))
    x, ids = x[order], ids[order]
    other = (x[1:] != x[:-1]).any(axis=1)
    once = np.concatenate([[True], other | (ids[1:] != ids[:-1])])
    x, ids = x[once], ids[once]
    new = np.flatnonzero(np.concatenate([[True], other[once[1:]]]))
    ends = np.append(new[1:], len(ids))
    return [ids[a : b if most is None else min(b, a + most)] for a, b in zip(new, ends, strict=True)], x[new]


def _nearest(ids: list, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest distinct ids, each at its least distance, ties to the smaller id. ``ids``: those at each distance.

    Ids may repeat, so more and more of the nearest places are taken until they hold enough distinct ones.
    """
    take = most
    while True:
        near = np.arange(len(d)) if len(d) <= take else np.flatnonzero(d <= np.partition(d, take - 1)[take - 1])
        if not len(near):
            return np.zeros(0, np.int64), np.zeros(0)
        own, far = np.concatenate([ids[i] for i in near]), np.repeat(d[near], [len(ids[i]) for i in near])
        order = np.lexsort((own, far))
        own, far = own[order], far[order]
        first = np.sort(np.unique(own, return_index=True)[1])
        if len(first) >= most or len(near) == len(d):
            return own[first[:most]], far[first[:most]]
        take = 4 * len(near)


def search(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, tables: int = TABLES, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, nearest first, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another id. Null ids and vectors
    that are null, zero, hold null or non-finite components, or have another length than the sample's most common one take
    no part. Rows that repeat an id count as one candidate. Queries that find fewer than ``k``, where there are more, are
    answered by an exact scan; with no more than ``k`` candidates each query so gets all of them. Other columns aren't read,
    whatever their names.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    pts = usable(vectors, id_col, vec_col)
    schema = "query_id long, rank int, vec_id long, score double"
    chosen = pts.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    taken = pts.join(chosen, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("id"), "id").toPandas()
    if not len(taken):
        return spark.createDataFrame([], schema)
    dims = int(taken["v"].map(len).mode().iloc[0])
    pts = pts.where(F.size("v") == dims)
    sample = np.stack([np.asarray(v, float) for v in taken["v"] if len(v) == dims])
    total = pts.count()
    index = fit(sample, total, tables=tables, target=target, k=k)
    if index is None:
        return _scanned(pts, pts.where(F.col("id") % every == 0), k)
    groups = max(1, -(-total // BLOCK))

    def group_of(keys):
        return np.mod(keys >> 7, groups)

    def sizes(batches):
        for b in trimmed(batches):
            x = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, dims))
            _, x = _together(b["id"].to_numpy(), x, 1)
            for t in range(tables):
                g, n = np.unique(group_of(index.keys(index.cells(x, t)[0], t)), return_counts=True)
                yield pd.DataFrame({"g": g * tables + t, "n": n})

    counted = pts.mapInPandas(sizes, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(f"n > {2 * BLOCK}")
    split = {r.g: -(-r.n // BLOCK) for r in counted.orderBy(F.desc("n"), "g").limit(SPLIT_GROUPS).collect()}
    offset = 1 << 20  # blocks of a group

    def place(batches):
        for b in trimmed(batches):
            ids, x = _together(b["id"].to_numpy(), np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, dims)), k + 1)
            for t in range(tables):
                keys = index.keys(index.cells(x, t)[0], t)
                g = group_of(keys) * tables + t
                part = np.array([(int(i[0]) * 2654435761 >> 8) % split.get(int(h), 1) for i, h in zip(ids, g, strict=True)], np.int64)
                yield pd.DataFrame({"block": g * offset + part, "cell": keys, "ids": ids, "v": list(x)})

    def ask(batches):
        for b in trimmed(batches):
            ids, x = _together(b["id"].to_numpy(), np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, dims)), None)
            for lo in range(0, len(x), 64):
                for t in range(tables):
                    names = index.probes(x[lo : lo + 64], t)
                    rows = []
                    for i, own in enumerate(names):
                        own = np.unique(own)
                        g = group_of(own) * tables + t
                        order = np.argsort(g, kind="stable")
                        at = np.flatnonzero(np.concatenate([[True], np.diff(g[order]) > 0]))
                        for h, cells in zip(g[order][at], np.split(own[order], at[1:]), strict=True):
                            rows += [(int(h) * offset + s, cells, ids[lo + i], x[lo + i]) for s in range(split.get(int(h), 1))]
                    yield pd.DataFrame(rows, columns=["block", "cells", "qids", "v"])

    def meet(batches):
        for points, asked in _blocks(trimmed(batches)):
            if points is None:
                continue
            x, cell, ids = points
            out = []
            for cells, qids, v in zip(asked["cells"], asked["ids"], asked["v"], strict=True):
                cells = np.asarray(cells)
                lo, hi = np.searchsorted(cell, cells, "left"), np.searchsorted(cell, cells, "right")
                n = hi - lo
                if not n.sum():
                    continue
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                d = distances(x[at], np.asarray(v))
                # One more than k distinct ids: a query's own, which goes later, takes no other's place.
                out.append((qids, *_nearest(ids[at], d, k + 1)))
            yield pd.DataFrame(out, columns=["qids", "ids", "scores"])

    points = pts.mapInPandas(place, "block long, cell long, ids array<long>, v array<double>")
    probes = pts.where(F.col("id") % every == 0).mapInPandas(ask, "block long, cells array<long>, qids array<long>, v array<double>")
    here = points.select("block", F.lit(0).alias("probe"), F.array("cell").alias("cells"), "ids", "v").unionByName(probes.select("block", F.lit(1).alias("probe"), "cells", F.col("qids").alias("ids"), "v"))
    dealt = here.repartition("block").sortWithinPartitions("block", "probe")
    met = dealt.mapInPandas(meet, "qids array<long>, ids array<long>, scores array<double>")
    pairs = met.select(F.explode("qids").alias("query_id"), F.arrays_zip("ids", "scores").alias("z")).select("query_id", F.explode("z").alias("z")).select("query_id", F.col("z.ids").alias("vec_id"), F.col("z.scores").alias("score"))
    ranked = written(_ranked(pairs, k), "neighbours")

    wanted = min(k, pts.select("id").distinct().limit(k + 1).count() - 1)
    asked = pts.where(F.col("id") % every == 0)
    full = ranked.groupBy("query_id").count().where(F.col("count") >= wanted)
    short = asked.join(full, F.col("id") == F.col("query_id"), "left_anti")
    if not short.take(1):
        return ranked
    # The exact way for the rest: all points pass by these queries in blocks.
    enough = ranked.join(full.select("query_id"), "query_id", "left_semi").select("query_id", "rank", "vec_id", "score")
    return enough.unionByName(_scanned(pts, short, k))


def _blocks(batches):
    """(points, probes) of a block for every batch or part of one that has probes, from rows sorted by block, points first.

    Points are (vectors, cells, ids) in order of their cells, or None where the block has none. Only they are held.
    """
    block, held, points = None, [], None
    for b in batches:
        if not len(b):
            continue
        names, probe = b["block"].to_numpy(), b["probe"].to_numpy()
        cuts = np.flatnonzero((names[1:] != names[:-1]) | (probe[1:] != probe[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(b)], strict=True):
            if names[lo] != block:
                block, held, points = names[lo], [], None
            part = b.iloc[lo:hi]
            if not probe[lo]:
                held.append((np.stack(part["v"].to_numpy()), np.concatenate(part["cells"].to_numpy()), part["ids"].to_numpy()))
                continue
            if held:
                x, cell, ids = (np.concatenate(z) for z in zip(*held, strict=True))
                order = np.argsort(cell, kind="stable")
                held, points = [], (x[order], cell[order], ids[order])
            yield points, part


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    once = pairs.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scanned(pts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of ``asked``: all points pass by the queries, ``SCAN_QUERIES`` at a time.

    What a turn finds is written as a table before the next, so neither the plan nor what a task holds grows with their number.
    """
    out, after = None, F.lit(True)
    asked = asked.select("id", "v").distinct()
    while True:
        got = asked.where(after).orderBy("id", "v").limit(SCAN_QUERIES).toPandas()
        if not len(got):
            break
        last = got.iloc[-1]  # an id may have several vectors, on both sides of it
        same = F.col("id") == int(last["id"])
        after = (F.col("id") > int(last["id"])) | (same & (F.col("v") > F.array(*(F.lit(float(c)) for c in last["v"]))))
        qids, qx = got["id"].to_numpy(), np.stack(got["v"].to_numpy())

        def scan(batches, qids=qids, qx=qx):
            for b in batches:
                ids, x = _together(b["id"].to_numpy(), np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, qx.shape[1])), k + 1)
                rows = []
                for q, v in zip(qids, qx, strict=True):
                    own, far = _nearest(ids, distances(x, v), k + 1)
                    rows += zip([q] * len(own), own, far, strict=True)
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

        found = written(_ranked(pts.mapInPandas(scan, "query_id long, vec_id long, score double"), k).drop("rank"), "neighbours-scanned")
        out = found if out is None else out.unionByName(found)
        if len(got) < SCAN_QUERIES:
            break
    if out is None:
        return pts.sparkSession.createDataFrame([], T.StructType.fromDDL("query_id long, rank int, vec_id long, score double"))
    return _ranked(out, k)


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    """``search`` over all embeddings; odd rows as stated there."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
