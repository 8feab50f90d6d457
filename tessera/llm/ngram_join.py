"""Near-duplicates by an n-gram Jaccard join with MinHash banding.

1. Texts become sets of hashed five-word shingles. Documents with equal sets are one class (copies are never paired).
2. A class has ``bands`` hashes of ``rows`` minima each; both numbers follow from the target recall at the threshold. Classes
   meet where a band hash is equal. Buckets with the same members as another bucket are dropped.
3. The shingle sets of the classes that are left are sent to their buckets, where all pairs are verified exactly. A pair that
   several buckets hold is counted in the first of them. A bucket is split into blocks, by classes and by bytes of their sets,
   and its pairs into pairs of blocks, so none has to fit into one task; a task gives link counts and a spanning forest, never the pairs themselves.
4. The forests' edges are joined to connected components by alternating large and small stars.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import positional, restored, small_batches, trimmed, unique_ids, written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 128
#: Classes of one block of a bucket, and bytes of their sets, about.
BLOCK = 1024
BLOCK_BYTES = 4_000_000
#: Odd factors that keep words of a shingle, and rows of a band, apart.
_C = np.array([pow(6364136223846793005, k, 2**64) for k in range(64)], np.uint64)


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest chance meetings, with which ``most`` hashes reach the recall."""
    best = (1, 1)
    for rows in range(1, most + 1):
        miss = 1 - threshold**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if miss > 0 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """The sorted set of hashed n-word shingles; a text of fewer words has the one of all its words, an empty text none."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    m, count = min(n, len(h)), max(1, len(h) - n + 1)
    z = np.full(count, m, np.uint64)
    for k in range(m):
        z += h[k : k + count] * _C[k]
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(z ^ (z >> np.uint64(29)))


def class_of(z: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    a = (z * np.uint64(0x9E3779B97F4A7C15)) ^ (z >> np.uint64(32))
    return int(a.sum(dtype=np.uint64)).to_bytes(8, "big") + int(np.bitwise_xor.reduce(a * a + z)).to_bytes(8, "big") if len(z) else b""


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(77)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(1, 2**63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, z: np.ndarray) -> np.ndarray:
        low = np.full(len(self.factor), 2**64 - 1, np.uint64)
        for i in range(0, len(z), 1024):
            np.minimum(low, (z[i : i + 1024, None] * self.factor).min(axis=0), out=low)
        b = low.reshape(self.bands, self.rows)
        h = (b * _C[1 : self.rows + 1]).sum(axis=1, dtype=np.uint64)
        return (h ^ (h >> np.uint64(31))).view(np.int64)


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, may: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold: rows ``left``, columns ``right`` (``left`` again, above the diagonal, if None).

    ``may`` has the candidates. Few candidates are intersected one by one, many by products of membership matrices.
    """
    cols = left if right is None else right
    size = np.array([len(s) for s in sets], np.float64)
    a, b = size[left][:, None], size[cols][None, :]
    may = may & (np.minimum(a, b) >= threshold * np.maximum(a, b))
    if right is None:
        may = np.triu(may, 1)
    out = np.zeros(may.shape, bool)
    pairs = np.argwhere(may)
    if len(pairs) <= 8 * (len(left) + len(cols)):
        for i, j in pairs:
            x, y = sets[left[i]], sets[cols[j]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[i, j] = both >= threshold * (len(x) + len(y) - both) - 1e-9
        return out
    names, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    shared = np.bincount(where) > 1
    number = np.cumsum(shared) - 1
    keep = shared[where]
    where, owner = number[where[keep]], owner[keep]
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    both = np.zeros(may.shape, np.float32)
    step = 4096
    for c in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(where, [c, c + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[lo:hi], where[lo:hi] - c] = 1
        both += m[left] @ m[cols].T
    out[may] = (both >= threshold * (a + b - both) - 1e-9)[may]
    return out


def _bucket(group: pd.DataFrame, band: int, split: bool, threshold: float):
    """Verifies one pair of blocks: (class, links, other end of a forest edge) for every class with a link."""
    group = group.drop_duplicates(["cid", "side"])
    sets = [np.frombuffer(x, np.uint64) for x in group["z"]]
    kept = np.stack(group["kept"].to_numpy())[:, :band]
    weight, cid, side = group["m"].to_numpy(), group["cid"].to_numpy(), group["side"].to_numpy()
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if split else None
    cols = left if right is None else right
    if not len(left) or not len(cols):
        return None
    may = np.ones((len(left), len(cols)), bool)
    for k in range(band):
        may &= kept[left, k][:, None] != kept[cols, k][None, :]
    linked = verified(sets, left, right, may, threshold)
    count = np.zeros(len(group), np.int64)
    np.add.at(count, left, linked @ weight[cols])
    np.add.at(count, cols, weight[left] @ linked)
    root = np.arange(len(group))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in np.argwhere(linked):
        a, b = find(left[i]), find(cols[j])
        if a != b:
            root[max(a, b)] = min(a, b)
    at = np.flatnonzero(count)
    return pd.DataFrame({"cid": cid[at], "links": count[at], "other": [cid[find(i)] for i in at]})


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root): the least node of each connected component, for every node of ``edges`` (a, b)."""
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct(), name)
    if before is None or not before[0]:
        return spark.createDataFrame([], edges.select(F.col("a").alias("node"), F.col("a").alias("root")).schema)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """id, class_id, n_links, n_same for each document.

    Documents are linked where the Jaccard similarity of their sets of ``words``-word shingles (words split at white space,
    taken as they are) reaches ``threshold``; a class is what links connect, named by its least id. ``n_links`` counts the
    other documents that a document is linked to, ``n_same`` those with an equal set. Each pair at the threshold is found
    with probability ``recall``, more similar ones are surer; pairs with equal sets always are.

    Texts of fewer words have one shingle of all their words. Null and empty texts have none: they link to nothing and are
    classes of their own. Repeated rows are documents with an equal set; null ids never name a class unless all are null.
    ``id_col`` may have any ordered type, and needn't be unique: rows are told apart by a number of their own. An empty table
    gives none; other columns aren't read, whatever their names.

    Shingles are 64-bit hashes and sets are named by 128 bits of them; neither is compared with the words again.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    if unique_ids(src, "id"):
        return _near(src.select(F.col("id").cast("bigint").alias("row"), "t"), words, threshold, recall, block).select(F.col("row").cast(src.schema["id"].dataType).alias(id_col), F.col("rep").cast(src.schema["id"].dataType).alias("class_id"), "n_links", "n_same")
    rows = written(src.withColumn("row", F.monotonically_increasing_id()), "near-rows")
    found = written(_near(rows.select("row", "t"), words, threshold, recall, block).join(rows.select("row", "id"), "row"), "near-found")
    least = found.groupBy(F.col("rep").alias("r")).agg(F.min("id").alias("class_id"))
    return found.join(least, F.col("rep") == F.col("r")).select(F.col("id").alias(id_col), "class_id", "n_links", "n_same")


def _near(src: DataFrame, words: int, threshold: float, recall: float, block: int) -> DataFrame:
    """(row, rep, n_links, n_same) of texts (row, t): ``row`` is unique and never null, ``rep`` the least row of the class."""
    spark = src.sparkSession
    small_batches(spark)
    bands, rows = banding(threshold, recall)

    def sign(batches):
        minhash = MinHash(bands, rows)
        for b in trimmed(batches):
            row, cid, size, hashes = b["row"].to_numpy(), [], [], []
            for t in b["t"]:
                z = shingles(t, words)
                cid.append(class_of(z) or None), size.append(len(z)), hashes.append(minhash(z) if len(z) else None)
            yield pd.DataFrame({"row": row, "cid": cid, "size": size, "bands": hashes})

    signed = written(src.mapInPandas(sign, "row bigint, cid binary, size bigint, bands array<bigint>"), "near-signed")
    classes = signed.where("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("m"), F.min("row").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = written(classes, "near-classes")
    exploded = classes.select("cid", "size", F.posexplode("bands").alias("band", "h"))
    buckets = exploded.groupBy("band", "h").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y")).where("n > 1")
    kept = buckets.groupBy("n", "size", "x", "y").agg(F.min(F.struct("band", "h")).alias("k"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") * 8 / BLOCK_BYTES)).cast("int")
    kept = kept.select(F.col("k.band").alias("band"), F.col("k.h").alias("h"), blocks.alias("blocks"))
    where = exploded.drop("size").join(kept, ["band", "h"]).groupBy("cid").agg(F.collect_list(F.struct("band", "h", "blocks")).alias("at"))
    asked = classes.select("cid", "m", "rep").join(where, "cid")

    parts = "band int, h bigint, i int, j int, side int, cid binary, m bigint, kept array<bigint>, z binary"

    def deal(batches):
        for b in trimmed(batches):
            out, size = [], 0
            for t, cid, m, at in zip(b["t"], b["cid"], b["m"], b["at"], strict=True):
                raw = shingles(t, words).tobytes()
                own = int.from_bytes(cid[:8], "big")
                mine = np.array([(own * (2 * k + 3) + k) % 2**63 for k in range(bands)], np.int64)
                for x in at:
                    mine[x["band"]] = x["h"]
                for x in at:
                    b_own = own % x["blocks"]
                    for other in range(x["blocks"]):
                        out.append((x["band"], x["h"], min(b_own, other), max(b_own, other), int(b_own > other), cid, m, mine, raw))
                        size += len(raw)
                        if len(out) >= 512 or size >= BLOCK_BYTES:
                            yield pd.DataFrame(out, columns=NAMES)
                            out, size = [], 0
            yield pd.DataFrame(out, columns=NAMES)

    def verify(batches):
        for key, group in _grouped(trimmed(batches)):
            got = _bucket(group, int(key[0]), key[2] != key[3], threshold)
            if got is not None:
                yield got

    texts = src.join(asked, F.col("row") == F.col("rep")).select("t", "cid", "m", "at")
    dealt = texts.mapInPandas(deal, parts).repartition("band", "h", "i", "j").sortWithinPartitions("band", "h", "i", "j")
    linked = written(dealt.mapInPandas(verify, "cid binary, links bigint, other binary"), "near-links")
    links = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    found = components(linked.select(F.col("cid").alias("a"), F.col("other").alias("b")), "near-stars")
    named = classes.select("cid", "m", F.col("rep").alias("own"), "size").join(links, "cid", "left").join(found, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    named = written(named.select("cid", "m", "own", "links", "root"), "near-named")
    label = named.groupBy("root").agg(F.min("own").alias("rep"))
    of_class = named.join(label, "root").select(F.col("cid").alias("c"), "rep", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "m")
    out = signed.select("row", "cid").join(of_class, F.col("cid") == F.col("c"), "left")
    return out.select("row", F.coalesce("rep", "row").alias("rep"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), (F.coalesce("m", F.lit(1)) - 1).cast("bigint").alias("n_same"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` of which one stands for each class, with all their columns, whatever their names.

    Where ids are unique whole numbers the one of the least id stays, else the first by a number given to each row. Null and
    empty texts have no shingles, so they all stay; of repeated rows with words one stays; an empty table gives none.
    """
    named, at = positional(docs)
    if unique_ids(named, at[id_col]):
        named = named.withColumn("row", F.col(at[id_col]).cast("bigint"))
    else:
        named = written(named.withColumn("row", F.monotonically_increasing_id()), "near-rows")
    found = _near(named.select("row", F.coalesce(F.col(at[text_col]), F.lit("")).alias("t")), words, threshold, recall, block)
    stay = found.where("row = rep").select(F.col("row").alias("stays"))
    return restored(named.join(stay, F.col("row") == F.col("stays"), "left_semi"), at)


NAMES = ["band", "h", "i", "j", "side", "cid", "m", "kept", "z"]


def _grouped(batches):
    """Consecutive rows of equal (band, h, i, j), whole, from sorted batches."""
    held: list[pd.DataFrame] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        keys = b[["band", "h", "i", "j"]].to_numpy()
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(b)], strict=True):
            key = tuple(keys[lo])
            if key != last and held:
                yield last, pd.concat(held, ignore_index=True)
                held = []
            last = key
            held.append(b.iloc[lo:hi])
    if held:
        yield last, pd.concat(held, ignore_index=True)


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents; odd rows as stated there."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
