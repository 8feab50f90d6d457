"""Removal of long repeated byte strings with a sparse suffix array.

A byte goes if a string of ``width`` bytes that covers it starts anywhere else as well. Sorting every suffix would move
the corpus many times over, so only suffixes at content-chosen positions (anchors: the least hash of a short gram within
``SPAN`` bytes) are sorted. Every window of ``width`` bytes has one anchor, chosen by the window's own bytes, so equal
windows have equal anchors at equal offsets, and nothing is lost.

1. Each anchor's suffix is a row of tokens: t1 names the bytes from the anchor on that all its windows hold, t2 the whole
   region of its windows. Splitters sampled from t1 range-partition the rows; a bucket sorts its rows by multikey
   quicksort. Neighbours equal in both tokens: every window of the anchor repeats. Equal in t1 alone: some may.
2. For the latter, one region of each kind is cut from the texts and sent to the bucket of its t1, where the regions' windows
   are sorted by multikey quicksort on their two tokens; neighbours that are equal repeat.
3. A t1 with so many regions that a bucket can't hold them sends windows in place of regions. Those are range-partitioned by
   their own sampled splitters; a window that very many texts share fills several buckets, each of which finds it, and
   the last row of a bucket is compared with the first ones of the next.

Tokens are polynomials of the bytes modulo the prime 2**61 - 1, each of the two with a base of its own: two different
strings of n bytes share one token with a chance of at most n / 2**61 and both with its square, whatever their bytes are.
Strings are taken as equal when both tokens are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import carried, numbered, small_batches, trimmed, written

WIDTH = 400
GRAM = 16
#: Bytes that one numpy pass works on (some 150 times as many are held meanwhile); longer texts go in overlapping pieces.
PASS_BYTES = 1 << 19
#: Tokens sampled for splitters.
SAMPLE = 100_000
#: Rows that a bucket sorts, and bytes of regions that it holds, about.
BUCKET_ROWS = 500_000
BUCKET_BYTES = 6_000_000
#: Regions of one t1 beyond which windows are sent in their place.
HOT_REGIONS = 20_000

_PRIME = 2**61 - 1
_P, _LOW30, _LOW31 = np.uint64(_PRIME), np.uint64(2**30 - 1), np.uint64(2**31 - 1)
#: Values that are multiplied at a time, so that what is made on the way stays in a processor's cache.
_STRETCH = 1 << 13
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)

# Drawn once: the two bases, and a word of its own for each byte value.
_RNG = np.random.default_rng(11)
_BASES = [int(b) for b in _RNG.integers(2**40, _PRIME - 1, size=2)]
_VALUE = _RNG.choice(2**31 - 1, size=256, replace=False).astype(np.uint64) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for any 64-bit values."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """``x`` * 2**31, congruent modulo the prime, for values below 2**62."""
    return (x >> _30) + ((x & _LOW30) << _31)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of values below it, from halves of 31 bits."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    return _reduced((ah * bh << np.uint64(1)) + _shifted(ah * bl + al * bh) + al * bl)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` or more; they are kept, as every pass needs the same ones."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, _times(have, np.uint64(pow(base, len(have), _PRIME)))])
    _powers[base] = have
    return have


class Rolling:
    """Polynomials of any ranges of ``raw`` from prefix sums; equal bytes have equal values wherever they stand."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        self.inverse = _power(pow(_BASES[which], -1, _PRIME), len(raw) + 1)
        power = _power(_BASES[which], len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        for i in range(0, len(raw), _STRETCH):
            j = min(i + _STRETCH, len(raw))
            term = _times(_VALUE[raw[i:j]], power[i:j])
            # Sums of the halves of a stretch stay far below 64 bits.
            own = _reduced(_shifted(np.cumsum(term >> _31)) + np.cumsum(term & _LOW31))
            self.sums[i + 1 : j + 1] = _reduced(own + self.sums[i])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        for i in range(0, len(start), _STRETCH):
            s, e = start[i : i + _STRETCH], end[i : i + _STRETCH]
            out[i : i + len(s)] = _mix(_times(_reduced(self.sums[e] + _P - self.sums[s]), self.inverse[s]))
        return out


def _grams(raw: np.ndarray, gram: int) -> np.ndarray:
    """A word for each ``gram`` bytes in a row, which only chooses anchors: words of ever longer strings, mixed in pairs."""
    h, size = _mix(_VALUE[raw] * np.uint64(0x9E3779B97F4A7C15)), 1
    while size < gram:
        step = min(size, gram - size)
        h = _mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        size += step
    return h


def anchored(raws: list[bytes], width: int, keep: int | None = None) -> tuple[np.ndarray, ...]:
    """(text, first window, last window - first window, t1, t2) for every anchor of texts that are scanned together."""
    span = min(width // 2, 200)
    gram = min(GRAM, width - span + 1)
    lens = np.array([len(r) for r in raws], np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    empty = np.zeros(0, np.int64)
    if len(raw) < width:
        return empty, empty, empty, empty, empty
    ends = np.cumsum(lens)
    at = np.arange(len(raw) - gram + 1)
    # The upper bits order grams by hash, the lower ones by place: the minimum is the leftmost gram of least hash.
    low = np.uint64(max(24, int(len(raw)).bit_length()))
    best = (_grams(raw, gram) >> low << low) | at.astype(np.uint64)
    size = 1
    while size * 2 <= span:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if span > size:
        best = np.minimum(best[: len(best) - (span - size)], best[span - size :])
    text = np.repeat(np.arange(len(raws)), lens)
    p = np.arange(len(raw) - width + 1)
    p = p[p + width <= ends[text[p]]]
    if not len(p):
        return empty, empty, empty, empty, empty
    anchor = (best[p] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[p[1:]] != text[p[:-1]])]))
    first, last, a = p[new], p[np.append(new[1:], len(p)) - 1], anchor[new]
    t1 = Rolling(raw)(a, a + (width - span + 1))
    shape = (a - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (last - first).astype(np.uint64)
    t2 = _mix(Rolling(raw, 1)(first, last + width) ^ shape)
    own = text[first]
    return own, first - (ends - lens)[own], last - first, t1.view(np.int64), t2.view(np.int64)


def multikey_quicksort(*tokens: np.ndarray, small: int = 1 << 14) -> np.ndarray:
    """The order of rows of tokens: three-way partition on one token, the equal part going on with the next."""
    order = np.arange(len(tokens[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(tokens):
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort([t[part] for t in reversed(tokens[depth:])])]
            continue
        key = tokens[depth][part]
        pivot = np.median(key[:: max(1, len(key) // 9)][:9].astype(np.float64))
        pivot = key[np.argmin(np.abs(key[:: max(1, len(key) // 99)].astype(np.float64) - pivot)) * max(1, len(key) // 99)]
        less, more = key < pivot, key > pivot
        n, m = int(less.sum()), int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        todo += [(lo, lo + n, depth), (lo + n, hi - m, depth + 1), (hi - m, hi, depth)]
    return order


class Splitters:
    """Sampled range splitters. A key that several splitters equal has the buckets between them; rows choose one by ``salt``."""

    def __init__(self, sample: np.ndarray, buckets: int):
        s = np.sort(sample)
        self.cuts = s[(np.arange(1, buckets) * len(s)) // buckets] if len(s) and buckets > 1 else np.zeros(0, np.int64)
        self.spanning = np.unique(self.cuts[1:][self.cuts[1:] == self.cuts[:-1]])

    def __call__(self, keys: np.ndarray, salt: np.ndarray) -> np.ndarray:
        left, right = np.searchsorted(self.cuts, keys, "left"), np.searchsorted(self.cuts, keys, "right")
        return np.where(right - left > 1, left + 1 + np.mod(salt, np.maximum(right - left, 1)), right).astype(np.int32)


def _runs(*tokens: np.ndarray) -> np.ndarray:
    """For sorted rows: the number of the run of equal rows that each belongs to."""
    new = np.zeros(len(tokens[0]), bool)
    for t in tokens:
        new[1:] |= t[1:] != t[:-1]
    return np.cumsum(new)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartitionById(buckets, F.col("bucket"))


def _slices(batches, rows: int = 512):
    """Batches in short slices, so that what is made from one is small."""
    for b in trimmed(batches):
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows]


def _gathered(batches) -> pd.DataFrame | None:
    parts = [b for b in trimmed(batches) if len(b)]
    return pd.concat(parts, ignore_index=True) if parts else None


def _passes(batch: pd.DataFrame, width: int):
    """Texts of a batch as bytes, some ``PASS_BYTES`` at a time: (rows, places in their texts, pieces).

    Pieces of a long text overlap by all but a byte of a window, so each window lies in exactly one.
    """
    rows, at, raws, size = [], [], [], 0
    for i, t in enumerate(batch["t"]):
        whole = t.encode("utf-8", "surrogatepass")
        for base in range(0, max(1, len(whole) - width + 1), PASS_BYTES):
            raw = whole[base : base + PASS_BYTES + width - 1]
            rows.append(i), at.append(base), raws.append(raw)
            size += len(raw)
            if size >= PASS_BYTES:
                yield np.array(rows), np.array(at), raws
                rows, at, raws, size = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(at), raws


def repeated_spans(docs: DataFrame, *, width: int = WIDTH, hot: int = HOT_REGIONS) -> DataFrame:
    """(doc, spans): for each text with repeated strings, its removed runs as array<struct<s, e>> in order.

    ``docs`` has doc (bigint, unique) and t (string). Rows without a removed byte are absent.
    """
    spark = docs.sparkSession
    long = docs.where(F.octet_length("t") >= width)
    sized = long.agg(F.sum(F.octet_length("t")).alias("n"), F.count("*").alias("d")).first()
    span = min(width // 2, 200)
    schema = "doc bigint, spans array<struct<s: bigint, e: bigint>>"
    if not sized.d:
        return spark.createDataFrame([], schema)
    rows_about = max(1, 2 * sized.n // span)
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(floor, -(-rows_about // BUCKET_ROWS))

    one_in = max(1, rows_about // SAMPLE)

    def first_tokens(batches):
        for b in batches:
            for _, _, raws in _passes(b, width):
                yield pd.DataFrame({"k": anchored(raws, width)[3]})

    few = long.where(F.pmod(F.xxhash64("doc"), F.lit(one_in)) == 0) if one_in > 1 else long
    splitters = Splitters(few.select("t").mapInPandas(first_tokens, "k bigint").limit(4 * SAMPLE).toPandas()["k"].to_numpy(np.int64), buckets)

    def suffixes(batches):
        for b in trimmed(batches):
            ids = b["doc"].to_numpy()
            for rows, at, raws in _passes(b, width):
                own, first, extent, t1, t2 = anchored(raws, width)
                doc, first = ids[rows][own], first + at[own]
                yield pd.DataFrame({"bucket": splitters(t1, doc + first), "t1": t1, "t2": t2, "doc": doc, "at": (first << 8) | extent})

    def compare(batches):
        b = _gathered(batches)
        if b is None:
            return
        t1, t2, doc, at = (b[c].to_numpy() for c in ("t1", "t2", "doc", "at"))
        o = multikey_quicksort(t1, t2)
        t1, t2, doc, at = t1[o], t2[o], doc[o], at[o]
        group, run = _runs(t1), _runs(t1, t2)
        size = np.bincount(run)
        lone, head = size[run] == 1, np.concatenate([[True], run[1:] != run[:-1]])
        kinds = np.bincount(group[head])  # different regions of a t1
        across = np.isin(t1, splitters.spanning)  # its other rows may be in other buckets
        part = head & ((kinds[group] > 1) | across)
        # 0: every window of the anchor repeats. 1, 2: a region to compare (1: whose own windows are asked for); 3, 4: the same, hot.
        kind = np.where(lone, 1, 2) + np.where((kinds[group] > hot) | across, 2, 0)
        yield pd.DataFrame({"kind": np.concatenate([np.zeros((~lone).sum(), np.int32), kind[part].astype(np.int32)]), "t1": np.concatenate([t1[~lone], t1[part]]), "doc": np.concatenate([doc[~lone], doc[part]]), "at": np.concatenate([at[~lone], at[part]])})

    rows = long.select("doc", "t").mapInPandas(suffixes, "bucket int, t1 bigint, t2 bigint, doc bigint, at bigint")
    found = written(_dealt(rows, buckets).mapInPandas(compare, "kind int, t1 bigint, doc bigint, at bigint"), "suffix-found")

    whole = found.where("kind = 0").select("doc", F.expr("shiftright(at, 8)").alias("s"), F.expr(f"shiftright(at, 8) + (at & 255) + {width}").alias("e"))
    asked = found.where("kind > 0").groupBy("doc").agg(F.collect_list(F.struct("kind", "t1", "at")).alias("a"))
    texts = _packed(long).join(asked, "doc")
    some = found.where("kind > 0").agg(F.sum(F.expr(f"CASE WHEN kind < 3 THEN (at & 255) + {width} END")).alias("region"), F.sum(F.expr("CASE WHEN kind > 2 THEN (at & 255) + 1 END")).alias("hot")).first()

    parts = [whole]
    if some.region:
        wide = max(floor, -(-some.region // BUCKET_BYTES))
        cuts = Splitters(splitters.cuts, wide) if len(splitters.cuts) else Splitters(np.zeros(0, np.int64), wide)
        if not len(cuts.cuts) or wide > len(splitters.cuts):  # t1 is a hash: even ranges serve as well
            cuts.cuts = np.linspace(-(2**63), 2**63 - 1, wide + 1)[1:-1].astype(np.int64)

        def regions(batches):
            for b in _slices(batches):
                out = []
                for doc, raw, a in _unpacked(b):
                    for x in a:
                        if x["kind"] < 3:
                            first = x["at"] >> 8
                            out.append((x["t1"], doc, first, x["kind"] == 1, raw[first : first + (x["at"] & 255) + width]))
                if out:
                    t1, doc, first, asked_, region = zip(*out, strict=True)
                    yield pd.DataFrame({"bucket": np.searchsorted(cuts.cuts, np.array(t1, np.int64), "right").astype(np.int32), "doc": doc, "first": first, "asked": asked_, "region": region})

        def windows_of(batches):
            b = _gathered(batches)
            if b is None:
                return
            w1, w2, at = _windows(b["region"].tolist(), width)
            own, place = at
            o = multikey_quicksort(w1, w2)
            run = _runs(w1[o], w2[o])
            again = np.zeros(len(o), bool)
            again[o] = np.bincount(run)[run] > 1
            again &= b["asked"].to_numpy(bool)[own]
            yield _intervals(b["doc"].to_numpy()[own[again]], b["first"].to_numpy()[own[again]] + place[again], width)

        cut = texts.mapInPandas(regions, "bucket int, doc bigint, first bigint, asked boolean, region binary")
        parts.append(_dealt(cut, wide).mapInPandas(windows_of, "doc bigint, s bigint, e bigint"))
    if some.hot:
        parts.append(_hot_windows(texts, some.hot, width, floor))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    merged = (
        spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("a"))
    )

    def union(batches):
        for b in _slices(batches):
            out = []
            for a in b["a"]:
                runs: list[list[int]] = []
                for x in a:
                    if runs and x["s"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["e"])
                    else:
                        runs.append([x["s"], x["e"]])
                out.append([{"s": s, "e": e} for s, e in runs])
            yield pd.DataFrame({"doc": b["doc"], "spans": out})

    return merged.mapInPandas(union, schema)


def _windows(regions: list[bytes], width: int):
    """Tokens of every window of every region: (one, the other, (region, place in it)). Some ``PASS_BYTES`` are hashed at a time."""
    lens = np.array([len(r) for r in regions], np.int64)
    n = lens - width + 1
    own = np.repeat(np.arange(len(regions)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    tokens = [], []
    chunk = (np.cumsum(lens) - lens) // PASS_BYTES
    for lo, hi in itertools.pairwise([*np.flatnonzero(np.diff(chunk, prepend=-1)), len(regions)]):
        raw = np.frombuffer(b"".join(regions[lo:hi]), np.uint8)
        starts = np.cumsum(lens[lo:hi]) - lens[lo:hi]
        first, end = np.searchsorted(own, [lo, hi])
        p = starts[own[first:end] - lo] + place[first:end]
        for which, out in enumerate(tokens):
            out.append(Rolling(raw, which)(p, p + width).view(np.int64))
    w1, w2 = (np.concatenate(t) if t else np.zeros(0, np.int64) for t in tokens)
    return w1, w2, (own, place)


def _intervals(doc: np.ndarray, p: np.ndarray, width: int) -> pd.DataFrame:
    """Windows as intervals; adjacent ones become one."""
    o = np.lexsort((p, doc))
    doc, p = doc[o], p[o]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (p[1:] != p[:-1] + 1)])) if len(p) else np.zeros(0, int)
    last = np.append(new[1:], len(p)) - 1 if len(p) else new
    return pd.DataFrame({"doc": doc[new], "s": p[new], "e": p[last] + width})


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed one by one, as they are shuffled."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in _slices(batches):
            yield pd.DataFrame({"doc": b["doc"], "z": [z.compress(t.encode("utf-8", "surrogatepass")) for t in b["t"]]})

    return docs.select("doc", "t").mapInPandas(run, "doc bigint, z binary")


def _unpacked(b: pd.DataFrame):
    z = zstandard.ZstdDecompressor()
    for doc, packed, a in zip(b["doc"], b["z"], b["a"], strict=True):
        yield doc, z.decompress(packed), a


def _hot_windows(texts: DataFrame, count: int, width: int, floor: int) -> DataFrame:
    """Repeated windows among hot regions, window by window (step 3)."""
    buckets = max(floor, -(-count // BUCKET_ROWS))
    one_in = max(1, count // SAMPLE)

    def of(b):
        for doc, raw, a in _unpacked(b):
            a = [x for x in a if x["kind"] > 2]
            if a:
                w1, w2, (own, place) = _windows([raw[x["at"] >> 8 : (x["at"] >> 8) + (x["at"] & 255) + width] for x in a], width)
                # Ranges go by a token of the whole window, so that only one window's rows can fill several buckets.
                first, mine = np.array([x["at"] >> 8 for x in a]), np.array([x["kind"] == 3 for x in a])
                yield doc, w1, w2, first[own] + place, mine[own]

    def tokens(batches):
        for b in batches:
            for doc, w1, _, p, _ in of(b):
                yield pd.DataFrame({"k": w1[_mix((p + doc).astype(np.uint64)) % np.uint64(one_in) == 0]})

    splitters = Splitters(texts.mapInPandas(tokens, "k bigint").limit(4 * SAMPLE).toPandas()["k"].to_numpy(np.int64), buckets)

    def windows(batches):
        for b in batches:
            for doc, w1, w2, p, mine in of(b):
                yield pd.DataFrame({"bucket": splitters(w1, doc + p), "w1": w1, "w2": w2, "doc": doc, "p": p, "mine": mine})

    def compare(batches):
        b = _gathered(batches)
        if b is None:
            return
        o = multikey_quicksort(b["w1"].to_numpy(), b["w2"].to_numpy())
        b = b.iloc[o].reset_index(drop=True)
        run = _runs(b["w1"].to_numpy(), b["w2"].to_numpy())
        again = np.bincount(run)[run] > 1
        hit = again & b["mine"].to_numpy(bool)
        inner = _intervals(b["doc"].to_numpy()[hit], b["p"].to_numpy()[hit], width).assign(w1=None, w2=None, open=False)
        # One row of the first and of the last run goes on to be compared across the boundary; lone ones are open.
        edge = np.unique([np.flatnonzero(run == run[0])[0], np.flatnonzero(run == run[-1])[0]])
        outer = pd.DataFrame({"doc": b["doc"][edge], "s": b["p"][edge], "e": b["p"][edge] + width, "w1": b["w1"][edge], "w2": b["w2"][edge], "open": ~again[edge] & b["mine"].to_numpy(bool)[edge]})
        yield pd.concat([inner, outer], ignore_index=True).astype({"w1": "Int64", "w2": "Int64"})

    rows = texts.mapInPandas(windows, "bucket int, w1 bigint, w2 bigint, doc bigint, p bigint, mine boolean")
    found = _dealt(rows, buckets).mapInPandas(compare, "doc bigint, s bigint, e bigint, w1 bigint, w2 bigint, open boolean")
    found = written(found, "suffix-hot")
    edges = found.where("w1 IS NOT NULL")  # two rows a bucket at most
    met = edges.groupBy("w1", "w2").count().where("count > 1").drop("count")
    across = edges.where("open").join(met, ["w1", "w2"], "left_semi")
    return found.where("w1 IS NULL").select("doc", "s", "e").unionByName(across.select("doc", "s", "e"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: int = HOT_REGIONS) -> DataFrame:
    """id, n_bytes, spans (removed runs), kept (binary, what is left) for each document.

    A text is its UTF-8 bytes, null is empty; matches never cross documents, and what counts is the input, not what is left.
    Repeated rows are documents of their own, so their strings repeat; null ids and repeated ids are told apart by row.
    Empty tables give none; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    carry, kind = carried(docs, id_col)
    named = numbered(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")), "id", "doc")
    spans = repeated_spans(named.select("doc", "t"), width=width, hot=hot)

    def pack(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in _slices(batches):
            yield b.assign(t=[z.compress(t.encode("utf-8", "surrogatepass")) for t in b["t"]])

    texts = named.select("doc", F.col("id").cast(carry).alias("id"), "t").mapInPandas(pack, f"doc bigint, id {carry}, t binary")

    def cut(batches):
        z = zstandard.ZstdDecompressor()
        for b in _slices(batches):
            n, runs, left = [], [], []
            for packed, spans_ in zip(b["t"], b["spans"], strict=True):
                raw, at, kept = z.decompress(packed), 0, []
                spans_ = [] if spans_ is None else spans_
                for x in spans_:
                    kept.append(raw[at : x["s"]])
                    at = x["e"]
                kept.append(raw[at:])
                n.append(len(raw)), runs.append(list(spans_)), left.append(b"".join(kept))
            yield pd.DataFrame({"id": b["id"], "n_bytes": n, "spans": runs, "kept": left})

    out = texts.join(spans, "doc", "left").mapInPandas(cut, f"id {carry}, n_bytes bigint, spans array<struct<s: bigint, e: bigint>>, kept binary")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """``remove_repeats`` over all documents with the figures of what goes and a digest of what stays; odd rows as stated there."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
