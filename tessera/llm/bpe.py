"""Byte-level BPE over padded numpy matrices.

The distinct pieces of a batch are grouped by length and laid out as rows of a padded matrix of token ids. Each round
looks up the rank of every adjacent pair in a hash table (open addressing, in numpy), merges each row's leftmost pair of
least rank, and closes the gaps; rows without a mergeable pair leave. Decoding gathers token bytes.
"""

from __future__ import annotations

import base64
import heapq
import sys

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import carried, small_batches, trimmed

#: Rows of a matrix have at most so many bytes; a longer piece is merged by the same rule with a queue, as its rounds
#: over whole rows would take quadratic time.
LONGEST_ROW = 256
#: Cells of one matrix at most.
CELLS = 1 << 20
#: Distinct pieces that a worker remembers; beyond, it starts anew.
REMEMBERED = 400_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ABSENT = np.int64(1 << 40)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class PairTable:
    """(left id, right id) -> merged id, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _ABSENT, np.int64)
        todo = np.arange(len(left))
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        while len(todo):
            free = self.keys[at[todo]] == -1
            cand = todo[free]
            _, first = np.unique(at[cand], return_index=True)
            won = cand[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask
        self.longest = 1
        step = self._slot(keys)
        while True:
            miss = self.keys[step] != keys
            if not miss.any():
                break
            step[miss] = (step[miss] + 1) & self.mask
            self.longest += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], _ABSENT)
        at, keys = at.ravel(), keys.ravel()
        flat = out.ravel()
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        for _ in range(self.longest):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            flat[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return flat.reshape(out.shape)


class BytePairEncoder:
    """Encodes by merge ranks as the id order gives them; ``pattern`` splits a text into pieces that merge separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int64))
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._reset()

    def _reset(self):
        self.known: dict[str, int] = {}
        self.flat, self.start, self.count, self.used = np.empty(1 << 16, np.uint32), [], [], 0

    def _merge_rows(self, rows: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges every row to its end. ``rows``: ids, padded with -1."""
        done_rows, done_lens = np.full_like(rows, -1), lens.copy()
        index = np.arange(len(rows))
        work = rows
        while len(index):
            width = int(lens.max())
            work = work[:, :width]
            if width < 2:
                break
            left, right = work[:, :-1], work[:, 1:]
            rank = np.where(right >= 0, self.pairs(left & 0xFFFFFFFF, right & 0xFFFFFFFF), _ABSENT)
            at = rank.argmin(axis=1)  # the leftmost of the least
            best = rank[np.arange(len(at)), at]
            over = best == _ABSENT
            if over.any():
                done_rows[index[over], :width], done_lens[index[over]] = work[over], lens[over]
                go = ~over
                index, work, lens, at, best = index[go], work[go], lens[go], at[go], best[go]
                if not len(index):
                    return done_rows, done_lens
            cols = np.arange(width - 1)
            out = np.where(cols > at[:, None], work[:, 1:], work[:, :-1])
            out[np.arange(len(at)), at] = best
            work, lens = out, lens - 1
        if len(index):
            done_rows[index, : work.shape[1]], done_lens[index] = work, lens
        return done_rows, done_lens

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same rule for one long piece: a queue gives the leftmost pair of least rank."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        size, nxt, prev = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, end = self.ranks, n
        queue = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = nxt[i] if size[i] else end
            if j >= end or ranks.get(piece[i : i + size[i] + size[j]]) != r:
                continue
            ids[i], size[i], size[j] = r, size[i] + size[j], 0
            nxt[i] = nxt[j]
            if nxt[i] < end:
                prev[nxt[i]] = i
                if (q := ranks.get(piece[i : i + size[i] + size[nxt[i]]])) is not None:
                    heapq.heappush(queue, (q, i))
            if (p := prev[i]) >= 0 and (q := ranks.get(piece[p : i + size[i]])) is not None:
                heapq.heappush(queue, (q, p))
        return np.array([x for x, s in zip(ids, size, strict=True) if s], np.uint32)

    def _keep(self, ids: np.ndarray):
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(ids), len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start.append(self.used), self.count.append(len(ids))
        self.used += len(ids)

    def _learn(self, pieces: list[str]):
        """Encodes new pieces, by length, and remembers them in the given order."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lens = np.array([len(b) for b in raw], np.int64)
        result: list = [None] * len(raw)
        for i in np.flatnonzero(lens > LONGEST_ROW):
            result[i] = self._merge_long(raw[i])
        edges = (0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, LONGEST_ROW)
        for low, high in zip(edges, edges[1:], strict=False):
            chosen = np.flatnonzero((lens > low) & (lens <= high))
            for k in range(0, len(chosen), max(1, CELLS // high)):
                part = chosen[k : k + max(1, CELLS // high)]
                joined = np.frombuffer(b"".join(raw[i].ljust(high, b"\0") for i in part), np.uint8).reshape(len(part), high)
                rows = np.where(np.arange(high) < lens[part][:, None], self.byte_id[joined], -1)
                rows, n = self._merge_rows(rows, lens[part])
                for i, row, m in zip(part, rows.astype(np.uint32), n.tolist(), strict=True):
                    result[i] = row[:m]
        for p, ids in zip(pieces, result, strict=True):
            self.known[p] = len(self.start)
            self._keep(ids if ids is not None else np.empty(0, np.uint32))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text starts, with the end)."""
        if len(self.known) > REMEMBERED:
            self._reset()
        pieces = [self.split.findall(t) for t in texts]
        known = self.known
        if new := list(dict.fromkeys(p for ps in pieces for p in ps if p not in known)):
            self._learn(new)
        per = [len(p) for p in pieces]
        which = np.fromiter((known[p] for ps in pieces for p in ps), np.int64, sum(per))
        start, count = np.array(self.start, np.int64), np.array(self.count, np.int64)
        n = count[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        ids = self.flat[np.arange(total) + np.repeat(start[which] - (ends - n), n)]
        bounds = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        return ids, np.concatenate([[0], ends])[bounds]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.token_len[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        return self.token_bytes[np.arange(total) + np.repeat(self.token_at[ids] - (ends - n), n)].tobytes()


def worker_encoder(vocabulary: str, pattern: str) -> BytePairEncoder:
    """One encoder for each worker process and vocabulary."""
    held = sys.__dict__.setdefault("_tessera_encoders", {})
    if (vocabulary, pattern) not in held:
        held[vocabulary, pattern] = BytePairEncoder(load_ranks(vocabulary), pattern)
    return held[vocabulary, pattern]


#: Characters that one call encodes, so that memory is bounded by it and the longest text.
CHUNK_CHARS = 4_000_000


def chunks(texts: list[str], most: int = CHUNK_CHARS):
    """Ranges of ``texts`` of about ``most`` characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (binary, from the ids) for each document.

    One narrow pass. Null texts count as empty; repeated rows and null ids give a row each; empty tables give none; other
    columns aren't read.
    """

    small_batches(docs.sparkSession)

    def run(batches):
        encoder = worker_encoder(vocabulary, pattern)
        for b in trimmed(batches):
            texts = b["t"].tolist()
            for lo, hi in chunks(texts):
                ids, at = encoder.encode(texts[lo:hi])
                whole, cut = encoder.decode(ids), np.concatenate([[0], np.cumsum(encoder.token_len[ids])])[at]
                raw = ids.astype("<u4").tobytes()
                yield b.iloc[lo:hi][["id"]].assign(n_tokens=np.diff(at), ids=[raw[4 * at[i] : 4 * at[i + 1]] for i in range(hi - lo)], decoded=[whole[cut[i] : cut[i + 1]] for i in range(hi - lo)])

    carry, kind = carried(docs, id_col)
    taken = docs.select(F.col(id_col).cast(carry).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = taken.mapInPandas(run, f"id {carry}, n_tokens bigint, ids binary, decoded binary")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """``encode_documents`` over all documents with digests of ids and bytes; odd rows as stated there."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
