"""Hierarchical packing into windows of several lengths.

Every document becomes token ids and an end id. A document goes to the tier of the shortest window that holds it (longer
ones fill whole windows of the longest tier, and their rest goes to a tier of its own). Tiers are packed from the longest
to the shortest: a window takes the longest pieces that still fit, its gap is filled from shorter tiers, and only what is
left of a gap is closed by cutting a piece. Windows are powers of two and end up full; what remains at the end of a
partition is split into powers of two as well, so there is no padding. Full windows are dealt to step groups of equal
token counts.

Packing is local to a partition, so nothing is shuffled, and memory is bounded by a chunk of texts.
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import chunks
from tessera.llm.common import carried, small_batches, trimmed

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 1 << 16
END_ID = 1
#: Characters of the texts that are packed together.
CHUNK_CHARS = 3_000_000
#: Sequence numbers of one partition; partition p has p * SPAN and up.
SPAN = 1 << 40


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes as."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class FileTokenizer:
    """Ids of a byte-level BPE tokenizer file, without special tokens added.

    The file's merges are in the order of its ids, so they are read as ranks and run by the faster of the two libraries,
    which gives the same ids; a text that it can't take, or a file of another build, goes through ``tokenizers``.
    """

    def __init__(self, path: str):
        self.path, self._slow, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab, alphabet = model["vocab"], _byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and not spec.get("normalizer") and not model.get("ignore_merges")
        if plain and all(vocab[x] == 256 + i for i, x in enumerate(names)):
            import public_tokenizers
            import tiktoken

            ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.array(self.slow(text), "<u4")
        try:
            if any(s in text for s in self.special):
                return np.array(self.fast.encode(text, allowed_special="all"), "<u4")
            return np.array(self.fast.encode_ordinary(text), "<u4")
        except Exception:  # noqa: BLE001  the library's own limits
            return np.array(self.slow(text), "<u4")


def worker_tokenizer(path: str) -> FileTokenizer:
    held = sys.__dict__.setdefault("_tessera_tokenizers", {})
    if path not in held:
        held[path] = FileTokenizer(path)
    return held[path]


class Pool:
    """Pieces (document, start, length up to the longest tier) by length; a bit mask finds the longest that fits."""

    def __init__(self):
        self.by, self.mask = defaultdict(list), 0

    def add(self, doc, start: int, length: int):
        if length:
            self.by[length].append((doc, start))
            self.mask |= 1 << length

    def take(self, length: int):
        doc, start = self.by[length].pop()
        if not self.by[length]:
            self.mask ^= 1 << length
        return doc, start, length

    def longest(self, most: int) -> int:
        """The greatest length up to ``most``, or 0."""
        return max(0, (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1


def fill_windows(pool: Pool, tiers=TIERS) -> list[list[tuple]]:
    """Full windows out of the pool, as lists of pieces; what can't fill a window stays in the pool."""
    out = []
    for i in range(len(tiers) - 1, -1, -1):
        size, below = tiers[i], tiers[i - 1] if i else 0
        while (first := pool.longest(size)) > below:
            window, gap = [pool.take(first)], size - first
            while gap and (n := pool.longest(gap)):
                window.append(pool.take(n))
                gap -= n
            if gap and pool.mask:
                doc, start, n = pool.take(pool.shortest())
                window.append((doc, start, gap))
                pool.add(doc, start + gap, n - gap)
                gap = 0
            if gap:  # the pool is empty
                for piece in window:
                    pool.add(*piece)
                return out
            out.append(window)
    return out


def powers(pool: Pool) -> list[list[tuple]]:
    """The rest of the pool in sequences whose lengths are powers of two."""
    rest = []
    while pool.mask:
        rest.append(pool.take(pool.longest(max(TIERS))))
    total, out = sum(p[2] for p in rest), []
    while total:
        size = min(max(TIERS), 1 << (total.bit_length() - 1))
        window, total = [], total - size
        while size:
            doc, start, n = rest.pop()
            window.append((doc, start, min(n, size)))
            if n > size:
                rest.append((doc, start + size, n - size))
            size -= min(n, size)
        out.append(window)
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row for each piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, tier, step_group.

    Each token of each document, and the end id after it, lies in exactly one piece; the pieces of a sequence follow each
    other from offset 0 and fill it. Null texts count as empty and give the end id alone; repeated rows and null ids are
    packed like others; empty tables give no row; other columns aren't read.
    """

    small_batches(docs.sparkSession)

    def run(batches):
        tokenizer = worker_tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() * SPAN
        counter, step_fill, step_id, next_step = 0, defaultdict(int), {}, 0
        pool, held = Pool(), {}

        def rows(windows):
            nonlocal counter, next_step
            cols = defaultdict(list)
            for window in windows:
                size, offset = sum(p[2] for p in window), 0
                if step_fill[size] % STEP_TOKENS == 0:
                    step_id[size], next_step = next_step, next_step + 1
                step_fill[size] += size
                for key, start, n in window:
                    doc, ids, left = held[key]
                    for name, v in (("id", doc), ("start", start), ("length", n), ("ids", ids[start : start + n].tobytes()), ("doc_tokens", len(ids)), ("sequence_id", base + counter), ("offset", offset), ("tier", size), ("step_group", base + step_id[size])):
                        cols[name].append(v)
                    offset += n
                    if left == n:
                        del held[key]
                    else:
                        held[key] = (doc, ids, left - n)
                counter += 1
            return pd.DataFrame(cols, columns=NAMES)

        key = 0
        for b in trimmed(batches):
            texts, docs_ = b["t"].tolist(), [None if pd.isna(x) else x for x in b["id"]]
            for lo, hi in chunks(texts, chunk_chars):
                for i in range(lo, hi):
                    ids = np.append(tokenizer(texts[i]), np.uint32(end_id)).astype("<u4")
                    held[key] = (docs_[i], ids, len(ids))
                    whole, most = len(ids) // max(TIERS), max(TIERS)
                    for k in range(whole):
                        pool.add(key, k * most, most)
                    pool.add(key, whole * most, len(ids) - whole * most)
                    key += 1
                yield rows(fill_windows(pool))
        yield rows(powers(pool))

    carry, kind = carried(docs, id_col)
    taken = docs.select(F.col(id_col).cast(carry).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = taken.mapInPandas(run, f"id {carry}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


NAMES = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]


def packed_digests(docs: DataFrame) -> DataFrame:
    """The pieces of ``pack`` with a checksum in place of their ids; odd rows as stated there."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """``packed_digests`` of all documents."""
    return packed_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
