import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, packing
from tests.llm.helpers import docs, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "a", "Hello, world's 123  \n\n x ", "x" * 3000, "é" * 700, "日本語 テキスト", "<|endoftext|> a<|endoftext|>", " " * 900, "\n \t " * 50 + "a", "abcabcab" * 200, "\ud7ff🙂" * 40, words(3, 900)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_decode(spark, reference):
    rows = list(enumerate(TEXTS))
    got = bpe.encode_documents(docs(spark, rows).withColumn("ids", F.lit(1)), RANKS, public_tokenizers.PATTERN).collect()
    for r in got:
        t = TEXTS[r.doc_id] or ""
        want = reference.encode_ordinary(t)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n_tokens == len(want) and bytes(r.decoded) == t.encode()
    assert len(got) == len(TEXTS)
    assert bpe.encode_documents(docs(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []


def test_random_pieces(reference):
    e = bpe.BytePairEncoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    r = random.Random(2)
    texts = ["".join(r.choice("aeiou thrn,.é1Q") for _ in range(r.randint(0, 700))) for _ in range(300)]
    ids, at = e.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == reference.encode_ordinary(t)


def packed(spark, rows, **options):
    return packing.pack(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), **options).collect()


def test_packing(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*enumerate(TEXTS)] + [(100 + i, words(i, random.Random(i).randint(1, 1500))) for i in range(60)]
    want = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows}
    got = packed(spark, rows, chunk_chars=20_000)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[d]) and bytes(p.ids) == want[d][at : at + p.length].tobytes()
            at += p.length
        assert at == len(want[d])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0 and {p.tier for p in pieces} == {at}
    groups = {}
    for r in got:
        groups.setdefault(r.step_group, {})[r.sequence_id] = r.tier
    assert all(sum(g.values()) <= packing.STEP_TOKENS for g in groups.values())


def test_packing_edge_cases(spark):
    assert packed(spark, []) == []
    got = packed(spark, [(None, None), (1, ""), (1, "")])
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and all(r.length == 1 and r.doc_tokens == 1 for r in got)
    q = packing.packed_digests(docs(spark, [(1, "")])).first()
    assert q.ids_crc32 == zlib.crc32(np.array([1], "<u4").tobytes())
