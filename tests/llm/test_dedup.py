import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, ngram_join, suffix_dedup
from tests.llm.helpers import docs, near, removed, words

TEXTS = [None, "", "Ab", "aB", "ÄB", "äb", "x" * 5000, "X" * 5000, "ab", None]


def exact(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(low(t), []).append(d)
    return {d: (max(groups[low(t)]), len(groups[low(t)]), d == max(groups[low(t)])) for d, t in rows}


@pytest.mark.parametrize("key", [None, lambda n: F.unhex(F.lpad(F.hex(F.length(n) % 2), 2, "0"))])
def test_exact(spark, key):
    rows = list(enumerate(TEXTS))
    df = docs(spark, rows).withColumn("digest", F.lit(1)).withColumn("norm", F.lit("x"))
    got = exact_dedup.exact_duplicates(df, files_per_batch=1, **({"key": key} if key else {})).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == exact(rows)
    assert {r.text_sha256 for r in got if r.doc_id in (0, 1)} == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}


def test_exact_repeated_rows_and_null_ids(spark):
    got = exact_dedup.exact_duplicates(docs(spark, [(3, "a")] * 3 + [(None, "a"), (None, "b")])).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 2
    assert sorted(str(r.keep_id) for r in got) == ["3", "3", "3", "3", "None"]


def test_exact_keep_one_and_empty(spark):
    df = docs(spark, list(enumerate(TEXTS)))
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3 + 5, 4, 5, 7, 9}
    assert exact_dedup.exact_duplicates(docs(spark, [])).collect() == []


def bases(seed=1, n=8):
    return [words(seed + i, random.Random(i).randint(3, 90)).split() for i in range(n)]


def near_rows(n=120):
    r, base = random.Random(5), bases()
    rows = [(0, None), (1, ""), (2, "a b"), (3, " a  b\n"), (4, "a b")]
    for i in range(5, n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"n{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 4])
def test_near(spark, block):
    rows = near_rows()
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs(spark, rows).withColumn("cid", F.lit(1)), block=block).collect()}
    assert got == near(rows)


def test_near_products_match_single_intersections():
    sets = [ngram_join.shingles(t) for _, t in near_rows() if t]
    n = np.arange(len(sets))
    many = ngram_join.verified(sets, n, None, np.ones((len(n), len(n)), bool), 0.8)
    one = np.zeros_like(many)
    for i in n:
        for j in n[i + 1 :]:
            one[i, j] = ngram_join.verified([sets[i], sets[j]], np.array([0]), np.array([1]), np.ones((1, 1), bool), 0.8)[0, 0]
    assert (many == one).all() and many.any()


def test_near_keep_one(spark):
    rows = near_rows(60)
    kept = ngram_join.keep_one(docs(spark, rows))
    want = {c for c, _ in near(rows).values()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs(spark, []).columns
    assert ngram_join.keep_one(docs(spark, [(7, "a b c")] * 3 + [(None, "a b c")])).count() == 1
    assert ngram_join.near_duplicates(docs(spark, [])).collect() == []


def test_banding_reaches_recall():
    bands, rows = ngram_join.banding(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= ngram_join.MOST_HASHES


def passages(seed=4):
    r = random.Random(seed)
    some = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [some(r.randint(30, 120)) for _ in range(8)]
    out = [None, "", "x" * 500, "x" * 300, "ab" * 200]
    for _ in range(60):
        out.append("".join(some(r.randint(0, 50)) if r.random() < 0.5 else r.choice(shared)[r.randint(0, 10) :] for _ in range(r.randint(1, 6))))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, monkeypatch, small):
    if small:  # many buckets, hot tokens over several of them, texts in pieces
        for name, value in (("SAMPLE", 50), ("BUCKET_ROWS", 40), ("PASS_BYTES", 64), ("BUCKET_BYTES", 2000)):
            monkeypatch.setattr(suffix_dedup, name, value)
    texts = passages()
    out = suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts))).withColumn("t", F.lit(1)), width=40, hot=3 if small else suffix_dedup.HOT_REGIONS)
    import hashlib

    got = [(r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.orderBy("doc_id").collect()]
    assert got == removed(texts, 40)


def test_repeats_of_rows_and_empty(spark):
    got = suffix_dedup.remove_repeats(docs(spark, [(1, "q" * 10 + words(1, 20))] * 2 + [(None, words(2, 30)), (None, None)]), width=40).collect()
    assert sorted(len(r.kept) for r in got)[:3] == [0, 0, 0] and len(got) == 4
    assert suffix_dedup.remove_repeats(docs(spark, [])).collect() == []


def test_multikey_quicksort():
    r = np.random.default_rng(1)
    a, b = r.integers(-3, 3, 5000), r.integers(-(2**62), 2**62, 5000) >> r.integers(0, 62, 5000)
    o = suffix_dedup.multikey_quicksort(a, b, small=16)
    assert (np.stack([a[o], b[o]]) == np.stack([a, b])[:, np.lexsort((b, a))]).all()


def test_components_have_no_bound_of_rounds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "range", lambda n: [0], raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a int, b int")
    assert {(r.node, r.root) for r in ngram_join.components(edges).collect()} == {(i, 0) for i in range(21)}


def test_rolling_tokens_are_polynomials_modulo_the_prime():
    prime = suffix_dedup._PRIME
    rng = np.random.default_rng(3)
    a = np.append(rng.integers(0, prime, 500, np.uint64), np.array([0, 1, prime - 1], np.uint64))
    for b in (a[::-1], np.full(len(a), prime - 1, np.uint64)):
        assert suffix_dedup._times(a, b).tolist() == [int(x) * int(y) % prime for x, y in zip(a, b, strict=True)]
    raw = rng.integers(0, 256, 3 * suffix_dedup._STRETCH, np.uint8)
    for which, base in enumerate(suffix_dedup._BASES):
        roll = suffix_dedup.Rolling(raw, which)
        for s, e in ((0, 400), (suffix_dedup._STRETCH - 100, suffix_dedup._STRETCH + 300), (len(raw) - 1, len(raw))):
            plain = sum(int(suffix_dedup._VALUE[raw[i]]) * pow(base, i - s, prime) for i in range(s, e)) % prime
            assert roll(np.array([s]), np.array([e])) == suffix_dedup._mix(np.array([plain], np.uint64))


def test_strings_of_hard_structure_have_different_tokens():
    # Sums modulo a power of two can't tell these apart.
    bit = np.array([i.bit_count() & 1 for i in range(2048)], np.uint8)
    for n in (256, 512, 1024, 2048):
        for which in (0, 1):
            one, other = (suffix_dedup.Rolling(x[:n] + np.uint8(97), which)(np.array([0]), np.array([n])) for x in (bit, 1 - bit))
            assert one != other
