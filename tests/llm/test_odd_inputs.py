"""Null, empty, long and repeated rows, empty tables and clashing names, through the operators and the stages of the pipeline."""

import datetime

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import exact_dedup, ngram_join, packing, pii, quality, toxicity
from tests.llm.helpers import near, words

CLASHES = ["cands", "_m", "_g", "_b", "_o", "_s", "b_email", "p_card", "_pii_t", "_pii_u", "base", "spans", "_at", "_f", "_r", "_metadata", "at", "n", "kept", "digest", "norm", "_near_row", "_near_kept", "row", "rep", "stays", "cid", "score", "t", "id", "k0", "c0", "c1"]
MAIL = "write to someone@example.com "
ROWS = [(1, None), (2, ""), (3, words(1, 60)), (3, words(1, 60)), (None, words(1, 60).upper()), (None, words(2, 40)), (2**60 + 1, MAIL + words(3, 50)), (2**60 + 3, "x " * 20000), (7, words(4, 9000))]


def odd(spark, rows=ROWS):
    full = [(i, t, "en", "src0", None if t is None else len(t), *(f"{c}{k}" for c in CLASHES)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)


def labels(spark, rows=()):
    return spark.createDataFrame([(i, 1, 0) for i in rows], "doc_id bigint, quality int, toxic int")


def stored(spark, tmp_path, df, name="documents"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return spark.read.parquet(f"{tmp_path}/{name}.parquet")


def plain(df):
    return sorted(map(str, df.select(*df.columns).collect()))


@pytest.mark.parametrize("from_files", [True, False])
def test_stages_give_columns_back(spark, tmp_path, from_files):
    labels(spark, [1, 3]).write.parquet(f"{tmp_path}/labels.parquet")
    df = odd(spark)
    if from_files:
        df = stored(spark, tmp_path, df)
    before = plain(df)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in df.schema], name
        got = plain(out)
        if name == "PII":
            assert len(got) == len(before) and len(set(got) - set(before)) == 1
            assert out.where("doc_id = 1152921504606846977").first()["text"].startswith("write to [EMAIL] ")
        else:
            assert not set(got) - set(before), name
    assert exact_dedup.keep_one(df).count() == 6  # null and empty are equal, and three texts but for case
    assert sorted(str(r.doc_id) for r in exact_dedup.keep_one(df).collect()) == sorted(["2", "3", "None", str(2**60 + 1), str(2**60 + 3), "7"])
    assert ngram_join.keep_one(df).count() == 8


def test_stages_on_empty_tables(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    df = stored(spark, tmp_path, odd(spark, []))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, str(tmp_path)).collect() == [], name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_scores_of_odd_rows(spark):
    df = odd(spark)
    for scored in (quality.quality_scores(df, labels(spark, [1])), toxicity.toxicity_scores(df, labels(spark, [1]))):
        got = scored.collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and len({r.score for r in got if r.doc_id == 3}) == 1


def test_packing_of_odd_rows(spark):
    import public_tokenizers

    got = packing.pack(odd(spark), public_tokenizers.path("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in got} == {i for i, _ in ROWS} and {r.n for r in got if r.doc_id in (1, 2)} == {1}


def test_pii_replaces_only_its_own_columns(spark):
    df = odd(spark).withColumn("pii_base", F.lit("mine"))
    found = pii.find_pii(df)
    assert found.columns == [c for c in df.columns if c != "pii_base"] + ["pii_base", "pii_spans"]
    rest = [f"`{c}`" for c in CLASHES]
    assert plain(found.select(*rest)) == plain(df.select(*rest))


def test_near_null_and_repeated_ids(spark):
    texts = [words(k % 5, 30) + f" w{k % 2}" for k in range(40)]
    unique = near(list(enumerate(texts)))
    ids = [None if k % 4 == 0 else k % 3 if k % 4 == 1 else 2**60 + k for k in range(40)]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").repartition(4)
    got = ngram_join.near_duplicates(df).collect()
    classes = {}
    for k, (c, _) in unique.items():
        classes.setdefault(c, []).append(ids[k])
    least = {c: min((i for i in own if i is not None), default=None) for c, own in classes.items()}
    want = sorted(str((ids[k], least[c], n)) for k, (c, n) in unique.items())
    assert sorted(str((r.doc_id, r.class_id, r.n_links)) for r in got) == want


def test_near_ids_of_other_types_and_long_sets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4000)
    rows = [(k, words(k % 3, 400) + f" w{k}") for k in range(30)]
    want = near(rows)
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
    df = spark.createDataFrame([(day(i), t) for i, t in rows], "doc_id date, text string").repartition(3)
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()} == {day(i): (day(c), n) for i, (c, n) in want.items()}
