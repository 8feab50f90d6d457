import random

import numpy as np

import corpus_pipeline
from tests.llm.helpers import base_spans, docs, near, table, words
from tests.llm.test_models import prose


def test_stages_against_plain_versions(spark, tmp_path):
    r = random.Random(9)
    rows = []
    for i in range(160):
        t = prose(i, 200) if i % 8 else "spam " * 300
        if i % 20 == 3:
            t = prose(3, 200)
        if i % 20 == 5:
            w = prose(5, 400).split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 20 == 7:
            t += f" me{i}@mail.example.com +1 (555) 123-4567"
        rows.append((i, t))
    rows.append((500, words(1, 50)))
    d = table(tmp_path, "documents", docs(spark, rows))
    labels = spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(160)], "doc_id bigint, quality int, toxic int")
    table(tmp_path, "labels", labels)
    texts = dict(rows)
    now, sizes = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {x.doc_id: x.text for x in now.collect()}
        out = stage(spark, now, d)
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert now.columns == columns
            after = {x.doc_id: x.text for x in now.collect()}
            sizes.append(len(after))
        if k == 0:
            assert not [i for i in after if i % 8 == 0 and i < 160] and len(after) >= 0.95 * len([i for i in texts if i % 8])
        elif k == 1:
            groups = {}
            for i, t in before.items():
                groups.setdefault(t.lower(), []).append(i)
            assert set(after) == {max(g) for g in groups.values()}
        elif k == 2:
            assert set(after) == {c for c, _ in near(sorted(before.items())).values()}
        elif k == 3:
            assert set(after) == set(before) and all((after[i] == before[i]) == (not base_spans(before[i])) for i in before)
            assert all(x.n_chars == len(x.text) for x in now.collect())
        else:
            assert {x.doc_id for x in now.collect()} == set(before)
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3], name
    got, want = corpus_pipeline.run(spark, d), now
    total = lambda df: {x.doc_id: x.n for x in df.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert total(got) == total(want) and np.sum(list(total(got).values())) > 0
