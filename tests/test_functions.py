from pyspark.sql import functions as F

from tessera.functions.columns import numbered, permuted, uniform_int, unit
from tessera.plans.loop import Tables


def test_numbering_follows_the_order(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 501).alias("x"))
    got = numbered(rows, [F.desc("x")], "k", Tables(spark, "t")).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.k)] == sorted((r.x for r in got), reverse=True)
    assert sorted(r.k for r in got) == list(range(500))


def test_permutations_are_bijections(spark):
    for bits in (0, 1, 2, 5, 8):
        p = permuted(spark.range(1 << bits).withColumn("y", F.col("id")), ["id", "y"], bits, 3).collect()
        assert sorted(r.id for r in p) == list(range(1 << bits)) and all(r.id == r.y for r in p)
    assert [r.id for r in permuted(spark.range(256), ["id"], 8, 3).collect()] != list(range(256))


def test_hashes_are_uniform(spark):
    r = spark.range(20000).select(uniform_int(10, F.col("id"), 1).alias("a"), unit(F.col("id"), 2).alias("b")).agg(F.avg("a"), F.avg("b"), F.min("b"), F.max("b")).first()
    assert abs(r[0] - 4.5) < 0.1 and abs(r[1] - 0.5) < 0.02 and r[2] >= 0 and r[3] < 1


def test_figures_are_observed_and_old_tables_go(spark):
    t = Tables(spark, "t")
    for k in range(3):
        df, seen = t.write(spark.range(10 + k), "g", keep=1, n=F.count("*"))
        assert seen == {"n": 10 + k} and df.count() == 10 + k
    assert len(t.made["g"]) == 1
