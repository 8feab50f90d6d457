"""Synthetic graphs and random weights, the same at any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import permuted, uniform_int, unit

#: The seed of all random choices, and edges for each vertex.
SEED = 27491095
DEGREE = 16
#: The chances of the quadrants of an R-MAT matrix; the fourth has the rest.
A, B, C = 0.57, 0.19, 0.19
MAX_WEIGHT = 255


def _edges(spark: SparkSession, scale: int, degree: int) -> tuple[int, DataFrame]:
    if not 0 <= scale < 48:
        raise ValueError(f"scale {scale} is out of range")
    n = 1 << scale
    return n, spark.range(n * degree).withColumnRenamed("id", "pos")


def uniform_edges(spark: SparkSession, scale: int, degree: int = DEGREE, seed: int = SEED) -> DataFrame:
    """(pos, src, dst): 2**scale * degree pairs, both ends uniform."""
    n, rows = _edges(spark, scale, degree)
    return rows.select("pos", uniform_int(n, F.col("pos"), seed).alias("src"), uniform_int(n, F.col("pos"), seed + 1).alias("dst"))


def rmat_edges(spark: SparkSession, scale: int, degree: int = DEGREE, seed: int = SEED, permute: bool = True) -> DataFrame:
    """(pos, src, dst): each bit of both ends is drawn from the quadrants; then ids are permuted."""
    _, rows = _edges(spark, scale, degree)
    src, dst = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    draws = [unit(F.col("pos"), seed, level).alias(f"d{level}") for level in range(scale)]
    rows = rows.select("pos", *draws)
    for level in range(scale):
        d = F.col(f"d{level}")
        src = F.shiftleft(src, 1) + (d >= A + B).cast("bigint")
        dst = F.shiftleft(dst, 1) + (((d >= A) & (d < A + B)) | (d >= A + B + C)).cast("bigint")
    out = rows.select("pos", src.alias("src"), dst.alias("dst"))
    if not permute:
        return out
    return permuted(out, ["src", "dst"], scale, seed)


def generate_edges(spark: SparkSession, scale: int, degree: int = DEGREE, *, uniform: bool = False, seed: int = SEED) -> DataFrame:
    return (uniform_edges if uniform else rmat_edges)(spark, scale, degree, seed)


def with_weights(edges: DataFrame, seed: int = SEED) -> DataFrame:
    """Weights 1..255: by position where edges have one (``pos``), else by what they connect."""
    keys = [F.col("pos")] if "pos" in edges.columns else [F.col("src"), F.col("dst")]
    return edges.withColumn("w", (uniform_int(MAX_WEIGHT, *keys, seed + 2) + 1).cast("int"))
