"""Column functions that give the same values at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.loop import Tables


def uniform_int(bound: int, *keys) -> Column:
    """A uniform value in 0..bound-1 from the hash of ``keys`` (columns or literals)."""
    return F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys]), F.lit(bound))


def unit(*keys) -> Column:
    """A uniform value in [0, 1) with 53 bits from the hash of ``keys``."""
    h = F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys])
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def fenced(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` last, as one element of an array that is taken out again: no filter on them is pushed below.

    A filter pushed through a chain of projections repeats all their expressions, which for a permutation is more than
    the compiler takes.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))


def permuted(df: DataFrame, columns: list[str], bits: int, seed: int, rounds: int = 4) -> DataFrame:
    """``df`` with ids 0..2**bits-1 in ``columns`` replaced by a pseudo-random permutation of them.

    Each round mixes one half of an id's bits into the other. Every step can be undone, so it is a bijection; nothing is
    sorted, shuffled or joined. A round is a projection of its own, as expressions nested over all rounds would grow
    exponentially.
    """
    if bits < 2:
        return df
    low = bits // 2
    sizes = {"a": bits - low, "b": low}
    rest = [c for c in df.columns if c not in columns]
    df = df.select(*rest, *[F.shiftrightunsigned(c, low).alias(f"_a_{c}") for c in columns], *[F.col(c).bitwiseAND(F.lit((1 << low) - 1)).alias(f"_b_{c}") for c in columns])
    for r in range(rounds):
        to, by = ("b", "a") if r % 2 == 0 else ("a", "b")
        mixed = [F.col(f"_{to}_{c}").bitwiseXOR(uniform_int(1 << sizes[to], F.col(f"_{by}_{c}"), seed + r)).alias(f"_{to}_{c}") for c in columns]
        df = df.select(*rest, *mixed, *[f"_{by}_{c}" for c in columns])
    return df.select(*rest, *[(F.shiftleft(f"_a_{c}", low) + F.col(f"_b_{c}")).alias(c) for c in columns])


def numbered(df: DataFrame, order: list[Column], name: str, tables: Tables) -> DataFrame:
    """``df`` with its 0-based place in the total order: a range-partitioned sort and per-partition offsets.

    The sorted rows are written once, so places stay put; only one row a partition comes together for the offsets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    local, _ = tables.write(local.withColumn("_p", F.shiftright("_m", 33)), name)
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    placed = local.join(F.broadcast(offsets), "_p")  # a row a partition
    return placed.withColumn(name, (F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("_m", "_p", "_o")
