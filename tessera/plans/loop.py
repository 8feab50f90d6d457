"""What iterative kernels need: tables in the shared folder that cut lineage, and figures observed while they are written.

A generation of state is one Parquet table. Writing it is the only job of a step: counts and sums that decide about the next
step are observed by the same job. Tables survive the loss of an executor, and generations that nothing reads any more are
deleted.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a local folder where it is unset (local mode alone)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """The tables of one run. ``keep`` limits how many generations of a name stay; the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
        self.made: dict[str, list[str]] = {}
        atexit.register(self._end)

    def write(self, df: DataFrame, name: str, keep: int | None = None, **figures: Column) -> tuple[DataFrame, dict]:
        """The written table, and the values of ``figures`` (aggregates) over its rows."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        seen: dict = {}
        if figures:
            watch = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
            df.observe(watch, *[c.alias(k) for k, c in figures.items()]).write.parquet(path)
            seen = watch.get
        else:
            df.write.parquet(path)
        old = self.made.setdefault(name, [])
        old.append(path)
        if keep is not None:
            while len(old) > keep:
                remove(self.spark, old.pop(0))
        return self.spark.read.schema(df.schema).parquet(path), seen

    def drop(self, path: str) -> None:
        """Deletes a table that nothing reads any more."""
        for old in self.made.values():
            if path in old:
                old.remove(path)
        remove(self.spark, path)

    def _end(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended before
            return
