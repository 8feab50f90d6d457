"""Shared helpers: the shared folder, tables written to cut lineage, names that can't clash."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


#: Bytes of one Arrow batch between the JVM and Python. Spark's own limit of 64 MiB is held several times over by each task,
#: in buffers, strings and copies; batches of this size keep a task's share small however long the texts are.
BATCH_BYTES = "8m"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task holds while it talks to Python. A limit that the session was given holds in its place."""
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)


def trimmed(batches):
    """Batches; between them and at the end, freed memory goes back to the system, as reused workers would keep it."""
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library

        def trim(_):
            return 0

    for b in batches:
        yield b
        trim(0)
    trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where it is unset (tests).

    Without the setting only a local master will do: executors elsewhere wouldn't see the driver's own folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _written:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later stages read it, and a lost executor costs no recomputation before it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether ``id_col`` is a whole number that tells rows apart: never null, never repeated."""
    whole = dict(df.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    return whole and not df.groupBy(F.col(id_col).alias("i")).count().where("count > 1 or i is null").take(1)


def numbered(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """``df`` with a bigint ``name`` that tells its rows apart: the id where ids are unique and never null, else a number given in a written table."""
    if unique_ids(df, id_col):
        return df.withColumn(name, F.col(id_col).cast("bigint"))
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def carried(df: DataFrame, id_col: str) -> tuple[str, str]:
    """(the type in which an id goes through pandas, its own type): whole numbers go as text, as beside nulls they'd become floats."""
    kind = df.schema[id_col].dataType.simpleString()
    return "string" if kind in ("bigint", "int", "smallint", "tinyint") else kind, kind


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ..., and those names by column: no column can clash with one that is added."""
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*at.values()), at


def restored(df: DataFrame, at: dict[str, str]) -> DataFrame:
    """The columns that ``positional`` renamed, under their own names; others go."""
    return df.select(*[F.col(v).alias(k) for k, v in at.items()])


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the fast path, on which ``lower`` does the same."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))
