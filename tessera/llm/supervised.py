"""What the two classifiers share: the bounded training sample and the scored table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, trimmed

#: Labelled rows that a classifier learns from at most, and the longest text among them. Both bound what reaches the
#: driver; neither touches what is scored.
TRAIN_ROWS = 8000
TRAIN_CHARS = 200_000
THRESHOLD = 0.3


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Callable[[Column], Column], *, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, y) of at most ``rows`` labelled documents, the same ones at any partitioning: those whose ids hash lowest.

    The chosen labels are bounded by ``rows`` (16 bytes each), so they are broadcast to the documents.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & learn(F.col(id_col)))
    chosen = known.groupBy(F.col(id_col).alias("_k")).agg(F.max(label).cast("int").alias("_y")).orderBy(F.xxhash64("_k"), "_k").limit(rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_k")).where(F.length(text) <= TRAIN_CHARS).select(F.col("_k").alias("id"), text.alias("text"), F.col("_y").alias("y"))


def score_all(docs: DataFrame, score: Callable[[list[str]], np.ndarray], held_out: Callable[[Column], Column], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each document; one narrow pass, nothing is shuffled, and ids stay in the JVM."""
    small_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("i"), scored_column(score, F.col(text_col)).alias("s"))
    return out.select(F.col("i").alias(id_col), F.coalesce(held_out(F.col("i")), F.lit(False)).alias("held_out"), F.col("s").alias("score"), (F.col("s") >= F.lit(THRESHOLD)).cast("int").alias("predicted"))


def scored_column(score: Callable[[list[str]], np.ndarray], text: Column) -> Column:
    """The score as a column; the row's other columns stay in the JVM. Null texts count as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in trimmed(batches):
            yield pd.Series(np.asarray(score(t.tolist()), dtype=np.float64))

    return run(F.coalesce(text, F.lit("")))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
