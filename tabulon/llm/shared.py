"""Helpers that several training-data operators use: stored stages, slices of texts and empty-safe columns."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.sources.scratch import fresh_path, removed, stored, tidy  # noqa: F401  the operators write their stages with them

#: about so many bytes of text are worked on at once in a task (one text at least)
SLICE_BYTES = 400_000


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, so that extra or clashing columns cannot matter; a null text is an empty one."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Buckets:
    """Tables of one run, bucketed alike, so that they join by these columns without a shuffle; they go with the run."""

    def __init__(self, spark: SparkSession, n: int, *by: str):
        self.spark, self.n, self.by, self.paths = spark, n, by, {}

    def __enter__(self) -> Buckets:
        return self

    def __exit__(self, *_) -> None:
        for table in list(self.paths):
            self.drop(table)

    def stored(self, df: DataFrame, name: str) -> str:
        table, path = f"tabulon_{name}_{uuid.uuid4().hex}", fresh_path(self.spark, name)
        self.paths[table] = path
        df.write.bucketBy(self.n, *self.by).option("path", path).format("parquet").saveAsTable(table)
        return table

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        removed(self.spark, self.paths.pop(table))


def slices(sizes: np.ndarray, limit: int):
    """Runs of rows of about `limit` bytes together, one row at least."""
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield at, to
        at = to


def text_of(rows: pa.StructArray, at: int) -> pa.Array:
    """The field at place `at` of a column of whole rows, nulls as empty texts; spares sending the text twice."""
    return pc.fill_null(pc.struct_field(rows, at), "")
