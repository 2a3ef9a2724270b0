"""Unions of intervals and runs of equal values, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, parts): overlapping and touching intervals made one; a null end is open."""
    far = F.lit("9999-12-31").cast(df.schema[end].dataType)
    w = Window.partitionBy(*keys).orderBy(start, "_e")
    d = df.withColumn("_e", F.coalesce(F.col(end), far)).withColumn("_before", F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = (F.col("_before").isNull() | (F.col(start) > F.col("_before"))).cast("int")
    d = d.withColumn("_i", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = d.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max("_e").alias(end), F.count("*").alias("parts"))
    return out.withColumn(end, F.nullif(F.col(end), far)).drop("_i")


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, value, first, last, length): stretches of consecutive rows with one value."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    d = df.withColumn("_c", changed).withColumn("_i", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_i").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_i")
