"""Sorting, paging and top-k, always with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.operators.filters import bounded

MOST_ROWS = 500


def page(df: DataFrame, sort: str, limit: int = 50, offset: int = 0, title: str = "title", date: str = "date", ordinal: str = "ordinal", id_col: str = "id") -> DataFrame:
    """One page in a named order; nulls come last and the id breaks ties."""
    bounded(limit, 1, MOST_ROWS, "limit")
    bounded(offset, 0, 10**9, "offset")
    orders = {"title": F.asc_nulls_last(title), "title_desc": F.desc_nulls_last(title), "date_desc": F.desc_nulls_last(date), "ordinal": F.asc_nulls_last(ordinal)}
    if sort not in orders:
        raise ValueError(f"sort must be one of {', '.join(orders)}")
    return df.orderBy(orders[sort], id_col).offset(offset).limit(limit)


def envelope(df: DataFrame, page: int, size: int) -> DataFrame:
    """(page, pages, total, first, last): what a page's heading says."""
    bounded(size, 1, MOST_ROWS, "size")
    total = F.col("total")
    return df.agg(F.count("*").alias("total")).select(F.lit(page).alias("page"), F.ceil(total / size).alias("pages"), "total", F.least(F.lit((page - 1) * size + 1), total).alias("first"), F.least(F.lit(page * size), total).alias("last"))


def after_key(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The rows that follow a key; the filter reaches the scan."""
    return df.filter(F.col(key) > F.lit(after)).orderBy(key).limit(limit)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, total: str | None = None) -> DataFrame:
    """The first n rows of each group, with the group's size if asked for."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("_r", F.row_number().over(w.orderBy(*order)))
    if total:
        out = out.withColumn(total, F.count("*").over(w))
    return out.filter(F.col("_r") <= n).drop("_r")


def interleave(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """Groups take turns: first all groups' first rows, then their second ones; no group can give more than `limit`."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).orderBy("_r", group).limit(limit).drop("_r")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """1, 2, ... over the whole table in an order, without one task for all: range partitions, then their offsets."""
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    from tabulon.sources.scratch import stored

    ranged = stored(ranged, "ranged")  # the partition ids must not change between the two uses
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_before")
    w = Window.partitionBy("_p").orderBy(*order)
    return ranged.join(F.broadcast(before), "_p").withColumn(out, F.row_number().over(w) + F.col("_before")).drop("_p", "_before")


def cumulated(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _n, _before, _total, _part): how many of a group's rows have each value, and how many a smaller one.

    A group of any size is spread over range partitions of its distinct values; only partition totals are put in line.
    """
    from tabulon.sources.scratch import stored

    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranged = stored(counted.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))  # a row per group and partition that holds some of it
    w = Window.partitionBy(*keys)
    ahead = F.sum("_s").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), ahead.alias("_ahead"), F.sum("_s").over(w).alias("_total"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return ranged.join(sums, same).withColumn("_before", inside + F.col("_ahead")).select(*keys, value, "_n", "_before", "_total", "_part")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column per share): exact quantiles, interpolated between neighbours (type 7), of groups of any size."""
    c = cumulated(df, keys, value).withColumn("_v", F.col(value).cast("double"))
    marks = []
    for name, p in shares.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        for end, place in (("a", F.floor(at)), ("z", F.ceil(at))):
            marks.append(F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col("_v"))).alias(f"{name}_{end}"))
    g = c.groupBy(*keys).agg(F.max("_total").alias("_rows"), *marks)
    part = {name: (F.col("_rows") - 1) * F.lit(float(p)) - F.floor((F.col("_rows") - 1) * F.lit(float(p))) for name, p in shares.items()}
    return g.select(*keys, *[(F.col(f"{n}_a") + part[n] * (F.col(f"{n}_z") - F.col(f"{n}_a"))).alias(n) for n in shares])


def nearest_ranks(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column per share): the smallest value that at least this share of a group's values does not exceed, of
    groups of any size."""
    c = cumulated(df, keys, value)
    reached = F.col("_before") + F.col("_n")
    marks = [F.min(F.when(reached >= F.greatest(F.ceil(F.col("_total") * F.lit(float(p)) - 1e-9), F.lit(1)), F.col(value))).alias(n) for n, p in shares.items()]
    return c.groupBy(*keys).agg(*marks)


def daily_pick(df: DataFrame, key: str, day_number: int) -> DataFrame:
    """One row for a day: rows stand in order of a hash of their key, and the day number walks through them."""
    h = F.xxhash64(F.col(key))
    n = df.count()
    return df.orderBy(h, key).offset(day_number % n if n else 0).limit(1)
