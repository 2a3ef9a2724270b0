"""Filters: the universal record filter, facets, guards, quarantine with reasons, suppression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RecordFilter:
    """What to keep of a record table; empty parts keep everything.

    facets: array or scalar column -> wanted values (any of them); contains: column -> substring, case-insensitive;
    ranges: date column -> (first, last), both inclusive and optional; any_date: array column -> (first, last).
    """

    datasets: tuple[str, ...] = ()
    ids: tuple = ()
    facets: dict[str, tuple] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    any_date: dict[str, tuple[str, str]] = field(default_factory=dict)

    def condition(self, df: DataFrame, dataset: str = "dataset", id_col: str = "id") -> Column:
        """Cheap comparisons first, so that they reach the scan; a filter drops rows for which this is null."""
        kinds = dict(df.dtypes)
        out = F.lit(True)
        if self.datasets:
            out &= F.col(dataset).isin(*self.datasets)
        if self.ids:
            out &= F.col(id_col).isin(*self.ids)
        for name, wanted in self.facets.items():
            out &= F.arrays_overlap(F.col(name), F.array(*map(F.lit, wanted))) if kinds[name].startswith("array") else F.col(name).isin(*wanted)
        for name, (first, last) in self.ranges.items():
            kind = kinds[name]  # the bound takes the column's type: a cast of the column would keep the filter from the scan
            out &= F.col(name) >= F.lit(first).cast(kind) if first else F.lit(True)
            out &= F.col(name) < F.date_add(F.lit(last).cast("date"), 1).cast(kind) if last else F.lit(True)
        for name, (first, last) in self.any_date.items():
            out &= F.exists(name, lambda d: d.between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        for name, part in self.contains.items():
            out &= F.contains(F.lower(name), F.lit(part.lower()))
        return out


def keep(df: DataFrame, wanted: RecordFilter, **columns: str) -> DataFrame:
    return df.filter(wanted.condition(df, **columns))


def all_terms(columns: list[str], query: str) -> Column:
    """Every blank-separated term of the query occurs, case-insensitively, in the columns' joined text."""
    text = F.lower(F.concat_ws(" ", *columns))
    out = F.lit(True)
    for term in query.lower().split():
        out &= F.contains(text, F.lit(term))
    return out


def number_guard(c: Column, lowest: float | None = None) -> Column:
    """The value as a double if it is a finite number and not below `lowest`; else null."""
    x = c.try_cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(good & (x >= lowest) if lowest is not None else good, x)


def year_guard(c: Column, first: int = 1700, last: int = 2200) -> Column:
    y = c.try_cast("int")
    return F.when(y.between(first, last), y)


def date_guard(c: Column) -> Column:
    """An ISO date that exists; impossible days and other spellings are null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def hold_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that a row breaks; null for a good row."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules.items()):
        out = F.when(F.coalesce(broken, F.lit(True)), name).otherwise(out)
    return out


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and held rows with hold_reason."""
    judged = df.withColumn("hold_reason", hold_reason(rules))
    return judged.filter("hold_reason is null").drop("hold_reason"), judged.filter("hold_reason is not null")


def allowed_url(url: Column, hosts: tuple[str, ...]) -> Column:
    """https only, and the host or a parent domain of it on the list."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    listed = F.lit(False)
    for h in hosts:
        listed |= (host == h) | F.endswith(host, F.lit("." + h))
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & listed, F.lit(False))


def suppress_small(value: Column, count: Column, least: int = 5) -> Column:
    """Null where fewer than `least` cases stand behind a value."""
    return F.when(count >= least, value)


def with_support(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of the units that have at least `least` rows."""
    enough = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return df.join(enough, keys, "left_semi")


def bounded(value: int, low: int, high: int, name: str) -> int:
    """A parameter within its bounds, or a ValueError before any plan is made."""
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not {value}")
    return value
