"""Named readers: a source is registered once with its kind, schema and checks, and read by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabulon.sources import files

Reader = Callable[[SparkSession, str, T.StructType], DataFrame]
_READERS: dict[str, Reader] = {}
_SOURCES: dict[str, "Source"] = {}


@dataclass(frozen=True)
class Source:
    """schema is DDL; least_rows makes a read of fewer rows an error."""

    name: str
    kind: str
    schema: str
    least_rows: int = 0


def reader(kind: str) -> Callable[[Reader], Reader]:
    """Register how a kind of source is read."""

    def add(function: Reader) -> Reader:
        if kind in _READERS:
            raise ValueError(f"readers of {kind} are registered twice")
        _READERS[kind] = function
        return function

    return add


def define_source(source: Source) -> Source:
    if source.kind not in _READERS:
        raise ValueError(f"no reader of {source.kind}")
    if _SOURCES.get(source.name, source) != source:
        raise ValueError(f"source {source.name} is defined otherwise already")
    _SOURCES[source.name] = source
    return source


def read_source(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in _SOURCES:
        raise ValueError(f"no source {name}")
    s = _SOURCES[name]
    df = _READERS[s.kind](spark, path, T.StructType.fromDDL(s.schema))
    if s.least_rows and df.limit(s.least_rows).count() < s.least_rows:
        raise ValueError(f"source {name} has fewer than {s.least_rows} rows")
    return df


reader("csv")(files.read_csv)
reader("json lines")(lambda spark, path, schema: files.read_json_lines(spark, path, schema)[0])
reader("copy text")(lambda spark, path, schema: files.read_copy_text(spark, path, schema)[0])
reader("parquet")(lambda spark, path, schema: spark.read.schema(schema).parquet(path))
