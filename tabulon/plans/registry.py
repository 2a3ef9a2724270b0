"""Named queries with, where SQL can express them, the DuckDB statement for the same rows.

A query is a function (spark, sf_dir) -> DataFrame; register() adds it under its SURVEY key.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: modules that register queries when imported
MODULES = ("lifecycle", "records", "join_queries", "aggregate_queries", "series_queries", "text_queries", "index_queries", "ingest_queries", "further_queries", "law_queries", "completed_queries")


def register(name: str, oracle: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """dates: columns that query and statement both give as text (YYYY-MM-DD), as engines differ in what they hand out."""
    if oracle and dates:
        oracle = f"SELECT * REPLACE ({', '.join(f'CAST("{d}" AS VARCHAR) AS "{d}"' for d in dates)}) FROM ({oracle})"

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = query(spark, sf_dir)
            return df.withColumns({d: df[d].cast("string") for d in dates})

        QUERIES[name] = spelled if dates else query
        if oracle:
            ORACLES[name] = oracle
        return query

    return add


for _module in MODULES:
    importlib.import_module(f"tabulon.plans.{_module}")
