"""Accumulators that are kept between runs: states of chunks, written apart, merged, and finished when asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Accumulator:
    """Count, sum, squares about a fixed centre, extremes and a histogram of a value by keys.

    A state is a plain row, so states of chunks can be appended to a table; merged() adds them up whatever their order
    and number, and finished() gives the figures.  Values are kept as differences from `centre`, which keeps the squares
    small.
    """

    keys: tuple[str, ...]
    value: str
    width: float
    centre: float = 0.0

    def states(self, chunk: DataFrame) -> DataFrame:
        """(keys, bin, n, s, ss, lo, hi) of a chunk: one row per key and histogram bin."""
        x = F.col(self.value) - self.centre
        d = chunk.filter(F.col(self.value).isNotNull())
        return d.groupBy(*self.keys, F.floor(F.col(self.value) / self.width).alias("bin")).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"), F.min(self.value).alias("lo"), F.max(self.value).alias("hi"))

    def merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(*self.keys, "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def finished(self, states: DataFrame) -> DataFrame:
        """(keys, n, mean, sd, lo, hi, modal_bin): sd of the sample, null for one value; of equal bins the lowest."""
        n, s = F.sum("n"), F.sum("s")
        spread: Column = F.sqrt(F.greatest((F.sum("ss") - s * s / n) / (n - 1), F.lit(0.0)))
        top = F.min(F.struct((-F.col("n")).alias("o"), "bin"))["bin"]
        return self.merged(states).groupBy(*self.keys).agg(n.alias("n"), (s / n + self.centre).alias("mean"), F.when(n > 1, spread).alias("sd"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), top.alias("modal_bin"))
