"""The parts of BM25 as Spark column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    code_boost: float = 1.2


def idf(chunks: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (chunks - df + F.lit(0.5)) / (df + F.lit(0.5)))


def saturation(tf: Column, length: Column, mean: Column, config: Bm25) -> Column:
    """The term's weight: grows with its count, less in long chunks; 0 where the denominator is."""
    below = tf + F.lit(config.k1) * (F.lit(1.0 - config.b) + F.lit(config.b) * F.try_divide(length.cast("double"), mean))
    return F.coalesce(F.try_divide(tf * F.lit(config.k1 + 1.0), below), F.lit(0.0))
