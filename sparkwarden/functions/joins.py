"""Joins whose sides both grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def many(side: DataFrame) -> DataFrame:
    """A join's side with a row per package, name, run or vector: both sides are shuffled, neither is broadcast.

    Spark guesses the size of such a side from its compressed file.  Keys that count up compress to a few bytes a row, so a million
    packages pass for small and would go through the driver.
    """
    return side.hint("merge")
