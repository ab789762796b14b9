"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    Catalyst may inline a projected expression into a lambda, where it would run per element;
    a lambda variable over a one-element array keeps it to one evaluation.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(n: Column) -> Column:
    """[0 .. n-1], empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def joined(values: Column, separator: str = " ") -> Column:
    """Array of any atomic type as one string."""
    return F.array_join(values.cast("array<string>"), separator)


def literal_rows(spark: SparkSession, **columns: list) -> DataFrame:
    """A small constant table, e.g. reserved tokens, planned without Python workers."""
    zipped = F.arrays_zip(*[F.lit(values).alias(name) for name, values in columns.items()])
    return spark.range(1).select(F.inline(zipped).alias(*columns))
