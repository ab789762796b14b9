"""What the operators share: reading tables, hash folds, joins with very frequent keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.staging import fresh_path, stage

__all__ = ["attach", "fold", "free_name", "fresh_path", "plain_text", "stage", "table", "union"]

#: A key counts as frequent when more than one row in FREQUENT carries it, so there are fewer
#: than FREQUENT such keys whatever the number of rows: their table may be broadcast.
FREQUENT = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain_text(text: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """Fold of a document: crc32 of its id written as text, modulo ``folds``; a null id is in 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(F.encode(column.cast("string"), "utf-8")), F.lit(folds)), F.lit(0)).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """Join ``rows`` with one row per key of ``groups``, without a task for a frequent key.

    ``size`` names the column of ``groups`` that holds how many rows carry the key, ``total`` the
    number of all rows. Keys with more than ``total / FREQUENT`` rows go by broadcast (fewer than
    FREQUENT of them exist), the others by a shuffle in which none can dominate. Pass stored
    tables: both are read twice. ``how`` is left, inner or left_semi; null keys match nothing.
    """
    least = max(1, total // FREQUENT)
    frequent = F.broadcast(groups.filter(F.col(size) > least))
    rest = groups.filter(F.col(size) <= least)
    inner = rows.join(frequent, keys, "left_semi" if how == "left_semi" else "inner")
    others = rows.join(frequent.select(*keys), keys, "left_anti").join(rest, keys, how)
    return inner.unionByName(others)
