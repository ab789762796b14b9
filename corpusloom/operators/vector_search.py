"""Exact cosine search over vector columns for one query; many at once are in ``vector_index``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.numeric import cosine
from corpusloom.functions.text import words


def vector_literal(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def scored(vectors: DataFrame, query: Sequence[float], out: str = "score") -> DataFrame:
    """Add the cosine to one query vector."""
    return vectors.withColumn(out, cosine(F.col("embedding"), vector_literal(query)))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id") -> DataFrame:
    """The ``k`` most similar rows (ties by key). Filter ``vectors`` first: filters on columns
    reach the scan, and each task keeps only its own k rows."""
    return scored(vectors, query).orderBy(F.round("score", 9).desc(), key).limit(k)


def nearest_per_group(vectors: DataFrame, query: Sequence[float], k: int, group: str, key: str = "vec_id") -> DataFrame:
    """Top ``k`` within each value of ``group``; tasks cut to k per group before the shuffle."""
    best = Window.partitionBy(group).orderBy(F.round("score", 9).desc(), key)
    ranked = scored(vectors, query).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k)


def above(vectors: DataFrame, query: Sequence[float], threshold: float) -> DataFrame:
    return scored(vectors, query).where(F.col("score") >= threshold)


# -- embedding ----------------------------------------------------------------------------


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """Offline stand-in for an embedding service: signed word hashing, unit length.

    A word's code is the first 32 bits of its MD5 modulo twice the width; codes from the width on
    count negatively.
    """

    @F.pandas_udf("array<double>")
    def fold(codes: pd.Series) -> pd.Series:
        def vector(code: np.ndarray) -> np.ndarray:
            counts = np.bincount(np.asarray(code, dtype=np.int64), minlength=2 * width)
            raw = (counts[:width] - counts[width:]).astype(np.float64)
            return raw / max(float(np.linalg.norm(raw)), 1e-12)

        return codes.map(vector)

    def code(word: Column) -> Column:
        return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % (2 * width)).cast("int")

    return fold(F.coalesce(F.transform(words(text), code), F.array().cast("array<int>")))


def embed_batches(df: DataFrame, text: str, embed, batch: int = 16, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """Call an external ``embed(list[str]) -> list[list[float]]`` in batches inside the tasks.

    Failed calls are repeated with doubled pauses and then re-raised; the number of vectors
    must equal the number of texts. Parallel calls = running tasks.
    """
    if batch <= 0 or attempts <= 0:
        raise ValueError("batch and attempts must be positive")
    import copy
    import time

    from pyspark.sql.types import ArrayType, FloatType, StructField

    schema = copy.deepcopy(df.schema).add(StructField("embedding", ArrayType(FloatType())))

    def call(texts: list[str]) -> list[list[float]]:
        for attempt in range(attempts):
            try:
                vectors = embed(texts)
                if len(vectors) != len(texts):
                    raise ValueError("number of vectors differs from number of texts")
                return vectors
            except Exception:
                if attempt == attempts - 1:
                    raise
                time.sleep(pause * 2**attempt)
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text].tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in call(texts[at : at + batch])]
            yield pdf.assign(embedding=vectors)

    return df.mapInPandas(run, schema)
