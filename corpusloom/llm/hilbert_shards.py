"""Shards along a Hilbert curve through the metadata.

Each of several metadata dimensions is quantised to 2**bits cells of about equal weight; the cell
of a document is a point of a small grid, and its place on the Hilbert curve through that grid is
the sort key. Consecutive runs of the sorted documents become the shards, so documents that are
alike in all dimensions lie together and a reader that filters on any of them skips files.

The law of the cut is ``rows``: shard s takes the positions p with floor(p * shards / n) = s, so
the counts of two shards differ by at most one.

Defined cases: a null value of a dimension is in the cell before all others; a null text counts as
empty; ties on the curve are ordered by identifier, then by checksum and size, so equal rows may
change places but never results; with fewer rows than shards some shards are empty; an empty table
gives an empty result; extra columns are ignored by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import plain_text, stage

BITS = 5
DIMENSIONS = ("lang", "source", "size", "doc_id")
_PREFIX_BYTES = 7


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n, d), values below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    # From axes to the transposed index: undo the excess rotations, highest bit first.
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(d):
            inverted = (x[i] >> bit) & 1 == 1
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip
    place = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def _common_prefix(low: str | None, high: str | None) -> int:
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def _ordinal(name: str, kind: T.DataType, prefix: int) -> Column:
    """An integer in the order of the column: itself, or the bytes of a string that follow the
    prefix all values share."""
    if not isinstance(kind, T.StringType):
        return F.col(name).cast("long")
    tail = F.substring(F.encode(F.col(name), "utf-8"), prefix + 1, _PREFIX_BYTES)
    return F.conv(F.hex(F.rpad(tail, _PREFIX_BYTES, F.lit(b"\0"))), 16, 10).cast("long")


def _ordinals(rows: DataFrame, dimensions) -> dict[str, Column]:
    kinds = {f.name: f.dataType for f in rows.schema}
    strings = [d for d in dimensions if isinstance(kinds[d], T.StringType)]
    ends = {}
    if strings:
        row = rows.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in strings for f in (F.min, F.max)]).first()
        ends = {d: _common_prefix(row[f"min_{d}"], row[f"max_{d}"]) for d in strings}
    return {d: _ordinal(d, kinds[d], ends.get(d, 0)) for d in dimensions}


def with_curve(rows: DataFrame, dimensions=DIMENSIONS, bits: int = BITS) -> DataFrame:
    """``rows`` with column ``curve``. Reads the dimensions twice: ends, then quantiles."""
    ordinals = _ordinals(rows, dimensions)
    cells = 1 << bits
    shares = [i / cells for i in range(1, cells)]
    found = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(d) for d, c in ordinals.items()]).first()
    bounds = [np.array(found[d] or [], dtype=np.int64) for d in dimensions]

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        grid = []
        for values, bound in zip(columns, bounds):
            cell = np.searchsorted(np.unique(bound), values.fillna(0).to_numpy(np.int64), side="right")
            grid.append(np.where(values.isna().to_numpy(), 0, np.minimum(cell, cells - 1)))
        return pd.Series(curve_index(np.stack(grid, axis=1), bits))

    return rows.withColumn("curve", place(*ordinals.values()))


def measured(docs: DataFrame) -> DataFrame:
    """The narrow row of each document: metadata, size and checksum, without the text."""
    data = F.encode(plain_text(), "utf-8")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang"),
        F.col("source"),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
    )


def assign(docs: DataFrame, shards: int = 24, dimensions=DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Shard and slot of each document; columns doc_id, size, text_crc32, law, shard, slot,
    grown_shard (null under this law), curve."""
    spark = docs.sparkSession
    rows = with_curve(stage(measured(docs), "shard-rows"), dimensions, bits)
    order = ["curve", "doc_id", "text_crc32", "size"]
    ordered = stage(
        rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("number", F.monotonically_increasing_id()),
        "shard-order",
    )
    # The number is the partition in its upper bits and the place in it in the lower 33.
    counts = ordered.groupBy(F.shiftright("number", 33).alias("part")).agg(F.count("*").alias("n")).collect()
    starts, total = [], 0
    for row in sorted(counts, key=lambda r: r.part):
        starts.append((row.part, total))
        total += row.n
    offsets = spark.createDataFrame(starts or [(0, 0)], "part long, start long")
    rank = F.col("start") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return (
        ordered.withColumn("part", F.shiftright("number", 33))
        .join(F.broadcast(offsets), "part")  # one row per range partition
        .withColumn("rank", rank)
        .withColumn("shard", F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("rank") - first).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "curve",
        )
    )


def write_shards(docs: DataFrame, folder: str, shards: int = 24, **options) -> DataFrame:
    """Write each shard as one folder of Parquet, rows in slot order; returns the assignment.

    Identifiers must be unique here: the assignment is joined back by them.
    """
    places = stage(assign(docs, shards, **options).select("doc_id", "shard", "slot"), "shard-places")
    placed = docs.join(places.withColumnsRenamed({"shard": "_shard", "slot": "_slot"}), "doc_id")
    (
        placed.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot")
        .withColumnRenamed("_shard", "shard_id").write.partitionBy("shard_id").parquet(folder)
    )
    return places

