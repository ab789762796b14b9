"""Global order without a global task: positions, running totals, splits and batches.

A window without partitions would send every row to one task, and a window over one hot key
nearly so. Here rows are range-partitioned by the order key (equal groups are split where they
are large), each partition numbers its own rows, and one small row per partition carries the
totals of the rows before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.chance import draw
from corpusloom.staging import stage

PART, LOCAL = "_part", "_local"


def place(df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """Range-partition and sort by a total order; keep partition and place as columns.

    Without ``parts`` small neighbouring partitions are merged at run time, which keeps their order.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    slot = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    placed = ranged.sortWithinPartitions(*keys).withColumn(LOCAL, slot)
    placed = placed.withColumn(PART, F.shiftright(LOCAL, 33)).withColumn(
        LOCAL, F.col(LOCAL).bitwiseAND(F.lit((1 << 33) - 1))
    )
    return stage(placed, "placed")


def with_position(
    df: DataFrame, order: Sequence[str | Column], out: str = "position", parts: int | None = None
) -> DataFrame:
    """Add the 1-based position of each row in the total order ``order``."""
    placed = place(df, order, parts)
    sizes = placed.groupBy(PART).agg((F.max(LOCAL) + 1).alias("_n"))
    # one row per range partition: the only unpartitioned window, bounded by their number
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), PART)
        .withColumn(out, F.col(LOCAL) + F.col("_before") + 1)
        .drop(PART, LOCAL, "_before")
    )


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    totals: Mapping[str, str],
    by: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Running sums (current row included) of ``totals`` {output: input} within groups ``by``.

    ``order`` must be total within a group. A group may span many partitions: only the first
    group of a partition can continue an earlier one, so at most one carry row per partition
    is broadcast.
    """
    placed = place(df, [*by, *order], parts)
    groups = [PART, *by]
    local = Window.partitionBy(*groups).orderBy(LOCAL).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select(
        "*", *[F.sum(source).over(local).alias(out) for out, source in totals.items()]
    )
    sums = placed.groupBy(*groups).agg(
        *[F.coalesce(F.sum(source), F.lit(0)).alias(f"_c_{out}") for out, source in totals.items()]
    )
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(PART)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        *groups,
        F.count(F.lit(1)).over(earlier).alias("_seen"),
        *[F.sum(f"_c_{out}").over(earlier).alias(f"_c_{out}") for out in totals],
    ).where("_seen > 0")
    joined = inside.join(F.broadcast(carry), groups, "left")
    for out in totals:
        joined = joined.withColumn(out, F.col(out) + F.coalesce(F.col(f"_c_{out}"), F.lit(0)))
    return joined.drop(PART, LOCAL, "_seen", *[f"_c_{out}" for out in totals])


def positional_split(df: DataFrame, order: Sequence[str], rate: float, out: str = "is_train") -> DataFrame:
    """First ``int(n * rate)`` rows train, the rest evaluate; no shuffling."""
    numbered = with_position(df, order, "_position")
    cut = int(numbered.count() * rate)
    return numbered.withColumn(out, F.col("_position") <= cut).drop("_position")


def shuffled_position(df: DataFrame, key: str, seed: int, out: str = "position") -> DataFrame:
    """Position in a repeatable random order (drawn from the key, ties by key)."""
    drawn = df.withColumn("_draw", draw(seed, F.col(key)))
    return with_position(drawn, ["_draw", key], out).drop("_draw")


def full_batches(df: DataFrame, key: str, batch: int, seed: int) -> DataFrame:
    """Shuffled batches of exactly ``batch`` rows; the incomplete last one is dropped."""
    numbered = shuffled_position(df, key, seed, "_position")
    cut = numbered.count() // batch * batch
    return (
        numbered.where(F.col("_position") <= cut)
        .withColumn("batch", F.floor((F.col("_position") - 1) / batch))
        .withColumn("slot", (F.col("_position") - 1) % batch)
        .drop("_position")
    )
