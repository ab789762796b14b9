"""How five document filters interact: what each removes in every order they may run in.

Row-local filters (word count, repeated words, capitals, symbols) are column expressions. The fifth
asks whether the same text occurs under a smaller identifier anywhere in the table. A counting
Bloom sketch goes before it: every task counts the hashes of its texts in pages of saturating
counters, the pages are merged by addition, and a text that meets a counter of one is the only one
of its kind. Only the others, the possible repeats, are shuffled, by hash and full text, merged in
each task first, to find the smallest identifier of every text. The flags of a row become one mask;
counts per part and mask are additive, so all orders are read off at most 32 counts a part.

The sketch has 8 counters of two bits per row, rounded up to a power of two, and at most
``MOST_COUNTERS`` (64 MB), the bound of what is broadcast. Beyond 34 million rows it fills up:
fewer unique texts are cleared and more are shuffled, up to all texts once; results stay the same.

Defined cases: a null text counts as empty, a null part as the empty string; a row without
identifier is never a repeat and makes none; rows that repeat an identifier with its text are not
repeats of each other (none is smaller), but all are if a smaller identifier has the text; a text
without words passes the filter of repeated words; of several labels of a document any that says
good or toxic counts; labels of unknown documents are ignored; an empty table has no parts and gives
no rows; other columns are ignored, also those named as the columns made here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import attach, plain_text, stage

SPACE = r"[\x20\x09-\x0D]+"
PROBES = 3
COUNTERS_PER_ROW = 8
LEAST_COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 28
#: Counters of a page; a counter holds 0, 1 or 2 and more.
PAGE = 1 << 15


def row_filters(text: Column, words: Column) -> dict[str, Column]:
    """True where the filter removes the text. ``words`` is its array of words."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": capitals * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def xxhash(text: Column) -> Column:
    return F.xxhash64(text)


def measured(docs: DataFrame, part: str, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, part, mask of the row-local filters, h and text of each document."""
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        plain_text().alias("text"),
    ).withColumn("words", words)
    flags = row_filters(F.col("text"), F.col("words")).values()
    mask = sum((f.cast("int") * (1 << bit) for bit, f in enumerate(flags)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), digest(F.col("text")).alias("h"), "text")


def _counters(h: np.ndarray, size: int) -> np.ndarray:
    """(PROBES, n) places of the hashes among ``size`` counters, a power of two."""
    mixed = h.astype(np.int64).view(np.uint64)
    start, step = mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((start + probes * step) & np.uint64(size - 1)).astype(np.int64)


def _task_pages(size: int):
    """Count the hashes of one task: rows (page, places, counts), counts cut to two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = _counters(batch.column(0).to_numpy(zero_copy_only=False), size).ravel()
            if not len(places):
                continue
            places, counts = np.unique(places, return_counts=True)
            pages = places // PAGE
            cuts = np.flatnonzero(np.diff(pages)) + 1
            inside = np.split((places % PAGE).astype(np.uint16), cuts)
            counted = np.split(np.minimum(counts, 2).astype(np.uint8), cuts)
            first = pages[np.concatenate([[0], cuts])]
            yield pa.record_batch(
                [pa.array(first), pa.array([p.tobytes() for p in inside]), pa.array([c.tobytes() for c in counted])],
                names=["page", "places", "counts"],
            )

    return count


def _merge_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the sketches of all tasks; rows come sorted by page, one page is held at a time."""

    def packed(number: int, counters: np.ndarray) -> pa.RecordBatch:
        fours = counters.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)
        data = np.bitwise_or.reduce(fours, axis=1).astype(np.uint8).tobytes()
        return pa.record_batch([pa.array([number]), pa.array([data])], names=["page", "counters"])

    current, counters = None, None
    for batch in batches:
        for page, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if page != current:
                if counters is not None:
                    yield packed(current, counters)
                current, counters = page, np.zeros(PAGE, dtype=np.uint8)
            at = np.frombuffer(places, dtype=np.uint16)
            counters[at] = np.minimum(counters[at] + np.frombuffer(counts, dtype=np.uint8), 2)
    if counters is not None:
        yield packed(current, counters)


def sketch(rows: DataFrame, total: int) -> tuple[int, dict[int, bytes]]:
    """The merged counting sketch of the column ``h``: number of counters and packed pages."""
    size = LEAST_COUNTERS
    while size < min(total * COUNTERS_PER_ROW, MOST_COUNTERS):
        size *= 2
    partial = rows.select("h").mapInArrow(_task_pages(size), "page long, places binary, counts binary")
    merged = (
        partial.repartition("page").sortWithinPartitions("page")
        .mapInArrow(_merge_pages, "page long, counters binary")
    )
    return size, {r.page: bytes(r.counters) for r in merged.toLocalIterator()}  # at most MOST_COUNTERS / 4 bytes


def may_repeat(rows: DataFrame, total: int) -> Callable[[Column], Column]:
    """A condition on hashes: false only for texts that occur once."""
    size, pages = sketch(rows, total)
    shared = rows.sparkSession.sparkContext.broadcast(pages)
    memory: dict[str, np.ndarray] = {}

    @F.pandas_udf("boolean")
    def repeated(h: pd.Series) -> pd.Series:
        if "counters" not in memory:
            packed = np.zeros(size // 4, dtype=np.uint8)
            for page, data in shared.value.items():
                packed[page * PAGE // 4 : (page + 1) * PAGE // 4] = np.frombuffer(data, dtype=np.uint8)
            memory["counters"] = packed
        places = _counters(h.to_numpy(), size)
        counts = memory["counters"][places >> 2] >> (2 * (places & 3)).astype(np.uint8) & 3
        return pd.Series((counts > 1).all(axis=0))

    return repeated


def with_repeats(docs: DataFrame, part: str = "lang", digest: Callable[[Column], Column] = xxhash) -> DataFrame:
    """doc_id, part and mask of every row, the last bit set where a smaller identifier has the text."""
    texts = measured(docs, part, digest)
    bit = 1 << len(row_filters(F.lit(""), F.array()))
    rows = stage(texts.drop("text"), "audit-rows")
    total = rows.count()
    possible = texts.select("doc_id", "h", "text").where(may_repeat(rows, total)("h"))
    classes = possible.groupBy("h", "text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).drop("text")
    groups = stage(
        classes.groupBy("h").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("first").alias("first")),
        "audit-groups",
    )
    groups = groups.where("n > 1")
    # A hash that several texts share is decided on the texts themselves.
    shared = groups.where("texts > 1").select("h", "n")
    if shared.isEmpty():
        return _flagged(attach(rows, groups, ["h"], "n", total), bit)
    mixed = stage(attach(texts, shared, ["h"], "n", total, "left_semi"), "audit-mixed")
    apart = stage(
        mixed.groupBy("h", "text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "audit-apart"
    )
    alone = attach(rows, groups.where("texts = 1"), ["h"], "n", total).join(shared.select("h"), "h", "left_anti")
    return _flagged(alone, bit).unionByName(_flagged(attach(mixed, apart, ["h", "text"], "n", total), bit))


def _flagged(rows: DataFrame, bit: int) -> DataFrame:
    repeat = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return rows.select("doc_id", "part", (F.col("mask") + F.when(repeat, bit).otherwise(0)).alias("mask"))


def mask_counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask): rows, rows labelled good, rows labelled toxic."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    ).where("good = 1 OR toxic = 1")
    # Merged first, so that rows that share an identifier, or have none, are few where they meet.
    merged = flagged.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    return merged.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def every_order(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from the counts per part and mask."""
    bits = {letter: 1 << i for i, letter in enumerate(letters)}
    orders = ["".join(p) for p in permutations(letters)]
    steps = [(o, i + 1, sum(bits[x] for x in o[:i]), bits[o[i]]) for o in orders for i in range(len(o))]
    literal = F.arrays_zip(*[F.lit([s[i] for s in steps]).alias(n) for i, n in enumerate(("o", "i", "before", "own"))])
    # At most 2 ** len(letters) masks a part.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.inline(literal).alias("filter_order", "step", "before", "own"))
    before, own = F.col("before"), F.col("own")

    def summed(field: str, where: Callable[[Column], Column], share: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
        def add(total: Column, c: Column) -> Column:
            return total + F.when(where(c["mask"]), c[field] * share(c["mask"])).otherwise(0)

        return F.aggregate("masks", F.lit(0).cast("long"), add)

    fails = lambda m: m.bitwiseAND(own) != 0
    earlier = lambda m: m.bitwiseAND(before) != 0
    # Of the filters that a row fails, each comes first in an equal share of all orders.
    first = lambda m: F.expr(f"{len(orders)}L") / F.bit_count(m)
    return rows.select(
        "part", "filter_order", "step",
        summed("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        summed("n", lambda m: fails(m) & ~earlier(m)).alias("removed"),
        summed("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        summed("n", lambda m: m == own).alias("unique_fails"),
        summed("good", lambda m: fails(m) & ~earlier(m)).alias("good_lost"),
        summed("toxic", lambda m: fails(m) & ~earlier(m)).alias("toxic_lost"),
        summed("n", fails, lambda m: first(m).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", digest: Callable[[Column], Column] = xxhash) -> DataFrame:
    """What each filter removes, keeps and costs in every order, per value of ``part``."""
    return every_order(mask_counts(with_repeats(docs, part, digest), labels))
