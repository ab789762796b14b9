"""Benchmark decontamination by suffix arrays over the training documents.

Each task cuts its documents into shards and builds a suffix array of the words of every shard.
``report`` and ``clean`` search the suffixes of the benchmark at which a window begins, all at once
by binary search, which gives the range of equal windows; ``longest_matches`` searches every suffix
for its longest verbatim match and its place. Documents with an occurring window are marked, and
``clean`` removes them.

A suffix can only match where its first two words follow each other in a document (its first, if
some item has a single word), so other places are left out of the array: they could not change
any result. The benchmark is taken in blocks of bounded size, each broadcast in turn; all of them
meet all documents. Documents stay where they are: nothing but small results is shuffled.

Defined cases: a null or empty text has no words; an item without words occurs nowhere; an item
shorter than the window is one window; repeated items (equal identifier) count once in n_items;
a null item identifier counts as the empty string; null and repeated document identifiers keep
their rows; empty tables give empty results or clean documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stage, union

WINDOW = 10
#: Words per shard: about 50 MB of working memory.
SHARD_WORDS = 500_000
#: Characters of benchmark text that are broadcast at once.
BLOCK_CHARS = 8_000_000
#: Words of a suffix that the sort compares; longer matches are extended word by word.
DEPTH = 16

# ASCII letters are lower-cased, letters, digits and bytes above 127 stay, the rest separates.
_TRANSLATE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TRANSLATE).split() if text else []


class Benchmark:
    """All suffixes of a block of items, ready for the search in many shards."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        split = [(name, words_of(text)) for name, text in items]
        split = [(name, words) for name, words in split if words]
        self.window = window
        self.names = [name for name, _ in split]
        self.vocabulary: dict[bytes, int] = {}
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] for _, words in split]
        #: Words of documents that no item has.
        self.unknown = len(self.vocabulary) + 1
        self.longest = max(map(len, ids), default=0)
        self.tokens = np.array([w for words in ids for w in [*words, 0]] + [0] * (2 * self.longest + DEPTH), dtype=np.int32)
        lengths = np.array([len(words) for words in ids], dtype=np.int64)
        starts = np.cumsum(np.concatenate([[0], lengths[:-1] + 1])).astype(np.int64) if len(ids) else lengths
        self.item = np.repeat(np.arange(len(ids)), lengths)
        offset = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.offset = offset
        self.place = np.repeat(starts, lengths) + offset
        self.left = np.repeat(lengths, lengths) - offset
        #: Length of the window that begins at a suffix; 0 where none does.
        full = np.repeat(lengths, lengths)
        self.span = np.where(self.left >= window, window, np.where((offset == 0) & (full < window), full, 0))
        self.pairs_only = bool(len(lengths)) and min(window, int(lengths.min())) > 1
        follow = self.tokens[self.place].astype(np.int64) * (self.unknown + 1) + self.tokens[self.place + 1]
        self.pairs = np.unique(follow[self.left > 1])

    def keys(self, places: np.ndarray, depth: int, left: np.ndarray) -> np.ndarray:
        return _keys(self.tokens, places, depth, left)


def _keys(tokens: np.ndarray, places: np.ndarray, depth: int, left: np.ndarray | None = None) -> np.ndarray:
    """The first ``depth`` words at each place as bytes whose order is the order of the words."""
    columns = np.arange(depth)
    matrix = tokens[places[:, None] + columns]
    if left is not None:
        matrix = np.where(columns < left[:, None], matrix, 0)
    ended = np.cumsum(matrix == 0, axis=1) > 0  # nothing counts behind the end of a text
    matrix = np.where(ended, 0, matrix)
    return np.ascontiguousarray(matrix.astype(">u4")).view(f"S{4 * depth}").ravel()


class Shard:
    """Suffix array over the words of some documents."""

    def __init__(self, documents: list[list[bytes]], benchmark: Benchmark, depth: int = DEPTH):
        self.depth = depth
        get, unknown = benchmark.vocabulary.get, benchmark.unknown
        self.lengths = np.array([len(d) for d in documents], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]).astype(np.int64) if documents else self.lengths
        flat: list[int] = []
        for words in documents:
            flat.extend([get(w, unknown) for w in words])
            flat.append(0)
        self.tokens = np.array(flat + [0] * (benchmark.longest + depth), dtype=np.int32)
        body = self.tokens[: len(flat)]
        if benchmark.pairs_only:
            follow = body.astype(np.int64) * (unknown + 1) + self.tokens[1 : len(flat) + 1]
            places = np.flatnonzero((body > 0) & (body < unknown))
            found = np.searchsorted(benchmark.pairs, follow[places])
            found[found == len(benchmark.pairs)] = 0
            places = places[benchmark.pairs[found] == follow[places]] if len(benchmark.pairs) else places[:0]
        else:
            places = np.flatnonzero((body > 0) & (body < unknown))
        keys = _keys(self.tokens, places, depth)
        order = np.argsort(keys, kind="stable")
        self.sorted_keys, self.suffixes = keys[order], places[order]

    def windows(self, benchmark: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of all windows: (place in the shard, suffix of the benchmark)."""
        queries = np.flatnonzero(benchmark.span)
        span = benchmark.span[queries]
        low = np.searchsorted(self.sorted_keys, benchmark.keys(benchmark.place[queries], DEPTH, np.minimum(span, DEPTH)))
        # The first key beyond all that begin with the window.
        cells = benchmark.tokens[benchmark.place[queries][:, None] + np.arange(DEPTH)].astype(np.int64)
        beyond = np.where(np.arange(DEPTH) < span[:, None], cells, 0xFFFFFFFF).astype(">u4")
        high = np.searchsorted(self.sorted_keys, np.ascontiguousarray(beyond).view(f"S{4 * DEPTH}").ravel())
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(queries)), count)
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        places, suffixes = self.suffixes[low[which] + inside], queries[which]
        deep = benchmark.span[suffixes] > DEPTH
        if deep.any():  # a window longer than the keys: compare the rest
            steps = np.arange(int(benchmark.span.max()))
            same = benchmark.tokens[benchmark.place[suffixes][:, None] + steps] == self.tokens[places[:, None] + steps]
            good = (same | (steps >= benchmark.span[suffixes][:, None])).all(axis=1)
            places, suffixes = places[good], suffixes[good]
        return places, suffixes

    def longest(self, benchmark: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """Per suffix of the benchmark: length of its longest match here, and one place of it.

        Needs an array sorted to the depth of the longest item: then the longest match is a
        neighbour of where the suffix would be inserted.
        """
        length = np.zeros(len(benchmark.place), dtype=np.int64)
        where = np.full(len(benchmark.place), -1, dtype=np.int64)
        if not len(self.suffixes) or not len(length):
            return length, where
        steps = np.arange(self.depth)
        mine = np.where(steps < benchmark.left[:, None], benchmark.tokens[benchmark.place[:, None] + steps], -1)
        at = np.searchsorted(self.sorted_keys, benchmark.keys(benchmark.place, self.depth, benchmark.left))
        for shift in (0, -1):
            place = self.suffixes[np.clip(at + shift, 0, len(self.suffixes) - 1)]
            common = np.cumprod(self.tokens[place[:, None] + steps] == mine, axis=1).sum(axis=1)
            better = common > length
            length[better], where[better] = common[better], place[better]
        return length, where

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def mark(documents: list[list[bytes]], benchmark: Benchmark) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """Per document: ranges [start, end) of words hit, merged, and names of the items that occur."""
    ranges: list[list[tuple[int, int]]] = [[] for _ in documents]
    names: list[set[str]] = [set() for _ in documents]
    shard = Shard(documents, benchmark)
    places, suffixes = shard.windows(benchmark)
    if len(places):
        order = np.argsort(places, kind="stable")
        places, suffixes = places[order], suffixes[order]
        in_document = shard.document_of(places)
        starts = places - shard.starts[in_document]
        ends = starts + benchmark.span[suffixes]
        for d, s, e, item in zip(in_document.tolist(), starts.tolist(), ends.tolist(), benchmark.item[suffixes].tolist()):
            mine = ranges[d]
            if mine and s <= mine[-1][1]:
                mine[-1] = (mine[-1][0], max(e, mine[-1][1]))
            else:
                mine.append((s, e))
            names[d].add(benchmark.names[item])
    return ranges, [sorted(n) for n in names]


_MARKED = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("ranges", pa.list_(pa.list_(pa.int64()))),
        ("items", pa.list_(pa.string())),
    ]
)
_MARKED_DDL = "row long, doc_id long, n_words long, ranges array<array<bigint>>, items array<string>"


def _mark_batches(packed, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(packed.value, window)
        for batch in batches:
            rows, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            begin = 0
            while begin < len(rows):
                documents, count, at = [], 0, begin
                while at < len(rows) and count < SHARD_WORDS:
                    documents.append(words_of(texts[at].as_py()))
                    count += len(documents[-1])
                    at += 1
                ranges, names = mark(documents, benchmark)
                columns = [rows[begin:at], ids[begin:at], [len(d) for d in documents], [[list(r) for r in m] for m in ranges], names]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MARKED)], schema=_MARKED)
                begin = at

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks of bounded size, read one by one."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row.name, row.text))
        size += len(row.text or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, ranges of words hit, items that occur.

    One block: a scan without a shuffle. Several: one scan per block, merged per row.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").filter("text IS NOT NULL")
    blocks = _blocks(items)
    first = next(blocks)
    narrow = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long"), F.col("text"))
    second = next(blocks, None)
    if second is None:
        return narrow.mapInArrow(_mark_batches(spark.sparkContext.broadcast(first), window), _MARKED_DDL).drop("row")
    rows = stage(narrow.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")

    def parts() -> Iterator[DataFrame]:
        for block in (first, second):
            yield rows.mapInArrow(_mark_batches(spark.sparkContext.broadcast(block), window), _MARKED_DDL)
        for block in blocks:
            yield rows.mapInArrow(_mark_batches(spark.sparkContext.broadcast(block), window), _MARKED_DDL)

    merged = None
    for part in parts():
        part = stage(part.filter("size(items) > 0").select("row", "ranges", "items"), "decontaminate-block")
        merged = part if merged is None else merged.unionByName(part)
    hits = merged.groupBy("row").agg(
        F.sort_array(F.flatten(F.collect_list("ranges"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.pandas_udf(_join_ranges, "array<array<bigint>>")
    words = rows.mapInArrow(_mark_batches(spark.sparkContext.broadcast([]), window), _MARKED_DDL)
    return words.drop("ranges", "items").join(hits, "row", "left").select(
        "doc_id",
        "n_words",
        joined(F.coalesce("ranges", F.expr("cast(array() as array<array<bigint>>)"))).alias("ranges"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def _join_ranges(column):
    """Sorted ranges, overlapping ones merged."""

    def merge(ranges):
        out: list[list[int]] = []
        for start, end in ranges:
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], int(end))
            else:
                out.append([int(start), int(end)])
        return out

    return column.map(merge)


def _longest_batches(packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(packed.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            begin = 0
            while begin < len(ids):
                documents, count, at = [], 0, begin
                while at < len(ids) and count < SHARD_WORDS:
                    documents.append(words_of(batch.column(1)[at].as_py()))
                    count += len(documents[-1])
                    at += 1
                shard = Shard(documents, benchmark, max(benchmark.longest, 1))
                length, where = shard.longest(benchmark)
                hit = np.flatnonzero(length)
                inside = shard.document_of(where[hit])
                columns = [
                    [benchmark.names[i] for i in benchmark.item[hit].tolist()],
                    benchmark.offset[hit].tolist(),
                    length[hit].tolist(),
                    [ids[begin + i] for i in inside.tolist()],
                    (where[hit] - shard.starts[inside]).tolist(),
                ]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "offset", "length", "doc_id", "at"]
                )
                begin = at

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per suffix of the benchmark (item_id, offset) its longest verbatim match in any document:
    length in words, doc_id and the number of the word at which it begins. Suffixes without a
    match of two words have no row, if all items have two words. Items with equal identifiers
    share their rows."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").filter("text IS NOT NULL")
    parts = []
    for block in _blocks(items):
        packed = docs.sparkSession.sparkContext.broadcast(block)
        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _longest_batches(packed), "item_id string, offset long, length long, doc_id long, at long"
        )
        parts.append(found.groupBy("item_id", "offset").agg(F.max(F.struct("length", -F.col("doc_id"), -F.col("at"))).alias("m")))
    return union(parts).select(
        "item_id", "offset", F.col("m.length").alias("length"), (-F.col("m.col2")).alias("doc_id"), (-F.col("m.col3")).alias("at")
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The counts of each document: doc_id, n_words, n_hit, n_items, items, contaminated."""
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return matches(docs, benchmark, window).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        (F.size("items") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without an occurring window, all columns as they are.

    Each row is decided by its own text where it is read, one pass per block, without a join.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").filter("text IS NOT NULL")
    text = docs.columns.index("text")
    for block in _blocks(items):
        packed = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(_clean_batches(packed, window, text), docs.schema)
    return docs


def _clean_batches(packed, window: int, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(packed.value, window)
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                documents, count, at = [], 0, begin
                while at < batch.num_rows and count < SHARD_WORDS:
                    documents.append(words_of(batch.column(text)[at].as_py()))
                    count += len(documents[-1])
                    at += 1
                _, names = mark(documents, benchmark)
                yield batch.slice(begin, at - begin).filter(pa.array([not n for n in names], pa.bool_()))
                begin = at

    return run
