"""Repeated passages removed by super-k-mer partitioning of word windows.

Every run of WINDOW consecutive words is a window; the minimiser of a window is the smallest hash
of the M-word sequences in it. Consecutive windows that share their minimiser travel as one packed
string, the super-k-mer, to the bucket of that minimiser; equal windows have equal minimisers, so
they meet there. In the bucket the windows are sorted by hash, identifier and place, equal hashes
are compared byte by byte, and each window but the earliest of its kind is marked.

Two tables of fixed size decide how super-k-mers travel, never what is found:

* A minimiser that occurs once cannot belong to a repeated window. A first pass counts minimisers;
  those that occur again set a bit in a broadcast bit map, and only super-k-mers with a set bit are
  packed and sent. Where the map fills up, more are sent and nothing is lost.
* A minimiser with more than CROWD super-k-mers sets a bit in a second map. Its windows are sent
  one by one and grouped by their whole text: equal ones are merged in each task before they move,
  so a passage of a third of all documents is a few rows, and the edges of such passages, which
  differ from document to document, spread over all tasks.

Defined cases: a null text has no words; documents shorter than a window keep all words; documents
are ordered by identifier, a null one first; rows that agree in identifier and text are one
document, each gets the same result; rows that share only the identifier are ordered by a hash of
their text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import attach, stage, union

WINDOW = 20
#: Words of the sequences among which the minimiser is chosen.
M = 6
#: Super-k-mers of a minimiser that one task may hold at once, some 20 MB.
CROWD = 100_000
#: Bits of the maps: 16 MB each.
MAP_BITS = 27
_CHUNK_BITS = 15
#: Bytes of packed strings compared at once.
COMPARED = 2 << 20

_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE_BITS = 24


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


class Cut:
    """Some texts cut into words and super-k-mers, all at once.

    ``joined`` has the words in order, one space after each; word i is at ``start[i]:end[i]`` of
    it. Super-k-mer k begins at word ``first[k]``, which is word ``number[k]`` of text ``text[k]``,
    and has ``count[k]`` windows with the minimiser ``minimiser[k]``.
    """

    def __init__(self, texts: list[bytes], window: int, m: int):
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        space = _SPACE[data]
        before = np.concatenate([[True], space[:-1]])
        begins = np.flatnonzero(~space & before)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        joined = data[~(space & before)].copy()
        breaks = _SPACE[joined]
        joined[breaks] = 32
        self.joined = joined.tobytes()
        self.end = np.flatnonzero(breaks)
        self.start = np.concatenate([[0], self.end + 1])[:-1]
        of_text = np.searchsorted(bounds, begins, side="right")
        self.words = len(begins)
        self.first = self.number = self.count = self.text = np.empty(0, dtype=np.int64)
        self.minimiser = np.empty(0, dtype=np.int64)
        windows = self.words - window + 1
        if windows < 1:
            return
        sums = np.zeros(len(joined) + 1, dtype=np.uint64)
        np.cumsum((joined + np.uint64(1)) * _power("up", _R, len(joined)), out=sums[1:])
        one = _mixed((sums[self.end] - sums[self.start]) * _power("down", _R_INVERSE, len(joined))[self.start])
        sequence = one[: len(one) - m + 1].copy()
        for j in range(1, m):
            sequence *= np.uint64(_R)
            sequence += one[j : len(one) - m + 1 + j]
        _mixed(sequence)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        placed = (sequence & ~low) | np.arange(len(sequence), dtype=np.uint64)  # the leftmost of equal ones
        place = (_rolling_min(placed, window - m + 1) & low).astype(np.int64)
        valid = of_text[:windows] == of_text[window - 1 :]
        new = np.ones(windows, dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | ~valid[:-1] | (of_text[1:windows] != of_text[: windows - 1])
        heads = np.flatnonzero(new & valid)
        ends = np.append(np.flatnonzero(new | ~valid), windows)
        self.first = heads
        self.count = ends[np.searchsorted(ends, heads, side="right")] - heads
        self.text = of_text[heads]
        first_word = np.searchsorted(of_text, np.arange(len(texts)))
        self.number = heads - first_word[self.text]
        self.minimiser = sequence[place[heads]].view(np.int64)


#: Bytes of text that are cut at once; a longer text goes in pieces that overlap by a window.
PIECE = 1 << 20
_GAP = re.compile(rb"[\t-\r ]")


def cut_pieces(keys: list, texts: list[bytes | None], window: int, m: int) -> Iterator[tuple[list, np.ndarray, Cut]]:
    """(keys, number of the first word, cut) of texts by PIECE bytes, in order."""
    some, names, size = [], [], 0
    for key, text in zip(keys, texts):
        if text is not None and len(text) > PIECE:
            for offset, cut in _pieces(text, window, m):
                yield [key], np.array([offset]), cut
        elif text:
            some.append(text)
            names.append(key)
            size += len(text)
            if size > PIECE:
                yield names, np.zeros(len(some), dtype=np.int64), Cut(some, window, m)
                some, names, size = [], [], 0
    if some:
        yield names, np.zeros(len(some), dtype=np.int64), Cut(some, window, m)


def _pieces(text: bytes, window: int, m: int) -> Iterator[tuple[int, Cut]]:
    """(number of the first word, cut) of the pieces of one text. Each takes whole words that no
    piece before had, at least as many bytes as the words it repeats: every text comes to its end,
    in time linear in its length."""
    carried, offset, at = b"", 0, 0
    while at < len(text):
        gap = _GAP.search(text, at + max(PIECE, len(carried)))
        end = gap.start() if gap else len(text)
        cut = Cut([carried + text[at:end]], window, m)
        yield offset, cut
        kept = min(cut.words, window - 1)
        carried = cut.joined[cut.start[cut.words - kept] :] if kept else b""
        offset += cut.words - kept
        at = end


def _minimisers(window: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, cut in cut_pieces([None] * batch.num_rows, batch.column(0).to_pylist(), window, m):
                values, counts = np.unique(cut.minimiser, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], names=["h", "n"])

    return run


def _slot(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _bit_map(rows: DataFrame) -> np.ndarray:
    """Bits of the slots in ``rows`` (column slot); made in chunks by the tasks. At most
    2**(MAP_BITS - 3) bytes reach the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column(0).to_numpy()
            numbers = slots >> _CHUNK_BITS
            order = np.argsort(numbers, kind="stable")
            slots, numbers = slots[order], numbers[order]
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(slots)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin < end:
                    bits = chunks.setdefault(int(numbers[begin]), np.zeros(1 << _CHUNK_BITS, dtype=bool))
                    bits[slots[begin:end] & ((1 << _CHUNK_BITS) - 1)] = True
        for number, bits in chunks.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["chunk", "bits"]
            )

    dealt = rows.repartition(F.shiftright("slot", _CHUNK_BITS))
    out = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    size = 1 << (_CHUNK_BITS - 3)
    for row in dealt.mapInArrow(run, "chunk long, bits binary").collect():
        out[row.chunk * size : (row.chunk + 1) * size] |= np.frombuffer(row.bits, dtype=np.uint8)
    return out


def _set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = _slot(h)
    return (bits[slot >> 3] >> (7 - (slot & 7))) & 1 == 1


_PACKED = "h long, doc long, version long, start int, crowded boolean, packed binary"


def _pack(repeated, crowded, window: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats, crowds = np.frombuffer(repeated.value, dtype=np.uint8), np.frombuffer(crowded.value, dtype=np.uint8)
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for names, offset, cut in cut_pieces(keys, batch.column(2).to_pylist(), window, m):
                sent = np.flatnonzero(_set(repeats, cut.minimiser))
                if not len(sent):
                    continue
                # Single windows of a crowded minimiser, else all its windows in one string.
                many = _set(crowds, cut.minimiser[sent])
                times = np.where(many, cut.count[sent], 1)
                which = np.repeat(sent, times)
                step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                first = cut.first[which] + step
                last = first + window - 1 + np.where(np.repeat(many, times), 0, cut.count[which] - 1)
                joined = cut.joined
                packed = [joined[a:b] for a, b in zip(cut.start[first].tolist(), cut.end[last].tolist())]
                doc, version = (np.array([n[i] for n in names], dtype=np.int64)[cut.text[which]] for i in (0, 1))
                start = (cut.number[which] + step + offset[cut.text[which]]).astype(np.int32)
                columns = [cut.minimiser[which], doc, version, start, np.repeat(many, times)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(packed, pa.binary())],
                    names=["h", "doc", "version", "start", "crowded", "packed"],
                )

    return run


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, size: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64."""
    if name not in _powers or len(_powers[name]) < size:
        column = np.full(size, base, dtype=np.uint64)
        column[0] = 1
        _powers[name] = np.cumprod(column, dtype=np.uint64)
    return _powers[name][:size]


def later_windows(doc, version, start, packed: list[bytes], window: int = WINDOW):
    """Mark windows that have an equal, earlier one among the packed strings of whole buckets.

    Returns (row, first marked word, end) of merged runs: word numbers in the document.
    """
    buffer = b"\n".join(packed)
    data = np.frombuffer(buffer, dtype=np.uint8)
    breaks = np.flatnonzero((data == 32) | (data == 10))
    ends = np.append(breaks, len(data))
    starts = np.concatenate([[0], breaks + 1])
    last = np.append(data[breaks] == 10, True)
    row_of_word = np.concatenate([[0], np.cumsum(last)[:-1]])
    words_in_row = np.bincount(row_of_word, minlength=len(packed))
    first_word = np.cumsum(words_in_row) - words_in_row
    windows = np.maximum(words_in_row - window + 1, 0)
    row = np.repeat(np.arange(len(packed)), windows)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    word = first_word[row] + inside
    begin, end = starts[word], ends[word + window - 1]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _R, len(data)), out=sums[1:])
    value = (sums[end] - sums[begin]) * _power("down", _R_INVERSE, len(data) + 1)[begin]
    place = start[row] + inside
    order = np.lexsort((place, version[row], doc[row], value))
    value, sorted_row, sorted_place = value[order], row[order], place[order]
    same = np.concatenate([[False], value[1:] == value[:-1]])
    owner = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = np.flatnonzero(same)
    b, e = begin[order], end[order]
    equal = np.fromiter(
        (buffer[p:q] == buffer[s:t] for p, q, s, t in zip(b[later].tolist(), e[later].tolist(), b[owner[later]].tolist(), e[owner[later]].tolist())),
        dtype=bool, count=len(later),
    )
    if not equal.all():  # different windows under one hash: find the owners by content
        for head in np.unique(owner[later[~equal]]).tolist():
            seen: dict[bytes, int] = {}
            for i in later[owner[later] == head].tolist():
                seen.setdefault(buffer[b[head] : e[head]], head)
                owner[i] = seen.setdefault(buffer[b[i] : e[i]], i)
    own = owner[later]
    twin = (sorted_row[own] == sorted_row[later]) & (own == later)
    r, o = sorted_row[later], sorted_row[own]
    twin |= (doc[r] == doc[o]) & (version[r] == version[o]) & (sorted_place[later] == sorted_place[own])
    marked = later[~twin]
    r, p = sorted_row[marked], sorted_place[marked]
    order = np.lexsort((p, r))
    r, p = r[order], p[order]
    cut = np.flatnonzero((r[1:] != r[:-1]) | (p[1:] > p[:-1] + window)) + 1
    heads = np.concatenate([[0], cut]).astype(np.int64)[: len(r)]
    tails = np.append(cut - 1, len(r) - 1).astype(np.int64) if len(r) else heads
    return r[heads], p[heads], p[tails] + window


_SPANS = "doc long, version long, begin int, end int"


def _bucket(window: int):
    """Rows sorted by minimiser; whole buckets are compared, several small ones at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, key = 0, None
        for batch in batches:
            h = batch.column(0).to_numpy()
            if not len(h):
                continue
            column = batch.column(4)
            weight = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(h) + 1].astype(np.int64)
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1  # buckets are whole at these rows
            if held and h[0] != key:
                cuts = np.concatenate([[0], cuts])
            at = 0
            while len(cuts):
                # As many whole buckets as fit, one at least.
                room = np.searchsorted(weight[cuts], weight[at] + COMPARED - size, side="right")
                if room == len(cuts) and weight[-1] - weight[at] + size <= COMPARED:
                    break
                cut = int(cuts[max(room, 1) - 1])
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                if held:
                    yield _compare(held)
                held, size, at = [], 0, cut
                cuts = cuts[max(room, 1) :]
            if at < len(h):
                held.append(batch.slice(at))
                size += int(weight[-1] - weight[at])
            key = h[-1]
        if held:
            yield _compare(held)

    def _compare(held):
        whole = pa.Table.from_batches(held)
        doc, version, start = (whole.column(i).to_numpy() for i in (1, 2, 3))
        row, begin, end = later_windows(doc, version, start.astype(np.int64), whole.column(4).to_pylist(), window)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(version[row]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))],
            names=["doc", "version", "begin", "end"],
        )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc orders the documents, version tells texts under one identifier apart."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64("text").alias("version"),
        "text",
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW, m: int = M) -> DataFrame:
    """Spans of words [begin, end) covered by windows that occur earlier: doc, version, begin, end.
    Spans of one document may overlap; rows that are one document repeat theirs."""
    spark = docs.sparkSession
    counts = docs.select(F.encode("text", "utf-8")).mapInArrow(_minimisers(window, m), "h long, n long")
    counts = counts.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    slot = F.shiftrightunsigned("h", 64 - MAP_BITS).alias("slot")
    counts = stage(counts.select(slot, (F.col("n") > CROWD).alias("crowded")), "minimisers")
    repeated = _bit_map(counts.select("slot").distinct())
    crowded = _bit_map(counts.filter("crowded").select("slot").distinct())
    share = spark.sparkContext.broadcast
    packed = _keyed(docs).select("doc", "version", F.encode("text", "utf-8")).mapInArrow(
        _pack(share(repeated.tobytes()), share(crowded.tobytes()), window, m), _PACKED
    )
    if crowded.any():
        packed = stage(packed, "super-kmers")
    cold = packed.filter("NOT crowded").drop("crowded").repartition("h").sortWithinPartitions("h")
    spans = [cold.mapInArrow(_bucket(window), _SPANS)]
    if crowded.any():
        spans.append(_crowded_spans(packed.filter("crowded"), window))
    return union(spans)


def _crowded_spans(single: DataFrame, window: int) -> DataFrame:
    """The same for windows sent one by one: the earliest of equal ones by a merging aggregation."""
    single = single.select("packed", "doc", "version", "start")
    earliest = single.groupBy("packed").agg(
        F.min(F.struct("doc", "version", "start")).alias("earliest"), F.count("*").alias("n")
    )
    earliest = stage(earliest.filter("n > 1"), "crowded-windows")
    later = F.struct("doc", "version", "start") > F.col("earliest")
    return attach(single, earliest, ["packed"], "n", single.count(), "inner").filter(later).select(
        "doc", "version", F.col("start").alias("begin"), (F.col("start") + window).cast("int").alias("end")
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            total, gone, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                if not spans.is_valid:
                    total.append(len(words))
                    gone.append(0)
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                    continue
                mask = np.zeros(len(words) + 1, dtype=np.int64)
                for span in spans.as_py():
                    mask[span["begin"]] += 1
                    mask[span["end"]] -= 1
                covered = np.cumsum(mask)[:-1] > 0
                total.append(len(words))
                gone.append(int(covered.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~covered).tolist()]).decode("utf-8", "surrogatepass"))
            columns = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, m: int = M) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay joined by one space, per row."""
    spans = repeated_spans(docs, window, m)
    per_document = spans.groupBy("doc", "version").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = _keyed(docs).join(per_document, ["doc", "version"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")
