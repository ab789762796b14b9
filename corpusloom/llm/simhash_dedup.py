"""Near-duplicates by SimHash fingerprints that meet at the anchor points of a covering code.

Fingerprint: 64 bits over the XXH64 values of all word shingles. Two fingerprints are linked when
at most LINK = 4 bits differ. The 64 bits are cut into three blocks, so that linked fingerprints
differ in at most one bit of some block. In a block the anchors are the words of a covering code:
the Hamming code of length 15, which covers all points within radius 1, joined with the free bits
that remain. A fingerprint is replicated to every anchor within covering radius plus threshold,
that is within two bits on the coded part and one on the whole block beyond the nearest anchor;
two fingerprints that differ in at most one bit of the block meet at the anchor next to either.

At an anchor, linked fingerprints are found by expanding components: each reached fingerprint is
compared only with those not reached yet, and every member points to the smallest of its
component. So a group of near copies costs rows in proportion to its members, never all pairs. An
anchor with more members than one task should hold is compared in tiles, each pair of tiles in a
task of its own. The components of all anchors are then joined by rounds of min-label joins.

Copies share a fingerprint and are one row from the first step on. Components and links stay in
Spark; nothing grows on the driver.

Defined cases: null and empty texts have no words and fingerprint zero, linked like any other;
repeated rows and null identifiers keep their rows in ``components`` (a null identifier is never a
component id while the component has another); ``keep_one`` decides row by row, by identifier and
text, so one row of every component stays whatever its identifiers; an empty table gives an empty
result; extra columns are ignored by ``components`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import attach, free_name, plain_text, stage, union
from corpusloom.llm.exact_dedup import sha256

SHINGLE = 4
LINK = 4
#: Bits of the three blocks; 15 of each are coded.
BLOCKS = (21, 21, 22)
CODED = 15
#: Members of an anchor that one task compares; more are compared in tiles of this size.
TILE = 20_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as an unsigned integer: a bit is set if set in over half the hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = []
    at = -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - shingle]]]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :])])
    count = len(hashes) // 8
    bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(count, 64)
    whole = count // 255 * 255
    ones = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:  # sums of 255 rows fit a byte, which is the fast way
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; with ``digest`` also the SHA-256 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", "digest"][: batch.num_columns]
            )

    told = [sha256(plain_text()).alias("digest")] if digest else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *told).mapInArrow(
        run, "doc_id long, fp long" + ", digest binary" * digest
    )


@lru_cache(None)
def _syndromes() -> np.ndarray:
    """Syndrome of each 15-bit word: the exclusive or of the numbers (1 to 15) of its set bits.
    Zero on code words; else the number of the one bit to flip for the nearest code word."""
    words = np.arange(1 << CODED)
    out = np.zeros(1 << CODED, dtype=np.int64)
    for bit in range(CODED):
        out ^= np.where((words >> bit) & 1, bit + 1, 0)
    return out


def _near_codewords(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code words within two bits of each 15-bit word: (n, 8) values, -1 where there is none, the
    first the nearest. A word off the code has one at distance 1 and seven at distance 2."""
    syndrome = _syndromes()[word]
    nearest = np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome - 1, 0)), word)
    out = np.full((len(word), 8), -1, dtype=np.int64)
    out[:, 0] = nearest
    filled = np.ones(len(word), dtype=np.int64)
    for low in range(1, CODED + 1):  # flip bits low and high with low ^ high = syndrome
        high = syndrome ^ low
        pair = (syndrome > 0) & (high > low)
        rows = np.flatnonzero(pair)
        out[rows, filled[rows]] = word[rows] ^ (1 << (low - 1)) ^ (1 << (high[rows] - 1))
        filled[rows] += 1
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for every anchor that each fingerprint goes to.

    An anchor is a code word and the free bits of a block. A point goes to the anchors of all
    points within one bit of it in the block, its own included: that is its nearest code word
    with the free bits, those with one free bit flipped, and the code words within two bits.
    """
    values = fps.astype(np.int64).view(np.uint64)
    index, found = [], []
    shift = 0
    everyone = np.arange(len(values))
    for number, width in enumerate(BLOCKS):
        block = ((values >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        shift += width
        coded, free = block & ((1 << CODED) - 1), block >> CODED
        words = _near_codewords(coded)
        parts = [(everyone, words[:, 0], free ^ (1 << b)) for b in range(width - CODED)]
        for column in range(words.shape[1]):
            rows = np.flatnonzero(words[:, column] >= 0)
            parts.append((rows, words[rows, column], free[rows]))
        for rows, word, rest in parts:
            index.append(rows)
            found.append((number << 32) | (rest << CODED) | word)
    return np.concatenate(index), np.concatenate(found)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for begin in range(0, len(fps), 50_000):
            part = fps[begin : begin + 50_000]
            index, found = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[index])], names=["anchor", "fp"])


def bucket_links(fps: np.ndarray, most: int = LINK) -> tuple[np.ndarray, np.ndarray]:
    """Links from members to the smallest member of their component among ``fps``, those of single
    members left out. Each reached member is compared with the unreached only."""
    left = np.unique(fps)
    out_from, out_to = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = np.array([root])
        while len(frontier) and len(left):
            # Tiles of frontier by unreached members, of bounded size.
            step = max(1, 4_000_000 // len(left))
            head, frontier = frontier[:step], frontier[step:]
            near = (np.bitwise_count((head[:, None] ^ left[None, :]).view(np.uint64)) <= most).any(axis=0)
            if near.any():
                reached, left = left[near], left[~near]
                out_from.append(reached)
                out_to.append(np.full(len(reached), root))
                frontier = np.concatenate([frontier, reached])
    if not out_from:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_from), np.concatenate(out_to)


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket (columns 0 to k-1, then fp): links of each bucket."""

    def links(key, fps):
        first, second = bucket_links(fps)
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])

    open_key, open_parts = None, []
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(key)]
        firsts, seconds = [], []
        for begin, end in zip(bounds, bounds[1:]):
            if open_key is not None and key[begin] != open_key:
                group = np.concatenate(open_parts)
                if len(group) > 1:
                    a, b = bucket_links(group)
                    firsts.append(a)
                    seconds.append(b)
                open_parts = []
            open_key = key[begin]
            open_parts.append(fps[begin:end])
        if firsts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(firsts), pa.int64()), pa.array(np.concatenate(seconds), pa.int64())], names=["a", "b"]
            )
    if open_parts:
        yield links(open_key, np.concatenate(open_parts))


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b), b the smaller, that join all linked fingerprints of ``distinct`` (column fp)."""
    members = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    members = stage(members, "simhash-anchors")
    loads = members.groupBy("anchor").agg(F.count("*").alias("n"))
    full = stage(loads.filter(F.col("n") > tile).select("anchor", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "simhash-full")
    if full.isEmpty():
        keyed = members.select(F.col("anchor").alias("bucket"), "fp")
    else:
        # At most (number of members / tile) anchors are full.
        crowded = members.join(full, "anchor")
        mine = F.pmod(F.xxhash64("fp"), F.col("tiles"))
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("tiles") - 1),
            lambda other: F.xxhash64("anchor", F.least(other, mine.cast("int")), F.greatest(other, mine.cast("int"))),
        )
        keyed = union(
            [
                members.join(full, "anchor", "left_anti").select(F.col("anchor").alias("bucket"), "fp"),
                crowded.select(F.explode(F.array_distinct(pairs)).alias("bucket"), "fp"),
            ]
        )
    found = keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_batches, "a long, b long")
    return found.distinct()


def label_components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for the nodes of ``edges`` (a, b; b < a).

    Rounds of two steps on stored tables: each node links its larger neighbours to the smallest of
    its neighbourhood, then its smaller ones; long chains halve in every round. Minima are merged
    in each task before they move; the join of a node with very many links is split by the
    adaptive skew join. A round costs three jobs over the links only.
    """
    edges, mark = stage(edges, "component-edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = stage(larger.distinct(), "component-stars")
        least = stars.groupBy("a").agg(F.min("b").alias("m"))
        smaller = stars.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(smaller.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "component-edges")
        before, mark = mark, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _members(rows: DataFrame) -> DataFrame:
    """fp, first, n and root of the distinct fingerprints of the stored ``rows``: smallest identifier,
    number of rows, smallest fingerprint of the component."""
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    roots = label_components(links(distinct))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return stage(member, "simhash-members")


def components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id of the component, per row of ``docs``."""
    rows = stage(fingerprints(docs, shingle), "simhash-rows")
    member = _members(rows)
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    smallest = stage(smallest, "simhash-components")
    classes = attach(member, smallest, ["root"], "size", member.count(), "inner").select("fp", "n", "component_id")
    return attach(rows, stage(classes, "simhash-classes"), ["fp"], "n", rows.count(), "inner").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per component, all columns as they are: the smallest identifier, a null
    one last, and of several texts under it the one of the smallest digest."""
    rows = stage(fingerprints(docs, digest=True), "simhash-rows")
    labelled = attach(rows, _members(rows).select("fp", "n", "root"), ["fp"], "n", rows.count(), "inner")
    labelled = stage(labelled.select("doc_id", "digest", "root"), "simhash-labelled")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    best = labelled.groupBy("root").agg(F.min(name).alias("best"), F.count("*").alias("size")).filter("size > 1")
    best = stage(best, "simhash-best")
    decided = attach(labelled, best, ["root"], "size", labelled.count(), "inner").groupBy("doc_id", "digest").agg(
        F.max(name.eqNullSafe(F.col("best"))).alias("kept"), F.count("*").alias("n")
    )
    decided = decided.filter("NOT kept OR n > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "kept")
    decided = stage(decided, "simhash-decided")
    key, text_digest = free_name(docs, "_key"), free_name(docs, "_text_digest")
    named = docs.withColumns({key: F.col("doc_id").cast("long"), text_digest: sha256(plain_text())})

    def those(frame: DataFrame, found: DataFrame, how: str) -> DataFrame:
        same = frame[key].eqNullSafe(found["_id"]) & (frame[text_digest] == found["_digest"])
        return frame.join(found, same, how)

    # Rows that agree in identifier and text are told apart by nothing: any one of them stays.
    repeated = decided.filter("kept")
    found = those(named, decided, "left_anti")
    if not repeated.isEmpty():
        found = found.unionByName(those(named, repeated, "left_semi").dropDuplicates([key, text_digest]))
    return found.drop(key, text_digest)
