"""Merkle manifest of a table: a digest per row, trees of eight, proofs of inclusion.

The leaves of a language, in the order of the identifiers, are cut into aligned blocks of 512 (three
levels of eight). A block keeps each of its levels as one string of hex digests of fixed width:
substrings of eight digests are hashed to the parents, and the digests left and right of a node in
its run are two substrings as well. The tops of the blocks are nodes of a tree of the same form, and
so on up to one node per language; the nodes of the languages make one more tree. Proofs come down
the same way: the siblings of a block's top are attached to the block, those inside are cut out of
its strings. Everything is a column expression; a group of any size is spread over its blocks.

Leaves: SHA-256 (lower-case hex) of doc_id, source, lang, n_chars and text, each ``-`` if null, else
its UTF-8 byte count, a colon and the value. A node: SHA-256 of its children's digests joined.

Defined cases: null values are part of the leaf; a null lang is a group of its own, before all
others; null identifiers come first in their group; rows that share an identifier are ordered by
leaf, so equal rows may change places but nothing else; empty texts and very long ones are hashed
whole; a group with one row is its own subroot, a table with one group has that subroot as root; an
empty table gives an empty result; other columns are ignored, also those named as the columns made
here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stage
from corpusloom.operators.ordering import LOCAL, PART, place
from corpusloom.staging import hinted

FAN = 8
SPAN = 3
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Up to so many (partition, group) offsets are broadcast, beyond they are joined by a shuffle.
OFFSETS = 100_000

_PATH = "array<struct<left:string,right:string>>"


def node_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: dict[str, Column]) -> Column:
    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return node_hash(*[told(fields[name]) for name in FIELDS])


def leaves(docs: DataFrame, tampered: Column, change: Column) -> DataFrame:
    """doc_id, grp, leaf, and for rows that ``tampered`` selects the leaf with ``change`` as text."""
    fields = {name: F.col(name) for name in FIELDS}
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        # in the order of the values, a null one first
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("grp"),
        leaf(fields).alias("leaf"),
        F.when(tampered, leaf({**fields, "text": change})).alias("changed"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 in the order within ``grp``, and ``size`` of the group."""
    placed = place(rows, ["grp", *order])
    pieces = placed.groupBy(PART, "grp").agg(F.min(LOCAL).alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy("grp")
    before = F.sum("_n").over(group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.select(
        PART, "grp", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("size")
    )
    joined = placed.join(hinted(stage(starts, "merkle-starts"), OFFSETS), [PART, "grp"])
    return joined.withColumn("pos", F.col(LOCAL) + F.col("_shift")).drop(PART, LOCAL, "_shift")


def _level(j: int) -> str:
    return f"level{j}"


def blocks(nodes: DataFrame) -> DataFrame:
    """Gather (grp, pos, size, node, item) into aligned blocks with a string per level."""
    width = FAN**SPAN
    members = F.sort_array(F.collect_list(F.struct("pos", "node", "item")))
    rows = nodes.groupBy("grp", "size", F.floor(F.col("pos") / width).alias("block")).agg(members.alias("members"))
    rows = rows.select(
        "grp", "size", "block", F.transform("members", lambda m: m["item"]).alias("items"),
        F.array_join(F.transform("members", lambda m: m["node"]), "").alias(_level(0)),
    )
    for j in range(SPAN):
        below, run = F.col(_level(j)), FAN * DIGEST
        starts = F.sequence(F.lit(1), F.length(below), F.lit(run))
        parents = F.array_join(F.transform(starts, lambda at: node_hash(F.substring(below, at, F.lit(run)))), "")  # noqa: B023
        rows = rows.withColumn(_level(j + 1), F.when(F.col("size") > FAN**j, parents).otherwise(below))
    return rows


def _siblings(j: int) -> Column:
    """The digests left and right of the node of ``place`` in its run of level j; none at the top."""
    at = F.floor(F.col("place") / FAN**j)
    first = F.floor(at / FAN) * FAN
    digests = F.col(_level(j))

    def cut(start: Column, count: Column) -> Column:
        return F.substring(digests, (start * DIGEST + 1).cast("int"), (count * DIGEST).cast("int"))

    pair = F.struct(cut(first, at - first).alias("left"), cut(at + 1, first + (FAN - 1) - at).alias("right"))
    return F.when(F.col("size") > FAN**j, F.array(pair)).otherwise(F.array().cast(_PATH))


def grow(nodes: DataFrame) -> list[DataFrame]:
    """Stored blocks of all heights; the last holds only groups that end there."""
    heights = []
    while True:
        found = stage(blocks(nodes), "merkle-blocks")
        heights.append(found)
        more = found.where(F.col("size") > FAN**SPAN)
        if more.isEmpty():
            return heights
        nodes = more.select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("size") / FAN**SPAN).alias("size"),
            F.col(_level(SPAN)).alias("node"), F.lit(None).cast("boolean").alias("item"),
        )


def tops(heights: list[DataFrame]) -> DataFrame:
    """(grp, top) of every group."""
    ends = [h.where(F.col("size") <= FAN**SPAN).select("grp", F.col(_level(SPAN)).alias("top")) for h in heights]
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    return found


def descend(heights: list[DataFrame], outer: DataFrame | None = None) -> DataFrame:
    """(grp, item, node, path, top, root) of every node of the lowest height.

    ``path`` lists (left, right) from the node up to the top of its group, then to the root;
    ``outer`` holds (grp, path, root) of the tops. A group ends in one block, so it meets its row
    of ``outer`` once, however many nodes it has.
    """
    above = None
    for found in reversed(heights):
        ends = found.where(F.col("size") <= FAN**SPAN).withColumn("top", F.col(_level(SPAN)))
        if outer is None:
            ends = ends.withColumn("up", F.array().cast(_PATH)).withColumn("root", F.col("top"))
        else:
            ends = ends.join(outer.select("grp", F.col("path").alias("up"), "root"), "grp")
        if above is not None:
            higher = above.select("grp", F.col("pos").alias("block"), "top", F.col("path").alias("up"), "root")
            ends = ends.unionByName(found.where(F.col("size") > FAN**SPAN).join(higher, ["grp", "block"]))
        levels = [_level(j) for j in range(SPAN)]
        members = ends.select("grp", "size", "block", "top", "up", "root", *levels, F.posexplode("items").alias("place", "item"))
        above = members.select(
            "grp", "item", "top", "root",
            (F.col("block") * FAN**SPAN + F.col("place")).alias("pos"),
            F.substring(F.col(_level(0)), F.col("place") * DIGEST + 1, F.lit(DIGEST)).alias("node"),
            F.concat(*[_siblings(j) for j in range(SPAN)], F.col("up")).alias("path"),
        )
    return above.drop("pos")


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a digest and its siblings."""
    return F.aggregate(path, start, lambda digest, step: node_hash(step["left"], digest, step["right"]))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def lower_az(text: str = "text") -> Column:
    return F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def every_third() -> Column:
    """Where 3 divides the CRC-32 of the decimal identifier."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0


def manifest(docs: DataFrame, tampered: Column | None = None, change: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path, folded_root and verified of every row.

    The path and the roots are those of ``docs``; ``folded_root`` follows the path from the leaf of
    the row as it is found now: with ``change`` as text where ``tampered`` holds.
    """
    tampered = F.lit(False) if tampered is None else tampered
    change = F.col("text") if change is None else change
    rows = numbered(stage(leaves(docs, tampered, change), "merkle-leaves"), ["doc_id", "leaf"])
    heights = grow(rows.select("grp", "pos", "size", F.col("leaf").alias("node"), F.struct("doc_id", "changed").alias("item")))
    groups = tops(heights).select(F.lit("").alias("grp"), F.col("grp").alias("item"), F.col("top").alias("node"))
    roots = grow(numbered(groups, ["item"]))
    outer = stage(descend(roots).select(F.col("item").alias("grp"), "path", "root"), "merkle-roots")
    found = descend(heights, outer)
    folded = fold(F.coalesce("item.changed", "node"), F.col("path")).alias("folded_root")
    return found.select("item.doc_id", F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", "path", folded).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
