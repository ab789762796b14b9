"""An index of inverted lists for cosine search, and batch search by tiles.

Centroids are fitted on a bounded sample; every vector goes to the list of its nearest centroid.
Vectors are stored as tiles: up to ``TILE`` keys and one flat matrix, so that a search multiplies
matrices and a vector is never a row of its own. Queries are gathered into blocks the same way. A
list with many tiles, or one that many queries ask for, is cut into groups of tiles and groups of
blocks; every pair of groups is one key of an equi-join, so no task holds more than one pair.

A search visits the ``probes`` lists nearest to each query; its scores are exact cosines. Exact
search then visits every further list that can still hold one of the best ``k``: no member of a list
is closer to the query than the angle to the centroid less the list's widest angle. ``calibrate``
finds the number of lists for a wanted recall by comparing a bounded sample of the stored vectors
with a search of everything.

Vectors without length have no cosine: they are kept in a list of their own, are never a result and
find nothing; a null or empty vector likewise. Keys that repeat are separate results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.staging import fresh_path, stage

TILE, BLOCK = 1024, 1024
#: Tiles, or blocks, that meet in one task.
GROUP = 16
#: Results of pairs that a task gathers before it keeps the best of each query.
GATHERED = 400_000
#: Angles between queries and centroids that a task holds, and pairs (list, query) it hands on at once.
ANGLES, HANDED = 1_000_000, 20_000
#: Centroids are fitted on at most this many rows per list, of at most so many lists.
SAMPLE_PER_LIST, MOST_LISTS = 40, 4096
ROUNDS = 12
UNUSABLE = -1
WIDE = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """A stored index: tiles (list, keys, cells), lists (list, n, tiles, widest), centroids."""

    tiles: DataFrame
    lists: DataFrame
    centroids: np.ndarray

    @property
    def key_type(self) -> str:
        return self.tiles.schema["keys"].dataType.elementType.simpleString()


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have one, and which rows these are."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    full = np.array([v is not None and len(v) == width > 0 for v in vectors], dtype=bool)
    if not full.any():
        return np.zeros((0, width)), full
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors[full]])
    lengths = np.linalg.norm(rows, axis=1)
    good = np.isfinite(lengths) & (lengths > 0)
    full[np.flatnonzero(full)[~good]] = False
    return rows[good] / lengths[good, None], full


# -- building -------------------------------------------------------------------------------


def _fit(lists: int, seed: int):
    """Spherical k-means over the rows of one task; empty clusters take the worst served rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [_matrix(b["embedding"])[0] for b in batches if len(b)]
        rows = [r for r in rows if len(r)]
        if not rows:
            return
        sample = np.concatenate(rows)
        sample = sample[np.lexsort(sample.T)]  # the order of arrival must not matter
        draw = np.random.default_rng(seed)
        centres = sample[draw.permutation(len(sample))[:lists]]
        for _ in range(ROUNDS):
            scores = sample @ centres.T
            nearest, best = scores.argmax(axis=1), scores.max(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, sample)
            lengths = np.linalg.norm(sums, axis=1)
            empty = np.flatnonzero(lengths == 0)
            sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
            lengths[empty] = 1.0
            centres = sums / lengths[:, None]
        yield pd.DataFrame({"list": range(len(centres)), "centre": list(centres)})

    return run


def fit_centroids(vectors: DataFrame, key: str, lists: int, seed: int = 7) -> np.ndarray:
    """(lists, width) unit vectors, fitted in one task on SAMPLE_PER_LIST rows per list: those with
    the smallest hashes of their key."""
    sample = vectors.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(lists * SAMPLE_PER_LIST).select("embedding")
    found = sample.coalesce(1).mapInPandas(_fit(lists, seed), "list int, centre array<double>")
    return np.array([r.centre for r in sorted(found.collect(), key=lambda r: r.list)])  # the model, not the data


def _tiles_of(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows (list, key, embedding, angle) sorted by list, as tiles."""

    def tile(name: int, held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        cells = np.concatenate([np.asarray(v, dtype=np.float32) for v in rows["embedding"]]) if name != UNUSABLE else None
        return pd.DataFrame(
            {"list": [name], "keys": [rows[key].to_numpy()], "cells": [cells], "widest": [rows["angle"].max()]}
        )

    current, held, n = None, [], 0
    for batch in batches:
        for name, rows in batch.groupby("list", sort=False):
            while len(rows):
                if held and (name != current or n >= TILE):
                    yield tile(current, held)
                    held, n = [], 0
                current = name
                held.append(rows.iloc[: TILE - n])
                n += len(held[-1])
                rows = rows.iloc[len(held[-1]) :]
    if held:
        yield tile(current, held)


def _stored_tiles(assigned: DataFrame, key: str, path: str) -> None:
    kind = assigned.schema[key].dataType.simpleString()
    ordered = assigned.repartitionByRange("list", F.xxhash64(key)).sortWithinPartitions("list", key)
    tiles = ordered.mapInPandas(
        lambda batches: _tiles_of(batches, key), f"list int, keys array<{kind}>, cells array<float>, widest double"
    )
    tiles.write.partitionBy("list").parquet(path)


def build_index(vectors: DataFrame, path: str, key: str = "vec_id", lists: int | None = None, seed: int = 7) -> VectorIndex:
    """Index ``vectors`` (key, embedding) in the folder ``path``, which all executors share.

    Without ``lists`` the square root of the number of rows is taken. A list spans as many files as
    its rows need: rows are range-partitioned by list and hashed key.
    """
    spark, rows = vectors.sparkSession, vectors.select(key, "embedding")
    lists = lists or max(1, min(MOST_LISTS, round(rows.count() ** 0.5)))
    centres = fit_centroids(rows, key, lists, seed)
    shared = spark.sparkContext.broadcast(centres)  # at most MOST_LISTS rows

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit, usable = _matrix(batch["embedding"])
            names, angles = np.full(len(batch), UNUSABLE), np.zeros(len(batch))
            if len(unit):
                scores = unit @ shared.value.T
                names[usable] = scores.argmax(axis=1)
                angles[usable] = np.arccos(np.clip(scores.max(axis=1), -1, 1))
            yield batch.assign(list=names, angle=angles)

    kind = rows.schema[key].dataType.simpleString()
    assigned = stage(rows.mapInPandas(assign, f"{key} {kind}, embedding array<float>, list int, angle double"), "vector-lists")
    _stored_tiles(assigned, key, f"{path}/tiles")
    spark.createDataFrame([(kind,)], "key_type string").coalesce(1).write.parquet(f"{path}/kind")
    stored = _tiles_at(spark, path)
    summary = stored.groupBy("list").agg(
        F.sum(F.size("keys")).alias("n"), F.count("*").alias("tiles"), F.max("widest").alias("widest")
    )
    summary.coalesce(1).write.parquet(f"{path}/lists")
    centroid_rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(centroid_rows, "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return load_index(spark, path)


def _tiles_at(spark: SparkSession, path: str) -> DataFrame:
    kind = spark.read.parquet(f"{path}/kind").first().key_type
    return spark.read.schema(f"keys array<{kind}>, cells array<float>, widest double, list int").parquet(f"{path}/tiles")


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    centres = spark.read.parquet(f"{path}/centroids").collect()
    centres = np.array([r.centre for r in sorted(centres, key=lambda r: r.list)])
    return VectorIndex(_tiles_at(spark, path), spark.read.parquet(f"{path}/lists"), centres)


# -- searching ------------------------------------------------------------------------------


def _groups(count) -> F.Column:
    return F.ceil(count / F.lit(GROUP)).cast("int")


def _query_blocks(asked: DataFrame) -> DataFrame:
    """Stored rows (list, qid, query) as blocks (list, qids, cells, h of blocks_h); hashing keeps
    a block near BLOCK queries, whatever their number."""
    sizes = asked.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("_blocks"))
    number = F.pmod(F.xxhash64("qid"), F.col("_blocks"))
    rows = asked.join(F.broadcast(sizes), "list").withColumn("_block", number)  # a row per list
    gathered = rows.groupBy("list", "_blocks", "_block").agg(F.collect_list(F.struct("qid", "query")).alias("_rows"))
    return gathered.select(
        "list",
        F.transform("_rows", lambda r: r["qid"]).alias("qids"),
        F.flatten(F.transform("_rows", lambda r: r["query"])).alias("queries"),
        _groups(F.col("_blocks")).alias("_hs"),
        F.floor(F.col("_block") / GROUP).cast("int").alias("_h"),
    )


def _best_of_tiles(k: int, key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, gathered = [], 0
            for keys, cells, qids, queries in zip(batch["keys"], batch["cells"], batch["qids"], batch["queries"]):
                rows = np.asarray(cells, dtype=np.float64).reshape(len(keys), -1)
                asked = np.asarray(queries, dtype=np.float64).reshape(len(qids), -1)
                rows = rows / np.linalg.norm(rows, axis=1)[:, None]
                scores = rows @ asked.T  # keys are sorted, so that a stable sort decides ties by key
                order = np.argsort(-np.round(scores, 9), axis=0, kind="stable")[:k]
                found.append(
                    pd.DataFrame({
                        "qid": np.tile(qids, len(order)),
                        key: np.asarray(keys)[order].ravel(),
                        "score": np.take_along_axis(scores, order, axis=0).ravel(),
                    })
                )
                gathered += len(found[-1])
                if gathered > GATHERED:
                    found = [_best_rows(found, k, key)]
                    gathered = len(found[0])
                    if 2 * gathered > GATHERED:  # many queries: the final ranking merges them
                        yield found.pop()
                        gathered = 0
            if found:
                yield _best_rows(found, k, key)

    return run


def _best_rows(found: list[pd.DataFrame], k: int, key: str) -> pd.DataFrame:
    rows = pd.concat(found).assign(_fine=lambda r: r["score"].round(9))
    rows = rows.sort_values(["qid", "_fine", key], ascending=[True, False, True])
    return rows.groupby("qid", sort=False).head(k).drop(columns="_fine")


def _scan(tiles: DataFrame, tile_counts: DataFrame, asked: DataFrame, k: int, key: str, kind: str) -> DataFrame:
    """Best ``k`` per (query, task) of the stored pairs (list, qid, query). ``tile_counts`` has a row per list."""
    blocks = _query_blocks(asked)
    heights = stage(blocks.groupBy("list").agg(F.max("_hs").alias("_hs")), "vector-heights")
    sizes = F.broadcast(tile_counts.select("list", _groups(F.col("tiles")).alias("_gs")))
    wide = blocks.drop("_hs").join(sizes, "list").withColumn("_g", F.explode(F.sequence(F.lit(0), F.col("_gs") - 1))).drop("_gs")
    placed = tiles.select("list", "keys", "cells", F.xxhash64(F.element_at("keys", 1), F.size("keys")).alias("_place"))
    placed = placed.join(sizes, "list").withColumn("_g", F.pmod("_place", F.col("_gs")).cast("int")).drop("_place", "_gs")
    placed = placed.join(F.broadcast(heights), "list").withColumn("_h", F.explode(F.sequence(F.lit(0), F.col("_hs") - 1)))
    pairs = placed.join(wide, ["list", "_g", "_h"]).select("keys", "cells", "qids", "queries")
    return pairs.mapInPandas(_best_of_tiles(k, key), f"qid bigint, {key} {kind}, score double")


def _ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _probe(centres: np.ndarray, spark: SparkSession, choose, out: str):
    """Queries (qid, query, *more) to rows (list, qid, query) by ``choose(angles, more)``, a mask."""
    shared = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit, usable = _matrix(batch["query"])
            rows = batch[usable]
            step = max(1, ANGLES // len(shared.value))
            for low in range(0, len(unit), step):
                some, more = unit[low : low + step], rows.iloc[low : low + step]
                at, names = np.nonzero(choose(np.arccos(np.clip(some @ shared.value.T, -1, 1)), more))
                qids = more["qid"].to_numpy()
                # a query may be open in every list, and each pair carries its vector
                for i in range(0, len(at), HANDED):
                    part = at[i : i + HANDED]
                    yield pd.DataFrame({"list": names[i : i + HANDED], "qid": qids[part], "query": list(some[part])})

    return lambda frame: frame.mapInPandas(run, out)


_ASKED = "list int, qid bigint, query array<double>"


def _nearest_lists(probes: int):
    def choose(angles: np.ndarray, _: pd.DataFrame) -> np.ndarray:
        order = np.argsort(angles, axis=1, kind="stable")[:, :probes]
        wanted = np.zeros(angles.shape, dtype=bool)
        np.put_along_axis(wanted, order, True, axis=1)
        return wanted

    return choose


def search(
    index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, key: str = "vec_id"
) -> DataFrame:
    """The ``k`` nearest of each query (qid, query vector): (qid, rank, key, score).

    With ``exact`` all lists that can hold a better one are visited after the first ``probes``.
    """
    spark = queries.sparkSession
    asked = stage(queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("query").cast("array<double>").alias("query")), "vector-queries")
    if not len(index.centroids):
        return spark.createDataFrame([], f"qid bigint, {key} {index.key_type}, score double, rank int")
    first = stage(_probe(index.centroids, spark, _nearest_lists(probes), _ASKED)(asked), "vector-probes")
    found = stage(_scan(index.tiles, index.lists, first, k, key, index.key_type), "vector-found")
    if not exact or probes >= len(index.centroids):
        return _ranked(found, k, key)
    # The angle of the k-th best so far; a query with fewer results must look everywhere.
    reached = _ranked(found, k, key).groupBy("qid").agg(
        F.when(F.count("*") == k, F.acos(F.least(F.min("score"), F.lit(1.0)))).otherwise(F.lit(np.pi)).alias("reach")
    )
    widest = np.zeros(len(index.centroids))
    for row in index.lists.where(F.col("list") >= 0).collect():  # a row per list
        widest[row.list] = row.widest
    near = _nearest_lists(probes)

    def still_open(angles: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        # WIDE also covers scores that are equal after rounding
        reach = rows["reach"].fillna(np.pi).to_numpy()
        return (angles - widest <= reach[:, None] + WIDE) & ~near(angles, rows)

    rest = stage(_probe(index.centroids, spark, still_open, _ASKED)(asked.join(reached, "qid", "left")), "vector-rest")
    more = stage(_scan(index.tiles, index.lists, rest, k, key, index.key_type), "vector-more")
    return _ranked(found.unionByName(more), k, key)


def search_all(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """Exact search of everything without an index, by the same tiles and blocks: (qid, rank, key, score)."""
    kind = vectors.schema[key].dataType.simpleString()
    path = fresh_path(vectors.sparkSession, "vector-tiles")

    def usable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(list=np.where(_matrix(batch["embedding"])[1], 0, UNUSABLE), angle=0.0)

    rows = vectors.select(key, "embedding").mapInPandas(usable, f"{key} {kind}, embedding array<float>, list int, angle double")
    tiles = rows.sortWithinPartitions("list", key).mapInPandas(
        lambda batches: _tiles_of(batches, key), f"list int, keys array<{kind}>, cells array<float>, widest double"
    )
    tiles.write.parquet(path)
    stored = vectors.sparkSession.read.parquet(path)
    counts = stage(stored.groupBy("list").agg(F.count("*").alias("tiles")), "vector-counts")

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, good = _matrix(batch["query"])
            if len(rows):
                yield pd.DataFrame({"list": 0, "qid": batch["qid"].to_numpy()[good], "query": list(rows)})

    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("query").cast("array<double>").alias("query"))
    found = _scan(stored, counts, stage(asked.mapInPandas(unit, _ASKED), "vector-asked"), k, key, kind)
    return _ranked(found, k, key)


def calibrate(index: VectorIndex, k: int, recall: float = 0.95, sample: int = 256, key: str = "vec_id") -> int:
    """The smallest number of lists that holds the share ``recall`` of the true best ``k``.

    Measured with at most ``sample`` stored vectors as queries: all lists are searched for them, and
    for each result the place of its list in the order of the query's lists is counted.
    """
    spark = index.tiles.sparkSession
    flat = index.tiles.where(F.col("list") >= 0).select("list", F.posexplode("keys").alias("at", key), "cells", F.size("keys").alias("n"))
    width = (F.size("cells") / F.col("n")).cast("int")
    rows = flat.orderBy(F.xxhash64(key, F.lit("calibrate")), key).limit(sample)
    rows = stage(rows.select(F.slice("cells", F.col("at") * width + 1, width).alias("query")).withColumn("qid", F.monotonically_increasing_id()), "vector-sample")
    best = search(index, rows, k, probes=len(index.centroids), key=key)
    homes = index.tiles.where(F.col("list") >= 0).select("list", F.explode("keys").alias(key))
    placed = homes.join(F.broadcast(best.select("qid", key)), key).join(F.broadcast(rows), "qid")  # at most sample * k rows
    shared = spark.sparkContext.broadcast(index.centroids)

    @F.pandas_udf("int")
    def place(home: pd.Series, query: pd.Series) -> pd.Series:
        unit, _ = _matrix(query)
        scores = unit @ shared.value.T
        own = np.take_along_axis(scores, home.to_numpy()[:, None], axis=1)
        return pd.Series((scores > own).sum(axis=1) + 1)

    found = placed.agg(F.percentile(place("list", "query").cast("double"), F.lit(recall)).alias("p")).first().p
    return 1 if found is None else int(np.ceil(found))
