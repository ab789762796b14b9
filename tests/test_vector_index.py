import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import vector_index as I
from corpusloom.staging import fresh_path


def plainly(rows, queries, k):
    out = []
    for qid, q in queries:
        scored = [(-round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 9), key) for key, v in rows if np.linalg.norm(v) > 0]
        out += [(qid, rank, key) for rank, (_, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(frame):
    return sorted((r.qid, r["rank"], r.vec_id) for r in frame.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    """Clusters of unequal size, one of them a third of all rows of equal vectors; a zero, a null."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    rows = [(i, centres[i % 12] + 0.15 * draw.normal(size=16)) for i in range(800)]
    rows += [(i, centres[3]) for i in range(800, 1200)] + [(1200, np.zeros(16))]
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame([*data, (1201, None)], "vec_id bigint, embedding array<float>").repartition(5)
    return frame, data, [(i, data[i][1]) for i in range(0, 1200, 50)]


def asked(spark, queries):
    return spark.createDataFrame(queries, "qid int, query array<float>")


@pytest.fixture(scope="module", params=[(1024, 1024, 16), (7, 3, 2)])
def sizes(request):
    """Also tiles, blocks and groups so small that every list and query set has many."""
    before = I.TILE, I.BLOCK, I.GROUP
    I.TILE, I.BLOCK, I.GROUP = request.param
    yield request.param
    I.TILE, I.BLOCK, I.GROUP = before


def test_exact_ways(spark, clustered, sizes):
    frame, data, queries = clustered
    want = plainly(data, queries, 6)
    assert found(I.search_all(frame, asked(spark, queries), 6)) == want
    index = I.build_index(frame, fresh_path(spark, "index"), lists=12)
    assert found(I.search(index, asked(spark, queries), 6, probes=12)) == want
    assert found(I.search(index, asked(spark, queries), 6, probes=1, exact=True)) == want
    # more results than a list holds: the bound must not end the search
    assert found(I.search(index, asked(spark, queries[:2]), 700, probes=1, exact=True)) == plainly(data, queries[:2], 700)


def test_every_vector_is_stored_once(spark, clustered, sizes):
    frame, data, _ = clustered
    path = fresh_path(spark, "index")
    I.build_index(frame, path, lists=10)
    index = I.load_index(spark, path)
    keys = [k for r in index.tiles.collect() for k in r["keys"]]
    assert sorted(keys) == list(range(1202))
    assert max(len(r["keys"]) for r in index.tiles.collect()) <= sizes[0]
    assert {r["keys"][0] for r in index.tiles.where(F.col("list") == I.UNUSABLE).collect()} <= {1200, 1201}


def test_recall_of_calibrated_search(spark, clustered):
    frame, data, queries = clustered
    index = I.build_index(frame, fresh_path(spark, "index"), lists=12)
    probes = I.calibrate(index, 6)
    got, want = found(I.search(index, asked(spark, queries), 6, probes)), plainly(data, queries, 6)
    assert probes < 12 and len({(q, k) for q, _, k in got} & {(q, k) for q, _, k in want}) >= 0.9 * len(want)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_recall_on_the_given_vectors(spark, scale):
    vectors = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet")
    queries = vectors.where("vec_id % 50 = 0").selectExpr("vec_id AS qid", "embedding AS query")
    index = I.build_index(vectors, fresh_path(spark, "index"))
    got = {(q, k) for q, _, k in found(I.search(index, queries, 10, I.calibrate(index, 10)))}
    want = {(q, k) for q, _, k in found(I.search_all(vectors, queries, 10))}
    assert len(got & want) >= 0.9 * len(want)


def test_empty_sides(spark, clustered):
    frame, _, queries = clustered
    none = frame.limit(0)
    assert found(I.search_all(none, asked(spark, queries), 3)) == []
    assert found(I.search_all(frame, asked(spark, []), 3)) == []
    assert found(I.search(I.build_index(none, fresh_path(spark, "index")), asked(spark, queries), 3)) == []
    index = I.build_index(frame, fresh_path(spark, "index"), lists=4)
    odd = asked(spark, [(1, [0.0] * 16), (2, None), (3, [])])
    assert found(I.search(index, odd, 3, exact=True)) == []


def test_text_keys(spark, clustered):
    frame, data, queries = clustered
    named = frame.withColumn("vec_id", F.format_string("v%05d", "vec_id"))
    index = I.build_index(named, fresh_path(spark, "index"), lists=5)
    want = [(q, r, f"v{k:05d}") for q, r, k in plainly(data, queries, 3)]
    assert found(I.search(index, asked(spark, queries), 3, probes=2, exact=True)) == want


def test_a_task_gathers_a_bounded_number_of_results(monkeypatch):
    """Many pairs of one batch: what is held stays bounded, and nothing better is lost."""
    draw = np.random.default_rng(3)
    tiles = [(np.arange(i * 20, i * 20 + 20), draw.normal(size=(20, 4)).astype(np.float32)) for i in range(60)]
    asked = draw.normal(size=(5, 4))
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    pairs = pd.DataFrame([{"keys": k, "cells": c.ravel(), "qids": np.arange(5), "queries": asked.ravel()} for k, c in tiles])
    want = pd.concat(I._best_of_tiles(3, "vec_id")(iter([pairs]))).reset_index(drop=True)
    held, plain = [], I._best_rows
    monkeypatch.setattr(I, "GATHERED", 100)
    monkeypatch.setattr(I, "_best_rows", lambda found, k, key: held.append(sum(map(len, found))) or plain(found, k, key))
    got = pd.concat(I._best_of_tiles(3, "vec_id")(iter([pairs]))).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)
    assert len(held) > 5 and max(held) <= 115


def test_a_probing_task_hands_on_bounded_pieces(spark):
    """Queries that are open in every list: each pair once, with the vector of its query."""

    class Frame:
        def mapInPandas(self, run, _):
            return run

    draw = np.random.default_rng(3)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(draw.normal(size=(n, 4)))
    centres, vectors = unit(40), unit(3000)
    run = I._probe(centres, spark, lambda angles, rows: np.ones(angles.shape, bool), "")(Frame())
    parts = list(run(iter([pd.DataFrame({"qid": range(3000), "query": list(vectors)})])))
    assert max(map(len, parts)) <= 20_000 and sum(map(len, parts)) == 120_000
    pairs = pd.concat(parts)
    assert len(pairs[["list", "qid"]].drop_duplicates()) == 120_000
    assert np.allclose(np.stack(pairs["query"]), vectors[pairs["qid"]])
