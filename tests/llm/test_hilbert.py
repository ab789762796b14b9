import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.hilbert_shards import assign, curve_index, write_shards


@pytest.mark.parametrize("d, bits", [(2, 4), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(d, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    index = curve_index(points, bits)
    assert sorted(index) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def law(rows, shards):
    counts = Counter(r.shard for r in rows)
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert all(a.curve <= b.curve for a, b in zip(ordered, ordered[1:]))


def test_documents(documents, pairs):
    rows = assign(documents).collect()
    law(rows, 24)
    text = dict(pairs)
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)


def test_odd_rows(odd, odd_pairs):
    rows = assign(odd).collect()
    law(rows, 24)
    key = lambda d, t: (str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(key(d, t) for d, t in odd_pairs)
    assert assign(odd.limit(0)).count() == 0


def test_files_are_pruned_by_several_dimensions(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    write_shards(docs, str(tmp_path / "shards"), 24, dimensions=("lang", "source"))
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert written.count() == docs.count()
    for column, value in (("lang", "es"), ("source", "src7")):
        spans = written.groupBy("shard_id").agg(F.min(column).alias("low"), F.max(column).alias("high")).collect()
        assert len(spans) == 24
        assert sum(r.low <= value <= r.high for r in spans) < 18
