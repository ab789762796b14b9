from threading import Thread

import pytest

from corpusloom.operators import keyed_table as K
from corpusloom.staging import fresh_path

SCHEMA = "id bigint, content string"


@pytest.fixture
def path(spark):
    path = fresh_path(spark, "keyed")
    K.create(spark, path, SCHEMA, "id", buckets=16)
    return path


def rows(spark, path):
    return sorted((str(r.id), r.content) for r in K.read(spark, path).collect())


def batch(spark, values):
    return spark.createDataFrame(values, "id bigint, content string, v int")


def test_last_row_of_a_key_wins(spark, path):
    K.upsert(spark, path, batch(spark, [(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "d", 1), (None, "n", 1)]), ["v"])
    assert rows(spark, path) == [("1", "b"), ("2", "d"), ("None", "n")]
    K.upsert(spark, path, batch(spark, [(2, "e", 0), (3, "f", 0), (None, "m", 0)]), ["v"])
    assert rows(spark, path) == [("1", "b"), ("2", "e"), ("3", "f"), ("None", "m")]
    found = K.read_keys(spark, path, spark.createDataFrame([(3,), (None,), (9,)], "id bigint"))
    assert sorted(r.content for r in found.collect()) == ["f", "m"]
    with pytest.raises(K.VersionTaken):
        K.create(spark, path, SCHEMA, "id")


def test_only_touched_buckets_are_written(spark, path):
    first = K.upsert(spark, path, spark.range(500).selectExpr("id", "'x' AS content", "0 AS v"), ["v"])
    second = K.upsert(spark, path, batch(spark, [(7, "y", 0)]), ["v"])
    changed = [b for b in first.folders if first.folders[b] != second.folders[b]]
    assert len(first.folders) == 16 and len(changed) == 1
    assert dict(rows(spark, path))["7"] == "y" and len(rows(spark, path)) == 500
    K.drop_old_data(spark, path)
    assert len(rows(spark, path)) == 500 and K.current(spark, path).number == 2
    assert K.upsert(spark, path, batch(spark, []), ["v"]).number == 2


@pytest.mark.parametrize("other", [7, 8])
def test_a_writer_in_between(spark, path, monkeypatch, other):
    """Another upsert, of the same key or of another bucket, ends while this one is about to claim."""
    K.upsert(spark, path, spark.range(20).selectExpr("id", "'x' AS content", "0 AS v"), ["v"])
    claim, seen = K._claim, []

    def late(spark, path, version):
        if not seen:
            seen.append(version.number)
            K.upsert(spark, path, batch(spark, [(other, "other", 0)]), ["v"])
        claim(spark, path, version)

    monkeypatch.setattr(K, "_claim", late)
    assert K.upsert(spark, path, batch(spark, [(7, "mine", 0)]), ["v"]).number == 3
    found = dict(rows(spark, path))
    assert found["7"] == "mine" and found["8"] == ("other" if other == 8 else "x") and len(found) == 20


def test_writers_at_once(spark, path):
    threads = [Thread(target=K.upsert, args=(spark, path, batch(spark, [(i, f"t{i}", 0), (99, f"t{i}", 0)]), ["v"])) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = dict(rows(spark, path))
    assert {k for k in found} == {"0", "1", "2", "3", "4", "99"} and found["99"] in {f"t{i}" for i in range(5)}
    assert K.current(spark, path).number == 5
