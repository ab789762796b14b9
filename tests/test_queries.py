"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    rows, _ = compare(spark, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert rows >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["vocab_count_alpha", "running_avg", "bm25_topk", "nsp_pairs", "auc", "encode_pad"])
def test_result_does_not_depend_on_partitions(spark, name):
    def rows(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            return sorted(map(str, QUERIES[name](spark, FOLDER).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    assert rows(1) == rows(7)


@pytest.mark.parametrize("name, tables", [("stream_chunks", "documents"), ("stream_upserts", "conversations")])
def test_streams_read_tables_in_many_files(spark, tmp_path, name, tables):
    spark.read.parquet(f"{FOLDER}/{tables}.parquet").repartition(3).write.parquet(str(tmp_path / f"{tables}.parquet"))

    def rows(folder):
        return sorted(map(str, QUERIES[name](spark, str(folder)).collect()))

    assert rows(tmp_path) == rows(FOLDER) != []
