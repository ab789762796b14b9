from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup as E
from corpusloom.llm.common import fresh_path


def weak(text):
    return F.encode((F.length(text) % 5).cast("string"), "utf-8")


def decided(docs, digest=E.sha256):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in E.deduplicate(docs, digest).collect())


def test_full_bytes_take_collisions_apart(documents, pairs):
    want, groups = [], {}
    for d, t in pairs:
        groups.setdefault(t, []).append(d)
    for ids in groups.values():
        want += [(str(d), str(max(ids)), len(ids), d == max(ids)) for d in ids]
    assert decided(documents) == sorted(want)
    assert decided(documents, weak) == sorted(want)


def test_state_goes_on_with_new_arrivals(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    more = spark.createDataFrame([(9, "b"), (0, "a")], "doc_id long, text string")
    arrivals, checkpoint = E.store_arrivals(docs), fresh_path(spark, "state-test")
    first = {r.keep.doc_id: r.n for r in E.stream_state(spark, arrivals, checkpoint, 2).collect()}
    assert first == {2: 2, 3: 1}
    spark.read.parquet(E.store_arrivals(more)).write.mode("append").parquet(arrivals)
    assert {r.keep.doc_id: r.n for r in E.stream_state(spark, arrivals, checkpoint, 2).collect()} == {2: 3, 9: 2}


def test_odd_rows(odd):
    rows = decided(odd)
    assert rows == sorted(
        [("1", "2", 3, False), ("2", "2", 3, True), ("2", "2", 3, False), ("3", "3", 2, True), ("None", "3", 2, False)]
        + [("4", "5", 3, False), ("5", "5", 3, True), ("5", "5", 3, False)]
        + [(x, x, 1, True) for x in "789"]
    )
    assert decided(odd, weak) == rows
    kept = E.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 7, 8, 9]
    assert E.deduplicate(odd.limit(0)).count() == 0 and E.keep_one(odd.limit(0)).count() == 0


def test_clashing_columns_stay(odd):
    named = odd.selectExpr("*", "1 AS _key", "2 AS _text_digest", "3 AS _id", "4 AS _digest")
    kept = E.keep_one(named)
    assert kept.columns == named.columns and kept.where("_key = 1 AND _text_digest = 2 AND _id = 3 AND _digest = 4").count() == 6
