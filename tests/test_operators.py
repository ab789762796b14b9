"""Ordering, metrics, tables, sources and composition."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import composition as P
from corpusloom.operators import metrics as M
from corpusloom.operators import ordering as O
from corpusloom.operators import tables as B
from corpusloom.sources import readers as R
from corpusloom.sources import writers as W


def test_positions_and_running_totals_with_a_hot_group(spark):
    """One group holds most rows and spans many partitions."""
    rows = [("hot" if i % 5 else f"g{i % 3}", i, i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(6)
    placed = O.with_position(df, ["g", "i"], parts=9).collect()
    assert [(r.g, r.i) for r in sorted(placed, key=lambda r: r.position)] == sorted((g, i) for g, i, _ in rows)
    totals = O.running_totals(df, ["i"], {"s": "v"}, by=["g"], parts=9).collect()
    sums = {}
    expected = {}
    for g, i, v in sorted(rows):
        sums[g] = sums.get(g, 0) + v
        expected[g, i] = sums[g]
    assert {(r.g, r.i): r.s for r in totals} == expected


def test_batches_and_split(spark):
    df = spark.range(103)
    batches = O.full_batches(df, "id", 10, 3).collect()
    assert len(batches) == 100 and {r.slot for r in batches} == set(range(10))
    split = O.positional_split(df, ["id"], 0.8).collect()
    assert {r.id for r in split if r.is_train} == set(range(82))


def test_metrics_without_hits_and_without_rows(spark):
    schema = "p int, t int"
    none = M.binary_metrics(spark.createDataFrame([(0, 1), (0, 0)], schema), "p", "t").first()
    assert (none.accuracy, none.precision, none.recall, none.f_score) == (0.5, 0, 0, 0)
    empty = M.binary_metrics(spark.createDataFrame([], schema), "p", "t").first()
    assert (empty.accuracy, empty.precision, empty.recall, empty.f_score) == (0, 0, 0, 0)
    scored = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, t int")
    assert M.auc(scored, "s", "t").first().auc == pytest.approx((1 + 2 + 1.5) / 6)


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "id int, v int, x string"
    B.upsert_table(spark, path, spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], schema), "id", ["v"])
    B.upsert_table(spark, path, spark.createDataFrame([(1, 1, "new"), (3, 1, "d")], schema), "id", ["v"])
    assert {r.id: r.x for r in B.read_table(spark, path).collect()} == {1: "new", 2: "c", 3: "d"}
    assert B.table_count(spark, str(tmp_path / "none")) == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("s1\ns2\n\n\ns3\n")
    (tmp_path / "docs" / "b.txt").write_text("s4\n\ns5")
    rows = R.blank_separated_documents(spark, str(tmp_path / "docs")).orderBy("line_no").collect()
    assert [(r.doc, r.sentence) for r in rows] == [(0, "s1"), (0, "s2"), (2, "s3"), (2, "s4"), (3, "s5")]
    (tmp_path / "v.txt").write_text("<S>\nx\n!!!MAXTERMID\nx\n")
    assert {r.token: r.id for r in R.vocabulary_file(spark, str(tmp_path / "v.txt")).collect()}["x"] == 3
    assert {r.token: r.id for r in R.lm_vocabulary_file(spark, str(tmp_path / "v.txt")).collect()} == {"<S>": 0, "x": 2}
    (tmp_path / "s.txt").write_text("one\ttwo\nthree\tfour\n")
    assert [(r.t1, r.t2) for r in R.sentence_pairs(spark, str(tmp_path / "s.txt")).orderBy("line_no").collect()] == [("one", "two"), ("three", "four")]
    assert sorted(r.token for r in R.stop_words(spark, str(tmp_path / "s.txt")).collect()) == ["one\ttwo", "three\tfour"]
    with pytest.raises(FileNotFoundError):
        R.json_folder(spark, str(tmp_path / "docs"))


def test_json_sources(spark, tmp_path):
    page = {"page_index": 0, "text": "T", "tables": [{"preamble": "p", "table": "|a|", "line_start": 0, "line_end": 1}]}
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "one.json").write_text(json.dumps({"document": {"title": "t"}, "pages": [page]}, indent=2))
    row = R.page_documents(spark, str(tmp_path / "*" / "*.json")).first()
    assert (row.doc_id, row.title, row.text, row.tables[0].table) == ("one", "t", "T", "|a|")
    (tmp_path / "c.json").write_text(json.dumps([{"doc_id": "d", "content": "x", "page": 1, "metadata": {"k": "v"}}], indent=4))
    chunk = R.flat_chunks(spark, str(tmp_path / "c.json")).first()
    assert (chunk.doc_id, chunk.page, chunk.metadata) == ("d", 1, {"k": "v"})
    (tmp_path / "f.bin").write_bytes(b"p1|p2")
    pages = R.binary_pages(spark, str(tmp_path), lambda data: data.decode().split("|"), "*.bin").collect()
    assert [(p.page_index, p.text) for p in pages] == [(0, "p1"), (1, "p2")]


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, t string")
    W.markdown(docs, str(tmp_path / "md"), "k", "t")
    assert sorted(r.k for r in spark.read.text(str(tmp_path / "md")).collect()) == ["a", "b"]
    W.chunk_lists(docs, str(tmp_path / "chunks"), "k")
    assert spark.read.json(str(tmp_path / "chunks")).count() == 2
    W.keyed_json(docs, "k", F.col("t"), str(tmp_path / "pred"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "pred")).collect()) == ['{"a":"x"}', '{"b":"y"}']
    W.vocabulary(docs.select(F.col("t").alias("token"), F.lit(1).alias("id")), str(tmp_path / "vocab"))
    assert spark.read.parquet(str(tmp_path / "vocab")).count() == 2


def test_composition(spark):
    df = spark.range(3)
    add = P.assign(x=F.col("id") + 1)
    both = P.sequence(P.sequence(add, P.pick("x")), P.parallel(y=F.col("x") * 2))
    assert len(both.steps) == 3 and [r.y for r in df.transform(both).collect()] == [2, 4, 6]
    with pytest.raises(ValueError):
        P.sequence(add)
    choose = P.alternatives("a", a=add, b=P.pick("id"))
    assert df.transform(choose("b")).columns == ["id"] and df.transform(choose()).columns == ["id", "x"]
    seen = []
    df.transform(P.with_listeners(add, on_start=lambda d: seen.append("s"), on_end=lambda d: seen.append("e")))
    assert seen == ["s", "e"]
    assert df.transform(P.with_fallbacks(P.pick("nope"), P.pick("id"))).columns == ["id"]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert P.with_retry(flaky, pause=0.0)() == 7
    limited = P.bind(lambda df, n: df.limit(n), n=2)
    assert df.transform(limited).count() == 2


def test_staged_tables_are_deleted_on_request(spark, monkeypatch):
    from corpusloom import staging

    monkeypatch.setattr(staging, "_written", [])
    kept = staging.stage(spark.range(3), "t")
    assert kept.count() == 3
    path = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    staging.clear(spark)
    import os

    assert not os.path.exists(path)


def test_streamed_upserts_survive_repeats(spark, tmp_path):
    from corpusloom.streaming import flows

    schema = "id int, v int, x string"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = ([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], [(2, 1, "new"), (3, 1, "d")])
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = flows.file_stream(spark, source, schema)
        flows.to_upserts(stream, out, "id", ["v"], state).awaitTermination()
    found = {r.id: r.x for r in flows.current_rows(spark, out, "id", ["v"]).collect()}
    assert found == {1: "b", 2: "new", 3: "d"}
    merged = str(tmp_path / "merged")
    assert flows.compact(spark, out, merged, "id", ["v"]) == 2 and flows.compact(spark, out, merged, "id", ["v"]) == 0
    assert {r.id: r.x for r in flows.current_rows(spark, out, "id", ["v"], merged).collect()} == found
    spark.createDataFrame([(1, 0, "later"), (4, 1, "e")], schema).coalesce(1).write.mode("append").parquet(source)
    stream = flows.file_stream(spark, source, schema)
    flows.to_upserts(stream, out, "id", ["v"], state).awaitTermination()
    want = {**found, 1: "later", 4: "e"}
    assert {r.id: r.x for r in flows.current_rows(spark, out, "id", ["v"], merged).collect()} == want
    assert flows.compact(spark, out, merged, "id", ["v"]) == 1
    assert {r.id: r.x for r in flows.current_rows(spark, out, "id", ["v"], merged).collect()} == want


def test_upserts_are_versions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id int, v int, x string"
    B.ingest(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema), path)
    before = B.read_table(spark, path)
    B.upsert_table(spark, path, spark.createDataFrame([(2, 2, "c")], schema), "id", ["v"])
    assert {r.id: r.x for r in before.collect()} == {1: "a", 2: "b"}  # a reader keeps its version
    B.upsert_table(spark, path, spark.createDataFrame([(3, 1, "d")], schema), "id", ["v"])
    (tmp_path / "t" / "_versions" / "v-000000003").mkdir()  # a write that failed
    assert {r.id: r.x for r in B.read_table(spark, path).collect()} == {1: "a", 2: "c", 3: "d"}
    B.upsert_table(spark, path, spark.createDataFrame([(3, 2, "e")], schema), "id", ["v"])
    B.drop_old_versions(spark, path)
    assert B.ingest(spark.createDataFrame([(9, 1, "z")], schema), path, drop_existing=False) == 1
    assert {r.id: r.x for r in B.read_table(spark, path).collect()} == {1: "a", 2: "c", 3: "e", 9: "z"}
    B.ingest(spark.createDataFrame([(5, 1, "only")], schema), path)
    assert [r.x for r in B.read_table(spark, path).collect()] == ["only"]


def test_existing_tables_are_never_taken_for_missing(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception):
        B.read_table(spark, str(folder)).count()
    with pytest.raises(Exception):
        B.ensure_table(spark, str(folder), "a long")
    assert (folder / "part-0.parquet").read_text() == "not a table"
    rows = spark.range(5).selectExpr("id AS a")
    assert B.ingest(rows, str(tmp_path / "u")) == 5 and B.ingest(rows, str(tmp_path / "u"), drop_existing=False) == 5
    assert B.table_count(spark, str(tmp_path / "u")) == 10 and B.table_count(spark, str(tmp_path / "none")) == 0
