import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lexical_search as L
from corpusloom.operators import retrieval as R
from corpusloom.operators import vector_search as V

DOCS = [("a", "red red blue"), ("b", "blue green"), ("c", ""), ("d", "blue green")]


def ranked(docs, query, k):
    tokens = {c: t.split() for c, t in docs}
    mean = sum(map(len, tokens.values())) / len(tokens)
    scores = {}
    for term in query.split():
        df = sum(term in ts for ts in tokens.values())
        for c, ts in tokens.items():
            tf = ts.count(term)
            if tf:
                idf = math.log((len(docs) - df + 0.5) / (df + 0.5) + 1)
                scores[c] = scores.get(c, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / mean))
    best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return [(c, round(s, 4)) for c, s in best]


@pytest.mark.parametrize("row_terms", [64, 0])
def test_search(spark, monkeypatch, row_terms):
    """Both ways of counting: inside the rows, and by grouping."""
    monkeypatch.setattr(L, "ROW_TERMS", row_terms)
    docs = spark.createDataFrame(DOCS, "chunk_id string, text string")
    texts = {0: "blue blue", 1: "Red green", 2: "none", 3: ""}
    queries = spark.createDataFrame(list(texts.items()), "qid int, text string")
    hits = L.search_chunks(docs, queries, 2).collect()
    for qid, text in texts.items():
        got = [(h.chunk_id, h.score) for h in sorted(hits, key=lambda h: h["rank"]) if h.qid == qid]
        assert got == ranked(DOCS, text.lower(), 2)


def test_search_without_terms(spark):
    docs = spark.createDataFrame(DOCS, "chunk_id string, text string")
    queries = spark.createDataFrame([(0, " ")], "qid int, text string")
    assert L.search_chunks(docs, queries).collect() == []


def test_embedding_calls_are_batched_and_repeated(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(10)], "i int, text string").coalesce(1)
    failures = []

    def embed(texts):
        if not failures:
            failures.append(1)
            raise OSError("busy")
        assert len(texts) <= 4
        return [[float(len(t))] for t in texts]

    out = V.embed_batches(docs, "text", embed, batch=4, pause=0.0).collect()
    assert all(r.embedding == [float(r.i)] for r in out)
    with pytest.raises(ValueError):
        V.embed_batches(docs, "text", embed, batch=0)
    with pytest.raises(Exception, match="number of vectors"):
        V.embed_batches(docs, "text", lambda ts: [], batch=4, pause=0.0).collect()


def test_routing_and_rerank(spark):
    queries = spark.createDataFrame([(0, "sales of Foo Bar Inc in 2020"), (1, "foo only")], "qid int, text string")
    aliases = spark.createDataFrame([("Foo Bar", 1), ("bar inc", 2), ("Baz", 3)], "alias string, doc_id int")
    found = R.route(queries, aliases).collect()
    assert sorted((r.qid, r.doc_id) for r in found) == [(0, 1), (0, 2)]
    items = spark.createDataFrame([(0, "x", "b c"), (0, "y", "a b")], "qid int, chunk_id string, text string")
    top = R.rerank(items, R.overlap_score(F.lit("a b"), F.col("text")), 1).collect()
    assert [(r.chunk_id, r.rerank_score) for r in top] == [("y", 1.0)]


def test_prompt(spark):
    row = spark.range(1).select(R.answer_prompt(F.lit("Q?"), F.lit("number"), F.lit("C"), 5)).first()[0]
    assert "Q?" in row and "digits only" in row and "\nC\n" in row


def test_grep_context(spark):
    docs = spark.createDataFrame([(0, "a\nfind me\nb\nc"), (1, "nothing")], "k int, t string")
    rows = R.grep(docs, "k", "t", "^find", context=1).collect()
    assert [(r.k, r.line_no, r.around) for r in rows] == [(0, 1, "a\nfind me\nb")]


def test_both_ways_of_counting_give_equal_scores(spark, monkeypatch):
    rows = [(1, "alpha beta"), (2, None), (3, "alpha alpha gamma"), (4, ""), (5, "gamma delta"), (5, "gamma delta"), (5, "alpha"), (6, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    queries = spark.createDataFrame([(0, "alpha gamma"), (1, "delta delta beta"), (2, None)], "qid int, text string")

    def found():
        return sorted(map(tuple, L.search_chunks(chunks, queries, 10).collect()))

    in_rows = found()
    monkeypatch.setattr(L, "ROW_TERMS", 1)
    assert found() == in_rows
    index = L.build_index(chunks)
    assert sorted(map(tuple, L.search(index, queries, 10).collect())) == in_rows
    assert tuple(index.stats.first()) == (8, (2 + 0 + 3 + 0 + 2 + 2 + 1 + 0) / 8)


def test_grep_anchors(spark):
    df = spark.createDataFrame([(1, "a\nfoo"), (2, "foo b"), (3, None)], "k long, text string")
    assert [tuple(r)[:3] for r in R.grep(df, "k", "text", r"\Afoo\z").collect()] == [(1, 1, "foo")]


def test_terms_are_counted_without_a_shuffle(spark):
    """A task that counts holds a row, not its share of all words."""
    chunks = spark.createDataFrame([(5, "w1 w1 w59"), (5, "w1 w1 w59"), (6, None), (7, "b A b a")], "chunk_id long, text string")
    got = sorted((r.chunk_id, r.term, r.tf, r.length) for r in L.build_index(chunks).postings.collect())
    assert got == [(5, "w1", 2, 3)] * 2 + [(5, "w59", 1, 3)] * 2 + [(7, "a", 2, 4), (7, "b", 2, 4)]
    plan = L._counted_in_rows(chunks)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan
