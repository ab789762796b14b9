import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import basic_tokens
from corpusloom.operators import answer_spans as A
from corpusloom.operators.chunking import doc_spans


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def strings(*values):
    return F.array(*[F.lit(v) for v in values])


def test_final_text(spark):
    def final(pred, orig):
        return one(spark, A.final_text(F.lit(pred), F.lit(orig)))[0]

    assert final("steve smith", "Steve Smith's") == "Steve Smith"
    assert final("unknown", "Steve Smith's") == "Steve Smith's"
    assert final("hello", "Héllo!") == "Héllo"


def test_improved_span(spark):
    tokens = strings("(", "1895", "-", "1943", ")", ".")
    span = one(spark, A.improve_span(tokens, F.lit(0), F.lit(5), strings("1895")))[0]
    assert (span["start"], span["end"]) == (1, 1)
    span = one(spark, A.improve_span(tokens, F.lit(0), F.lit(5), strings("x")))[0]
    assert (span["start"], span["end"]) == (0, 5)


@pytest.mark.parametrize("longest, stride, n", [(9, 4, 9), (9, 4, 30), (8, 8, 20), (10, 3, 31), (6, 5, 1)])
def test_maximal_context_by_comparing_all_spans(spark, longest, stride, n):
    from corpusloom.functions.columns import let

    flags = let(
        doc_spans(F.lit(n), longest, stride),
        lambda spans: F.transform(spans, lambda s, i: F.struct(
            s["start"].alias("start"), s["length"].alias("length"),
            F.transform(F.sequence(s["start"], s["start"] + s["length"] - 1), lambda p: A.is_max_context(
                s, F.get(spans, i - 1), F.get(spans, i + 1), p)).alias("flags"))),
    )
    spans = one(spark, flags)[0]
    for i, span in enumerate(spans):
        for offset, flag in enumerate(span["flags"]):
            p = span["start"] + offset
            scores = [
                (min(p - s["start"], s["start"] + s["length"] - 1 - p) + 0.01 * s["length"], -j)
                for j, s in enumerate(spans) if s["start"] <= p < s["start"] + s["length"]
            ]
            assert flag == (-max(scores)[1] == i)


def test_doc_spans_equal_the_loop(spark):
    for n in (0, 300, 384, 385, 1000):
        got = [(s["start"], s["length"]) for s in one(spark, doc_spans(F.lit(n), 384, 128))[0]]
        expected, start = [], 0
        while start < n:
            length = min(384, n - start)
            expected.append((start, length))
            if start + length == n:
                break
            start += min(length, 128)
        assert got == expected


def test_examples_and_features(spark, tmp_path):
    from corpusloom.sources.readers import questions

    context = "The leader was John Smith (1895-1943). He lived in  Xanten."
    data = {"data": [{"title": "t", "paragraphs": [{"context": context, "qas": [
        {"id": "q1", "question": "When was he born?", "answers": [{"text": "1895", "answer_start": 27}]},
        {"id": "q2", "question": "Gone?", "is_impossible": True, "answers": []},
        {"id": "q3", "question": "Bad", "answers": [{"text": "in Xanten", "answer_start": 47}]},
    ]}]}]}
    import json

    (tmp_path / "q.json").write_text(json.dumps(data, indent=1))
    examples = A.training_examples(A.read_questions(questions(spark, str(tmp_path))))
    rows = {r.qas_id: r for r in examples.collect()}
    assert rows["q1"].doc_tokens[rows["q1"].start_position] == "(1895-1943)."
    assert rows["q2"].start_position == -1 and rows["q3"].end_position == 9
    ready = examples.withColumns({
        "pieces": F.transform("doc_tokens", lambda w: basic_tokens(w)),
        "query": basic_tokens(F.col("question")),
        "answer_tokens": basic_tokens(F.col("answer_text")),
    })
    found = A.with_unique_ids(A.window_features(ready, "pieces", "query", 64, 32)).collect()
    by_id = {r.qas_id: r for r in found}
    q1 = by_id["q1"]
    assert q1.tokens[q1.start_index : q1.end_index + 1] == ["1895"]
    assert (by_id["q2"].start_index, by_id["q2"].end_index) == (0, 0)
    assert sorted(r.unique_id for r in found) == [1000000000, 1000000001, 1000000002]
    assert len(q1.tokens) == len(q1.segment_ids) == len(q1.token_to_orig) == len(q1.token_is_max_context)


def test_several_answers_fail(spark):
    rows = spark.createDataFrame(
        [("q", "?", "a b", [("a", 0), ("b", 2)], False)],
        "qas_id string, question string, context string, answers array<struct<text:string,answer_start:int>>, is_impossible boolean",
    )
    with pytest.raises(Exception, match="exactly one answer"):
        A.training_examples(rows).collect()


def test_no_text_at_all_gives_the_empty_answer(spark):
    schema = "qas_id string, rank int, text string, start_logit double, end_logit double"
    nulls = spark.createDataFrame([("q", -1.0, 0.0, -1.0)], "qas_id string, score_null double, null_start_logit double, null_end_logit double")
    row = A.decide(spark.createDataFrame([], schema), nulls).first()
    assert row.prediction == "" and row.score_diff is None


def test_null_entry_and_fallback(spark):
    schema = (
        "qas_id string, feature_index int, tokens array<string>, token_to_orig array<int>, doc_tokens array<string>, "
        "start_index int, end_index int, start_logit double, end_logit double"
    )
    words = ["a", "b", "c"]
    spans = [("q", 0, words, [0, 1, 2], words, i, i, x, 0.0) for i, x in enumerate((3.0, 2.0, 1.0))]
    candidates = spark.createDataFrame(spans, schema)
    nulls = spark.createDataFrame(
        [("q", 2.0, 1.0, 1.0), ("r", -4.0, -2.0, -2.0)],
        "qas_id string, score_null double, null_start_logit double, null_end_logit double",
    )

    def rows(**options):
        return sorted((r.qas_id, r["rank"], r.text) for r in A.n_best(candidates, **options).collect())

    assert rows(n=3) == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")]
    assert rows(n=3, nulls=nulls) == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, ""), ("r", 1, "")]
    assert rows(n=2, nulls=nulls) == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, ""), ("r", 1, "")]
    questions = spark.createDataFrame([("q",), ("s",)], "qas_id string")
    assert rows(n=1, questions=questions) == [("q", 1, "a"), ("s", 1, "empty")]


def test_results_by_unique_id(spark):
    features = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "unique_id long, tokens array<string>")
    good = [(2, [0.5], [0.25]), (1, [1.0, 2.0], [3.0, 4.0]), (9, [0.0], [0.0])]

    def joined(rows):
        results = spark.createDataFrame(rows, "unique_id long, start_logits array<double>, end_logits array<double>")
        return sorted((r.unique_id, r.start_logits, r.end_logits) for r in A.with_results(features, results).collect())

    assert joined(good) == [(1, [1.0, 2.0], [3.0, 4.0]), (2, [0.5], [0.25])]
    for bad in (good[1:], [*good, good[0]], [(2, [0.5, 0.5], [0.25]), *good[1:]], [(2, [0.5], []), *good[1:]]):
        with pytest.raises(Exception, match="no single fitting result for feature 2"):
            joined(bad)


def documents(folder, n=12):
    import duckdb

    text = "list_aggregate([CASE WHEN k % 17 = 3 THEN 'Näh-' || k ELSE 'w' || (i * k) % 97 || ',' END FOR k IN range(0, 40 + i * 11)], 'string_agg', ' ')"
    duckdb.execute(f"COPY (SELECT i AS doc_id, {text} AS text, 'web' AS source, 'en' AS lang FROM range(0, {n}) t(i)) TO '{folder}/documents.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["qa_features", "qa_nbest", "qa_decide"])
def test_features_and_logits_are_not_stored(spark, tmp_path, monkeypatch, name):
    """Stored tables hold lengths, digests or reduced results: nothing per token."""
    import __spark_entry__ as entry
    import oracle
    from corpusloom.operators import ordering
    from corpusloom.plans import qa_plans
    from corpusloom.staging import stage

    stored = []

    def seen(df, tag):
        stored.append((tag, df.columns))
        return stage(df, tag)

    monkeypatch.setattr(oracle, "TABLES", ("documents",))
    for module in (A, ordering, qa_plans):
        monkeypatch.setattr(module, "stage", seen)
    n, _ = oracle.compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], documents(tmp_path))
    assert n >= 12 and stored
    per_token = {"tokens", "token_to_orig", "token_is_max_context", "segment_ids", "start_logits", "end_logits"}
    assert not [tag for tag, columns in stored if per_token & set(columns)]


def test_reduced_results_give_the_same_candidates(spark):
    import random

    rng = random.Random(4)
    features, results = [], []
    for i in range(60):
        n = rng.randrange(3, 30)
        orig = [None, *[k // 2 for k in range(n - 2)], None]
        features.append((f"q{i % 7}", i // 7, n, i, [f"t{k}" for k in range(n)], orig, [o is not None and rng.random() < 0.8 for o in orig]))
        results.append((i, *[[float(rng.randrange(6)) for _ in range(n)] for _ in range(2)]))
    schema = "qas_id string, doc_span_index int, n_tokens int, unique_id long, tokens array<string>, token_to_orig array<int>, token_is_max_context array<boolean>"
    features = spark.createDataFrame(features, schema)
    results = spark.createDataFrame([*results, (99, [1.0], [])], "unique_id long, start_logits array<double>, end_logits array<double>")
    columns = ["qas_id", "doc_span_index", "start_index", "end_index", "start_logit", "end_logit"]
    whole = A.candidate_spans(A.with_results(features, results), 5, 9).select(columns)
    reduced = A.results_of_questions(features, results, 5)
    one = features.join(reduced, "qas_id").withColumn("result", F.get("results", F.col("doc_span_index")))
    got = A.candidates_of_best(one, 9).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and whole.count() > 100
    for bad in (results.where("unique_id <> 4"), results.unionByName(results.where("unique_id = 4"))):
        with pytest.raises(Exception, match="no single fitting result for feature 4"):
            A.results_of_questions(features, bad, 5).collect()
