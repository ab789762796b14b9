import pytest
from pyspark.sql import functions as F

from corpusloom.functions import encoding as E
from corpusloom.functions import numeric as N
from corpusloom.operators import vocabulary as V


def test_pair_lengths_equal_the_loop(spark):
    grid = spark.range(20).selectExpr("cast(id as int) a").join(spark.range(20).selectExpr("cast(id as int) b"))
    for limit in range(1, 14):
        keep_a, keep_b = E.pair_lengths(F.col("a"), F.col("b"), limit)
        for a, b, ka, kb in grid.select("a", "b", keep_a, keep_b).collect():
            x, y = a, b
            while x + y > limit:
                if x > y:
                    x -= 1
                else:
                    y -= 1
            assert (ka, kb) == (x, y), (a, b, limit)


def test_vocabularies(spark):
    docs = spark.createDataFrame([(0, ["b", "a", "b", "<pad>"]), (1, ["c", "a", "d"])], "k int, ws array<string>")
    counts = V.token_counts(docs, "ws", ["k"])
    by_count = {r.token: r.id for r in V.build_by_count(counts.drop("first_seen")).collect()}
    assert by_count == {"<pad>": 0, "<unk>": 1, "<eos>": 2, "<sos>": 3, "<mask>": 4, "a": 5, "b": 6, "c": 7, "d": 8}
    capped = V.build_by_count(counts.drop("first_seen"), max_size=2)
    assert sorted(r.token for r in capped.collect()) == sorted(["<pad>", "<unk>", "<eos>", "<sos>", "<mask>", "a", "b"])
    first = {r.token: r.id for r in V.build_by_first_seen(counts, min_freq=1).collect()}
    assert [first[t] for t in "bacd"] == [4, 5, 6, 7]
    grown = V.extend(capped, V.build_by_count(counts.drop("first_seen")))
    assert {r.token: r.id for r in grown.collect()}["d"] == 8


@pytest.mark.parametrize("limit", [100, 0])
def test_lookup_by_broadcast_and_by_salted_join(spark, limit):
    docs = spark.createDataFrame([(0, ["b", "x", "a"]), (1, []), (2, ["a"])], "k int, ws array<string>")
    vocab = spark.createDataFrame([("a", 7), ("b", 8)], "token string, id int")
    found = V.lookup(docs, "k", "ws", vocab, 1, broadcast_rows=limit)
    assert {r.k: r.ids for r in found.collect()} == {0: [8, 1, 7], 1: [], 2: [7]}
    with pytest.raises(Exception, match="not in vocabulary"):
        V.lookup(docs, "k", "ws", vocab, None, broadcast_rows=limit).collect()


def test_words_of_ids(spark):
    rows = spark.createDataFrame([(0, [5, 0, 9]), (1, [0])], "k int, ids array<int>")
    vocab = spark.createDataFrame([("<pad>", 0), ("a", 5)], "token string, id int")
    shown = V.words_of_ids(rows, "k", "ids", vocab, drop=[0])
    assert {r.k: r.tokens for r in shown.collect()} == {0: ["a", "<9>"], 1: []}


def test_character_matrices(spark):
    row = spark.range(1).select(
        E.char_codes(F.lit("né"), 6).alias("w"), E.char_codes(F.lit("abcdefgh"), 6).alias("cut"),
        E.sentence_codes(F.array(F.lit("a")), 5).alias("s"), E.causal_mask(F.lit(3)).alias("m"),
        E.char_index(F.array(*[F.lit(c) for c in "a-?é"]), 6).alias("c"),
    ).first()
    assert row["w"] == [258, 110, 195, 169, 259, 260]
    assert row["cut"] == [258, 97, 98, 99, 100, 259]
    assert row["s"] == [[258, 256, 259, 260, 260], [258, 97, 259, 260, 260], [258, 257, 259, 260, 260]]
    assert row["m"] == [[1, 0, 0], [1, 1, 0], [1, 1, 1]]
    # "-" occurs twice in the alphabet: the later place counts
    last = 2 + E.CHAR_ALPHABET.rindex("-")
    assert row["c"] == [2, last, 2 + E.CHAR_ALPHABET.index("?"), 1, 0, 0]


def test_formulas(spark):
    import math

    row = spark.range(1).select(
        N.gelu_erf(F.lit(-1.3)).alias("g"), N.erf(F.lit(0.7)).alias("e"), N.erf(F.lit(-3.0)).alias("f"),
        N.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"), N.softmax(F.array().cast("array<double>")).alias("n"),
        N.noam_rate(F.lit(0), 512, 4000).alias("r"), N.linear_rate(F.lit(50), 1.0, 100, 10).alias("l"),
    ).first()
    assert row["g"] == pytest.approx(-1.3 * 0.5 * (1 + math.erf(-1.3 / math.sqrt(2))), abs=1e-12)
    assert row["e"] == pytest.approx(math.erf(0.7), abs=1e-12) and row["f"] == pytest.approx(math.erf(-3), abs=1e-12)
    assert row["s"] == [0.5, 0.5] and row["n"] == []
    assert row["r"] == pytest.approx(512**-0.5 * 4000**-1.5) and row["l"] == pytest.approx(0.5)


def test_one_hot_digits_are_the_joined_vector(spark):
    ids = spark.range(74).selectExpr("cast(id AS int) AS k")
    plain = F.array_join(E.char_one_hot(F.col("k"), 70).cast("array<string>"), "")
    assert ids.where(E.char_one_hot_digits(F.col("k"), 70) != plain).count() == 0
    shown = ids.select(E.char_one_hot_digits(F.col("k"), 70).alias("d"))
    assert "lambda" not in shown._jdf.queryExecution().executedPlan().toString()


def test_ids_are_found_inside_the_rows(spark):
    vocab = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "token string, id int")
    rows = spark.createDataFrame([(1, ["a", "x", None, "b"]), (2, None), (3, []), (None, ["c"])], "k int, t array<string>")
    found = V.lookup(rows, "k", "t", vocab, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    assert {r.k: r.ids for r in found.collect()} == {1: [5, 1, 1, 6], 2: [], 3: [], None: [7]}
    twice = rows.union(rows)
    want = {1: [5, 5, 1, 1, 1, 1, 6, 6], 2: [], 3: [], None: [7, 7]}
    for limit in (10, 0):
        assert {r.k: r.ids for r in V.lookup(twice, "k", "t", vocab, 1, broadcast_rows=limit).collect()} == want


def test_words_of_ids_inside_the_rows(spark, monkeypatch):
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, id int")
    rows = spark.createDataFrame([(1, [5, 99, None, 0, 6]), (2, None), (3, []), (None, [6])], "k int, ids array<int>")
    shown = V.words_of_ids(rows, "k", "ids", vocab, drop=[0])
    assert "Generate" not in shown._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(str, shown.collect()))
    assert "Row(k=1, tokens=['a', '<99>', 'b'])" in want
    monkeypatch.setattr(V, "BROADCAST_ROWS", 0)
    assert sorted(map(str, V.words_of_ids(rows, "k", "ids", vocab, drop=[0]).collect())) == want
