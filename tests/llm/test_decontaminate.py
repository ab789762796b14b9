import random

import plain
import pytest

from corpusloom.llm import decontaminate as D


def found(docs, items, window=10):
    return sorted(
        ((r.doc_id, r.n_words, r.n_hit, r.n_items, plain.sha(",".join(r["items"])), r.contaminated) for r in D.report(docs, items, window).collect()),
        key=str,
    )


@pytest.mark.parametrize("block, shard", [(8_000_000, 1_000_000), (1500, 2000)])
def test_documents(monkeypatch, spark, documents, pairs, block, shard):
    monkeypatch.setattr(D, "BLOCK_CHARS", block)
    monkeypatch.setattr(D, "SHARD_WORDS", shard)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain.decontaminated(pairs, [tuple(r) for r in items.select("item_id", "text").collect()])
    assert any(w[5] for w in want)
    assert found(documents, items) == sorted(want, key=str)


@pytest.mark.parametrize("window", [1, 2, 3, 20])
def test_small_alphabet(spark, window):
    rnd = random.Random(window)
    text = lambda n: " ".join(rnd.choice("a b c".split()) for _ in range(rnd.randint(0, n)))
    docs = [(i, text(40)) for i in range(60)]
    items = [(i, text(30)) for i in range(8)] + [(90, None), (91, ""), (92, "A b!"), (92, "c")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(*frames, window) == sorted(plain.decontaminated(docs, items, window), key=str)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "one two three four five"), (3, "four five six")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "zero one two three four five six")], "item_id string, text string")
    got = {r.offset: (r.length, r.doc_id, r.at) for r in D.longest_matches(docs, items).collect()}
    assert got == {1: (5, 2, 0), 2: (4, 2, 1), 3: (3, 2, 2), 4: (3, 3, 0), 5: (2, 3, 1)}


def test_odd_rows(spark, odd, odd_pairs):
    items = spark.createDataFrame(
        [("s", "ONE"), ("t", "two three four five six seven eight nine ten eleven"), (None, "b"), ("u", None), ("t", "b")],
        "item_id string, text string",
    )
    plain_items = [("s", "ONE"), ("t", "two three four five six seven eight nine ten eleven"), ("", "b"), ("u", None), ("t", "b")]
    assert found(odd, items) == sorted(plain.decontaminated(odd_pairs, plain_items), key=str)
    kept = D.clean(odd, items)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == "1 2 2 7 8".split()
    assert D.report(odd.limit(0), items).count() == 0
    assert not any(r.contaminated for r in D.report(odd, items.limit(0)).collect())
    assert D.clean(odd, items.limit(0)).count() == 11
