import random

import numpy as np
import plain
import pytest

from corpusloom.llm import simhash_dedup as S


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_documents(documents, pairs):
    found = {r.doc_id: r for r in S.components(documents).collect()}
    fps = {d: plain.simhash(t) for d, t in pairs}
    assert {d: r.fp for d, r in found.items()} == {d: signed(x) for d, x in fps.items()}
    assert {d: r.component_id for d, r in found.items()} == plain.linked(fps)


def test_codewords_cover_every_point_within_one_bit():
    words = np.arange(1 << S.CODED)
    near = S._near_codewords(words)
    assert (S._syndromes()[near[near >= 0]] == 0).all()
    assert np.bitwise_count(near[:, 0] ^ words).max() == 1
    code = np.flatnonzero(S._syndromes() == 0)
    for word in random.Random(1).sample(range(1 << S.CODED), 50):
        want = {int(c) for c in code if bin(int(c) ^ word).count("1") <= 2}
        assert {int(c) for c in near[word] if c >= 0} == want


def test_linked_pairs_meet_at_an_anchor():
    rnd = random.Random(2)
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for bit in rnd.sample(range(64), rnd.randint(0, 4)):
            y ^= 1 << bit
        index, found = S.anchors(np.array([signed(x), signed(y)]))
        assert set(found[index == 0]) & set(found[index == 1])


@pytest.mark.parametrize("tile", [20_000, 3])
def test_clusters_and_chains(spark, tile):
    rnd = random.Random(3)
    fps = set()
    for _ in range(30):
        x = base = rnd.getrandbits(64)
        for _ in range(8):
            y = base
            for _ in range(rnd.randint(0, 5)):
                y ^= 1 << rnd.randrange(64)
            fps.add(y)
            for bit in rnd.sample(range(64), 4):
                x ^= 1 << bit
            fps.add(x)
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in S.label_components(S.links(frame, tile)).collect()}
    want = plain.linked({signed(x): x for x in fps})
    assert {x: roots.get(x, x) for x in want} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(150)] + [(900, 7), (901, 900)], "a long, b long")
    assert {r.root for r in S.label_components(edges).collect()} == {0}


def test_odd_rows(odd):
    found = S.components(odd).collect()
    assert len(found) == 11
    empty = [r for r in found if r.doc_id in (1, 2)]
    assert all(r.fp == 0 and r.component_id == 1 for r in empty) and len(empty) == 3
    assert {r.component_id for r in found if r.doc_id in (4, 5)} == {4}
    assert {r.component_id for r in found if r.doc_id in (3, None)} == {3}
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 3 4 7 8 9".split())
    assert S.components(odd.limit(0)).count() == 0 and S.keep_one(odd.limit(0)).count() == 0


def test_one_row_of_every_component_stays(spark):
    word = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [
        (1, word(1)), (None, word(1).upper()),  # a null identifier linked to another one
        *[(None, word(i)) for i in range(2, 8)],  # unrelated texts without an identifier
        (20, word(20)), (21, word(20).upper()), (21, word(21)),  # two texts under one identifier, one a near copy
        (30, word(30)), (30, word(30).upper()), (30, word(30)),  # the smallest identifier repeats
        (None, word(40)), (None, word(40).upper()), (None, word(40)),  # null identifiers only
        (50, None), (50, ""), (None, " "),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string").repartition(3)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted((str(r.doc_id), (r.text or "").strip().lower()) for r in kept.collect())
    want = [(1, word(1)), *[(None, word(i)) for i in range(2, 8)], (20, word(20)), (21, word(21)), (30, word(30)), (None, word(40)), (50, "")]
    assert found == sorted((str(d), t) for d, t in want)


def test_clashing_columns_stay(odd):
    named = odd.selectExpr("*", "1 AS _key", "2 AS _text_digest", "3 AS _id", "4 AS _digest")
    kept = S.keep_one(named)
    assert kept.columns == named.columns and kept.where("_key = 1 AND _text_digest = 2 AND _id = 3 AND _digest = 4").count() == S.keep_one(odd).count()
