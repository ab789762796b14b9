import math

import numpy as np

from corpusloom.llm import quality_fm as Q
from corpusloom.llm.common import fold


def machine(rng):
    m = len(Q._STATISTICS)
    size = Q.WORD_SLOTS + m + m * Q.CELLS
    bounds = np.sort(rng.standard_normal((m, Q.CELLS - 1)), axis=1)
    return Q.Machine(0.1, rng.standard_normal(size), rng.standard_normal((size, Q.FACTORS)) * 0.1, np.zeros(m), np.ones(m), bounds)


def test_pairs_by_the_identity():
    rng = np.random.default_rng(1)
    fm = machine(rng)
    index, x = fm.row(*Q.read("some words, and some more words 12"))
    z = fm.bias + sum(fm.w[i] * a for i, a in zip(index, x))
    for a in range(len(index)):
        for b in range(a + 1, len(index)):
            z += fm.v[index[a]] @ fm.v[index[b]] * x[a] * x[b]
    assert math.isclose(fm.score(index, x), 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_statistics_have_names_and_are_finite():
    for text in ("", " ", "\n\n", "a", "| | |", "É" * 50, "x" * 100_000):
        _, _, stats = Q.read(text)
        assert len(stats) == len(Q._STATISTICS) and np.isfinite(stats).all()


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = Q.score(docs, Q.fit(docs, labels)).join(labels, "doc_id").filter(fold() == 0).collect()
    s, y = np.array([r.score for r in scored]), np.array([r.quality for r in scored])
    low, high = s[y == 0], s[y == 1]
    auc = np.mean([(high > x).mean() + 0.5 * (high == x).mean() for x in low])
    assert len(scored) > 500 and auc > 0.97 and ((s >= Q.THRESHOLD) == y).mean() > 0.95


def test_odd_rows(spark, monkeypatch, odd):
    monkeypatch.setattr(Q, "EPOCHS", 1)
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (5, None), (None, 1), (7, 1), (8, 1)], "doc_id long, quality int")
    for known in (labels, labels.filter("quality = 1"), labels.limit(0)):
        fitted = Q.fit(odd, known)
        rows = Q.score(odd, fitted).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert fitted is not None or {r.score for r in rows} == {0.5}
    assert Q.score(odd.limit(0), Q.fit(odd.limit(0), labels)).count() == 0
