import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import filter_audit as A


def plainly(docs, labels):
    """docs: (doc_id, part, text), labels: (doc_id, quality, toxic); every order run row by row."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    flags = []
    for doc_id, part, text in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(d is not None and doc_id is not None and d < doc_id and (x or "") == t for d, _, x in docs)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller,
        }
        flags.append((part or "", doc_id, {k for k, v in fails.items() if v}))
    out, removed_by = {}, Counter()
    for part in {p for p, _, _ in flags}:
        for order in map("".join, permutations("ABCDE")):
            alive = [(d, f) for p, d, f in flags if p == part]
            everyone = alive
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in alive if letter in f]
                alive = [(d, f) for d, f in alive if letter not in f]
                failing = [f for _, f in everyone if letter in f]
                removed_by[part, letter] += len(gone)
                out[part, order, step] = [
                    len(alive), len(gone), len(failing) - len(gone), sum(f == {letter} for f in failing),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
    return sorted((p, o, s, *v, removed_by[p, o[s - 1]]) for (p, o, s), v in out.items())


def weak(text):
    return F.length(text).cast("long") % 7


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, 1, 0), (5, None, 1), (7, 1, None), (9, 0, 1), (None, 1, 1), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), rows


@pytest.mark.parametrize("digest", [A.xxhash, weak])
def test_odd_rows(odd, labels, digest):
    rows = [(r.doc_id, r.lang, r.text) for r in odd.select("doc_id", "lang", "text").collect()]
    found = A.audit(odd, labels[0], digest=digest)
    assert sorted(map(tuple, found.collect())) == plainly(rows, labels[1])
    assert A.audit(odd.limit(0), labels[0]).count() == 0


def test_small_table(spark, documents):
    """Copies within and across parts; all hashes in seven classes must change nothing."""
    docs = documents.select("doc_id", "lang", "text")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").selectExpr("doc_id + 1000 AS doc_id", "'xx' AS lang", "text"))
    labels = documents.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality", "cast(doc_id % 5 = 0 AS int) AS toxic")
    want = plainly([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert sorted(map(tuple, A.audit(docs, labels).collect())) == want
    assert sorted(map(tuple, A.audit(docs, labels, digest=weak).collect())) == want


def test_sketch_clears_only_unique_texts(spark):
    texts = [(i, f"text {i}") for i in range(4000)] + [(i, f"text {i % 50}") for i in range(4000, 4200)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumn("h", F.xxhash64("text")).repartition(7)
    kept = rows.where(A.may_repeat(rows, len(texts))(F.col("h"))).select("doc_id", "text").collect()
    counts = Counter(t for _, t in texts)
    found = {r.doc_id for r in kept}
    assert {i for i, t in texts if counts[t] > 1} <= found
    assert len(found) < 250 + 400  # unique texts that share all counters with others


def test_full_sketch_gives_the_same(spark, documents, labels, monkeypatch):
    want = sorted(map(tuple, A.audit(documents, labels[0]).collect()))
    monkeypatch.setattr(A, "LEAST_COUNTERS", 1 << 15)
    monkeypatch.setattr(A, "PAGE", 64)
    monkeypatch.setattr(A, "MOST_COUNTERS", 64)
    monkeypatch.setattr(A, "LEAST_COUNTERS", 64)
    assert sorted(map(tuple, A.audit(documents, labels[0]).collect())) == want
