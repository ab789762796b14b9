import zlib

import pytest
from plain import lower, sha
from pyspark.sql import functions as F

from corpusloom.llm import merkle as M


def leaf_of(row, text):
    told = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in told))


def tree(hashes):
    """Levels from the leaves to the root."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def path_of(levels, pos):
    out = []
    for level in levels[:-1]:
        run = pos // 8 * 8
        out.append(("".join(level[run:pos]), "".join(level[pos + 1 : run + 8])))
        pos //= 8
    return out


def plainly(rows):
    """Every output row of the manifest with every third text tampered."""
    groups = {}
    for r in rows:
        groups.setdefault((r.lang is not None, (r.lang or "").encode()), []).append(r)
    order = sorted(groups)
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        trees[g] = tree([leaf_of(r, r.text) for r in groups[g]])
    crown = tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for pos, r in enumerate(groups[g]):
            path = path_of(trees[g], pos) + path_of(crown, at)
            third = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            x = leaf_of(r, lower(r.text) if third and r.text is not None else r.text)
            for left, right in path:
                x = sha(left + x + right)
            root = crown[-1][0]
            out.append((str(r.doc_id), trees[g][0][pos], trees[g][-1][0], root, sha("".join(a + b for a, b in path)), x, x == root))
    return sorted(out)


def found(docs):
    rows = M.manifest(docs, M.every_third(), M.lower_az())
    rows = rows.select("doc_id", "leaf", "subroot", "root", M.proof_hash(F.col("path")), "folded_root", "verified")
    return sorted((str(r[0]), *r[1:]) for r in rows.collect())


@pytest.mark.parametrize("span", [1, 3])
def test_documents(documents, monkeypatch, span):
    """With blocks of one level the trees are several blocks high."""
    monkeypatch.setattr(M, "SPAN", span)
    assert found(documents) == plainly(documents.collect())


def test_odd_rows(odd):
    assert found(odd) == plainly(odd.select(*M.FIELDS).collect())
    assert found(odd.limit(0)) == []
    one = odd.where("doc_id = 7")
    assert found(one) == plainly(one.select(*M.FIELDS).collect())


@pytest.mark.parametrize("rows", [8, 9, 64, 65, 512, 513])
def test_edges_of_runs(spark, rows):
    docs = spark.range(rows).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "id AS n_chars", "concat('T', id) AS text")
    assert found(docs) == plainly(docs.collect())


def test_many_groups(spark, monkeypatch):
    """More languages than a block has nodes, offsets joined by a shuffle."""
    monkeypatch.setattr(M, "SPAN", 1)
    monkeypatch.setattr(M, "OFFSETS", 3)
    docs = spark.range(300).selectExpr(
        "id AS doc_id", "'s' AS source", "if(id % 97 = 0, null, concat('é', id % 80)) AS lang", "id AS n_chars", "concat('T', id) AS text"
    )
    assert found(docs) == plainly(docs.collect())


def test_untampered_rows_verify(documents):
    assert M.manifest(documents).where("verified AND folded_root = root").count() == documents.count()
