import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(documents):
    """(doc_id, text) of all documents."""
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, ties, repeated rows, a very long text, columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [
        (1, None, "en", None, 3, "h1"),
        (2, "", None, "a", None, "h2"),
        (2, "", None, "a", None, "h2"),
        (3, "one", "en", "a", 3, "h3"),
        (4, "One two three four five six seven eight nine ten eleven twelve", "en", "b", 60, "x"),
        (5, "One two three four five six seven eight nine ten eleven twelve", "de", "b", 60, "x"),
        (5, "One two three four five six seven eight nine ten eleven twelve", "de", "b", 60, "x"),
        (None, "one", None, None, None, None),
        (7, long, "en", "c", len(long), "x"),
        (8, "!!! ... 123", "en", "c", 11, "x"),
        (9, "a\x00b \x1c c d 　", "fr", "c", 11, "x"),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long, digest string"
    frame = spark.createDataFrame(rows, names)
    for clash in ("n", "h", "fp", "row", "shard", "spans", "ids", "score", "keep", "slot", "curve", "part"):
        frame = frame.selectExpr("*", f"'{clash}' AS {clash}")
    return frame


@pytest.fixture(scope="session")
def odd_pairs(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
