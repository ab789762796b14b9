import glob
import gzip
import hashlib

import pytest

from corpusloom.llm import warc_archive as W

LONG = "<p>" + "long text " * 400_000
COPY = "<html>" + "c" * 1500
ODD = [
    (1, "http://a/1", COPY), (2, "http://a/2", COPY), (3, None, COPY), (4, "http://a/ü%20 x\r\nInjected: 1", "é" * 600),
    (5, "http://a/5", "short"), (6, "http://a/6", "short"), (7, "http://a/7", None), (8, "", ""), (9, "http://a/9", LONG),
    (10, "http://a/10", COPY), (10, "http://a/10", COPY), (10, "http://a/10b", COPY), (None, "http://a/n", COPY), (None, None, None),
    (11, "http://a/11", "x" * 999), (12, "http://a/12", "x" * 999), (13, "u", "y" * 1000), (14, "u", "y" * 1000), (-5, "u", "y" * 1000),
    (15, "u", "a\r\n\r\nb\x00WARC/1.1\r\n"),
]


@pytest.fixture(scope="module")
def odd_pages(spark):
    frame = spark.createDataFrame(ODD, "page_id long, url string, html string")
    for clash in ("key", "row", "size", "payload", "response", "shard", "page", "n", "best", "name", "sha256", "upto"):
        frame = frame.selectExpr("*", f"'{clash}' AS {clash}")
    return frame


def plainly(rows, least=1000):
    out, left = [], {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for page_id, _, html in order:
        left[html or ""] = page_id
    taken = set()
    for page_id, _, html in reversed(order):
        data = (html or "").encode()
        first = len(data) < least or html not in taken
        taken.add(html)
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", None if first else left[html]))
    return sorted(out, key=str)


def found(spark, archive):
    rows = W.read(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 3000, "file_bytes": 700}])
def test_odd_rows(spark, odd_pages, sizes):
    archive = W.write(odd_pages, **sizes)
    assert found(spark, archive) == plainly(ODD)
    names = {r.name for r in spark.read.parquet(archive.manifest).collect()}
    assert sizes == {} or len(names) > 5
    assert {p.rsplit("/", 1)[-1] for p in glob.glob(archive.files + "/*.gz")} == names
    assert not glob.glob(archive.files + "/../temporary*")


def test_payloads_and_references(spark, odd_pages):
    archive = W.write(odd_pages, shard_bytes=5000)
    rows = W.read(spark, archive, payloads=True).collect()
    texts = {(r.page_id, hashlib.sha1(r.payload).hexdigest()) for r in rows if r.record_type == "response"}
    assert all(bytes(r.payload) in {(h or "").encode() for _, _, h in ODD} for r in rows if r.payload is not None)
    assert all((r.refers_to, r.payload_digest) in texts for r in rows if r.record_type == "revisit")
    assert len({r.record_id for r in rows}) == len(ODD)
    assert {r.url for r in rows} == {u for _, u, _ in ODD}


def test_empty(spark, odd_pages):
    assert found(spark, W.write(odd_pages.limit(0))) == []


def digests(spark, archive):
    return sorted((r.name, r.records, r.sha1) for r in spark.read.parquet(archive.manifest).collect())


def test_files_depend_on_the_data_alone(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sizes = {"shard_bytes": 40_000, "file_bytes": 4_000}
    one = W.write(pages.repartition(1), **sizes)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = W.write(pages.repartition(7), **sizes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert digests(spark, one) == digests(spark, other) and len(digests(spark, one)) > 5
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert found(spark, one) == found(spark, other) == plainly(rows)


def test_files_are_plain_gzip_with_a_member_a_record(spark, odd_pages):
    archive = W.write(odd_pages, file_bytes=900)
    whole = b"".join(gzip.open(p).read() for p in sorted(glob.glob(archive.files + "/*.gz")))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(ODD)
    assert b"\r\nInjected" not in whole


@pytest.mark.parametrize("harm", ["cut", "bit", "lost"])
def test_damage_is_reported(spark, harm):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}" * 50) for i in range(50)], "page_id long, url string, html string")
    archive = W.write(pages, file_bytes=500)
    path = sorted(glob.glob(archive.files + "/*.gz"))[1]
    data = open(path, "rb").read()
    records = list(W.members(data))
    if harm == "cut":
        data = data[:-20]
    elif harm == "bit":
        data = W.member(records[0].replace(b"<p>", b"<P>")) + b"".join(map(W.member, records[1:]))
    else:
        data = b"".join(map(W.member, records[1:]))
    with open(path, "wb") as out:
        out.write(data)
    with pytest.raises(Exception, match="torn|damaged|differ"):
        W.read(spark, archive).count()


def test_renaming_twice_changes_nothing(spark, tmp_path):
    """A task that is run again after its files were renamed."""
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    archive = W.write(pages)
    rows = spark.read.parquet(archive.manifest).selectExpr("*", "'gone' AS temporary").toArrow().to_batches()
    folder = archive.files.removesuffix("/files")
    assert sum(b.num_rows for b in W._renamer(folder)(iter(rows))) == 1
    assert found(spark, archive) == plainly([(1, "u", "x")])
