"""Chunkers against short re-statements of their rules on small texts."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking as C


def column(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


@pytest.mark.parametrize("size, overlap", [(10, 3), (10, 0), (6, 4)])
def test_fixed_windows(spark, size, overlap):
    texts = ["", "a", "abcdefghij", "abcdefghijk", "x y " * 13, "数据é" * 9]
    got = column(spark, texts, lambda t: C.fixed_windows(t, size, overlap))
    step = size - overlap
    for text, chunks in zip(texts, got):
        expected = [(i, text[i : i + size].strip()) for i in range(0, len(text), step)]
        assert [(c["char_start"], c["content"]) for c in chunks] == expected


def test_default_window_edges(spark):
    texts = ["a" * n for n in (0, 1, 800, 1000, 1001)]
    got = column(spark, texts, lambda t: C.fixed_windows(t))
    assert [[c["char_start"] for c in chunks] for chunks in got] == [[], [0], [0], [0, 800], [0, 800]]


def windows(text, size, overlap, strict):
    """The window loop in its plain form."""
    out, start, step = [], 0, size - overlap
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for sep in ("\n\n", "\n", ". ", " "):
                found = text[start:end].rfind(sep)
                if found >= int(size * 0.6):
                    end = start + found + len(sep)
                    break
        piece = text[start:end]
        if piece.strip():
            out.append((start + len(piece) - len(piece.lstrip()), end, piece.strip()))
        if end >= len(text):
            break
        start = end - overlap if strict else max(end - overlap, start + step)
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_boundary_windows(spark, strict):
    rng = random.Random(1)
    texts = ["", " ", "a" * 10] + [
        "".join(rng.choice("abcdefgh   .\n") for _ in range(rng.randint(1, 200))) for _ in range(60)
    ]
    got = column(spark, texts, lambda t: C.boundary_windows(t, 20, 5, strict))
    for text, chunks in zip(texts, got):
        assert [(c["char_start"], c["char_end"], c["content"]) for c in chunks] == windows(text, 20, 5, strict)


def test_early_cut_loses_text_only_without_strict(spark):
    text = "a" * 640 + ". " + "b" * 3000
    loose, strict = (column(spark, [text], lambda t: C.boundary_windows(t, strict=s))[0] for s in (False, True))
    assert [(c["char_start"], c["char_end"]) for c in loose][:2] == [(0, 642), (800, 1800)]
    assert all(b["char_start"] <= a["char_end"] for a, b in zip(strict, strict[1:]))


def test_header_segments(spark):
    texts = ["before\n# A\nx\n## B\ny", " none \n#nohdr", "####### seven\nz", "# \n", "a\n#\tT"]
    got = column(spark, texts, C.header_segments)
    assert got == [["# A\nx", "## B\ny"], ["none \n#nohdr"], ["####### seven\nz"], ["#"], ["#\tT"]]


def test_noise_and_short_merging(spark):
    long = "w" * 60
    texts = [f"# a\n# b\n{long}\n# c", "# a\n# b", f"# a\n{long}\n# b\n{long}"]
    got = column(spark, texts, C.structural_segments)
    assert got[0] == [f"# a\n\n# b\n{long}\n\n# c"]
    assert got[1] == ["# a\n\n# b"]
    assert got[2] == [f"# a\n{long}", f"# b\n{long}"]


def test_merge_short(spark):
    def merged(*chunks):
        item = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(k).alias("chunk_type")) for t, k in chunks])
        rows = spark.range(1).select(C.merge_short(item)).first()[0]
        return [(len(r["text"]), r["chunk_type"]) for r in rows]

    assert merged(("a" * 200, "text")) == [(200, "text")]
    assert merged(("a" * 100, "text"), ("b" * 99, "table")) == [(201, "table")]
    assert merged(("a" * 250, "text"), ("b" * 10, "table")) == [(262, "table")]
    assert merged(("a" * 150, "text"), ("b" * 50, "text"), ("c" * 210, "table")) == [(202, "text"), (210, "table")]


def test_table_blocks(spark):
    text = "|a|b|\n|1|2|\n\n|3|4|\nx\n\n\n|c|\n\n\n|d|\n"
    blocks = column(spark, [text], C.table_blocks)[0]
    assert [(b["line_start"], b["line_end"]) for b in blocks] == [(0, 4), (7, 8), (10, 12)]
    assert blocks[0]["preamble"] == "" and blocks[0]["table"] == "|a|b|\n|1|2|\n\n|3|4|"
    assert blocks[1]["preamble"] == "|3|4|\nx"


def test_pages(spark):
    pages = F.array(F.lit("ab"), F.lit(""), F.lit("cde"))
    row = spark.range(1).select(
        C.compose_pages(pages).alias("t"), C.page_spans(pages).alias("s"),
        *[C.page_of_offset(C.page_spans(pages), F.lit(o)).alias(f"p{o}") for o in (0, 2, 6, 99)],
        C.page_ranges(F.lit(23)).alias("r"),
    ).first()
    assert row["t"] == "ab\n\n\n\ncde"
    assert [(s["start"], s["end"]) for s in row["s"]] == [(0, 2), (4, 4), (6, 9)]
    assert (row["p0"], row["p2"], row["p6"], row["p99"]) == (0, 2, 2, 2)
    assert [len(r) for r in row["r"]] == [10, 10, 3]
