import random

import numpy as np
import plain
import pytest

from corpusloom.llm import substring_dedup as S


def found(docs, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, plain.sha(r.kept)) for r in S.remove_repeats(docs, **options).collect()), key=str)


@pytest.mark.parametrize("crowd", [100_000, 1])
def test_documents(monkeypatch, documents, pairs, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    want = plain.removed_words(pairs)
    assert sum(w[2] for w in want) > 1000
    assert found(documents) == sorted(want, key=str)


@pytest.mark.parametrize("window, m, crowd, bits", [(6, 3, 20_000, 27), (5, 1, 3, 27), (4, 4, 20_000, 16), (8, 2, 1, 16)])
def test_small_alphabet(monkeypatch, spark, window, m, crowd, bits):
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S, "MAP_BITS", bits)  # a map this small is nearly full: more is sent, nothing changes
    rnd = random.Random(window)
    docs = [(i, "\t ".join(rnd.choice("a b c d".split()) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(frame, window=window, m=m) == sorted(plain.removed_words(docs, window), key=str)


@pytest.mark.parametrize("piece", [40, 200, 3000])
def test_pieces_of_texts_give_the_same_windows(monkeypatch, piece):
    rnd = random.Random(piece)
    texts = [" \n".join(rnd.choice(["a", "bb", "é"]) for _ in range(rnd.randint(0, 300))).encode() for _ in range(12)]
    texts += [b"", b"x" * 500, b"  ", b"one  two "]

    def windows():
        out = set()
        for keys, offset, cut in S.cut_pieces(list(range(len(texts))), texts, 7, 3):
            for f, n, c, t, h in zip(cut.first, cut.number, cut.count, cut.text, cut.minimiser):
                for i in range(c):
                    words = cut.joined[cut.start[f + i] : cut.end[f + i + 6]]
                    out.add((keys[t], int(n + i + offset[t]), words, int(h)))
        return out

    whole = windows()
    want = {(k, i, b" ".join(t.split()[i : i + 7])) for k, t in enumerate(texts) for i in range(len(t.split()) - 6)}
    assert {x[:3] for x in whole} == want and len(whole) == len(want)
    minimisers = {}
    for _, _, words, h in whole:
        assert minimisers.setdefault(words, h) == h
    monkeypatch.setattr(S, "PIECE", piece)
    assert windows() == whole


@pytest.mark.parametrize("piece", [16, 64])
def test_long_words_before_more_text_come_to_an_end(monkeypatch, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    few = [b"y" * 30] * 6  # fewer words than a window fill a piece
    texts = [b"x" * 500 + b" a b", b" ".join([*few, b"a b c"]), b" ".join(few * 5), b" " * 300 + b"a" * 90 + b"\n b " * 40]
    for text in texts:
        got, bound = [], 2 * len(text) // piece + 2
        for _, offset, cut in S.cut_pieces([0], [text], 7, 3):
            bound -= 1
            assert bound, "more pieces than the text has"
            for f, n, c in zip(cut.first, cut.number, cut.count):
                got += [(int(n + i + offset[0]), cut.joined[cut.start[f + i] : cut.end[f + i + 6]]) for i in range(c)]
        words = text.split()
        assert got == [(i, b" ".join(words[i : i + 7])) for i in range(len(words) - 6)]


def test_long_word_in_a_query(spark):
    long = "x" * (S.PIECE + 9) + " a b c d e"
    docs = [(1, long), (2, "y " + long), (3, "a b c d e")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(frame, window=5, m=2) == sorted(plain.removed_words(docs, 5), key=str)


def test_copies_of_a_row_do_not_multiply_its_spans(monkeypatch, spark):
    monkeypatch.setattr(S, "_kept", lambda batches, run=S._kept: run(_noted(batches)))

    def _noted(batches):
        for batch in batches:
            for row in batch.column(2).to_pylist():
                assert row is None or len({(r["begin"], r["end"]) for r in row}) == len(row)
            yield batch

    docs = [(1, "a b c d e f"), *[(2, "z a b c d e f")] * 8]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    first, second = plain.removed_words(docs, 5)
    assert found(frame, window=5, m=2) == [first, *[second] * 8]


def test_equal_hashes_of_different_windows(monkeypatch):
    # Hashes of one byte: almost all windows collide, the bytes decide.
    power = S._power
    monkeypatch.setattr(S, "_power", lambda name, base, size: power(name, base, size) * np.uint64(0))
    rnd = random.Random(5)
    words = [[rnd.choice("a b".split()) for _ in range(30)] for _ in range(6)]
    packed = [" ".join(w).encode() for w in words]
    doc = np.arange(6)
    row, begin, end = S.later_windows(doc, doc * 0, doc * 0, packed, window=4)
    got = {(r, i) for r, b, e in zip(row, begin, end) for i in range(b, e)}
    seen, want = set(), set()
    for d, w in enumerate(words):
        for i in range(27):
            key = tuple(w[i : i + 4])
            want |= {(d, j) for j in range(i, i + 4)} if key in seen else set()
            seen.add(key)
    assert got == want


def test_odd_rows(odd, odd_pairs):
    rows = found(odd, window=5, m=2)
    removed = {str(r[0]): r[2] for r in rows}
    assert len(rows) == 11
    # Rows that agree in identifier and text are one document; the earlier identifier keeps its words.
    assert removed["4"] == 0 and removed["5"] == 12 and removed["7"] == 0 and removed["None"] == 0
    assert S.remove_repeats(odd.limit(0)).count() == 0
