import binascii
import math

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lm_score as L
from corpusloom.llm.common import fold
from corpusloom.llm.elias_fano import EliasFano, Quantised, Trie


def learn(doc_id):
    return binascii.crc32(str(doc_id).encode()) % 5 != 1


@pytest.mark.parametrize("n, u", [(0, 10), (1, 5), (1, 1 << 64), (7, 1 << 64), (900, 1 << 64), (5000, 6000), (5000, 300)])
def test_sequences(n, u):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, u - 1, n, dtype=np.uint64, endpoint=True))
    sequence = EliasFano.build(values, u)
    if n:
        assert (sequence.access(np.arange(n)) == values).all()
    asked = np.concatenate([values, rng.integers(0, u - 1, 300, dtype=np.uint64, endpoint=True)])
    place, equal = sequence.find(asked)
    want = np.searchsorted(values, asked)
    assert (place == want).all()
    assert equal.tolist() == [i < n and values[i] == a for i, a in zip(want, asked)]


def test_trie_from_files(tmp_path):
    rng = np.random.default_rng(2)
    contexts = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    following = [np.unique(rng.integers(0, 500, rng.integers(1, 40))) for _ in contexts]
    first = np.cumsum([0, *map(len, following[:-1])])
    successors, owner = np.concatenate(following), np.repeat(np.arange(len(contexts)), list(map(len, following)))
    p, w = rng.random(len(successors)), rng.random(len(contexts))
    Trie.build(500, contexts, w, first, successors, p).save(str(tmp_path))
    trie = Trie.open(str(tmp_path), 500)
    got_p, got_w, known = trie.find(contexts[owner], successors)
    assert known.all() and np.abs(np.log10(got_p / p)).max() < 0.05 and np.abs(np.log10(got_w / w[owner])).max() < 0.05
    i, s = rng.integers(0, len(contexts), 2000), rng.integers(0, 500, 2000)
    got_p, _, _ = trie.find(contexts[i], s)
    assert [x > 0 for x in got_p] == [b in following[a] for a, b in zip(i, s)]
    assert trie.find(np.array([3], np.uint64), np.array([1]))[2].tolist() == [False]


def test_few_values_are_exact():
    numbers = np.array([0.5, 0.25, 0.5, 1e-9])
    assert np.allclose(Quantised.build(numbers).read(np.arange(4)), numbers, rtol=1e-12)


@pytest.mark.parametrize("most, cut, batch", [(1 << 18, 200_000, 1_000_000), (300, 200, 5_000)])
def test_scores(monkeypatch, documents, pairs, most, cut, batch):
    monkeypatch.setattr(L, "CONTEXT_TOKENS", cut)
    monkeypatch.setattr(L, "BATCH_TOKENS", batch)
    rows = {r.doc_id: r for r in L.score(documents, fold() != 1, most).collect()}
    base = plain.lm_base(pairs, learn)
    for d, (n, known, train, value) in base.items():
        assert (rows[d].n_tokens, rows[d].n_known, rows[d].train_tokens) == (n, known, train)
        assert math.isclose(rows[d].base_score, value, rel_tol=1e-9)
    frequent = {w.decode() for w in L._frequent(L.unigrams(documents, fold() != 1), most).codes}
    assert len(frequent) <= most
    want = plain.lm_bigram(pairs, learn, frequent, L.DISCOUNT)
    # Classes of successors change a context's probabilities; the quantisation costs little.
    assert max(abs(rows[d].score - want[d]) / rows[d].n_tokens for d in want) < (0.03 if cut == 200_000 else 0.3)
    held = [d for d in want if not learn(d)]
    assert sum(rows[d].score for d in held) > sum(rows[d].base_score for d in held)


def test_probabilities_of_a_context_sum_to_one():
    model = L.Unigrams([b"a", b"b", b"c"], [5, 3, 2], 4, 16, 6)
    pairs = [(1, 2, 3), (1, 4, 1), (2, 0, 2), (L._RARE_BIT + 9, 1, 1)]
    context, successor, count = (np.array(x, dtype=np.uint64) for x in zip(*pairs))
    trie = L.smoothed(context, successor.astype(np.int64), count.astype(np.int64), model)
    every = np.arange(model.rare + 1)
    for v in (1, 2, L._RARE_BIT + 9):
        p, weight, known = trie.find(np.full(len(every), v, dtype=np.uint64), every)
        assert known.all() and math.isclose((p + weight * model.share).sum(), 1.0, rel_tol=1e-6)


@pytest.mark.parametrize("codes, cut, batch", [(1 << 18, 200_000, 1_000_000), (300, 200_000, 5_000), (300, 200, 5_000)])
def test_every_word_has_transitions(monkeypatch, documents, pairs, codes, cut, batch):
    monkeypatch.setattr(L, "FREQUENT", codes)
    monkeypatch.setattr(L, "CONTEXT_TOKENS", cut)
    monkeypatch.setattr(L, "BATCH_TOKENS", batch)
    rows = {r.doc_id: r.score for r in L.score(documents, fold() != 1).collect()}
    tokens = {d: t and t.encode("utf-8", "surrogatepass").translate(L._LOWER).split() for d, t in pairs}
    every = {w.decode() for d, ws in tokens.items() if learn(d) for w in ws or []}
    assert len(every) > 10 * 300
    want = plain.lm_bigram(pairs, learn, every, L.DISCOUNT)
    # Classes of successors change a context's probabilities; the quantisation costs little.
    off = {d: abs(rows[d] - want[d]) / max(1, len(tokens[d] or [])) for d in want}
    assert max(off.values()) < (0.03 if cut == 200_000 else 0.3)


def test_a_rare_pair_seen_twice(spark):
    texts = {0: "a b", 1: "c d", 2: "c d", 3: "a c", 4: "c b"}
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(L, "FREQUENT", 0)  # no word has a code
        rows = {r.doc_id: r.score for r in L.score(docs, F.lit(True)).collect()}
    want = plain.lm_bigram(list(texts.items()), lambda d: True, set("abcd"), L.DISCOUNT)
    assert all(math.isclose(rows[d], want[d], abs_tol=1e-4) for d in texts)


def test_more_words_than_codes(spark):
    n = L.FREQUENT // 2 + 5_000  # two words in each document
    docs = spark.range(n).selectExpr("id doc_id", "concat('a', id, ' b', id) text")
    rows = {r.doc_id: r.score for r in L.score(docs, F.lit(True)).filter("doc_id % 1000 = 0").collect()}
    texts = [(i, f"a{i} b{i}") for i in range(n)]
    want = plain.lm_bigram(texts, lambda d: True, {w for _, t in texts for w in t.split()}, L.DISCOUNT)
    assert len(rows) == -(-n // 1000)
    assert max(abs(rows[d] - want[d]) for d in rows) < 0.01


def test_classes_of_rare_words(spark):
    docs = spark.createDataFrame([(i, f"the w{i} the w{i % 7}") for i in range(400)], "doc_id long, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(L, "CONTEXT_TOKENS", 50)
        model = L._frequent(L.unigrams(docs, F.lit(True)), 5)
    k = model.most_classes
    assert k > 8 and math.isclose(model.mass.sum() + 0.5 / model.total, 1.0, rel_tol=1e-9)
    want = np.zeros(k)
    counts = {b"": 400, b"the": 800}
    for i in range(400):
        for w in (b"w%d" % i, b"w%d" % (i % 7)):
            counts[w] = counts.get(w, 0) + 1
    for w, c in counts.items():
        code = L.encode([w], model) if w else np.zeros(1, np.uint64)
        want[L.class_of(code) & (k - 1)] += (c + 0.5) / model.total
    assert np.allclose(model.mass, want)
    # Over all classes of one context, its words and the unseen one of each class sum to one.
    classes = np.arange(k, dtype=np.uint64) + np.uint64(1) << np.uint64(32) | np.uint64(model.codes[b"the"])
    front, mass = L.fronts(classes, np.full(k, 800 / k), model)
    assert math.isclose(front.sum(), 1.0, rel_tol=1e-9) and math.isclose((front / mass * model.masses(k)).sum(), 1.0, rel_tol=1e-9)


def test_odd_rows(odd, odd_pairs):
    rows = L.score(odd, fold() != 1).collect()
    assert len(rows) == 11 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    want = [plain.lm_base([(0, t)], learn)[0][0] for _, t in odd_pairs]
    assert sorted(r.n_tokens for r in rows) == sorted(want)
    assert L.score(odd.limit(0), fold() != 1).count() == 0
    nothing = L.score(odd, fold() > 9).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in nothing) and len(nothing) == 11
