import numpy as np

from corpusloom.llm import language_id as L
from corpusloom.llm.common import fold


def test_gradients_by_backpropagation_through_time():
    rng = np.random.default_rng(0)
    net = L.Network.fresh(["a", "b", "c"], hidden=3, seed=1)
    for group in (net.table, net.inner):
        group[:] = [x.astype(np.float64) for x in group]
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    data, labels = rng.integers(0, 6, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.gradients(data, labels)
    for value, grad in zip(net.parameters(), grads):
        for _ in range(4):
            at = tuple(int(rng.integers(0, min(s, 6))) for s in value.shape)
            old = value[at]
            value[at] = old + 1e-2
            above = net.gradients(data, labels)[0]
            value[at] = old - 1e-2
            below = net.gradients(data, labels)[0]
            value[at] = old
            assert abs((above - below) / 2e-2 - grad[at]) < 1e-4 + 0.02 * abs(grad[at])


def test_every_position_is_labelled_once():
    for n in (1, 63, 64, 65, 128, 200, 1000):
        raw = bytes(range(256)) * 4
        parts, begin, end = L.segments(raw[:n])
        assert b"".join(p[b:e].tobytes() for p, b, e in zip(parts, begin, end)) == raw[:n]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = L.fit(docs)
    assert network.languages == ["de", "en", "es", "fr"]
    rows = L.predict(docs, network).join(docs.select("doc_id", "lang"), "doc_id").filter(fold() == 0).collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    again = L.fit(docs)
    assert all((a == b).all() for a, b in zip(network.parameters(), again.parameters()))


def test_odd_rows(monkeypatch, odd):
    monkeypatch.setattr(L, "STEPS", 5)
    for docs, network in ((odd, L.fit(odd)), (odd, None), (odd.limit(0), L.fit(odd.limit(0)))):
        rows = L.predict(docs, network).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 8) or network is None) and 0 <= r.score <= 1
        kept = L.accept(docs, network)
        assert kept.columns == docs.columns
        assert kept.count() == min(docs.count(), 7)
