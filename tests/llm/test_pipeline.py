import plain
import tiktoken
import public_tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm import byte_bpe

FOLDER = "/root/testdata/sf0.001"


def test_against_brute_force(spark, documents, pairs):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [(d, t) for d, t in pairs if t and any(c.isalpha() for c in t)]
    last = {}
    for d, t in kept:
        last[t] = max(d, last.get(t, d))
    kept = [(d, t) for d, t in kept if last[t] == d]
    root = plain.linked({d: plain.simhash(t) for d, t in kept})
    kept = [(d, t) for d, t in kept if root[d] == d]
    dirty = {r[0] for r in plain.decontaminated(kept, items) if r[5]}
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    wanted = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: (len(wanted.encode_ordinary(t)), t) for d, t in kept if d not in dirty}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: (r.n_tokens, r.decoded) for r in rows} == want


def test_stages_take_odd_rows(spark, odd):
    for frame in (odd, odd.limit(0)):
        docs = frame
        for name, function in corpus_pipeline.STAGES:
            docs = function(spark, docs, FOLDER)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == frame.columns
        assert docs.count() <= 6


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
