"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads segments of SEGMENT bytes in both directions, labels every byte position with
probabilities of the languages, and the probabilities of a document are the mean over all its
positions. It is written and trained in numpy: forward pass, backpropagation through time and Adam
steps, in one task, on a bounded sample (SAMPLE_ROWS rows per language, EXCERPTS segments of
each). Scoring reads every byte of every text; weights travel by broadcast (some ten kilobytes).

Only the text is an input of a prediction. Training rows are those with a text and a language
whose fold is not 0.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if
no row can be learned from; with a single language all texts with a letter get it; texts shorter
than a segment are padded with spaces that do not count; the last segment of a text reaches back
over bytes that are labelled already and do not count twice; repeated rows and null identifiers
keep their rows (a null identifier is in fold 0); extra columns are kept by ``accept`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fold

HIDDEN = 8
SEGMENT = 64
#: Training rows per language and segments per row: the bound of the sample.
SAMPLE_ROWS = 600
EXCERPTS = 4
#: Languages that can be learned.
MOST_LANGUAGES = 200
STEPS = 160
BATCH = 256
RATE = 0.02
#: Segments that are read side by side when scoring.
ABREAST = 2048
UNDETERMINED = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Per direction: ``table`` (byte to gate inputs), ``inner`` (state to gate inputs). Gates in
    the order reset, update, candidate. ``out`` and ``bias`` give the label of a position."""

    languages: list[str]
    table: list[np.ndarray]
    inner: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            languages,
            [draw(256, 3 * hidden, scale=0.3) for _ in range(2)],
            [draw(hidden, 3 * hidden, scale=0.3) for _ in range(2)],
            draw(2 * hidden, len(languages), scale=0.3),
            np.zeros(len(languages), dtype=np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.inner, self.out, self.bias]

    def states(self, data: np.ndarray, direction: int, keep: list | None = None) -> np.ndarray:
        """State at every position of ``data`` (time, segments); direction 1 reads backwards."""
        steps, width = data.shape
        table, inner = self.table[direction], self.inner[direction]
        h = inner.shape[0]
        state = np.zeros((width, h), dtype=np.float32)
        out = np.empty((steps, width, h), dtype=np.float32)
        for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
            given = table[data[t]]
            carried = state @ inner
            gates = _sigmoid(given[:, : 2 * h] + carried[:, : 2 * h])
            reset, update = gates[:, :h], gates[:, h:]
            new = carried[:, 2 * h :] * reset
            new += given[:, 2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, state.copy(), reset, update, new.copy(), carried[:, 2 * h :]))
            state -= new
            state *= update
            state += new
            out[t] = state
        return out

    def probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        h = forward.shape[-1]
        scores = forward @ self.out[:h]
        scores += backward @ self.out[h:]
        scores += self.bias
        scores -= scores.max(axis=-1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=-1, keepdims=True)
        return scores

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions and its gradients by backpropagation through time."""
        steps, width = data.shape
        kept: list[list] = [[], []]
        both = [self.states(data, d, kept[d]) for d in (0, 1)]
        p = self.probabilities(*both)
        at = np.arange(width)
        loss = float(-np.log(np.maximum(p[:, at, labels], 1e-9)).mean())
        p[:, at, labels] -= 1
        p /= steps * width
        h = both[0].shape[-1]
        flat = p.reshape(-1, p.shape[-1])
        grad_out = np.concatenate([b.reshape(-1, h).T @ flat for b in both])
        grads: list[np.ndarray] = [np.zeros_like(x) for x in self.table + self.inner]
        for d in (0, 1):
            above = p @ self.out[d * h : (d + 1) * h].T
            table, inner, weights = grads[d], grads[2 + d], self.inner[d]
            back = np.zeros((width, h), dtype=np.float32)
            for t, before, reset, update, new, carried in reversed(kept[d]):
                back += above[t]
                d_new = back * (1 - update) * (1 - new * new)
                d_update = back * (before - new) * update * (1 - update)
                d_reset = d_new * carried * reset * (1 - reset)
                d_given = np.concatenate([d_reset, d_update, d_new], axis=1)
                d_carried = np.concatenate([d_reset, d_update, d_new * reset], axis=1)
                np.add.at(table, data[t], d_given)
                inner += before.T @ d_carried
                back = back * update + d_carried @ weights.T
        return loss, [*grads, grad_out, flat.sum(axis=0)]


def segments(raw: bytes, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text (n, length) and the positions [begin, end) of each that count."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if len(data) < length:
        padded = np.full(length, 32, dtype=np.uint8)
        padded[: len(data)] = data
        return padded[None, :], np.array([0]), np.array([len(data)])
    whole = len(data) // length
    parts = data[: whole * length].reshape(whole, length)
    rest = len(data) - whole * length
    begin = np.zeros(whole + (rest > 0), dtype=np.int64)
    if rest:
        parts = np.concatenate([parts, data[None, -length:]])
        begin[-1] = length - rest
    return parts, begin, np.full(len(begin), length)


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 5) -> Network:
    """Fit a network to excerpts of the texts."""
    languages = sorted(set(labels))
    network = Network.fresh(languages, seed=seed)
    number = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    parts, owners = [], []
    for text, label in zip(texts, labels):
        own, _, _ = segments(text)
        chosen = rng.choice(len(own), min(EXCERPTS, len(own)), replace=False)
        parts.append(own[chosen])
        owners.extend([number[label]] * len(chosen))
    data, owner = np.concatenate(parts), np.array(owners)
    by_label = [np.flatnonzero(owner == i) for i in range(len(languages))]
    values = network.parameters()
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        # Languages by turns, so that a rare one counts as much as a common one.
        kinds = rng.integers(0, len(languages), BATCH)
        rows = np.array([by_label[k][rng.integers(0, len(by_label[k]))] for k in kinds])
        _, grads = network.gradients(np.ascontiguousarray(data[rows].T), kinds)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 3 * (1 - step / (steps + 1)))
        for v, g, m, s in zip(values, grads, first, second):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return network


def pooled(network: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all positions of each (non-empty) text."""
    cut = [segments(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c[1]) for c in cut])
    data = np.concatenate([c[0] for c in cut])
    begin, end = np.concatenate([c[1] for c in cut]), np.concatenate([c[2] for c in cut])
    total = np.zeros((len(texts), len(network.languages)))
    steps = np.arange(data.shape[1])[:, None]
    for at in range(0, len(data), ABREAST):
        part = np.ascontiguousarray(data[at : at + ABREAST].T)
        p = network.probabilities(network.states(part, 0), network.states(part, 1))
        b, e = begin[at : at + ABREAST], end[at : at + ABREAST]
        odd = np.flatnonzero((b > 0) | (e < len(steps)))
        p[:, odd] *= ((steps >= b[odd]) & (steps < e[odd]))[:, :, None]
        np.add.at(total, owner[at : at + ABREAST], p.sum(axis=0))
    return total / np.array([max(len(t), 1) for t in texts])[:, None]


def fit(docs: DataFrame, seed: int = 5) -> Network | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) outside fold 0; None without any."""
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND text <> ''").filter(fold() != 0)
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return None
    # Rows in the order of a hash; the shares leave about twice the wanted number to sort.
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 2 * SAMPLE_ROWS / n))])
    some = rows.filter(F.pmod(order, F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).select("lang", "text", order.alias("o"))
    # At most EXCERPTS segments of a text are used; a long one lends those at hashed places.
    spread = [F.expr(f"substring(text, cast(1 + pmod(xxhash64(o, {i}), greatest(length(text) - {SEGMENT}, 1)) as int), {SEGMENT})") for i in range(EXCERPTS)]
    excerpt = F.when(F.length("text") <= SEGMENT * EXCERPTS, F.col("text")).otherwise(F.concat(*spread))
    some = some.select("lang", excerpt.alias("text"), "o").orderBy("o", "lang", "text").limit(2 * SAMPLE_ROWS * len(counts))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f for f in frames], ignore_index=True).sort_values(["o", "lang", "text"], kind="stable")
        frame = frame.groupby("lang", sort=True).head(SAMPLE_ROWS)
        if len(frame):
            network = train([t.encode("utf-8", "surrogatepass") for t in frame["text"]], frame["lang"].tolist(), seed=seed)
            parts = [np.ascontiguousarray(v, dtype=np.float32).tobytes() for v in network.parameters()]
            yield pd.DataFrame({"languages": ["\n".join(network.languages)], "parts": [parts]})

    row = some.coalesce(1).mapInPandas(run, "languages string, parts array<binary>").first()
    if row is None:
        return None
    network = Network.fresh(row.languages.split("\n"))
    shaped = [np.frombuffer(bytes(b), dtype=np.float32).reshape(v.shape).copy() for b, v in zip(row.parts, network.parameters())]
    return Network(network.languages, shaped[:2], shaped[2:4], shaped[4], shaped[5])


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = [i for i, ok in enumerate(batch.column(2).to_pylist()) if ok]
                names, scores = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
                if rows and network is not None:
                    column = batch.column(1)
                    p = pooled(network, [column[i].as_py().encode("utf-8", "surrogatepass") for i in rows])
                    for i, best, score in zip(rows, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                        names[i], scores[i] = network.languages[best], min(score, 1.0)
                columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    source = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(_predict(shared), f"doc_id {kind}, lang_pred string, score double")


def accept(docs: DataFrame, network: Network | None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a score of at least ``least``, all
    columns as they are. Rows are decided one by one, without a join. If nothing could be learned
    (``network`` is None), every text with a letter stays."""
    if network is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    others = docs.columns
    text = others.index("text")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    inner = _predict(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                numbered = pa.RecordBatch.from_arrays(
                    [pa.array(range(batch.num_rows), pa.int64()), batch.column(text), batch.column(batch.num_columns - 1)],
                    names=["doc_id", "text", "letters"],
                )
                for part in inner(iter([numbered])):
                    names, scores = part.column(1).to_pylist(), part.column(2).to_pylist()
                    keep = pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores)])
                    kept = batch.filter(keep)
                    yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=others)

    return docs.select("*", letters).mapInArrow(run, docs.schema)
