"""Quality by a factorisation machine.

Features of a text: its words, hashed into WORD_SLOTS slots and weighted by the logarithm of their
counts; structure statistics, each standardised and also cut into cells; and the metadata that may
be used, the length. The machine scores w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the
pairs cost linear time, as 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]. It is trained in numpy
by Adam steps on the logistic loss, in one task, on a bounded sample of SAMPLE_ROWS labelled rows;
scoring reads every whole text in one scan, with the weights by broadcast (under three megabytes).

Defined cases: null and empty texts have no words and the statistics of an empty text, and get a
score; texts may be of any length; without any labelled row all scores are 0.5; with labels of one
kind only the machine learns to prefer it; a document with several labels counts with each;
repeated rows and null identifiers keep their rows (a null identifier is in fold 0); extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fold

WORD_SLOTS = 1 << 15
FACTORS = 8
CELLS = 12
#: Labelled rows the machine is fitted to, chosen by a hash of the identifier.
SAMPLE_ROWS = 6000
EPOCHS = 6
BATCH = 128
RATE = 0.02
DECAY = 1e-4
THRESHOLD = 0.3

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_STATISTICS = (
    "log_chars log_words mean_word long_words one_letter upper lower digits spaces marks odd_marks not_ascii lines "
    "mean_line short_lines distinct_words distinct_lines most_frequent repeats_next ends_sentence pipes capitals "
    "joined_marks"
).split()


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure of a text, in the order of _STATISTICS; all finite, zeros for an empty one."""
    n, w = max(len(text), 1), max(len(words), 1)
    lines = text.split("\n") if text else []
    k = max(len(lines), 1)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    marks = int(by_byte[33:48].sum() + by_byte[58:65].sum() + by_byte[91:97].sum() + by_byte[123:127].sum())
    odd = int(by_byte[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]].sum())
    lower, upper = int(by_byte[97:123].sum()), int(by_byte[65:91].sum())
    lengths = np.array([len(x) for x in words] or [0])
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        float(lengths.mean()),
        float((lengths > 15).sum()) / w,
        float((lengths == 1).sum()) / w,
        upper / n,
        lower / n,
        int(by_byte[48:58].sum()) / n,
        int(by_byte[[9, 10, 11, 12, 13, 32]].sum()) / n,
        marks / n,
        odd / n,
        int((by_byte[192:]).sum()) / n,
        np.log1p(len(lines)),
        np.log1p(len(text) / k),
        sum(1 for x in lines if len(x) < 30) / k,
        len(counts) / w,
        len(set(lines)) / k,
        (max(counts.values()) if counts else 0) / w,
        sum(1 for a, b in zip(words, words[1:]) if a == b) / w,
        sum(1 for x in words if x[-1] in ".!?") / w,
        int(by_byte[124]) / w,
        sum(1 for x in words if x[0].isupper()) / w,
        sum(1 for x in words if not x[-1].isalnum() and not x[-1] in ".,;:!?)\"'") / w,
    ]


class _Slots(dict):
    """Slots of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = slot = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11) % WORD_SLOTS
        return slot


_slots = _Slots()


def read(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots of the distinct words, their values, statistics)."""
    text = text or ""
    words = _WORDS.findall(text)
    counts = Counter(words)
    slots = np.fromiter((_slots[w] for w in counts), dtype=np.int64, count=len(counts))
    values = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    norm = np.sqrt((values * values).sum())
    return slots, values / norm if norm else values, np.array(statistics(text, words, counts))


@dataclass
class Machine:
    """bias, weights w, factors v; mean, scale and cell bounds of the statistics."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bounds: np.ndarray

    def row(self, slots: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of all features of a text: words, statistics, their cells."""
        m = len(stats)
        level = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        cell = (stats[:, None] > self.bounds).sum(axis=1)
        first = WORD_SLOTS + m + np.arange(m) * CELLS
        index = np.concatenate([slots, WORD_SLOTS + np.arange(m), first + cell])
        return index, np.concatenate([values, level, np.full(m, 0.5)])

    def score(self, index: np.ndarray, x: np.ndarray) -> float:
        factors = self.v[index]
        inner = x @ factors
        pairs = 0.5 * float((inner * inner - (x * x) @ (factors * factors)).sum())
        z = self.bias + float(x @ self.w[index]) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str], labels: list[int], seed: int = 3) -> Machine:
    rows = [read(t) for t in texts]
    stats = np.array([r[2] for r in rows])
    m = stats.shape[1]
    rng = np.random.default_rng(seed)
    size = WORD_SLOTS + m + m * CELLS
    scale = stats.std(axis=0)
    shares = np.arange(1, CELLS) / CELLS
    machine = Machine(
        0.0, np.zeros(size), rng.standard_normal((size, FACTORS)) * 0.02, stats.mean(axis=0),
        np.where(scale > 1e-9, scale, 1.0), np.quantile(stats, shares, axis=0).T.copy(),
    )
    y = np.array(labels, dtype=np.float64)
    share = np.clip(y.mean(), 0.02, 0.98)
    machine.bias = float(np.log(share / (1 - share)))
    features = [machine.row(*r) for r in rows]
    mw, sw = np.zeros(size), np.zeros(size)
    mv, sv = np.zeros((size, FACTORS)), np.zeros((size, FACTORS))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            owner = np.repeat(np.arange(len(part)), [len(features[i][0]) for i in part])
            index = np.concatenate([features[i][0] for i in part])
            x = np.concatenate([features[i][1] for i in part])
            vx = machine.v[index] * x[:, None]
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            inner = np.add.reduceat(vx, heads)
            pairs = 0.5 * (inner**2 - np.add.reduceat(vx * vx, heads)).sum(axis=1)
            z = machine.bias + np.add.reduceat(machine.w[index] * x, heads) + pairs
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            machine.bias -= RATE * float(error.sum())
            own = error[owner]
            used, place = np.unique(index, return_inverse=True)
            gw = np.bincount(place, own * x, len(used)) + DECAY * machine.w[used]
            single = own[:, None] * (inner[owner] * x[:, None] - vx * x[:, None])
            gv = np.stack([np.bincount(place, single[:, f], len(used)) for f in range(FACTORS)], axis=1)
            gv += DECAY * machine.v[used]
            mw[used] += 0.1 * (gw - mw[used])
            sw[used] += 0.01 * (gw * gw - sw[used])
            mv[used] += 0.1 * (gv - mv[used])
            sv[used] += 0.01 * (gv * gv - sv[used])
            machine.w[used] -= RATE * mw[used] / (np.sqrt(sw[used]) + 1e-6)
            machine.v[used] -= RATE * mv[used] / (np.sqrt(sv[used]) + 1e-6)
    return machine


def fit(docs: DataFrame, labels: DataFrame, seed: int = 3) -> Machine | None:
    """Learn ``quality`` from labelled rows outside fold 0; None without any.

    The labels are few columns; the sample of identifiers is drawn from them first, and only its
    documents are fetched, by a broadcast of at most SAMPLE_ROWS identifiers.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(fold() != 0).select("doc_id", "quality")
    drawn = known.withColumn("o", F.xxhash64("doc_id", F.lit(seed))).orderBy("o", "doc_id", "quality").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("o", "text", "quality")
    rows = rows.orderBy("o", "quality", "text").limit(SAMPLE_ROWS)  # one task has the sample, whatever repeats

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        frame = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
        if len(frame):
            frame["text"] = frame["text"].fillna("")
            frame = frame.sort_values(["o", "quality", "text"], kind="stable")
            machine = train(frame["text"].tolist(), [int(q > 0) for q in frame["quality"]], seed)
            values = [np.array([machine.bias]), machine.w, machine.v, machine.mean, machine.scale, machine.bounds]
            yield pd.DataFrame({"parts": [[np.ascontiguousarray(v, dtype=np.float64).tobytes() for v in values]]})

    row = rows.coalesce(1).mapInPandas(run, "parts array<binary>").first()
    if row is None:
        return None
    bias, w, v, mean, scale, bounds = (np.frombuffer(bytes(p), dtype=np.float64) for p in row.parts)
    return Machine(float(bias[0]), w, v.reshape(-1, FACTORS), mean, scale, bounds.reshape(len(mean), -1))


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score, the probability of label 1, per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                scores = [0.5 if machine is None else machine.score(*machine.row(*read(t.as_py()))) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
