"""Language-model scores from an n-gram trie in Elias-Fano form, cut into shards by context.

Model. Unigrams are counted exactly over all training tokens. Every word, however rare, has its own
entry as a context and as a successor of each context it follows. Bigrams are smoothed by absolute
discounting over the unigrams, p(w | v) = (c(vw) - D) / c(v) + (D n(v) / c(v)) p(w), so all
probabilities of a context sum to one, up to the one-byte quantisation of the trie. The most
frequent words (at most FREQUENT) travel as short codes with their counts known everywhere, the
others as 64-bit hashes; this only decides how a word is written, not what the model holds. A caller
who wants a smaller model can ask for one: with ``most`` words, the others are one successor, which
they share by their unigrams. The query does not.

Work. Documents are taken in batches of BATCH_TOKENS tokens. A batch asks for each pair of
neighbours once, whatever documents share it, and sends with the question how often its training
documents have the pair. The questions travel to the shard of their context; the shard adds up
the counts of all batches, builds its trie, maps it into memory and answers every question of
every batch by successor search relative to the context. Rare successors have numbers of their own
in each shard, given by their hashes. The answers return to the batch, which adds them up per
document; for a rare successor they are the discounted share and the back-off weight of its context,
and its own count comes with the answer to the pair in which it is the context. So a pair or passage that a third of all documents share costs one
entry per batch. A context with very many tokens is cut into classes of its successors, each a
context of its own, with the probability of the class in front. Words without training tokens are
one word, the unseen one, in each class.

The order is two: a third level would need an entry for nearly every token of the corpus.

Defined cases: a null text counts as empty and has one token, the end; a null identifier is in
fold 0; repeated rows and identifiers keep their rows; without training documents all counts are
zero and every token has the share of the unseen word; an empty table gives an empty result; extra
columns are ignored. Rare words are told apart by 63 bits of their hashes.
"""

from __future__ import annotations

import struct
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import plain_text, stage
from corpusloom.llm.elias_fano import Trie

FREQUENT = 1 << 18
DISCOUNT = 0.75
BATCH_TOKENS = 1_000_000
#: Training tokens per shard, and tokens of a context beyond which it is cut into classes.
SHARD_TOKENS = 3_000_000
CONTEXT_TOKENS = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RARE_BIT = 1 << 63
_ALL_RARE = (1 << 64) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


# --- packed arrays -------------------------------------------------------------------------------


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as bytes, equal byte positions together, compressed."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<4sQ", a.dtype.str.encode().ljust(4), len(a)) for a in arrays)
    body = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (count,) = struct.unpack_from("<I", data)
    at, out = 4 + 12 * count, []
    for i in range(count):
        kind, n = struct.unpack_from("<4sQ", data, 4 + 12 * i)
        kind = np.dtype(kind.decode().strip())
        end = at + n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data[at:end], np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel())
        at = end
    return out


# --- unigrams ------------------------------------------------------------------------------------


def unigrams(docs: DataFrame, learn: Column) -> DataFrame:
    """word (bytes; the end is the empty word) and its number c in the documents to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                counts[b""] += 1
                if len(counts) > 300_000:
                    yield _counted(counts)
                    counts = Counter()
        if counts:
            yield _counted(counts)

    def _counted(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"]
        )

    seen = docs.filter(learn).select("text").mapInArrow(run, "word binary, c long")
    return seen.groupBy("word").agg(F.sum("c").alias("c"))


class Unigrams:
    """Codes and counts of the end (0) and the frequent words (1 to K); totals over all words.
    ``together``: as successors all others are one word."""

    def __init__(self, words: list[bytes], counts: list[int], ends: int, tokens: int, distinct: int, together: bool = False):
        self.codes = {w: i + 1 for i, w in enumerate(words)}
        self.counts = np.array([ends, *counts], dtype=np.int64)
        self.tokens, self.distinct, self.together = tokens, distinct, together
        self.rare, self.begin = len(words) + 1, len(words) + 2
        self.total = tokens + 0.5 * (distinct + 1)
        share = (self.counts + 0.5) / self.total
        #: By successor: end, frequent words, all others together.
        self.share = np.append(share, max(1.0 - float(share.sum()), 0.5 / self.total))
        uses = np.append(self.counts, [0, ends])
        uses[0] = 0  # nothing follows the end
        classes = np.maximum(1, -(-uses // CONTEXT_TOKENS))
        #: Classes of successors by context, powers of two.
        self.classes = 1 << np.ceil(np.log2(classes)).astype(np.int64)
        self.uses = uses
        #: Share of the words in each of the most classes, without the unseen word.
        self.mass = np.bincount(class_of(np.arange(self.rare)) & (self.most_classes - 1), share, self.most_classes)
        if together:
            self.mass[class_of(np.array([_ALL_RARE], dtype=np.uint64)) & (self.most_classes - 1)] += self.share[-1]

    @property
    def most_classes(self) -> int:
        return int(self.classes.max())

    def add_rare(self, group: list[int], counts: list[int], distinct: list[int]) -> None:
        """Numbers of tokens and of words that have no code, by class among the most classes."""
        share = (np.array(counts) + 0.5 * np.array(distinct)) / self.total
        self.mass += np.bincount(np.array(group, dtype=np.int64), share, self.most_classes)

    def masses(self, classes: int) -> np.ndarray:
        """Unigram share of each class, the unseen word in all of them."""
        return self.mass.reshape(-1, classes).sum(axis=0) + (0.0 if self.together else 0.5 / self.total)


def class_of(successor: np.ndarray) -> np.ndarray:
    """Class of a code or a hash; the lower bits are taken."""
    successor = successor.astype(np.uint64)
    mixed = np.where(successor >= np.uint64(_RARE_BIT), successor, (successor * _MIX) >> np.uint64(40))
    return (mixed & np.uint64(0xFFFFFF)).astype(np.int64)


def _frequent(words: DataFrame, most: int, together: bool = False) -> Unigrams:
    """Collect the frequent words of a stored table, which are written by codes: all with a count
    above a cut, at most ``most``. The others are summed by class where contexts are cut."""
    sums = words.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("c")))).first()
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = words.groupBy(level.alias("level")).count().collect()  # some hundred rows
    cut, room = 1 << 30, most
    for row in sorted(levels, key=lambda r: -r.level):
        room -= row["count"]
        if room < 0:
            break
        cut = row.level
    found = words.filter((level >= cut) & (F.length("word") > 0)).collect()
    found = sorted(((bytes(r.word), r.c) for r in found), key=lambda x: (-x[1], x[0]))
    model = Unigrams([w for w, _ in found], [c for _, c in found], sums[2] or 0, sums[0] or 0, sums[1], together)
    if model.most_classes > 1 and not together:
        group = F.xxhash64("word").bitwiseAND(F.lit(model.most_classes - 1))
        rare = words.filter((level < cut) & (F.length("word") > 0)).groupBy(group.alias("class"))
        rows = rare.agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()  # one row a class
        model.add_rare([r["class"] for r in rows], [r.c for r in rows], [r.n for r in rows])
    return model


# --- questions of a batch ------------------------------------------------------------------------

_ROWS = "batch long, shard int, kind int, blob binary"
_SCHEMA = pa.schema([("batch", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _questions(shared, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        number = TaskContext.get().partitionId() << 24
        documents, tokens = [], 0
        for batch in batches:
            for doc_id, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_of(text.as_py())
                documents.append((doc_id, learn, encode(words, model)))
                tokens += len(words) + 1
                if tokens >= BATCH_TOKENS:
                    yield _asked(number, documents, model, shards)
                    number, documents, tokens = number + 1, [], 0
        if documents:
            yield _asked(number, documents, model, shards)

    return run


def encode(words: list[bytes], model: Unigrams) -> np.ndarray:
    """Codes of the words; a rare one is its hash with the highest bit set."""
    get = model.codes.get
    return np.array([get(w) or (xxhash.xxh64_intdigest(w, 42) | _RARE_BIT) for w in words], dtype=np.uint64)


def numbered(successor: np.ndarray, hashes: np.ndarray, model: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """Codes with those of rare successors replaced by numbers from ``model.rare`` on, and the
    sorted hashes these numbers stand for. ``hashes`` belong to the rare ones in their order."""
    names, local = np.unique(hashes, return_inverse=True)
    successor[successor == model.rare] = model.rare + local
    return successor, names


def _asked(number: int, documents, model: Unigrams, shards: int) -> pa.RecordBatch:
    lengths = np.array([len(c) + 1 for _, _, c in documents], dtype=np.int64)
    heads = np.cumsum(lengths) - lengths
    context = np.empty(int(lengths.sum()), dtype=np.uint64)
    following = np.zeros(len(context), dtype=np.uint64)
    for (_, _, codes), head, n in zip(documents, heads.tolist(), lengths.tolist()):
        context[head] = model.begin
        context[head + 1 : head + n] = codes
        following[head : head + n - 1] = np.where(codes >= np.uint64(_RARE_BIT), np.uint64(_ALL_RARE), codes) if model.together else codes
    # What can be told without the shards: the unigrams of frequent words and ends.
    common = following < np.uint64(_RARE_BIT)
    successor = np.where(common, following, np.uint64(model.rare)).astype(np.int64)
    base = np.add.reduceat(np.where(common, np.log10(model.share)[successor], 0.0), heads)
    known = np.add.reduceat((common & (model.counts[np.minimum(successor, model.rare - 1)] > 0)).astype(np.int64), heads)
    # Contexts that are cut into classes carry the class above the lower 32 bits.
    own = np.minimum(context, np.uint64(model.begin)).astype(np.int64)
    cut = (context < np.uint64(_RARE_BIT)) & (model.classes[own] > 1)
    group = class_of(following) & (model.classes[own] - 1)
    context = np.where(cut, context | ((group + 1).astype(np.uint64) << np.uint64(32)), context)
    contexts, place = np.unique(context, return_inverse=True)
    successor, names = numbered(successor, following[~common], model)
    alphabet = model.rare + len(names)
    pairs, which = np.unique(place * alphabet + successor, return_inverse=True)
    learned = np.bincount(which, np.repeat(np.array([bool(x) for _, x, _ in documents]), lengths), len(pairs)).astype(np.uint32)
    pair_context, pair_successor = contexts[pairs // alphabet], pairs % alphabet
    mixed = (pair_context ^ (pair_context >> np.uint64(29))) * _MIX
    shard = ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    position = np.empty(len(order), dtype=np.uint32)
    position[order] = np.arange(len(order), dtype=np.uint32)
    ids = [d for d, _, _ in documents]
    own_blob = pack(
        [
            np.array([d if d is not None else 0 for d in ids], dtype=np.int64),
            np.array([d is None for d in ids], dtype=np.uint8),
            lengths, base, known, position[which],
        ]
    )
    rows = [(number, number % shards, 0, own_blob)]
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(ends)).tolist():
        part = order[ends[s] : ends[s + 1]]
        delta = np.diff(pair_context[part], prepend=np.uint64(0))
        asked = pair_successor[part]
        hashes = names[asked[asked >= model.rare] - model.rare]
        rows.append((number, s, 1, pack([delta, np.minimum(asked, model.rare).astype(np.uint32), learned[part], hashes])))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


# --- answers of a shard --------------------------------------------------------------------------


def smoothed(context, successor, count, model: Unigrams, rare: int = 1) -> Trie:
    """The trie of sorted distinct pairs with their (positive) training counts; ``rare`` numbers
    follow the codes."""
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, np.int64)
    contexts = context[first]
    size = np.diff(np.append(first, len(context)))
    uses = np.add.reduceat(count, first).astype(np.float64) if len(first) else np.empty(0)
    front, mass = fronts(contexts, uses, model)
    weights = front * DISCOUNT * size / np.maximum(uses, 1) / mass
    probabilities = np.repeat(front / np.maximum(uses, 1), size) * (count - DISCOUNT)
    return Trie.build(model.rare + rare, contexts, weights, first, successor, probabilities)


def fronts(contexts: np.ndarray, uses: np.ndarray, model: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """Of each context: probability of its class of successors, and their unigram share; 1 and 1
    unless the context is cut into classes. The unseen word is in each class."""
    front, mass = np.ones(len(contexts)), np.ones(len(contexts))
    cut = np.flatnonzero((contexts < np.uint64(_RARE_BIT)) & (contexts >= np.uint64(1 << 32)))
    own = (contexts[cut] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    group = (contexts[cut] >> np.uint64(32)).astype(np.int64) - 1
    shares: dict[int, np.ndarray] = {}
    for i, v, g in zip(cut.tolist(), own.tolist(), group.tolist()):
        k = int(model.classes[v])
        if k not in shares:
            shares[k] = model.masses(k)
        mass[i] = shares[k][g]
        front[i] = (uses[i] + mass[i] / shares[k].sum()) / (float(model.uses[v]) + 1)
    return front, mass


def _answers(shared):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        model = shared.value
        through = frame[frame["kind"] == 0]
        asked = frame[frame["kind"] == 1].sort_values("batch")
        if not len(asked):
            return through
        parts = [unpack(b) for b in asked["blob"]]
        sizes = [len(p[0]) for p in parts]
        context = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        successor = np.concatenate([p[1] for p in parts]).astype(np.int64)
        count = np.concatenate([p[2] for p in parts])
        successor, names = numbered(successor, np.concatenate([p[3] for p in parts]), model)
        rare, alphabet = len(names), model.rare + len(names)
        del parts, names
        contexts, place = np.unique(context, return_inverse=True)
        del context
        place *= alphabet
        place += successor
        del successor
        pairs, which = np.unique(place, return_inverse=True)
        del place
        total = np.bincount(which, count, len(pairs)).astype(np.int64)
        del count
        pair_context, pair_successor = contexts[pairs // alphabet], pairs % alphabet
        learned = np.flatnonzero(total)
        uses = np.bincount(pairs // alphabet, total, len(contexts))
        built = smoothed(pair_context[learned], pair_successor[learned], total[learned], model, rare)
        with tempfile.TemporaryDirectory() as folder:  # gone with the task
            built.save(folder)
            del built
            trie = Trie.open(folder, alphabet)
            probability, weight, known = trie.find(pair_context, pair_successor)
            del trie
        front, mass = fronts(contexts, uses, model)
        weight = np.where(known, weight, (front / mass)[pairs // alphabet])
        # Rare successors get their share at the batch, which learns their counts from other pairs.
        apart = pair_successor >= model.rare
        whole = np.log10(probability + weight * model.share[np.minimum(pair_successor, model.rare)])
        value, weight = np.where(apart, probability, whole).astype(np.float32), weight.astype(np.float32)
        # A rare word's own count comes with the pairs in which it is the context.
        own = np.where(pair_context >= np.uint64(_RARE_BIT), uses[pairs // alphabet], -1).astype(np.int64)
        blobs, at = [], 0
        for n in sizes:
            part = which[at : at + n]
            open_ = apart[part]
            blobs.append(pack([value[part], own[part], open_.astype(np.uint8), weight[part[open_]]]))
            at += n
        answered = pd.DataFrame({"batch": asked["batch"].to_numpy(), "shard": asked["shard"].to_numpy(), "kind": 1, "blob": blobs})
        return pd.concat([through, answered], ignore_index=True).astype({"kind": "int32", "shard": "int32"})

    return run


def _sums(total: float, together: float | None):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        (own,) = frame.loc[frame["kind"] == 0, "blob"]
        ids, null, lengths, base, known, which = unpack(own)
        parts = [unpack(b) for b in frame[frame["kind"] == 1].sort_values("shard")["blob"]]
        value = np.concatenate([p[0] for p in parts]).astype(np.float64)[which]
        rare = np.concatenate([p[1] for p in parts])[which]
        apart = np.concatenate([p[2] for p in parts]) > 0
        weight = np.zeros(len(apart))
        weight[apart] = np.concatenate([p[3] for p in parts])
        # A rare successor is the context of the next token of its document.
        at = np.flatnonzero(apart[which])
        own_share = (rare[at + 1] + 0.5) / total
        if together:
            value[at] = np.log10((value[at] + weight[which[at]] * together) * (own_share / together))
        else:
            value[at] = np.log10(value[at] + weight[which[at]] * own_share)
        share = np.where(rare >= 0, np.log10((np.maximum(rare, 0) + 0.5) / total), 0.0)
        heads = np.cumsum(lengths) - lengths
        return pd.DataFrame(
            {
                "doc_id": pd.array(ids, dtype="Int64").astype(object) if not null.any() else [None if z else int(i) for i, z in zip(ids, null)],
                "n_tokens": lengths,
                "n_known": known + np.add.reduceat((rare > 0).astype(np.int64), heads),
                "base_score": base + np.add.reduceat(share, heads),
                "score": np.add.reduceat(value, heads),
            }
        )

    return run


def score(docs: DataFrame, learn: Column, most: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``, by a
    model of the rows for which ``learn`` holds. Every word has transitions of its own, unless
    ``most`` says how many may have them as successors."""
    spark = docs.sparkSession
    words = stage(unigrams(docs, learn), "lm-unigrams")
    together = most is not None
    model = _frequent(words, most if together else FREQUENT, together)
    shards = max(8, -(-model.tokens // SHARD_TOKENS))
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("long"), learn.alias("_learn"), plain_text().alias("text"))
    asked = source.mapInArrow(_questions(shared, shards), _ROWS)
    answered = asked.groupBy("shard").applyInPandas(_answers(shared), _ROWS)
    summed = answered.groupBy("batch").applyInPandas(
        _sums(model.total, float(model.share[-1]) if together else None),
        "doc_id long, n_tokens long, n_known long, base_score double, score double",
    )
    return summed.select(
        "doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
