"""Byte-level BPE in padded numpy matrices.

A text is cut by the pattern of the vocabulary; each piece that the worker has not met yet is
encoded with many others at once. Pieces of similar length share a matrix of token ids, padded on
the right. In every round each row merges its leftmost pair of minimum rank: the ranks of
neighbouring pairs come from one hashed table, the merged column is closed up, and rows without a
pair left leave the matrix, which is compacted. The rank of a pair is the rank of its joined
bytes, whatever tokens it is made of, and a piece that is itself a token is taken as it is.

Pieces longer than LONG bytes would cost a round per merge on a wide matrix; they are merged with
a heap over linked neighbours, by the same rule, so that a text without any boundary stays cheap.

The ranks travel to the workers once, by broadcast: a vocabulary file, under a megabyte.

Defined cases: a null or empty text has no tokens; texts of any length are encoded whole; repeated
rows and null identifiers keep their rows; an empty table gives an empty result; extra columns are
kept by ``encode`` and ``decode`` unless named like the result columns, which replace them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = 256
#: Distinct pieces a worker remembers before it starts anew.
REMEMBERED = 150_000
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) to the rank of the joined bytes; open addressing, looked up in bulk."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            ((ranks[token[:i]] << 32) | ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.bits = max(4, (3 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, _NONE, dtype=np.int32)
        keys = np.array([k for k, _ in pairs], dtype=np.int64)
        values = np.array([v for _, v in pairs], dtype=np.int32)
        slots = self._slots(keys)
        todo = np.arange(len(keys))
        while len(todo):  # first comers take free slots, the rest moves on
            free = self.keys[slots[todo]] == -1
            candidates = todo[free]
            self.keys[slots[candidates]] = keys[candidates]
            won = candidates[self.keys[slots[candidates]] == keys[candidates]]
            self.values[slots[won]] = values[won]
            lost = np.ones(len(keys), dtype=bool)
            lost[won] = False
            todo = todo[lost[todo]]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        shape, keys = keys.shape, keys.ravel()
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], _NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out.reshape(shape)


def tokens_of(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of every token by its rank; all that decoding needs."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def decode(tokens: list[bytes], packed: bytes) -> bytes:
    return b"".join([tokens[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])


class Encoder:
    """A vocabulary of byte tokens: ``ranks`` of tokens, ``pattern`` that cuts the text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.cut = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.tokens = tokens_of(ranks)
        self.known: dict[str, bytes] = {}

    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of at most LONG bytes, length-bucketed."""
        out: list[np.ndarray] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            buckets.setdefault((len(piece) + 3) // 4 * 4, []).append(i)
        for width, members in buckets.items():
            step = max(1, 400_000 // width)
            for begin in range(0, len(members), step):
                self._merge_block([pieces[i] for i in members[begin : begin + step]], members[begin : begin + step], width, out)
        return out

    def _merge_block(self, pieces, rows, width, out) -> None:
        lengths = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        ids = self.byte_ids[data]
        ids[np.arange(width) >= lengths[:, None]] = -1
        rows = np.array(rows)
        ranks = np.full(ids.shape, _NONE, dtype=np.int32)
        inside = ids[:, 1:] >= 0
        ranks[:, :-1][inside] = self.pairs.rank(ids[:, :-1][inside], ids[:, 1:][inside])
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of equal ranks
            every = np.arange(len(rows))
            best = ranks[every, at]
            done = best == _NONE
            if done.any():
                for row, line, n in zip(rows[done].tolist(), ids[done], lengths[done].tolist()):
                    out[row] = line[:n].copy()
                going = ~done
                rows, ids, ranks, lengths, at, best = rows[going], ids[going], ranks[going], lengths[going], at[going], best[going]
                if not len(rows):
                    break
                wide = int(lengths.max())
                ids, ranks = ids[:, :wide], ranks[:, :wide]
                every = np.arange(len(rows))
            columns = np.arange(ids.shape[1] - 1)
            source = columns + (columns > at[:, None])
            merged = np.take_along_axis(ids, source, axis=1)
            merged[every, np.minimum(at, merged.shape[1] - 1)] = best
            follow = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            ids, ranks, lengths = merged, follow, lengths - 1
            for shift in (-1, 0):  # only the two pairs of the new token have other ranks
                left = at + shift
                valid = (left >= 0) & (left + 1 < lengths)
                here = every[valid]
                ranks[here, left[valid]] = self.pairs.rank(ids[here, left[valid]], ids[here, left[valid] + 1])
            last = at >= lengths - 1
            ranks[every[last], at[last]] = _NONE

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges on one long piece: a heap of (rank, place) over linked neighbours."""
        get, tokens = self.ranks.get, self.tokens
        ids = [int(i) for i in self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]]
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        heap = []
        for i in range(len(ids) - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for p, q in ((before[i], i), (i, k)):
                if p >= 0 and q >= 0:
                    rank = get(tokens[ids[p]] + tokens[ids[q]])
                    if rank is not None:
                        heapq.heappush(heap, (rank, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not met yet; values are little-endian unsigned 32-bit ids."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known.clear()
        names, data = [], []
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.known[piece] = np.array(self.merge_long(raw), dtype="<u4").tobytes()
            else:
                names.append(piece)
                data.append(raw)
        for name, ids in zip(names, self.merge_matrix(data)):
            self.known[name] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, packed little-endian."""
        cut = [self.cut(t) if t else [] for t in texts]
        fresh: set[str] = set()
        known = self.known
        for pieces in cut:
            fresh.update(pieces)
        if len(fresh) + len(known) > REMEMBERED:
            known.clear()
        self.learn({p for p in fresh if p not in known})
        return [b"".join([known[p] for p in pieces]) for pieces in cut]

    def decode(self, packed: bytes) -> bytes:
        return decode(self.tokens, packed)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_encoders: dict[str, Encoder] = {}


def _encoder(shared, pattern: str, key: str) -> Encoder:
    """One per vocabulary and worker process, so that pieces are remembered between tasks. The
    key is a digest of the vocabulary and the pattern."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value, pattern)
    return _encoders[key]


class Tokenizer:
    """``encode`` and ``decode`` of DataFrames with the vocabulary file at ``path``."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        self.shared = spark.sparkContext.broadcast(ranks)
        self.pattern = pattern
        self.key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    def encode(self, docs: DataFrame, text: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
        """``docs`` with n_tokens and ids (packed little-endian, four bytes each)."""
        shared, pattern, key = self.shared, self.pattern, self.key
        made = ["n_tokens", "ids", *(["decoded"] if decoded else [])]
        others = [c for c in (docs.columns if keep is None else keep) if c not in made]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = _encoder(shared, pattern, key)
            for whole in batches:
                for begin in range(0, whole.num_rows, 500):
                    batch = whole.slice(begin, 500)
                    ids = encoder.encode(batch.column("_text").to_pylist())
                    columns = [batch.column(i) for i in range(len(others))]
                    columns += [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                    if decoded:
                        columns.append(pa.array([encoder.decode(i) for i in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=[*others, *made])

        source = docs.select(*[F.col(f"`{c}`") for c in others], F.col(text).alias("_text"))
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
        ddl = (ddl + ", " if ddl else "") + "n_tokens long, ids binary"
        return source.mapInArrow(run, ddl + ", decoded binary" if decoded else ddl)

    def round_trip(self, docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """``docs`` with n_tokens, ids and decoded, the bytes that the ids stand for: ``encode`` and
        ``decode`` in one worker, which holds the vocabulary once."""
        return self.encode(docs, text, keep, decoded=True)

    def decode(self, encoded: DataFrame, ids: str = "ids") -> DataFrame:
        """``encoded`` with ``decoded``, the bytes that the ids stand for."""
        shared = self.shared
        others = [c for c in encoded.columns if c != "decoded"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = tokens_of(shared.value)
            for whole in batches:
                for begin in range(0, whole.num_rows, 500):
                    batch = whole.slice(begin, 500)
                    decoded = [decode(tokens, i.as_py() or b"") for i in batch.column(ids)]
                    columns = [batch.column(i) for i in range(batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(decoded, pa.binary())], names=[*others, "decoded"])

        source = encoded.select(*[F.col(f"`{c}`") for c in others])
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
        return source.mapInArrow(run, ddl + ", decoded binary")
