"""Sub-word tokenising against a fixed vocabulary, by a double-array trie.

The trie holds the bytes of all tokens in two flat arrays: from state ``s`` byte ``b`` leads to slot
``base[s] + b`` if ``check`` of that slot is ``s``. Continuations start at the state of ``##``. A
batch of token arrays is reduced to its distinct words, which are matched all at once: every step
follows one byte of every word that is still open. The pieces are then put back by position, so a
word costs the same however often it occurs, and no Python code runs per word.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import basic_tokens

#: Bound of what is broadcast: bytes of all tokens of a vocabulary.
MAX_BYTES = 256 << 20
MARK, UNKNOWN, LONGEST = "##", "[UNK]", 200
#: A node with several children is tried at so many places before it goes to the end.
TRIES = 64


@dataclass(frozen=True)
class Trie:
    """base, check and token number (-1: none) per slot; slot 0 is the root. ``tokens`` by number."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    ids: np.ndarray
    tokens: pa.Array
    unknown: int

    @classmethod
    def of(cls, tokens: list[str], ids: list[int]) -> Trie:
        """Distinct tokens and their ids; ``UNKNOWN`` must be one of them."""
        data = [t.encode() for t in tokens]
        order = sorted((i for i in range(len(data)) if data[i]), key=data.__getitem__)
        return cls(*_slots(data, np.array(order, dtype=np.int64)), np.array(ids, dtype=np.int64), pa.array(tokens, pa.string()), tokens.index(UNKNOWN))

    def follow(self, data: bytes) -> int:
        """The state after ``data``, -1 if no token begins so."""
        state = 0
        for byte in data:
            slot = self.base[state] + byte
            if not 0 <= slot < len(self.check) or self.check[slot] != state:
                return -1
            state = int(slot)
        return state

    def split(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of distinct ``words``: number of pieces of each, and all pieces in
        order as token numbers. A word that cannot be covered, or is too long, is unknown as a whole."""
        bounds = np.frombuffer(words.buffers()[1], dtype=np.int32, count=len(words) + 1 + words.offset)[words.offset :].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
        ends = bounds[1:]
        bad = pc.greater(pc.utf8_length(words), LONGEST).to_numpy(zero_copy_only=False)
        at, found = bounds[:-1].copy(), []
        open_words = np.flatnonzero(~bad & (at < ends))
        start = 0
        for step in count():
            if not len(open_words):
                break
            best_end, best = self._longest(data, at[open_words], ends[open_words], start)
            bad[open_words[best < 0]] = True
            open_words, best_end, best = open_words[best >= 0], best_end[best >= 0], best[best >= 0]
            found.append((open_words, np.full(len(open_words), step), best))
            at[open_words] = best_end
            open_words = open_words[best_end < ends[open_words]]
            start = self.follow(MARK.encode())
            if start < 0:
                bad[open_words] = True
                break
        lost = np.flatnonzero(bad)
        found = [tuple(c[~bad[rows[0]]] for c in rows) for rows in found]
        found.append((lost, np.zeros(len(lost), dtype=np.int64), np.full(len(lost), self.unknown)))
        word, step, piece = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((step, word))
        return np.bincount(word, minlength=len(words)), piece[order]

    def _longest(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        state = np.full(len(at), start, dtype=np.int64)
        best_end, best = at.copy(), np.full(len(at), -1, dtype=np.int64)
        alive, at = np.arange(len(at)), at.copy()
        while len(alive):
            slot = self.base[state[alive]] + data[at[alive]]
            on = (slot >= 0) & (slot < len(self.check))
            on[on] = self.check[slot[on]] == state[alive][on]
            alive, slot = alive[on], slot[on]
            state[alive] = slot
            at[alive] += 1
            token = self.value[slot]
            whole = alive[token >= 0]
            best[whole], best_end[whole] = token[token >= 0], at[whole]
            alive = alive[at[alive] < ends[alive]]
        return best_end, best


def _slots(data: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arrays of the trie over ``data``, whose sorted order is given; built level by level."""
    lengths = np.array([len(data[i]) for i in order], dtype=np.int64)
    flat = np.frombuffer(b"".join(data[i] for i in order), dtype=np.uint8)
    starts = np.cumsum(lengths) - lengths
    used, base, check = bytearray(512), np.full(512, -1024, dtype=np.int64), np.full(512, -1, dtype=np.int64)
    value = np.full(512, -1, dtype=np.int64)
    used[0] = 1
    node = np.zeros(len(order), dtype=np.int64)  # the state of each token so far
    low, depth, open_tokens = 1, 0, np.arange(len(order))

    def grow(size: int) -> None:
        nonlocal base, check, value
        more = max(size, 2 * len(base)) - len(base)
        used.extend(bytes(more))
        base = np.append(base, np.full(more, -1024, dtype=np.int64))
        check, value = (np.append(a, np.full(more, -1, dtype=np.int64)) for a in (check, value))

    while len(open_tokens):
        byte = flat[starts[open_tokens] + depth].astype(np.int64)
        parents = node[open_tokens]
        # tokens are sorted, so those of one parent lie together, in the order of their bytes
        new = np.append(True, (np.diff(parents) != 0) | (np.diff(byte) != 0))
        child_parent, child_byte = parents[new], byte[new]
        first = np.flatnonzero(np.append(True, np.diff(child_parent) != 0))
        sizes = np.diff(np.append(first, len(child_parent)))
        slots = np.empty(len(child_parent), dtype=np.int64)
        for begin, size in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            labels = child_byte[begin : begin + size].tolist()
            while used[low]:
                low += 1
                if low == len(used):
                    grow(low + 512)
            place, tries = low, 0
            while True:
                if place + 256 >= len(used):
                    grow(place + 512)
                offset = place - labels[0]
                if not used[place] and not any(used[offset + b] for b in labels):
                    break
                place, tries = place + 1, tries + 1
                if tries == TRIES:
                    place = max(place, used.rfind(1) + 1)
            for i, b in enumerate(labels):
                used[offset + b] = 1
                slots[begin + i] = offset + b
        single = first[sizes == 1]
        free = np.flatnonzero(np.frombuffer(used, dtype=np.uint8) == 0)
        while len(free) < len(single):
            grow(len(used) + len(single))
            free = np.flatnonzero(np.frombuffer(used, dtype=np.uint8) == 0)
        slots[single] = free[: len(single)]
        for slot in slots[single].tolist():
            used[slot] = 1
        base[child_parent] = slots - child_byte
        check[slots] = child_parent
        node[open_tokens] = slots[np.cumsum(new) - 1]
        depth += 1
        ended = lengths[open_tokens] == depth
        value[node[open_tokens[ended]]] = order[open_tokens[ended]]
        open_tokens = open_tokens[~ended]
    return base, check, value


def trie_of(vocab: DataFrame) -> Trie:
    """The trie of a vocabulary (token, id). It is the model, which every task needs whole: its size
    is checked first."""
    size = vocab.agg(F.sum(F.octet_length("token"))).first()[0] or 0
    if size > MAX_BYTES:
        raise ValueError(f"a word-piece vocabulary may hold at most {MAX_BYTES} bytes")
    rows = vocab.select("token", "id").orderBy("id").collect()
    return Trie.of([r.token for r in rows], [r.id for r in rows])


def split_word(word: str, vocab, unknown: str = UNKNOWN, longest: int = LONGEST) -> list[str]:
    """The rule for one word: greedy longest match; a word that cannot be covered is unknown as a whole."""
    if len(word) > longest:
        return [unknown]
    pieces, rest, mark = [], word, ""
    while rest:
        size = next((n for n in range(len(rest), 0, -1) if mark + rest[:n] in vocab), 0)
        if not size:
            return [unknown]
        pieces.append(mark + rest[:size])
        rest, mark = rest[size:], MARK
    return pieces


def _split_lists(trie: Trie, words: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """New bounds of the lists, and the pieces as token numbers."""
    flat = words.flatten().dictionary_encode()
    sizes, pieces = trie.split(flat.dictionary.cast(pa.string()))
    of_word = np.append(0, np.cumsum(sizes))
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    repeated = sizes[codes]
    ends = np.append(0, np.cumsum(repeated))
    # the places of all pieces of all words, one after the other
    spread = np.arange(ends[-1]) - np.repeat(ends[:-1] - of_word[codes], repeated)
    per_row = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    bounds = ends[np.append(0, np.cumsum(per_row))]
    missing = words.is_null().to_numpy(zero_copy_only=False)
    return pa.array(bounds.astype(np.int32), mask=np.append(missing, False)), pieces[spread]


def word_pieces(spark: SparkSession, trie: Trie, words: Column) -> Column:
    """Token array -> piece array."""
    shared = spark.sparkContext.broadcast(trie)

    @F.arrow_udf("array<string>")
    def split(batch: pa.Array) -> pa.Array:
        bounds, pieces = _split_lists(shared.value, batch)
        return pa.ListArray.from_arrays(bounds, shared.value.tokens.take(pa.array(pieces)))

    # declared nondeterministic so that a filter on the result does not split everything again
    return split.asNondeterministic()(words)


def piece_ids(spark: SparkSession, trie: Trie, words: Column) -> Column:
    """Token array -> ids of its pieces."""
    shared = spark.sparkContext.broadcast(trie)

    @F.arrow_udf("array<int>")
    def split(batch: pa.Array) -> pa.Array:
        bounds, pieces = _split_lists(shared.value, batch)
        return pa.ListArray.from_arrays(bounds, pa.array(shared.value.ids[pieces].astype(np.int32)))

    # declared nondeterministic so that a filter on the result does not split everything again
    return split.asNondeterministic()(words)


def full_tokens(spark: SparkSession, trie: Trie, text: Column, lower: bool = True) -> Column:
    """Basic tokens, then word pieces."""
    return word_pieces(spark, trie, basic_tokens(text, lower))


def full_token_ids(spark: SparkSession, trie: Trie, text: Column, lower: bool = True) -> Column:
    """Basic tokens, then the ids of their word pieces."""
    return piece_ids(spark, trie, basic_tokens(text, lower))
