"""Fixed-width sequences: padding, special ids, masks and windows over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.columns import indices

# The reserved ids of the vocabulary kinds.
PAD, UNK, EOS, SOS, MASK = 0, 1, 2, 3, 4
CHAR_BOS, CHAR_EOS, CHAR_BOW, CHAR_EOW, CHAR_PAD = 256, 257, 258, 259, 260
CHAR_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-,;.!?:'\"/\\|_@#$%^&*~`+-=<>()[]{}"


def ints(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def pad(ids: Column, width: int, filler: int = PAD) -> Column:
    """Cut to ``width`` or fill up on the right."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(filler).cast("int"), width)), 1, width)


def with_specials(ids: Column, sos: int | None = SOS, eos: int | None = EOS) -> Column:
    parts = [ids]
    if eos is not None:
        parts.append(ints(eos))
    if sos is not None:
        parts.insert(0, ints(sos))
    return F.concat(*parts)


def without_ids(ids: Column, *specials: int) -> Column:
    return F.filter(ids, lambda i: ~i.isin(*specials))


def lm_encode(ids: Column, bos: int, eos: int, backward: bool = False) -> Column:
    """Sentence ids between boundary marks; the backward form swaps the marks."""
    first, last = (eos, bos) if backward else (bos, eos)
    return F.concat(ints(first), ids, ints(last))


def presence_mask(ids: Column, filler: int = PAD) -> Column:
    return F.transform(ids, lambda i: (i != filler).cast("int"))


def causal_mask(width: Column) -> Column:
    """Row ``i`` may look at positions ``0..i``."""
    return F.transform(
        indices(width), lambda i: F.transform(indices(width), lambda j: (j <= i).cast("int"))
    )


def target_mask(ids: Column, filler: int = PAD) -> Column:
    """Causal mask with padding hidden."""
    return F.transform(
        indices(F.size(ids)),
        lambda i: F.transform(ids, lambda value, j: ((value != filler) & (j <= i)).cast("int")),
    )


def shift_right(ids: Column) -> tuple[Column, Column]:
    """Decoder input (all but the last) and labels (all but the first)."""
    length = F.size(ids)
    rest = F.greatest(length - 1, F.lit(0))
    return F.slice(ids, F.lit(1), rest), F.slice(ids, F.lit(2), rest)


def one_hot(index: Column, width: int) -> Column:
    return F.transform(indices(F.lit(width)), lambda i: (i == index).cast("int"))


def char_one_hot(index: Column, width: int) -> Column:
    """Padding (0) is the zero vector, id ``k`` sets component ``k - 1``."""
    return one_hot(index - 1, width)


def char_one_hot_digits(index: Column, width: int) -> Column:
    """``char_one_hot`` as a string of digits, from a constant table of its rows."""
    rows = ["".join("01"[i == k - 1] for i in range(width)) for k in range(width + 1)]
    return F.coalesce(F.get(F.lit(rows), index), F.lit("0" * width))


def gather(values: Column, positions: Column) -> Column:
    return F.transform(positions, lambda p: F.get(values, p))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def best_positions(values: Column, n: int) -> Column:
    """The ``n`` positions of largest value; equal values keep their order."""
    ranked = F.sort_array(F.transform(values, lambda v, i: F.struct((-v).alias("k"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: s["i"])


def pair_lengths(a: Column, b: Column, limit: int) -> tuple[Column, Column]:
    """Lengths kept when the longer side loses its end until both fit (a tie shortens b).

    Closed form of the one-token-at-a-time loop.
    """
    half_up, half_down = (limit + 1) // 2, limit // 2
    fits = a + b <= limit
    a_short = (a <= half_up) & (b > limit - a)
    b_short = b <= half_down
    keep_a = F.when(fits | a_short, a).when(b_short, limit - b).otherwise(half_up)
    keep_b = F.when(fits, b).when(a_short, limit - a).when(b_short, b).otherwise(half_down)
    return keep_a, keep_b


def char_index(text_chars: Column, width: int, alphabet: str = CHAR_ALPHABET) -> Column:
    """Characters as ids: padding 0, unknown 1, alphabet from 2; a repeated letter keeps its last id."""
    ids = {c: i for i, c in enumerate(alphabet, start=2)}
    keys = "".join(ids)
    # the id of a letter is found by its place among the distinct letters
    places = F.array(*[F.lit(v) for v in ids.values()])
    known = F.transform(
        F.slice(text_chars, 1, width),
        lambda c: F.coalesce(F.get(places, F.instr(F.lit(keys), c) - 1), F.lit(1)),
    )
    return pad(known, width)


def utf8_codes(word: Column, limit: int) -> Column:
    """The first ``limit`` bytes of the UTF-8 form as integers."""
    hexes = F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(F.slice(hexes, 1, limit), lambda h: F.conv(h, 16, 10).cast("int"))


def char_codes(word: Column, width: int) -> Column:
    """Begin-of-word, bytes, end-of-word, padding; always ``width`` long."""
    framed = F.concat(ints(CHAR_BOW), utf8_codes(word, width - 2), ints(CHAR_EOW))
    return pad(framed, width, CHAR_PAD)


def boundary_codes(mark: int, width: int) -> Column:
    return pad(ints(CHAR_BOW, mark, CHAR_EOW), width, CHAR_PAD)


def sentence_codes(tokens: Column, width: int) -> Column:
    """Character matrix of a sentence with its two boundary rows."""
    return F.concat(
        F.array(boundary_codes(CHAR_BOS, width)),
        F.transform(tokens, lambda t: char_codes(t, width)),
        F.array(boundary_codes(CHAR_EOS, width)),
    )


def unmasked(ids: Column) -> Column:
    """Ids plus one so that 0 is free for the mask."""
    return F.transform(ids, lambda i: i + 1)
