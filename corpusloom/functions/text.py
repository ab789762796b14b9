"""Text cleaning and tokenising as column expressions (string in, string or array out)."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns that decide the results. They are written in
# the syntax that Java and RE2 share.
ASCII_SPACE = r"\t-\r\x1c-\x20"
OTHER_SPACE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = ASCII_SPACE + OTHER_SPACE
WORD = r"[\p{L}\p{N}_]+"
ASCII_PUNCT = r"!-/:-@\[-`{-~"
PUNCT = r"\p{P}$+<=>^`|~"
SPACE_SEPARATORS = r"[\t\n\r\p{Zs}]"
ASCII_CONTROL = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f"
PAGE_CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
RULE_LINE = r"[-_.=]{4,}"
KEEP_ASCII = "A-Za-z0-9" + ASCII_SPACE + r".,;:!?()%$+\-*/=<>@#&'" + '"'
KEEP_OTHER = r"\x{4e00}-\x{9fff}" + OTHER_SPACE
FULL_WIDTH = "，。；：！？（）￥"
KEEP = KEEP_ASCII + KEEP_OTHER
KEEP_FULL_WIDTH = KEEP + FULL_WIDTH
CJK = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
)


def _singles(ascii_class: str) -> str:
    return "".join(f"\\x{c:02x}" for c in range(128) if re.match(f"[{ascii_class}]", chr(c)))


def _inside(ascii_class: str, other_class: str) -> str:
    """The union of both classes, written so that ASCII characters are decided by one table
    lookup; Java tries the ranges of a plain class one by one for every character."""
    return rf"[[\x{{80}}-\x{{10FFFF}}&&[{other_class}]]{_singles(ascii_class)}]"


def _outside(ascii_class: str, other_class: str) -> str:
    """The complement of the union."""
    return rf"[[\x{{80}}-\x{{10FFFF}}&&[^{other_class}]][\x00-\x7f&&[^{_singles(ascii_class)}]]]"


_SPACES = _inside(ASCII_SPACE, OTHER_SPACE)
_CONTROLS = _inside(ASCII_CONTROL, r"\p{C}\x{FFFD}")
_BLANKS = _inside(r"\t\n\r ", r"\p{Zs}")
_PUNCTS = _inside(ASCII_PUNCT, r"\p{P}")
_PLAIN = _outside(ASCII_SPACE + ASCII_PUNCT, OTHER_SPACE + r"\p{P}")
_HIGH = r"[^\x00-\x7f]"


def _sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes only blanks)."""
    return _sub(text, rf"\A{_SPACES}+|{_SPACES}+\z", "")


def lstrip(text: Column) -> Column:
    return _sub(text, rf"\A{_SPACES}+", "")


def squeeze(text: Column) -> Column:
    return strip(_sub(text, f"{_SPACES}+", " "))


# -- cleaning ---------------------------------------------------------------------------


def normalize_page(text: Column) -> Column:
    """Unix line ends, no control characters, no trailing blanks, at most one blank line."""
    text = _sub(text, r"\r\n?", "\n")
    text = _sub(text, PAGE_CONTROL, "")
    text = _sub(text, r"[ \t]+\n", "\n")
    return _sub(text, r"\n{3,}", "\n\n")


def clean_basic(text: Column) -> Column:
    """Collapse ruler lines, keep the allowed characters (with full-width punctuation)."""
    text = _sub(text, RULE_LINE, " ")
    return squeeze(_sub(text, _outside(KEEP_ASCII, KEEP_OTHER + FULL_WIDTH), " "))


def clean_recursive(text: Column) -> Column:
    """Page normalisation followed by the narrower character whitelist."""
    text = _sub(normalize_page(text), RULE_LINE, " ")
    return squeeze(_sub(text, _outside(KEEP_ASCII, KEEP_OTHER), " "))


def collapse_markdown(text: Column) -> Column:
    """Blank-run collapse and image paths ``data2/X/name.png`` -> ``data/X/images/name.png``."""
    text = _sub(text, r"\n{3,}", "\n\n")
    return _sub(text, r"data2/([^/()\n]+)/([^/()\n]+\.png)", "data/$1/images/$2")


def body(text: Column) -> Column:
    """Text without header lines and image references, lines joined by a blank."""
    lines = F.transform(F.split(text, "\n"), strip)
    kept = F.filter(
        lines, lambda line: (line != "") & ~line.startswith("#") & ~line.startswith("![")
    )
    return F.array_join(kept, " ")


def clean_invalid(text: Column) -> Column:
    """Drop NUL, U+FFFD and control characters; every kind of white space becomes a blank."""
    return _sub(_sub(text, _CONTROLS, ""), _BLANKS, " ")


def space_cjk(text: Column) -> Column:
    return _sub(text, f"([{CJK}])", " $1 ")


def decode_utf8(data: Column) -> Column:
    """Bytes to text, malformed sequences dropped."""
    return _sub(F.make_valid_utf8(data.cast("string")), "\\x{FFFD}", "")


# -- accents ----------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Characters whose canonical decomposition leaves one base character, and that base."""
    source, target = [], []
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        decomposed = unicodedata.normalize("NFD", char)
        if decomposed == char:
            continue
        base = [c for c in decomposed if unicodedata.category(c) != "Mn"]
        if len(base) == 1:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


def _hangul_parts(char: Column) -> Column:
    """One Hangul syllable as its conjoining letters (arithmetic decomposition)."""

    def letter(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    index = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
    tail = index % 28
    return F.concat(
        letter((index / 588).cast("int") + 0x1100),
        letter(((index % 588) / 28).cast("int") + 0x1161),
        F.when(tail > 0, letter(tail + 0x11A7)).otherwise(""),
    )


def strip_accents(text: Column) -> Column:
    """Canonical decomposition without combining marks."""
    source, target = _accent_table()
    plain = _sub(F.translate(text, source, target), r"\p{Mn}", "")
    hangul = r"[\x{AC00}-\x{D7A3}]"
    spelled = F.array_join(
        F.transform(
            F.split(plain, ""), lambda c: F.when(c.rlike(hangul), _hangul_parts(c)).otherwise(c)
        ),
        "",
    )
    return F.when(plain.rlike(hangul), spelled).otherwise(plain)


# -- tokenising -------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Letter/digit/underscore runs, lower-cased after the match."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"{_SPACES}+"), lambda token: token != "")


def simple_tokens(text: Column) -> Column:
    return whitespace_tokens(F.lower(text))


def counter_words(text: Column) -> Column:
    """White-space tokens after line feeds and tabs are deleted (``a<TAB>b`` is ``ab``)."""
    return whitespace_tokens(F.translate(text, "\n\t", ""))


def punct_tokens(text: Column) -> Column:
    """Punctuation marks as single tokens, other runs whole."""
    return F.regexp_extract_all(text, F.lit(f"{_PLAIN}+|{_PUNCTS}"), F.lit(0))


def basic_tokens(text: Column, lower: bool = True) -> Column:
    """Clean, space CJK, lower-case and strip accents (optional), split on punctuation.

    Pure ASCII has neither accents nor CJK, and its blanks need no replacing before a split.
    """
    wide = space_cjk(clean_invalid(text))
    if lower:
        wide = strip_accents(F.lower(wide))
    narrow = _sub(F.lower(text) if lower else text, f"[{ASCII_CONTROL}]", "")
    return punct_tokens(F.when(text.rlike(_HIGH), wide).otherwise(narrow))


def basic_tokens_of_words(words: Column) -> Column:
    """The basic tokens of each word of an array (words hold no line feeds): array of arrays.

    All steps but the last run once on the joined words instead of once per word.
    """
    text = F.array_join(words, "\n")
    wide = _sub(_sub(text, _CONTROLS, ""), _inside(r"\t\r ", r"\p{Zs}"), " ")
    wide = strip_accents(F.lower(space_cjk(wide)))
    narrow = _sub(F.lower(text), f"[{ASCII_CONTROL}]", "")
    plain = F.when(text.rlike(_HIGH), wide).otherwise(narrow)
    tokens = F.transform(F.split(plain, "\n"), punct_tokens)
    return F.when(F.size(words) > 0, tokens).otherwise(F.array().cast("array<array<string>>"))


def characters(text: Column) -> Column:
    """Single characters without blanks."""
    return F.filter(F.split(text, ""), lambda c: (c != " ") & (c != ""))


def is_whitespace(char: Column) -> Column:
    return char.rlike(rf"\A{SPACE_SEPARATORS}\z")


def is_control(char: Column) -> Column:
    return char.rlike(rf"\A{_CONTROLS}\z") & (char != "\ufffd")


def is_punctuation(char: Column) -> Column:
    return char.rlike(rf"\A[{PUNCT}]\z")


# -- composing --------------------------------------------------------------------------


def detokenize(pieces: Column) -> Column:
    """Word pieces joined by blanks -> text."""
    text = F.replace(F.replace(pieces, F.lit(" ##"), F.lit("")), F.lit("##"), F.lit(""))
    return squeeze(text)


def chunk_id(doc_id: Column, chunk_no: Column, label: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), chunk_no.cast("string"), label)


def stable_id(*parts: Column) -> Column:
    """Reproducible identifier (instead of a random one)."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def default_label(prefix: str, size: int, overlap: int) -> str:
    return f"{prefix}_{size}_{overlap}"


def answer_number(value: Column, unit: Column) -> Column:
    """Number answers: no symbols or separators, scaled by unit, parentheses negative.

    The decimal point is moved in the text, so numbers of any length keep all their places.
    Values with other characters than a number, its symbols and separators give ``N/A``.
    """
    trimmed = strip(value)
    digits = _sub(trimmed, r"[\s,()$€£¥%]", "")
    usable = digits.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z")
    negative = trimmed.rlike(r"\A\(.*\)\z") != digits.startswith("-")
    places = F.when(F.lower(unit) == "thousands", 3).when(F.lower(unit) == "millions", 6).otherwise(0)
    whole = F.regexp_extract(digits, r"\A-?([0-9]*)", 1)
    part = F.regexp_extract(digits, r"\.([0-9]+)\z", 1)
    moved = F.concat(whole, F.rpad(F.substring(part, F.lit(1), places), places, "0"))
    rest = _sub(F.substring(part, places + 1, F.length(part)), r"0+\z", "")
    amount = F.concat(_sub(moved, r"\A0+(?=[0-9])", ""), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))
    signed = F.concat(F.when(negative & (amount != "0"), "-").otherwise(""), amount)
    return F.coalesce(F.when(usable, signed), F.lit("N/A"))


def answer_boolean(value: Column) -> Column:
    low = F.lower(strip(value))
    return (
        F.when(low.isin("yes", "true"), "true").when(low.isin("no", "false"), "false").otherwise("N/A")
    )
