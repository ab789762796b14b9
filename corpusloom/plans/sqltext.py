"""SQL fragments for the checking engine (same semantics, written independently as SQL)."""

from __future__ import annotations

# Fixed values, spelled out here so that the SQL does not depend on the code it checks.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]+"
PUNCT = r"\p{P}$+<=>^`|~"
SPACE_SEPARATORS = r"[\t\n\r\p{Zs}]"
PAGE_CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
RULE_LINE = r"[-_.=]{4,}"
KEEP = (
    r"A-Za-z0-9\t-\r\x1c-\x20.,;:!?()%$+\-*/=<>@#&'" + '"' + r"\x{4e00}-\x{9fff}"
    r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
KEEP_FULL_WIDTH = KEEP + "，。；：！？（）￥"
CJK = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
)
SENTENCE_PAIR_SPECIALS = ('<pad>', '<unk>', '<eos>', '<sos>', '<mask>')
TRANSLATION_SPECIALS = ('<pad>', '<sos>', '<eos>', '<unk>')
REVIEW_SPECIALS = ('PAD', 'UNK')
CHAR_ALPHABET = 'abcdefghijklmnopqrstuvwxyz0123456789-,;.!?:\'"/\\|_@#$%^&*~`+-=<>()[]{}'


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, replacement: str = "''") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {replacement}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"\A[{SPACE}]+|[{SPACE}]+\z")


def lstrip(x: str) -> str:
    return sub(x, rf"\A[{SPACE}]+")


def squeeze(x: str) -> str:
    return strip(sub(x, f"[{SPACE}]+", "' '"))


def normalize_page(x: str) -> str:
    x = sub(x, r"\r\n?", "chr(10)")
    x = sub(x, PAGE_CONTROL)
    x = sub(x, r"[ \t]+\n", "chr(10)")
    return sub(x, r"\n{3,}", "chr(10)||chr(10)")


def clean_basic(x: str) -> str:
    return squeeze(sub(sub(x, RULE_LINE, "' '"), f"[^{KEEP_FULL_WIDTH}]", "' '"))


def clean_recursive(x: str) -> str:
    return squeeze(sub(sub(normalize_page(x), RULE_LINE, "' '"), f"[^{KEEP}]", "' '"))


def words(x: str) -> str:
    return f"[lower(w) for w in regexp_extract_all({x}, {lit(WORD)})]"


def whitespace_tokens(x: str) -> str:
    return f"[w for w in regexp_split_to_array({x}, {lit(f'[{SPACE}]+')}) if w <> '']"


def punct_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(f'[{PUNCT}]|[^{SPACE}{PUNCT}]+')})"


def basic_tokens(x: str) -> str:
    x = sub(x, r"[^\P{C}\t\n\r]|\x{FFFD}")
    x = sub(x, SPACE_SEPARATORS, "' '")
    x = sub(x, f"([{CJK}])", r"' \1 '")
    return punct_tokens(f"strip_accents(lower({x}))")


def body(x: str) -> str:
    lines = f"[{strip('raw')} for raw in string_split({x}, chr(10))]"
    return (
        f"array_to_string([ln for ln in {lines} if ln <> '' and not starts_with(ln, '#') "
        "and not starts_with(ln, '!['))], ' ')".replace("'![')", "'!['")
    )


def page_markdown(x: str) -> str:
    """The Markdown stand-in used by the page queries, see ``plans.chunk_plans``."""
    x = f"regexp_replace({x}, '(?m)^([^\n,]{{1,100}}), ([^\n]{{1,100}})$', '| \\1 | \\2 |', 'g')"
    return f"regexp_replace({x}, '(?m)^([^|\n][^\n]{{0,39}})$', '## \\1', 'g')"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
