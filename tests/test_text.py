import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.wordpiece import Trie, _split_lists, full_token_ids, full_tokens, split_word

VOCAB = {t: i for i, t in enumerate("[UNK] [CLS] [SEP] want ##want ##ed wa un runn ##ing ,".split())}
TRIE = Trie.of(list(VOCAB), list(VOCAB.values()))


def value(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


def test_full_tokens(spark):
    pieces = value(spark, "UNwantéd,running", lambda t: full_tokens(spark, TRIE, t))
    assert pieces == ["un", "##want", "##ed", ",", "runn", "##ing"]
    assert [VOCAB[p] for p in pieces] == [7, 4, 5, 10, 8, 9]


def test_basic_tokens(spark):
    assert value(spark, "ah博推zz", T.basic_tokens) == ["ah", "博", "推", "zz"]
    text = " \tHeLLo!how  \n Are yoU?  "
    assert value(spark, text, T.basic_tokens) == ["hello", "!", "how", "are", "you", "?"]
    assert value(spark, "Héllo", T.basic_tokens) == ["hello"]
    cased = value(spark, text, lambda t: T.basic_tokens(t, lower=False))
    assert cased == ["HeLLo", "!", "how", "Are", "yoU", "?"]


def test_hangul_and_marks_are_decomposed(spark):
    import unicodedata

    for text in ("각하", "áb", "Ǻ"):
        plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        assert value(spark, text, T.strip_accents) == plain


def test_tokens_of_words_equal_tokens_of_each(spark):
    words = ["Héllo,", "UN\u00a0a", "博x", "\u0005", "plain-Text.", "각"]
    array = F.array(*[F.lit(w) for w in words])
    row = spark.range(1).select(
        T.basic_tokens_of_words(array).alias("a"), F.transform(array, lambda w: T.basic_tokens(w)).alias("b"),
        T.basic_tokens_of_words(F.array().cast("array<string>")).alias("c"),
    ).first()
    assert row["a"] == row["b"] and row["c"] == []


def test_word_pieces():
    assert split_word("unwanted", VOCAB) == ["un", "##want", "##ed"]
    assert split_word("unwantedX", VOCAB) == ["[UNK]"]
    assert split_word("", VOCAB) == []
    assert split_word("a" * 201, {"a", "##a"}) == ["[UNK]"]


def test_character_classes(spark):
    def flags(test, chars):
        return [value(spark, c, test) for c in chars]

    assert flags(T.is_whitespace, " \t\r\n ") == [True] * 5
    assert flags(T.is_whitespace, "A-") == [False] * 2
    assert flags(T.is_control, "\u0005A \t\r") == [True, False, False, False, False]
    assert flags(T.is_punctuation, "-$`.A ") == [True] * 4 + [False] * 2


def test_words_follow_unicode(spark):
    text = "Ünïcode_1 ÄÖ  ß x"
    assert value(spark, text, T.words) == ["ünïcode_1", "äö", "ß", "x"]
    assert value(spark, " 　 a \n", T.strip) == "a"
    assert value(spark, "a\tb c\nd", T.counter_words) == ["ab", "cd"]


def test_cleaning(spark):
    assert value(spark, "a----b § c，d\n\n e", T.clean_basic) == "a b c，d e"
    assert value(spark, "a----b § c，d\n\n e", T.clean_recursive) == "a b c d e"
    assert value(spark, "a \r\n\r\n\r\n\x07b", T.normalize_page) == "a\n\nb"
    assert value(spark, "# h\n![i](x)\n body \n\nmore", T.body) == "body more"


def test_answer_values(spark):
    def number(text, unit):
        return value(spark, text, lambda t: T.answer_number(t, F.lit(unit)))

    assert number("$4970.5", "thousands") == "4970500"
    assert number("$1352", "Millions") == "1352000000"
    assert number("(1,234.50)", "units") == "-1234.5"
    assert number("122k", "units") == "N/A"
    assert number("100", "units") == "100"
    assert number("1.23456789", "units") == "1.23456789"
    assert number("-1.23456789", "thousands") == "-1234.56789"
    assert number("(0.5)", "Millions") == "-500000"
    assert number("(-7)", "units") == "7"
    assert number("-0.00", "units") == "0" and number("007.10", "units") == "7.1"
    assert number("123456789012345678901234", "thousands") == "123456789012345678901234000"
    assert number(None, "units") == "N/A"
    assert value(spark, " YES ", T.answer_boolean) == "true"


_LETTERS = st.text(alphabet="ab#é日", min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.sets(_LETTERS, max_size=12), st.sets(_LETTERS.map("##".__add__), max_size=8), st.lists(st.none() | st.lists(st.text(alphabet="ab#é日", max_size=8) | st.just("é" * 201), max_size=6), min_size=1))
def test_trie_splits_like_the_rule(first, more, rows):
    tokens = sorted(first | more | {"[UNK]"})
    trie = Trie.of(tokens, list(range(100, 100 + len(tokens))))
    bounds, pieces = _split_lists(trie, pa.array(rows, pa.list_(pa.string())))
    found = pa.ListArray.from_arrays(bounds, trie.tokens.take(pa.array(pieces))).to_pylist()
    assert found == [None if r is None else [p for w in r for p in split_word(w, set(tokens))] for r in rows]


def test_large_trie():
    tokens = [f"{i * 7919 % 1000003:x}" for i in range(60_000)] + [f"##{i:x}" for i in range(3000)] + ["[UNK]"]
    trie = Trie.of(tokens, list(range(len(tokens))))
    sizes, pieces = trie.split(pa.array([t for t in tokens if not t.startswith("##")]))
    assert sizes.tolist() == [1] * 60_001
    assert [tokens[p] for p in pieces] == [t for t in tokens if not t.startswith("##")]


def test_full_token_ids(spark):
    row = spark.createDataFrame([("UNwantéd,running",), ("",), (None,)], "t string").select(full_token_ids(spark, TRIE, F.col("t")).alias("ids"))
    ids = {t: i for i, t in enumerate(TRIE.tokens.to_pylist())}
    assert [r.ids for r in row.collect()] == [[ids[t] for t in ("un", "##want", "##ed", ",", "runn", "##ing")], [], None]
