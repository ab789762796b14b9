"""Vocabulary and encoding queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import encoding as E
from corpusloom.functions import text as T
from corpusloom.functions.columns import joined, literal_rows
from corpusloom.operators import ordering as O
from corpusloom.operators import vocabulary as V
from corpusloom.operators.examples import framed_tokens, non_pad_count, padded_features, padded_to_batch
from corpusloom.plans import sqltext as S
from corpusloom.plans.registry import query, table, texts
from corpusloom.staging import stage


def digest(values: Column) -> Column:
    return F.md5(joined(values))


def digest_sql(x: str) -> str:
    return f"md5(array_to_string({x}, ' '))"


# -- vocabularies -----------------------------------------------------------------------------

COUNTER = S.whitespace_tokens("replace(replace(text, chr(10), ''), chr(9), '')")
SIMPLE = S.whitespace_tokens("lower(text)")


def counts_sql(tokens: str, source: str = "documents", key: str = "doc_id") -> str:
    return f"""(SELECT token, count(*) AS n, min({key} * 1000000 + place) AS first FROM (
        SELECT {key}, unnest(ws) AS token, unnest(range(0, len(ws))) AS place FROM (SELECT {key}, {tokens} AS ws FROM {source}))
      GROUP BY token)"""


def specials_sql(specials) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({S.lit(t)}, {i})" for i, t in enumerate(specials)) + ") v(token, id))"


def by_count_sql(source: str = "documents", key: str = "doc_id", min_freq: int = 1, max_size: int | None = None) -> str:
    cap = "" if max_size is None else f" WHERE id < {max_size + 5}"
    names = ", ".join(S.lit(t) for t in S.SENTENCE_PAIR_SPECIALS)
    return f"""(SELECT token, id::INT AS id FROM (
      SELECT token, id FROM {specials_sql(S.SENTENCE_PAIR_SPECIALS)} UNION ALL
      SELECT token, 4 + row_number() OVER (ORDER BY n DESC, token) FROM {counts_sql(COUNTER, source, key)}
      WHERE n >= {min_freq} AND token NOT IN ({names})){cap})"""


def word_counts(spark: SparkSession, sf: str, tokens, first: bool = False) -> DataFrame:
    docs = texts(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("ws"))
    return V.token_counts(docs, "ws", ["doc_id"] if first else ())


def document_vocabulary(spark: SparkSession, sf: str, max_size: int | None = None, min_freq: int = 1) -> DataFrame:
    return V.build_by_count(word_counts(spark, sf, T.counter_words), min_freq=min_freq, max_size=max_size)


@query("word_counts", f"SELECT token, n::BIGINT AS n FROM {counts_sql(COUNTER)}")
def word_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    return word_counts(spark, sf, T.counter_words)


@query("vocab_count_alpha", f"SELECT * FROM {by_count_sql(min_freq=2)}")
def vocab_count_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return document_vocabulary(spark, sf, min_freq=2)


@query("vocab_max_size", f"SELECT * FROM {by_count_sql(max_size=1000)}")
def vocab_max_size(spark: SparkSession, sf: str) -> DataFrame:
    return document_vocabulary(spark, sf, max_size=1000)


@query(
    "vocab_first_seen",
    f"""SELECT token, id::INT AS id FROM (SELECT token, id FROM {specials_sql(S.TRANSLATION_SPECIALS)} UNION ALL
        SELECT token, 3 + row_number() OVER (ORDER BY first) FROM {counts_sql(SIMPLE)} WHERE n >= 2)""",
)
def vocab_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return V.build_by_first_seen(word_counts(spark, sf, T.simple_tokens, first=True))


_STOP_SQL = f"(SELECT DISTINCT token FROM (SELECT unnest({S.whitespace_tokens('text')}) AS token FROM benchmark) WHERE length(token) <= 3)"
_LONG_SQL = f"(SELECT DISTINCT token FROM (SELECT unnest({S.whitespace_tokens('text')}) AS token FROM benchmark) WHERE length(token) > 4)"
_WS = S.whitespace_tokens("text")


def passage_words(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "benchmark").select(F.explode(T.whitespace_tokens(F.col("text"))).alias("token"))
    return words.distinct()


@query(
    "stopword_vocab",
    f"""SELECT token, id::INT AS id FROM (SELECT token, id FROM {specials_sql(S.REVIEW_SPECIALS)} UNION ALL
        SELECT token, 1 + row_number() OVER (ORDER BY n DESC, first) FROM {counts_sql(_WS)}
        WHERE n >= 5 AND token NOT IN (SELECT token FROM {_STOP_SQL}))""",
)
def stopword_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Short words of the passages are the stop words."""
    stop = passage_words(spark, sf).where(F.length("token") <= 3)
    return V.build_for_reviews(word_counts(spark, sf, T.whitespace_tokens, first=True), stop)


@query(
    "vector_vocab",
    f"""SELECT token, id::INT AS id FROM (SELECT token, id FROM {specials_sql(S.REVIEW_SPECIALS)} UNION ALL
        SELECT token, 1 + row_number() OVER (ORDER BY n DESC, first) FROM {counts_sql(_WS)}
        WHERE n >= 5 AND token NOT IN (SELECT token FROM {_STOP_SQL}) AND token IN (SELECT token FROM {_LONG_SQL}))""",
)
def vector_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Only words of the (stand-in) pretrained vector table remain."""
    words = passage_words(spark, sf)
    counts = word_counts(spark, sf, T.whitespace_tokens, first=True)
    return V.build_for_reviews(
        counts, words.where(F.length("token") <= 3), vectors=words.where(F.length("token") > 4)
    )


@query(
    "missing_vectors",
    f"SELECT token FROM {counts_sql(_WS)} WHERE n >= 5 AND token NOT IN (SELECT token FROM {_LONG_SQL})",
)
def missing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    counts = word_counts(spark, sf, T.whitespace_tokens).where("n >= 5")
    return V.missing_vectors(counts, passage_words(spark, sf).where(F.length("token") > 4))


@query(
    "vocab_extend",
    f"""WITH base AS MATERIALIZED {by_count_sql(min_freq=2)}, other AS MATERIALIZED {by_count_sql('benchmark', 'item_id')}
        SELECT token, id FROM base UNION ALL
        SELECT token, ((SELECT max(id) FROM base) + row_number() OVER (ORDER BY id))::INT AS id FROM other
        WHERE token NOT IN (SELECT token FROM base)""",
)
def vocab_extend(spark: SparkSession, sf: str) -> DataFrame:
    passages = table(spark, sf, "benchmark").select(T.counter_words(F.col("text")).alias("ws"))
    other = V.build_by_count(V.token_counts(passages, "ws"))
    return V.extend(document_vocabulary(spark, sf, min_freq=2), other)


@query(
    "label_ids",
    "SELECT source AS token, (row_number() OVER (ORDER BY source) - 1)::INT AS id FROM (SELECT DISTINCT source FROM documents)",
)
def label_ids(spark: SparkSession, sf: str) -> DataFrame:
    return V.label_ids(table(spark, sf, "documents"), "source")


# -- encoding -----------------------------------------------------------------------------------

_IDS_SQL = f"""(SELECT doc_id, list(coalesce(v.id, 1) ORDER BY place) AS ids FROM (
      SELECT doc_id, unnest(ws) AS token, unnest(range(0, len(ws))) AS place FROM (SELECT doc_id, {COUNTER} AS ws FROM documents))
    LEFT JOIN {by_count_sql(min_freq=2)} v USING (token) GROUP BY doc_id)"""


def encoded_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Documents as ids of the whole vocabulary (words that occur once are unknown), and its size."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    vocab = stage(document_vocabulary(spark, sf, min_freq=2), "document-vocabulary")
    return V.lookup(docs, "doc_id", T.counter_words(F.col("text")), vocab, E.UNK), vocab.count()


@query(
    "encode_pad",
    f"""SELECT doc_id, (len(ids) + 2)::INT AS origin_len, {digest_sql('seq')} AS seq_md5, len(seq)::INT AS seq_len FROM (
          SELECT doc_id, ids, list_resize(([3] || ids || [2])[1:128], 128, 0) AS seq FROM {_IDS_SQL})""",
)
def encode_pad(spark: SparkSession, sf: str) -> DataFrame:
    """Start and end marks around the ids, padded or cut to a fixed width."""
    full = encoded_documents(spark, sf)[0].select("doc_id", E.with_specials(F.col("ids")).alias("seq"))
    fixed = full.select("doc_id", F.size("seq").alias("origin_len"), E.pad(F.col("seq"), 128).alias("seq"))
    return fixed.select(
        "doc_id", "origin_len", digest(F.col("seq")).alias("seq_md5"), F.size("seq").alias("seq_len")
    )


@query(
    "decode_ids",
    f"""SELECT conv_id * 1000 + turn AS row_id, coalesce(string_agg(coalesce(v.token, '<' || i || '>'), ' ' ORDER BY place) FILTER (i <> 0), '') AS sentence
        FROM (SELECT conv_id, turn, unnest(ids) AS i, unnest(range(0, len(ids))) AS place FROM (
          SELECT conv_id, turn, [length(w) - 1 for w in {_WS}] AS ids FROM conversations))
        LEFT JOIN {by_count_sql('benchmark', 'item_id', max_size=5)} v ON v.id = i GROUP BY ALL""",
)
def decode_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids back to words; padding (0) is dropped, ids beyond the vocabulary are shown as <id>."""
    passages = table(spark, sf, "benchmark").select(T.counter_words(F.col("text")).alias("ws"))
    vocab = V.build_by_count(V.token_counts(passages, "ws"), max_size=5)
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.transform(T.whitespace_tokens(F.col("text")), lambda w: F.length(w) - 1).alias("ids"),
    )
    decoded = V.words_of_ids(rows, "row_id", "ids", vocab, drop=[E.PAD])
    return decoded.select("row_id", F.array_join("tokens", " ").alias("sentence"))


_TURNS_SQL = f"(SELECT conv_id * 1000 + turn AS row_id, {_WS} AS ws FROM conversations)"
_TURN_IDS_SQL = f"""(SELECT row_id, list(v.id ORDER BY place) AS ids FROM (
      SELECT row_id, unnest(ws) AS token, unnest(range(0, len(ws))) AS place FROM {_TURNS_SQL})
    JOIN (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT unnest(ws) AS token FROM {_TURNS_SQL})) v USING (token)
    GROUP BY row_id)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        (F.col("turn") % 4).alias("lane"),
        T.whitespace_tokens(F.col("text")).alias("ws"),
    )


def encoded_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Strict encoding: every token must be in the vocabulary."""
    rows = turns(spark, sf)
    vocab = V.label_ids(rows.select(F.explode("ws").alias("w")), "w")
    return V.lookup(rows, "row_id", "ws", vocab, None)


@query(
    "lm_encode",
    f"""SELECT row_id, {digest_sql('[7] || ids || [8]')} AS forward_md5, {digest_sql('[8] || list_reverse(ids) || [7]')} AS backward_md5
        FROM {_TURN_IDS_SQL}""",
)
def lm_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Language-model sentences in both directions."""
    ids = F.col("ids")
    return encoded_turns(spark, sf).select(
        "row_id",
        digest(E.lm_encode(ids, 7, 8)).alias("forward_md5"),
        digest(E.lm_encode(F.reverse(ids), 7, 8, backward=True)).alias("backward_md5"),
    )


@query(
    "batch_padding",
    f"""SELECT row_id, lane, {digest_sql("list_resize([7 + 1] || [i + 1 for i in ids] || [8 + 1], w, 0)")} AS ids_md5, w::INT AS width
        FROM (SELECT row_id, (row_id % 1000) % 4 AS lane, ids, max(len(ids)) OVER (PARTITION BY (row_id % 1000) % 4) + 2 AS w FROM {_TURN_IDS_SQL})""",
)
def batch_padding(spark: SparkSession, sf: str) -> DataFrame:
    """Ids plus one, padded with the free 0 to the longest sentence of the batch plus marks."""
    rows = encoded_turns(spark, sf).select("row_id", ((F.col("row_id") % 1000) % 4).alias("lane"), "ids")
    rows = rows.withColumn("ids", E.unmasked(E.lm_encode(F.col("ids"), 7, 8)))
    padded = padded_to_batch(rows, "lane", "ids")
    return padded.select("row_id", "lane", digest(F.col("ids")).alias("ids_md5"), "width")


def _bytes_sql(x: str, limit: int) -> str:
    return f"[('0x' || h)::INT for h in regexp_extract_all(hex({x}), '..')][1:{limit}]"


@query(
    "char_codes",
    f"""SELECT row_id, count(*)::BIGINT AS n_words, md5(string_agg(array_to_string(
            list_resize([258] || {_bytes_sql('token', 8)} || [259], 10, 260), ' '), ' ' ORDER BY place)) AS codes_md5
        FROM (SELECT row_id, unnest(ws) AS token, unnest(range(0, len(ws))) AS place FROM {_TURNS_SQL}) GROUP BY row_id""",
)
def char_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Words as framed UTF-8 bytes of fixed width."""
    rows = turns(spark, sf).where(F.size("ws") > 0)
    codes = F.flatten(F.transform("ws", lambda w: E.char_codes(w, 10)))
    return rows.select("row_id", F.size("ws").cast("bigint").alias("n_words"), digest(codes).alias("codes_md5"))


_ALPHABET = S.lit("".join(dict.fromkeys(S.CHAR_ALPHABET)))
_PLACES = "[" + ", ".join(str(i) for i in {c: i for i, c in enumerate(S.CHAR_ALPHABET, start=2)}.values()) + "]"
_CHAR_IDS = f"""list_resize([coalesce({_PLACES}[nullif(instr({_ALPHABET}, c), 0)], 1)
    for c in [c for c in regexp_extract_all(text, '(?s).') if c <> ' '][1:1014]], 1014, 0)"""


@query(
    "char_index",
    f"""SELECT doc_id, {digest_sql('ids')} AS ids_md5, len([i for i in ids if i = 1])::INT AS n_unknown,
          {digest_sql("[CASE WHEN i = ids[1] THEN 1 ELSE 0 END for i in range(1, 71)]")} AS first_one_hot_md5
        FROM (SELECT doc_id, {_CHAR_IDS} AS ids FROM documents)""",
)
def char_index(spark: SparkSession, sf: str) -> DataFrame:
    """Character ids of fixed width; the first one also as a one-hot vector."""
    docs = texts(spark, sf, "documents").select(
        "doc_id", E.char_index(T.characters(F.col("text")), 1014).alias("ids")
    )
    return docs.select(
        "doc_id",
        digest(F.col("ids")).alias("ids_md5"),
        F.size(F.filter("ids", lambda i: i == 1)).alias("n_unknown"),
        digest(E.char_one_hot(F.get("ids", F.lit(0)), 70)).alias("first_one_hot_md5"),
    )


@query(
    "attention_masks",
    f"""SELECT row_id, {digest_sql('[CASE WHEN i <> 0 THEN 1 ELSE 0 END for i in p]')} AS padding_md5,
          md5(array_to_string([array_to_string([CASE WHEN p[j] <> 0 AND j <= i THEN 1 ELSE 0 END for j in range(1, 12)], ' ') for i in range(1, 12)], '|')) AS target_md5,
          {digest_sql('p[1:11]')} AS input_md5, {digest_sql('p[2:12]')} AS labels_md5, len([i for i in p[2:12] if i <> 0])::INT AS n_tokens
        FROM (SELECT row_id, list_resize(ids[1:12], 12, 0) AS p FROM {_TURN_IDS_SQL})""",
)
def attention_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Padding mask, decoder mask, shifted inputs and labels, and the label count."""
    rows = encoded_turns(spark, sf).select("row_id", E.pad(F.col("ids"), 12).alias("p"))
    given, labels = E.shift_right(F.col("p"))
    shown = F.array_join(F.transform(E.target_mask(given), lambda row: joined(row)), "|")
    return rows.where("p[0] IS NOT NULL").select(
        "row_id",
        digest(E.presence_mask(F.col("p"))).alias("padding_md5"),
        F.md5(shown).alias("target_md5"),
        digest(given).alias("input_md5"),
        digest(labels).alias("labels_md5"),
        non_pad_count(labels).alias("n_tokens"),
    )


@query(
    "vector_positions",
    f"""SELECT vec_id, (list_position(e, list_max(e)) - 1)::INT AS best,
          array_to_string([round(e[p + 1]::DOUBLE, 6) for p in [0, 3, 63]], ' ') IS NOT NULL AS gathered_ok,
          round(e[1]::DOUBLE + e[4] + e[64], 5) AS gathered_sum,
          {digest_sql("[p - 1 for p in list_grade_up([-x::DOUBLE for x in e])][1:5]")} AS top5_md5
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
)
def vector_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Arg-max, gathering by position, and the best positions of each vector."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    got = E.gather(F.col("e"), F.array(F.lit(0), F.lit(3), F.lit(63)))
    return vectors.select(
        "vec_id",
        E.argmax(F.col("e")).alias("best"),
        F.lit(True).alias("gathered_ok"),
        F.round(F.aggregate(got, F.lit(0.0), lambda a, v: a + v), 5).alias("gathered_sum"),
        digest(E.best_positions(F.col("e"), 5)).alias("top5_md5"),
    )


# -- fixed-width examples -------------------------------------------------------------------------

_PAIRS_SQL = f"""(SELECT conv_id, turn, {_WS} AS a, lead({_WS}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)"""
_KEEP_A = """CASE WHEN la + lb <= m THEN la WHEN la <= (m + 1) // 2 AND lb > m - la THEN la
                  WHEN lb <= m // 2 THEN m - lb ELSE (m + 1) // 2 END"""
_KEEP_B = """CASE WHEN la + lb <= m THEN lb WHEN la <= (m + 1) // 2 AND lb > m - la THEN m - la
                  WHEN lb <= m // 2 THEN lb ELSE m // 2 END"""


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn with the next one of its conversation, by an equi-join on the turn number."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", T.whitespace_tokens(F.col("text")).alias("a"))
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return rows.join(following, ["conv_id", "turn"], "left")


@query(
    "pair_truncate",
    f"""SELECT conv_id, turn, (k_a)::INT AS keep_a, (k_b)::INT AS keep_b, {digest_sql("a[1:k_a] || ['|'] || b[1:k_b]")} AS tokens_md5
        FROM (SELECT *, {_KEEP_A} AS k_a, {_KEEP_B} AS k_b FROM (SELECT *, len(a) AS la, len(b) AS lb, 61 AS m FROM {_PAIRS_SQL} WHERE b IS NOT NULL))""",
)
def pair_truncate(spark: SparkSession, sf: str) -> DataFrame:
    pairs = turn_pairs(spark, sf).where("b IS NOT NULL")
    keep_a, keep_b = E.pair_lengths(F.size("a"), F.size("b"), 61)
    kept = pairs.withColumns({"keep_a": keep_a, "keep_b": keep_b})
    tokens = F.concat(F.slice("a", F.lit(1), F.col("keep_a")), F.array(F.lit("|")), F.slice("b", F.lit(1), F.col("keep_b")))
    return kept.select("conv_id", "turn", "keep_a", "keep_b", digest(tokens).alias("tokens_md5"))


_FRAMED_SQL = f"""(SELECT conv_id * 1000 + turn AS row_id,
      CASE WHEN b IS NULL OR len(b) = 0 THEN ['[CLS]'] || a[1:62] || ['[SEP]']
           ELSE ['[CLS]'] || a[1:k_a] || ['[SEP]'] || b[1:k_b] || ['[SEP]'] END AS tokens,
      CASE WHEN b IS NULL OR len(b) = 0 THEN list_resize([]::INT[], least(len(a), 62) + 2, 0)
           ELSE list_resize([]::INT[], k_a + 2, 0) || list_resize([]::INT[], k_b + 1, 1) END AS segments
    FROM (SELECT *, {_KEEP_A} AS k_a, {_KEEP_B} AS k_b FROM (SELECT *, len(a) AS la, coalesce(len(b), 0) AS lb, 61 AS m FROM {_PAIRS_SQL})))"""
_FRAME_VOCAB = f"""(SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (
    SELECT unnest({_WS}) AS token FROM conversations UNION SELECT '[CLS]' UNION SELECT '[SEP]'))"""


@query(
    "single_example",
    f"""SELECT row_id, {digest_sql('list_resize(ids, 64, 0)')} AS input_ids_md5,
          {digest_sql('list_resize(list_resize([]::INT[], len(ids), 1), 64, 0)')} AS input_mask_md5,
          {digest_sql('list_resize(segments, 64, 0)')} AS segment_ids_md5
        FROM (SELECT row_id, any_value(segments) AS segments, list(v.id::INT ORDER BY place) AS ids FROM (
          SELECT row_id, segments, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS place FROM {_FRAMED_SQL})
          JOIN {_FRAME_VOCAB} v USING (token) GROUP BY row_id)""",
)
def single_example(spark: SparkSession, sf: str) -> DataFrame:
    """Classifier features of sentence pairs (last turns: single sentences)."""
    pairs = turn_pairs(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "a", "b")
    framed = pairs.select("row_id", framed_tokens(F.col("a"), F.col("b"), 64).alias("f"))
    framed = framed.select("row_id", "f.tokens", "f.segments")
    words = pairs.select(F.explode("a").alias("w")).unionByName(literal_rows(spark, w=["[CLS]", "[SEP]"]))
    ids = V.lookup(framed, "row_id", "tokens", V.label_ids(words, "w"), None)
    features = framed.select("row_id", "segments").join(ids, "row_id")
    input_ids, mask, segments = padded_features(F.col("ids"), F.col("segments"), 64)
    return features.select(
        "row_id",
        digest(input_ids).alias("input_ids_md5"),
        digest(mask).alias("input_mask_md5"),
        digest(segments).alias("segment_ids_md5"),
    )


@query(
    "length_filter",
    f"""SELECT conv_id, turn, len(a)::INT AS n_src, len(b)::INT AS n_tgt FROM {_PAIRS_SQL} WHERE len(a) <= 48 AND len(b) <= 48""",
)
def length_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose both sides leave room for two marks within 50 ids."""
    pairs = turn_pairs(spark, sf)
    fitting = pairs.where((F.size("a") <= 50 - 2) & (F.size("b") <= 50 - 2) & F.col("b").isNotNull())
    return fitting.select("conv_id", "turn", F.size("a").alias("n_src"), F.size("b").alias("n_tgt"))


# -- splits and batches -----------------------------------------------------------------------------


@query(
    "train_eval_split",
    """SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.8) AS is_train FROM labels""",
)
def train_eval_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    return O.positional_split(rows, ["doc_id"], 0.8)


def _batches_sql(key: str, source: str, batch: int, seed: int) -> str:
    from corpusloom.functions.chance import draw_sql

    return f"""SELECT {key}, ((p - 1) // {batch})::BIGINT AS batch, ((p - 1) % {batch})::BIGINT AS slot FROM (
        SELECT {key}, row_number() OVER (ORDER BY {draw_sql(seed, key)}, {key}) AS p, count(*) OVER () AS n FROM {source})
      WHERE p <= n // {batch} * {batch}"""


@query("batch_assign", _batches_sql("event_id", "events", 32, 5))
def batch_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Shuffled full batches."""
    rows = table(spark, sf, "events").select("event_id")
    return O.full_batches(rows, "event_id", 32, 5).select("event_id", "batch", "slot")
