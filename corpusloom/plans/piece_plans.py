"""Sub-word and vector lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import numeric as N
from corpusloom.functions import text as T
from corpusloom.operators import vocabulary as V
from corpusloom.operators.wordpiece import full_token_ids, trie_of, word_pieces
from corpusloom.plans import sqltext as S
from corpusloom.plans.registry import query, table, texts
from corpusloom.plans.vocab_plans import digest, digest_sql

# The sub-word vocabulary: letters as word starts and continuations (without a few letters, so
# that some words are unknown), passage words, and their endings.
_PASSAGE = f"(SELECT DISTINCT unnest({S.basic_tokens('text')}) AS w FROM benchmark)"
_VOCAB = f"""(SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (
    SELECT w AS token FROM {_PASSAGE} UNION SELECT '##' || right(w, 3) FROM {_PASSAGE} WHERE length(w) > 4
    UNION SELECT c FROM (SELECT DISTINCT unnest(string_split(w, '')) AS c FROM {_PASSAGE}) WHERE c NOT IN ('w', 'v', '')
    UNION SELECT '##' || c FROM (SELECT DISTINCT unnest(string_split(w, '')) AS c FROM {_PASSAGE}) WHERE c NOT IN ('w', 'v', '')
    UNION SELECT '[UNK]'))"""


def sub_word_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "benchmark").select(F.explode(T.basic_tokens(F.col("text"))).alias("w")).distinct()
    letters = w.select(F.explode(F.split("w", "")).alias("c")).where("c NOT IN ('w', 'v', '')").distinct()
    mark = F.lit("##")
    parts = (
        w.select(F.col("w").alias("token")),
        w.where(F.length("w") > 4).select(F.concat(mark, F.right("w", F.lit(3))).alias("token")),
        letters.select(F.col("c").alias("token")),
        letters.select(F.concat(mark, "c").alias("token")),
        spark.range(1).select(F.lit("[UNK]").alias("token")),
    )
    tokens = parts[0]
    for part in parts[1:]:
        tokens = tokens.unionByName(part)
    return V.label_ids(tokens, "token")


_SPLIT_CTE = f"""WITH RECURSIVE vocab AS MATERIALIZED {_VOCAB},
          toks AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS place FROM (SELECT doc_id, {S.basic_tokens('text')} AS ws FROM documents)),
          distinct_words AS MATERIALIZED (SELECT DISTINCT w FROM toks),
          split AS (
            SELECT w, 0 AS pos, []::VARCHAR[] AS pieces FROM distinct_words WHERE length(w) <= 200
            UNION ALL
            SELECT w, pos + max(k) AS pos, list_append(any_value(pieces), (CASE WHEN pos > 0 THEN '##' ELSE '' END) || substr(w, pos + 1, max(k))) AS pieces
            FROM (SELECT w, pos, pieces, unnest(range(1, length(w) - pos + 1)) AS k FROM split WHERE pos < length(w))
            JOIN vocab ON token = (CASE WHEN pos > 0 THEN '##' ELSE '' END) || substr(w, pos + 1, k)
            GROUP BY w, pos),
          done AS MATERIALIZED (SELECT d.w, coalesce(s.pieces, ['[UNK]']) AS pieces FROM distinct_words d LEFT JOIN (SELECT w, pieces FROM split WHERE pos = length(w)) s USING (w)),
          docs AS (SELECT doc_id, flatten(list(pieces ORDER BY place)) AS ps FROM toks JOIN done USING (w) GROUP BY doc_id)"""


@query(
    "wordpiece_tokens",
    f"""{_SPLIT_CTE}
        SELECT doc_id, len(ps)::INT AS n_pieces, len([p for p in ps if p = '[UNK]'])::INT AS n_unknown, {digest_sql('ps')} AS pieces_md5 FROM docs""",
)
def wordpiece_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Basic tokens split into sub-words of a small vocabulary."""
    trie = trie_of(sub_word_vocabulary(spark, sf))
    docs = texts(spark, sf, "documents").select("doc_id", T.basic_tokens(F.col("text")).alias("ws"))
    pieces = docs.select("doc_id", word_pieces(spark, trie, F.col("ws")).alias("ps"))
    return pieces.select(
        "doc_id",
        F.size("ps").alias("n_pieces"),
        F.size(F.filter("ps", lambda p: p == "[UNK]")).alias("n_unknown"),
        digest(F.col("ps")).alias("pieces_md5"),
    )


@query(
    "full_token_ids",
    f"""{_SPLIT_CTE}, flat AS (SELECT doc_id, unnest(ps) AS token, unnest(range(0, len(ps))) AS place FROM docs)
        SELECT doc_id, list(id::INT ORDER BY place) AS input_ids FROM flat JOIN vocab USING (token) GROUP BY doc_id""",
)
def full_token_ids_query(spark: SparkSession, sf: str) -> DataFrame:
    """The full tokenizer: basic tokens, word pieces, ids. Documents without tokens have none."""
    trie = trie_of(sub_word_vocabulary(spark, sf))
    ids = texts(spark, sf, "documents").select("doc_id", full_token_ids(spark, trie, F.col("text")).alias("input_ids"))
    return ids.where(F.size("input_ids") > 0)


@query(
    "embedding_lookup",
    """SELECT row_id, place::INT AS place, id::BIGINT AS id, round(list_sum(e.embedding::DOUBLE[]), 5) AS total FROM (
         SELECT conv_id * 1000 + turn AS row_id, unnest(ids) AS id, unnest(range(0, len(ids))) AS place FROM (
           SELECT conv_id, turn, [length(w) * 40 for w in %s] AS ids FROM conversations))
       LEFT JOIN embeddings e ON e.vec_id = id""" % S.whitespace_tokens("text"),
)
def embedding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Id arrays to vectors; ids beyond the table have none."""
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.transform(T.whitespace_tokens(F.col("text")), lambda w: (F.length(w) * 40).cast("bigint")).alias("ids"),
    )
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = V.embedding_lookup(rows, "row_id", "ids", vectors)
    return found.select("row_id", "place", "id", F.round(N.total(F.col("embedding")), 5).alias("total"))


@query(
    "train_steps",
    """SELECT lang, count(*)::BIGINT AS n, floor(count(*) / 32.0::DOUBLE * 3)::INT AS steps, floor(floor(count(*) / 32.0::DOUBLE * 3) * 0.1::DOUBLE)::INT AS warmup
       FROM documents GROUP BY lang""",
)
def train_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Step counts for training on each language."""
    sizes = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    steps, warmup = N.step_counts(F.col("n"), 32, 3.0, 0.1)
    return sizes.select("lang", "n", steps.alias("steps"), warmup.alias("warmup"))
