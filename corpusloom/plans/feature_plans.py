"""Feature queries whose whole arrays, texts and files are compared."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import encoding as E
from corpusloom.functions import numeric as N
from corpusloom.functions import text as T
from corpusloom.functions.columns import indices
from corpusloom.operators import retrieval as R
from corpusloom.operators import vocabulary as V
from corpusloom.plans import sqltext as S
from corpusloom.plans.registry import query, table, texts
from corpusloom.plans.vocab_plans import (
    _CHAR_IDS, _TURN_IDS_SQL, _TURNS_SQL, _bytes_sql, by_count_sql, document_vocabulary, encoded_turns, turns,
)
from corpusloom.sources import readers, writers
from corpusloom.staging import fresh_path

# -- encodings ------------------------------------------------------------------------------------


@query(
    "char_matrix",
    f"""SELECT row_id, [list_resize([258, 256, 259], 10, 260)] || list_transform(ws, lambda w: list_resize([258] || {_bytes_sql('w', 8)} || [259], 10, 260))
          || [list_resize([258, 257, 259], 10, 260)] AS codes FROM {_TURNS_SQL}""",
)
def char_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Character codes of every word of a turn between two boundary rows."""
    return turns(spark, sf).select("row_id", E.sentence_codes(F.col("ws"), 10).alias("codes"))


@query(
    "char_one_hot",
    f"""SELECT doc_id, md5(array_to_string(flatten(list_transform(ids, lambda k: list_transform(range(1, 71), lambda i: CASE WHEN i = k THEN 1 ELSE 0 END))), '')) AS rows_md5
        FROM (SELECT doc_id, {_CHAR_IDS} AS ids FROM documents)""",
)
def char_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """All character rows of a document as one-hot vectors; padding is the zero vector."""
    ids = texts(spark, sf, "documents").select("doc_id", E.char_index(T.characters(F.col("text")), 1014).alias("ids"))
    rows = F.transform("ids", lambda k: E.char_one_hot_digits(k, 70))
    return ids.select("doc_id", F.md5(F.array_join(rows, "")).alias("rows_md5"))


@query(
    "one_hot_positions",
    f"SELECT row_id, list_transform(range(0, len(ws)), lambda i: list_transform(range(0, 24), lambda j: (i = j)::INT)) AS positions FROM {_TURNS_SQL}",
)
def one_hot_positions(spark: SparkSession, sf: str) -> DataFrame:
    """One-hot vectors of the positions of every word."""
    return turns(spark, sf).select("row_id", F.transform(indices(F.size("ws")), lambda i: E.one_hot(i, 24)).alias("positions"))


@query(
    "decoded_turns",
    f"""SELECT row_id, list(coalesce(v.token, '<' || id || '>') ORDER BY place) AS tokens FROM (
          SELECT row_id, unnest(ids) AS id, unnest(range(0, len(ids))) AS place FROM {_TURN_IDS_SQL})
        LEFT JOIN {by_count_sql('(SELECT conv_id * 1000 + turn AS row_id, text FROM conversations)', 'row_id')} v USING (id)
        WHERE id NOT IN (0, 2, 3) GROUP BY row_id""",
)
def decoded_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Ids with boundary marks and padding, decoded without those."""
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), T.counter_words(F.col("text")).alias("ws"))
    vocab = V.build_by_count(V.token_counts(rows, "ws"))
    framed = encoded_turns(spark, sf).select("row_id", F.concat(E.lm_encode(F.col("ids"), E.SOS, E.EOS), F.array_repeat(F.lit(E.PAD), 3)).alias("ids"))
    found = V.words_of_ids(framed, "row_id", "ids", vocab, drop=(E.PAD, E.EOS, E.SOS))
    return found.where(F.size("tokens") > 0)


@query(
    "strict_labels",
    """SELECT doc_id, id::INT AS label_id FROM documents JOIN (
         SELECT source, row_number() OVER (ORDER BY source) - 1 AS id FROM (SELECT DISTINCT source FROM documents)) USING (source)""",
)
def strict_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as ids of the sorted distinct labels; an unknown label would fail."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    ids = V.lookup(docs, "doc_id", F.array("source"), V.label_ids(docs, "source"), None)
    return ids.select("doc_id", F.get("ids", F.lit(0)).alias("label_id"))


# the error function as its alternating series, which needs few terms for unit vectors
_ERF = " + ".join(
    f"({(-1) ** n}::DOUBLE) * pow(z, {2 * n + 1}) / {(2 * n + 1) * math.factorial(n)}::DOUBLE" for n in range(14)
)


@query(
    "gelu_forms",
    f"""SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(0.5::DOUBLE * x * (1 + 2 / sqrt(pi()) * list_transform([x / sqrt(2::DOUBLE)], lambda z: {_ERF})[1]), 7)) AS gelu
        FROM embeddings""",
)
def gelu_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The exact form of the activation on all components."""
    vectors = table(spark, sf, "embeddings")
    return vectors.select("vec_id", F.transform("embedding", lambda x: F.round(N.gelu_erf(x.cast("double")), 7)).alias("gelu"))


# -- prompts --------------------------------------------------------------------------------------

_KINDS = ("number", "name", "names", "boolean")
_RULES = (
    "Give digits only, without currency, separators, units or notes.", "Give the name alone.", "Give a list of names.", "Give true or false.",
)


@query(
    "answer_prompts",
    f"""SELECT conv_id, turn, 'Use only the context. Reply in JSON with question_text, kind, value, references, '
          || 'retrieval_results and reasoning_process; value is N/A and references are empty if the context does not hold the answer.' || chr(10) || 'kind: '
          || {list(_KINDS)}[k] || ' (top 5)' || chr(10) || 'rule: ' || {list(_RULES)}[k] || chr(10) || chr(10) || 'Context:' || chr(10) || role
          || chr(10) || chr(10) || 'Question:' || chr(10) || text AS prompt FROM (SELECT *, turn % 4 + 1 AS k FROM conversations)""",
)
def answer_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Question, rule of its kind and context as one text."""
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("turn") % 4).cast("int"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", R.answer_prompt(F.col("text"), kind, F.col("role"), 5).alias("prompt")
    )


# -- files ----------------------------------------------------------------------------------------


@query("vocabulary_stored", f"SELECT * FROM {by_count_sql(min_freq=2)}")
def vocabulary_stored(spark: SparkSession, sf: str) -> DataFrame:
    """A vocabulary written and loaded again."""
    path = fresh_path(spark, "vocabulary")
    writers.vocabulary(document_vocabulary(spark, sf, min_freq=2), path)
    return readers.vocabulary(spark, path)


@query(
    "markdown_files",
    """SELECT source, count(*)::BIGINT AS n_lines, sum(length(l))::BIGINT AS n_chars, sum(('0x' || substr(md5(l), 1, 7))::BIGINT)::BIGINT AS line_sum
       FROM (SELECT source, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY source""",
)
def markdown_files(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts as files in a folder per source, read back line by line."""
    path = fresh_path(spark, "markdown")
    writers.markdown(texts(spark, sf, "documents"), path, "source", "text")
    line = F.conv(F.substring(F.md5("value"), 1, 7), 16, 10).cast("bigint")
    return spark.read.text(path).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).cast("bigint").alias("n_chars"), F.sum(line).alias("line_sum")
    )


@query("prediction_files", "SELECT doc_id::VARCHAR AS qas_id, lang || ' \"' || source || '\"' AS prediction FROM documents")
def prediction_files(spark: SparkSession, sf: str) -> DataFrame:
    """One object per question in prediction files, and back."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("qas_id"), "lang", "source")
    path = fresh_path(spark, "predictions")
    writers.keyed_json(docs, "qas_id", F.concat("lang", F.lit(' "'), "source", F.lit('"')), path)
    cells = F.explode(F.from_json("value", "map<string,string>"))
    return spark.read.text(path).select(cells.alias("qas_id", "prediction"))
