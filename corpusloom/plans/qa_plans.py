"""Extractive question-answering queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.chance import uniform_sql, uniforms
from corpusloom.functions.columns import joined
from corpusloom.operators import answer_spans as A
from corpusloom.plans import sqltext as S
from corpusloom.plans.io_plans import write_groups
from corpusloom.plans.registry import query, texts
from corpusloom.plans.vocab_plans import digest, digest_sql
from corpusloom.sources import readers as R
from corpusloom.staging import stage

# Every document is a context; the question asks for one of its words (the one in the middle).
_SPLIT = "[w for w in regexp_split_to_array({}, '[ \\t\\r\\n\\x{{202F}}]+') if w <> '']"
_CW = _SPLIT.format("text")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents").select("doc_id", "text", "source", A.context_words(F.col("text")).alias("ws"))
    answer = F.get("ws", (F.size("ws") / 2).cast("int"))
    found = docs.select("doc_id", "text", "source", answer.alias("answer"))
    qa = F.struct(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("Where is "), F.col("source"), F.lit("?")).alias("question"),
        (F.col("doc_id") % 10 == 9).alias("is_impossible"),
        F.array(F.struct(F.col("answer").alias("text"), (F.instr("text", F.col("answer")) - 1).alias("answer_start"))).alias("answers"),
    )
    paragraph = F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))
    return found.select(F.col("source").alias("title"), F.array(paragraph).alias("paragraphs"))


EXAMPLES_SQL = f"""(SELECT doc_id, question, ws, impossible, answer, CASE WHEN impossible THEN -1 ELSE s END AS start_position,
      CASE WHEN impossible THEN -1 ELSE e END AS end_position FROM (
      SELECT *, len({_SPLIT.format("left(text, o + 1)")}) - 1 AS s, len({_SPLIT.format("left(text, o + length(a))")}) - 1 AS e,
             CASE WHEN impossible THEN '' ELSE a END AS answer
      FROM (SELECT doc_id, text, ws, 'Where is ' || source || '?' AS question, doc_id % 10 = 9 AS impossible, ws[len(ws) // 2 + 1] AS a,
                   instr(text, ws[len(ws) // 2 + 1]) - 1 AS o FROM (SELECT *, {_CW} AS ws FROM documents)))
    WHERE impossible OR contains(array_to_string(ws[s + 1:e + 1], ' '), a))"""


@query(
    "qa_examples",
    f"""SELECT doc_id::VARCHAR AS qas_id, start_position::INT AS start_position, end_position::INT AS end_position,
          answer AS answer_text, len(ws)::INT AS n_words FROM {EXAMPLES_SQL}""",
)
def qa_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Nested articles to questions with word positions of their answers."""
    examples = A.training_examples(A.read_questions(articles(spark, sf)))
    return examples.select(
        "qas_id", "start_position", "end_position", "answer_text", F.size("doc_tokens").alias("n_words")
    )


@query(
    "question_files",
    f"""SELECT doc_id::VARCHAR AS qas_id, start_position::INT AS start_position, end_position::INT AS end_position,
          answer AS answer_text, ws AS doc_tokens FROM {EXAMPLES_SQL}""",
)
def question_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same questions through JSON files with up to fifty articles each."""
    nested = articles(spark, sf).withColumn("_n", F.get("paragraphs", F.lit(0))["qas"][0]["id"].cast("bigint"))
    json = F.to_json(F.struct("title", "paragraphs"))
    path = write_groups(nested, "_n", json, "questions", wrap='{"data": [%s]}')
    examples = A.training_examples(A.read_questions(R.questions(spark, path)))
    return examples.select("qas_id", "start_position", "end_position", "answer_text", "doc_tokens")


WIDTH, STRIDE, QUERY = 96, 32, 8


def prepared(examples: DataFrame) -> DataFrame:
    return examples.withColumns(
        {
            "pieces": T.basic_tokens_of_words(F.col("doc_tokens")),
            "query": T.basic_tokens(F.col("question")),
            "answer_tokens": T.basic_tokens(F.col("answer_text")),
        }
    )


_FEATURES_CTE = f"""ex AS MATERIALIZED (SELECT *, {S.basic_tokens('question')}[1:{QUERY}] AS q, [{S.basic_tokens('w')} for w in ws] AS pieces,
        {S.basic_tokens('answer')} AS ans FROM {EXAMPLES_SQL}),
  flat AS MATERIALIZED (SELECT *, flatten(pieces) AS toks, {WIDTH} - len(q) - 3 AS room, len(flatten(pieces)) AS n,
            coalesce(list_sum([len(p) for p in pieces[1:start_position]]), 0)::INT AS ts,
            coalesce(list_sum([len(p) for p in pieces[1:end_position + 1]]), 0)::INT - 1 AS te,
            flatten(list_transform(pieces, lambda p, i: [i - 1 for x in p])) AS orig FROM ex),
  better AS MATERIALIZED (SELECT *, [a for a in range(ts, te - len(ans) + 2) if len(ans) > 0 and toks[a + 1:a + len(ans)] = ans][1] AS hit FROM flat),
  spans AS MATERIALIZED (SELECT doc_id, sp // {STRIDE} AS idx, sp, least(room, n - sp) AS len
            FROM (SELECT doc_id, n, room, unnest(range(0, n + 1, {STRIDE})) AS sp FROM flat)
            WHERE least(room, n - sp) > 0 AND (sp = 0 OR sp - {STRIDE} + room < n)),
  holding AS (SELECT doc_id, idx, p, least(p - sp, sp + len - 1 - p) + 0.01::DOUBLE * len AS score
              FROM (SELECT *, unnest(range(sp, sp + len)) AS p FROM spans)),
  maxctx AS (SELECT doc_id, idx, string_agg(CASE WHEN idx = best THEN '1' ELSE '0' END, '' ORDER BY p) AS flags
             FROM (SELECT *, first_value(idx) OVER (PARTITION BY doc_id, p ORDER BY score DESC, idx) AS best FROM holding) GROUP BY doc_id, idx),
  feats AS MATERIALIZED (SELECT s.doc_id, s.idx, ['[CLS]'] || b.q || ['[SEP]'] || b.toks[s.sp + 1:s.sp + s.len] || ['[SEP]'] AS tokens,
              b.orig[s.sp + 1:s.sp + s.len] AS orig, m.flags, len(b.q) + 2 AS off, b.ws, s.len,
              CASE WHEN b.impossible THEN NULL ELSE coalesce(b.hit, b.ts) END AS a_s,
              CASE WHEN b.impossible THEN NULL ELSE coalesce(b.hit + len(b.ans) - 1, b.te) END AS a_e, s.sp
            FROM spans s JOIN better b USING (doc_id) JOIN maxctx m USING (doc_id, idx))"""


@query(
    "qa_features",
    f"""WITH {_FEATURES_CTE}
        SELECT doc_id::VARCHAR AS qas_id, idx::INT AS doc_span_index, len(tokens)::INT AS n_tokens, {digest_sql('tokens')} AS tokens_md5,
          {digest_sql('orig')} AS orig_md5, md5(flags) AS max_context_md5,
          (CASE WHEN a_s >= sp AND a_e <= sp + len - 1 THEN a_s - sp + off ELSE 0 END)::INT AS start_index,
          (CASE WHEN a_s >= sp AND a_e <= sp + len - 1 THEN a_e - sp + off ELSE 0 END)::INT AS end_index,
          999999999 + row_number() OVER (ORDER BY doc_id::VARCHAR, idx) AS unique_id
        FROM feats""",
)
def qa_features(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping windows with original word numbers, maximal context and answer positions."""
    ready = prepared(A.training_examples(A.read_questions(articles(spark, sf))))
    found = A.window_features(ready, "pieces", "query", WIDTH, STRIDE, QUERY)
    inner = F.filter("token_to_orig", lambda o: o.isNotNull())
    first = F.array_position("tokens", "[SEP]").cast("int")
    flags = F.slice("token_is_max_context", first + 1, F.size(inner))
    digests = found.select(
        "qas_id",
        "doc_span_index",
        F.size("tokens").alias("n_tokens"),
        digest(F.col("tokens")).alias("tokens_md5"),
        digest(inner).alias("orig_md5"),
        F.md5(joined(flags.cast("array<int>"), "")).alias("max_context_md5"),
        "start_index",
        "end_index",
    )
    # numbered when they are small: numbering stores its rows
    return A.with_unique_ids(digests)


_START = f"round({uniform_sql(21, 'doc_id', 'idx', 'p - 1')} * 8, 4)"
_END = f"round({uniform_sql(22, 'doc_id', 'idx', 'p - 1')} * 8, 4)"
_TOK = f"array_to_string({S.basic_tokens('orig_text')}, ' ')"


def _nospace(x: str) -> str:
    return f"replace({x}, ' ', '')"


_NBEST_CTE = f"""{_FEATURES_CTE},
  logits AS MATERIALIZED (SELECT *, list_transform(tokens, lambda t, p: {_START}) AS sl, list_transform(tokens, lambda t, p: {_END}) AS el FROM feats),
  tops AS MATERIALIZED (SELECT *, [x.i for x in list_sort(list_transform(sl, lambda v, p: {{'k': -v, 'i': p - 1}}))[1:6]] AS ss,
                [x.i for x in list_sort(list_transform(el, lambda v, p: {{'k': -v, 'i': p - 1}}))[1:6]] AS es FROM logits),
  cands AS MATERIALIZED (SELECT *, sl[s + 1] AS s_logit, el[e + 1] AS e_logit FROM (SELECT *, unnest(es) AS e FROM (SELECT *, unnest(ss) AS s FROM tops))
            WHERE s >= off AND s < off + len AND e >= off AND e < off + len AND e >= s AND e - s + 1 <= 12 AND substr(flags, (s - off + 1)::INT, 1) = '1'),
  worded AS MATERIALIZED (SELECT doc_id, idx, s, e, s_logit, e_logit, array_to_string(tokens[s + 1:e + 1], ' ') AS pred,
             array_to_string(ws[orig[s - off + 1] + 1:orig[e - off + 1] + 1], ' ') AS orig_text FROM cands),
  tokenized AS MATERIALIZED (SELECT *, {_TOK} AS tok FROM worded),
  aligned AS MATERIALIZED (SELECT *, instr(tok, pred) - 1 AS st, length({_nospace('left(tok, instr(tok, pred) - 1)')}) AS k1,
              length({_nospace('left(tok, instr(tok, pred) - 1 + length(pred))')}) - 1 AS k2,
              [i for i in range(1, length(orig_text) + 1) if substr(orig_text, i, 1) <> ' '] AS places FROM tokenized),
  named AS MATERIALIZED (SELECT doc_id, idx, s, e, s_logit, e_logit, CASE WHEN st >= 0 AND length({_nospace('tok')}) = length({_nospace('orig_text')})
                 THEN substr(orig_text, places[k1 + 1], places[k2 + 1] - places[k1 + 1] + 1) ELSE orig_text END AS text FROM aligned),
  empties AS (SELECT doc_id, min_by({{'s': sl[1], 'e': el[1]}}, {{'k': sl[1] + el[1], 'i': idx}}) AS x FROM logits GROUP BY doc_id),
  offered AS MATERIALIZED (SELECT * FROM named UNION ALL SELECT doc_id, 2147483647, 2147483647, 2147483647, x.s, x.e, '' FROM empties),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY -(s_logit + e_logit), idx, s, e) AS r FROM offered),
  best AS MATERIALIZED (SELECT * REPLACE (least(rank, 7) AS rank) FROM (
             SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -(s_logit + e_logit), idx, s, e) AS rank FROM firsts WHERE r = 1)
           WHERE rank <= 6 OR text = '')"""


def raw_results(spans: DataFrame) -> DataFrame:
    """The results as a model gives them, a table of their own: unique_id and two scores a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, span, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            row = np.repeat(np.arange(len(n)), n)
            ends = np.concatenate([[0], np.cumsum(n)])
            place = np.arange(len(row)) - ends[row]
            scores = [np.floor(uniforms(seed, doc[row], span[row], place) * 8 * 1e4 + 0.5) / 1e4 for seed in (21, 22)]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in scores]
            yield pa.RecordBatch.from_arrays([batch.column(3), *lists], names=["unique_id", "start_logits", "end_logits"])

    known = spans.where("n_tokens IS NOT NULL").select(F.col("qas_id").cast("bigint"), "doc_span_index", "n_tokens", "unique_id")
    return known.mapInArrow(run, "unique_id long, start_logits array<double>, end_logits array<double>")


def answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Best answers and null scores. Raw results are a table of their own, as a model writes them.

    The spans are numbered by lengths alone. The results are reduced in their rows, meet their
    spans by unique_id and travel to the text of their question, where the features are laid out:
    features and logits are neither stored nor shuffled.
    """
    asked = A.read_questions(articles(spark, sf))
    lengths = stage(A.question_lengths(prepared(A.training_examples(asked)), "pieces", "query", QUERY), "question-lengths")
    spans = stage(A.with_unique_ids(A.spans_of_lengths(lengths, WIDTH, STRIDE)), "spans-numbered")
    results = stage(A.results_of_questions(spans, raw_results(spans), 6), "question-results")
    ready = prepared(A.training_examples(asked.join(results.withColumnRenamed("qas_id", "_qas_id"), F.col("qas_id") == F.col("_qas_id")).drop("_qas_id")))
    scored = A.window_features(ready, "pieces", "query", WIDTH, STRIDE, QUERY, words=True, results="results")
    candidates = A.candidates_of_best(scored.withColumn("feature_index", F.col("doc_span_index")), longest=12)
    each = results.select("qas_id", F.inline("results"))
    nulls = A.null_scores(
        each.select("qas_id", F.col("span").alias("feature_index"), F.array("null_start").alias("start_logits"), F.array("null_end").alias("end_logits"))
    )
    return A.n_best(candidates, n=6, nulls=nulls, questions=lengths), nulls


@query(
    "qa_nbest",
    f"""WITH {_NBEST_CTE}
        SELECT doc_id::VARCHAR AS qas_id, rank::INT AS rank, text, round(exp(s_logit + e_logit - max(s_logit + e_logit) OVER w)
            / sum(exp(s_logit + e_logit)) OVER w * exp(max(s_logit + e_logit) OVER w), 6) AS probability
        FROM best WINDOW w AS (PARTITION BY doc_id)""",
)
def qa_nbest(spark: SparkSession, sf: str) -> DataFrame:
    """Best distinct answer texts of every question with their probabilities."""
    best, _ = answers(spark, sf)
    rated = A.with_probabilities(best)
    return rated.select("qas_id", "rank", "text", F.round("probability", 6).alias("probability"))


@query(
    "qa_decide",
    f"""WITH {_NBEST_CTE},
          nulls AS (SELECT doc_id, min(sl[1] + el[1]) AS score_null FROM logits GROUP BY doc_id),
          top AS (SELECT doc_id, min_by(text, rank) AS text, min_by(s_logit, rank) AS s, min_by(e_logit, rank) AS e FROM best WHERE text <> '' GROUP BY doc_id)
        SELECT n.doc_id::VARCHAR AS qas_id, round(score_null - s - e, 4) AS score_diff,
          CASE WHEN s IS NULL OR score_null - s - e > -9 THEN '' ELSE text END AS prediction
        FROM nulls n LEFT JOIN top t USING (doc_id)""",
)
def qa_decide(spark: SparkSession, sf: str) -> DataFrame:
    """Answer or none, by the difference to the score of no answer."""
    best, nulls = answers(spark, sf)
    decided = A.decide(best, nulls, threshold=-9.0)
    return decided.select("qas_id", F.round("score_diff", 4).alias("score_diff"), "prediction")
