"""Streaming queries: the batch steps on a stream of the given files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking as C
from corpusloom.operators import composition as P
from corpusloom.plans import sqltext as S
from corpusloom.plans.chunk_plans import _FIXED_SQL
from corpusloom.plans.registry import query, table, texts
from corpusloom.staging import fresh_path
from corpusloom.streaming import flows


def _clean(df: DataFrame) -> DataFrame:
    return df.select("doc_id", T.clean_basic(F.col("text")).alias("clean"))


def _chunks(df: DataFrame) -> DataFrame:
    chunks = C.explode_chunks(df, C.fixed_windows(F.col("clean")), "doc_id")
    return chunks.select("doc_id", "chunk_no", F.md5("content").alias("content_md5"))


_STEP = P.sequence(_clean, _chunks)


def _files(sf: str, name: str) -> str:
    """A table as a stream reads it, be it one file or a folder of files: a stream takes a file only
    by a pattern."""
    return f"{sf}/{name}.parque[t]"


@query("stream_chunks", f"SELECT doc_id, chunk_no, md5(content) AS content_md5 FROM ({_FIXED_SQL})")
def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk step as a stream: every file is processed once and appended."""
    schema = table(spark, sf, "documents").schema
    return flows.replay(spark, _files(sf, "documents"), schema, _STEP, glob="*")


@query(
    "stream_upserts",
    "SELECT conv_id AS id, max_by(role, turn) AS role, max(turn)::BIGINT AS version FROM conversations GROUP BY conv_id",
)
def stream_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Micro-batches upserted by id."""
    schema = table(spark, sf, "conversations").schema
    stream = flows.file_stream(spark, _files(sf, "conversations"), schema, glob="*").select(
        F.col("conv_id").alias("id"), "role", F.col("turn").alias("version")
    )
    path, state = fresh_path(spark, "stream-table"), fresh_path(spark, "stream-state")
    flows.to_upserts(stream, path, "id", ["version"], state).awaitTermination()
    return flows.current_rows(spark, path, "id", ["version"])


@query(
    "composed_steps",
    f"""SELECT doc_id, lang, length(c)::INT AS n_chars_clean, len({S.whitespace_tokens('c')})::INT AS n_tokens
        FROM (SELECT doc_id, lang, {S.clean_basic('text')} AS c FROM documents)""",
)
def composed_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Assign, parallel and pick steps in one sequence, with a fallback for a missing column."""
    prefer_summary = P.with_fallbacks(P.pick("doc_id", "lang", "summary"), P.pick("doc_id", "lang", "text"))
    choose = P.alternatives("plain", plain=prefer_summary, whole=P.pick("doc_id", "lang", "text"))
    step = P.sequence(
        choose(),
        P.sequence(P.assign(clean=T.clean_basic(F.col("text"))), P.pick("doc_id", "lang", "clean")),
        P.parallel(
            doc_id=F.col("doc_id"),
            lang=F.col("lang"),
            n_chars_clean=F.length("clean"),
            n_tokens=F.size(T.whitespace_tokens(F.col("clean"))),
        ),
    )
    return texts(spark, sf, "documents").transform(step)


@query(
    "parallel_branches",
    """SELECT lang, count(*)::BIGINT AS n_docs, max(n_chars)::BIGINT AS longest FROM documents GROUP BY lang""",
)
def parallel_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Two aggregating branches joined on their key."""
    step = P.parallel_frames(
        "lang",
        counts=lambda df: df.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs")),
        sizes=lambda df: df.groupBy("lang").agg(F.max("n_chars").alias("longest")),
    )
    return table(spark, sf, "documents").select("lang", "n_chars").transform(step)
