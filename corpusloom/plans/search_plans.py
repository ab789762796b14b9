"""Lexical and vector search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.columns import literal_rows
from corpusloom.operators import bounded_search as B
from corpusloom.operators import chunking as C
from corpusloom.operators import lexical_search as L
from corpusloom.operators import retrieval as R
from corpusloom.operators import vector_index as I
from corpusloom.operators import vector_search as V
from corpusloom.plans import sqltext as S
from corpusloom.plans.registry import query, table, texts
from corpusloom.staging import fresh_path

ASKED = ((0, "the of the"), (1, "licensed under the apache license"), (2, "Erachtz Stteen"), (3, "no-such-word"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def asked(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, qid=[q for q, _ in ASKED], text=[t for _, t in ASKED])


_VALUES = ", ".join(f"({q}, {S.lit(t)})" for q, t in ASKED)
ASKED_SQL = f"(SELECT * FROM (VALUES {_VALUES}) v(qid, text))"


def scores_sql(chunks: str, queries: str) -> str:
    """raw scores (qid, chunk_id, raw)."""
    return f"""(WITH toks AS (SELECT chunk_id, {S.words('text')} AS ws FROM {chunks}),
      post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(ws) AS dl, unnest(ws) AS term FROM toks) GROUP BY ALL),
      dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
      stats AS (SELECT count(*) AS n, avg(len(ws))::DOUBLE AS avgdl FROM toks),
      qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({S.words('text')}) AS term FROM {queries}) GROUP BY ALL)
      SELECT qid, chunk_id, sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE
             / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS raw
      FROM qt JOIN post USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY qid, chunk_id)"""


def topk_sql(chunks: str, queries: str, k: int) -> str:
    return f"""(SELECT qid, rank::INT AS rank, chunk_id, round(raw, 4) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, chunk_id) AS rank
      FROM {scores_sql(chunks, queries)}) WHERE rank <= {k})"""


DOCS_SQL = "(SELECT doc_id AS chunk_id, text FROM documents)"
_TOP10 = f"SELECT * FROM {topk_sql(DOCS_SQL, ASKED_SQL, 10)}"


@query("bm25_topk", _TOP10)
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return L.search_chunks(documents(spark, sf), asked(spark), 10)


@query("bm25_stored_index", _TOP10)
def bm25_stored_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same search on an index that was written and read back."""
    path = fresh_path(spark, "index")
    L.save_index(L.build_index(documents(spark, sf)), path)
    return L.search(L.load_index(spark, path), asked(spark), 10)


_DOCS_BY_TURN = "(SELECT conv_id * 1000 + turn AS qid, text FROM conversations)"


@query("bm25_turns", f"SELECT * FROM {topk_sql(DOCS_SQL, _DOCS_BY_TURN, 3)}")
def bm25_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of the conversations as a query on blocks that were written and read back."""
    path = fresh_path(spark, "blocks")
    B.save_blocks(B.build_blocks(L.build_index(documents(spark, sf))), path)
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    return B.search(B.load_blocks(spark, path), turns, 3)


@query(
    "bm25_batch",
    f"SELECT * FROM {topk_sql(DOCS_SQL, '(SELECT item_id AS qid, text FROM benchmark)', 5)}",
)
def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage of the second table as a query."""
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return B.search_chunks(documents(spark, sf), queries, 5)


_CHUNKS_SQL = f"""(SELECT doc_id || ':' || (st // 800) AS chunk_id, {S.strip('substr(clean, st + 1, 1000)')} AS text
  FROM (SELECT doc_id, clean, unnest(range(0, length(clean), 800)) AS st
        FROM (SELECT doc_id, {S.clean_basic('text')} AS clean FROM documents)))"""


@query(
    "bm25_chunks",
    f"""SELECT t.qid, t.rank, t.chunk_id, t.score, md5(c.text) AS text_md5
        FROM {topk_sql(_CHUNKS_SQL, ASKED_SQL, 3)} t JOIN {_CHUNKS_SQL} c USING (chunk_id)""",
)
def bm25_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Search over windows instead of documents, with the text of the hits."""
    clean = texts(spark, sf, "documents").select("doc_id", T.clean_basic(F.col("text")).alias("clean"))
    chunks = C.explode_chunks(clean, C.fixed_windows(F.col("clean")), "doc_id").select(
        F.concat_ws(":", "doc_id", "chunk_no").alias("chunk_id"), F.col("content").alias("text")
    )
    hits = L.search_chunks(chunks, asked(spark), 3)
    return L.with_text(hits, chunks).select("qid", "rank", "chunk_id", "score", F.md5("text").alias("text_md5"))


@query(
    "bm25_index_stats",
    f"""WITH toks AS (SELECT doc_id, {S.words('text')} AS ws FROM documents),
          post AS (SELECT DISTINCT doc_id, unnest(ws) AS term FROM toks)
        SELECT (SELECT count(*) FROM toks)::BIGINT AS n_docs, round((SELECT avg(len(ws)) FROM toks), 6) AS mean_length,
          (SELECT count(DISTINCT term) FROM post)::BIGINT AS n_terms, (SELECT count(*) FROM post)::BIGINT AS n_postings""",
)
def bm25_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    index = L.build_index(documents(spark, sf))
    n_docs, mean_length = index.stats.first()
    return index.terms.agg(
        F.lit(n_docs).cast("bigint").alias("n_docs"),
        F.round(F.lit(mean_length), 6).alias("mean_length"),
        F.count(F.lit(1)).alias("n_terms"),
        F.sum("df").alias("n_postings"),
    )


@query(
    "bm25_terms",
    f"""SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf
        FROM (SELECT doc_id, unnest({S.words('text')}) AS term FROM documents) GROUP BY term""",
)
def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    postings = L.build_index(documents(spark, sf)).postings
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


# -- around the search ------------------------------------------------------------------------


@query(
    "rerank_topn",
    f"""SELECT qid, chunk_id, rank::INT AS new_rank, round(s, 6) AS rerank_score FROM (
          SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM (
            SELECT t.qid, t.chunk_id, CASE WHEN len(list_distinct({S.words('q.text')})) = 0 THEN 0 ELSE
                 len(list_intersect(list_distinct({S.words('q.text')}), {S.words('d.text')}))::DOUBLE / len(list_distinct({S.words('q.text')})) END AS s
            FROM {topk_sql(DOCS_SQL, ASKED_SQL, 10)} t JOIN {ASKED_SQL} q USING (qid) JOIN documents d ON d.doc_id = t.chunk_id))
        WHERE rank <= 3""",
)
def rerank_topn(spark: SparkSession, sf: str) -> DataFrame:
    docs, queries = documents(spark, sf), asked(spark)
    hits = L.with_text(L.search_chunks(docs, queries, 10), docs)
    both = hits.join(queries.withColumnRenamed("text", "question"), "qid")
    ranked = R.rerank(both, R.overlap_score(F.col("question"), F.col("text")), 3)
    return ranked.select("qid", "chunk_id", "new_rank", F.round("rerank_score", 6).alias("rerank_score"))


@query(
    "rerank_documents",
    """SELECT conv_id, turn, i::INT AS idx, (CASE WHEN i >= 0 AND i < len(ws) THEN ws[i + 1] END) AS document
       FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws, unnest([2, 0, len(string_split(text, ' ')), -1]) AS i FROM conversations)""",
)
def rerank_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a reranking service name documents by index; bad indexes give no document."""
    docs = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("ws"))
    indexes = (F.lit(2), F.lit(0), F.size("ws"), F.lit(-1))
    items = F.array(*[F.struct(i.alias("index"), F.lit(0.5).alias("score")) for i in indexes])
    found = docs.select("conv_id", "turn", F.inline(R.attach_documents(items, F.col("ws"))))
    return found.select("conv_id", "turn", F.col("index").alias("idx"), "document")


@query(
    "prompt_context",
    f"""SELECT qid, md5(string_agg(block, chr(10)||chr(10) ORDER BY rank)) AS context_md5,
          sum(length(block))::BIGINT AS chars FROM (
          SELECT qid, rank, 'Retrieved chunk ' || rank || chr(10) || 'pdf_sha1: ' || chunk_id || chr(10) || 'document: ' || source
            || chr(10) || 'label: ' || lang || chr(10) || 'page_index: 0' || chr(10) || 'chunk_no: 0' || chr(10)
            || 'cosine_similarity: ' || printf('%.6f', score) || chr(10) || 'content:' || chr(10) || d.text AS block
          FROM {topk_sql(DOCS_SQL, ASKED_SQL, 5)} t JOIN documents d ON d.doc_id = t.chunk_id) GROUP BY qid""",
)
def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    hits = L.with_text(L.search_chunks(docs, asked(spark), 5), docs)
    zero = F.lit(0)
    block = R.context_block(
        F.col("rank"), F.col("chunk_id"), F.col("source"), F.col("lang"), zero, zero, F.col("score"), F.col("text")
    )
    contexts = R.prompt_context(hits, block)
    return contexts.select(
        "qid",
        F.md5("context").alias("context_md5"),
        (F.length("context") - 2 * (F.size(F.split("context", "(?m)^Retrieved chunk ")) - 2)).cast("bigint").alias("chars"),
    )


_GREP = r"\b(License|Licensed)\b"


@query(
    "grep_lines",
    """SELECT doc_id, (i - 1)::INT AS line_no, ls[i] AS line,
         md5(array_to_string(ls[greatest(i - 1, 1):i + 1], chr(10))) AS around_md5
       FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
       WHERE regexp_matches(ls[i], '\\b(License|Licensed)\\b')""",
)
def grep_lines(spark: SparkSession, sf: str) -> DataFrame:
    hits = R.grep(texts(spark, sf, "documents"), "doc_id", "text", _GREP, context=1)
    return hits.select("doc_id", "line_no", "line", F.md5("around").alias("around_md5"))


@query(
    "alias_route",
    f"""SELECT DISTINCT c.conv_id AS qid, a.n_name AS alias, a.n_nationkey AS doc_id FROM (
          SELECT conv_id, text || ' about NATION_' || (conv_id % 30) || ' and nation_' || (turn % 25) AS text FROM conversations) c
        JOIN nation a ON list_contains({S.words('c.text')}, lower(a.n_name))""",
)
def alias_route(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    question = F.concat(
        F.col("text"), F.lit(" about NATION_"), (F.col("conv_id") % 30).cast("string"),
        F.lit(" and nation_"), (F.col("turn") % 25).cast("string"),
    )
    aliases = table(spark, sf, "nation").select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("doc_id"))
    return R.route(turns.select(F.col("conv_id").alias("qid"), question.alias("text")), aliases)


_PARENTS_SQL = """(SELECT doc_id || '/' || (st // 1000) AS parent_id, substr(text, st + 1, 1000) AS text
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS st FROM documents))"""
_CHILDREN_SQL = f"""(SELECT parent_id || '/' || (st // 250) AS chunk_id, parent_id, substr(text, st + 1, 250) AS text
  FROM (SELECT parent_id, text, unnest(range(0, length(text), 250)) AS st FROM {_PARENTS_SQL}))"""


@query(
    "parent_expand",
    f"""SELECT h.qid, p.parent_id, max(h.score) AS score, count(*)::BIGINT AS n_children, md5(any_value(p.text)) AS text_md5
        FROM {topk_sql(_CHILDREN_SQL, ASKED_SQL, 20)} h JOIN {_CHILDREN_SQL} c USING (chunk_id) JOIN {_PARENTS_SQL} p USING (parent_id)
        GROUP BY h.qid, p.parent_id""",
)
def parent_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Small windows are searched, the large windows around them returned."""

    def windows(df: DataFrame, key: str, size: int, out: str, *keep: str) -> DataFrame:
        pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        rows = df.select(key, *keep, F.posexplode(pieces).alias("_n", "piece"))
        return rows.select(F.concat_ws("/", key, "_n").alias(out), key, F.col("piece").alias("text"))

    parents = windows(texts(spark, sf, "documents"), "doc_id", 1000, "parent_id").select("parent_id", "text")
    children = windows(parents, "parent_id", 250, "chunk_id")
    hits = L.search_chunks(children, asked(spark), 20)
    expanded = R.expand_parents(hits, children, parents)
    return expanded.select("qid", "parent_id", "score", "n_children", F.md5("text").alias("text_md5"))


# -- vectors ------------------------------------------------------------------------------------


def _vector(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    return table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


_COS = S.cosine("e.embedding", "q.embedding")
_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(
    "cosine_topk",
    f"""SELECT vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q0} ORDER BY round({_COS}, 9) DESC, vec_id LIMIT 10""",
)
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    best = V.nearest(table(spark, sf, "embeddings"), _vector(spark, sf, 0), 10)
    return best.select("vec_id", F.round("score", 6).alias("score"))


@query(
    "cosine_topk_per_label",
    f"""SELECT label, rank::INT AS rank, vec_id, round(s, 6) AS score FROM (
          SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS rank
          FROM (SELECT e.label, e.vec_id, {_COS} AS s FROM embeddings e, {_Q0})) WHERE rank <= 3""",
)
def cosine_topk_per_label(spark: SparkSession, sf: str) -> DataFrame:
    best = V.nearest_per_group(table(spark, sf, "embeddings"), _vector(spark, sf, 0), 3, "label")
    return best.select("label", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(
    "cosine_threshold",
    f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q0} WHERE {_COS} >= 0.2",
)
def cosine_threshold(spark: SparkSession, sf: str) -> DataFrame:
    near = V.above(table(spark, sf, "embeddings"), _vector(spark, sf, 0), 0.2)
    return near.select("vec_id", F.round("score", 6).alias("score"))


@query(
    "filtered_search",
    f"""SELECT vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q0} WHERE e.label = 3
        ORDER BY round({_COS}, 9) DESC, vec_id LIMIT 5""",
)
def filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    """The filter is applied by the scan, before any similarity is computed."""
    candidates = table(spark, sf, "embeddings").where(F.col("label") == 3)
    best = V.nearest(candidates, _vector(spark, sf, 0), 5)
    return best.select("vec_id", F.round("score", 6).alias("score"))


@query(
    "cosine_batch",
    f"""SELECT qid, rank::INT AS rank, vec_id, round(s, 6) AS score FROM (
          SELECT qid, vec_id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) AS rank
          FROM (SELECT q.vec_id AS qid, e.vec_id, {_COS} AS s FROM embeddings e, embeddings q WHERE q.label = 7)) WHERE rank <= 5""",
)
def cosine_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors of one label as queries against the whole table."""
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where("label = 7").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    best = I.search_all(vectors, queries, 5)
    return best.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


def _index(spark: SparkSession, sf: str) -> tuple[I.VectorIndex, DataFrame]:
    """The index of all vectors, read back, and every fiftieth as a query."""
    vectors = table(spark, sf, "embeddings")
    path = fresh_path(spark, "vector-index")
    I.build_index(vectors, path)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    return I.load_index(spark, path), queries


@query("ivf_search")
def ivf_search(spark: SparkSession, sf: str) -> DataFrame:
    """As many lists as hold 0.95 of the best ten, measured on stored vectors."""
    index, queries = _index(spark, sf)
    best = I.search(index, queries, 10, probes=I.calibrate(index, 10))
    return best.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(
    "ivf_search_exact",
    f"""SELECT qid, rank::INT AS rank, vec_id, round(s, 6) AS score FROM (
          SELECT qid, vec_id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) AS rank
          FROM (SELECT q.vec_id AS qid, e.vec_id, {_COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""",
)
def ivf_search_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The same index; lists that the bound on their members rules out are not visited."""
    index, queries = _index(spark, sf)
    best = I.search(index, queries, 10, probes=4, exact=True)
    return best.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(
    "embed_documents",
    f"""WITH codes AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS c
          FROM (SELECT doc_id, unnest({S.words('text')}) AS w FROM documents)),
          cells AS (SELECT doc_id, c % 64 AS j, sum(CASE WHEN c < 64 THEN 1 ELSE -1 END)::DOUBLE AS x FROM codes GROUP BY ALL),
          norms AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM cells GROUP BY doc_id),
          dots AS (SELECT a.doc_id, sum(a.x * b.x) AS d FROM cells a JOIN cells b ON b.doc_id = 0 AND a.j = b.j GROUP BY a.doc_id)
        SELECT doc_id, round(s, 6) AS score FROM (
          SELECT doc_id, d / (n * (SELECT n FROM norms WHERE doc_id = 0)) AS s FROM dots JOIN norms USING (doc_id) WHERE n > 0)
        ORDER BY round(s, 9) DESC, doc_id LIMIT 10""",
)
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed vectors of the documents and the nearest ones to the first document."""
    docs = texts(spark, sf, "documents").select("doc_id", V.hashed_embedding(F.col("text")).alias("embedding"))
    first = docs.where("doc_id = 0").first()["embedding"]
    best = V.nearest(docs, first, 10, key="doc_id")
    return best.select("doc_id", F.round("score", 6).alias("score"))
