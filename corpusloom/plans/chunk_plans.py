"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking as C
from corpusloom.operators.ordering import running_totals
from corpusloom.plans import sqltext as S
from corpusloom.plans.registry import query, texts

# Documents are prose without Markdown; the page queries read them with some lines rewritten:
# "a, b" lines of moderate length become table rows, short lines become headers.
TABLE_LINE = r"(?m)^([^\n,]{1,100}), ([^\n]{1,100})$"
SHORT_LINE = r"(?m)^([^|\n][^\n]{0,39})$"


def page_markdown(text: Column) -> Column:
    rows = F.regexp_replace(text, TABLE_LINE, "| $1 | $2 |")
    return F.regexp_replace(rows, SHORT_LINE, "## $1")


def markdown_pages(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents")
    return docs.select("doc_id", "lang", "source", page_markdown(F.col("text")).alias("text"))


PAGES_SQL = f"(SELECT doc_id, lang, source, {S.page_markdown('text')} AS text FROM documents)"


# -- windows ------------------------------------------------------------------------------

_FIXED_SQL = f"""
  SELECT doc_id, lang, source, (st // 800)::INT AS chunk_no, st::INT AS char_start,
         {S.strip("substr(clean, st + 1, 1000)")} AS content
  FROM (SELECT doc_id, lang, source, clean, unnest(range(0, length(clean), 800)) AS st
        FROM (SELECT doc_id, lang, source, {S.clean_basic('text')} AS clean FROM documents))"""


def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents").select("doc_id", "lang", "source", T.clean_basic(F.col("text")).alias("clean"))
    return C.explode_chunks(docs, C.fixed_windows(F.col("clean")), "doc_id", "lang", "source")


@query(
    "chunk_fixed",
    f"""SELECT doc_id, chunk_no, char_start, length(content)::INT AS char_count,
          len({S.whitespace_tokens('content')})::INT AS token_count, md5(content) AS content_md5,
          doc_id || ':' || chunk_no || ':raw_fixed_1000_200' AS id
        FROM ({_FIXED_SQL})""",
)
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    content = F.col("content")
    label = F.lit(T.default_label("raw_fixed", 1000, 200))
    return fixed_chunks(spark, sf).select(
        "doc_id",
        "chunk_no",
        "char_start",
        F.length(content).alias("char_count"),
        F.size(T.whitespace_tokens(content)).alias("token_count"),
        F.md5(content).alias("content_md5"),
        T.chunk_id(F.col("doc_id"), F.col("chunk_no"), label).alias("id"),
    )


@query(
    "chunk_stats",
    f"""SELECT lang, count(*)::BIGINT AS n_chunks, count(DISTINCT doc_id)::BIGINT AS n_docs,
          min(length(content))::INT AS min_chars, max(length(content))::INT AS max_chars,
          (sum(length(content)) // count(*))::BIGINT AS mean_chars
        FROM ({_FIXED_SQL}) GROUP BY lang""",
)
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("content")
    per_doc = fixed_chunks(spark, sf).groupBy("lang", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.sum(size).alias("chars")
    )
    # one row per document is left: counting them is counting distinct documents
    return per_doc.groupBy("lang").agg(
        F.sum("n").alias("n_chunks"),
        F.count(F.lit(1)).alias("n_docs"),
        F.min("lo").alias("min_chars"),
        F.max("hi").alias("max_chars"),
        F.expr("sum(chars) div sum(n)").alias("mean_chars"),
    )


def _cut_sql(window: str) -> str:
    def cut(sep: str) -> str:
        return f"nullif(regexp_extract({window}, '(?s)\\A.{{600,}}{sep}'), '')"

    return f"coalesce({cut(chr(92) + 'n' + chr(92) + 'n')}, {cut(chr(92) + 'n')}, {cut(chr(92) + '. ')}, {cut(' ')}, {window})"


def _boundary_sql(next_start: str) -> str:
    """The window loop as a recursive query; ``next_start`` from start st and end en."""
    return f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, {S.normalize_page('text')} AS t FROM documents),
      cuts AS (
        SELECT doc_id, 0 AS st, CASE WHEN length(t) <= 1000 THEN length(t)
               ELSE length({_cut_sql('substr(t, 1, 1000)')}) END AS en
        FROM docs WHERE length(t) > 0
        UNION ALL
        SELECT doc_id, st, CASE WHEN st + 1000 >= length(t) THEN length(t)
               ELSE st + length({_cut_sql('substr(t, st + 1, 1000)')}) END AS en
        FROM (SELECT c.doc_id, {next_start} AS st, d.t FROM cuts c JOIN docs d USING (doc_id) WHERE c.en < length(d.t)))
      SELECT doc_id, (st + length(span) - length({S.lstrip('span')}))::INT AS char_start, (en)::INT AS char_end,
             md5({S.strip('span')}) AS content_md5
      FROM (SELECT doc_id, st, en, substr(t, st + 1, en - st) AS span FROM cuts JOIN docs USING (doc_id))
      WHERE {S.strip('span')} <> ''"""


def _boundary(spark: SparkSession, sf: str, strict: bool) -> DataFrame:
    pages = texts(spark, sf, "documents").select("doc_id", T.normalize_page(F.col("text")).alias("t"))
    chunks = C.explode_chunks(pages, C.boundary_windows(F.col("t"), strict=strict), "doc_id")
    return chunks.select("doc_id", "char_start", "char_end", F.md5("content").alias("content_md5"))


@query("chunk_boundary", _boundary_sql("greatest(c.en - 200, c.st + 800)"))
def chunk_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return _boundary(spark, sf, strict=False)


@query("chunk_boundary_strict", _boundary_sql("c.en - 200"))
def chunk_boundary_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _boundary(spark, sf, strict=True)


@query(
    "chunk_pages",
    f"""WITH cleaned AS (SELECT doc_id, [{S.clean_recursive('p')} for p in string_split(text, chr(10))] AS pages FROM documents),
      composed AS (SELECT doc_id, array_to_string(pages, chr(10)||chr(10)) AS t FROM cleaned),
      windows AS (SELECT doc_id, st, t, CASE WHEN st + 1000 >= length(t) THEN substr(t, st + 1)
                    ELSE {_cut_sql('substr(t, st + 1, 1000)')} END AS span
                  FROM (SELECT doc_id, t, unnest(range(0, greatest(length(t) - 1000 + 799, 0) // 800 + 1)) * 800 AS st
                        FROM composed WHERE length(t) > 0)),
      spans AS (SELECT doc_id, page, sum(len + 2) OVER (PARTITION BY doc_id ORDER BY page) - len - 2 AS s,
                       sum(len + 2) OVER (PARTITION BY doc_id ORDER BY page) - 2 AS e,
                       max(page) OVER (PARTITION BY doc_id) AS last_page
                FROM (SELECT doc_id, unnest(range(0, len(pages))) AS page, unnest([length(p) for p in pages]) AS len FROM cleaned)),
      chunks AS (SELECT doc_id, st // 800 AS chunk_no, st + length(span) - length({S.lstrip('span')}) AS at, {S.strip('span')} AS content
                 FROM windows)
      SELECT c.doc_id, c.at::INT AS char_start, coalesce(max(s.page), any_value(l.last_page))::INT AS page,
             length(c.content)::INT AS char_count
      FROM chunks c LEFT JOIN spans s ON s.doc_id = c.doc_id AND c.at >= s.s AND c.at < s.e
           JOIN (SELECT doc_id, max(last_page) AS last_page FROM spans GROUP BY doc_id) l ON l.doc_id = c.doc_id
      WHERE c.content <> '' GROUP BY c.doc_id, c.chunk_no, c.at, c.content""",
)
def chunk_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Lines stand for pages: composed, windowed, and each chunk put back on its page."""
    docs = texts(spark, sf, "documents").select(
        "doc_id", F.transform(F.split("text", "\n"), T.clean_recursive).alias("pages")
    )
    composed = docs.select("doc_id", "pages", C.compose_pages(F.col("pages")).alias("t"))
    located = C.with_pages(C.boundary_windows(F.col("t")), C.page_spans(F.col("pages")))
    chunks = C.explode_chunks(composed, located, "doc_id")
    return chunks.select("doc_id", "char_start", "page", F.length("content").alias("char_count"))


@query(
    "page_offsets",
    f"""SELECT doc_id, page::INT AS page, (sum(n + 2) OVER (PARTITION BY doc_id ORDER BY page) - n - 2)::BIGINT AS start_at,
          (sum(n + 2) OVER (PARTITION BY doc_id ORDER BY page) - 2)::BIGINT AS end_at
        FROM (SELECT doc_id, unnest(range(0, len(ls))) AS page, unnest([length(l) for l in ls])::BIGINT AS n
              FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""",
)
def page_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """The same spans for pages kept as rows, where a document may have any number of them."""
    pages = texts(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "p"))
    sized = pages.select("doc_id", "page", (F.length("p") + 2).cast("bigint").alias("_n"))
    ends = running_totals(sized, ["page"], {"_end": "_n"}, by=["doc_id"])
    return ends.select(
        "doc_id", "page", (F.col("_end") - F.col("_n")).alias("start_at"), (F.col("_end") - 2).alias("end_at")
    )


@query(
    "page_batches",
    """SELECT doc_id, b::INT AS batch, (b * 10)::INT AS first_page, (least((b + 1) * 10, n) - 1)::INT AS last_page
       FROM (SELECT doc_id, n, unnest(range(0, (n + 9) // 10)) AS b
             FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents))""",
)
def page_batches(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    ranges = docs.select("doc_id", F.posexplode(C.page_ranges(F.col("n"))).alias("batch", "r"))
    return ranges.select(
        "doc_id", "batch", F.array_min("r").alias("first_page"), F.array_max("r").alias("last_page")
    )


# -- structure ----------------------------------------------------------------------------

_MARKED = f"regexp_replace(text, '(?m)^(#{{1,6}}[{T.SPACE}])', chr(1)||'\\1', 'g')"
_SEGMENTS = (
    f"CASE WHEN regexp_matches(text, '(?m)^#{{1,6}}[{T.SPACE}]') "
    f"THEN [{S.strip('p')} for p in string_split({_MARKED}, chr(1))[2:]] ELSE [{S.strip('text')}] END"
)


@query(
    "header_split",
    f"""SELECT doc_id, len(segs)::INT AS n_segments, md5(array_to_string(segs, '|')) AS segments_md5
        FROM (SELECT doc_id, {_SEGMENTS} AS segs FROM {PAGES_SQL})""",
)
def header_split(spark: SparkSession, sf: str) -> DataFrame:
    pages = markdown_pages(spark, sf).select("doc_id", C.header_segments(F.col("text")).alias("segs"))
    return pages.select(
        "doc_id", F.size("segs").alias("n_segments"), F.md5(F.array_join("segs", "|")).alias("segments_md5")
    )


@query("body_text", f"SELECT doc_id, length(b)::INT AS body_len, md5(b) AS body_md5 FROM (SELECT doc_id, {S.body('text')} AS b FROM {PAGES_SQL})")
def body_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = markdown_pages(spark, sf).select("doc_id", T.body(F.col("text")).alias("b"))
    return pages.select("doc_id", F.length("b").alias("body_len"), F.md5("b").alias("body_md5"))


_NL2 = "chr(10)||chr(10)"
_PREFIXED = f"CASE WHEN acc.pre = '' THEN x.seg ELSE {S.strip(f'acc.pre||{_NL2}||x.seg')} END"
_NOISE = f"""list_reduce([{{'out': []::VARCHAR[], 'pre': '', 'seg': s}} for s in segs],
    lambda acc, x: {{
      'out': CASE WHEN length({S.body('x.seg')}) < 50 THEN acc.out ELSE list_append(acc.out, {_PREFIXED}) END,
      'pre': CASE WHEN length({S.body('x.seg')}) < 50 THEN {_PREFIXED} ELSE '' END,
      'seg': ''}},
    {{'out': []::VARCHAR[], 'pre': '', 'seg': ''}})"""
_KEPT = f"""CASE WHEN NOT headed THEN segs WHEN st.pre = '' THEN st.out
    WHEN len(st.out) > 0 THEN list_append(st.out[1:len(st.out)-1], {S.strip(f'st.out[-1]||{_NL2}||st.pre')})
    ELSE [st.pre] END"""
_NOISE_SQL = f"""SELECT doc_id, text, {_KEPT} AS segs FROM (
    SELECT doc_id, text, headed, segs, {_NOISE} AS st FROM (
      SELECT doc_id, text, regexp_matches(text, '(?m)^#{{1,6}}[{T.SPACE}]') AS headed, {_SEGMENTS} AS segs FROM {PAGES_SQL}))"""


@query(
    "noise_merge",
    f"SELECT doc_id, len(segs)::INT AS n_segments, md5(array_to_string(segs, '|')) AS segments_md5 FROM ({_NOISE_SQL})",
)
def noise_merge(spark: SparkSession, sf: str) -> DataFrame:
    pages = markdown_pages(spark, sf).select("doc_id", C.structural_segments(F.col("text")).alias("segs"))
    return pages.select(
        "doc_id", F.size("segs").alias("n_segments"), F.md5(F.array_join("segs", "|")).alias("segments_md5")
    )


_LINES = f"""SELECT doc_id, ls, i, ls[i] AS l, regexp_matches(ls[i], '^\\|[^\\n]+\\|') AS is_row,
      {S.strip('ls[i]')} = '' AS blank, len(ls) AS n
    FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {PAGES_SQL}))"""
_MEMBERS = f"""SELECT *, is_row OR (blank AND lag(is_row, 1, false) OVER w AND (lead(is_row, 1, false) OVER w OR i = n)) AS member
    FROM ({_LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""
_ISLANDS = f"""SELECT *, sum(CASE WHEN member AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block
    FROM (SELECT *, lag(member, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM ({_MEMBERS})) """
_TABLES_SQL = f"""SELECT doc_id, min(i) - 1 AS line_start, max(i) AS line_end,
      {S.strip("array_to_string(any_value(ls)[min(i):max(i)], chr(10))")} AS tbl,
      {S.strip("array_to_string(any_value(ls)[greatest(min(i) - 5, 1):min(i) - 1], chr(10))")} AS preamble
    FROM ({_ISLANDS}) WHERE member GROUP BY doc_id, block"""


@query(
    "table_blocks",
    f"SELECT doc_id, line_start::INT AS line_start, line_end::INT AS line_end, md5(tbl) AS table_md5, md5(preamble) AS preamble_md5 FROM ({_TABLES_SQL})",
)
def table_blocks(spark: SparkSession, sf: str) -> DataFrame:
    pages = markdown_pages(spark, sf).select("doc_id", F.inline(C.table_blocks(F.col("text"))))
    return pages.select(
        "doc_id", "line_start", "line_end", F.md5("table").alias("table_md5"), F.md5("preamble").alias("preamble_md5")
    )


_ITEM = "STRUCT(text VARCHAR, kind VARCHAR)"
_JOINED = (
    "{'text': array_to_string([p.text for p in %s], chr(10)||chr(10)), "
    "'kind': CASE WHEN list_contains([p.kind for p in %s], 'table') THEN 'table' ELSE 'text' END}"
)
_PENDING = "list_append(acc.pending, x.item)"
_FULL = "acc.n + length(x.item.text) >= 200"
_MERGE = f"""list_reduce(
    [{{'out': []::{_ITEM}[], 'pending': []::{_ITEM}[], 'n': 0::BIGINT, 'item': c}} for c in typed],
    lambda acc, x: {{
      'out': CASE WHEN {_FULL} THEN list_append(acc.out, {_JOINED % (_PENDING, _PENDING)}) ELSE acc.out END,
      'pending': CASE WHEN {_FULL} THEN []::{_ITEM}[] ELSE {_PENDING} END,
      'n': CASE WHEN {_FULL} THEN 0 ELSE acc.n + length(x.item.text) END,
      'item': x.item}},
    {{'out': []::{_ITEM}[], 'pending': []::{_ITEM}[], 'n': 0::BIGINT, 'item': {{'text': '', 'kind': ''}}}})"""
_LAST = "list_concat([st.out[-1]], st.pending)"
_MERGED = f"""CASE WHEN len(st.pending) = 0 THEN st.out
    WHEN len(st.out) > 0 AND length(st.pending[1].text) < 200
      THEN list_append(st.out[1:len(st.out)-1], {_JOINED % (_LAST, _LAST)})
    ELSE list_append(st.out, {_JOINED % ('st.pending', 'st.pending')}) END"""
STRUCTURAL_SQL = f"""WITH segments AS MATERIALIZED ({_NOISE_SQL}), tables AS MATERIALIZED ({_TABLES_SQL}),
  marks AS (SELECT s.doc_id, any_value(s.segs) AS segs,
              coalesce(list(t.tbl) FILTER (t.tbl <> ''), []) || coalesce(list(t.preamble) FILTER (t.preamble <> ''), []) AS marks
            FROM segments s LEFT JOIN tables t ON s.doc_id = t.doc_id GROUP BY s.doc_id),
  typed AS (SELECT doc_id, [{{'text': s, 'kind': CASE WHEN len([m for m in marks if contains(s, m)]) > 0 THEN 'table' ELSE 'text' END}}
                            for s in segs] AS typed FROM marks),
  merged AS (SELECT doc_id, {_MERGED} AS chunks FROM (SELECT doc_id, {_MERGE} AS st FROM typed)),
  kept AS (SELECT doc_id, [c for c in chunks if length({S.body('c.text')}) >= CASE WHEN c.kind = 'table' THEN 10 ELSE 50 END] AS chunks FROM merged)
  SELECT doc_id, unnest(range(0, len(chunks)))::INT AS chunk_no, unnest(chunks) AS c FROM kept"""


def structural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    pages = markdown_pages(spark, sf).select("doc_id", "text", C.table_blocks(F.col("text")).alias("tables"))
    return C.explode_chunks(pages, C.structural_chunks(F.col("text"), F.col("tables")), "doc_id")


@query(
    "structural_chunks",
    f"""SELECT doc_id, chunk_no, c.kind AS chunk_type, md5(c.text) AS text_md5, length(c.text)::INT AS chars,
          sha256(doc_id || '|0|' || chunk_no) AS chunk_id FROM ({STRUCTURAL_SQL})""",
)
def structural_chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Page text to typed, merged and filtered chunks with reproducible ids."""
    return structural_chunks(spark, sf).select(
        "doc_id",
        "chunk_no",
        "chunk_type",
        F.md5("text").alias("text_md5"),
        F.length("text").alias("chars"),
        T.stable_id(F.col("doc_id"), F.lit(0), F.col("chunk_no")).alias("chunk_id"),
    )


@query("structural_chunk_types", f"SELECT c.kind AS chunk_type, count(*)::BIGINT AS n FROM ({STRUCTURAL_SQL}) GROUP BY c.kind")
def structural_chunk_types(spark: SparkSession, sf: str) -> DataFrame:
    return structural_chunks(spark, sf).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


_SPANS_SQL = """SELECT doc_id, st::INT AS span_start, least(384, n - st)::INT AS span_length
  FROM (SELECT doc_id, n, unnest(range(0, n + 1, 128)) AS st
        FROM (SELECT doc_id, len(%s) AS n FROM documents))
  WHERE least(384, n - st) > 0 AND (st = 0 OR st - 128 + 384 < n)""" % S.whitespace_tokens("text")


@query("doc_spans", _SPANS_SQL)
def doc_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents").select("doc_id", F.size(T.whitespace_tokens(F.col("text"))).alias("n"))
    return docs.select(
        "doc_id", F.inline(C.doc_spans(F.col("n"), 384, 128)).alias("span_start", "span_length")
    )


@query(
    "assemble_pages",
    """SELECT doc_id, md5(string_agg(l, chr(10)||chr(10) ORDER BY p, l)) AS text_md5, count(*)::INT AS page_count
       FROM (SELECT doc_id, CASE WHEN page % 3 = 1 THEN page + 1 ELSE coalesce(nullif(page, 0), 0) END AS p, l FROM (
         SELECT doc_id, unnest(range(0, len(ls))) AS page, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
       GROUP BY doc_id""",
)
def assemble_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page records with two kinds of page numbers, sorted and joined per document."""
    lines = texts(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    page = F.when(F.col("n") % 3 != 1, F.col("n"))
    other = F.when(F.col("n") % 3 == 1, F.col("n") + 1)
    records = lines.select("doc_id", C.page_number(page, other).alias("page_index"), "text")
    documents = C.assemble_documents(records, "doc_id")
    return documents.select("doc_id", F.md5("text").alias("text_md5"), "page_count")
