"""Source and sink queries: the given tables are written in an exchange format, read back
through the reader, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import keyed_table as K
from corpusloom.operators import tables as B
from corpusloom.operators.examples import dataset_examples
from corpusloom.plans import sqltext as S
from corpusloom.plans.chunk_plans import STRUCTURAL_SQL, structural_chunks
from corpusloom.plans.registry import query, table, texts
from corpusloom.sources import readers as R
from corpusloom.sources import writers as W
from corpusloom.staging import fresh_path, hinted, stage


def write_ordered(df: DataFrame, key: str, column: str, name: str) -> str:
    """Lines in key order over several files, whose names keep the order."""
    return write_lines(df.repartitionByRange(key).sortWithinPartitions(key), column, name)


def write_lines(df: DataFrame, column: str, name: str) -> str:
    path = fresh_path(df.sparkSession, name)
    W.json_lines(df, column, path)
    return path


# -- documents ------------------------------------------------------------------------------------


@query(
    "page_json",
    """SELECT 'd' || doc_id AS doc_id, source, (page - 1)::INT AS page_index, md5(ls[page]) AS text_md5, 'company ' || lang AS company_name
       FROM (SELECT doc_id, source, lang, ls, unnest(range(1, len(ls) + 1)) AS page FROM (
         SELECT doc_id, source, lang, string_split(text, chr(10)) AS ls FROM documents))""",
)
def page_json(spark: SparkSession, sf: str) -> DataFrame:
    """Nested page documents as JSON files and back, one row per page."""
    pages = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(i.alias("page_index"), line.alias("text"), F.array().cast(
            "array<struct<preamble:string,table:string,line_start:int,line_end:int>>").alias("tables")),
    )
    document = F.struct(
        F.concat(F.lit("d"), F.col("doc_id")).alias("file_name"),
        F.col("source"),
        F.concat(F.lit("company "), F.col("lang")).alias("company_name"),
    )
    docs = texts(spark, sf, "documents").select(W.document_json(document, pages).alias("json"))
    path = write_lines(docs, "json", "pages")
    # one document per line here; a file per document is read with multiLine
    read = spark.read.schema(R.PAGE_JSON).json(path).select("document.*", F.inline("pages"))
    return read.select(
        F.col("file_name").alias("doc_id"), "source", "page_index", F.md5("text").alias("text_md5"), "company_name"
    )


@query(
    "chunk_json",
    f"""SELECT doc_id::VARCHAR AS doc_id, lang AS label, n_chars::INT AS char_count, md5(text) AS content_md5,
          len({S.whitespace_tokens('text')})::INT AS token_count FROM documents""",
)
def chunk_json(spark: SparkSession, sf: str) -> DataFrame:
    """Flat chunks to JSON and back through the explicit schema."""
    docs = texts(spark, sf, "documents").select(
        F.col("doc_id").cast("string"),
        F.lit(0).alias("chunk_no"),
        F.col("text").alias("content"),
        F.lit(0).alias("page"),
        F.size(T.whitespace_tokens(F.col("text"))).alias("token_count"),
        F.length("text").alias("char_count"),
        "source",
        F.col("lang").alias("label"),
        F.create_map(F.lit("parser"), F.lit("none")).alias("metadata"),
    )
    path = fresh_path(spark, "chunks")
    W.chunk_json(docs, path)
    read = spark.read.schema(R.CHUNK_JSON).json(path)
    return read.select("doc_id", "label", "char_count", F.md5("content").alias("content_md5"), "token_count")


PER_FILE = 50


def write_groups(df: DataFrame, key: str, json: Column, name: str, wrap: str = "[%s]") -> str:
    """JSON files of up to PER_FILE values of ``json`` each, one folder per file; returns a glob of the files."""
    group = F.floor(F.col(key) / PER_FILE).alias("folder")
    rows = df.select(group, F.struct(key, json.alias("_json")).alias("_row"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("_row")), lambda r: r["_json"]), ",\n")
    path = fresh_path(df.sparkSession, name)
    rows.groupBy("folder").agg(F.format_string(wrap, joined).alias("value")).write.partitionBy("folder").text(path)
    return f"{path}/*"


_LINES = "(SELECT doc_id, source, lang, ls, unnest(range(1, len(ls) + 1)) AS page FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS ls FROM documents))"


@query(
    "page_folders",
    f"""SELECT 'd' || doc_id AS doc_id, 'title ' || doc_id AS title, lang AS author, source, 'company ' || lang AS company_name, (page - 1)::INT AS page_index,
          ls[page] AS text, (CASE WHEN page % 2 = 0 THEN 1 ELSE 0 END)::INT AS n_tables FROM {_LINES}""",
)
def page_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Page documents in JSON files of several folders, through the reader: one row per page."""
    table_block = F.struct(F.lit("before").alias("preamble"), F.lit("| a |").alias("table"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    none = F.array().cast("array<struct<preamble:string,table:string,line_start:int,line_end:int>>")
    pages = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(i.alias("page_index"), line.alias("text"), F.when(i % 2 == 1, F.array(table_block)).otherwise(none).alias("tables")),
    )
    document = F.struct(
        F.concat(F.lit("d"), F.col("doc_id")).alias("file_name"), F.concat(F.lit("title "), F.col("doc_id")).alias("title"),
        F.col("lang").alias("author"), F.col("source"), F.concat(F.lit("company "), F.col("lang")).alias("company_name"),
    )
    path = write_groups(texts(spark, sf, "documents"), "doc_id", W.document_json(document, pages), "page-folders")
    found = R.page_documents(spark, path)
    return found.select("doc_id", "title", "author", "source", "company_name", "page_index", "text", F.size("tables").alias("n_tables"))


@query(
    "chunk_lists",
    f"""SELECT doc_id::VARCHAR AS doc_id, (page - 1)::INT AS chunk_no, ls[page] AS content, (page - 1)::INT AS page, length(ls[page])::INT AS char_count, source, lang AS label
        FROM {_LINES}""",
)
def chunk_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Flat chunks as a JSON list per file, through the reader."""
    lines = F.split("text", "\n")
    chunks = F.transform(
        lines,
        lambda line, i: F.struct(
            F.col("doc_id").cast("string").alias("doc_id"), i.alias("chunk_no"), line.alias("content"), i.alias("page"),
            F.lit(0).alias("token_count"), F.length(line).alias("char_count"), F.col("source"), F.col("lang").alias("label"),
        ),
    )
    objects = F.array_join(F.transform(chunks, lambda c: F.to_json(c)), ",")
    path = write_groups(texts(spark, sf, "documents"), "doc_id", objects, "chunk-lists")
    return R.flat_chunks(spark, path).select("doc_id", "chunk_no", "content", "page", "char_count", "source", "label")


@query(
    "json_folder",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'empty content' END AS error,
         CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS content_md5 FROM documents""",
)
def json_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Every JSON file of a folder as raw lines, checked before they are taken as chunks."""
    docs = texts(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("text")).alias("content"),
        F.lit(0).alias("page"), F.lit(1).alias("token_count"), F.length("text").alias("char_count"), "source", F.col("lang").alias("label"),
    )
    path = fresh_path(spark, "json-folder")
    W.chunk_json(docs, path)
    good, bad = B.split_valid(R.json_folder(spark, path), "value")
    number = F.get_json_object("value", "$.doc_id").cast("bigint").alias("doc_id")
    valid = good.select(number, F.lit(None).cast("string").alias("error"), F.md5(F.get_json_object("value", "$.content")).alias("content_md5"))
    return valid.unionByName(bad.select(number, "error", F.lit(None).cast("string").alias("content_md5")))


_JSON_KIND = "doc_id % 4"


@query(
    "chunk_validate",
    f"""SELECT doc_id, CASE {_JSON_KIND} WHEN 1 THEN 'missing: label, page' WHEN 2 THEN 'empty content' WHEN 3 THEN 'not an object' END AS error FROM documents""",
)
def chunk_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Good and bad chunk objects told apart, with the reason."""
    full = F.struct(
        F.lit("x").alias("doc_id"),
        F.when(F.col("doc_id") % 4 == 2, " \n ").otherwise(F.col("text")).alias("content"),
        F.lit(0).alias("page"), F.lit(1).alias("token_count"), F.lit(1).alias("char_count"),
        F.col("source"), F.col("lang").alias("label"),
    )
    partial = full.dropFields("page", "label")
    kind = F.col("doc_id") % 4
    json = F.when(kind == 1, F.to_json(partial)).when(kind == 3, "[1, 2]").otherwise(F.to_json(full))
    rows = texts(spark, sf, "documents").select("doc_id", json.alias("json"))
    good, bad = B.split_valid(rows, "json")
    return good.select("doc_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("doc_id", "error"))


@query(
    "company_names",
    """SELECT 'sha' || c_nationkey AS sha1, max_by(c_name, c_custkey) AS company_name FROM customer GROUP BY c_nationkey""",
)
def company_names(spark: SparkSession, sf: str) -> DataFrame:
    """Side table with repeated keys: the last line wins."""
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.concat_ws(",", F.concat(F.lit("sha"), F.col("c_nationkey")), F.col("c_name")).alias("line")
    )
    header = table(spark, sf, "region").where("r_regionkey = 0").select(F.lit(-1).cast("bigint").alias("c_custkey"), F.lit("sha1,company_name").alias("line"))
    return R.company_names(spark, write_ordered(header.unionByName(rows), "c_custkey", "line", "companies"))


@query(
    "company_join",
    """SELECT c_custkey, c_mktsegment, coalesce(r_name, c_mktsegment) AS name
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3""",
)
def company_join(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata injection: the side table's value wins where there is one."""
    regions = table(spark, sf, "region").where("r_regionkey < 3")
    names = table(spark, sf, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "customer")
    joined = rows.join(names, rows["c_nationkey"] == names["n_nationkey"], "left")
    return joined.select("c_custkey", "c_mktsegment", F.coalesce("r_name", "c_mktsegment").alias("name"))


# -- lines ----------------------------------------------------------------------------------------


@query(
    "tsv_examples",
    """SELECT 'train-' || doc_id AS guid, lang AS text_a, source AS text_b, CASE WHEN doc_id % 3 = 0 THEN 'contradiction' ELSE 'neutral' END AS label
       FROM documents WHERE doc_id > 0""",
)
def tsv_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Tab-separated lines without quoting, read as numbered cells and laid out as examples."""
    label = F.when(F.col("doc_id") % 3 == 0, "contradictory").otherwise("neutral")
    rows = table(spark, sf, "documents").select("doc_id", F.concat_ws("\t", "lang", "source", label).alias("line"))
    cells = R.delimited_lines(spark, write_ordered(rows, "doc_id", "line", "tsv"))
    return dataset_examples(cells, "xnli", "train")


_FIRST_LINES = "(SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, replace(ls[1], chr(9), ' ') AS a, replace(coalesce(ls[2], ''), chr(9), ' ') AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


@query("sentence_pairs", f"SELECT line_no, a AS t1, b AS t2 FROM {_FIRST_LINES}")
def sentence_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The first two lines of every document as a tab-separated pair, through the reader."""
    lines = F.transform(F.slice(F.split("text", "\n"), 1, 2), lambda x: F.translate(x, "\t", " "))
    first, second = F.get(lines, F.lit(0)), F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    rows = texts(spark, sf, "documents").select("doc_id", F.concat(first, F.lit("\t"), second).alias("line"))
    return R.sentence_pairs(spark, write_ordered(rows, "doc_id", "line", "sentence-pairs"))


@query("comma_cells", f"SELECT line_no, string_split(a, ',') AS cells FROM {_FIRST_LINES}")
def comma_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Comma-separated lines without quoting: quotes are part of the cells."""
    first = F.translate(F.get(F.split("text", "\n"), F.lit(0)), "\t", " ")
    rows = texts(spark, sf, "documents").select("doc_id", first.alias("line"))
    return R.delimited_lines(spark, write_ordered(rows, "doc_id", "line", "comma-cells"), ",")


@query(
    "stop_word_file",
    f"""SELECT doc_id, len(list_filter({S.words('text')}, lambda w: NOT list_contains(stop, w)))::INT AS n_kept
        FROM documents CROSS JOIN (SELECT list(DISTINCT w) AS stop FROM (SELECT lower(c_mktsegment) AS w FROM customer UNION ALL SELECT role FROM conversations))""",
)
def stop_word_file(spark: SparkSession, sf: str) -> DataFrame:
    """Stop words from a file, repeated lines and all, taken out of the documents' words by an anti-join."""
    lines = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("line")).unionByName(
        table(spark, sf, "conversations").select(F.col("role").alias("line"))
    )
    stop = R.stop_words(spark, write_lines(lines, "line", "stop-words"))
    docs = texts(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("ws"))
    left = docs.select("doc_id", F.explode_outer("ws").alias("token")).join(hinted(stop, 100_000), "token", "left_anti")
    return docs.select("doc_id").join(
        left.groupBy("doc_id").agg(F.count("token").cast("int").alias("n_kept")), "doc_id", "left"
    ).select("doc_id", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query(
    "blank_documents",
    """SELECT (doc_id)::BIGINT AS doc, count(*)::BIGINT AS n_sentences, sum(length(trim(l)))::BIGINT AS chars
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' GROUP BY doc_id""",
)
def blank_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One sentence per line, blank lines between documents."""
    docs = texts(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\n")).alias("line"))
    sentences = R.blank_separated_documents(spark, write_ordered(docs, "doc_id", "line", "blank"))
    return sentences.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("chars")
    )


@query(
    "parallel_text",
    """SELECT line_no, src, tgt FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, source AS src FROM documents)
       JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, lang AS tgt FROM documents JOIN labels USING (doc_id)) USING (line_no)""",
)
def parallel_text(spark: SparkSession, sf: str) -> DataFrame:
    """Two files side by side up to the end of the shorter one (the labelled documents)."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    labelled = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi")
    source, target = write_ordered(docs, "doc_id", "source", "src"), write_ordered(labelled, "doc_id", "lang", "tgt")
    return R.parallel_text(spark, source, target).select("line_no", "src", "tgt")


@query(
    "piped_pairs",
    """SELECT c_custkey AS unique_id, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' ||| ' || c_name ELSE c_name END AS text_a,
         CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS text_b FROM customer""",
)
def piped_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Optional second texts; the first group is greedy."""
    double = F.concat_ws(" ||| ", "c_name", "c_name", "c_mktsegment")
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, double).otherwise(F.col("c_name")).alias("line"))
    return R.piped_pairs(spark, write_ordered(rows, "c_custkey", "line", "pairs"))


@query(
    "vocabulary_file",
    """SELECT source AS token, (max(r) - 1)::INT AS id FROM (SELECT source, row_number() OVER (ORDER BY doc_id) AS r FROM documents) GROUP BY source""",
)
def vocabulary_file(spark: SparkSession, sf: str) -> DataFrame:
    """One token per line; repeated tokens keep the last line number."""
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return R.vocabulary_file(spark, write_ordered(rows, "doc_id", "source", "vocab"))


@query(
    "lm_vocabulary_file",
    """SELECT token, (max(r) - 1)::INT AS id FROM (SELECT source AS token, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE lang <> 'de') GROUP BY token""",
)
def lm_vocabulary_file(spark: SparkSession, sf: str) -> DataFrame:
    """Marker lines take no id."""
    token = F.when(F.col("lang") == "de", "!!!MAXTERMID").otherwise(F.col("source"))
    rows = table(spark, sf, "documents").select("doc_id", token.alias("token"))
    return R.lm_vocabulary_file(spark, write_ordered(rows, "doc_id", "token", "lmvocab"))


@query("reviews_csv", "SELECT text AS review, quality AS label FROM documents JOIN labels USING (doc_id)")
def reviews_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted multi-line CSV with the label column chosen by the number of classes."""
    rows = texts(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("text").alias("review"), F.col("quality").alias("sentiment"), F.col("toxic").alias("rate")
    )
    path = fresh_path(spark, "reviews")
    rows.write.csv(path, header=True, escape='"')
    return R.reviews(spark, path, classes=1)


@query("record_shards", "SELECT (count(*))::BIGINT AS n, sum(vec_id)::BIGINT AS id_sum FROM embeddings")
def record_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Records dealt over several files and read back."""
    path = fresh_path(spark, "records")
    W.record_shards(table(spark, sf, "embeddings").select("vec_id", "label"), path, 4)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("id_sum"))


# -- tables -----------------------------------------------------------------------------------------

_BATCH = "SELECT conv_id AS id, turn AS version, 'new ' || role AS content FROM conversations"


@query(
    "upsert_last_wins",
    f"""WITH batch AS ({_BATCH}), newest AS (SELECT id, max_by(content, version) AS content FROM batch GROUP BY id)
        SELECT coalesce(n.id, d.doc_id) AS id, coalesce(n.content, d.source) AS content
        FROM newest n FULL JOIN (SELECT doc_id, source FROM documents) d ON n.id = d.doc_id""",
)
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a batch replace stored rows of the same id; of several in the batch the last."""
    path = fresh_path(spark, "collection")
    target = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("version"), F.col("source").alias("content")
    )
    B.ingest(target, path, drop_existing=True)
    batch = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), F.col("turn").alias("version"), F.concat(F.lit("new "), F.col("role")).alias("content")
    )
    B.upsert_table(spark, path, batch, "id", ["version"])
    return B.read_table(spark, path).select("id", "content")


@query(
    "keyed_upserts",
    f"""WITH batch AS ({_BATCH}), part AS (SELECT id, version % 2 AS half, max_by(content, version) AS content FROM batch GROUP BY ALL),
          newest AS (SELECT id, max_by(content, half) AS content FROM part GROUP BY id)
        SELECT coalesce(n.id, d.doc_id) AS id, coalesce(n.content, d.source) AS content
        FROM newest n FULL JOIN (SELECT doc_id, source FROM documents) d ON n.id = d.doc_id""",
)
def keyed_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Three upserts in a row into a table in buckets: all documents, the even turns, the odd ones."""
    path = fresh_path(spark, "keyed")
    K.create(spark, path, "id bigint, content string", key="id", buckets=8)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("content"), F.lit(0).alias("version"))
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), F.concat(F.lit("new "), F.col("role")).alias("content"), F.col("turn").alias("version")
    )
    for batch in (docs, turns.where("version % 2 = 0"), turns.where("version % 2 = 1")):
        K.upsert(spark, path, batch, ["version"])
    return K.read(spark, path)


@query(
    "collection_rows",
    """SELECT doc_id::VARCHAR AS doc_id, chunk_type, title, page_index, count(*)::BIGINT AS n FROM (
         SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id END AS doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'table' END, 'text') AS chunk_type,
                '' AS title, coalesce(CASE WHEN doc_id % 5 = 0 THEN 5 END, 0)::BIGINT AS page_index FROM documents)
       GROUP BY ALL""".replace("SELECT doc_id::VARCHAR AS doc_id,", "SELECT coalesce(doc_id::VARCHAR, '') AS doc_id,"),
)
def collection_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a vector collection with the defaults for missing values."""
    n = F.col("doc_id")
    chunks = table(spark, sf, "documents").select(
        F.sha2(n.cast("string"), 256).alias("chunk_id"),
        "text",
        F.when(n % 2 == 0, n).alias("doc_id"),
        F.when(n % 5 == 0, 5).alias("page_index"),
        F.when(n % 3 == 0, "table").alias("chunk_type"),
        F.lit(None).cast("string").alias("title"),
    )
    rows = B.vector_rows(chunks)
    return rows.groupBy("doc_id", "chunk_type", "title", "page_index").agg(F.count(F.lit(1)).alias("n"))


@query("collection_count", "SELECT 0::BIGINT AS missing, count(*)::BIGINT AS stored, count(*)::BIGINT * 2 AS appended FROM documents")
def collection_count(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a missing, a replaced and an appended collection."""
    path = fresh_path(spark, "counted")
    rows = table(spark, sf, "documents").select("doc_id", "source")
    missing = B.table_count(spark, path)
    B.ensure_table(spark, path, "doc_id bigint, source string")
    B.ingest(rows, path, drop_existing=True)
    stored = B.table_count(spark, path)
    B.ingest(rows, path, drop_existing=False)
    both = B.read_table(spark, path)
    return both.agg(F.lit(missing).cast("bigint").alias("missing"), F.lit(stored).cast("bigint").alias("stored"), F.count(F.lit(1)).alias("appended"))


@query(
    "structural_collection",
    f"""SELECT doc_id::VARCHAR AS doc_id, count(*)::BIGINT AS n_chunks, sum(length(c.text))::BIGINT AS chars,
          min(sha256(doc_id || '|0|' || chunk_no)) AS first_id FROM ({STRUCTURAL_SQL}) GROUP BY doc_id""",
)
def structural_collection(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of Markdown pages with ids, stored once and counted by document."""
    chunks = structural_chunks(spark, sf).select(
        "doc_id", "chunk_no", "chunk_type", "text",
        T.stable_id(F.col("doc_id"), F.lit(0), F.col("chunk_no")).alias("chunk_id"),
        F.lit(0).alias("page_index"), F.lit(None).cast("string").alias("title"),
    )
    stored = stage(B.vector_rows(chunks), "collection")
    return stored.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("chars"), F.min("chunk_id").alias("first_id")
    )
