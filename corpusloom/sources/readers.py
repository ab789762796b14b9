"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.ordering import with_position
from corpusloom.staging import stage

TABLE_BLOCK = "preamble string, table string, line_start int, line_end int"
PAGE_JSON = (
    "document struct<file_name:string,title:string,author:string,source:string,page_count:int,company_name:string>, "
    f"pages array<struct<page_index:int,text:string,tables:array<struct<{TABLE_BLOCK.replace(' string', ':string').replace(' int', ':int')}>>>>"
)
CHUNK_JSON = (
    "doc_id string, chunk_no int, content string, page int, token_count int, char_count int, "
    "source string, label string, metadata map<string,string>"
)
ARTICLES = (
    "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<"
    "id:string,question:string,is_impossible:boolean,answers:array<struct<text:string,answer_start:int>>>>>>>>"
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their position: (file, line_no from 0, value).

    A path may be one file or several, which count as one text in the order of their names.
    Splits are read in parallel; numbers come from file, split and place within the split,
    written down once (a second scan might be split differently). The text stays where it was
    read: only one small row per split is ordered, and broadcast.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    raw = stage(raw, "lines")
    splits = raw.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    offsets = splits.select("file", "_block", shift.alias("_shift"))
    return raw.join(F.broadcast(offsets), ["file", "_block"]).select(
        "file", (F.col("_at") + F.col("_shift")).alias("line_no"), "value"
    )


def delimited_lines(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """Cells of separated lines without quoting: (line_no, cells)."""
    return lines(spark, path).select("line_no", F.split("value", separator, -1).alias("cells"))


def reviews(spark: SparkSession, path: str, classes: int = 1) -> DataFrame:
    """Review CSV with header; the label column depends on the number of classes."""
    schema = "review string, sentiment int, rate int"
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')
    label = F.col("sentiment") if classes == 1 else F.col("rate")
    return raw.select("review", label.alias("label"))


def company_names(spark: SparkSession, path: str) -> DataFrame:
    """sha1 -> company_name; of duplicates the last line wins."""
    header_first = lines(spark, path).select("line_no", F.from_csv("value", F.lit("sha1 string, company_name string")).alias("r"))
    rows = header_first.where("line_no > 0 AND r.sha1 IS NOT NULL").select("line_no", "r.*")
    return rows.groupBy("sha1").agg(F.max_by("company_name", "line_no").alias("company_name"))


def page_documents(spark: SparkSession, path: str) -> DataFrame:
    """Page JSON files (one folder per document) -> one row per page with document columns."""
    raw = spark.read.schema(PAGE_JSON).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("_file"))
    pages = raw.select(
        F.coalesce("document.file_name", F.regexp_replace("_file", r"\.[^.]*$", "")).alias("doc_id"),
        F.col("document.title").alias("title"),
        F.col("document.author").alias("author"),
        F.col("document.source").alias("source"),
        F.col("document.company_name").alias("company_name"),
        F.explode("pages").alias("_p"),
    )
    return pages.select(
        "doc_id", "title", "author", "source", "company_name", "_p.page_index",
        F.coalesce("_p.text", F.lit("")).alias("text"), F.col("_p.tables").alias("tables"),
    )


def flat_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk JSON: each file is a list of flat objects."""
    return spark.read.schema(CHUNK_JSON).json(path, multiLine=True)


def json_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Raw JSON lines of a folder; fails if there is none."""
    found = spark.read.text(folder, pathGlobFilter="*.[jJ][sS][oO][nN]")
    if found.isEmpty():
        raise FileNotFoundError(f"no JSON files in {folder}")
    return found


def sentence_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Two tab-separated sentences per line: (line_no, t1, t2)."""
    return delimited_lines(spark, path).select(
        "line_no", F.get("cells", F.lit(0)).alias("t1"), F.get("cells", F.lit(1)).alias("t2")
    )


def blank_separated_documents(spark: SparkSession, path: str) -> DataFrame:
    """One sentence per line, an empty line ends a document: (doc, line_no, sentence).

    A document's number is how many blank lines came before it: a running total over the
    lines, so that a document may be of any length. Empty documents have no rows.
    """
    from corpusloom.operators.ordering import running_totals

    marked = lines(spark, path).select("line_no", strip(F.col("value")).alias("sentence"))
    marked = marked.withColumn("_blank", (F.col("sentence") == "").cast("bigint"))
    numbered = running_totals(marked, ["line_no"], {"doc": "_blank"})
    return numbered.where("sentence != ''").select("doc", "line_no", "sentence")


def parallel_text(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Lines of two files side by side, up to the end of the shorter: (line_no, src, tgt)."""
    src = lines(spark, source).select("line_no", F.col("value").alias("src"))
    tgt = lines(spark, target).select("line_no", F.col("value").alias("tgt"))
    return src.join(tgt, "line_no")


def piped_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``text_a ||| text_b`` or ``text_a``: (unique_id, text_a, text_b)."""
    stripped = lines(spark, path).select("line_no", strip(F.col("value")).alias("v"))
    pattern = r"^(.*) \|\|\| (.*)$"
    paired = F.col("v").rlike(pattern)
    return stripped.select(
        F.col("line_no").alias("unique_id"),
        F.when(paired, F.regexp_extract("v", pattern, 1)).otherwise(F.col("v")).alias("text_a"),
        F.when(paired, F.regexp_extract("v", pattern, 2)).alias("text_b"),
    )


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """One token per line, its id is the line number; a repeated token keeps the last."""
    rows = lines(spark, path).select(strip(F.col("value")).alias("token"), "line_no")
    return rows.groupBy("token").agg(F.max("line_no").cast("int").alias("id"))


def lm_vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """As ``vocabulary_file``, but ``!!!MAXTERMID`` lines take no id."""
    rows = lines(spark, path).select(strip(F.col("value")).alias("token"), "line_no").where("token != '!!!MAXTERMID'")
    numbered = with_position(rows, ["line_no"], "_n")
    return numbered.groupBy("token").agg((F.max("_n") - 1).cast("int").alias("id"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary that ``writers.vocabulary`` stored: (token, id)."""
    return spark.read.schema("token string, id int").parquet(path)


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("token")).distinct()


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Question-answering JSON -> articles (title, paragraphs)."""
    raw = spark.read.schema(ARTICLES).json(path, multiLine=True)
    return raw.select(F.inline("data"))


def sentence_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """Tokenised sentence files matching a glob: (file, line_no, sentence)."""
    return lines(spark, pattern).withColumnRenamed("value", "sentence")


def binary_pages(spark: SparkSession, path: str, extract, glob: str = "*.pdf") -> DataFrame:
    """Files as pages: ``extract(bytes) -> list[str]`` runs in the tasks, one file at a time.

    No page extractor ships with this package; pass one of an installed library.
    """
    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)

    def run(batches):
        for batch in batches:
            rows = [
                (name, number, text)
                for name, data in zip(batch["path"], batch["content"])
                for number, text in enumerate(extract(data))
            ]
            yield pd.DataFrame(rows, columns=["source", "page_index", "text"])

    return files.select("path", "content").mapInPandas(run, "source string, page_index int, text string")


def copy_task(spark: SparkSession, rows: int, vocab_size: int, low: int, high: int, seed: int, sos: int = 1, eos: int = 2) -> DataFrame:
    """Generated sequences whose target repeats the source: (id, ids)."""
    from corpusloom.functions.chance import draw
    from corpusloom.functions.encoding import ints

    length = (draw(seed, F.col("id")) % (high - low + 1) + low).cast("int")
    body = F.transform(
        F.sequence(F.lit(1), length), lambda i: (draw(seed + 1, F.col("id"), i) % (vocab_size - 4) + 4).cast("int")
    )
    return spark.range(rows).select("id", F.concat(ints(sos), body, ints(eos)).alias("ids"))
