"""Writers for chunks, documents, vocabularies, features and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_json(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines. Files follow the partitions, not the documents: millions of
    documents would be millions of folders; ``doc_id`` stays a column to filter on."""
    chunks.write.mode("overwrite").json(path, ignoreNullFields=False)


def chunk_lists(chunks: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """One folder per document (for small collections and exchange with file-based tools)."""
    chunks.repartition(doc_id).write.partitionBy(doc_id).mode("overwrite").json(path)


def markdown(documents: DataFrame, path: str, key: str, text: str) -> None:
    """Document texts as files, one folder per document."""
    documents.select(key, F.col(text).alias("value")).write.partitionBy(key).mode("overwrite").text(path)


def document_json(document: Column, pages: Column) -> Column:
    """Nested document JSON with its pages."""
    return F.to_json(F.struct(document.alias("document"), pages.alias("pages")))


def json_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def record_shards(df: DataFrame, path: str, shards: int) -> None:
    """Records dealt evenly over ``shards`` files."""
    df.repartition(shards).write.mode("overwrite").parquet(path)


def vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select("token", "id").write.mode("overwrite").parquet(path)


def probability_line(probabilities: Column, places: int | None = None) -> Column:
    """Class probabilities of one row, tab-separated."""
    shown = probabilities if places is None else F.transform(probabilities, lambda p: F.round(p, places))
    return F.array_join(shown.cast("array<string>"), "\t")


def rounded_layers(layers: Column, places: int = 6) -> Column:
    """array<array<double>> with every value rounded, as JSON."""
    return F.to_json(F.transform(layers, lambda vs: F.transform(vs, lambda v: F.round(v.cast("double"), places))))


def keyed_json(df: DataFrame, key: str, value: Column, path: str) -> None:
    """``{key: value}`` objects, one per line (predictions, n-best lists, null odds)."""
    json_lines(df.select(F.to_json(F.create_map(F.col(key), value)).alias("json")), "json", path)
