"""Vocabularies as (token, id) tables, and encoding token arrays against them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from corpusloom.functions.columns import literal_rows
from corpusloom.operators.ordering import with_position
from corpusloom.staging import small_enough, stage

# Reserved tokens of the vocabulary kinds, in id order.
SENTENCE_PAIR_SPECIALS = ("<pad>", "<unk>", "<eos>", "<sos>", "<mask>")
TRANSLATION_SPECIALS = ("<pad>", "<sos>", "<eos>", "<unk>")
REVIEW_SPECIALS = ("PAD", "UNK")

BROADCAST_ROWS = 1_000_000
SALTS = 16


def token_counts(df: DataFrame, tokens: str, first: Sequence[str] = ()) -> DataFrame:
    """(token, n) and, with ``first``, the first occurrence as struct(*first, place)."""
    exploded = df.select(*first, F.posexplode(tokens).alias("_place", "token"))
    sums = [F.count(F.lit(1)).alias("n")]
    if first:
        sums.append(F.min(F.struct(*first, "_place")).alias("first_seen"))
    return exploded.groupBy("token").agg(*sums)


def _numbered(words: DataFrame, order: Sequence[str | Column], specials: Sequence[str]) -> DataFrame:
    spark = words.sparkSession
    ranked = with_position(words.select("token", *_extra(words)), order, "id")
    ranked = ranked.select("token", (F.col("id") - 1 + len(specials)).cast("int").alias("id"))
    if not specials:
        return ranked
    reserved = literal_rows(spark, token=list(specials), id=list(range(len(specials))))
    return reserved.unionByName(ranked)


def _extra(words: DataFrame) -> list[str]:
    return [c for c in words.columns if c != "token"]


def build_by_count(
    counts: DataFrame,
    specials: Sequence[str] = SENTENCE_PAIR_SPECIALS,
    min_freq: int = 1,
    max_size: int | None = None,
) -> DataFrame:
    """Most frequent first, equal counts by token; ``max_size`` counts without the specials."""
    words = counts.where((F.col("n") >= max(min_freq, 1)) & ~F.col("token").isin(*specials, ""))
    words = words.select("token", "n")
    if max_size is not None:
        words = _frequent(words, max_size)
    vocab = _numbered(words, [F.desc("n"), "token"], specials)
    return vocab if max_size is None else vocab.where(F.col("id") < max_size + len(specials))


def _frequent(words: DataFrame, size: int) -> DataFrame:
    """The words whose count reaches that of the ``size``-th word: all that can be among the
    first ``size``. Found from the number of words per count, of which at most the ``size``
    largest counts matter."""
    kept = stage(words, "word-counts")
    per_count = kept.groupBy("n").agg(F.count(F.lit(1)).alias("_words")).orderBy(F.desc("n")).limit(size)
    so_far = F.sum("_words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    reached = per_count.withColumn("_so_far", so_far).where(F.col("_so_far") >= size)
    least = reached.agg(F.max("n")).first()[0]
    return kept if least is None else kept.where(F.col("n") >= least)


def build_by_first_seen(
    counts: DataFrame, specials: Sequence[str] = TRANSLATION_SPECIALS, min_freq: int = 2
) -> DataFrame:
    """In order of first occurrence; tokens equal to a special keep the special's id."""
    words = counts.where((F.col("n") >= min_freq) & ~F.col("token").isin(*specials))
    return _numbered(words.select("token", "first_seen"), ["first_seen"], specials)


def build_for_reviews(
    counts: DataFrame, stop_words: DataFrame, min_freq: int = 5, vectors: DataFrame | None = None
) -> DataFrame:
    """Without stop words and rare words; by count, equal counts by first occurrence.

    With ``vectors`` (token, ...) only tokens that have one are kept.
    """
    words = counts.where(F.col("n") >= min_freq).join(stop_words.select("token"), "token", "left_anti")
    if vectors is not None:
        words = words.join(vectors.select("token"), "token", "left_semi")
    return _numbered(words.select("token", "n", "first_seen"), [F.desc("n"), "first_seen"], REVIEW_SPECIALS)


def missing_vectors(words: DataFrame, vectors: DataFrame) -> DataFrame:
    return words.select("token").join(vectors.select("token"), "token", "left_anti")


def extend(vocab: DataFrame, other: DataFrame, alphabetical: bool = False) -> DataFrame:
    """Append the tokens of ``other`` that are new, in its id order or sorted."""
    new = other.join(vocab.select("token"), "token", "left_anti")
    order = ["token"] if alphabetical else ["id"]
    start = (vocab.agg(F.max("id")).first()[0] or 0) + 1
    placed = with_position(new.select("token", "id"), order, "_position")
    added = placed.select("token", (F.col("_position") - 1 + start).cast("int").alias("id"))
    return vocab.select("token", "id").unionByName(added)


def label_ids(labels: DataFrame, column: str) -> DataFrame:
    """Distinct labels, sorted, numbered from 0."""
    distinct = labels.select(F.col(column).alias("token")).distinct()
    return _numbered(distinct, ["token"], ())


def _in_rows(df: DataFrame, key: str, cells: Column, table: DataFrame, find) -> DataFrame | None:
    """(key, _found): the arrays ``cells`` with each value's partner in ``table`` (value, partner), a
    broadcast. Nothing but the arrays moves, and they stay in their rows. None if values repeat.

    ``find(values, partners)`` completes an Arrow array of partners, null where there is none.
    """
    spark = df.sparkSession
    pairs = table.toArrow().combine_chunks()
    names, partners = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in pairs.columns)
    if len(pc.unique(names)) < len(names):
        return None
    shared = spark.sparkContext.broadcast((names, partners))
    source = df.select(key, cells.alias("_cells"))
    kept = StructType([source.schema[0], StructField("_found", ArrayType(table.schema[1].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, partners = shared.value
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            found = find(values, partners.take(pc.index_in(values, names.cast(values.type))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, found)], names=[key, "_found"])

    return source.mapInArrow(run, kept)


def in_rows(df: DataFrame, cells: Column, vocab: DataFrame, given: str, wanted: str, out: str) -> DataFrame | None:
    """``df`` with the array ``out``: for each of the ``cells`` (values of the column ``given`` of
    ``vocab``) its ``wanted``, null where there is none. Rows stay where they are. None if the
    vocabulary is too large to be broadcast or values repeat."""
    table = vocab.select(given, wanted).where(F.col(given).isNotNull())
    if not small_enough(table, BROADCAST_ROWS):
        return None
    pairs = table.toArrow().combine_chunks()
    names, partners = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in pairs.columns)
    if len(pc.unique(names)) < len(names):
        return None
    shared = df.sparkSession.sparkContext.broadcast((names, partners))
    kept = StructType([*df.schema, StructField(out, ArrayType(table.schema[1].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, partners = shared.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            values = lists.flatten()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            found = partners.take(pc.index_in(values, names.cast(values.type)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, found)], names=kept.names)

    return df.withColumn("_cells", cells).mapInArrow(run, kept)


def _merged(found: DataFrame, key: str) -> DataFrame:
    """Rows that share a key as one array: by place, then value."""
    cells = F.flatten(F.transform("_lists", lambda cells: F.transform(cells, lambda v, i: F.struct(i.alias("i"), v.alias("v")))))
    grouped = found.groupBy(key).agg(F.collect_list("_found").alias("_lists"))
    return grouped.select(key, F.transform(F.sort_array(cells), lambda c: c["v"]).alias("_found"))


def _keys_repeat(df: DataFrame, key: str) -> bool:
    return not df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()


def lookup(
    df: DataFrame,
    key: str,
    tokens: str | Column,
    vocab: DataFrame,
    unknown: int | None,
    out: str = "ids",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Replace the token array by its ids; ``key`` identifies the row.

    Unknown tokens get the id ``unknown``; with None they fail the query. ``tokens`` may be an
    expression over a text column. A vocabulary within ``broadcast_rows`` is broadcast and the ids
    are found inside the rows, without a shuffle unless keys repeat. A larger one is joined by token
    with the frequent tokens salted over ``SALTS`` copies of the vocabulary; rows are then shuffled
    by key before they are exploded, so that collecting the ids of a row needs no second shuffle.
    """
    ids = vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    few = small_enough(ids, broadcast_rows)
    cells = F.col(tokens) if isinstance(tokens, str) else tokens

    def known(values: pa.Array, found: pa.Array) -> pa.Array:
        if unknown is not None:
            return pc.fill_null(found, unknown)
        missing = values.filter(pc.and_(pc.is_null(found), pc.is_valid(values)))
        if len(missing):
            raise ValueError(f"token not in vocabulary: {missing[0].as_py()}")
        return found

    found = _in_rows(df, key, cells, ids.where("_token IS NOT NULL"), known) if few else None
    if found is not None:
        found = _merged(found, key) if _keys_repeat(df, key) else found
        return found.withColumnRenamed("_found", out)
    exploded = df.repartition(key).select(key, F.posexplode_outer(tokens).alias("_place", "_token"))
    if few:
        joined = exploded.join(F.broadcast(ids), "_token", "left")
    else:
        salted = ids.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = exploded.withColumn("_salt", F.pmod("_place", F.lit(SALTS))).join(
            salted, ["_token", "_salt"], "left"
        )
    if unknown is None:
        fail = F.raise_error(F.concat(F.lit("token not in vocabulary: "), F.col("_token")))
        found = F.coalesce("_id", F.when(F.col("_token").isNotNull(), fail.cast("int")))
    else:
        found = F.coalesce("_id", F.lit(unknown))
    cells = F.collect_list(F.when(F.col("_place").isNotNull(), F.struct("_place", found.alias("_id"))))
    grouped = joined.groupBy(key).agg(F.sort_array(cells).alias("_cells"))
    return grouped.select(key, F.transform("_cells", lambda c: c["_id"]).alias(out))


def words_of_ids(df: DataFrame, key: str, ids: str, vocab: DataFrame, drop: Sequence[int] = ()) -> DataFrame:
    """Ids back to tokens; an id beyond the vocabulary becomes ``<id>``; ``drop`` ids vanish.

    A vocabulary that is small enough is broadcast, as by ``lookup``."""
    few = small_enough(vocab, BROADCAST_ROWS)

    def named(values: pa.Array, found: pa.Array) -> pa.Array:
        gone = pc.is_in(values, pa.array(list(drop), values.type))
        shown = pc.coalesce(found, pc.binary_join_element_wise("<", values.cast(pa.string()), ">", ""))
        return pc.if_else(gone, None, shown)

    none = F.array().cast("array<string>")
    words = vocab.select(F.col("id").cast("bigint"), "token").where("id IS NOT NULL")
    placed = _in_rows(df, key, F.col(ids).cast("array<bigint>"), words, named) if few and not _keys_repeat(df, key) else None
    if placed is not None:
        kept = F.filter("_found", lambda w: w.isNotNull())
        return placed.select(key, F.when(F.col(key).isNotNull(), kept).otherwise(none).alias("tokens"))
    exploded = df.repartition(key).select(key, F.posexplode_outer(ids).alias("_place", "_id"))
    if drop:
        exploded = exploded.where(F.col("_id").isNull() | ~F.col("_id").isin(*drop))
    table = vocab.select(F.col("id").alias("_id"), F.col("token").alias("_token"))
    if few:
        joined = exploded.join(F.broadcast(table), "_id", "left")
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = exploded.withColumn("_salt", F.pmod("_place", F.lit(SALTS))).join(
            salted, ["_id", "_salt"], "left"
        )
    name = F.coalesce("_token", F.concat(F.lit("<"), F.col("_id").cast("string"), F.lit(">")))
    cells = F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_place", name.alias("_word"))))
    grouped = joined.groupBy(key).agg(F.sort_array(cells).alias("_cells"))
    found = grouped.select(key, F.transform("_cells", lambda c: c["_word"]).alias("tokens"))
    # rows whose ids were all dropped keep an empty list
    return df.select(key).join(found, key, "left").select(
        key, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")
    )


def embedding_lookup(df: DataFrame, key: str, ids: str, vectors: DataFrame) -> DataFrame:
    """Vectors of an id array in order, one row per position: (key, place, id, embedding).

    Ids without a vector keep a null. A table of vectors that is small enough is broadcast.
    """
    spread = df.select(key, F.posexplode(ids).alias("place", "id"))
    table = vectors.select("id", "embedding")
    hint = F.broadcast(table) if small_enough(table, BROADCAST_ROWS // 100) else table
    return spread.join(hint, "id", "left")
