"""Around the search: line search, routing, parents, reranking and prompt context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.columns import indices, let
from corpusloom.functions.text import words
from corpusloom.staging import hinted, stage

BROADCAST_ROWS = 1_000_000


def grep(df: DataFrame, key: str, text: str, pattern: str, context: int = 0) -> DataFrame:
    """Lines matching a pattern with ``context`` lines around: (key, line_no from 0, line, around)."""
    hits = let(
        F.split(text, "\n"),
        lambda lines: F.transform(
            F.filter(indices(F.size(lines)), lambda i: F.get(lines, i).rlike(pattern)),
            lambda i: F.struct(
                i.alias("line_no"),
                F.get(lines, i).alias("line"),
                F.array_join(
                    F.slice(
                        lines,
                        F.greatest(i - context, F.lit(0)) + 1,
                        i + context + 1 - F.greatest(i - context, F.lit(0)),
                    ),
                    "\n",
                ).alias("around"),
            ),
        ),
    )
    return df.select(key, F.inline(hits))


def route(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, text) x (alias, doc_id) -> the documents named in each query.

    Joined on the longest word of the alias (the least common one, usually), then checked for
    the whole alias as words.
    """
    named = aliases.select("doc_id", "alias", words(F.col("alias")).alias("_alias_words")).where(
        F.size("_alias_words") > 0
    )
    by_length = F.sort_array(F.transform("_alias_words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False)
    named = named.withColumn("_word", F.get(by_length, F.lit(0))["w"])
    asked = queries.select("qid", words(F.col("text")).alias("_query_words"))
    asked = asked.select("*", F.explode(F.array_distinct("_query_words")).alias("_word"))

    def spelled(sequence: str) -> Column:
        return F.concat(F.lit(" "), F.array_join(sequence, " "), F.lit(" "))

    matched = asked.join(hinted(named, BROADCAST_ROWS), "_word").where(
        F.contains(spelled("_query_words"), spelled("_alias_words"))
    )
    return matched.select("qid", "alias", "doc_id").distinct()


def expand_parents(hits: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits on child chunks -> their parent texts, once per query with the best child score."""
    few = hinted(stage(hits, "hits"), BROADCAST_ROWS)
    best = (
        children.select("chunk_id", "parent_id")
        .join(few, "chunk_id")
        .groupBy("qid", "parent_id")
        .agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_children"))
    )
    return parents.select("parent_id", "text").join(hinted(stage(best, "parents"), BROADCAST_ROWS), "parent_id")


def overlap_score(query: Column, document: Column) -> Column:
    """Share of the query's distinct words found in the document (offline reranking model)."""
    asked = F.array_distinct(words(query))
    found = F.size(F.array_intersect(asked, words(document)))
    return F.coalesce(F.try_divide(found, F.size(asked)), F.lit(0.0))


def rerank(candidates: DataFrame, score: Column, top_n: int | None = None, tie: str = "chunk_id") -> DataFrame:
    """Order the candidates of each query by another score; keep ``top_n``."""
    ranked = candidates.withColumn("rerank_score", score)
    order = Window.partitionBy("qid").orderBy(F.round("rerank_score", 9).desc(), tie)
    ranked = ranked.withColumn("new_rank", F.row_number().over(order))
    return ranked if top_n is None else ranked.where(F.col("new_rank") <= top_n)


def attach_documents(items: Column, documents: Column) -> Column:
    """array<struct<index, score>> -> with the document at the index, null when out of bounds."""
    return F.transform(
        items,
        lambda item: F.struct(
            item["index"].alias("index"),
            item["score"].alias("score"),
            F.when(item["index"] >= 0, F.get(documents, item["index"])).alias("document"),
        ),
    )


def context_block(rank: Column, doc_id: Column, source: Column, label: Column, page: Column,
                  chunk_no: Column, similarity: Column, content: Column) -> Column:
    """One retrieved chunk as it appears in a prompt."""
    # fixed value: the layout of a context block
    layout = (
        "Retrieved chunk %d\npdf_sha1: %s\ndocument: %s\nlabel: %s\npage_index: %s\n"
        "chunk_no: %s\ncosine_similarity: %.6f\ncontent:\n%s"
    )
    texts = [c.cast("string") for c in (doc_id, source, label, page, chunk_no)]
    return F.format_string(layout, rank, *texts, similarity.cast("double"), content)


def prompt_context(hits: DataFrame, block: Column) -> DataFrame:
    """The blocks of each query in rank order, separated by an empty line (k rows per query)."""
    rows = hits.select("qid", "rank", block.alias("_block"))
    grouped = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "_block"))).alias("_b"))
    return grouped.select("qid", F.array_join(F.transform("_b", lambda b: b["_block"]), "\n\n").alias("context"))


# Rules for the kinds of answers, in our own words.
KIND_RULES = {
    "number": "Give digits only, without currency, separators, units or notes.",
    "name": "Give the name alone.",
    "names": "Give a list of names.",
    "boolean": "Give true or false.",
}


def answer_prompt(question: Column, kind: Column, context: Column, top_k: int) -> Column:
    """Question, rule for its kind and retrieved context as one prompt."""
    rule = F.element_at(F.create_map(*[F.lit(x) for pair in KIND_RULES.items() for x in pair]), kind)
    return F.concat(
        F.lit("Use only the context. Reply in JSON with question_text, kind, value, references, "
              "retrieval_results and reasoning_process; value is N/A and references are empty if the "
              "context does not hold the answer.\nkind: "),
        kind,
        F.lit(f" (top {top_k})\nrule: "),
        rule,
        F.lit("\n\nContext:\n"),
        context,
        F.lit("\n\nQuestion:\n"),
        question,
    )
