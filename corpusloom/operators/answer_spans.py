"""Extractive question answering: examples, window features, n-best decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from corpusloom.functions.columns import let
from corpusloom.functions.encoding import best_positions
from corpusloom.functions.numeric import softmax
from corpusloom.functions.text import basic_tokens, detokenize, whitespace_tokens
from corpusloom.operators.ordering import running_totals
from corpusloom.staging import hinted, stage

BROADCAST_QUESTIONS = 1_000_000
#: Context words laid out at a time.
LAYOUT_WORDS = 100_000

# Fixed value: white space that separates context words.
CONTEXT_SPACE = r"[ \t\r\n\x{202F}]+"


def context_words(context: Column) -> Column:
    return F.filter(F.split(context, CONTEXT_SPACE), lambda w: w != "")


def word_of_char(context: Column, offset: Column) -> Column:
    """Index of the word a character belongs to (or of the last word before white space)."""
    return F.size(context_words(F.left(context, offset + 1))) - 1


def read_questions(articles: DataFrame) -> DataFrame:
    """Nested articles -> one row per question: (qas_id, question, context, answers, is_impossible)."""
    paragraphs = articles.select(F.explode("paragraphs").alias("p"))
    questions = paragraphs.select(F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    return questions.select(
        F.col("q.id").alias("qas_id"),
        F.col("q.question").alias("question"),
        "context",
        F.col("q.answers").alias("answers"),
        F.coalesce(F.col("q.is_impossible"), F.lit(False)).alias("is_impossible"),
    )


def training_examples(questions: DataFrame) -> DataFrame:
    """Word positions of the answers; answers that cannot be recovered from the words are dropped.

    A question that can be answered must have exactly one answer.
    """
    one = F.when(
        ~F.col("is_impossible") & (F.size("answers") != 1),
        F.raise_error(F.concat(F.lit("exactly one answer expected: "), F.col("qas_id"))).cast("string"),
    ).otherwise(F.get("answers", F.lit(0))["text"])
    begin = F.get("answers", F.lit(0))["answer_start"]
    found = questions.select(
        "qas_id",
        "question",
        "context",
        "is_impossible",
        context_words(F.col("context")).alias("doc_tokens"),
        F.when(F.col("is_impossible"), "").otherwise(one).alias("answer_text"),
        begin.alias("_begin"),
        *[c for c in questions.columns if c not in ("qas_id", "question", "context", "is_impossible", "answers")],
    )
    last = F.col("_begin") + F.length("answer_text") - 1
    placed = found.withColumns(
        {
            "start_position": F.when(F.col("is_impossible"), -1).otherwise(word_of_char(F.col("context"), F.col("_begin"))),
            "end_position": F.when(F.col("is_impossible"), -1).otherwise(word_of_char(F.col("context"), last)),
        }
    )
    span = F.slice("doc_tokens", F.col("start_position") + 1, F.col("end_position") - F.col("start_position") + 1)
    cleaned = F.array_join(whitespace_tokens(F.col("answer_text")), " ")
    recoverable = F.col("is_impossible") | F.contains(F.array_join(span, " "), cleaned)
    return placed.where(recoverable).drop("_begin", "context")


def improve_span(tokens: Column, start: Column, end: Column, answer: Column) -> Column:
    """struct<start, end>: the first stretch inside [start, end] equal to the answer's tokens,
    otherwise the span itself."""
    size = F.size(answer)
    candidates = F.when(
        (size > 0) & (end - size + 1 >= start), F.sequence(start, end - size + 1)
    ).otherwise(F.array().cast("array<int>"))
    hits = F.filter(candidates, lambda s: F.slice(tokens, s + 1, size) == answer)
    first = F.get(hits, F.lit(0))
    return F.struct(
        F.coalesce(first, start).alias("start"), F.coalesce(first + size - 1, end).alias("end")
    )


def is_max_context(span: Column, before: Column, after: Column, position: Column) -> Column:
    """Whether a span gives the token the most context: the largest
    min(left, right) + 0.01 * length, the first of equals.

    Starts and ends rise from span to span, so a span that loses to any other loses to the one
    next to it on that side: the two neighbours decide.
    """

    def score(s: Column) -> Column:
        return F.least(position - s["start"], s["start"] + s["length"] - 1 - position) + 0.01 * s["length"]

    earlier = (position < before["start"] + before["length"]) & (score(before) >= score(span))
    later = (position >= after["start"]) & (score(after) > score(span))
    return ~F.coalesce(earlier, F.lit(False)) & ~F.coalesce(later, F.lit(False))


def _flags(start: np.ndarray, length: np.ndarray, new_row: np.ndarray, span: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Whether a span gives the token at ``position`` the most context: the largest
    min(left, right) + 0.01 * length, the first of equals.

    Starts and ends rise from span to span of a row, so a span that loses to any other loses to
    the one next to it on that side: the two neighbours decide.
    """

    def score(s: np.ndarray) -> np.ndarray:
        return np.minimum(position - start[s], start[s] + length[s] - 1 - position) + 0.01 * length[s]

    own = score(span)
    before, after = np.maximum(span - 1, 0), np.minimum(span + 1, len(start) - 1)
    earlier = ~new_row[span] & (position < start[before] + length[before]) & (score(before) >= own)
    later = (after > span) & ~new_row[after] & (position >= start[after]) & (score(after) > own)
    return ~(earlier | later)


def _places(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owner and the place within it of each cell of runs of the given sizes, moved to ``first``."""
    owner = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return owner, first[owner] + within


def _lists(sizes: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    """An array of lists; lists marked in ``null`` are null and have size 0."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    if null is None or not null.any():
        return pa.ListArray.from_arrays(pa.array(ends), values)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(null, False)), values)


def _spans(n: np.ndarray, room: np.ndarray, stride: int, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, number within the row, start and length of the spans; a ``whole`` row has one at most."""
    last = np.where(whole, 0, np.maximum(-(-(n - room) // stride), 0))
    count = np.where((n > 0) & (whole | (room > 0)), last + 1, 0)
    # a span that starts at the end of the text is empty
    count = np.minimum(count, np.maximum(-(-n // stride), 0))
    row, number = _places(np.zeros(len(n), np.int64), count)
    start = number * stride
    return row, number, start, np.where(whole[row], n[row], np.minimum(room[row], n[row] - start))


def _cells(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Values of an array of lists, and of each list its first value and its size."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.cumsum(sizes) - sizes, sizes


def _layout(batch: pa.RecordBatch, names: list[str], width: int, stride: int, schema: pa.Schema) -> pa.RecordBatch:
    """The spans of some examples, laid out on whole columns."""
    column = dict(zip(names, batch.columns))
    words, word_at, n_words = _cells(column["pieces"])
    tokens, piece_at, piece_size = _cells(words)
    sums = np.concatenate([[0], np.cumsum(piece_size)])
    token_at, n = sums[word_at], sums[word_at + n_words] - sums[word_at]
    word_of, _ = _places(piece_at, piece_size)
    asked, query_at, n_query = _cells(column["query"])
    whole = column["query"].is_null().to_numpy(zero_copy_only=False)
    row, number, start, length = _spans(n, width - n_query - 3, stride, whole)
    new_row = number == 0

    # question and context tokens in one pool, the marks behind them
    pool = pa.concat_arrays([tokens.cast(pa.string()), asked.cast(pa.string()), pa.array(["[CLS]", "[SEP]"], pa.string())])
    mark, missing = len(tokens) + len(asked), whole[row]
    head = n_query[row] + 2
    size = np.where(missing, 0, head + length + 1)
    span, place = _places(np.zeros(len(row), np.int64), size)
    inside = (place >= head[span]) & (place < size[span] - 1)
    context = start[span] + place - head[span]
    at = token_at[row[span]] + context
    chosen = np.select(
        [inside, place == 0, (place == head[span] - 1) | (place == size[span] - 1)],
        [at, mark, mark + 1],
        len(tokens) + query_at[row[span]] + place - 1,
    )
    orig = np.where(inside, word_of[np.where(inside, at, 0)] - word_at[row[span]], 0) if len(word_of) else np.zeros(len(span), np.int64)
    flags = inside & _flags(start, length, new_row, span, context) if len(span) else inside

    # where the answer begins and ends, in tokens of the text
    def ints(name: str) -> np.ndarray:
        return pc.fill_null(column[name], -9).to_numpy(zero_copy_only=False).astype(np.int64)

    first, last = ints("start_position"), ints("end_position")
    answer_from = sums[word_at + np.minimum(np.maximum(first, 0), n_words)] - token_at
    answer_to = sums[word_at + np.clip(last + 1, 0, n_words)] - token_at - 1
    if "answer_tokens" in column:
        wanted, wanted_at, n_wanted = _cells(column["answer_tokens"])
        for r in np.flatnonzero((n_wanted > 0) & (first >= 0) & (answer_to - answer_from + 1 >= n_wanted)).tolist():
            text = tokens.slice(token_at[r] + answer_from[r], answer_to[r] - answer_from[r] + 1).to_pylist()
            answer, k = wanted.slice(wanted_at[r], n_wanted[r]).to_pylist(), int(n_wanted[r])
            hit = next((i for i in range(len(text) - k + 1) if text[i : i + k] == answer), None)
            if hit is not None:
                answer_from[r], answer_to[r] = answer_from[r] + hit, answer_from[r] + hit + k - 1
    holds = (first[row] >= 0) & (last[row] > -9) & (answer_from[row] >= start) & (answer_to[row] <= start + length - 1)
    outside = ~inside
    arrays = {
        "qas_id": column["qas_id"].take(pa.array(row)),
        "doc_span_index": pa.array(number),
        "tokens": _lists(size, pool.take(pa.array(chosen)), missing),
        "segment_ids": _lists(size, pa.array((place >= head[span]).astype(np.int32)), missing),
        "token_to_orig": _lists(size, pa.array(orig, mask=outside), missing),
        "token_is_max_context": _lists(size, pa.array(flags), missing),
    }
    for name, answer in (("start_index", answer_from), ("end_index", answer_to)):
        arrays[name] = pa.array(np.where(holds, answer[row] - start + head, 0), mask=holds & missing)
    if "doc_tokens" in column:
        texts, text_at, _ = _cells(column["doc_tokens"])
        low = word_of[token_at[row] + start] - word_at[row] if len(row) else row
        high = word_of[token_at[row] + start + length - 1] - word_at[row] if len(row) else row
        _, cell = _places(text_at[row] + low, high - low + 1)
        arrays["first_word"], arrays["doc_tokens"] = pa.array(low), _lists(high - low + 1, texts.take(pa.array(cell)))
    if "results" in column:
        found, found_at, n_found = _cells(column["results"])
        arrays["result"] = found.take(pa.array(found_at[row] + number, mask=number >= n_found[row]))
    return pa.RecordBatch.from_arrays([arrays[f.name].cast(f.type) for f in schema], schema=schema)


def window_features(
    examples: DataFrame, pieces: str, query: str, max_seq_length: int = 384, doc_stride: int = 128,
    max_query_length: int = 64, words: bool = False, results: str | None = None,
) -> DataFrame:
    """One row per span of an example.

    ``pieces`` holds the sub-tokens of each context word (array of arrays), ``query`` the
    question tokens. Output: tokens, segment_ids, the word index of each token
    (token_to_orig, null outside the context), token_is_max_context, and start/end positions
    (0, 0 when the answer lies outside the span).

    ``words`` adds the context words of the span (doc_tokens) and the index of their first
    (first_word); ``results`` names an array with one cell per span, which becomes the column
    ``result``. Without question tokens (null) there is one span whose arrays are null.

    Context room depends on the question length, so spans are computed per row: on Arrow columns,
    some hundred thousand tokens at a time.
    """
    cells = {
        "qas_id": F.col("qas_id"), "pieces": F.col(pieces), "query": F.slice(query, 1, max_query_length),
        "start_position": F.col("start_position"), "end_position": F.col("end_position"),
    }
    cells |= {"answer_tokens": F.col("answer_tokens")} if "answer_tokens" in examples.columns else {}
    cells |= {"doc_tokens": F.col("doc_tokens")} if words else {}
    cells |= {"results": F.col(results)} if results else {}
    source = examples.select(*[c.alias(name) for name, c in cells.items()])
    names = source.columns
    fields = [source.schema["qas_id"]] + [StructField(*f) for f in (
        ("doc_span_index", IntegerType()), ("tokens", ArrayType(StringType())), ("segment_ids", ArrayType(IntegerType())),
        ("token_to_orig", ArrayType(IntegerType())), ("token_is_max_context", ArrayType(BooleanType())),
        ("start_index", IntegerType()), ("end_index", IntegerType()),
    )]
    fields += [StructField("first_word", IntegerType()), StructField("doc_tokens", ArrayType(StringType()))] if words else []
    fields += [StructField("result", source.schema["results"].dataType.elementType)] if results else []
    kept = StructType(fields)
    schema = to_arrow_schema(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes) // LAYOUT_WORDS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    yield _layout(batch.slice(low, high - low), names, max_seq_length, doc_stride, schema)

    return source.mapInArrow(run, kept)


def question_lengths(examples: DataFrame, pieces: str, query: str, max_query_length: int) -> DataFrame:
    """Per example the number of context tokens and of question tokens: (qas_id, n, n_query)."""
    sizes = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.size(p))
    return examples.select("qas_id", sizes.alias("n"), F.size(F.slice(query, 1, max_query_length)).alias("n_query"))


def spans_of_lengths(lengths: DataFrame, max_seq_length: int, doc_stride: int) -> DataFrame:
    """The spans that ``window_features`` lays out, by lengths alone: (qas_id, doc_span_index, n_tokens)."""
    n, room = F.col("n"), F.lit(max_seq_length) - F.col("n_query") - 3
    starts = F.filter(
        F.sequence(F.lit(0), n, F.lit(doc_stride)),
        lambda s: (F.least(room, n - s) > 0) & ((s == 0) | (s - doc_stride + room < n)),
    )
    spread = lengths.select("qas_id", "n", "n_query", F.posexplode(starts).alias("doc_span_index", "_s"))
    return spread.select("qas_id", "doc_span_index", (F.col("n_query") + 3 + F.least(room, n - F.col("_s"))).alias("n_tokens"))


def with_unique_ids(features: DataFrame) -> DataFrame:
    """Number the features from 1000000000 in question and span order.

    Only the questions and their numbers of spans are ordered; a feature adds its place among the
    spans of its question. Question ids are unique.
    """
    kept = stage(features, "features")
    counts = kept.groupBy("qas_id").agg(F.count(F.lit(1)).alias("_n"))
    starts = running_totals(counts, ["qas_id"], {"_end": "_n"}).select("qas_id", (F.col("_end") - F.col("_n")).alias("_start"))
    joined = kept.join(hinted(stage(starts, "feature-starts"), BROADCAST_QUESTIONS), "qas_id")
    return joined.withColumn("unique_id", F.lit(1000000000) + F.col("_start") + F.col("doc_span_index")).drop("_start")


# -- raw results ----------------------------------------------------------------------------------


def with_results(features: DataFrame, results: DataFrame) -> DataFrame:
    """Features with the raw model results of their ``unique_id`` (unique_id, start_logits, end_logits).

    Every feature needs exactly one result with a score per token, or the query fails; results
    without a feature are left out.
    """
    once = results.groupBy("unique_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("start_logits", "end_logits")]
    )
    joined = features.join(once, "unique_id", "left")
    fits = (F.col("_n") == 1) & (F.size("start_logits") == F.size("tokens")) & (F.size("end_logits") == F.size("tokens"))
    text = F.concat(F.lit("no single fitting result for feature "), F.col("unique_id").cast("string"))
    failed = F.raise_error(text).cast("array<double>")
    checked = F.when(F.coalesce(fits, F.lit(False)), F.col("start_logits")).otherwise(failed)
    return joined.withColumn("start_logits", checked).drop("_n")


def best_of_results(results: DataFrame, n: int) -> DataFrame:
    """Of each raw result: the ``n`` best starts and ends, equal ones in order, with their logits, the
    logits at position 0 and the numbers of scores. A result is reduced in its row, before it moves."""
    kept = "unique_id long, best struct<n_starts:int,n_ends:int,null_start:double,null_end:double,starts:array<struct<i:int,logit:double>>,ends:array<struct<i:int,logit:double>>>"

    def best(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        values, first, sizes = _cells(lists)
        values = values.to_numpy(zero_copy_only=False).astype(np.float64)
        # a matrix of the places, filled up behind the scores
        width = max(int(sizes.max(initial=0)), 1)
        at = np.minimum(first[:, None] + np.arange(width), max(len(values) - 1, 0))
        there = np.arange(width) < sizes[:, None]
        cells = np.where(there, -(values[at] if len(values) else np.zeros(at.shape)), np.inf)
        order = np.argsort(cells, axis=1, kind="stable")[:, :n]
        taken = np.minimum(sizes, n)
        inside = np.arange(order.shape[1]) < taken[:, None]
        places = order[inside]
        logits = -np.take_along_axis(cells, order, axis=1)[inside]
        pairs = pa.StructArray.from_arrays([pa.array(places.astype(np.int32)), pa.array(logits)], names=["i", "logit"])
        return pa.array(sizes.astype(np.int32)), pa.array(-cells[:, 0], mask=sizes == 0), _lists(taken, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (n_s, null_s, starts), (n_e, null_e, ends) = best(batch.column(1)), best(batch.column(2))
            names = ["n_starts", "n_ends", "null_start", "null_end", "starts", "ends"]
            cells = pa.StructArray.from_arrays([n_s, n_e, null_s, null_e, starts, ends], names=names)
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], names=["unique_id", "best"])

    return results.select(F.col("unique_id").cast("long"), "start_logits", "end_logits").mapInArrow(run, kept)


def results_of_questions(spans: DataFrame, results: DataFrame, n: int) -> DataFrame:
    """Per question the reduced results of its spans in order: (qas_id, results). ``spans`` holds qas_id,
    doc_span_index, n_tokens and unique_id, ``results`` unique_id, start_logits and end_logits.

    As in ``with_results`` every span needs exactly one result with a score per token.
    """
    once = best_of_results(results, n).groupBy("unique_id").agg(F.count(F.lit(1)).alias("_n"), F.first("best").alias("_b"))
    joined = spans.select("qas_id", "doc_span_index", "n_tokens", "unique_id").join(once, "unique_id", "left")
    fits = (F.col("_n") == 1) & (F.col("_b.n_starts") == F.col("n_tokens")) & (F.col("_b.n_ends") == F.col("n_tokens"))
    text = F.concat(F.lit("no single fitting result for feature "), F.col("unique_id").cast("string"))
    cell = F.struct(F.col("doc_span_index").alias("span"), *[F.col(f"_b.{c}").alias(c) for c in ("null_start", "null_end", "starts", "ends")])
    checked = F.when(F.coalesce(fits, F.lit(False)), cell).otherwise(F.raise_error(text).cast(joined.select(cell.alias("c")).schema["c"].dataType))
    by_span = lambda a, b: F.when(a["span"] < b["span"], -1).when(a["span"] > b["span"], 1).otherwise(0)
    gathered = joined.select("qas_id", checked.alias("_c")).groupBy("qas_id").agg(F.collect_list("_c").alias("_c"))
    return gathered.select("qas_id", F.array_sort("_c", by_span).alias("results"))


# -- decoding -------------------------------------------------------------------------------------


def candidate_spans(features: DataFrame, n_best: int = 20, longest: int = 30) -> DataFrame:
    """Valid (start, end) pairs of the best starts and ends of each feature.

    At most n_best^2 combinations are formed inside the row; validity is checked before they
    become rows. Input columns: qas_id, feature_index, tokens, token_to_orig,
    token_is_max_context, start_logits, end_logits.
    """
    starts, ends = best_positions(F.col("start_logits"), n_best), best_positions(F.col("end_logits"), n_best)
    # only starts and ends that a valid span can have are combined
    usable_starts = F.filter(
        starts, lambda s: (s < F.size("tokens")) & F.get("token_to_orig", s).isNotNull() & F.coalesce(F.get("token_is_max_context", s), F.lit(False))
    )
    usable_ends = F.filter(ends, lambda e: (e < F.size("tokens")) & F.get("token_to_orig", e).isNotNull())
    pairs = let(
        usable_ends,
        lambda es: F.flatten(
            F.transform(
                usable_starts,
                lambda s: F.transform(
                    F.filter(es, lambda e: (e >= s) & (e - s + 1 <= longest)),
                    lambda e: F.struct(s.alias("start_index"), e.alias("end_index")),
                ),
            )
        ),
    )
    kept = [c for c in features.columns if c not in ("start_index", "end_index")]
    return features.select(*kept, F.inline(pairs)).withColumns(
        {
            "start_logit": F.get("start_logits", F.col("start_index")),
            "end_logit": F.get("end_logits", F.col("end_index")),
        }
    )


def candidates_of_best(features: DataFrame, longest: int = 30) -> DataFrame:
    """``candidate_spans`` of features that carry their reduced ``result`` (see ``results_of_questions``)."""
    starts = F.filter(
        "result.starts", lambda s: F.get("token_to_orig", s["i"]).isNotNull() & F.coalesce(F.get("token_is_max_context", s["i"]), F.lit(False))
    )
    ends = F.filter("result.ends", lambda e: F.get("token_to_orig", e["i"]).isNotNull())
    pairs = let(
        ends,
        lambda es: F.flatten(
            F.transform(
                starts,
                lambda s: F.transform(
                    F.filter(es, lambda e: (e["i"] >= s["i"]) & (e["i"] - s["i"] + 1 <= longest)),
                    lambda e: F.struct(
                        s["i"].alias("start_index"), e["i"].alias("end_index"), s["logit"].alias("start_logit"), e["logit"].alias("end_logit")
                    ),
                ),
            )
        ),
    )
    kept = [c for c in features.columns if c not in ("start_index", "end_index", "result")]
    return features.select(*kept, F.inline(pairs))


def final_text(predicted: Column, original: Column, lower: bool = True) -> Column:
    """Project a token-joined prediction back onto the original text.

    Characters other than blanks of the original and of its tokenised form are aligned one to
    one; if that is impossible the original is the answer.
    """
    def squeezed(text: Column) -> Column:
        return F.replace(text, F.lit(" "), F.lit(""))

    def place_of(text: Column, rank: Column) -> Column:
        places = F.filter(
            F.transform(F.split(text, ""), lambda c, i: F.when((c != " ") & (c != ""), i)), lambda i: i.isNotNull()
        )
        return F.get(places, rank)

    def project(tokenized: Column) -> Column:
        start = F.instr(tokenized, predicted) - 1
        first = F.length(squeezed(F.left(tokenized, start)))
        last = F.length(squeezed(F.left(tokenized, start + F.length(predicted)))) - 1
        begin, end = place_of(original, first), place_of(original, last)
        usable = (
            (start >= 0) & (predicted != "") & (F.length(squeezed(original)) == F.length(squeezed(tokenized)))
        )
        return F.when(usable, F.substring(original, begin + 1, end - begin + 1)).otherwise(original)

    return let(F.array_join(basic_tokens(original, lower), " "), project)


def n_best(
    candidates: DataFrame,
    n: int = 20,
    nulls: DataFrame | None = None,
    questions: DataFrame | None = None,
    lower: bool = True,
) -> DataFrame:
    """The ``n`` best distinct answer texts of each question with their probabilities.

    Input: candidate_spans joined with the question's doc_tokens (word array), or with a part of
    them that begins at the word ``first_word``. ``nulls`` (see
    ``null_scores``) adds the empty answer with its logits, behind equal sums; if it is not among
    the best n it follows them. ``questions`` (qas_id) names questions that get a row in any case:
    the text "empty" with logits 0 where there is neither candidate nor null. Each text keeps its best span, chosen per (question, text) before questions
    are grouped, so one question with very many features is reduced in parallel.
    """
    first = F.col("first_word") if "first_word" in candidates.columns else F.lit(0)
    low, high = (F.get("token_to_orig", F.col(c)) - first for c in ("start_index", "end_index"))
    wording = F.array_join(
        F.slice("tokens", F.col("start_index") + 1, F.col("end_index") - F.col("start_index") + 1), " "
    )
    texts = candidates.select(
        "qas_id",
        final_text(detokenize(wording), F.array_join(F.slice("doc_tokens", low + 1, high - low + 1), " "), lower).alias("text"),
        "start_logit",
        "end_logit",
        F.struct(
            (-(F.col("start_logit") + F.col("end_logit"))).alias("k"), "feature_index", "start_index", "end_index"
        ).alias("_order"),
    )
    if nulls is not None:
        last = F.lit(2**31 - 1)
        texts = texts.unionByName(
            nulls.select(
                "qas_id",
                F.lit("").alias("text"),
                F.col("null_start_logit").alias("start_logit"),
                F.col("null_end_logit").alias("end_logit"),
                F.struct(
                    (-F.col("score_null")).alias("k"), last.alias("feature_index"), last.alias("start_index"), last.alias("end_index")
                ).alias("_order"),
            )
        )
    best = texts.groupBy("qas_id", "text").agg(
        F.min_by(F.struct("start_logit", "end_logit", "_order"), "_order").alias("_b")
    )
    ranked = best.select("qas_id", "text", "_b.*").withColumn(
        "rank", F.row_number().over(Window.partitionBy("qas_id").orderBy("_order"))
    )
    kept = (F.col("rank") <= n) if nulls is None else (F.col("rank") <= n) | (F.col("text") == "")
    found = ranked.where(kept).select(
        "qas_id", F.least("rank", F.lit(n + 1)).alias("rank"), "text", "start_logit", "end_logit"
    )
    if questions is None:
        return found
    every = questions.select("qas_id").distinct().join(found, "qas_id", "left")
    return every.select(
        "qas_id", F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("text", F.lit("empty")).alias("text"),
        F.coalesce("start_logit", F.lit(0.0)).alias("start_logit"), F.coalesce("end_logit", F.lit(0.0)).alias("end_logit"),
    )


def null_scores(features: DataFrame) -> DataFrame:
    """Per question the smallest logit sum at position 0; the first feature of equals."""
    row = features.select(
        "qas_id",
        "feature_index",
        F.get("start_logits", F.lit(0)).alias("null_start_logit"),
        F.get("end_logits", F.lit(0)).alias("null_end_logit"),
    ).withColumn("score_null", F.col("null_start_logit") + F.col("null_end_logit"))
    best = F.min_by(
        F.struct("score_null", "null_start_logit", "null_end_logit"), F.struct("score_null", "feature_index")
    )
    return row.groupBy("qas_id").agg(best.alias("_n")).select("qas_id", "_n.*")


def with_probabilities(answers: DataFrame) -> DataFrame:
    """Softmax over the logit sums of each question's answers (n rows per question)."""
    cells = F.sort_array(F.collect_list(F.struct("rank", "text", "start_logit", "end_logit")))
    grouped = answers.groupBy("qas_id").agg(cells.alias("_a"))
    probs = softmax(F.transform("_a", lambda a: a["start_logit"] + a["end_logit"]))
    zipped = F.arrays_zip(F.col("_a").alias("a"), probs.alias("p"))
    return grouped.select("qas_id", F.explode(zipped).alias("_z")).select(
        "qas_id", "_z.a.*", F.col("_z.p").alias("probability")
    )


def decide(answers: DataFrame, nulls: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Empty answer where the null score beats the best text by more than the threshold.

    A question without any non-empty candidate gets the empty answer.
    """
    best = answers.where("text != ''").groupBy("qas_id").agg(
        F.min_by(F.struct("text", "start_logit", "end_logit"), "rank").alias("_b")
    )
    joined = nulls.join(best, "qas_id", "left")
    diff = F.col("score_null") - F.col("_b.start_logit") - F.col("_b.end_logit")
    return joined.select(
        "qas_id",
        diff.alias("score_diff"),
        F.when(diff.isNull() | (diff > threshold), "").otherwise(F.col("_b.text")).alias("prediction"),
    )
