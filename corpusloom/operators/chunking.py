"""Splitting texts into chunks. Every operator works inside its row: no shuffle, no Python
(``boundary_chunks(strict=True)`` excepted, whose window starts depend on the previous end)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.columns import indices, let
from corpusloom.functions.text import SPACE, body, lstrip, strip

# Sizes of the structural chunker and of the window splitters.
MIN_CHUNK_CHARS, NOISE_CHARS, TABLE_BODY_CHARS, CONTEXT_LINES = 200, 50, 10, 5
SEPARATORS = ("\n\n", "\n", ". ", " ")
HEADER = "#{1,6}[" + SPACE + "]"
TABLE_ROW = r"\A\|[^\n]+\|"


def _windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters starting every ``size - overlap``, by one scan of the text.

    Repeated ``substring`` calls would rescan the text from its start for each window.
    """
    step = size - overlap
    following = -(-overlap // step)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    if overlap == 0:
        return pieces

    def window(piece: Column, i: Column, all_pieces: Column) -> Column:
        tail = F.array_join(F.slice(all_pieces, i + 2, F.lit(following)), "")
        return F.concat(piece, F.left(tail, F.lit(overlap)))

    return let(pieces, lambda ps: F.transform(ps, lambda p, i: window(p, i, ps)))


def fixed_windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """array<struct<char_start, content>>; the last window may lie inside the one before."""
    step = size - overlap
    return F.transform(
        _windows(text, size, overlap),
        lambda w, i: F.struct((i * step).alias("char_start"), strip(w).alias("content")),
    )


def _cut_at_separator(window: Column, at_least: int) -> Column:
    """The window up to its last separator of the best kind found at ``at_least`` or later."""
    cuts = [
        F.nullif(
            F.regexp_extract(window, f"(?s)\\A.{{{at_least},}}{sep.replace('.', chr(92) + '.')}", 0),
            F.lit(""),
        )
        for sep in SEPARATORS
    ]
    return F.coalesce(*cuts, window)


def _boundary_windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<start, span>>: a window never ends later than start + size, so the next
    start ``max(end - overlap, start + step)`` is always ``start + step``; the loop stops with
    the first window that reaches the end of the text."""
    step = size - overlap
    length = F.length(text)
    needed = F.greatest(F.ceil((length - size) / step), F.lit(0)) + 1
    windows = F.slice(_windows(text, size, overlap), F.lit(1), needed.cast("int"))
    return let(
        windows,
        lambda ws: F.transform(
            ws,
            lambda w, i: F.struct(
                (i * step).alias("start"),
                F.when(i + 1 == F.size(ws), w)
                .otherwise(_cut_at_separator(w, int(size * 0.6)))
                .alias("span"),
            ),
        ),
    )


def _strict_windows(size: int, overlap: int):
    at_least = int(size * 0.6)

    @F.pandas_udf("array<struct<start:int,span:string>>")
    def windows(texts: pd.Series) -> pd.Series:
        def split(text: str | None) -> list[dict]:
            out, start = [], 0
            while text and start < len(text):
                span = text[start : start + size]
                if start + size < len(text):
                    ends = [span.rfind(s) + len(s) for s in SEPARATORS if span.rfind(s) >= at_least]
                    span = span[: ends[0]] if ends else span
                out.append({"start": start, "span": span})
                if start + len(span) >= len(text):
                    break
                start += len(span) - overlap
            return out

        return texts.map(split)

    # declared nondeterministic so that an explode and its filter do not run it twice
    return windows.asNondeterministic()


def boundary_windows(text: Column, size: int = 1000, overlap: int = 200, strict: bool = False) -> Column:
    """array<struct<char_start, char_end, content>> of windows cut at the best separator.

    With ``strict`` each window starts ``overlap`` before the end of the one before, so that no
    character is lost behind an early cut.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    if strict and overlap >= int(size * 0.6):
        raise ValueError("strict windows need an overlap below 0.6 * size to advance")
    spans = _strict_windows(size, overlap)(text) if strict else _boundary_windows(text, size, overlap)
    chunks = F.transform(
        spans,
        lambda s: F.struct(
            (s["start"] + F.length(s["span"]) - F.length(lstrip(s["span"]))).cast("int").alias("char_start"),
            (s["start"] + F.length(s["span"])).cast("int").alias("char_end"),
            strip(s["span"]).alias("content"),
        ),
    )
    return F.filter(chunks, lambda c: c["content"] != "")


def explode_chunks(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """One row per chunk with ``chunk_no`` and the fields of the chunk."""
    exploded = df.select(*keep, F.posexplode(chunks).alias("chunk_no", "_chunk"))
    return exploded.select(*keep, "chunk_no", "_chunk.*")


# -- composed pages -----------------------------------------------------------------------


def compose_pages(pages: Column) -> Column:
    """Pages joined by an empty line."""
    return F.array_join(pages, "\n\n")


def page_spans(pages: Column) -> Column:
    """array<struct<start, end>> of each page in the composed text.

    Meant for documents of up to some thousand pages; with pages as rows, running totals give
    the same spans for any number of them.
    """
    state = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )
    return F.aggregate(
        pages,
        state,
        lambda acc, page: F.struct(
            (acc["at"] + F.length(page) + 2).alias("at"),
            F.concat(
                acc["spans"],
                F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(page)).alias("end"))),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def page_of_offset(spans: Column, offset: Column) -> Column:
    """Index of the span holding the offset; an offset in no span belongs to the last page.

    Spans come in order and do not overlap: the last one that starts at or before the offset is
    found by halving.
    """
    count = F.size(spans)
    low, high = F.lit(0).alias("low"), count.alias("high")

    def halve(state: Column, _: Column) -> Column:
        middle = ((state["low"] + state["high"]) / 2).cast("int")
        before = (state["low"] < state["high"]) & (F.get(spans, middle)["start"] <= offset)
        return F.struct(
            F.when(before, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(before, state["high"]).otherwise(middle).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(count + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(low, high), halve)["low"] - 1
    holds = (found >= 0) & (offset < F.get(spans, F.greatest(found, F.lit(0)))["end"])
    return F.when(holds, found).otherwise(F.greatest(count - 1, F.lit(0)))


def with_pages(chunks: Column, spans: Column) -> Column:
    """Add the page of each chunk's start, before the chunks become rows."""
    return let(
        spans,
        lambda ss: F.transform(
            chunks,
            lambda c: F.struct(
                c["char_start"].alias("char_start"),
                c["char_end"].alias("char_end"),
                c["content"].alias("content"),
                page_of_offset(ss, c["char_start"]).alias("page"),
            ),
        ),
    )


def page_ranges(page_count: Column, batch: int = 10) -> Column:
    """array<array<int>> of consecutive page indexes, ``batch`` at a time."""
    return F.transform(
        indices(F.ceil(page_count / batch).cast("int")),
        lambda b: F.sequence(b * batch, F.least((b + 1) * batch, page_count) - 1),
    )


# -- structural chunks --------------------------------------------------------------------


def has_header(text: Column) -> Column:
    return text.rlike(f"(?md)^{HEADER}")


def header_segments(text: Column) -> Column:
    """Stripped sections from header to header; text before the first header is dropped.

    A text without headers is one stripped segment.
    """
    parts = F.split(text, f"(?md)(?=^{HEADER})")
    sections = F.filter(parts, lambda p: p.rlike(rf"\A{HEADER}"))
    return F.when(has_header(text), F.transform(sections, strip)).otherwise(
        F.array(strip(text))
    )


def merge_noise(segments: Column) -> Column:
    """Segments with hardly any body are put in front of the next one; a rest joins the last."""
    texts = F.array().cast("array<string>")
    state = F.struct(texts.alias("out"), F.lit("").alias("pre"))

    def step(acc: Column, seg: Column) -> Column:
        prefixed = F.when(acc["pre"] == "", seg).otherwise(strip(F.concat(acc["pre"], F.lit("\n\n"), seg)))
        short = F.length(body(seg)) < NOISE_CHARS
        return F.struct(
            F.when(short, acc["out"]).otherwise(F.concat(acc["out"], F.array(prefixed))).alias("out"),
            F.when(short, prefixed).otherwise("").alias("pre"),
        )

    def finish(acc: Column) -> Column:
        kept = F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
        last = strip(F.concat(F.get(acc["out"], F.size(acc["out"]) - 1), F.lit("\n\n"), acc["pre"]))
        return (
            F.when(acc["pre"] == "", acc["out"])
            .when(F.size(acc["out"]) > 0, F.concat(kept, F.array(last)))
            .otherwise(F.array(acc["pre"]))
        )

    return F.aggregate(segments, state, step, finish)


def structural_segments(text: Column) -> Column:
    """Header sections without orphans; texts without headers are not merged."""
    headed = has_header(text)
    return F.when(headed, merge_noise(header_segments(text))).otherwise(header_segments(text))


def chunk_type(segment: Column, marks: Column) -> Column:
    """``table`` if any non-empty table or preamble text occurs in the segment."""
    hit = F.exists(marks, lambda m: (m != "") & F.contains(segment, m))
    return F.when(hit, "table").otherwise("text")


def merge_short(chunks: Column, min_chars: int = MIN_CHUNK_CHARS) -> Column:
    """Join neighbours until ``min_chars`` characters are gathered (separators not counted).

    In and out: array<struct<text, chunk_type>>. A rest that starts with a short chunk joins
    the last result; joined chunks are tables if any part is.
    """
    item = "array<struct<text:string,chunk_type:string>>"
    empty = F.array().cast(item)
    state = F.struct(empty.alias("out"), empty.alias("pending"), F.lit(0).alias("chars"))

    def join(parts: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"),
            F.when(F.exists(parts, lambda p: p["chunk_type"] == "table"), "table")
            .otherwise("text")
            .alias("chunk_type"),
        )

    def step(acc: Column, chunk: Column) -> Column:
        pending = F.concat(acc["pending"], F.array(chunk))
        chars = acc["chars"] + F.length(chunk["text"])
        full = chars >= min_chars
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(join(pending)))).otherwise(acc["out"]).alias("out"),
            F.when(full, empty).otherwise(pending).alias("pending"),
            F.when(full, 0).otherwise(chars).alias("chars"),
        )

    def finish(acc: Column) -> Column:
        size = F.size(acc["out"])
        kept = F.slice(acc["out"], F.lit(1), F.greatest(size - 1, F.lit(0)))
        last = F.slice(acc["out"], F.greatest(size, F.lit(1)), F.lit(1))
        starts_short = F.length(F.get(acc["pending"], F.lit(0))["text"]) < min_chars
        return (
            F.when(F.size(acc["pending"]) == 0, acc["out"])
            .when((size > 0) & starts_short, F.concat(kept, F.array(join(F.concat(last, acc["pending"])))))
            .otherwise(F.concat(acc["out"], F.array(join(acc["pending"]))))
        )

    return F.aggregate(chunks.cast(item), state, step, finish)


def is_substantive(text: Column, kind: Column) -> Column:
    """Enough body: tables need less than running text."""
    return F.length(body(text)) >= F.when(kind == "table", TABLE_BODY_CHARS).otherwise(NOISE_CHARS)


def structural_chunks(text: Column, tables: Column) -> Column:
    """Page text to array<struct<text, chunk_type>>: split, type, merge, filter."""
    marks = F.array_distinct(
        F.concat(F.transform(tables, lambda t: t["table"]), F.transform(tables, lambda t: t["preamble"]))
    )
    typed = let(
        marks,
        lambda ms: F.transform(
            structural_segments(text),
            lambda s: F.struct(s.alias("text"), chunk_type(s, ms).alias("chunk_type")),
        ),
    )
    return F.filter(merge_short(typed), lambda c: is_substantive(c["text"], c["chunk_type"]))


# -- tables -------------------------------------------------------------------------------


def table_blocks(text: Column, context: int = CONTEXT_LINES) -> Column:
    """array<struct<preamble, table, line_start, line_end>> of runs of ``|...|`` lines.

    A single blank line belongs to the run if a row follows or the text ends. The preamble is
    the ``context`` lines before the run; line numbers are 0-based and half-open.
    """

    def blocks(lines: Column) -> Column:
        n = F.size(lines)
        kinds = F.transform(
            lines, lambda l: F.when(l.rlike(TABLE_ROW), 2).when(strip(l) == "", 1).otherwise(0)
        )

        def spans(k: Column) -> Column:
            def row(i: Column) -> Column:
                return F.coalesce(F.get(k, i) == 2, F.lit(False))

            members = F.transform(
                k, lambda v, i: (v == 2) | ((v == 1) & row(i - 1) & (row(i + 1) | (i + 1 == n)))
            )

            def edges(m: Column) -> Column:
                starts = F.filter(
                    indices(n), lambda i: F.get(m, i) & ~F.coalesce(F.get(m, i - 1), F.lit(False))
                )
                ends = F.filter(
                    indices(n), lambda i: F.get(m, i) & ~F.coalesce(F.get(m, i + 1), F.lit(False))
                )
                return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e")))

            return let(members, edges)

        def block(span: Column) -> Column:
            first = F.greatest(span["s"] - context, F.lit(0))
            return F.struct(
                strip(F.array_join(F.slice(lines, first + 1, span["s"] - first), "\n")).alias("preamble"),
                strip(F.array_join(F.slice(lines, span["s"] + 1, span["e"] - span["s"]), "\n")).alias("table"),
                span["s"].alias("line_start"),
                span["e"].alias("line_end"),
            )

        return F.transform(let(kinds, spans), block)

    return let(F.split(text, "\n"), blocks)


# -- token spans --------------------------------------------------------------------------


def doc_spans(n_tokens: Column, longest: int, stride: int) -> Column:
    """array<struct<start, length>> covering the tokens, stopping at the first span at the end."""
    if stride > longest:
        raise ValueError("stride must not exceed the span length")
    spans = F.transform(
        F.sequence(F.lit(0), n_tokens, F.lit(stride)),
        lambda s: F.struct(s.alias("start"), F.least(F.lit(longest), n_tokens - s).alias("length")),
    )
    return F.filter(
        spans,
        lambda s: (s["length"] > 0) & ((s["start"] == 0) | (s["start"] - stride + longest < n_tokens)),
    )


# -- documents from pages -----------------------------------------------------------------


def page_number(page: Column, number: Column) -> Column:
    """The page of a record: ``page`` unless it is missing or 0, else ``number``."""
    return F.when(page.isNotNull() & (page != 0), page).otherwise(number)


def assemble_documents(pages: DataFrame, *document: str) -> DataFrame:
    """Page rows (page_index, text) -> one text per document, pages in order (none counts as 0).

    The result row is the document itself, which bounds what meets in one group.
    """
    page = F.struct(F.coalesce("page_index", F.lit(0)).alias("p"), "text")
    grouped = pages.groupBy(*document).agg(F.sort_array(F.collect_list(page)).alias("_p"))
    texts = F.transform("_p", lambda p: p["text"])
    return grouped.select(*document, compose_pages(texts).alias("text"), F.size("_p").alias("page_count"))
