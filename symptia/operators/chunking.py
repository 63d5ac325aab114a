"""Overlapping token windows over pages, with offsets and section titles.

Everything happens inside the row of a page: windows come from array slices
and one explode, so preparing a corpus needs no shuffle at any size. Offsets
are prefix sums over blocks, and a window looks its section up by bisection, so
the work grows with the page and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import text
from symptia.functions.rows import explode_rows

# Headings are recognised line by line.
_HEADING = r"(?:#{1,6}[ \t]+(\S.*)|([A-Z][A-Z \t]{3,}[A-Z])[ \t]*(?:\n|\z))"
_BEFORE_HEADING = r"(?md)(?=^" + _HEADING.replace("(\\S.*)", "\\S").replace("([A-Z]", "(?:[A-Z]", 1) + ")"


# Numbers that are added up one by one before blocks of them are.
BLOCK = 64


def sums_before(values: Column, levels: int = 2) -> Column:
    """For every place of an array of numbers the sum of those before it: that
    of its block so far and, the same way, that of the blocks before."""

    def so_far(at: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(at, start + 1, n), F.lit(0), lambda a, v: a + v)

    if not levels:
        return text.bind(values, lambda vs: F.transform(vs, lambda _, i: so_far(vs, F.lit(0), i)))

    def blocked(vs: Column) -> Column:
        starts = F.when(F.size(vs) > 0, F.sequence(F.lit(0), F.size(vs) - 1, F.lit(BLOCK))).otherwise(
            F.array().cast("array<int>"))
        before = sums_before(F.transform(starts, lambda s: so_far(vs, s, F.lit(BLOCK))), levels - 1)
        return text.bind(before, lambda bs: F.transform(vs, lambda _, i: F.get(bs, F.floor(i / BLOCK).cast("int")) + so_far(
            vs, i - i % BLOCK, i % BLOCK)))

    return text.bind(values, blocked)


def section_headings(page: Column) -> Column:
    """Structs (start, title) in text order. The page is cut in front of every
    heading line, so the piece lengths add up to the heading offsets."""

    def titled(parts: Column) -> Column:
        def heading(part: Column, start: Column) -> Column:
            # (?d): only a newline ends a line
            line = F.regexp_extract(part, "(?d)^" + _HEADING, 1)
            capitals = F.regexp_extract(part, "(?d)^" + _HEADING, 2)
            return F.struct(start.alias("start"), text.strip(F.concat(line, capitals)).alias("title"))

        return F.filter(F.zip_with(parts, sums_before(F.transform(parts, F.length)), heading), lambda h: h["title"] != "")

    return text.bind(F.split(page, _BEFORE_HEADING), titled)


def section_at(headings: Column, offset: Column) -> Column:
    """Title of the last heading starting at or before the offset, else ''.
    Headings are in order of their starts."""
    bits = F.length(F.bin(F.size(headings)))

    def halve(n: Column, bit: Column) -> Column:
        step = n + F.call_function("shiftleft", F.lit(1), bit)
        return F.when(F.get(headings, step - 1)["start"] <= offset, step).otherwise(n)

    at = F.aggregate(F.sequence(bits - 1, F.lit(0), F.lit(-1)), F.lit(0), halve)
    return F.coalesce(F.get(headings, at - 1)["title"], F.lit(""))


def window_starts(total: Column, step: int) -> Column:
    """Token positions 0, step, 2*step, ... below ``total``."""
    return F.when(total > 0, F.sequence(F.lit(0), total - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def chunk_spans(
    pieces: Column, chunk_tokens: int = fv.CHUNK_TOKENS, overlap_tokens: int = fv.OVERLAP_TOKENS
) -> Column:
    """Structs (idx, char_start, char_end, raw). Offsets are exact: the pieces
    concatenate to the page, so a window starts where the steps before it end."""
    step = max(chunk_tokens - overlap_tokens, 1)

    def spans(p: Column) -> Column:
        starts = window_starts(F.size(p), step)
        step_chars = F.transform(
            starts, lambda s: F.length(F.array_join(F.slice(p, s + 1, F.lit(step)), ""))
        )
        return text.bind(sums_before(step_chars), lambda before: F.zip_with(
            F.transform(starts, lambda s, i: F.struct(i.alias("idx"), F.array_join(F.slice(p, s + 1, F.lit(chunk_tokens)), "").alias("raw"))),
            before,
            lambda w, at: F.struct(
                w["idx"].alias("idx"), at.alias("char_start"), (at + F.length(w["raw"])).alias("char_end"), w["raw"].alias("raw"))))

    return text.bind(pieces, spans)


def chunk_pages(
    pages: DataFrame,
    chunk_tokens: int = fv.CHUNK_TOKENS,
    overlap_tokens: int = fv.OVERLAP_TOKENS,
    tokenise: Callable[[Column], Column] = text.pieces,
) -> DataFrame:
    """Chunks of pages (source_name, page_number, text).

    ``tokenise`` maps a text to pieces that concatenate back to it. Blank
    windows are dropped but keep their number, so ids may skip.
    """
    stem = F.regexp_replace("source_name", r"\.[^.]*$", "")
    # titles are looked up before the windows become rows, which would each
    # carry all headings of the page
    spans = chunk_spans(tokenise(F.col("text")), chunk_tokens, overlap_tokens)
    placed = text.bind(section_headings(F.col("text")), lambda headings: F.transform(spans, lambda w: F.struct(
        *[w[c].alias(c) for c in ("idx", "char_start", "char_end", "raw")],
        section_at(headings, w["char_start"]).alias("title"))))
    # a blank page has no windows left after the last filter, so it needs none
    # of its own
    windows = (
        explode_rows(pages, ["source_name", "page_number"], placed, "_w")
        .withColumn("_chunk", text.strip("_w.raw"))
        .filter(F.col("_chunk") != "")
    )
    return windows.select(
        F.concat_ws("_", stem, "page_number", "_w.idx").alias("chunk_id"),
        "source_name",
        "page_number",
        F.col("_w.title").alias("section_title"),
        text.category("source_name").alias("medical_category"),
        F.col("_chunk").alias("text"),
        F.size(tokenise(F.col("_chunk"))).alias("token_count"),
        "_w.char_start",
        "_w.char_end",
    )
