"""From a corpus to labelled chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import text
from symptia.operators import chunking
from symptia.sources import corpus


def ingest(pages: DataFrame, chunk_tokens: int = fv.CHUNK_TOKENS, overlap_tokens: int = fv.OVERLAP_TOKENS,
           **options) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected) of pages (source_name, page_number, text)."""
    valid, rejected = corpus.split_readable(pages)
    return chunking.chunk_pages(valid, chunk_tokens, overlap_tokens, **options), rejected


def totals(pages: DataFrame, chunk_tokens: int = fv.CHUNK_TOKENS, overlap_tokens: int = fv.OVERLAP_TOKENS) -> DataFrame:
    """Files processed, chunks and number of rejected files, as one row.

    The rejected list itself is the second output of :func:`ingest`; folding
    it into one cell would grow with the data.
    """
    readable = corpus.unreadable_reason().isNull()
    spans = chunking.chunk_spans(text.pieces("text"), chunk_tokens, overlap_tokens)
    kept = F.size(F.filter(spans, lambda w: ~text.is_blank(w["raw"])))
    # one pass: what a page contributes is known within its row
    return pages.agg(
        F.count_if(readable).alias("files_processed"),
        F.coalesce(F.sum(F.when(readable, kept)), F.lit(0)).alias("total_chunks"),
        F.count_if(~readable).alias("n_errors"),
    )
