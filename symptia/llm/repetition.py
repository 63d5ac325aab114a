"""Quality rules on repetition inside a text, from a suffix array over its words.

The texts of a batch stand one after another, each closed by a symbol of its
own, so no match crosses a text. Prefix doubling puts all suffixes in order,
sorting again only those that still share their beginning with another; the
ranks of every doubling then give the longest common prefixes (LCP) of
neighbours. An interval of the LCP array is a substring that occurs at least
twice; it is maximal if the words before its occurrences differ. Of every
suffix only its longest repeated beginning matters to the union of spans, since
the spans of all other repeats lie inside.

A text fails if repeats of at least ``LEAST`` words cover more than ``COVERED``
of its words, or if one repeat is longer than ``LONGEST`` words. Nothing is
shuffled; a batch is worked off in portions of about ``PORTION`` bytes, and a
longer text is a portion of its own (about 20 bytes of memory a byte).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symptia.llm.common import text_values

LEAST = 10
COVERED = 0.2
LONGEST = 100
PORTION = 1 << 21
# What the base rules ask for.
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50

_WORD = re.compile("[^\x20\x09-\x0d]+")
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_repeats long, "
            "covered_words long, longest_repeat long, spans array<struct<start: long, end: long>>")


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks of all suffixes by their first 1, 2,
    4, ... symbols. The last symbol must occur once."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    head = np.append(True, np.diff(symbols[order]) != 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels = [rank.astype(np.int32)]
    while True:
        crowded = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(crowded):
            return order, levels
        # a suffix that shares its first symbols with another has no closing
        # symbol among them, so the place after them exists
        at = order[crowded]
        key = rank[at] * n + rank[at + (1 << len(levels) - 1)]
        moved = np.argsort(key, kind="stable")
        order[crowded] = at = at[moved]
        head[crowded] = first = np.append(True, np.diff(key[moved]) != 0)
        rank[at] = np.maximum.accumulate(np.where(first, crowded, 0))
        levels.append(rank.astype(np.int32))


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Symbols each suffix in order has in common with the next one."""
    lcp = (levels[0][order[:-1]] == levels[0][order[1:]]).astype(np.int64)
    if len(levels) > 1:
        more = np.flatnonzero(levels[1][order[:-1]] == levels[1][order[1:]])
        left, right = order[more], order[more + 1]
        start = left.copy()
        for level in range(len(levels) - 1, -1, -1):
            step = (levels[level][left] == levels[level][right]).astype(np.int64) << level
            left, right = left + step, right + step
        lcp[more] = left - start
    return lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """(length, first, last) of every interval of at least ``least`` symbols."""
    found = []
    places = np.flatnonzero(lcp >= least)
    for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1) if len(places) else ():
        open_ = []
        for place, length in zip(run.tolist(), lcp[run].tolist()):
            first = place
            while open_ and open_[-1][0] > length:
                closed, first = open_.pop()
                found.append((closed, first, place))
            if not open_ or open_[-1][0] < length:
                open_.append((length, first))
        found += [(length, first, int(run[-1]) + 1) for length, first in open_]
    return np.array(found, np.int64).reshape(-1, 3)


def maximal(intervals: np.ndarray, order: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The intervals whose occurrences do not all follow the same symbol."""
    before = np.where(order > 0, symbols[order - 1], -1)
    changes = np.append(0, np.cumsum(np.diff(before) != 0))
    return intervals[changes[intervals[:, 1]] < changes[intervals[:, 2]]]


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` places the spans cover."""
    opened, closed = np.bincount(starts, minlength=n + 1), np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum((opened - closed)[:-1]) > 0


def _spans(text: str, mask: np.ndarray) -> list[dict]:
    """Runs of covered words in code points, from the first word's start to
    the last one's end."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    if not len(edges):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    return [{"start": words[a][0], "end": words[b - 1][1]} for a, b in edges.reshape(-1, 2)]


def measure_texts(texts: list[str], least: int) -> dict[str, list]:
    """The measures of some texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = [r.split() for r in raw]
    sizes = np.array([len(w) for w in words], np.int64)
    known: dict[bytes, int] = {}
    n = int(sizes.sum()) + len(texts)
    symbols, owner = np.empty(n, np.int64), np.repeat(np.arange(len(texts)), sizes + 1)
    begins = np.cumsum(sizes + 1) - sizes - 1
    for at, own in zip(begins.tolist(), words):
        symbols[at : at + len(own)] = [known.setdefault(w, len(known)) for w in own]
    # a text is sorted among its own suffixes only
    closing = begins + sizes
    symbols[closing] = len(known)
    symbols += owner * (len(known) + 1)
    order, levels = suffix_order(symbols)
    lcp = common_prefixes(order, levels)
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(np.append(lcp, 0), np.append(0, lcp))
    repeats = maximal(lcp_intervals(lcp, least), order, symbols)
    per_text = np.bincount(owner[order[repeats[:, 1]]], minlength=len(texts))
    windows = np.flatnonzero(longest >= WINDOW)
    in_windows = covered(windows, WINDOW, n)
    starts = np.flatnonzero(longest >= least)
    in_repeats = covered(starts, longest[starts], n)
    out: dict[str, list] = {k.split()[0]: [] for k in MEASURES.split(", ")[:8]} | {"spans": []}
    for i, (text, data, at, size) in enumerate(zip(texts, raw, begins.tolist(), sizes.tolist())):
        own = slice(at, at + size)
        lines = [line for line in data.split(b"\n") if line.strip(_BLANKS)]
        out["n_words"].append(size)
        out["word_chars"].append(len(text) - len(data) + len(data.translate(None, _BLANKS)))
        out["n_symbols"].append(len(data) - len(data.translate(None, _SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(int(in_windows[own].sum()))
        out["n_repeats"].append(int(per_text[i]))
        out["covered_words"].append(int(in_repeats[own].sum()))
        out["longest_repeat"].append(int(longest[own].max(initial=0)))
        out["spans"].append(_spans(text, in_repeats[own]))
    return out


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of about ``PORTION`` characters."""
    own, held = [], 0
    for text in texts:
        if own and held + len(text) > PORTION:
            yield own
            own, held = [], 0
        own.append(text)
        held += len(text) + 1
    if own:
        yield own


def measures(text: Column, least: int = LEAST) -> Column:
    """The measures of a text as a struct; a null text counts as empty.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that are equal to an earlier line),
    ``n_repeat_words`` (words in windows of three that occur twice), and of the
    repeats of at least ``least`` words: ``n_repeats`` (maximal ones),
    ``covered_words`` and ``spans`` (their union, in code points).
    ``longest_repeat`` is in words, of any length; occurrences may overlap.
    """
    kind = pa.struct([
        *[(c.split()[0], pa.int64()) for c in MEASURES.split(", ")[:8]],
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(column: pa.Array) -> pa.Array:
        parts = [measure_texts(portion, least) for portion in _portions(text_values(column))]
        arrays = [pa.array([v for p in parts for v in p[f.name]], f.type) for f in kind]
        return pa.StructArray.from_arrays(arrays, fields=list(kind))

    return F.arrow_udf(run, MEASURES)(text.cast("string"))


def base_failed(measured: Column) -> Column:
    """Under 50 words, or over half of them in repeated windows."""
    words = measured["n_words"]
    return (words < LEAST_WORDS) | (100 * measured["n_repeat_words"] > MOST_REPEATED * words)


def repetitive(measured: Column, most: float = COVERED, longest: int = LONGEST) -> Column:
    """Repeats cover too much, or one is too long."""
    return (measured["covered_words"] > most * measured["n_words"]) | (measured["longest_repeat"] > longest)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, most: float = COVERED,
          longest: int = LONGEST) -> DataFrame:
    """One row per row of ``docs``: doc_id, all measures, base_failed, kept.

    Null ids stay null, equal rows are judged each for itself, an empty table
    gives no rows and other columns do not matter. A text without a word has
    zeros, no spans, and fails.
    """
    measured = docs.select(F.col(doc_id).cast("long").alias("doc_id"), measures(F.col(text), least).alias("m"))
    return measured.select(
        "doc_id", "m.*", base_failed(F.col("m")).alias("base_failed"),
        (~base_failed(F.col("m")) & ~repetitive(F.col("m"), most, longest)).alias("kept"))


def keep_varied(docs: DataFrame, text: str = "text", least: int = LEAST, most: float = COVERED,
                longest: int = LONGEST) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    judged = docs.select(F.struct("*").alias("row"), measures(F.col(text), least).alias("m"))
    return judged.filter(~base_failed(F.col("m")) & ~repetitive(F.col("m"), most, longest)).select("row.*")
