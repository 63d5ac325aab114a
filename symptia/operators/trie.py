"""Many terms looked up in texts at once.

The terms form a trie in three flat arrays: a transition is the number
``state << 21 | character``, transitions are sorted, and the state a transition
leads to is its rank. All places of a batch of texts descend together, one
character a step; a place leaves when no term continues there. As every place
starts a descent of its own, no failure links are needed. The texts never leave
the task: what comes out is which term was found, and where first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 21
END = (1 << BITS) - 1  # no character has this number
BLANK = 32
# Characters of terms in one trie (12 bytes each at most), and places of a
# text that descend at a time.
TRIE_CHARACTERS = 4_000_000
PLACES = 1 << 20

FOUND = "array<struct<key:string,pass_no:int,n:int,pos:int>>"


def characters(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all values, each followed by END, and where each starts."""
    codes = np.frombuffer("\0".join([*values, ""]).encode("utf-32-le"), dtype=np.uint32).copy()
    ends = np.cumsum([len(v) + 1 for v in values], dtype=np.int64) - 1
    codes[ends] = END
    return codes, np.append(0, ends[:-1] + 1)


def build(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions, the state after each first character, and the term that
    ends in a state (-1: none), of distinct non-empty keys."""
    codes, starts = characters(keys)
    transitions, ending = [], [np.full(1, -1, dtype=np.int32)]
    active, states, known, depth = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64), 1, 0
    while len(active):
        nexts = codes[starts[active] + depth].astype(np.int64)
        going = nexts != END
        ending[-1][states[~going] - (known - len(ending[-1]))] = active[~going]
        active, depth = active[going], depth + 1
        new, place = np.unique(states[going] << BITS | nexts[going], return_inverse=True)
        transitions.append(new)
        ending.append(np.full(len(new), -1, dtype=np.int32))
        states, known = known + place, known + len(new)
    transitions = np.concatenate(transitions)
    first = np.zeros(1 << BITS, dtype=np.int32)
    roots = transitions[transitions <= END]
    first[roots] = np.arange(1, len(roots) + 1)
    return transitions, first, np.concatenate(ending)


def descend(codes: np.ndarray, trie: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, terms) of all occurrences, overlapping ones too."""
    transitions, first, ending = trie
    for low in range(0, len(codes), PLACES):
        states = first[codes[low : low + PLACES]].astype(np.int64)
        places = np.flatnonzero(states)
        states, places, depth = states[places], places + low, 1
        while len(places):
            terms = ending[states]
            hit = terms >= 0
            if hit.any():
                yield places[hit], terms[hit].astype(np.int64)
            wanted = states << BITS | codes[places + depth]
            at = np.searchsorted(transitions, wanted)
            at[at == len(transitions)] = 0
            on = transitions[at] == wanted
            places, states, depth = places[on], at[on] + 1, depth + 1


def firsts(values: list[str], trie: tuple, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, term, blanks before) of the first occurrence of each term in
    each value, by value and term."""
    codes, starts = characters(values)
    found = list(descend(codes, trie))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    places, terms = (np.concatenate(c) for c in zip(*found))
    value = np.searchsorted(starts, places, side="right") - 1
    order = np.lexsort((places, value * n_terms + terms))
    value, terms, places = value[order], terms[order], places[order]
    new = np.append(True, (value[1:] != value[:-1]) | (terms[1:] != terms[:-1]))
    value, terms, places = value[new], terms[new], places[new]
    blanks = np.append(0, np.cumsum(codes == BLANK))
    return value, terms, blanks[places] - blanks[starts[value]]


def _batches(*columns: list[str]) -> Iterator[slice]:
    """Rows that hold about PLACES characters together; a longer one is alone."""
    sizes = np.sum([[len(v) for v in c] for c in columns], axis=0)
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > PLACES:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def found_terms(index: DataFrame, joined: Column, lowered: Column, longest: int) -> Column:
    """The terms (``key`` of the index) a text holds, as an array.

    ``joined`` is the text as tokens with one blank between. A term of up to
    ``longest`` tokens found there has ``pass_no`` 1, its tokens as ``n`` and
    the token it first starts in as ``pos``; one that only ``lowered`` holds
    has ``pass_no`` 2. A dictionary of any size is cut into tries of bounded
    size by the hash of its terms. A NULL text holds none.
    """
    spark = index.sparkSession
    terms = index.select("key")
    parts = -(-(terms.agg(F.sum(F.length("key"))).first()[0] or 0) // TRIE_CHARACTERS)
    columns = [F.array().cast(FOUND)]
    for part in range(parts):
        keys = [r.key for r in terms.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).collect()]
        if keys:
            columns.append(F.arrow_udf(_finder(spark.sparkContext.broadcast((keys, build(keys))), longest), FOUND)(joined, lowered))
    return F.concat(*columns) if len(columns) > 2 else columns[-1]


def _finder(shared, longest: int):
    def find(joined: pa.Array, lowered: pa.Array) -> pa.Array:
        keys, trie = shared.value
        inner = np.array([k.count(" ") for k in keys], dtype=np.int32)
        joined, lowered = ([v or "" for v in c.to_pylist()] for c in (joined, lowered))
        parts = []
        for batch in _batches(joined, lowered):
            row, term, pos = firsts(joined[batch], trie, len(keys))
            fits = inner[term] < longest
            row, term, pos = row[fits], term[fits], pos[fits]
            other, late, _ = firsts(lowered[batch], trie, len(keys))
            only = ~np.isin(other * len(keys) + late, row * len(keys) + term)
            other, late = other[only], late[only]
            ones, none = np.ones(len(row), dtype=np.int64), np.zeros(len(other), dtype=np.int64)
            parts.append(np.stack([
                np.append(row, other) + batch.start, np.append(term, late), np.append(ones, none + 2),
                np.append(inner[term] + 1, none), np.append(pos, none)]))
        row, term, pass_no, n, pos = np.concatenate(parts, axis=1) if parts else np.empty((5, 0), dtype=np.int64)
        order = np.argsort(row, kind="stable")
        offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(joined)))).astype(np.int32)
        items = pa.StructArray.from_arrays(
            [pa.array(keys, pa.string()).take(pa.array(term[order])),
             *[pa.array(c[order].astype(np.int32)) for c in (pass_no, n, pos)]], names=["key", "pass_no", "n", "pos"])
        return pa.ListArray.from_arrays(pa.array(offsets), items)

    return find
