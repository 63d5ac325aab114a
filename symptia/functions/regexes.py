"""Rendering of the fixed patterns as Java expressions for ``rlike`` & co.

The patterns assume Unicode classes in which a word character is a letter,
number or underscore but not a combining mark. Java's own ``\\w`` disagrees on
marks and its ``\\b`` changed between releases, so both are spelled out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
_STARTS_WORD = re.compile(r"(?:\((?:\?:)?)*(?:\w|\\d|\[(?!\^))")


def java(pattern: str) -> str:
    """One fixed pattern as a case-insensitive Java expression."""
    out, i = [], 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\b":
            opens = _STARTS_WORD.match(pattern, i + 2)
            out.append(f"(?<!{WORD})" if opens else f"(?!{WORD})")
            i += 2
        elif pair == r"\w":
            out.append(WORD)
            i += 2
        elif pair.startswith("\\"):
            out.append(pair)
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "(?iuU)" + "".join(out)


def any_of(patterns: list[str]) -> str:
    """Several patterns as one alternation, so a text is scanned once."""
    return java("|".join(f"(?:{p})" for p in patterns))


def any_literal(literals: list[str]) -> str:
    return "(?iu)" + "|".join(re.sub(r"([^\w\s])", r"\\\1", s, flags=re.ASCII) if s.isascii() else s for s in literals)


def matches(col: Column, patterns: list[str] | str) -> Column:
    return col.rlike(any_of([patterns] if isinstance(patterns, str) else patterns))


def has_literal(col: Column, literals: list[str]) -> Column:
    return col.rlike(any_literal(literals))


def extract_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(java(pattern)), F.lit(group))
