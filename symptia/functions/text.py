"""Scalar text functions, all built from Spark SQL expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv

SPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in fv.WHITESPACE) + "]"
ALNUM_RUN = f"[{fv.ARABIC_BLOCK}]+|[a-zA-Z0-9]+"
ANY_DIGITS = "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Nd")
# Pieces that concatenate back to the text: an optional blank with a word or
# with a run of signs, else a run of blanks.
PIECE = r"[ \t\r\n]?[\p{L}\p{N}]+|[ \t\r\n]?[^ \t\r\n\p{L}\p{N}]+|[ \t\r\n]+"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``fn``;
    nesting the expression itself would multiply the plan."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def strip(c: Column | str) -> Column:
    return F.btrim(as_col(c), F.lit(fv.WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return strip(c) == ""


def words(c: Column | str) -> Column:
    """White-space tokens, without empty ones."""
    return F.filter(F.split(as_col(c), SPACE_CLASS + "+"), lambda w: w != "")


# ------------------------------------------------------------ script and fold
def normalize(c: Column | str) -> Column:
    bare = F.regexp_replace(as_col(c), fv.DIACRITICS, "")
    return strip(F.translate(bare, fv.FOLD_FROM, fv.FOLD_TO))


def fold_alef(c: Column | str) -> Column:
    return F.translate(as_col(c), fv.ALEF_FROM, fv.ALEF_TO)


def with_folded(c: Column | str) -> Column:
    """The text, followed by its alef-folded form when that differs."""
    c = as_col(c)
    folded = fold_alef(c)
    return F.when(folded != c, F.concat_ws("\n", c, folded)).otherwise(c)


def ascii_digits(c: Column | str) -> Column:
    return F.translate(as_col(c), fv.ARABIC_DIGITS, fv.ASCII_DIGITS)


def plain_digits(c: Column | str) -> Column:
    """Decimal digits of any script as ASCII digits."""
    return F.translate(as_col(c), ANY_DIGITS, "".join(str(unicodedata.digit(d)) for d in ANY_DIGITS))


def _arabic_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[^{fv.ARABIC_BLOCK}]", ""))


def detect_language(c: Column | str) -> Column:
    c = as_col(c)
    dense = F.regexp_replace(c, SPACE_CLASS, "")
    return (
        F.when(F.length(dense) == 0, "english")
        .when(_arabic_chars(dense) / F.length(dense) > fv.ARABIC_SHARE, "arabic")
        .when(c.rlike(fv.FRANCO_DIGITS) & c.rlike("[a-zA-Z]"), "franco_arab")
        .otherwise("english")
    )


def detect_script(c: Column | str) -> Column:
    return F.when(as_col(c).rlike(f"[{fv.ARABIC_LETTERS}]"), "arabic").otherwise("english")


def output_script(preference: Column, response_script: Column, message: Column) -> Column:
    return (
        F.when(preference == "english", "english")
        .when(response_script == "franco", "franco")
        .when(preference == "auto", detect_script(message))
        .otherwise("arabic")
    )


def _letters(token: Column) -> Column:
    """One Latin-letter token in Arabic script."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = F.translate(token, upper, upper.lower())
    for latin, arabic in fv.DIGRAPHS + [s for s in fv.SINGLES if len(s[1]) > 1]:
        out = F.replace(out, F.lit(latin), F.lit(arabic))
    # translate() drops source characters that have no counterpart, so the
    # letters written as nothing go last
    kept = [s for s in fv.SINGLES if len(s[1]) == 1]
    dropped = [s for s in fv.SINGLES if s[1] == ""]
    return F.translate(
        out,
        "".join(s for s, _ in kept + dropped),
        "".join(d for _, d in kept),
    )


def transliterate(c: Column | str) -> Column:
    def one(t: Column) -> Column:
        share = _arabic_chars(t) / F.greatest(F.length(t), F.lit(1))
        return F.when(share > fv.ARABIC_SHARE, t).otherwise(_letters(t))

    tokens = words(c)
    # white space is not part of the mapping, so a text without Arabic
    # characters is mapped in one go instead of token by token
    return F.when(
        as_col(c).rlike(f"[{fv.ARABIC_BLOCK}]"), F.array_join(F.transform(tokens, one), " ")
    ).otherwise(_letters(F.array_join(tokens, " ")))


# -------------------------------------------------------------------- tokens
def keyword_tokens(c: Column | str) -> Column:
    """Lower-cased word runs longer than two characters, minus stop words."""
    runs = F.regexp_extract_all(as_col(c), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))
    return F.filter(F.transform(runs, F.lower), lambda w: ~w.isin(fv.STOP_WORDS))


def symptom_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit(ALNUM_RUN), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Windows of ``n`` tokens joined by one space, in position order."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
            lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def pieces(c: Column | str) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit(PIECE), F.lit(0))


def token_count(c: Column | str) -> Column:
    return F.size(pieces(c))


# --------------------------------------------------------------- projections
def category(name: Column | str) -> Column:
    """Category of the first hint found in the name."""
    lowered = F.lower(as_col(name))
    out = F.lit(fv.DEFAULT_CATEGORY)
    for keyword, label in reversed(fv.CATEGORY_HINTS):
        out = F.when(F.contains(lowered, F.lit(keyword)), label).otherwise(out)
    return out


def truncate(c: Column | str, chars: int) -> Column:
    return F.substring(as_col(c), 1, chars)


def ellipsis(c: Column | str, chars: int = fv.ERROR_CHARS) -> Column:
    c = as_col(c)
    return F.when(F.length(c) > chars, F.concat(truncate(c, chars), F.lit("..."))).otherwise(c)


def _upper(x: Column) -> Column:
    """The upper half of a double's bits; the rest is exact in another."""
    return bind(x * F.lit(134217729.0), lambda wide: wide - (wide - x))  # 2**27 + 1


def rounded(c: Column | str, digits: int) -> Column:
    """Half-even rounding of the binary value, to 0 to 15 digits; NULL stays
    NULL, and a value of another number type is taken as a double.

    2.675 is a little less than it prints and gives 2.67; only values that lie
    exactly between two results (0.125) go to the even one. The scaled value is
    held as a product and its exact rounding error, so that what is left over
    the next smaller result is compared with one half without any error. From
    2**53 units on a double has no digits to lose.
    """
    scale = 10.0**digits
    top = scale * 134217729.0
    top = top - (top - scale)

    def error(x: Column, product: Column) -> Column:
        return bind(_upper(x), lambda high: bind(x - high, lambda low: (
            (high * F.lit(top) - product) + high * F.lit(scale - top) + low * F.lit(top)) + low * F.lit(scale - top)))

    def nearest(product: Column, rest: Column) -> Column:
        # a product rounded up to a whole number belongs to the one before
        whole = F.floor(product).cast("double")
        below = F.when((whole == product) & (rest < 0), whole - 1).otherwise(whole)

        def settle(low: Column) -> Column:
            over = (product - low) - F.lit(0.5)
            up = (over > -rest) | ((over == -rest) & (low % 2 == 1))
            return F.when(up, low + 1).otherwise(low) / F.lit(scale)

        return bind(below, settle)

    def signless(x: Column) -> Column:
        return bind(x * F.lit(scale), lambda product: F.when(F.isnan(x) | (product >= F.lit(2.0**53)), x).otherwise(
            bind(error(x, product), lambda rest: nearest(product, rest))))

    # every step is bound once: written out, a report of many rates would be
    # more code than a generated method may hold
    return bind(as_col(c).cast("double"), lambda value: bind(
        signless(F.abs(value)), lambda result: F.when(value < 0, -result).otherwise(result)))


def ordered_distinct(*parts: Column) -> Column:
    """Distinct non-empty values in order of first appearance."""
    return F.array_distinct(F.filter(F.array(*parts), lambda q: q.isNotNull() & (q != "")))


def fill(template: str, **values: Column) -> Column:
    """A prompt template with ``{name}`` slots as one concatenation."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)
