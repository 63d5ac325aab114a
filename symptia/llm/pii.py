"""Personal data, also where it is disguised, with spans in the source text.

Plain identifiers are found as they stand. Then a cascade of small transducers
normalises the text: look-alike characters become the Latin letters and digits
they resemble, spelled digits become digits, and disguised at and dot signs
become ``@`` and ``.``. Each transducer keeps the source offsets of what it
rewrites, so an identifier found in the normalised text is mapped back to the
source characters it came from.

All scans are linear in the length of a text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symptia.llm.common import documents, pieces_of, text_values

KINDS = ("email", "ip", "card", "phone")
BATCH_BYTES = 8 << 20
Span = tuple[int, int]

# --- plain identifiers -------------------------------------------------------

LOCAL = r"[A-Za-z0-9._%+-]"
# A run of local characters up to its @; the run is entered at its start only,
# so a long run without an @ is scanned once.
FROM_RUN = re.compile(rf"(?<!{LOCAL}){LOCAL}++@")
FROM_HERE = re.compile(rf"{LOCAL}++@")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    out, at = [], 0
    if "@" not in text:
        return out
    while True:
        # after a match the rest of a run may start an address of its own
        found = (FROM_HERE.match(text, at) if out and out[-1][1] == at else None) or FROM_RUN.search(text, at)
        if not found:
            return out
        domain = DOMAIN.match(text, found.end())
        at = domain.end() if domain else found.end()
        if domain:
            out.append((found.start(), at))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2])
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


FINDERS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# --- disguises ---------------------------------------------------------------

# fixed values: characters of other scripts that look like Latin ones
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i",
    "ɡ": "g", "․": ".", "。": ".", "·": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    " ": " ", " ": " ", " ": " ",
}
# full-width forms lie a fixed distance from ASCII, and every decimal digit of
# any script has a value
TRANSLATION = (
    {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    | {c: str(unicodedata.digit(chr(c))) for c in range(0x660, 0x1FBFA) if unicodedata.category(chr(c)) == "Nd"}
    | {ord(k): v for k, v in LOOK_ALIKES.items()}
)
TRANSLATED = re.compile("[" + "".join(map(re.escape, map(chr, TRANSLATION))) + "]")
INVISIBLE = re.compile("[­​-‏⁠﻿]+")

# fixed values: digits as words in the languages of the texts
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
SIGN_WORDS = {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "minus": "-", "hyphen": "-"}
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SIGN = "|".join(sorted(SIGN_WORDS, key=len, reverse=True))
# At least three spelled digits close together; numerals and spelled signs may
# stand between them.
SPELLED = re.compile(
    rf"(?<!\w)(?:(?:plus|más)[\s,]+)?(?:{_DIGIT})(?:[\s,-]+(?:(?:{_SIGN})[\s,-]+)?(?:{_DIGIT}|[0-9]+)(?!\w)){{2,}}", re.I)
SPELLED_PART = re.compile(rf"(?<!\w)(?:({_DIGIT})|({_SIGN})|([0-9]+))(?!\w)", re.I)

# fixed values: endings after which plain "at" and "dot" words are an address
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|name|pro|io|ai|dev|app|co|me|tv|eu|uk|us|ca|au|de|at|ch|fr|be|nl|es|pt|mx|ar|it|pl|se|no|dk|fi|ie|ru|br|in|jp|cn|test|example"

AT_WORD = r"(?:at|@|arobase|arroba|klammeraffe|ät)"
DOT_WORD = r"(?:dot|punkt|point|punto|\.)"
BRACKETED_AT = re.compile(rf"(?<=[\w.%+-])\s{{0,3}}[\[({{<]\s{{0,3}}{AT_WORD}\s{{0,3}}[\])}}>]\s{{0,3}}(?=\w)", re.I)
BRACKETED_DOT = re.compile(rf"(?<=\w)\s{{0,3}}[\[({{<]\s{{0,3}}{DOT_WORD}\s{{0,3}}[\])}}>]\s{{0,3}}(?=\w)", re.I)
# " at host dot tld": plain words are signs only together
SPOKEN = re.compile(
    r"(?<=[A-Za-z0-9_%+-])\s{1,3}(?:at|arobase|arroba)\s{1,3}"
    r"[A-Za-z0-9-]{1,63}(?:(?:\s{1,3}(?:dot|punkt|punto)\s{1,3}|\.)[A-Za-z0-9-]{1,63}){0,5}"
    r"\s{1,3}(?:dot|punkt|punto)\s{1,3}(?:" + ENDINGS + r")(?!\w)", re.I)
SPOKEN_PART = re.compile(r"\s{1,3}(?:(at|arobase|arroba)|dot|punkt|punto)\s{1,3}", re.I)
LOCAL_DOT = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}(?:dot|punkt|punto)\s{1,3}(?=[A-Za-z0-9._%+-]{1,64}@)", re.I)
SPACED_SIGN = re.compile(r"(?<=[A-Za-z0-9])\s{0,2}@\s{0,2}(?=[A-Za-z0-9-]{1,63}(?:\s?\.\s?[A-Za-z0-9-]{1,63})*\s?\.\s?[A-Za-z0-9])")


class Rewritten:
    """A text with the source offsets of its characters, kept as the stretches
    that a transducer rewrote; all other characters moved along unchanged."""

    def __init__(self, text: str, edits: list[tuple[int, int, int, int]] = [], earlier: Rewritten | None = None):
        self.text = text
        self.edits = edits  # target start and end, source start and end
        self.starts = [e[0] for e in edits]
        self.earlier = earlier  # the text these edits were made to, if not the source

    def _at(self, position: int, ends: bool) -> int:
        """The source offset of a boundary; inside a rewritten stretch the
        whole of it counts."""
        i = (bisect_left if ends else bisect_right)(self.starts, position) - 1
        if i < 0:
            return position
        _, end, source_start, source_end = self.edits[i]
        if position < end:
            return source_end if ends else source_start
        return source_end + position - end

    def original(self, span: Span) -> Span:
        span = self._at(span[0], False), self._at(span[1], True)
        return self.earlier.original(span) if self.earlier else span

    def substituted(self, changes: list[tuple[int, int, str]]) -> Rewritten:
        """With stretches (start, end, replacement) of this text replaced."""
        if not changes:
            return self
        out, edits, done, shift = [], [], 0, 0
        for start, end, new in changes:
            out += [self.text[done:start], new]
            at = start + shift
            edits.append((at, at + len(new), start, end))
            shift += len(new) - (end - start)
            done = end
        return Rewritten("".join([*out, self.text[done:]]), edits, self if self.edits else None)


def _spelled(text: str) -> list[tuple[int, int, str]]:
    changes = []
    for m in SPELLED.finditer(text):
        parts = list(SPELLED_PART.finditer(m[0]))
        if sum(bool(p[1]) for p in parts) >= 3:
            changes.append((*m.span(), "".join(
                DIGIT_WORDS[p[1].lower()] if p[1] else SIGN_WORDS[p[2].lower()] if p[2] else p[3] for p in parts)))
    return changes


def _digits_close(low: str) -> bool:
    words = low.replace(",", " ").replace("-", " ").split()
    if DIGIT_WORDS.keys().isdisjoint(words):
        return False
    at = [i for i, w in enumerate(words) if w in DIGIT_WORDS]
    return any(b - a <= 4 for a, b in zip(at, at[2:]))


def _spoken(text: str) -> list[tuple[int, int, str]]:
    return [(m.start() + p.start(), m.start() + p.end(), "@" if p[1] else ".")
            for m in SPOKEN.finditer(text) for p in SPOKEN_PART.finditer(m[0])]


def _each(pattern: re.Pattern, new: str) -> Callable[[str], list[tuple[int, int, str]]]:
    return lambda text: [(*m.span(), new) for m in pattern.finditer(text)]


def _dots(low: str) -> bool:
    return "dot" in low or "punkt" in low or "punto" in low


def _brackets(low: str) -> bool:
    return any(c in low for c in "[({<")


# What each transducer needs to find in the lower-cased text, and its changes.
TRANSDUCERS: tuple[tuple[Callable[[str], bool], Callable[[str], list[tuple[int, int, str]]]], ...] = (
    (lambda low: not low.isascii(), _each(INVISIBLE, "")),
    (_digits_close, _spelled),
    (_brackets, _each(BRACKETED_AT, "@")),
    (_brackets, _each(BRACKETED_DOT, ".")),
    (_dots, _spoken),
    (_dots, _each(LOCAL_DOT, ".")),
    (lambda low: " @" in low or "@ " in low, _each(SPACED_SIGN, "@")),
)


def normalise(text: str) -> Rewritten:
    """The text after all transducers. Look-alikes are replaced one for one
    and so keep their offsets."""
    out = Rewritten(text if text.isascii() or not TRANSLATED.search(text) else text.translate(TRANSLATION))
    low = out.text.lower()
    for present, change in TRANSDUCERS:
        if present(low):
            changed = out.substituted(change(out.text))
            if changed is not out:
                out, low = changed, changed.text.lower()
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: find(text) for kind, find in FINDERS.items()}


def all_spans(text: str, base: dict[str, list[Span]] | None = None) -> dict[str, list[Span]]:
    """The plain spans of each kind and, beside them, the disguised ones: those
    found in the normalised text that no plain span of the kind holds."""
    base = base_spans(text) if base is None else base
    seen = normalise(text)
    if seen.text == text:
        return base
    out = {}
    for kind, find in FINDERS.items():
        own = base[kind]
        starts = [s for s, _ in own]
        more = []
        for span in {seen.original(s) for s in find(seen.text)}:
            i = bisect_right(starts, span[0]) - 1
            if i < 0 or own[i][1] < span[1]:
                more.append(span)
        out[kind] = sorted(own + more)
    return out


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, the number of spans of each kind, base_sha256 (digest of
    the plain spans) and spans (plain and disguised ones, ``kind:start:end`` in
    code points, end exclusive).

    Null and empty texts have no spans; repeated rows are each searched. Rows
    stay where they are.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS),
                        ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, BATCH_BYTES):
            rows = []
            for own_id, value in zip(batch.column(0).to_pylist(), text_values(batch.column(1))):
                base = base_spans(value)
                found = all_spans(value, base)
                rows.append((own_id, *(len(found[k]) for k in KINDS),
                             hashlib.sha256(written(base).encode()).hexdigest(), written(found)))
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return documents(docs, doc_id, text).mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """The text with every span, plain or disguised, replaced by its kind.
    Spans that overlap are replaced together, named after the first."""
    found = sorted((a, -b, kind) for kind, spans in all_spans(text).items() for a, b in spans)
    out, done = [], 0
    for a, b, kind in found:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, -b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The rows with personal data replaced in ``text``; a null text stays
    null. All columns stay; ``n_chars`` names one that holds the length of the
    text, which is then counted anew (0 for null)."""
    run = F.arrow_udf(lambda texts: pa.array([None if t is None else redacted(t) for t in texts.to_pylist()], pa.string()), "string")
    out = docs.withColumn(text, run(F.col(text).cast("string")))
    if n_chars is None:
        return out
    return out.withColumn(n_chars, F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[n_chars].dataType))
